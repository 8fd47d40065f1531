"""Cases on common grids against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import tensors


def _dense(rows, name, shape, tile):
    """One case's channel put together from its blocks."""
    out = np.full(shape, np.nan)
    across = [-(-n // tile) for n in shape]
    for r in rows:
        if r["name"] == name:
            at = np.unravel_index(r["tile"], across)
            out[tuple(slice(i * tile, i * tile + w) for i, w in zip(at, r["shape"]))] = np.reshape(r["data"], r["shape"])
    return out


def test_a_triangle_on_a_grid(spark):
    cells = spark.createDataFrame([("a", 1, [[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]], [0.0, 10.0, 20.0]), ("b", 1, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0]], [1.0, 1.0, 1.0])], "case string, cell int, corners array<array<double>>, p array<double>")
    params = spark.createDataFrame([("a", 3.0), ("b", 4.0), ("none", 5.0)], "case string, mu double")
    grid = tensors.common_grid(cells, "corners", 2, 10)
    assert grid.shape == (11, 11) and grid.step == pytest.approx(1.04)
    rows = tensors.cases_to_grid_tensors(cells, params, "case", "cell", "corners", ["p"], ["mu"], resolution=10, tile=4).collect()
    of = {c: [r for r in rows if r["case"] == c] for c in ("a", "b", "none")}
    x, y = (np.arange(11) * grid.step + o for o in grid.origin)
    x, y = np.meshgrid(x, y, indexing="ij")
    mask = (x >= 0) & (y >= 0) & (x + y <= 10)
    assert np.array_equal(_dense(of["a"], "mask", (11, 11), 4), mask)
    assert np.allclose(_dense(of["a"], "p", (11, 11), 4), np.where(mask, x + 2 * y, 0), atol=1e-5)
    assert (_dense(of["b"], "mu", (11, 11), 4) == 4).all()
    assert (_dense(of["none"], "mask", (11, 11), 4) == 0).all()
    assert np.allclose(_dense(of["none"], "sdf", (11, 11), 4), -np.sqrt(200) * 1.04)
    ones, zeros = np.argwhere(mask), np.argwhere(~mask)
    want = np.zeros((11, 11))
    for mine, others, sign in ((ones, zeros, 1), (zeros, ones, -1)):
        for p in mine:
            want[tuple(p)] = sign * 1.04 * np.sqrt(((others - p) ** 2).sum(axis=1).min())
    assert np.allclose(_dense(of["a"], "sdf", (11, 11), 4), want, atol=1e-5)


def test_tetrahedra_are_linear_inside(spark):
    cells = spark.createDataFrame([("a", 1, [[0.0, 0.0, 0.0], [4.0, 0.0, 0.0], [0.0, 4.0, 0.0], [0.0, 0.0, 4.0]], [0.0, 4.0, 8.0, 12.0]), ("a", 2, [[0.0] * 3, [1.0] * 3, [2.0] * 3, [3.0] * 3], [9.0] * 4)], "case string, cell int, corners array<array<double>>, p array<double>")
    grid = tensors.Grid((0.0, 0.0, 0.0), 1.0, (5, 5, 5))
    got = {r["node"]: r["p"] for r in tensors.rasterise(cells, "case", "cell", "corners", ["p"], grid).collect()}
    want = {i * 25 + j * 5 + k: i + 2 * j + 3 * k for i in range(5) for j in range(5) for k in range(5) if i + j + k <= 4}
    assert got == pytest.approx(want)


def test_cells_beyond_the_grid_and_without_coordinates(spark):
    cells = spark.createDataFrame([("a", 1, [[50.0, 50.0], [60.0, 50.0], [50.0, 60.0]], [1.0] * 3), ("a", 2, [[float("nan"), 0.0], [1.0, 0.0], [0.0, 1.0]], [1.0] * 3), ("a", 3, None, [1.0] * 3)], "case string, cell int, corners array<array<double>>, p array<double>")
    assert tensors.rasterise(cells, "case", "cell", "corners", ["p"], tensors.Grid((0.0, 0.0), 1.0, (5, 5))).count() == 0
    with pytest.raises(ValueError):
        tensors.common_grid(cells.filter(F.lit(False)), "corners", 2, 10)
