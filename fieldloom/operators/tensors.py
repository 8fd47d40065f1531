"""Cases with meshes of their own as dense tensor blocks on one common grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut


class Grid(NamedTuple):
    """A grid of equal steps; nodes are numbered with the last axis fastest."""

    origin: tuple[float, ...]
    step: float
    shape: tuple[int, ...]

    @property
    def strides(self) -> list[int]:
        return [math.prod(self.shape[a + 1 :]) for a in range(len(self.shape))]

    def index(self, node: Column, axis: int) -> Column:
        return F.floor(node / self.strides[axis]) % self.shape[axis]


def common_grid(cells: DataFrame, corners: str, dim: int, resolution: int) -> Grid:
    """The grid over the box of all cells, widened by 2 % at each side; the longest axis has ``resolution`` steps (2 at least)."""
    p = cells.select(F.explode(corners).alias("p_"))
    row = p.agg(*(f(F.col("p_")[a]).alias(f"{n}{a}") for a in range(dim) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if row[0] is None:
        raise ValueError("no cell, so no grid")
    low, span = [row[f"lo{a}"] for a in range(dim)], [row[f"hi{a}"] - row[f"lo{a}"] for a in range(dim)]
    low, high = [b - s * 0.02 for b, s in zip(low, span)], [b + s + s * 0.02 for b, s in zip(low, span)]
    span = [b - a for a, b in zip(low, high)]
    if not max(span) > 0:
        raise ValueError("the box of the cells is empty")
    step = max(span) / max(2, resolution)
    return Grid(tuple(low), step, tuple(max(1, round(s / step) + 1) for s in span))


def _determinant(m: Sequence[Sequence[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = F.lit(0.0)
    for j, x in enumerate(m[0]):
        total = total + (1 if j % 2 == 0 else -1) * x * _determinant([[*r[:j], *r[j + 1 :]] for r in m[1:]])
    return total


def rasterise(cells: DataFrame, case: str, cell: str, corners: str, fields: Sequence[str], grid: Grid, few: int = 50_000) -> DataFrame:
    """(case, node, fields) of the nodes inside a triangle (2 axes) or tetrahedron (3 axes), linear between its corners.

    ``corners`` is an array of points, a field an array of the corners' values. A cell gives its own nodes, so nothing is
    joined; of several cells that hold a node the smallest id counts. Flat cells and such with missing coordinates hold none.
    """
    dim = len(grid.shape)
    at = lambda c, a: F.col(corners)[c][a]
    edges = [[at(c, a) - at(0, a) for c in range(1, dim + 1)] for a in range(dim)]
    # The edges' matrix is inverted once a cell; a node then costs a product with it.
    parts = {"d_": _determinant(edges)}
    for i in range(dim):
        for a in range(dim):
            minor = [[x for k, x in enumerate(r) if k != i] for b, r in enumerate(edges) if b != a]
            parts[f"m{i}{a}_"] = (1 if (i + a) % 2 == 0 else -1) * (_determinant(minor) if minor else F.lit(1.0))
    nodes = cells.withColumns(parts).filter("d_ != 0 AND NOT isnan(d_)")
    for a, (o, n) in enumerate(zip(grid.origin, grid.shape)):
        every = [(at(c, a) - o) / grid.step for c in range(dim + 1)]
        # A step of slack at both ends; the test below decides.
        first, last = F.greatest(F.floor(F.least(*every)), F.lit(0)), F.least(F.ceil(F.greatest(*every)), F.lit(n - 1))
        nodes = nodes.withColumn(f"i{a}_", F.explode(F.when(first <= last, F.sequence(first, last))))
    shift = [grid.origin[a] + F.col(f"i{a}_") * grid.step - at(0, a) for a in range(dim)]
    share = []
    for i in range(dim):
        total = F.lit(0.0)
        for a in range(dim):
            total = total + F.col(f"m{i}{a}_") * shift[a]
        share.append(total / F.col("d_"))
    rest = F.lit(1.0)
    for s in share:
        rest = rest - s
    share = [rest, *share]
    inside = F.least(*share) >= -1e-12
    node = F.lit(0).cast("long")
    for a, n in enumerate(grid.shape):
        node = node * n + F.col(f"i{a}_")
    values = []
    for f in fields:
        total = F.lit(0.0)
        for c, s in enumerate(share):
            total = total + s * F.col(f)[c]
        values.append(total.alias(f))
    hits = nodes.filter(inside).select(F.col(case).alias(case), node.alias("node"), F.col(cell).alias("cell_"), F.struct(*values).alias("v_"))
    # Ids alone are reduced, in a hash a task, whose size is the grid's; values follow for the cells that count.
    first = cut(hits.groupBy(case, "node").agg(F.min("cell_").alias("cell_")).select(F.col(case).alias("case_"), F.col("node").alias("node_"), F.col("cell_").alias("first_")))
    first = F.broadcast(first) if first.count() <= few else first
    same = F.col(case).eqNullSafe(F.col("case_")) & (F.col("node") == F.col("node_")) & F.col("cell_").eqNullSafe(F.col("first_"))
    held = hits.join(first, same).groupBy(case, "node").agg(F.first("v_").alias("v_"))
    return held.select(case, "node", *(F.col("v_")[f].alias(f) for f in fields))


def _nearer(step: float):
    @F.pandas_udf("array<double>")
    def lower(rows: pd.Series) -> pd.Series:
        square: dict[int, np.ndarray] = {}
        out = []
        for row in rows:
            n = len(row)
            if n not in square:
                i = np.arange(n) * step
                square[n] = (i[:, None] - i[None, :]) ** 2
            out.append((square[n] + np.asarray(row)[None, :]).min(axis=1))
        return pd.Series(out)

    return lower


def signed_distance(nodes: DataFrame, case: str, valid: str, grid: Grid) -> DataFrame:
    """(case, node, sdf) of all nodes: how far the nearest invalid node is from a valid one, less than 0 the other way round.

    The exact distance transform takes an axis at a time, so what meets in a task is a line of the grid. A case without
    nodes of the other kind gets the grid's diagonal.
    """
    far = float("inf")
    lower = _nearer(grid.step)
    d = nodes.select(case, "node", F.when(F.col(valid), far).otherwise(0.0).alias("out_"), F.when(F.col(valid), 0.0).otherwise(far).alias("in_"))
    for a, stride in enumerate(grid.strides):
        if grid.shape[a] == 1:
            continue
        i = grid.index(F.col("node"), a)
        line = d.groupBy(case, (F.col("node") - i * stride).alias("line_")).agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), "out_", "in_"))).alias("l_"))
        line = line.select(case, "line_", lower(F.col("l_.out_")).alias("out_"), lower(F.col("l_.in_")).alias("in_"))
        d = line.select(case, "line_", F.posexplode(F.arrays_zip("out_", "in_")).alias("i_", "z_"))
        d = d.select(case, (F.col("line_") + F.col("i_") * stride).alias("node"), "z_.out_", "z_.in_")
    most = grid.step * math.sqrt(sum((n - 1) ** 2 for n in grid.shape))
    gap = F.sqrt("out_") - F.sqrt("in_")
    return d.select(case, "node", F.greatest(F.least(gap, F.lit(most)), F.lit(-most)).alias("sdf"))


def cases_to_grid_tensors(
    cells: DataFrame, params: DataFrame, case: str, cell: str, corners: str, fields: Sequence[str], parameters: Sequence[str] = (),
    dim: int = 2, resolution: int = 48, tile: int = 32, grid: Grid | None = None,
) -> DataFrame:
    """(case, tile, role, channel, name, shape, data): every case's channels on one grid, in tiles of ``tile`` nodes a side.

    Inputs are the signed distance to the edge of the mesh, the mask of nodes in it, and each parameter laid over the
    grid; targets are the fields, 0 where the mask is. ``params`` has a row a case; a case without cells has an empty
    mask. ``data`` is row by row, the last axis fastest, as 32-bit floats, so a row is bounded by the tile.
    """
    grid = grid or common_grid(cells, corners, dim, resolution)
    total = math.prod(grid.shape)
    held = rasterise(cells, case, cell, corners, fields, grid)
    dense = params.select(case, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("node"))
    dense = cut(dense.join(held.withColumn("valid_", F.lit(True)), [case, "node"], "left").withColumn("valid_", F.coalesce("valid_", F.lit(False))))
    nodes = dense.join(signed_distance(dense, case, "valid_", grid), [case, "node"])
    index = [grid.index(F.col("node"), a) for a in range(len(grid.shape))]
    number, offset, shape = F.lit(0).cast("long"), F.lit(0).cast("long"), []
    for a, n in enumerate(grid.shape):
        t = F.floor(index[a] / tile)
        number = number * math.ceil(n / tile) + t
        width = F.least(F.lit(n) - t * tile, F.lit(tile)).cast("int")
        shape.append(width)
        offset = offset * width + index[a] % tile
    cut_ = nodes.groupBy(case, number.alias("tile"), F.array(*shape).alias("shape"))
    held = cut_.agg(F.array_sort(F.collect_list(F.struct(offset.alias("o"), F.col("sdf"), F.col("valid_").cast("double").alias("mask"), *(F.coalesce(f, F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(fields))))).alias("d_"))
    held = held.join(params.select(case, *(F.col(p).cast("double").alias(f"p{i}_") for i, p in enumerate(parameters))), case)
    of = lambda c: F.col(f"d_.{c}").cast("array<float>")
    inputs = [("sdf", of("sdf")), ("mask", of("mask")), *((p, F.array_repeat(F.col(f"p{i}_").cast("float"), F.size("d_"))) for i, p in enumerate(parameters))]
    targets = [(f, of(f"f{i}")) for i, f in enumerate(fields)]
    rows = [F.struct(F.lit(role).alias("role"), F.lit(i).alias("channel"), F.lit(n).alias("name"), c.alias("data")) for role, group in (("input", inputs), ("target", targets)) for i, (n, c) in enumerate(group)]
    return held.select(case, "tile", "shape", F.explode(F.array(*rows)).alias("r_")).select(case, "tile", "r_.role", "r_.channel", "r_.name", "shape", "r_.data")
