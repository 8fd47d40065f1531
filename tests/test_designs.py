import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import meshhash as M
from fieldloom.operators import sampling as S
from fieldloom.plans import facade


def sobol(spark, n, d, **options):
    x = S.sobol_point(F.col("id"), [(0.0, 1.0)] * d, **options)
    return np.array(spark.range(n).select(F.array(*x).alias("x")).orderBy("id").toPandas()["x"].tolist())


def test_sobol_points_fill_every_stratum(spark):
    x = sobol(spark, 256, 10)
    assert x[:4, :3].tolist() == [[0, 0, 0], [0.5, 0.5, 0.5], [0.75, 0.25, 0.25], [0.25, 0.75, 0.75]]
    for d in range(10):
        for k in (4, 16, 64, 256):
            assert sorted(np.floor(x[:k, d] * k).astype(int)) == list(range(k)), (d, k)
    boxes = {(int(a * 16), int(b * 16)) for a, b in x[:, :2]}
    assert len(boxes) == 256
    shifted = sobol(spark, 64, 3, seed=5)
    assert not np.allclose(shifted, x[:64, :3]) and all(sorted(np.floor(shifted[:, d] * 64).astype(int)) == list(range(64)) for d in range(3))
    with pytest.raises(ValueError):
        S.sobol_point(F.lit(1), [(0, 1)] * 11)


def test_walks_move_each_input_once_by_a_level(spark):
    bounds = {"a": (0.0, 3.0), "b": (-1.0, 1.0), "c": (10.0, 10.6)}
    rows = S.morris_walks(spark.range(200), "id", bounds, 4).orderBy("id", "step").collect()
    assert len(rows) == 800
    orders = set()
    for i in range(200):
        walk = rows[4 * i : 4 * i + 4]
        assert walk[0].moved is None and walk[0].sign is None and {r.moved for r in walk[1:]} == {"a", "b", "c"}
        orders.add(tuple(r.moved for r in walk[1:]))
        for r, s in zip(walk, walk[1:]):
            for c, (lo, hi) in bounds.items():
                want = s.sign * (hi - lo) / 3 if c == s.moved else 0.0
                assert s[c] - r[c] == pytest.approx(want) and lo - 1e-9 <= s[c] <= hi + 1e-9
    assert len(orders) == 6
    assert rows == S.morris_walks(spark.range(200).repartition(9), "id", bounds, 4).orderBy("id", "step").collect()


def test_effects_of_a_linear_and_of_a_mixed_model(spark):
    bounds = {"a": (0.0, 2.0), "b": (0.0, 1.0), "c": (5.0, 9.0)}
    got = {r.moved: r for r in facade.run("morris_sensitivity", spark.range(300), "id", lambda x: 3 * x["a"] - 5 * x["b"] + 0 * x["c"], bounds).collect()}
    assert [(got[c].mu_star, got[c].n) for c in "abc"] == [(pytest.approx(6), 300), (pytest.approx(5), 300), (pytest.approx(0, abs=1e-9), 300)]
    assert all(r.sigma == pytest.approx(0, abs=1e-6) for r in got.values())
    mixed = {r.moved: r for r in S.morris_sensitivity(spark.range(300), "id", lambda x: x["a"] * x["b"], bounds).collect()}
    assert mixed["a"].sigma > 0.1 and mixed["b"].sigma > 0.1
    with pytest.raises(ValueError):
        S.morris_walks(spark.range(1), "id", bounds, 1)


def test_mesh_hashes_know_no_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    tri = [rng.choice(30, 3, replace=False).tolist() for _ in range(40)]
    turn = rng.permutation(30)
    meshes = {
        "a": (dict(enumerate(x)), tri),
        "b": ({100 + int(turn[i]): x[i] for i in range(30)}, [[100 + int(turn[v]) for v in reversed(t)] for t in reversed(tri)]),
        "moved": (dict(enumerate(x)) | {3: x[3] + 1e-6}, tri),
        "near": (dict(enumerate(x)) | {3: x[3] + 1e-12}, tri),
        "fewer": (dict(enumerate(x)), tri[1:]),
        "twice": (dict(enumerate(x)), [*tri, tri[0]]),
        "open": (dict(enumerate(x)), []),
    }
    p = spark.createDataFrame([(m, i, *map(float, v)) for m, (points, _) in meshes.items() for i, v in points.items()], "mesh string, pid long, x double, y double, z double").repartition(5)
    c = spark.createDataFrame([(m, t) for m, (_, cells) in meshes.items() for t in cells], "mesh string, v array<long>").repartition(3)
    got = {r.mesh: r for r in M.mesh_classes(M.mesh_hashes(p, c, "mesh", "pid", ["x", "y", "z"], "v"), "mesh").collect()}
    assert {m: r.same_as for m, r in got.items()} == {"a": "a", "b": "a", "moved": "moved", "near": "a", "fewer": "fewer", "twice": "twice", "open": "open"}
    assert (got["a"].n_points, got["a"].n_cells, got["open"].n_cells) == (30, 40, 0)
    assert M.mesh_classes(M.mesh_hashes(p.limit(0), c.limit(0), "mesh", "pid", ["x", "y", "z"], "v"), "mesh").collect() == []


def test_null_hashes_equal_nothing(spark):
    df = spark.createDataFrame([("a", "t", None), ("b", "t", None), ("c", "t", "c"), ("d", "t", "c")], "mesh string, topology_hash string, coordinate_hash string")
    assert {r.mesh: r.same_as for r in M.mesh_classes(df, "mesh").collect()} == {"a": "a", "b": "b", "c": "c", "d": "c"}
