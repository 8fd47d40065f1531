"""Work and memory that must not grow faster than the input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import frames, joins, probes, relations, tensors
from fieldloom.plans import queries


def test_density_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(probes, "radius_pairs", None)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.uniform(-10, 10, 150), np.full(50, 3.25), np.arange(-6, 6) * 0.75, [1e6]])
    rows = [(i, float(v), i % 3 + 1) for i, v in enumerate(x)]
    p = spark.createDataFrame([*rows, (900, None, 1), (901, float("nan"), 1), (902, 0.5, None)], "i long, x double, m int")
    got = {r.i: r.density for r in probes.density_1d(p, "i", "x", "m", 0.75).collect()}
    m = np.array([r[2] for r in rows], float)
    assert set(got) == {*range(len(x)), 902}
    for i, at in [*enumerate(x), (902, 0.5)]:
        q = np.abs(x - at) / 0.75
        want = (m * np.where(q < 1, 1 - 1.5 * q**2 + 0.75 * q**3, np.where(q < 2, 0.25 * (2 - q) ** 3, 0))).sum() * 2 / 3 / 0.75
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_nodes_of_cells_are_not_sorted(spark):
    cells = spark.createDataFrame([("a", i, [[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]], [float(i)] * 3) for i in (3, 1, 2)], "case string, cell long, corners array<array<double>>, p array<double>")
    held = tensors.rasterise(cells, "case", "cell", "corners", ["p"], tensors.Grid((0.0, 0.0), 1.0, (5, 5)))
    assert "min_by" not in held._jdf.queryExecution().executedPlan().toString()
    rows = held.collect()
    assert len(rows) == 15 and {r.p for r in rows} == {1.0}


def test_running_sums_take_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "RUN", 100)
    d = spark.range(3000).select(F.lit("g").alias("g"), "id")
    r = frames.running(d, "g", "id", {"s": F.col("id")}, {"n": F.count("*")})
    assert max(x[0] for x in r.groupBy(F.spark_partition_id()).count().select("count").collect()) < 1000
    assert {(x.id, x.s, x.n) for x in r.collect()} == {(i, i * (i + 1) // 2, 3000) for i in range(3000)}


def test_a_class_of_equal_meshes_spreads_over_tasks(spark):
    m = spark.range(400).select("id", F.lit("t").alias("t"), F.lit("c").alias("c")).unionByName(spark.createDataFrame([(900, "t", None), (901, "t", None), (902, "u", "c")], "id long, t string, c string"))
    pairs = relations.same_mesh(m, "id", "t", "c", block=50, pairs_of_task=5_000)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(400) for a in range(b)} and pairs.count() == 400 * 399 // 2
    assert max(r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()) < 40_000


def test_radius_search_takes_distances_of_places_and_spreads_a_cell(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 50)
    points = spark.range(2000).select("id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).unionByName(spark.createDataFrame([(7, 4.0, 2.0), (None, 1.0, 2.5), (None, 1.0, 2.5), (8, None, 2.0), (9, float("nan"), 2.0), (10, -0.5, 2.0), (11, 3.1, 4.2), (7, 4.0, 2.0)], "id long, x double, y double"))
    targets = spark.range(300).select(F.col("id").alias("tid"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).unionByName(spark.createDataFrame([(900, 5.5, 2.0), (901, None, None), (902, 90.0, 90.0)], "tid long, x double, y double"))
    found = joins.radius_search(points, targets, "id", "tid", ["x", "y"], 3.0, 3, pairs_of_key=10_000, pairs_of_task=50_000).cache()
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < found.count() / 4
    p, t = points.toPandas().to_numpy(float), targets.toPandas().to_numpy(float)
    with np.errstate(invalid="ignore"):
        d = np.sqrt(((t[:, None, 1:] - p[None, :, 1:]) ** 2).sum(axis=2))
    key = lambda r: tuple(-1.0 if x is None or np.isnan(x) else float(x) for x in r)
    want = sorted(key((t[i, 0], p[j, 0], np.round(d[i, j], 3))) for i, j in zip(*np.nonzero(d <= 3.0)))
    assert sorted(map(key, found.collect())) == want
    empty = joins.radius_search(points.limit(0), targets, "id", "tid", ["x", "y"], 3.0)
    assert empty.columns == ["tid", "id", "distance"] and empty.collect() == []
    monkeypatch.setattr(joins, "radius_pairs", None)
    assert queries.QUERIES["radius_search"](spark, "/root/testdata/sf0.001").count() == 18
