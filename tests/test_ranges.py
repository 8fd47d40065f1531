"""Running sums, ranks and pairs of one large group that lies in many partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import aggregates as A
from fieldloom.operators import diagnostics as D
from fieldloom.operators.frames import running


def test_running_sums_of_hot_small_and_missing_groups(spark):
    rows = [("hot", i, float(i % 7)) for i in range(2000)] + [("small", i, 1.0) for i in range(3)] + [(None, i, 2.0) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(7)
    got = running(df, "g", "i", {"n": F.lit(1), "s": F.col("v")}, {"all": F.sum("v")}).collect()
    assert len(got) == len(rows)
    sums = {"hot": np.cumsum([r[2] for r in rows[:2000]]), "small": [1, 2, 3], None: [2, 4, 6, 8]}
    for r in got:
        assert r["n"] == r["i"] + 1 and r["s"] == pytest.approx(sums[r["g"]][r["i"]]) and r["all"] == pytest.approx(sums[r["g"]][-1])


def test_running_sums_of_nothing(spark):
    assert running(spark.createDataFrame([], "g string, i int"), "g", "i", {"n": F.lit(1)}, {"m": F.count("*")}).collect() == []


def test_ks_of_one_group_in_many_ranges(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=900).round(2), rng.normal(0.3, 1, 1100).round(2)
    df = spark.createDataFrame([("all", float(x), True) for x in a] + [("all", float(x), False) for x in b], "g string, x double, f boolean")
    every = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= x).mean() - (b <= x).mean()) for x in every)
    assert A.ks_statistic(df, "g", "x", F.col("f")).first()["ks"] == pytest.approx(want)


def test_percentiles_by_rank(spark):
    x = np.random.default_rng(5).exponential(size=777)
    df = spark.createDataFrame([("g", float(v)) for v in x] + [("one", 4.0), ("g", None)], "g string, x double")
    got = {r["g"]: r for r in D.propagate(df, "g", F.col("x") * 2).collect()}
    assert [got["g"][c] for c in ("p5", "p50", "p95")] == pytest.approx(list(np.percentile(2 * x, [5, 50, 95])))
    assert got["g"]["mean"] == pytest.approx(2 * x.mean()) and got["one"]["p95"] == 8.0


@pytest.mark.parametrize("block", [5, 16, 64, 1000])
def test_motifs_by_pairs_of_blocks(spark, block):
    w, n = 6, 150
    v = np.random.default_rng(7).normal(size=n)
    v[100:106] = v[20:26] * 3 + 1  # the planted pair
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("short", i, 1.0) for i in range(6)], "g string, i int, x double")
    got = D.motifs(df, "g", "i", "x", w, k=3, block=block).orderBy("distance").collect()
    s = np.lib.stride_tricks.sliding_window_view(v, w)
    s = (s - s.mean(axis=1, keepdims=True)) / (s.std(axis=1, keepdims=True) + 1e-12)
    d = np.sqrt(np.maximum(2 * (w - s @ s.T), 0))
    i = np.arange(len(s))
    d[np.abs(i[:, None] - i) <= w // 2] = np.inf
    best = sorted({(round(d[a].min(), 9), min(a, int(d[a].argmin())), max(a, int(d[a].argmin()))) for a in i})[:3]
    assert (got[0]["a"], got[0]["b"]) == (20, 100)
    assert [(r["a"], r["b"]) for r in got[1:]] == [p[1:] for p in best[1:]] and [r["distance"] for r in got] == pytest.approx([p[0] for p in best], abs=1e-6)
