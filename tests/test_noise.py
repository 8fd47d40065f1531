from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import assimilation as A
from fieldloom.operators import diagnostics as D
from fieldloom.operators import series as T


def test_noise_is_normal_and_does_not_depend_on_partitions(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("x"))
    x = np.array([r[0] for r in df.select(A._normal(1, df.columns)).collect()])
    assert x.mean() == pytest.approx(0, abs=0.03) and x.std() == pytest.approx(1, abs=0.02) and abs(np.mean(np.abs(x) < 1) - 0.683) < 0.015
    ensemble = df.select(F.lit("g").alias("g"), "id", F.randn(3).alias("a")).cache()
    update = lambda e, **k: {r.id: r.a for r in A.enkf_update(e, "g", ["a"], F.col("a"), F.lit(2.0), 1.0, **k).collect()}
    first = update(ensemble)
    assert first == pytest.approx(update(ensemble.repartition(9))) and first != pytest.approx(update(ensemble, seed=1))
    assert np.mean(list(first.values())) == pytest.approx(1, abs=0.05) and np.var(list(first.values())) == pytest.approx(0.5, abs=0.05)


def test_more_buckets_give_the_same_importance(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 101).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 2 * F.col("a"))
    found = [{r.input: r.importance for r in D.permutation_importance(df, "id", ["a", "b"], "y", lambda x: 2 * x["a"], 2, n).collect()} for n in (None, 5000)]
    spread = 2 * np.std(np.arange(101)) * np.sqrt(2)
    for got in found:
        assert got["b"] == 0 and got["a"] == pytest.approx(spread, rel=0.15)


def test_the_mean_of_a_series_is_rounded_once(spark):
    v = np.round(np.random.default_rng(6).exponential(50, (60, 70)), 2) * 0.73105857863
    rows = [(k, i, float(x)) for k, s in enumerate(v) for i, x in enumerate(s)] + [(60, 0, 1e30), (60, 1, 1.0), (60, 2, -1e30)]
    rows += [(61, 0, float("inf")), (61, 1, 1.0), (62, 0, None), (63, 0, 2.0), (63, 1, None), (64, 0, 0.0), (65, 0, 1.7e308), (65, 1, 1e308)]
    want = {k: float(sum(map(Fraction, s.tolist())) / len(s)) for k, s in enumerate(v)} | {60: 1 / 3, 61: 0.0, 62: 0.0, 63: 2.0, 64: 0.0, 65: 0.0}
    for n in (1, 9):
        df = spark.createDataFrame(rows[::-1] if n == 1 else rows, "k int, i int, x double").repartition(n)
        assert {r.k: r.mean for r in T.features(df, "k", "i", "x").collect()} == want
