"""Exact flows and fields on triangles against them."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import analytic

TRIANGLE = "tri int, ax double, ay double, bx double, by double, cx double, cy double, ua double, ub double, uc double, va double, vb double, vc double"


def test_profiles(spark):
    y = F.col("y")
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "y double").orderBy("y")
    got = df.select(analytic.couette(y, 4.0, 2.0), analytic.plane_poiseuille(y, -8.0, 1.0, 1.0), analytic.pipe_poiseuille(y, -8.0, 1.0, 1.0)).collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (1, 1, 1.5), (2, 0, 0)]
    for f in (lambda: analytic.couette(y, 1, 0), lambda: analytic.plane_poiseuille(y, 1, 0, 1), lambda: analytic.pipe_poiseuille(y, 1, 1, -1)):
        with pytest.raises(ValueError):
            f()


def _square(spark, u):
    """A unit square of two triangles with velocity (u(y), 0) at its corners."""
    row = lambda i, *p: (i, *(float(v) for q in p for v in q), *(u(q[1]) for q in p), 0.0, 0.0, 0.0)
    return spark.createDataFrame([row(0, (0, 0), (1, 0), (1, 1)), row(1, (0, 0), (1, 1), (0, 1))], TRIANGLE)


@pytest.mark.parametrize("values", [[["ua", "ub", "uc"]], [["ua", "ub", "uc"], ["va", "vb", "vc"]]])
def test_a_linear_flow_is_met_exactly(spark, values):
    profile = spark.range(11).select(F.col("id").alias("sample"), (F.col("id") / 8).alias("at"))
    profile = profile.withColumn("exact", analytic.couette(F.col("at"), 3.0, 1.0))
    r = analytic.compare_against_analytic(_square(spark, lambda y: 3.0 * y), profile, "tri", values, 0.5).first()
    assert (r["n"], r["n_outside"]) == (11, 2) and r["rmse"] == pytest.approx(0, abs=1e-12) and r["r2"] == pytest.approx(1)


def test_another_flow_is_told(spark):
    profile = spark.createDataFrame([(0, 0.5, 2.5)], "sample int, at double, exact double")
    r = analytic.compare_against_analytic(_square(spark, lambda y: 3.0 * y), profile, "tri", [["ua", "ub", "uc"]], 0.5).first()
    assert r["max_error"] == pytest.approx(1.0) and r["n_outside"] == 0
    r = analytic.compare_against_analytic(_square(spark, lambda y: 3.0 * y), profile.withColumn("at", F.lit(7.0)), "tri", [["ua", "ub", "uc"]], 0.5).first()
    assert (r["n"], r["n_outside"], r["rmse"]) == (1, 1, None)
