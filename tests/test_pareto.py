"""Rows that nothing dominates, with fronts of many blocks, against all pairs."""

import numpy as np
import pytest

from fieldloom.operators import joins as J


@pytest.mark.parametrize("count,block", [(1, 16), (2, 16), (3, 8), (4, 4096)])
def test_fronts_equal_all_pairs(spark, count, block):
    x = np.random.default_rng(count).integers(0, 9, (240, count)).astype(float)
    names = [f"f{i}" for i in range(count)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    want = {i for i, a in enumerate(x) if not ((x <= a).all(axis=1) & (x < a).any(axis=1)).any()}
    assert {r.i for r in J.pareto(df, names, block).collect()} == want


def test_a_front_of_all_rows_keeps_them(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(500)], "i int, f double, g double")
    assert J.pareto(df, ["f", "g"], 32).count() == 500


def test_nothing_nulls_and_repeats(spark):
    schema = "i int, f double, g double"
    assert J.pareto(spark.createDataFrame([], schema), ["f", "g"]).count() == 0
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, None, 0.0), (4, 1.0, 3.0), (5, float("nan"), 1.0)], schema)
    assert {r.i for r in J.pareto(df, ["f", "g"]).collect()} == {1, 2, 5}
