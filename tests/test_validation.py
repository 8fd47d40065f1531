import numpy as np
import pytest

from fieldloom.operators import validation as V


def test_scores_by_folds(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 600)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(600)] + [(900, None, 0.0, 1.0)], "id long, a double, b double, y double").repartition(7)
    got = V.kfold_scores(df, "id", ["a", "b"], "y", V.fit_linear, V.predict_linear, 4).collect()
    assert sorted(r.fold for r in got) == [0, 1, 2, 3] and sum(r.n for r in got) == 600
    assert all(r.rmse < 0.15 and r.r2 > 0.99 for r in got)
    models = V.kfold_models(df, "id", ["a", "b"], "y", V.fit_linear, 4)
    import hashlib

    fold = np.array([int(hashlib.md5(f"0-{i}".encode()).hexdigest()[:8], 16) % 4 for i in range(600)])
    for k in range(4):
        assert models[k] == pytest.approx(V.fit_linear(x[fold != k], y[fold != k]))
        r = next(r for r in got if r.fold == k)
        assert r.rmse == pytest.approx(np.sqrt(np.mean((V.predict_linear(models[k], x[fold == k]) - y[fold == k]) ** 2)))
    sizes = V.kfold_models(df, "id", ["a", "b"], "y", lambda x, y: len(y), 4, train_at_most=90)
    assert all(40 < n < 140 for n in sizes.values())
    assert V.kfold_scores(df.limit(0), "id", ["a"], "y", V.fit_linear, V.predict_linear).collect() == []
    with pytest.raises(ValueError):
        V.kfold_scores(df, "id", ["a"], "y", V.fit_linear, V.predict_linear, 1)


def test_little_bootstraps_give_the_interval_of_the_mean(spark):
    rng = np.random.default_rng(1)
    rows = [("big", i, float(v)) for i, v in enumerate(rng.normal(5, 2, 20_000))] + [("small", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 50))] + [("one", 0, 3.0), ("big", -1, None)]
    df = spark.createDataFrame(rows, "g string, i long, x double")
    got = {r.g: r for r in V.little_bootstraps(df, "g", "i", "x", V.weighted_mean).collect()}
    assert got["big"].n == 20_000 and got["big"].estimate == pytest.approx(5, abs=0.1)
    assert got["big"].upper - got["big"].lower == pytest.approx(2 * 1.645 * 2 / np.sqrt(20_000), rel=0.15)
    x = np.array([r[2] for r in rows if r[0] == "small"])
    assert got["small"].estimate == pytest.approx(x.mean()) and got["small"].upper - got["small"].lower == pytest.approx(2 * 1.645 * x.std() / np.sqrt(50), rel=0.3)
    assert (got["one"].lower, got["one"].upper) == (3.0, 3.0)
    again = {r.g: r for r in V.little_bootstraps(df.repartition(9), "g", "i", "x", V.weighted_mean).collect()}
    assert {g: (r.lower, r.upper) for g, r in again.items()} == {g: (pytest.approx(r.lower), pytest.approx(r.upper)) for g, r in got.items()}


def test_weighted_median():
    x, w = np.array([3.0, 1.0, 2.0]), np.array([1, 1, 5])
    assert V.weighted_median(x, w) == 2.0 and V.weighted_median(x, np.array([0, 4, 0])) == 1.0
    assert V.weighted_mean(x, w) == pytest.approx(14 / 7)
