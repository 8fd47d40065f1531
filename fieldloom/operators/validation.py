"""Scores by folds of a user's model, and intervals of a user's statistic; what runs in a task is bounded by a parameter."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keys

TRAIN_AT_MOST = 100_000
SUBSET_AT_MOST = 200_000


def _drawn(seed: int, of: Sequence[str]) -> Column:
    """A number from 0 to 2**32 - 1 by hash of seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *(F.col(c).cast("string") for c in of))), 1, 8), 16, 10).cast("long")


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with an intercept."""
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def predict_linear(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return model[0] + x @ model[1:]


def kfold_models(df: DataFrame, ids, features: Sequence[str], target: str, fit: Callable, k: int = 5, seed: int = 0, train_at_most: int = TRAIN_AT_MOST) -> dict[int, object]:
    """{fold: what fit(x, y) gives on the rows of the other folds}; folds train beside each other, a task each.

    A row's fold is a hash of its ids. Where a fold has more than train_at_most rows to train on, it takes a hash sample of
    about that many; so many, and k models, are all that one process holds.
    """
    i, f = keys(ids), list(features)
    rows = df.select(*i, *f, target).dropna(subset=[*f, target])
    share = min(1.0, train_at_most / max(rows.count() * (k - 1) / k, 1))
    fold = F.pmod(_drawn(seed, i), F.lit(k)).cast("int")
    taken = rows.withColumn("own_", fold)
    if share < 1:
        taken = taken.filter(_drawn(seed + 1, i) < int(share * (1 << 32)))
    trained = taken.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("fold <> own_")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = fit(pdf[f].to_numpy(float), pdf[target].to_numpy(float))
        return pd.DataFrame({"fold": [int(pdf["fold"].iloc[0])], "model": [pickle.dumps(model)]})

    found = trained.select("fold", *f, target).groupBy("fold").applyInPandas(run, "fold int, model binary")
    return {r["fold"]: pickle.loads(bytes(r["model"])) for r in found.collect()}


def kfold_scores(df: DataFrame, ids, features: Sequence[str], target: str, fit: Callable, predict: Callable, k: int = 5, seed: int = 0, train_at_most: int = TRAIN_AT_MOST) -> DataFrame:
    """(fold, n, rmse, r2) of predict(model, x) on each fold by the model of the others. All rows are judged, in batches.

    Rows with a null are left out; folds without rows, or without others to train on, have no row.
    """
    if k < 2:
        raise ValueError("two folds at least")
    i, f = keys(ids), list(features)
    models = kfold_models(df, i, f, target, fit, k, seed, train_at_most)
    sent = df.sparkSession.sparkContext.broadcast(models)  # k models
    rows = df.dropna(subset=[*f, target]).select(F.pmod(_drawn(seed, i), F.lit(k)).cast("int").alias("fold"), *(F.col(c).cast("double").alias(c) for c in f), F.col(target).cast("double").alias("y_"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                if fold in sent.value:
                    yield pd.DataFrame({"fold": part["fold"], "y": part["y_"], "p": np.asarray(predict(sent.value[fold], part[f].to_numpy(float)), float)})

    e = rows.mapInPandas(run, "fold int, y double, p double")
    gap = (F.col("y") - F.col("p")) ** 2
    spread = F.var_pop("y") * F.count("*")
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(gap)).alias("rmse"), (1 - F.try_divide(F.sum(gap), spread)).alias("r2"))


def weighted_mean(x: np.ndarray, w: np.ndarray) -> float:
    return float((x * w).sum() / w.sum())


def weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """The least value up to which half of the weight lies."""
    order = np.argsort(x, kind="stable")
    return float(x[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)])


def little_bootstraps(df: DataFrame, by, tie, x: str, statistic: Callable[[np.ndarray, np.ndarray], float], *, subsets: int = 10, exponent: float = 0.7, replicates: int = 100, alpha: float = 0.1, seed: int = 0, subset_at_most: int = SUBSET_AT_MOST) -> DataFrame:
    """(by, n, estimate, lower, upper): the percentile interval of statistic(values, weights) by a bag of little bootstraps.

    Of a group of n rows, ``subsets`` disjoint hash samples of about n ** exponent rows, subset_at_most at most, go to a
    task each; there weights that sum to n are drawn again and again. The ends of the subsets' intervals are averaged. So a
    group of any size costs its subsets only, and no group meets in a task. A group too small for disjoint subsets of 30
    rows is one subset, of all its rows. Nulls are left out.
    """
    b, t = keys(by), keys(tie)
    rows = df.select(*b, *t, F.col(x).cast("double").alias("x_")).dropna(subset=["x_"])
    n = rows.groupBy(*b).agg(F.count("*").alias("n_"))
    size = F.least(F.greatest(F.pow(F.col("n_"), F.lit(float(exponent))), F.lit(30.0)), F.lit(float(subset_at_most)))
    sized = rows.join(n, b).withColumn("size_", F.when(size * subsets <= F.col("n_"), size).otherwise(F.col("n_").cast("double")))
    place = F.floor(_drawn(seed, t) / float(1 << 32) * F.col("n_") / F.col("size_")).cast("int")
    taken = sized.withColumn("subset_", place).filter(F.col("subset_") < F.when(F.col("size_") < F.col("n_"), subsets).otherwise(1))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, total = np.sort(pdf["x_"].to_numpy()), int(pdf["n_"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(repr(key).encode())])
        found = [statistic(values, w) for w in rng.multinomial(total, np.full(len(values), 1 / len(values)), size=replicates)]
        lower, upper = np.quantile(found, [alpha / 2, 1 - alpha / 2])
        one = {c: [v] for c, v in zip([*b, "subset_"], key)}
        return pd.DataFrame(one | {"n_": [total], "estimate": [statistic(values, np.ones(len(values)))], "lower": [lower], "upper": [upper]})

    kinds = dict(taken.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in b), "subset_ int", "n_ long", "estimate double", "lower double", "upper double"])
    each = taken.select(*b, "subset_", "n_", "x_").groupBy(*b, "subset_").applyInPandas(run, schema)
    return each.groupBy(*b).agg(F.max("n_").alias("n"), *(F.avg(c).alias(c) for c in ("estimate", "lower", "upper")))
