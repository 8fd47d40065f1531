"""Clusters of windows of series: k-means over window means, with sampled seeds, and a silhouette from cluster sums.

Points are rows; centres, k by features numbers, are the only thing that the driver holds. A step of Lloyd's iteration is
one partial aggregate of k rows a task, and seeding by k-means|| takes a few passes however many centres there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, indexed, keys, ordered
from .series import label_runs


class Clusters(NamedTuple):
    labels: DataFrame
    centers: DataFrame
    runs: DataFrame
    silhouette: DataFrame


def window_means(df: DataFrame, by, order, features: Sequence[str], window: int) -> DataFrame:
    """(by, start, features): means of each full window of ``window`` rows of a series; shorter series have none."""
    k = keys(by)
    ahead = ordered(by, order).rowsBetween(0, window - 1)
    w = indexed(df, by, order, "start").select(*k, "start", *(F.avg(F.col(c).cast("double")).over(ahead).alias(c) for c in features), F.count(F.lit(1)).over(ahead).alias("n_"))
    return w.filter(F.col("n_") == window).drop("n_")


def _squared(features: Sequence[str], center: Sequence[float]) -> Column:
    return sum((F.col(f) - F.lit(float(c))) * (F.col(f) - F.lit(float(c))) for f, c in zip(features, center))


def nearest_center(features: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """(d, label): squared distance and number of the nearest centre, the first of equals."""
    return F.array_min(F.array(*(F.struct(_squared(features, c).alias("d"), F.lit(j).alias("label")) for j, c in enumerate(centers))))


def seed_centers(points: DataFrame, ids: Sequence[str], features: Sequence[str], k: int, seed: int = 0, rounds: int = 4) -> list[list[float]]:
    """k centres by k-means||: each round draws about 2k points with chances in proportion to squared distance.

    The draws come from a hash of ids and seed, so they don't depend on partitions. The few candidates are weighted by
    the points nearest to them and thinned on the driver. Fewer distinct points than k give fewer centres.
    """
    u = lambda r: F.pmod(F.xxhash64(F.lit(f"{seed}:{r}"), *ids), F.lit(1 << 53)) / float(1 << 53)
    first = points.groupBy().agg(F.min(F.struct(u(0).alias("u"), *features)).alias("p")).first()["p"]
    if first is None:
        return []
    found = [[first[f] for f in features]]
    for r in range(1, rounds + 1):
        near = points.withColumn("near_", nearest_center(features, found))
        cost = near.agg(F.sum("near_.d")).first()[0]
        if not cost:
            break
        drawn = near.filter(u(r) < 2.0 * k * F.col("near_.d") / cost).select(*features).distinct().collect()
        found += sorted([row[f] for f in features] for row in drawn)
    weights = dict(points.groupBy(nearest_center(features, found)["label"].alias("j")).count().collect())
    x, w = np.array(found), np.array([weights.get(j, 0) for j in range(len(found))], float)
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    while len(chosen) < min(k, len(x)):
        d = w * np.min([((x - x[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        if not d.sum():
            break
        chosen.append(int(rng.choice(len(x), p=d / d.sum())))
    return x[chosen].tolist()


def kmeans(points: DataFrame, ids: Sequence[str], features: Sequence[str], k: int, *, centers: Sequence[Sequence[float]] | None = None, max_iter: int = 100, seed: int = 0) -> tuple[DataFrame, list[list[float]]]:
    """(points with ``label``, centres) of Lloyd's iteration until no centre moves, max_iter steps at most.

    Ties go to the first centre; a centre without points stays where it is. Rows with a null feature are left out.
    """
    if k < 1 or max_iter < 1:
        raise ValueError("k and max_iter must be at least 1")
    points = cut(points.dropna(subset=list(features)))
    at = [list(map(float, c)) for c in centers] if centers is not None else seed_centers(points, ids, features, k, seed)
    if not at:
        return points.withColumn("label", F.lit(None).cast("int")), []
    for _ in range(max_iter):
        labelled = points.withColumn("label", nearest_center(features, at)["label"])
        moved = {r["label"]: [r[f] for f in features] for r in labelled.groupBy("label").agg(*(F.avg(f).alias(f) for f in features)).collect()}
        new = [moved.get(j, c) for j, c in enumerate(at)]
        still = np.allclose(new, at, rtol=1e-13, atol=0)
        at = new
        if still:
            break
    return points.withColumn("label", nearest_center(features, at)["label"]), at


def silhouette(labelled: DataFrame, features: Sequence[str]) -> DataFrame:
    """labelled with ``silhouette`` by squared distances: (b - a) / max(a, b) of the mean squared distance to the other rows of the own cluster, a, and of the nearest other one, b.

    A cluster's count, sums and sum of squares give every mean squared distance, so no two rows meet. 0 for a lone row,
    or where there is one cluster only.
    """
    square = sum(F.col(f) * F.col(f) for f in features)
    sums = labelled.groupBy("label").agg(F.count("*").alias("n"), F.avg(square).alias("q"), *(F.avg(f).alias(f) for f in features)).orderBy("label").collect()
    if len(sums) < 2:
        return labelled.withColumn("silhouette", F.lit(0.0))
    mean = lambda r: F.greatest(square - 2 * sum(F.col(f) * F.lit(r[f]) for f in features) + F.lit(r["q"]), F.lit(0.0))
    a = b = F.lit(None).cast("double")
    for r in sums:
        own = F.col("label") == r["label"]
        a = F.when(own, mean(r) * (r["n"] / (r["n"] - 1)) if r["n"] > 1 else F.lit(None)).otherwise(a)
        b = F.when(own, b).otherwise(F.least(b, mean(r)))
    return labelled.withColumns({"a_": a, "b_": b}).withColumn("silhouette", F.coalesce((F.col("b_") - F.col("a_")) / F.greatest("a_", "b_", F.lit(1e-30)), F.lit(0.0))).drop("a_", "b_")


def trajectory_clustering(df: DataFrame, by, order, features: Sequence[str], window: int, k: int, *, centers: Sequence[Sequence[float]] | None = None, max_iter: int = 100, seed: int = 0) -> Clusters:
    """Regimes of series: k-means over the means of sliding windows, as labels, centres, runs of equal labels and silhouette.

    labels (by, start, features, label, silhouette) has a row per window; runs (by, run, label, start, end, length) are
    half-open in windows; silhouette is the mean over all windows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    b = keys(by)
    points = window_means(df, b, order, features, window)
    labelled, at = kmeans(points, [*b, "start"], features, k, centers=centers, max_iter=max_iter, seed=seed)
    labels = silhouette(labelled, features)
    table = df.sparkSession.createDataFrame([(j, *c) for j, c in enumerate(at)], "label int, " + ", ".join(f"`{f}` double" for f in features))
    counted = table.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label", "left").fillna(0, ["n"])
    runs = label_runs(labels, b, "start", "label").withColumn("end", F.col("end") + 1)
    return Clusters(labels, counted, runs, labels.agg(F.avg("silhouette").alias("silhouette")))
