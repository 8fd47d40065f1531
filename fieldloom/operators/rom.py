"""Reduced-order models: snapshots are rows (snapshot, point, value); Spark sums Gram matrices, the driver solves them.

The Gram matrix has the size of the smaller side (snapshots or points of one case), which a parameter bounds; the large
side only meets sums, so it may grow without bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_AT_MOST = 4096


def gram(snapshots: DataFrame, side: str, other: str, value: str, at_most: int = GRAM_AT_MOST) -> tuple[list, np.ndarray]:
    """(ids, G) with G[i, j] = sum over ``other`` of x[i] * x[j]. One shuffle on ``other``, then partial sums."""
    n = snapshots.select(side).distinct().count()
    if n > at_most:
        raise ValueError(f"{n} values of {side}: the Gram matrix is bounded by {at_most}")
    x = snapshots.select(F.col(side).alias("i"), F.col(other).alias("o"), F.col(value).cast("double").alias("x"))
    rows = x.groupBy("o").agg(F.collect_list(F.struct("i", "x")).alias("r"))  # at most ``at_most`` entries
    pairs = rows.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b")).filter("a.i <= b.i")
    sums = pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("g")).collect()
    ids = sorted({r.i for r in sums} | {r.j for r in sums})
    at = {v: k for k, v in enumerate(ids)}
    g = np.zeros((len(ids), len(ids)))
    for r in sums:
        g[at[r.i], at[r.j]] = g[at[r.j], at[r.i]] = r.g
    return ids, g


@dataclass
class Modes:
    """Singular values, descending, and each snapshot's unit temporal coefficients by mode."""

    snapshots: list
    sigma: np.ndarray
    temporal: np.ndarray

    @property
    def energy(self) -> np.ndarray:
        """Cumulative share of the total energy."""
        return np.cumsum(self.sigma**2) / max((self.sigma**2).sum(), 1e-30)


def centred(snapshots: DataFrame, point: str, value: str) -> DataFrame:
    mean = snapshots.groupBy(point).agg(F.avg(value).alias("mean_"))
    return snapshots.join(mean, point).withColumn(value, F.col(value) - F.col("mean_")).drop("mean_")


def pod(snapshots: DataFrame, snapshot: str, point: str, value: str, center: bool = False) -> Modes:
    """Method of snapshots: eigenpairs of the snapshots' Gram matrix."""
    ids, g = gram(centred(snapshots, point, value) if center else snapshots, snapshot, point, value)
    w, v = np.linalg.eigh(g)
    order = np.argsort(w)[::-1]
    return Modes(ids, np.sqrt(np.maximum(w[order], 0)), v[:, order])


def spatial_modes(snapshots: DataFrame, modes: Modes, snapshot: str, point: str, value: str, n_modes: int) -> DataFrame:
    """(mode, point, phi): sum over snapshots of x * temporal / sigma; each mode's largest entry is positive."""
    spark = snapshots.sparkSession
    keep = [m for m in range(n_modes) if modes.sigma[m] > 1e-12 * max(modes.sigma[0], 1e-300)]
    table = spark.createDataFrame([(s, m, float(modes.temporal[k, m] / modes.sigma[m])) for k, s in enumerate(modes.snapshots) for m in keep], f"`{snapshot}` {dict(snapshots.dtypes)[snapshot]}, mode int, w double")
    phi = snapshots.join(F.broadcast(table), snapshot).groupBy("mode", point).agg(F.sum(F.col(value) * F.col("w")).alias("phi"))
    sign = phi.groupBy("mode").agg(F.signum(F.max_by("phi", F.abs("phi"))).alias("s_"))
    return phi.join(F.broadcast(sign), "mode").withColumn("phi", F.col("phi") * F.col("s_")).drop("s_")


def project(snapshots: DataFrame, phi: DataFrame, snapshot: str, point: str, value: str) -> DataFrame:
    """(snapshot, mode, a): coefficients of snapshots on spatial modes."""
    return snapshots.join(phi, point).groupBy(snapshot, "mode").agg(F.sum(F.col(value) * F.col("phi")).alias("a"))


def reconstruction_error(snapshots: DataFrame, phi: DataFrame, snapshot: str, point: str, value: str) -> DataFrame:
    """(snapshot, residual, relative): norm of what the modes leave over, by Pythagoras for orthonormal modes."""
    total = snapshots.groupBy(snapshot).agg(F.sum(F.col(value) ** 2).alias("t_"))
    kept = project(snapshots, phi, snapshot, point, value).groupBy(snapshot).agg(F.sum(F.col("a") ** 2).alias("k_"))
    r = F.sqrt(F.greatest(F.col("t_") - F.coalesce("k_", F.lit(0.0)), F.lit(0.0)))
    return total.join(kept, snapshot, "left").select(snapshot, r.alias("residual"), (r / (F.sqrt("t_") + 1e-30)).alias("relative"))


def mahalanobis(df: DataFrame, columns: list[str], ridge: float = 1e-12) -> DataFrame:
    """df with ``score``: distance from the mean under the sample covariance plus ridge; moments in one aggregate."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    m = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if m["m0"] is None or m["c0_0"] is None:
        return df.withColumn("score", F.lit(0.0))
    cov = np.eye(d) * ridge
    for i, j in pairs:
        cov[i, j] += m[f"c{i}_{j}"]
        if i != j:
            cov[j, i] += m[f"c{i}_{j}"]
    inv = np.linalg.inv(cov)
    z = [F.col(c) - float(m[f"m{i}"]) for i, c in enumerate(columns)]
    q = sum(z[i] * z[j] * float(inv[i, j]) for i in range(d) for j in range(d))
    return df.withColumn("score", F.sqrt(F.greatest(q, F.lit(0.0))))


def ridge_regression(df: DataFrame, inputs: list[str], target: str, ridge: float = 0.0) -> np.ndarray:
    """Weights with the intercept last, from the normal equations summed in one pass."""
    cols = [*(F.col(c).cast("double") for c in inputs), F.lit(1.0)]
    n = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(cols[i] * F.col(target)).alias(f"b{i}") for i in range(n)]
    r = df.agg(*aggs).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
    return np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(n)]))


def envelope(training: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """new with max_z, mahalanobis and outside: how far coefficients lie from those of the training, and how many beyond their range.

    max_z uses population deviations, mahalanobis the sample covariance; the training is one aggregate.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    stats = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    m = training.agg(*stats, *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    cov = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]) + 1e-12 * np.eye(d)
    inv = np.linalg.inv(cov)
    z = [F.col(c) - float(m[f"m{i}"]) for i, c in enumerate(columns)]
    scaled = [F.abs(x) / (float(m[f"s{i}"]) + 1e-30) for i, x in enumerate(z)]
    q = sum(z[i] * z[j] * float(inv[i, j]) for i in range(d) for j in range(d))
    outside = sum(((F.col(c) < float(m[f"lo{i}"])) | (F.col(c) > float(m[f"hi{i}"]))).cast("long") for i, c in enumerate(columns))
    return new.withColumns({"max_z": F.greatest(*scaled) if d > 1 else scaled[0], "mahalanobis": F.sqrt(F.greatest(q, F.lit(0.0))), "outside": outside})


def _products(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """Sums of products of columns, in one pass; as many as there are pairs of modes."""
    row = df.agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([[row[f"p{i}_{j}"] or 0.0 for j in range(len(right))] for i in range(len(left))])


def subspace_drift(points: DataFrame, old: list[str], new: list[str]) -> np.ndarray:
    """Principal angles, ascending, between the spans of two sets of mode columns of one table of points.

    The angles follow from three Gram matrices; their norm is the Grassmann distance.
    """
    whiten = lambda g: np.linalg.inv(np.linalg.cholesky(g))
    a, b = whiten(_products(points, old, old)), whiten(_products(points, new, new))
    return np.sort(np.arccos(np.clip(np.linalg.svd(a @ _products(points, old, new) @ b.T, compute_uv=False), -1, 1)))


def gappy_coefficients(points: DataFrame, modes: list[str], value: str, known: str) -> np.ndarray:
    """Least-squares coefficients of a field on modes from the points where it is known; zeros if it is known nowhere."""
    seen = points.filter(known)
    return np.linalg.lstsq(_products(seen, modes, modes), _products(seen, modes, [value])[:, 0], rcond=None)[0]


def gappy_reconstruct(points: DataFrame, modes: list[str], value: str, known: str) -> DataFrame:
    """points with ``reconstructed``: the field that the coefficients give everywhere."""
    a = gappy_coefficients(points, modes, value, known)
    return points.withColumn("reconstructed", sum(F.col(c) * float(w) for c, w in zip(modes, a)))


def mode_summary(phi: DataFrame, sigma: DataFrame) -> DataFrame:
    """(mode, singular_value, energy_fraction, spatial_norm) of modes (mode, point, phi) and (mode, sigma)."""
    total = sigma.agg(F.sum(F.col("sigma") ** 2).alias("total_"))
    norm = phi.groupBy("mode").agg(F.sqrt(F.sum(F.col("phi") ** 2)).alias("spatial_norm"))
    return sigma.crossJoin(F.broadcast(total)).join(norm, "mode").select("mode", F.col("sigma").alias("singular_value"), (F.col("sigma") ** 2 / F.greatest("total_", F.lit(1e-30))).alias("energy_fraction"), "spatial_norm")


def save_modes(phi: DataFrame, sigma: DataFrame, path: str) -> None:
    """Writes modes (mode, point, phi), a folder a mode, and (mode, sigma) as Parquet; a model that is there is replaced."""
    phi.write.mode("overwrite").partitionBy("mode").parquet(f"{path}/phi")
    sigma.write.mode("overwrite").parquet(f"{path}/sigma")


def load_modes(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """What save_modes wrote; reading some modes prunes the others."""
    return spark.read.parquet(f"{path}/phi"), spark.read.parquet(f"{path}/sigma")
