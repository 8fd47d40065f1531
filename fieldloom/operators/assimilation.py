"""Ensemble and particle filters over long tables of members, and gates on drift: a group is a model or a sensor."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import keys, ordered
from .recursions import grouped


def _normal(seed: int, columns: Sequence[str]) -> Column:
    """A standard normal number by hash of the columns."""
    u = [(F.pmod(F.xxhash64(F.lit(f"{seed}:{i}"), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in range(2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def enkf_update(ensemble: DataFrame, by, states: Sequence[str], predicted: Column, observed: Column, r: float, noise: Column | None = None, inflation: float = 1.0, seed: int = 0) -> DataFrame:
    """The ensemble after one observation of variance r: each member moves by gain * (observed + noise - predicted).

    predicted is a linear expression of the states; its covariances with them are one aggregate a group, which is joined back.
    noise perturbs the observation per member, by default normal with variance r and drawn by a hash of seed and the
    member's columns, so that a repeated run gives the same. Several independent observations are taken one after another,
    each with a seed of its own. Inflation widens the ensemble about its mean first.
    """
    k = keys(by)
    if inflation != 1.0:
        mean = Window.partitionBy(*k)
        ensemble = ensemble.withColumns({c: F.avg(c).over(mean) + inflation * (F.col(c) - F.avg(c).over(mean)) for c in states})
    noise = _normal(seed, ensemble.columns) * float(np.sqrt(r)) if noise is None else noise
    e = ensemble.withColumn("hx_", predicted).withColumn("gap_", observed + noise - F.col("hx_"))
    gain = e.groupBy(*k).agg(*((F.covar_samp(c, "hx_") / (F.var_samp("hx_") + r)).alias(f"{c}_gain_") for c in states))
    return e.join(gain, k).withColumns({c: F.col(c) + F.col(f"{c}_gain_") * F.col("gap_") for c in states}).select(*ensemble.columns)


def particle_update(particles: DataFrame, by, order, predicted: Column, observed: Column, r: float, weight: str = "weight", u: float = 0.5, least: float = 0.5) -> DataFrame:
    """Particles after one observation of variance r: weights by likelihood, and a systematic resampling where it is due.

    A group is resampled, to equal weights, if its effective number of particles is under ``least`` of all; a particle
    then stays as often as the points (i + u) / n fall into its share. Weights that vanish become even.
    """
    k = keys(by)
    g = Window.partitionBy(*k)
    log = -0.5 * (observed - predicted) ** 2 / r
    p = particles.withColumn("log_", log).withColumn("raw_", F.exp(F.col("log_") - F.max("log_").over(g)) * F.col(weight))
    n, total = F.count("*").over(g), F.sum("raw_").over(g)
    p = p.withColumns({"n_": n, weight: F.when(total > 0, F.col("raw_") / total).otherwise(1 / n)})
    p = p.withColumn("sum_", F.sum(weight).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("few_", 1 / F.sum(F.col(weight) ** 2).over(g) < least * F.col("n_"))
    last = F.row_number().over(ordered(by, order)) == F.col("n_")
    upto = lambda share: F.ceil(share * F.col("n_") - u)
    copies = F.when(last, F.col("n_")).otherwise(upto(F.col("sum_"))) - upto(F.col("sum_") - F.col(weight))
    p = p.withColumn("copies_", F.when(F.col("few_"), F.greatest(copies, F.lit(0))).otherwise(1).cast("int")).withColumn(weight, F.when(F.col("few_"), 1 / F.col("n_")).otherwise(F.col(weight)))
    return p.filter("copies_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*particles.columns)


def retrain_steps(df: DataFrame, by, step: str, drift: str, threshold: float = 0.2, cooldown: int = 100) -> DataFrame:
    """(by, step) at which a model is retrained: drift over the threshold, at least ``cooldown`` steps after the last time."""

    def kernel(z: np.ndarray) -> dict:
        out, at = [], -np.inf
        for s in z[z[:, 1] > threshold, 0]:
            if s - at >= cooldown:
                out.append(int(s))
                at = s
        return {step: out}

    return grouped(df, by, step, [step, drift], f"`{step}` long", kernel)
