"""Ordered-series operators: features, rolling filters, crossings, derivatives, embeddings.

A series is the rows of one key (``by``), ordered by a total order (``order``); windows are per series, so a plan's
parallelism is the number of series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import TINY, guarded, indexed, keys, mirrored, ordered, running, with_totals


def _parts(df: DataFrame, k: Sequence[str], x: str) -> DataFrame:
    """df with x = s1_ + s2_ + s3_, the number m_ of the series' values and their plain average rough_.

    s1_ and s2_ are multiples of a step so wide that doubles hold their sums over the series exactly, in any order; s3_ is
    what is left, under 2**-70 of the largest value for 4,096 rows.
    """
    sized = df.groupBy(*k).agg(F.avg(x).alias("rough_"), F.count(x).cast("double").alias("m_"), F.max(F.abs(x)).alias("top_"))
    room = F.rint(F.log2("m_")) + 4  # bits for the sum of m_ values, and spare ones
    step = F.pow(F.lit(2.0), F.rint(F.log2("top_")) + room)
    out = df.join(sized.select(*k, "rough_", "m_", step.alias("g1_"), (step * F.pow(F.lit(2.0), room - 53)).alias("g2_")), k)
    out = out.withColumn("s1_", F.col(x) + F.col("g1_") - F.col("g1_")).withColumn("s3_", F.col(x) - F.col("s1_"))
    out = out.withColumn("s2_", F.col("s3_") + F.col("g2_") - F.col("g2_")).withColumn("s3_", F.col("s3_") - F.col("s2_"))
    return out.drop("g1_", "g2_")


def _mean_of_parts() -> Column:
    """The mean from the sums of the parts: their quotient, and the quotient of what it leaves of them; rough_ where that isn't finite."""
    s1, s2, s3, m = (F.col(f) for f in ("s1_", "s2_", "s3_", "m_"))
    mean = (s1 + s2 + s3) / m
    upper = mean * 134217729 - (mean * 134217729 - mean)  # 26 bits, whose product with m is exact
    mean = mean + (s1 - m * upper - m * (mean - upper) + s2 + s3) / m
    return F.when(F.abs(mean) < float("inf"), mean).otherwise(F.col("rough_"))


def features(df: DataFrame, by: str, order, x: str, bins: int = 10, support: int = 3) -> DataFrame:
    """18 features per series; NaN and infinite results become 0.

    The mean is that of the doubles, rounded once, so it doesn't hang on the order of its sum.
    """
    k = keys(by)
    c, w = F.col(x), ordered(by, order)
    base = _parts(df.select(*k, x), k, x).groupBy(*k).agg(
        F.count("*").alias("n"), *(F.first(f).alias(f) for f in ("rough_", "m_")), *(F.sum(f).alias(f) for f in ("s1_", "s2_", "s3_")), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        *(F.percentile(x, p).alias(n) for n, p in (("q25_", 0.25), ("median", 0.5), ("q75_", 0.75))),
    )
    base = base.withColumn("mean", _mean_of_parts()).drop("rough_", "m_", "s1_", "s2_", "s3_")
    d = indexed(df.select(*k, *keys(order), x), by, order).join(base, k)
    dev = c - F.col("mean")
    peak = F.lit(True)
    for s in range(1, support + 1):
        peak = peak & (c > F.lag(x, s).over(w)) & (c > F.lead(x, s).over(w))
    above = c > F.col("mean")
    d = d.withColumns({
        "prev_": F.lag(x).over(w), "peak_": F.coalesce(peak, F.lit(False)), "above_": above, "dev_": dev,
        "cross_": F.signum(dev) != F.lag(F.signum(dev)).over(w),
        "isle_": F.col("i") - F.row_number().over(Window.partitionBy(*k, above).orderBy(*keys(order))),
        "bin_": F.when(F.col("max") > F.col("min"), F.least(F.floor((c - F.col("min")) / (F.col("max") - F.col("min")) * bins), F.lit(bins - 1))).otherwise(0),
    })
    d = d.withColumn("before_", F.lag("dev_").over(w))
    i, n = F.col("i"), F.col("n")
    rows = d.groupBy(*k).agg(
        *(F.first(f).alias(f) for f in ("n", "mean", "std", "min", "max", "median")),
        F.first(F.col("q75_") - F.col("q25_")).alias("iqr"),
        F.avg(F.when(c >= F.col("q75_"), c)).alias("mean_above_q75"),
        F.count_if("peak_").alias("n_peaks"),
        F.coalesce(F.min(F.when(F.col("above_"), i)), F.lit(-1)).alias("first_above_mean"),
        F.avg((c < 0).cast("double")).alias("pct_below_zero"),
        F.coalesce(F.sum(F.abs(c - F.col("prev_"))), F.lit(0.0)).alias("total_variation"),
        F.coalesce(F.avg(F.abs(c - F.col("prev_"))), F.lit(0.0)).alias("mean_abs_change"),
        F.sum(F.col("dev_") * F.col("before_")).alias("num_"), F.sum(F.col("dev_") ** 2).alias("den_"),
        F.regr_slope(c, i).alias("slope_"), F.max(F.abs(c)).alias("peak_abs_"), F.sqrt(F.avg(c * c)).alias("rms_"),
        F.coalesce(F.count_if("cross_"), F.lit(0)).alias("cross_n_"),
    )
    longest = d.filter("above_").groupBy(*k, "isle_").agg(F.count("*").alias("l_")).groupBy(*k).agg(F.max("l_").alias("long_run_above_mean"))
    shares = d.groupBy(*k, "bin_").agg((F.count("*") / F.first("n")).alias("p_")).groupBy(*k).agg(F.sum(-F.col("p_") * F.ln("p_")).alias("entropy_"))
    out = rows.join(longest, k, "left").join(shares, k)
    zero = lambda cond, e: F.when(cond, 0.0).otherwise(guarded(e))
    return out.select(
        *k, *(guarded(F.col(f)).alias(f) for f in ("mean", "std", "min", "max", "median", "iqr", "mean_above_q75")),
        F.coalesce("long_run_above_mean", F.lit(0)).alias("long_run_above_mean"), "n_peaks", "first_above_mean", "pct_below_zero", "total_variation", "mean_abs_change",
        zero((n < 2) | (F.col("den_") < TINY), F.col("num_") / F.greatest("den_", F.lit(TINY))).alias("acf_lag1"),
        zero(n < 2, F.col("slope_")).alias("trend_slope"),
        zero(F.col("rms_") < TINY, F.col("peak_abs_") / F.greatest("rms_", F.lit(TINY))).alias("crest_factor"),
        zero(n < 2, F.col("entropy_")).alias("shannon_entropy"),
        zero(n < 2, F.col("cross_n_") / F.greatest(n - 1, F.lit(1))).alias("zero_crossing_rate"),
    )


def fluctuation(df: DataFrame, by, x: str) -> DataFrame:
    return df.withColumn("fluctuation", F.col(x) - F.avg(x).over(Window.partitionBy(*keys(by))))


def running_statistics(df: DataFrame, by, order, x: str) -> DataFrame:
    """Cumulative mean and rms of fluctuations."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg(x).over(w)
    return df.withColumns({"running_mean": mean, "running_rms": F.sqrt(F.greatest(F.avg(F.col(x) ** 2).over(w) - mean * mean, F.lit(0.0)))})


def rolling(df: DataFrame, by, order, x: str, window: int, how: str = "mean") -> DataFrame:
    """Centred rolling mean or median of an odd window, with mirrored edges, as ``rolled``."""
    if window % 2 == 0 or window < 1:
        raise ValueError("window must be odd")
    half = window // 2
    padded = mirrored(indexed(df, by, order), by, "i", half)
    w = ordered(by, "i").rowsBetween(-half, half)
    value = F.avg(x).over(w) if how == "mean" else F.element_at(F.array_sort(F.collect_list(x).over(w)), half + 1)
    return padded.withColumn("rolled", value).filter("not pad").drop("pad")


def hampel(df: DataFrame, by, order, x: str, window: int = 7, sigmas: float = 3.0) -> DataFrame:
    """Rolling median, rolling median deviation, score |x - med| / mad, and x with outliers replaced by the median."""
    half = window // 2
    padded = mirrored(indexed(df, by, order), by, "i", half)
    frame = F.collect_list(x).over(ordered(by, "i").rowsBetween(-half, half))
    med = padded.withColumn("w_", frame).withColumn("median", F.element_at(F.array_sort("w_"), half + 1))
    mad = F.element_at(F.array_sort(F.transform("w_", lambda v: F.abs(v - F.col("median")))), half + 1)
    out = med.filter("not pad").withColumn("mad", mad).drop("pad", "w_")
    gap = F.abs(F.col(x) - F.col("median"))
    flat = F.col("mad") < TINY
    outlier = ~flat & (gap > sigmas * 1.4826 * F.col("mad"))
    return out.withColumns({"score": F.when(flat, 0.0).otherwise(gap / F.greatest("mad", F.lit(TINY))), "filtered": F.when(outlier, F.col("median")).otherwise(F.col(x))})


def savgol_weights(window: int, order: int, deriv: int = 0) -> list[float]:
    """Weights of the least-squares polynomial's value (or derivative) at the middle of a window."""
    half = window // 2
    powers = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    return (np.linalg.pinv(powers)[deriv] * math.factorial(deriv)).tolist()


def savgol(df: DataFrame, by, order, x: str, window: int, poly: int = 3, deriv: int = 0) -> DataFrame:
    """Polynomial smoothing with mirrored edges, as ``smoothed``; a weighted sum over a frame."""
    half, weights = window // 2, savgol_weights(window, poly, deriv)
    padded = mirrored(indexed(df, by, order), by, "i", half)
    w = ordered(by, "i")
    total = sum(c * (F.lead(x, k).over(w) if k > 0 else F.lag(x, -k).over(w) if k < 0 else F.col(x)) for c, k in zip(weights, range(-half, half + 1)))
    return padded.withColumn("smoothed", total).filter("not pad").drop("pad")


def empirical_cdf(df: DataFrame, by, x: str, tie) -> DataFrame:
    """Plotting position rank / (n + 1)."""
    return df.withColumn("ecdf", F.row_number().over(ordered(by, [x, *keys(tie)])) / (F.count("*").over(Window.partitionBy(*keys(by))) + 1))


def crossings(df: DataFrame, by, order, x: str, threshold: float, direction: str = "rising") -> DataFrame:
    """Samples at which the state x >= threshold changes."""
    state = (F.col(x) >= threshold).cast("int")
    step = indexed(df, by, order).withColumn("step_", state - F.lag(state).over(ordered(by, order)))
    want = {"rising": F.col("step_") == 1, "falling": F.col("step_") == -1, "both": F.col("step_") != 0}[direction]
    return step.filter(want).withColumn("direction", F.when(F.col("step_") == 1, "rising").otherwise("falling")).drop("step_")


def plateau(df: DataFrame, by, order, x: str, window: int = 100, tolerance: float = 0.01) -> DataFrame:
    """First index at which the cumulative mean changes by less than tolerance over the next window samples; -1 if none."""
    cm = F.avg(x).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, 0))
    d = indexed(df, by, order).withColumn("cm_", cm)
    later = F.lead("cm_", window).over(ordered(by, "i"))
    d = d.withColumn("ok_", F.abs(later - F.col("cm_")) / (F.abs("cm_") + TINY) < tolerance)
    return d.groupBy(*keys(by)).agg(F.coalesce(F.min(F.when(F.col("ok_"), F.col("i"))), F.lit(-1)).alias("plateau_index"))


def autocorrelation(df: DataFrame, by, order, x: str, max_lag: int) -> DataFrame:
    """(by, lag, r): mean product of fluctuations over valid pairs, over their mean square. One lag column a lag, no join."""
    k = keys(by)
    d = df.withColumn("d_", F.col(x) - F.avg(x).over(Window.partitionBy(*k)))
    w = ordered(by, order)
    d = d.withColumns({f"l{lag}": F.col("d_") * F.lead("d_", lag).over(w) for lag in range(max_lag + 1)})
    r = d.groupBy(*k).agg(F.avg(F.col("d_") ** 2).alias("v_"), *(F.avg(f"l{lag}").alias(f"l{lag}") for lag in range(max_lag + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(lag).alias("lag"), F.when(F.col("v_") < TINY, 0.0).otherwise(F.col(f"l{lag}") / F.greatest("v_", F.lit(TINY))).alias("r")) for lag in range(max_lag + 1))))
    return r.select(*k, each.alias("e")).select(*k, "e.*")


def integral_scale(acf: DataFrame, by, dx: float = 1.0) -> DataFrame:
    """Trapezoid of r over the lags before its first negative value."""
    k = keys(by)
    w = ordered(by, "lag")
    d = acf.withColumn("neg_", F.max((F.col("r") < 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("neg_ = 0")
    return d.withColumn("area_", (F.col("r") + F.lag("r").over(w)) / 2 * dx).groupBy(*k).agg(F.coalesce(F.sum("area_"), F.lit(0.0)).alias("length_scale"))


def cross_correlation(df: DataFrame, by, order, a: str, b: str, max_lag: int, block: int = 65536) -> DataFrame:
    """(by, lag, r) of two columns at lags -max_lag..max_lag, over sqrt(sum a'^2 sum b'^2) + tiny.

    A series is numbered by ranges and cut into blocks that overlap by the largest lag, so a long one spreads over many tasks.
    """
    block = max(block, max_lag + 1)
    k = keys(by)
    w = Window.partitionBy(*k, "block_").orderBy("i_")
    d = with_totals(df.select(*k, *(c for c in keys(order) if c not in k), F.col(a).alias("a_"), F.col(b).alias("b_")), k, (F.avg("a_").alias("ma_"), F.avg("b_").alias("mb_")))
    d = d.withColumns({"a_": F.col("a_") - F.col("ma_"), "b_": F.col("b_") - F.col("mb_")}).drop("ma_", "mb_")
    d = running(d, k, order, {"i_": F.lit(1)}).select(*k, "a_", "b_", "i_")
    # A row stands in its block, and within max_lag of an end in the next one too, where only its a counts.
    home = F.floor(F.col("i_") / block)
    d = d.withColumn("block_", F.explode(F.array_distinct(F.array(home, F.floor((F.col("i_") - max_lag) / block), F.floor((F.col("i_") + max_lag) / block)))))
    own = F.col("block_") == home
    lags = list(range(-max_lag, max_lag + 1))
    shift = lambda lag: F.lead("a_", lag).over(w) if lag >= 0 else F.lag("a_", -lag).over(w)
    d = d.withColumns({f"c{i}": F.when(own, shift(lag) * F.col("b_")) for i, lag in enumerate(lags)}).withColumns({"a_": F.when(own, F.col("a_")), "b_": F.when(own, F.col("b_"))})
    s = d.groupBy(*k).agg((F.sqrt(F.sum(F.col("a_") ** 2) * F.sum(F.col("b_") ** 2)) + TINY).alias("n_"), *(F.coalesce(F.sum(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(len(lags))))
    each = F.explode(F.array(*(F.struct(F.lit(lag).alias("lag"), (F.col(f"c{i}") / F.col("n_")).alias("r")) for i, lag in enumerate(lags))))
    return s.select(*k, each.alias("e")).select(*k, "e.*")


def boundary_layer(df: DataFrame, by, y: str, u: str, edge: str) -> DataFrame:
    """Thickness at 99 % of the edge velocity, displacement and momentum thickness of profiles u(y)."""
    k = keys(by)
    w = ordered(by, y)
    ratio = F.col(u) / F.col(edge)
    d = df.withColumns({"r_": ratio, "r0_": F.lag(ratio).over(w), "y0_": F.lag(y).over(w)})
    lo, hi = F.least("r_", "r0_"), F.greatest("r_", "r0_")
    cross = (lo <= 0.99) & (hi >= 0.99) & (F.col("r_") != F.col("r0_"))
    at = F.col("y0_") + (0.99 - F.col("r0_")) * (F.col(y) - F.col("y0_")) / (F.col("r_") - F.col("r0_"))
    dy = F.col(y) - F.col("y0_")
    f = lambda r: 1 - F.col(r)
    g = lambda r: F.col(r) * (1 - F.col(r))
    return d.groupBy(*k).agg(
        F.coalesce(F.min_by(at, F.when(cross, F.col(y))), F.max(y)).alias("delta99"),
        F.sum(dy * (f("r_") + f("r0_")) / 2).alias("displacement"), F.sum(dy * (g("r_") + g("r0_")) / 2).alias("momentum"),
    )


def derivative(df: DataFrame, by, along: str, f: str, h: float, name: str, order: int = 2) -> DataFrame:
    """Central difference of order 2 or 4 along an index column; first-order one-sided at the edges, NULL for one sample."""
    w = ordered(by, along)
    at = lambda k: F.lead(f, k).over(w) if k > 0 else F.lag(f, -k).over(w)
    two = (at(1) - at(-1)) / (2 * h)
    inner = F.coalesce((-at(2) + 8 * at(1) - 8 * at(-1) + at(-2)) / (12 * h), two) if order == 4 else two
    return df.withColumn(name, F.coalesce(inner, (at(1) - F.col(f)) / h, (F.col(f) - at(-1)) / h))


def gradients_2d(df: DataFrame, by, i: str, j: str, f: str, dx: float = 1.0, dy: float = 1.0, order: int = 2) -> DataFrame:
    """d/dx along i and d/dy along j, and the Laplacian as derivatives applied twice."""
    k = keys(by)
    d = derivative(derivative(df, [*k, j], i, f, dx, "gx", order), [*k, i], j, f, dy, "gy", order)
    d = derivative(derivative(d, [*k, j], i, "gx", dx, "gxx", order), [*k, i], j, "gy", dy, "gyy", order)
    return d.withColumn("laplacian", F.col("gxx") + F.col("gyy")).drop("gxx", "gyy")


def rotation_2d(df: DataFrame, by, i: str, j: str, u: str, v: str, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Vorticity dv/dx - du/dy and Q = (rotation^2 - strain^2) / 2."""
    k = keys(by)
    d = df
    for f in (u, v):
        d = derivative(derivative(d, [*k, j], i, f, dx, f"{f}_x"), [*k, i], j, f, dy, f"{f}_y")
    ux, uy, vx, vy = (F.col(f"{f}_{a}") for f in (u, v) for a in "xy")
    spin2, strain2 = 0.5 * (vx - uy) ** 2, ux**2 + vy**2 + 0.5 * (uy + vx) ** 2
    return d.withColumns({"vorticity": vx - uy, "q": 0.5 * (spin2 - strain2), "divergence": ux + vy}).drop(*(f"{f}_{a}" for f in (u, v) for a in "xy"))


def arc_length(df: DataFrame, by, order, coordinates: Sequence[str]) -> DataFrame:
    w = ordered(by, order)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in coordinates))
    return df.withColumn("d_", F.coalesce(step, F.lit(0.0))).withColumn("arc_length", F.sum("d_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("d_")


def label_runs(df: DataFrame, by, order, label: str) -> DataFrame:
    """(by, run, label, start, end, length) of equal neighbouring labels."""
    k = keys(by)
    w = ordered(by, order)
    d = indexed(df, by, order).withColumn("new_", F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1)))
    d = d.withColumn("run", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.groupBy(*k, "run").agg(F.first(label).alias("label"), F.min("i").alias("start"), F.max("i").alias("end"), F.count("*").alias("length"))


def cumulative_energy(df: DataFrame, by, mode: str, sigma: str) -> DataFrame:
    """Cumulative share of squared singular values by mode."""
    e = F.col(sigma) ** 2
    w = ordered(by, mode).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("energy", F.sum(e).over(w) / F.greatest(F.sum(e).over(Window.partitionBy(*keys(by))), F.lit(TINY)))


def truncation(df: DataFrame, by, mode: str, sigma: str, fraction: float = 0.99) -> DataFrame:
    """Number of modes up to which the cumulative energy reaches the fraction; modes count from 0."""
    return cumulative_energy(df, by, mode, sigma).filter(F.col("energy") >= fraction).groupBy(*keys(by)).agg((F.min(mode) + 1).alias("n_modes"))


def durbin_watson(df: DataFrame, by, order, e: str) -> DataFrame:
    step = F.col(e) - F.lag(e).over(ordered(by, order))
    return df.withColumn("s_", step).groupBy(*keys(by)).agg((F.coalesce(F.sum(F.col("s_") ** 2), F.lit(0.0)) / (F.sum(F.col(e) ** 2) + TINY)).alias("durbin_watson"))


def delay_embed(df: DataFrame, by, order, x: str, dim: int = 3, delay: int = 1) -> DataFrame:
    """Rows (x_i, x_{i+delay}, ...) as columns d0, d1, ...; incomplete ones are left out."""
    w = ordered(by, order)
    return indexed(df, by, order).withColumns({f"d{m}": F.lead(x, m * delay).over(w) for m in range(dim)}).filter(F.col(f"d{dim - 1}").isNotNull())


def sliding_windows(df: DataFrame, by, order, x: str, length: int, stride: int = 1) -> DataFrame:
    """(by, start, values) of count-based windows."""
    w = ordered(by, "i").rowsBetween(0, length - 1)
    d = indexed(df, by, order).withColumn("values", F.collect_list(x).over(w))
    return d.filter((F.col("i") % stride == 0) & (F.size("values") == length)).select(*keys(by), F.col("i").alias("start"), "values")


def haar(df: DataFrame, by, order, x: str) -> DataFrame:
    """One Haar level: (by, k, approx, detail) of pairs of samples; an odd last sample is left out."""
    d = indexed(df, by, order).withColumn("k", F.floor(F.col("i") / 2))
    a, b = (F.max(F.when(F.col("i") % 2 == p, F.col(x))) for p in (0, 1))
    return d.groupBy(*keys(by), "k").agg(((a + b) / F.sqrt(F.lit(2.0))).alias("approx"), ((a - b) / F.sqrt(F.lit(2.0))).alias("detail")).filter(F.col("detail").isNotNull())


def window_jumps(df: DataFrame, by, order, x: str, width: int = 20, threshold: float = 3.0) -> DataFrame:
    """Candidate change points: |mean of the next width - mean of the last width| over threshold standard deviations."""
    w = ordered(by, order)
    left, right = F.avg(x).over(w.rowsBetween(-width, -1)), F.avg(x).over(w.rowsBetween(0, width - 1))
    k = keys(by)
    d = indexed(df, by, order).withColumns({"jump": F.abs(right - left), "s_": F.stddev_pop(x).over(Window.partitionBy(*k)), "n_": F.count("*").over(Window.partitionBy(*k))})
    return d.filter((F.col("i") >= width) & (F.col("i") <= F.col("n_") - width) & (F.col("jump") > threshold * F.col("s_"))).select(*k, "i", "jump")


def convergence_orders(df: DataFrame, by, h: str, err: str) -> DataFrame:
    """Observed order between consecutive grids, coarse to fine."""
    w = Window.partitionBy(*keys(by)).orderBy(F.desc(h))
    return df.withColumn("order", F.ln(F.lag(err).over(w) / F.col(err)) / F.ln(F.lag(h).over(w) / F.col(h)))


def trapezoid(df: DataFrame, by, order: str, y: str) -> DataFrame:
    """Trapezoid integral of y over its order column."""
    w = ordered(by, order)
    return df.withColumn("a_", (F.col(order) - F.lag(order).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2).groupBy(*keys(by)).agg(F.coalesce(F.sum("a_"), F.lit(0.0)).alias("integral"))
