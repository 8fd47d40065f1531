"""Grouped statistics: moments, quantiles, histograms, integrals, metrics, drift. All population moments (ddof 0)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import TINY, cut, indexed, keys, ordered, ranked, running, safe_div, with_totals


def reynolds(df: DataFrame, by, u: str, v: str, w: str | None = None) -> DataFrame:
    """Means, rms, Reynolds stresses, turbulent kinetic energy and intensity of velocity components per group."""
    parts = [u, v] + ([w] if w else [])
    aggs = [F.avg(c).alias(f"mean_{c}") for c in parts] + [F.stddev_pop(c).alias(f"rms_{c}") for c in parts]
    aggs += [F.covar_pop(a, b).alias(f"cov_{a}_{b}") for i, a in enumerate(parts) for b in parts[i:]]
    out = df.groupBy(*keys(by)).agg(*aggs)
    tke = 0.5 * sum(F.col(f"cov_{c}_{c}") for c in parts)
    speed = F.sqrt(sum(F.col(f"mean_{c}") ** 2 for c in parts))
    return out.withColumn("tke", tke).withColumn("intensity", safe_div(F.sqrt(2 * tke / 3), speed))


def intensity_1d(df: DataFrame, by, u: str) -> DataFrame:
    return df.groupBy(*keys(by)).agg((F.stddev_pop(u) / (F.abs(F.avg(u)) + TINY)).alias("intensity"))


def shape(df: DataFrame, by, x: str) -> DataFrame:
    """skewness m3 / max(var**1.5, tiny) and flatness m4 / max(var**2, tiny), not in excess of 3; central moments merge, so no row is shuffled."""
    var, c = F.var_pop(x), F.col(x)
    m3, m4 = F.skewness(c) * F.pow(var, F.lit(1.5)), (F.kurtosis(c) + 3) * var * var
    moment = lambda m: F.when(var == 0, 0.0).otherwise(m)
    return df.groupBy(*keys(by)).agg(safe_div(moment(m3), F.pow(var, F.lit(1.5))).alias("skewness"), safe_div(moment(m4), var * var).alias("flatness"))


def running_moments(df: DataFrame, by, x: str) -> DataFrame:
    """n, mean, variance with ddof 0 and 1 (0 for one value); Spark's partial aggregates are the mergeable form."""
    return df.groupBy(*keys(by)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var_sample"))


def running_covariance(df: DataFrame, by, x: str, y: str) -> DataFrame:
    return df.groupBy(*keys(by)).agg(F.covar_pop(x, y).alias("cov"), F.corr(x, y).alias("corr"))


def quantiles(df: DataFrame, by, x: str, percents: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation, as columns p<percent>.

    Values are counted before they are ordered, and a group's values are spread over ranges.
    """
    k = keys(by)
    v = df.select(*k, F.col(x).cast("double").alias("x_")).groupBy(*k, "x_").agg(F.count("x_").alias("m_"))
    r = running(v, k, "x_", {"c_": F.col("m_")}, {"n_": F.sum("m_")})
    found, out = [], []
    for j, p in enumerate(percents):
        at = p / 100 * (F.col("n_") - 1)
        first = lambda i: F.min(F.when(F.col("c_") > i, F.col("x_")))
        found += [first(F.floor(at)).alias(f"l{j}_"), first(F.ceil(at)).alias(f"h{j}_"), F.max(at - F.floor(at)).alias(f"w{j}_")]
        out.append(F.when(F.col(f"l{j}_") == F.col(f"h{j}_"), F.col(f"l{j}_")).otherwise(F.col(f"l{j}_") + (F.col(f"h{j}_") - F.col(f"l{j}_")) * F.col(f"w{j}_")).alias(f"p{p:g}"))
    return r.groupBy(*k).agg(*found).select(*k, *out)


def box_stats(df: DataFrame, by, x: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, fences' extreme inner values, outliers strictly outside, minimum and maximum."""
    k = keys(by)
    q = df.groupBy(*k).agg(*(F.percentile(x, p).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo, hi = F.col("q1") - whisker * F.col("iqr"), F.col("q3") + whisker * F.col("iqr")
    inside = (F.col(x) >= lo) & (F.col(x) <= hi)
    fields = ("median", "q1", "q3", "iqr")
    return df.join(q, k).groupBy(*k).agg(*(F.first(c).alias(c) for c in fields), F.min(F.when(inside, F.col(x))).alias("whisker_low"), F.max(F.when(inside, F.col(x))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"), F.min(x).alias("min"), F.max(x).alias("max"))


def _ranked(df: DataFrame, by, x: str, tie) -> DataFrame:
    k = keys(by)
    return df.select(*k, F.col(x), F.row_number().over(ordered(by, [x, *keys(tie)])).alias("rn"), F.count("*").over(Window.partitionBy(*k)).alias("n_"))


def trimmed_mean(df: DataFrame, by, x: str, tie, fraction: float = 0.1) -> DataFrame:
    """Mean without int(n * fraction) values at either end; the median if none would be left."""
    cut = F.floor(F.col("n_") * fraction)
    return _ranked(df, by, x, tie).groupBy(*keys(by)).agg(F.coalesce(F.avg(F.when((F.col("rn") > cut) & (F.col("rn") <= F.col("n_") - cut), F.col(x))), F.percentile(x, 0.5)).alias("trimmed_mean"))


def winsorized_mean(df: DataFrame, by, x: str, tie, low: float = 0.05, high: float = 0.05) -> DataFrame:
    """Mean after the tails are clamped to the nearest value that stays."""
    k = keys(by)
    r = _ranked(df, by, x, tie)
    a, b = F.floor(F.col("n_") * low) + 1, F.col("n_") - F.floor(F.col("n_") * high)
    w = Window.partitionBy(*k)
    clamped = r.withColumn("lo_", F.max(F.when(F.col("rn") == a, F.col(x))).over(w)).withColumn("hi_", F.max(F.when(F.col("rn") == b, F.col(x))).over(w))
    return clamped.groupBy(*k).agg(F.avg(F.least(F.greatest(F.col(x), F.col("lo_")), F.col("hi_"))).alias("winsorized_mean"))


def quadrants(df: DataFrame, by, u: str, v: str, hole: float = 0.0) -> DataFrame:
    """Counts and sums of u'v' by quadrant; below hole * rms_u * rms_v a pair is in the hole, on an axis in none."""
    k = keys(by)
    stats = (F.avg(u).alias("mu_"), F.avg(v).alias("mv_"), F.stddev_pop(u).alias("su_"), F.stddev_pop(v).alias("sv_"))
    f = with_totals(df.select(*k, u, v), k, stats).select(*k, (F.col(u) - F.col("mu_")).alias("a"), (F.col(v) - F.col("mv_")).alias("b"), (hole * F.col("su_") * F.col("sv_")).alias("h"))
    f = f.withColumn("uv", F.col("a") * F.col("b"))
    out = F.abs("uv") < F.col("h")
    a, b = F.col("a"), F.col("b")
    places = {"q1": (a > 0) & (b > 0), "q2": (a < 0) & (b > 0), "q3": (a < 0) & (b < 0), "q4": (a > 0) & (b < 0)}
    aggs = [F.count_if(out).alias("hole_n")]
    for name, cond in places.items():
        aggs += [F.count_if(cond & ~out).alias(f"{name}_n"), F.coalesce(F.sum(F.when(cond & ~out, F.col("uv"))), F.lit(0.0)).alias(f"{name}_uv")]
    return f.groupBy(*k).agg(*aggs)


def _bin(x, lo, hi, bins: int):
    """Equal-width bin from 0; the last one is closed, values outside have none."""
    at = F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int"), F.lit(bins - 1))
    return F.when((x >= lo) & (x <= hi), at)


def histogram_pdf(df: DataFrame, x: str, lo: float, hi: float, bins: int = 50) -> DataFrame:
    """(bin, n, pdf) for all bins, empty ones too."""
    counts = df.select(_bin(F.col(x), F.lit(lo), F.lit(hi), bins).alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = every.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    total = full.agg(F.sum("n").alias("total"))
    return full.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * ((hi - lo) / bins) + TINY)).alias("pdf"))


def joint_pdf(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 50) -> DataFrame:
    """(bx, by, n, density) of the cells that hold samples."""
    b = df.select(_bin(F.col(x), F.lit(x_range[0]), F.lit(x_range[1]), bins).alias("bx"), _bin(F.col(y), F.lit(y_range[0]), F.lit(y_range[1]), bins).alias("by")).dropna()
    counts = b.groupBy("bx", "by").agg(F.count("*").alias("n"))
    area = (x_range[1] - x_range[0]) * (y_range[1] - y_range[0]) / bins**2
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("bx", "by", "n", (F.col("n") / (F.col("total") * area)).alias("density"))


def kde_pdf(df: DataFrame, x: str, points: Sequence[float]) -> DataFrame:
    """Gaussian density at stated points with bandwidth n**-0.2 * std; the points are a literal array, one pass."""
    stats = df.agg((F.pow(F.count(x), F.lit(-0.2)) * F.stddev_pop(x)).alias("h"))
    at = F.explode(F.array(*(F.lit(float(p)) for p in points))).alias("point")
    z = (F.col("point") - F.col(x)) / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return df.select(x).crossJoin(F.broadcast(stats)).select("*", at).groupBy("point").agg(F.avg(kernel).alias("pdf"))


def phase_average(df: DataFrame, t: str, x: str, period: float, bins: int = 36, offset: float = 0.0) -> DataFrame:
    """(phase_bin, n, mean, rms) of every phase bin; 0 where it is empty."""
    phase = F.pmod(F.col(t) / period - offset, F.lit(1.0))
    at = F.least(F.floor(phase * bins).cast("int"), F.lit(bins - 1))
    got = df.select(at.alias("phase_bin"), F.col(x)).groupBy("phase_bin").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("rms"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("phase_bin"))
    return every.join(F.broadcast(got), "phase_bin", "left").fillna(0)


def conditional_average(df: DataFrame, by, x: str, condition) -> DataFrame:
    return df.groupBy(*keys(by)).agg(F.coalesce(F.avg(F.when(condition, F.col(x))), F.lit(0.0)).alias("mean"), F.count_if(condition).alias("n"))


def runs(df: DataFrame, by, order, condition) -> DataFrame:
    """(by, run, length) of the islands on which condition holds."""
    k = keys(by)
    d = df.withColumn("c_", condition).withColumn("i_", F.row_number().over(ordered(by, order)))
    d = d.withColumn("j_", F.row_number().over(Window.partitionBy(*k, "c_").orderBy(*keys(order))))
    return d.filter("c_").groupBy(*k, (F.col("i_") - F.col("j_")).alias("run")).agg(F.count("*").alias("length"))


def event_durations(df: DataFrame, by, order, condition, dt: float = 1.0) -> DataFrame:
    """Runs of a condition: number, mean, longest and total duration, and the fraction of samples in them."""
    k = keys(by)
    total = df.groupBy(*k).agg(F.count("*").alias("n_samples"))
    r = runs(df, by, order, condition).groupBy(*k).agg(F.count("*").alias("n_events"), (F.avg("length") * dt).alias("mean_duration"), (F.max("length") * dt).alias("max_duration"), (F.sum("length") * dt).alias("total_duration"))
    return total.join(r, k, "left").fillna(0).withColumn("active_fraction", F.col("total_duration") / dt / F.col("n_samples")).drop("n_samples")


def batch_means(df: DataFrame, by, order, x: str, batches: int = 20) -> DataFrame:
    """Mean and standard error (ddof 1) of equal batches of a series; the tail that fills no batch is dropped."""
    k = keys(by)
    d = indexed(df, by, order).withColumn("size_", F.floor(F.count("*").over(Window.partitionBy(*k)) / batches))
    d = d.filter("size_ > 0").withColumn("b_", F.floor(F.col("i") / F.col("size_"))).filter(F.col("b_") < batches)
    m = d.groupBy(*k, "b_").agg(F.avg(x).alias("m_"))
    return m.groupBy(*k).agg(F.avg("m_").alias("mean"), (F.stddev_samp("m_") / F.sqrt(F.count("*"))).alias("standard_error"))


def geweke(df: DataFrame, by, order, x: str, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """z of the first against the last part of a series, with sample variances over their lengths."""
    k = keys(by)
    d = indexed(df, by, order).withColumn("n_", F.count("*").over(Window.partitionBy(*k)))
    a, b = F.col("i") < F.floor(F.col("n_") * first), F.col("i") >= F.col("n_") - F.floor(F.col("n_") * last)
    mean = lambda c: F.avg(F.when(c, F.col(x)))
    se = lambda c: F.var_samp(F.when(c, F.col(x))) / F.count(F.when(c, F.col(x)))
    return d.groupBy(*k).agg(((mean(a) - mean(b)) / F.sqrt(se(a) + se(b) + TINY)).alias("z"))


def probe_statistics(df: DataFrame, by, x: str) -> DataFrame:
    return df.groupBy(*keys(by)).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.sqrt(F.avg(F.col(x) ** 2)).alias("rms"))


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def spearman_matrix(df: DataFrame, by, columns: Sequence[str], tie) -> DataFrame:
    """Pearson over ordinal ranks per group (ties by the tie columns, not averaged), as r_<a>_<b>."""
    k = keys(by)
    ranked = df.select(*k, *(F.row_number().over(ordered(by, [c, *keys(tie)])).alias(c) for c in columns))
    return ranked.groupBy(*k).agg(*(F.corr(a, b).alias(f"r_{a}_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]))


def volume_integrals(df: DataFrame, by, volume: str, field: str) -> DataFrame:
    """Integral, weighted mean and weighted variance of a cell field."""
    v, f = F.col(volume), F.col(field)
    out = df.groupBy(*keys(by)).agg(F.sum(v * f).alias("integral"), F.sum(v).alias("volume"), F.sum(v * f * f).alias("square_"))
    mean = F.when(F.col("volume") < TINY, 0.0).otherwise(F.col("integral") / F.greatest("volume", F.lit(TINY)))
    var = F.when(F.col("volume") < TINY, 0.0).otherwise(F.col("square_") / F.greatest("volume", F.lit(TINY)) - mean * mean)
    return out.select(*keys(by), "integral", mean.alias("average"), F.greatest(var, F.lit(0.0)).alias("variance"))


def sauter_mean(df: DataFrame, by, d: str) -> DataFrame:
    return df.groupBy(*keys(by)).agg((F.sum(F.col(d) ** 3) / (F.sum(F.col(d) ** 2) + TINY)).alias("sauter_mean"))


def harmonic_mean(df: DataFrame, by, a: str) -> DataFrame:
    """Effective conductivity of layers in series."""
    return df.groupBy(*keys(by)).agg((1 / F.avg(1 / F.col(a))).alias("effective"))


def block_average(df: DataFrame, by, order, x: str, block: int) -> DataFrame:
    k = keys(by)
    b = indexed(df, by, order).groupBy(*k, F.floor(F.col("i") / block).alias("block")).agg(F.avg(x).alias("mean"), F.count("*").alias("n_"))
    return b.filter(F.col("n_") == block).drop("n_")


def error_metrics(df: DataFrame, by, truth: str, pred: str) -> DataFrame:
    """rmse, r2 (1 or 0 without variance), relative L2, largest error, mae, bias, and rmse over range, |mean| and std."""
    t, p = F.col(truth), F.col(pred)
    e = p - t
    k = keys(by)
    out = df.groupBy(*k).agg(
        F.avg(e * e).alias("mse_"), F.sum(e * e).alias("res_"), (F.var_pop(t) * F.count(t)).alias("tot_"), F.sum(t * t).alias("sq_"),
        F.max(F.abs(e)).alias("max_error"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), (F.max(t) - F.min(t)).alias("range_"), F.abs(F.avg(t)).alias("mean_"), F.stddev_pop(t).alias("std_"),
    )
    rmse = F.sqrt("mse_")
    r2 = F.when(F.col("tot_") == 0, F.when(F.col("res_") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("res_") / F.greatest("tot_", F.lit(TINY)))
    return out.select(*k, rmse.alias("rmse"), r2.alias("r2"), (F.sqrt("res_") / (F.sqrt("sq_") + TINY)).alias("relative_l2"), "max_error", "mae", "bias", *(safe_div(rmse, F.col(f"{n}_")).alias(f"nrmse_{n}") for n in ("range", "mean", "std")))


def field_sanity(df: DataFrame, by, x: str, expected: tuple[float, float] | None = None) -> DataFrame:
    """Counts of NaN, infinite and finite values, statistics of the finite ones, and how many are out of range."""
    c = F.col(x)
    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    aggs = [F.count("*").alias("size"), F.count_if(F.isnan(c)).alias("n_nan"), F.count_if(F.abs(c) == float("inf")).alias("n_inf"), F.count(finite).alias("n_finite"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std")]
    if expected:
        aggs += [F.count_if(finite < expected[0]).alias("n_below"), F.count_if(finite > expected[1]).alias("n_above")]
    return df.groupBy(*keys(by)).agg(*aggs)


def coverage(df: DataFrame, by, y: str, lower: str, upper: str) -> DataFrame:
    """Share of values inside their prediction interval."""
    return df.groupBy(*keys(by)).agg(F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("double")).alias("picp"))


def ece(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over left-open bins; a confidence of 0 is in none."""
    at = F.least(F.ceil(F.col(confidence) * bins).cast("int") - 1, F.lit(bins - 1))
    b = df.filter(F.col(confidence) > 0).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    total = df.agg(F.count("*").alias("total"))
    return b.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("a") - F.col("c"))).alias("ece"))


def ks_statistic(df: DataFrame, by, x: str, is_first) -> DataFrame:
    """Largest gap of the two samples' right-continuous distribution functions per group.

    Values are counted before they are ordered, and a group's values are spread over ranges.
    """
    k = keys(by)
    v = df.groupBy(*k, x).agg(F.count_if(is_first).alias("a_"), F.count_if(~is_first).alias("b_"))
    r = running(v, k, x, {"c_": F.col("a_"), "d_": F.col("b_")}, {"m_": F.sum("a_"), "n_": F.sum("b_")})
    return r.groupBy(*k).agg(F.max(F.abs(F.col("c_") / F.col("m_") - F.col("d_") / F.col("n_"))).alias("ks"))


def exact_quantiles(df: DataFrame, x: str, shares) -> list[float]:
    """Linear quantiles of a column from a range-partitioned ranking: no task and no aggregate holds the whole sample."""
    r = ranked(df.filter(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x_")), "x_", "n_")
    n = r.count()
    if not n:
        return []
    at = [s * (n - 1) for s in shares]
    found = {q["n_"] - 1: q["x_"] for q in r.filter(F.col("n_").isin(sorted({int(a) + d for a in at for d in (1, 2)}))).collect()}  # two rows a quantile
    return [found[int(a)] + (found.get(int(a) + 1, found[int(a)]) - found[int(a)]) * (a - int(a)) for a in at]


def psi(df: DataFrame, x: str, is_expected, bins: int = 10) -> DataFrame:
    """Population stability index over quantile bins of the expected sample, shares floored at 1e-6; null without a sample."""
    e = exact_quantiles(df.filter(is_expected), x, [i / bins for i in range(bins + 1)])
    if not e:
        return df.sparkSession.createDataFrame([(None,)], "psi double")
    c = F.col(x)
    # The outer edges widen by 1e-9, the last bin is closed, values beyond the edges count for no bin.
    inside = (c >= e[0] - 1e-9) & (c <= e[bins] + 1e-9)
    at = sum((c >= v).cast("int") for v in e[1:bins])
    b = df.select(is_expected.alias("x_"), F.when(inside, at).alias("bin"))
    counts = b.groupBy("bin").agg(F.count_if("x_").alias("n_e"), F.count_if(~F.col("x_")).alias("n_a"))
    totals = b.agg(F.count_if("x_").alias("t_e"), F.count_if(~F.col("x_")).alias("t_a"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts.dropna()), "bin", "left").fillna(0).crossJoin(F.broadcast(totals))
    pe, pa = (F.greatest(F.col(f"n_{s}") / F.col(f"t_{s}"), F.lit(1e-6)) for s in "ea")
    return every.agg(F.sum((pa - pe) * F.ln(pa / pe)).alias("psi"))


def wasserstein_equal(df: DataFrame, by, a: str, b: str, tie) -> DataFrame:
    """Mean gap of the sorted values of two equally long samples, which is the area between their distribution functions.

    Values are counted before they are ordered and numbered by ranges of a group; each then meets the next one. Rows that
    lack a value are left out. Equal values count alike, so ``tie`` isn't needed.
    """
    k = keys(by)
    both = df.select(*k, F.explode(F.array(F.struct(F.col(a).cast("double").alias("x_"), F.lit(1).alias("s_")), F.struct(F.col(b).cast("double").alias("x_"), F.lit(-1).alias("s_")))).alias("e_"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok_"))
    v = both.filter("ok_").groupBy(*k, F.col("e_.x_").alias("x_")).agg(F.sum("e_.s_").alias("d_"), F.count("*").alias("m_"))
    r = cut(running(v, k, "x_", {"c_": F.col("d_"), "i_": F.lit(1)}, {"n_": F.sum("m_") / 2}))
    same = F.col("i_") == F.col("j_")
    for j, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"g{j}_"))
    after = r.select((F.col("i_") - 1).alias("j_"), F.col("x_").alias("y_"), *(F.col(c).alias(f"g{j}_") for j, c in enumerate(k)))
    return r.join(after, same, "left").groupBy(*k).agg((F.coalesce(F.sum(F.abs("c_") * (F.col("y_") - F.col("x_"))), F.lit(0.0)) / F.first("n_")).alias("wasserstein"))


def weighted_ensemble(df: DataFrame, by, pred: str, weight: str) -> DataFrame:
    """Weighted mean and population variance of members' predictions per point."""
    p, w = F.col(pred), F.col(weight)
    return df.groupBy(*keys(by)).agg((F.sum(w * p) / F.sum(w)).alias("average"), F.var_pop(p).alias("variance"))


def dashboard(df: DataFrame, by, order, x: str, buffer: int = 1000) -> DataFrame:
    """Count, latest, mean, std, min and max over the newest ``buffer`` samples of each metric."""
    w = Window.partitionBy(*keys(by)).orderBy(*(F.desc(c) for c in keys(order)))
    d = df.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= buffer)
    return d.groupBy(*keys(by)).agg(F.count("*").alias("count"), F.min_by(x, "rn_").alias("latest"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def flip_rate(df: DataFrame, by, order, passed) -> DataFrame:
    """Share of consecutive runs of a test that differ; 0 for one run."""
    d = df.withColumn("p_", passed).withColumn("f_", (F.col("p_") != F.lag("p_").over(ordered(by, order))).cast("double"))
    return d.groupBy(*keys(by)).agg(F.coalesce(F.avg("f_"), F.lit(0.0)).alias("flakiness"))


def two_level_estimate(df: DataFrame, level: str, x: str) -> DataFrame:
    """Multilevel Monte Carlo: sum of level means, and of their variances (ddof 1) over n."""
    m = df.groupBy(level).agg(F.avg(x).alias("m_"), (F.var_samp(x) / F.count(x)).alias("v_"))
    return m.agg(F.sum("m_").alias("estimate"), F.sum("v_").alias("variance"))


def deposit_cic(df: DataFrame, x: str, weight: str, n_grid: int, dx: float = 1.0, x0: float = 0.0) -> DataFrame:
    """(node, mass): each particle's weight is shared by the two nodes around it; partial sums are built before the shuffle."""
    s = (F.col(x) - x0) / dx
    i = F.floor(s)
    f = s - i
    two = F.array(F.struct(i.alias("node"), (F.col(weight) * (1 - f)).alias("m")), F.struct((i + 1).alias("node"), (F.col(weight) * f).alias("m")))
    return df.select(F.explode(two).alias("p")).select("p.*").filter(F.col("node").between(0, n_grid - 1)).groupBy("node").agg(F.sum("m").alias("mass"))
