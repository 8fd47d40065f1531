"""Goodness of fit, convergence, spectra, anisotropy, flow topology and the combination of models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from fieldloom.functions.scalars import normal_cdf

from .frames import cut, keys, ordered, running
from .joins import pareto
from .recursions import grouped


# Goodness of fit.
def kolmogorov_p(d: Column, n: Column) -> Column:
    """Asymptotic p-value of a Kolmogorov-Smirnov gap with Stephens' small-sample correction."""
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when((d <= 0) | (lam < 0.18), 1.0).otherwise(F.greatest(F.least(2 * terms, F.lit(1.0)), F.lit(0.0)))


#: The rational approximation of the normal quantile by P. J. Acklam.
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    low = lambda q: _horner(_QC, q) / _horner((*_QD, 1.0), q)
    q = p - 0.5
    middle = _horner(_QA, q * q) * q / _horner((*_QB, 1.0), q * q)
    return F.when(p < 0.02425, low(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -low(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def normality(df: DataFrame, by, tie, x: str, bins: int = 5, first: int = 50) -> DataFrame:
    """Per group: Kolmogorov-Smirnov gap and p, Anderson-Darling A2, a simplified Shapiro-Wilk W, and chi-square of even bins.

    The normal has the sample's mean and deviation. W takes the first ``first`` rows by tie; chi-square compares ``bins``
    equal bins with even counts, bins - 1 degrees of freedom. Groups of fewer than 8 rows or without spread give none.
    A group is ranked over ranges of its values, so its size is no bound.
    """
    k, x_ = keys(by), F.col("x_")
    d = df.select(*k, *keys(tie), F.col(x).cast("double").alias("x_"))
    least = {"n_": F.count("*"), "m_": F.avg("x_"), "s_": F.stddev_samp("x_"), "a_": F.min("x_"), "b_": F.max("x_")}
    r = running(d, k, ["x_", *keys(tie)], {"i_": F.lit(1)}, least).filter("n_ >= 8 and s_ > 0")
    p = normal_cdf((x_ - F.col("m_")) / F.col("s_"))
    r = r.withColumn("p_", p).withColumn("c_", F.greatest(F.least("p_", F.lit(1 - 1e-12)), F.lit(1e-12)))
    gap = F.greatest(F.col("i_") / F.col("n_") - F.col("p_"), F.col("p_") - (F.col("i_") - 1) / F.col("n_"))
    term = (2 * F.col("i_") - 1) * F.log("c_") + (2 * (F.col("n_") - F.col("i_")) + 1) * F.log(1 - F.col("c_"))
    bin_ = F.least(F.floor((x_ - F.col("a_")) / (F.col("b_") - F.col("a_")) * bins), F.lit(bins - 1))
    counts = [F.count_if(bin_ == i) for i in range(bins)]
    one = r.groupBy(*k).agg(F.count("*").alias("n"), F.max(gap).alias("ks_d"), F.sum(term).alias("t_"), *(c.alias(f"c{i}_") for i, c in enumerate(counts)))
    n = F.col("n")
    a2 = (-n - F.col("t_") / n) * (1 + 0.75 / n + 2.25 / (n * n))
    chi = sum((F.col(f"c{i}_") - n / bins) ** 2 / (n / bins) for i in range(bins))
    one = one.select(*k, "n", "ks_d", kolmogorov_p(F.col("ks_d"), n.cast("double")).alias("ks_p"), a2.alias("anderson_a2"), chi.alias("chi_square"), F.lit(bins - 1).alias("chi_square_dof"))
    # Spark keeps the first rows of each task before they move, so a group is small from here on.
    g = Window.partitionBy(*k)
    few = d.withColumn("f_", F.row_number().over(ordered(by, tie))).filter(F.col("f_") <= first)
    few = few.withColumns({"j_": F.row_number().over(g.orderBy("x_", *keys(tie))), "k_": F.count("*").over(g)})
    score = normal_quantile((F.col("j_") - 0.375) / (F.col("k_") + 0.25))
    few = few.withColumn("q_", score).groupBy(*k).agg(F.sum(F.col("q_") * x_).alias("u_"), F.sum(F.col("q_") ** 2).alias("v_"), (F.var_pop("x_") * F.count("*")).alias("w_"))
    return one.join(few.select(*k, F.try_divide(F.col("u_") ** 2 / F.col("v_"), F.col("w_")).alias("shapiro_w")), k)


def chi_square(df: DataFrame, by, observed: str, expected: str, ddof: int = 0) -> DataFrame:
    """(by, chi_square, dof) of observed and expected counts, a row a class; expected counts must be positive."""
    o, e = F.col(observed), F.col(expected)
    return df.groupBy(*keys(by)).agg(F.sum((o - e) ** 2 / e).alias("chi_square"), F.greatest(F.count("*") - 1 - ddof, F.lit(1)).alias("dof"))


# Convergence.
def effective_samples(df: DataFrame, by, order, x: str, max_lag: int | None = None) -> DataFrame:
    """(by, effective, correlation_time): n / tau and tau = 1 + 2 * the sum of autocorrelations up to the first negative one.

    Lags go to max_lag or a quarter of the series; products of a lag are averaged over the pairs there are.
    """

    def kernel(z: np.ndarray) -> dict:
        v = z[:, 0] - z[:, 0].mean()
        n = len(v)
        lags = n // 4 if max_lag is None else min(max_lag, n - 1)
        size = 1 << (2 * n).bit_length()
        f = np.fft.rfft(v, size)
        rho = np.fft.irfft(f * f.conj(), size)[1 : lags + 1] / (n - np.arange(1, lags + 1)) / (v.var() + 1e-30)
        stop = np.flatnonzero(rho < 0)
        tau = max(1 + 2 * rho[: stop[0] if len(stop) else lags].sum(), 1.0)
        return {"effective": [n / tau], "correlation_time": [tau]}

    return grouped(df, by, order, [x], "effective double, correlation_time double", kernel)


# Spectra.
def energy_spectrum(df: DataFrame, by, order, x: str, dx: float = 1.0) -> DataFrame:
    """(by, k, energy): one-sided energy by wave number of a Hann-windowed series."""

    def kernel(z: np.ndarray) -> dict:
        n = len(z)
        e = np.abs(np.fft.rfft(z[:, 0] * np.hanning(n))) ** 2 / n**2
        e[1:-1] *= 2
        return {"k": np.fft.rfftfreq(n, dx), "energy": e}

    return grouped(df, by, order, [x], "k double, energy double", kernel)


def power_law(spectrum: DataFrame, by, k: str = "k", energy: str = "energy") -> DataFrame:
    """(by, slope, r2) of the line through log energy over log wave number, where both are positive; -5/3 in an inertial range."""
    s = spectrum.filter((F.col(k) > 0) & (F.col(energy) > 0)).withColumns({"lk_": F.log(k), "le_": F.log(energy)})
    return s.groupBy(*keys(by)).agg(F.regr_slope("le_", "lk_").alias("slope"), F.regr_r2("le_", "lk_").alias("r2"))


# Turbulence.
def anisotropy(df: DataFrame, stress: Sequence[str]) -> DataFrame:
    """df with invariants II and III of the anisotropy tensor, eta, xi, its state and whether it is realizable.

    stress names the columns uu, uv, uw, vv, vw, ww. Without energy the tensor is 0.
    """
    uu, uv, uw, vv, vw, ww = (F.col(c) for c in stress)
    q = uu + vv + ww
    flat = F.abs(q) < 2e-30
    b = [F.when(flat, 0.0).otherwise(x / F.when(flat, 1.0).otherwise(q) - d) for x, d in zip((uu, uv, uw, vv, vw, ww), (1 / 3, 0, 0, 1 / 3, 0, 1 / 3))]
    out = df.withColumns({f"b{i}_": x for i, x in enumerate(b)})
    xx, xy, xz, yy, yz, zz = (F.col(f"b{i}_") for i in range(6))
    two = xx * xx + yy * yy + zz * zz + 2 * (xy * xy + xz * xz + yz * yz)
    # The trace of b cubed is three times the determinant, because b has no trace.
    three = 3 * (xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz))
    out = out.withColumns({"II": two, "III": three})
    out = out.withColumns({"eta": F.sqrt(F.greatest(F.col("II") / 6, F.lit(0.0))), "xi": F.signum("III") * F.cbrt(F.abs(F.col("III") / 6))})
    eta, xi = F.col("eta"), F.col("xi")
    state = F.when(eta < 0.05, "isotropic").when(eta > 0.3, "1_component").when(F.abs(xi) > 0.2, "2_component")
    state = state.when(xi > 0.05, "axisymmetric_expansion").when(xi < -0.05, "axisymmetric_contraction").otherwise("intermediate")
    return out.withColumns({"state": state, "realizable": (eta <= 1 / 3 + 1e-6) & (F.abs(xi) <= 1 / 3 + 1e-6)}).drop(*(f"b{i}_" for i in range(6)))


def strouhal(f: Column, length: Column, u: Column) -> Column:
    return f * length / u


def critical_points(grid: DataFrame, by, i: str, j: str, u: str, v: str, dx: float = 1.0, dy: float = 1.0, tol: float = 1e-6, steps: int = 20) -> DataFrame:
    """(by, i, j, x, y, kind): zeros of a bilinear vector field in the cells of a grid, by Newton steps from the cell's middle.

    A cell meets its corners by windows along rows and columns, so the grid is shuffled twice and never gathered. kind
    follows from the eigenvalues of the Jacobian.
    """
    k = keys(by)
    down, right = Window.partitionBy(*k, j).orderBy(i), Window.partitionBy(*k, i).orderBy(j)
    g = grid.select(*k, i, j, F.struct(F.col(u).cast("double").alias("u"), F.col(v).cast("double").alias("v")).alias("a_"))
    g = g.withColumns({"b_": F.lead("a_").over(down), "i1_": F.lead(i).over(down)})
    g = g.withColumns({"d_": F.lead("a_").over(right), "c_": F.lead("b_").over(right), "j1_": F.lead(j).over(right)}).filter(f"i1_ = {i} + 1 and j1_ = {j} + 1 and c_ is not null")
    corner = lambda w: [F.col(f"{c}_.{w}") for c in "abcd"]
    for w in "uv":
        g = g.filter(F.least(*corner(w)) * F.greatest(*corner(w)) <= tol * tol)

    def at(w: str, x: Column, y: Column) -> Column:
        a, b, c, d = corner(w)
        return (1 - x) * (1 - y) * a + x * (1 - y) * b + x * y * c + (1 - x) * y * d

    def slopes(w: str, x: Column, y: Column) -> tuple[Column, Column]:
        a, b, c, d = corner(w)
        return (1 - y) * (b - a) + y * (c - d), (1 - x) * (d - a) + x * (c - b)

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        (ux, uy), (vx, vy) = slopes("u", x, y), slopes("v", x, y)
        # The values at (x, y) are bound once, for they stand at many places below.
        here = F.struct(at("u", x, y).alias("u"), at("v", x, y).alias("v"), ux.alias("ux"), uy.alias("uy"), vx.alias("vx"), vy.alias("vy"))

        def newton(h: Column) -> Column:
            det = h["ux"] * h["vy"] - h["uy"] * h["vx"]
            stop = s["stop"] | ((F.abs(h["u"]) < tol) & (F.abs(h["v"]) < tol)) | (F.abs(det) < 1e-30)
            safe = F.when(F.abs(det) < 1e-30, 1.0).otherwise(det)
            nx, ny = x - (h["vy"] * h["u"] - h["uy"] * h["v"]) / safe, y - (h["ux"] * h["v"] - h["vx"] * h["u"]) / safe
            out = ~(nx.between(0, 1) & ny.between(0, 1))
            return F.struct(F.when(stop, x).otherwise(nx).alias("x"), F.when(stop, y).otherwise(ny).alias("y"), (stop | out).alias("stop"))

        return F.transform(F.array(here), newton)[0]

    start = F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(False).alias("stop"))
    g = g.withColumn("z_", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)).withColumns({"zx_": F.col("z_.x"), "zy_": F.col("z_.y")})
    x, y = F.col("zx_"), F.col("zy_")
    g = g.filter(x.between(0, 1) & y.between(0, 1) & (F.abs(at("u", x, y)) <= 10 * tol) & (F.abs(at("v", x, y)) <= 10 * tol))
    (ux, uy), (vx, vy) = slopes("u", x, y), slopes("v", x, y)
    g = g.withColumns({"tr_": ux / dx + vy / dy, "det_": (ux * vy - uy * vx) / (dx * dy)})
    tr, det = F.col("tr_"), F.col("det_")
    disc = tr * tr / 4 - det
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    least = F.when(disc < 0, F.sqrt(F.abs(det))).otherwise(F.least(F.abs(tr / 2 + root), F.abs(tr / 2 - root)))
    kind = F.when(least < 1e-12, "degenerate").when(F.sqrt(F.greatest(-disc, F.lit(0.0))) > 1e-9, F.when(F.abs(tr / 2) < 1e-9, "center").when(tr > 0, "spiral_source").otherwise("spiral_sink"))
    kind = kind.when(det < 0, "saddle").when(tr > 0, "source").otherwise("sink")
    return g.select(*k, i, j, ((F.col(i) + x) * dx).alias("x"), ((F.col(j) + y) * dy).alias("y"), kind.alias("kind"))


def helmholtz(grid: DataFrame, by, i: str, j: str, u: str, v: str, width: float = 2 * np.pi, height: float = 2 * np.pi) -> DataFrame:
    """(by, i, j, solenoidal_u, solenoidal_v, irrotational_u, irrotational_v) of periodic 2-D fields, rows i, columns j.

    By FFT, one grid a task: the number of grids, not their size, gives parallelism. The mean goes to the irrotational part.
    """
    k = keys(by)
    types = dict(grid.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([i, j], kind="stable")
        ny, nx = pdf[i].nunique(), pdf[j].nunique()
        if ny * nx != len(pdf):
            raise ValueError(f"a grid of {ny} x {nx} needs each cell once, but there are {len(pdf)} rows")
        fu, fv = (np.fft.fft2(pdf[c].to_numpy(float).reshape(ny, nx)) for c in (u, v))
        kx, ky = np.meshgrid(np.fft.fftfreq(nx, width / nx), np.fft.fftfreq(ny, height / ny))
        size = kx**2 + ky**2
        size[0, 0] = 1.0
        along = (kx * fu + ky * fv) / size
        iu, iv = kx * along, ky * along
        iu[0, 0], iv[0, 0] = fu[0, 0], fv[0, 0]
        parts = {"solenoidal_u": fu - iu, "solenoidal_v": fv - iv, "irrotational_u": iu, "irrotational_v": iv}
        return pdf[[*k, i, j]].assign(**{n: np.fft.ifft2(f).real.ravel() for n, f in parts.items()})

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*k, i, j)) + ", solenoidal_u double, solenoidal_v double, irrotational_u double, irrotational_v double"
    return grid.select(*k, i, j, u, v).groupBy(*k).applyInPandas(run, schema)


# Models.
def bic_weights(models: DataFrame, bic: str = "bic") -> DataFrame:
    """models with ``weight``: posterior shares exp(-(BIC - least BIC) / 2), which sum to 1. models is a row a model."""
    least = models.agg(F.min(bic).alias("least_"))
    raw = models.crossJoin(F.broadcast(least)).withColumn("raw_", F.exp(-0.5 * (F.col(bic) - F.col("least_"))))
    total = raw.agg(F.sum("raw_").alias("total_"))
    return raw.crossJoin(F.broadcast(total)).withColumn("weight", F.col("raw_") / F.col("total_")).drop("least_", "raw_", "total_")


def ensemble(predictions: DataFrame, on, prediction: str, weight: str | None = None) -> DataFrame:
    """(on, average, variance) over models: variance is the weighted mean square of the gaps to the average."""
    w = F.col(weight) if weight else F.lit(1.0)
    p = F.col(prediction)
    m = predictions.groupBy(*keys(on)).agg(F.sum(w).alias("w_"), F.sum(w * p).alias("p_"), F.sum(w * p * p).alias("q_"))
    mean = F.col("p_") / F.col("w_")
    return m.select(*keys(on), mean.alias("average"), F.greatest(F.col("q_") / F.col("w_") - mean * mean, F.lit(0.0)).alias("variance"))


def bic_model_average(predictions: DataFrame, models: DataFrame, on, model: str, prediction: str, bic: str = "bic") -> tuple[DataFrame, DataFrame]:
    """The models' weights, and (on, average, variance) of predictions (on, model, prediction) by these weights.

    Models without predictions somewhere leave their weight there to the others.
    """
    weights = bic_weights(models, bic)
    return weights, ensemble(predictions.join(weights.select(model, "weight"), model), on, prediction, "weight")



def stacking(df: DataFrame, predictions: Sequence[str], target: str, nonnegative: bool = True) -> np.ndarray:
    """Least-squares weights of models' predictions, negative ones cut to 0, sum 1; even if they cancel.

    Spark sums the models x models products in one pass; the driver solves that system.
    """
    m = len(predictions)
    cells = [(a, b) for a in range(m) for b in range(a, m)]
    row = df.agg(*(F.sum(F.col(predictions[a]) * F.col(predictions[b])).alias(f"g{a}_{b}") for a, b in cells), *(F.sum(F.col(p) * F.col(target)).alias(f"y{a}") for a, p in enumerate(predictions))).first()
    if row["y0"] is None:
        return np.full(m, 1 / m)
    g = np.array([[row[f"g{min(a, b)}_{max(a, b)}"] for b in range(m)] for a in range(m)], float)
    w = np.linalg.lstsq(g, np.array([row[f"y{a}"] for a in range(m)], float), rcond=None)[0]
    w = np.maximum(w, 0) if nonnegative else w
    return w / w.sum() if abs(w.sum()) >= 1e-30 else np.full(m, 1 / m)


def permutation_importance(df: DataFrame, tie, inputs: Sequence[str], target: str, model: Callable[[dict[str, Column]], Column], repeats: int = 5, buckets: int | None = None) -> DataFrame:
    """(input, importance): mean rise of a model's root mean square error when an input's values change places.

    Rows change places inside buckets that a hash of the id picks, in the order of another hash, so no sort is global; by
    default there is a bucket for 100,000 rows, and 64 at least. model makes a prediction of named columns.
    """
    t = keys(tie)
    buckets = max(64, -(-df.count() // 100_000)) if buckets is None else buckets
    h = lambda *salt: F.md5(F.concat_ws(":", *(F.lit(str(s)) for s in salt), *t))
    bucket = F.conv(F.substring(h("bucket"), 1, 4 if buckets <= 4096 else 8), 16, 10).cast("long") % buckets
    d = df.select(*t, *inputs, F.col(target).alias("y_")).withColumn("bucket_", bucket)
    error = lambda p: F.sqrt(F.avg((F.col("y_") - p) ** 2))
    base = d.agg(error(model({c: F.col(c) for c in inputs})).alias("base_"))
    moved = d.crossJoin(d.sparkSession.range(repeats).select(F.col("id").alias("repeat_")))
    place = Window.partitionBy("repeat_", "bucket_")
    shuffled = F.md5(F.concat_ws(":", F.col("repeat_").cast("string"), *t))
    moved = moved.withColumns({"to_": F.row_number().over(place.orderBy(*t)), "from_": F.row_number().over(place.orderBy(shuffled, *t))})
    source = moved.select("repeat_", "bucket_", F.col("from_").alias("to_"), *(F.col(c).alias(f"{c}_moved") for c in inputs))
    both = moved.join(source, ["repeat_", "bucket_", "to_"])
    errors = both.groupBy("repeat_").agg(*(error(model({o: F.col(f"{o}_moved" if o == c else o) for o in inputs})).alias(c) for c in inputs))
    each = errors.select("repeat_", F.explode(F.array(*(F.struct(F.lit(c).alias("input"), F.col(c).alias("rmse_")) for c in inputs))).alias("e")).select("e.*")
    return each.crossJoin(F.broadcast(base)).groupBy("input").agg(F.avg(F.col("rmse_") - F.col("base_")).alias("importance"))


def batch_predict(df: DataFrame, inputs: Sequence[str], predict: Callable[[np.ndarray], np.ndarray], chunk: int = 1024) -> DataFrame:
    """df with ``prediction`` and ``failed``: a vectorised model gets at most ``chunk`` rows at a time.

    If a chunk fails its rows are tried one by one; rows that fail have a null prediction.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), chunk):
                part = f.iloc[at : at + chunk]
                x = part[list(inputs)].to_numpy(float)
                try:
                    y = np.asarray(predict(x), float).ravel()
                except Exception:  # noqa: BLE001 - a user's model may raise anything
                    y = np.array([_one(predict, r) for r in x])
                bad = np.isnan(y)
                yield part.assign(prediction=pd.Series(y, part.index).where(~bad), failed=bad)

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("prediction", DoubleType()), StructField("failed", BooleanType())]))


def _one(predict: Callable[[np.ndarray], np.ndarray], row: np.ndarray) -> float:
    try:
        return float(np.asarray(predict(row[None, :]), float).ravel()[0])
    except Exception:  # noqa: BLE001
        return float("nan")


def nondominated_fronts(df: DataFrame, objectives: Sequence[str], most: int | None = None) -> DataFrame:
    """df with ``front`` from 0: rows that only rows of earlier fronts dominate. One pass a front; after ``most`` fronts it ends."""
    left, out, front = cut(df), None, 0
    while not left.isEmpty() and (most is None or front < most):
        best = cut(pareto(left, objectives).withColumn("front", F.lit(front).cast("long")))
        out = best if out is None else out.unionByName(best)
        left = cut(left.join(best.select(*objectives).distinct(), list(objectives), "left_anti"))
        front += 1
    return out if out is not None else df.withColumn("front", F.lit(0).cast("long"))


def committee(predictions: DataFrame, point: str, prediction: str, n: int) -> DataFrame:
    """(point, disagreement): the n points whose predictions vary most over a committee of models."""
    return predictions.groupBy(point).agg(F.var_pop(prediction).alias("disagreement")).orderBy(F.desc("disagreement"), point).limit(n)


def propagate(df: DataFrame, by, model: Column, percentiles: Sequence[float] = (5.0, 50.0, 95.0)) -> DataFrame:
    """(by, mean, std, p5, ...) of a model's output over a sample of its inputs; percentiles are exact, by ranks over ranges of a group."""
    k = keys(by)
    y = df.select(*k, model.cast("double").alias("y_")).filter("y_ IS NOT NULL")
    r = running(y, k, "y_", {"i_": F.lit(1)}, {"n_": F.count("*")})
    found, out = [], []
    for j, q in enumerate(percentiles):
        at = q / 100 * (F.col("n_") - 1)
        found += [F.max(F.when(F.col("i_") - 1 == F.floor(at), F.col("y_"))).alias(f"l{j}_"), F.max(F.when(F.col("i_") - 1 == F.ceil(at), F.col("y_"))).alias(f"h{j}_"), F.max(at - F.floor(at)).alias(f"w{j}_")]
        out.append((F.col(f"l{j}_") + (F.col(f"h{j}_") - F.col(f"l{j}_")) * F.col(f"w{j}_")).alias(f"p{q:g}"))
    return r.groupBy(*k).agg(F.avg("y_").alias("mean"), F.stddev_pop("y_").alias("std"), *found).select(*k, "mean", "std", *out)


def channel_rmse(df: DataFrame, channel: str, truth: str, prediction: str) -> DataFrame:
    return df.groupBy(channel).agg(F.sqrt(F.avg((F.col(truth) - F.col(prediction)) ** 2)).alias("rmse"))


# Motifs.
def motifs(df: DataFrame, by, order, x: str, window: int, k: int = 1, exclusion: int | None = None, block: int = 2048) -> DataFrame:
    """(by, a, b, distance): the k closest pairs of stretches of a series by z-normalised distance, a < b.

    Each stretch meets its nearest outside the exclusion zone (half a window). A series is cut into blocks of stretches and
    each pair of blocks is a task's group, so one long series spreads over many tasks and a group holds ``block`` squared
    products; the work is quadratic in a series. order must be total.
    """
    zone, keyed = window // 2 if exclusion is None else exclusion, keys(by)
    at = running(df.select(*keyed, *keys(order), F.col(x).cast("double").alias("x_")), keyed, order, {"i_": F.lit(1)}, {"n_": F.count("*")})
    at = at.select(*keyed, (F.col("i_") - 1).alias("i_"), (F.col("n_") - window + 1).alias("m_"), "x_").filter("m_ > 1")
    # A row is in the blocks of all stretches that it is part of.
    first = F.greatest(F.floor((F.col("i_") - window + 1) / block), F.lit(0))
    last = F.least(F.floor(F.col("i_") / block), F.floor((F.col("m_") - 1) / block))
    at = at.withColumn("b_", F.explode(F.sequence(first, last)))
    held = cut(at.groupBy(*keyed, "b_", "m_").agg(F.array_sort(F.collect_list(F.struct("i_", "x_"))).alias("v_")).withColumn("v_", F.col("v_.x_")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m_") - 1) / block)))
    pair = held.withColumn("o_", other).select(*keyed, F.least("b_", "o_").alias("p_"), F.greatest("b_", "o_").alias("q_"), "b_", "v_")

    def kernel(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        def stretches(b: int) -> np.ndarray:
            s = np.lib.stride_tricks.sliding_window_view(np.asarray(blocks["v_"][blocks["b_"] == b].iloc[0], float), window)
            return (s - s.mean(axis=1, keepdims=True)) / (s.std(axis=1, keepdims=True) + 1e-12)

        p, q = key[-2:]
        s, t = stretches(p), stretches(q)
        i, j = np.arange(len(s)) + p * block, np.arange(len(t)) + q * block
        d = np.maximum(2 * (window - s @ t.T), 0)
        d[np.abs(i[:, None] - j[None, :]) <= zone] = np.inf
        out = [pd.DataFrame({"at": i, "to": j[d.argmin(axis=1)], "d": d.min(axis=1)})]
        if p != q:
            out.append(pd.DataFrame({"at": j, "to": i[d.argmin(axis=0)], "d": d.min(axis=0)}))
        found = pd.concat(out)
        found = found[np.isfinite(found["d"])]
        for n, value in zip(keyed, key):
            found[n] = value
        return found

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{n}` {types[n]}" for n in keyed), "at long", "to long", "d double"])
    near = pair.groupBy(*keyed, "p_", "q_").applyInPandas(kernel, schema)
    near = near.groupBy(*keyed, "at").agg(F.min(F.struct("d", "to")).alias("m_"))
    near = near.groupBy(*keyed, F.least("at", "m_.to").cast("int").alias("a"), F.greatest("at", "m_.to").cast("int").alias("b")).agg(F.sqrt(F.min("m_.d")).alias("distance"))
    best = Window.partitionBy(*keyed).orderBy("distance", "a", "b")
    return near.withColumn("r_", F.row_number().over(best)).filter(F.col("r_") <= k).drop("r_")
