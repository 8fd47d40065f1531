"""Designs of experiments and resampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import keys

PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)
#: Degree, inner coefficients and first odd numbers of the primitive polynomials of Sobol's dimensions 2 to 10 (Joe and Kuo).
SOBOL = ((1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)))
SOBOL_BITS = 32


def radical_inverse(n: Column, base: int, digits: int = 30) -> Column:
    """The digits of n in a base, mirrored behind the point."""
    digits = min(digits, int(62 / (base.bit_length() - 1 or 1)) - 1)
    return sum(((F.floor(n / base**k) % base) / float(base) ** (k + 1) for k in range(digits)), F.lit(0.0))


def halton(spark: SparkSession, n: int, bounds: Sequence[tuple[float, float]]) -> DataFrame:
    """(i, x0, x1, ...): points 1..n of the Halton sequence, scaled to bounds; rows are made by tasks from a range."""
    d = spark.range(1, n + 1).withColumnRenamed("id", "i")
    return d.select("i", *((lo + (hi - lo) * radical_inverse(F.col("i"), PRIMES[k], 20)).alias(f"x{k}") for k, (lo, hi) in enumerate(bounds)))


def latin_hypercube(spark: SparkSession, n: int, bounds: Sequence[tuple[float, float]], seed: int = 0) -> DataFrame:
    """(i, x0, ...): each of n strata of every dimension holds one point; strata are dealt by a seeded hash order.

    n is the size of a design, so the sort of n small rows a dimension is the whole cost.
    """
    out = spark.range(n).withColumnRenamed("id", "i")
    for k, (lo, hi) in enumerate(bounds):
        stratum = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.xxhash64(F.lit(seed), F.lit(k), F.col("i")))) - 1
        jitter = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1 - k), F.col("i")), F.lit(1 << 20)) / (1 << 20)
        out = out.withColumn(f"x{k}", lo + (hi - lo) * (stratum + jitter) / n)
    return out


def bootstrap_mean(df: DataFrame, by, tie, x: str, replicates: int = 200, alpha: float = 0.1, seed: int = 0, part: int = 50_000) -> DataFrame:
    """(by, mean, lower, upper): percentile interval of the mean by the Poisson bootstrap.

    A row's weight in a replicate follows from a hash of its id, so replicates need no sample of their own. Rows are brought
    together by group, large groups in parts of about ``part`` rows, before they are expanded by replicate: shuffled are the
    rows themselves and a row a part and replicate.
    """
    k = keys(by)
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("rep_").cast("string"), *(F.col(c).cast("string") for c in keys(tie)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # Poisson(1) by its distribution function.
    cut, weight, p, total = [], F.lit(0), 0.36787944117144233, 0.0
    for m in range(1, 9):
        total += p
        cut.append(total)
        p /= m
    for c in cut:
        weight = weight + (u >= c).cast("int")
    parts = df.groupBy(*k).agg(F.ceil(F.count("*") / part).alias("parts_"))
    held = df.select(*k, *(c for c in keys(tie) if c not in k), F.col(x).alias("x_")).join(parts, k).withColumn("part_", F.pmod(F.xxhash64(*keys(tie)), F.col("parts_"))).repartition(*k, "part_")
    each = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep_")).withColumn("w_", weight)
    sums = each.groupBy(*k, "part_", "rep_").agg(F.sum(F.col("w_") * F.col("x_")).alias("s_"), F.sum("w_").alias("w_"))
    means = sums.repartition(*k).groupBy(*k, "rep_").agg((F.sum("s_") / F.greatest(F.sum("w_"), F.lit(1))).alias("m_"))
    ends = means.groupBy(*k).agg(F.percentile("m_", alpha / 2).alias("lower"), F.percentile("m_", 1 - alpha / 2).alias("upper"))
    return df.groupBy(*k).agg(F.avg(x).alias("mean")).join(ends, k)


def one_at_a_time(df: DataFrame, columns: Sequence[str], delta: float) -> DataFrame:
    """Each row and, for each column, a copy with it moved by delta: (copy, moved, columns...); for elementary effects."""
    moves = [F.struct(F.lit(None).cast("string").alias("moved"), *(F.col(c).alias(c) for c in columns))]
    moves += [F.struct(F.lit(m).alias("moved"), *((F.col(c) + delta if c == m else F.col(c)).alias(c) for c in columns)) for m in columns]
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(*moves)).alias("m_")).select(*rest, "m_.*")


def direction_numbers(dimension: int) -> list[int]:
    """The numbers whose sum without carry, over the set bits of a point's Gray code, is the point's coordinate times 2**32."""
    if dimension == 0:
        m = [1] * SOBOL_BITS
    else:
        degree, inner, first = SOBOL[dimension - 1]
        m = list(first)
        for k in range(degree, SOBOL_BITS):
            new = m[k - degree] ^ (m[k - degree] << degree)
            for j in range(1, degree):
                if inner >> (degree - 1 - j) & 1:
                    new ^= m[k - j] << j
            m.append(new)
    return [x << (SOBOL_BITS - 1 - k) for k, x in enumerate(m)]


def sobol_point(index: Column, bounds: Sequence[tuple[float, float]], seed: int | None = None) -> list[Column]:
    """The coordinates of the Sobol point of a number from 0 to 2**32 - 1, scaled to bounds, at most ten of them.

    Each point follows from its number alone, so rows of any table can be points and no task waits for another. A seed
    shifts all points of a dimension by the same random bits, which keeps their evenness.
    """
    if len(bounds) > len(SOBOL) + 1:
        raise ValueError(f"at most {len(SOBOL) + 1} dimensions")
    i = index.cast("long")
    gray = i.bitwiseXOR(F.shiftright(i, 1))
    out = []
    for d, (lo, hi) in enumerate(bounds):
        x = F.lit(0 if seed is None else _shift(seed, d)).cast("long")
        for k, v in enumerate(direction_numbers(d)):
            x = x.bitwiseXOR(F.when(F.shiftright(gray, k).bitwiseAND(F.lit(1)) == 1, F.lit(v)).otherwise(0).cast("long"))
        out.append(lo + (hi - lo) * (x / float(1 << SOBOL_BITS)))
    return out


def _shift(seed: int, dimension: int) -> int:
    return int(md5(f"{seed}-{dimension}".encode()).hexdigest()[:8], 16)


def _drawn(seed: int, what: str, *of: Column) -> Column:
    """A number from 0 to 2**32 - 1 by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit(what), *(c.cast("string") for c in of))), 1, 8), 16, 10).cast("long")


def morris_walks(df: DataFrame, by, bounds: dict[str, tuple[float, float]], n_levels: int = 4, seed: int = 0) -> DataFrame:
    """(by, step, moved, sign, inputs): a walk a row of df over a grid of levels, in which each input moves once, by one level.

    Levels and the order of moves come from a hash of seed and ``by``. A move goes up, or down from the top level. Step 0
    is the start, where nothing has moved. With n inputs a walk has n + 1 rows.
    """
    if n_levels < 2:
        raise ValueError("two levels at least")
    k, names = keys(by), list(bounds)
    ids = [F.col(c) for c in k]
    moves = F.array_sort(F.array(*(F.struct(_drawn(seed, f"order-{c}", *ids).alias("o"), F.lit(c).alias("c")) for c in names)))
    levels = [F.pmod(_drawn(seed, f"level-{c}", *ids), F.lit(n_levels)).cast("int").alias(f"{c}_at_") for c in names]
    w = df.select(*k, F.transform(moves, lambda m: m["c"]).alias("order_"), *levels).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    up = {c: F.when(F.col(f"{c}_at_") + 1 < n_levels, 1).otherwise(-1) for c in names}
    moved = F.when(F.col("step") > 0, F.element_at("order_", F.greatest("step", F.lit(1))))
    w = w.withColumn("moved", moved)
    place = lambda c: F.col(f"{c}_at_") + F.when(F.array_position("order_", F.lit(c)) <= F.col("step"), up[c]).otherwise(0)
    sign = F.coalesce(*(F.when(F.col("moved") == c, up[c]) for c in names))
    return w.select(*k, "step", "moved", sign.alias("sign"), *((lo + (hi - lo) * (place(c) / (n_levels - 1))).alias(c) for c, (lo, hi) in bounds.items()))


def elementary_effects(walks: DataFrame, by, f: str, n_levels: int = 4, group: str | Sequence[str] = ()) -> DataFrame:
    """(group, moved, mu_star, sigma, n) of walks with a column f of the model's values: mean size and spread of an input's effects, per unit of its range."""
    g = keys(group)
    before = F.lag(f).over(Window.partitionBy(*g, *keys(by)).orderBy("step"))
    e = walks.withColumn("e_", (F.col(f) - before) / (F.col("sign") / (n_levels - 1))).filter("moved is not null")
    return e.groupBy(*g, "moved").agg(F.avg(F.abs("e_")).alias("mu_star"), F.stddev_pop("e_").alias("sigma"), F.count("*").alias("n"))


def morris_sensitivity(df: DataFrame, by, model: Callable[[dict[str, Column]], Column], bounds: dict[str, tuple[float, float]], n_levels: int = 4, seed: int = 0) -> DataFrame:
    """(moved, mu_star, sigma, n): Morris' elementary effects of a model, an expression of the inputs, with a walk a row of df."""
    walks = morris_walks(df, by, bounds, n_levels, seed)
    return elementary_effects(walks.withColumn("f_", model({c: F.col(c) for c in bounds})), by, "f_", n_levels)
