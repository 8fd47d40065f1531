"""Predicates, top-k, set-like operators and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import TINY, cut, keys, ordered, ranked


EXISTING = 10_000  # bound of the design points that greedy_maxmin broadcasts


# Predicates on coordinates.
def box(x: str, y: str, z: str, bounds: Sequence[float]) -> Column:
    x0, x1, y0, y1, z0, z1 = bounds
    return F.col(x).between(x0, x1) & F.col(y).between(y0, y1) & F.col(z).between(z0, z1)


def sphere(coordinates: Sequence[str], center: Sequence[float], radius: float) -> Column:
    return F.sqrt(sum((F.col(c) - m) ** 2 for c, m in zip(coordinates, center))) <= radius


def cylinder(coordinates: Sequence[str], start: Sequence[float], end: Sequence[float], radius: float) -> Column:
    axis = [b - a for a, b in zip(start, end)]
    length = sum(a * a for a in axis) ** 0.5
    rel = [F.col(c) - a for c, a in zip(coordinates, start)]
    t = sum(r * (a / length) for r, a in zip(rel, axis))
    radial = sum((r - t * (a / length)) ** 2 for r, a in zip(rel, axis))
    return (t >= 0) & (t <= length) & (F.sqrt(radial) <= radius)


def _level(origin: Sequence[float], normal: Sequence[float]) -> float:
    """origin . normal, exact but for one rounding: components are taken as the decimals that they are written as."""
    return float(sum(Fraction(str(o)) * Fraction(str(n)) for o, n in zip(origin, normal)))


def half_space(coordinates: Sequence[str], origin: Sequence[float], normal: Sequence[float], strict: bool = False) -> Column:
    """The side of a plane to which the normal points: x . n against origin . n, so that a point on the plane isn't lost in x - origin."""
    s, level = sum(F.col(c) * n for c, n in zip(coordinates, normal)), _level(origin, normal)
    return s > level if strict else s >= level


def near_plane(coordinates: Sequence[str], origin: Sequence[float], normal: Sequence[float], tolerance: float = 1e-3) -> Column:
    size = sum(n * n for n in normal) ** 0.5
    return F.abs(sum((F.col(c) - o) * (n / size) for c, o, n in zip(coordinates, origin, normal))) < tolerance


def threshold(x: str, level: float, mode: str = "above") -> Column:
    c = F.col(x)
    return {"above": c > level, "below": c < level, "equal": c == level, "abs_above": F.abs(c) > level}[mode]


def outliers_iqr(df: DataFrame, by, x: str, whisker: float = 1.5) -> DataFrame:
    """Rows with ``outlier``: strictly outside the quartiles by whisker * IQR."""
    k = keys(by)
    q = df.groupBy(*k).agg(F.percentile(x, 0.25).alias("a_"), F.percentile(x, 0.75).alias("b_"))
    r = F.col("b_") - F.col("a_")
    return df.join(q, k).withColumn("outlier", (F.col(x) < F.col("a_") - whisker * r) | (F.col(x) > F.col("b_") + whisker * r)).drop("a_", "b_")


def outliers_z(df: DataFrame, by, x: str, level: float = 3.0) -> DataFrame:
    w = Window.partitionBy(*keys(by))
    return df.withColumn("outlier", F.abs(F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + TINY) > level)


def differs(a: str, b: str, tolerance: float = 1e-3) -> Column:
    return F.abs(F.col(a) - F.col(b)) > tolerance


def beyond(x: str, level: float) -> Column:
    return F.abs(F.col(x)) > level


def refine(df: DataFrame, by, order, x: str, level: float = 0.1) -> DataFrame:
    """df with ``indicator``, half the gap of a cell's neighbours and 0 at both ends of a series, and ``refine``."""
    w = ordered(by, order)
    gap = F.abs(F.lead(x).over(w) - F.lag(x).over(w)) / 2
    return df.withColumn("indicator", F.coalesce(gap, F.lit(0.0))).withColumn("refine", F.col("indicator") > level)


def confident(df: DataFrame, probs: str, level: float = 0.9) -> DataFrame:
    """Rows whose largest probability reaches level, with its class, the first of equals, as ``label`` from 0."""
    top = F.array_max(probs)
    return df.filter(top >= level).withColumn("label", (F.array_position(F.col(probs), top) - 1).cast("long"))


def every_nth(df: DataFrame, by, order, stride: int) -> DataFrame:
    """Rows 0, stride, 2 * stride, ... of each series."""
    return df.withColumn("n_", F.row_number().over(ordered(by, order)) - 1).filter(F.col("n_") % stride == 0).drop("n_")


def masked(x: str, valid: Column, fill: float = 0.0) -> Column:
    return F.when(valid, F.col(x)).otherwise(fill)


#: Parts of a field's name that mark it as a conserved quantity.
CONSERVED = ("rho", "density", "mass", "flux", "flow_rate", "flowrate", "momentum", "total_energy", "totalenergy", "enthalpy_flow")


def is_conserved(name: str) -> Column:
    return F.lower(F.col(name)).rlike("|".join(CONSERVED))


def kept_triangles(triangles: DataFrame, tri: str, vertices: str, kept: DataFrame, vertex: str) -> DataFrame:
    """Triangles whose corners are all among the kept points."""
    corners = triangles.select(tri, F.explode(F.array_distinct(vertices)).alias(vertex))
    lost = corners.join(kept.select(vertex), vertex, "left_anti").select(tri).distinct()
    return triangles.join(lost, tri, "left_anti")


def same_mesh(meshes: DataFrame, mesh: str, topology: str, coordinates: str, block: int = 256, pairs_of_task: int = 5_000_000) -> DataFrame:
    """Pairs (a, b), a < b, of meshes with equal topology and coordinate hashes; nulls equal nothing.

    A class of equal meshes is dealt into blocks; each pair of blocks is one key of the join, so a class spreads over as
    many tasks as its pairs need, and the number of tasks follows the number of pairs.
    """
    on = ["t_", "c_"]
    m = meshes.select(F.col(mesh).alias("m_"), F.col(topology).alias("t_"), F.col(coordinates).alias("c_"))
    classes = cut(m.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("n_")).filter("n_ > 1").withColumn("class_", F.monotonically_increasing_id()))
    pairs = classes.agg(F.sum(F.col("n_").cast("double") * F.col("n_") / 2)).first()[0] or 0
    tasks = max(int(meshes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / pairs_of_task))
    blocks = F.ceil(F.col("n_") / block)
    dealt = m.join(classes, on).select("class_", "m_", (blocks - 1).alias("last_"), F.pmod(F.xxhash64("m_"), blocks).alias("own_"))
    # A pair of blocks is (p, q), p <= q; a mesh is on the one side with its block as p, on the other with it as q.
    one = dealt.select("class_", F.col("own_").alias("p_"), F.explode(F.sequence("own_", "last_")).alias("q_"), F.col("m_").alias("x_"))
    other = dealt.select("class_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own_"))).alias("p_"), F.col("own_").alias("q_"), F.col("m_").alias("y_"))
    key = ["class_", "p_", "q_"]
    met = one.repartition(tasks, *key).join(other.repartition(tasks, *key), key).filter("p_ < q_ AND x_ <> y_ OR x_ < y_")
    return met.select(F.least("x_", "y_").alias("a"), F.greatest("x_", "y_").alias("b"))


def reflected(df: DataFrame, components: Sequence[str]) -> DataFrame:
    """The rows, and a copy for each reflected component: its sign is changed; ``axis`` is null, or names the component."""
    axes = F.array(F.lit(None).cast("string"), *map(F.lit, components))
    each = df.withColumn("axis", F.explode(axes))
    return each.withColumns({c: F.when(F.col("axis") == c, -F.col(c)).otherwise(F.col(c)) for c in components})


def dropped_out(x: str, tie, rate: float, seed: int = 0, fill: float = 0.0) -> Column:
    """x, or fill at a share of rows that a hash of the id and the seed picks: the same at every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys(tie))), 1, 8), 16, 10).cast("double") / 2**32
    return F.when(u < rate, fill).otherwise(F.col(x))


def snapshots_with_parameters(snapshots: DataFrame, parameters: DataFrame, case: str, time: str) -> DataFrame:
    """One row a case and time: the case's parameters and its time as ``t``."""
    return snapshots.select(case, F.col(time).cast("double").alias("t")).distinct().join(parameters, case)


def last_runs(history: DataFrame, order, most: int = 50) -> DataFrame:
    """The most recent entries of a log."""
    return history.orderBy(*(F.desc(c) for c in keys(order))).limit(most)


# Top-k; ties always by id.
def top_k(df: DataFrame, score: Column, tie, k: int, largest: bool = True) -> DataFrame:
    s = df.withColumn("score", score)
    return s.orderBy(F.desc("score") if largest else F.asc("score"), *keys(tie)).limit(k)


def top_k_by(df: DataFrame, by, score: Column, tie, k: int, largest: bool = True) -> DataFrame:
    s = df.withColumn("score", score)
    w = Window.partitionBy(*keys(by)).orderBy(F.desc("score") if largest else F.asc("score"), *keys(tie))
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spectral_peaks(df: DataFrame, by, f: str, amplitude: str, k: int) -> DataFrame:
    """The k largest local maxima of a spectrum at positive frequencies."""
    w = Window.partitionBy(*keys(by)).orderBy(f)
    a = F.col(amplitude)
    peak = (a > F.coalesce(F.lag(amplitude).over(w), F.lit(float("-inf")))) & (a > F.coalesce(F.lead(amplitude).over(w), F.lit(float("-inf"))))
    return top_k_by(df.filter(F.col(f) > 0).withColumn("peak_", peak).filter("peak_").drop("peak_"), by, a, f, k)


def margin(probs: str) -> Column:
    """Gap of the two largest probabilities of an array."""
    s = F.sort_array(probs, asc=False)
    return s[0] - s[1]


def greedy_maxmin(candidates: DataFrame, existing: DataFrame, cid: str, coordinates: Sequence[str], k: int) -> DataFrame:
    """Candidates farthest from their nearest existing point, in one pass. existing is a design of at most EXISTING points."""
    if existing.limit(EXISTING + 1).count() > EXISTING:
        raise ValueError(f"more than {EXISTING} existing points; search their nearest by joins.knn with k = 1")
    e = existing.agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in coordinates))).alias("e_"))
    d = F.array_min(F.transform("e_", lambda p: F.sqrt(sum((F.col(c) - p[i]) ** 2 for i, c in enumerate(coordinates)))))
    return top_k(candidates.crossJoin(F.broadcast(e)).withColumn("d_", d).drop("e_"), F.col("d_"), cid, k).drop("d_")


# Sets.
def first_seen_ids(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys numbered from 0 by first appearance, joined to the rows as group_id."""
    first = ranked(df.groupBy(key).agg(F.min(order).alias("f_")), ["f_", key], "group_id")
    return df.join(first.select(key, (F.col("group_id") - 1).alias("group_id")), key)


def undirected_edges(df: DataFrame, cell: str, vertices: str) -> DataFrame:
    """Distinct edges of cells in both directions; an edge joins neighbours in a cell's vertex list, closed to a ring."""
    v = F.col(vertices)
    ring = F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.struct(v[i].alias("src"), v[((i + 1) % F.size(v)).cast("int")].alias("dst")))
    e = df.select(F.explode(ring).alias("e")).select("e.*").filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def boundary_faces(df: DataFrame, vertices: str) -> DataFrame:
    """Triangular faces of tetrahedra that belong to one cell only, as sorted vertex triples."""
    v = F.col(vertices)
    faces = F.array(*(F.array_sort(F.array(*(v[i] for i in f))) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))))
    return df.select(F.explode(faces).alias("face")).groupBy("face").agg(F.count("*").alias("n")).filter("n = 1").select("face")


def hash_split(df: DataFrame, by, val: float = 0.15, test: float = 0.15, seed: int = 0) -> DataFrame:
    """Rows with ``split`` (train, val, test): a stable hash of the group decides, so groups are never torn.

    Sizes hold in expectation. It needs no sort and no shuffle.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), *keys(by)), F.lit(1 << 20)) / (1 << 20)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "val").otherwise("train"))


def stratified_split(df: DataFrame, label: str, tie, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 0) -> DataFrame:
    """Exact shares per class by position in a seeded hash order."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), *keys(tie)), *keys(tie))
    d = df.withColumns({"r_": F.row_number().over(w) - 1, "n_": F.count("*").over(Window.partitionBy(label))})
    a, b = F.floor(F.col("n_") * ratios[0]), F.floor(F.col("n_") * (ratios[0] + ratios[1]))
    return d.withColumn("split", F.when(F.col("r_") < a, "train").when(F.col("r_") < b, "val").otherwise("test")).drop("r_", "n_")


def k_folds(df: DataFrame, tie, k: int, seed: int = 0) -> DataFrame:
    """Fold numbers by a seeded hash of the id."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), *keys(tie)), F.lit(k)).cast("int"))


def augment(df: DataFrame, x: str, copies: int, sigma: float = 0.01, seed: int = 0) -> DataFrame:
    """The rows, and ``copies`` of each with Gaussian noise added, numbered by copy."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return each.withColumn(x, F.when(F.col("copy") == 0, F.col(x)).otherwise(F.col(x) + sigma * F.randn(seed)))


def sweep(spark, space: dict[str, Sequence]) -> DataFrame:
    """The cartesian product of stated parameter lists."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]) for name, values in space.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def violations(df: DataFrame, key: str, parent: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """(key, problem): blank or repeated ids, and ids without a parent."""
    out = df.filter(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).select(F.col(key).cast("string").alias("key"), F.lit("blank").alias("problem"))
    out = out.unionByName(df.groupBy(key).count().filter("count > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("problem")))
    if parent is not None:
        orphans = df.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit("orphan").alias("problem"))
        out = out.unionByName(orphans)
    return out


def diff_maps(a: DataFrame, b: DataFrame, path: str, value: str) -> DataFrame:
    """(path, change, old, new) of two flattened configurations."""
    j = a.select(path, F.col(value).alias("old")).join(b.select(path, F.col(value).alias("new")), path, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return j.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("change", change)
