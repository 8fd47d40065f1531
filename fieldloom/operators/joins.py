"""Join-shaped operators: as-of, interpolating, interval, overlap, nearest-neighbour, radius, dominance."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, keys, ordered


def bracket(samples: DataFrame, queries: DataFrame, by, t: str, value: str, tq: str) -> DataFrame:
    """Each query with the last sample before it (t0, v0) and the first at or after it (t1, v1) in its series.

    Samples and queries are united and scanned once in time order: one shuffle on the key, no range join. Repeated
    sample times of a series give the sample that sorts last by value to the left, first to the right.
    """
    k = keys(by)
    s = samples.select(*k, F.col(t).cast("double").alias("t_"), F.col(value).cast("double").alias("v_"), F.lit(True).alias("is_sample"))
    q = queries.select(*k, F.col(tq).cast("double").alias("t_"), F.lit(None).cast("double").alias("v_"), F.lit(False).alias("is_sample")).distinct()
    # A query sorts before samples of its own time, so those lie to its right.
    order = [F.col("t_"), F.col("is_sample").cast("int"), F.col("v_")]
    back = Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*k).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    point = F.when(F.col("is_sample"), F.struct("t_", "v_"))
    both = s.unionByName(q).withColumns({"p0": F.last(point, ignorenulls=True).over(back), "p1": F.first(point, ignorenulls=True).over(ahead)})
    return both.filter("not is_sample").select(*k, F.col("t_").alias(tq), F.col("p0.t_").alias("t0"), F.col("p0.v_").alias("v0"), F.col("p1.t_").alias("t1"), F.col("p1.v_").alias("v1"))


def align(samples: DataFrame, queries: DataFrame, by, t: str, value: str, tq: str, *, tolerance: float = 0.0, max_gap: float = float("inf"), max_age: float = float("inf"), method: str = "linear") -> DataFrame:
    """As-of alignment of sensors to model times, without extrapolation: (value, age, state).

    In this order: the nearest sample within tolerance (stale if older than max_age); between two samples at most max_gap
    apart and neither older than max_age, the line between them; else stale. Equal distances take the later sample. A
    series without samples is missing.
    """
    b = bracket(samples, queries, by, t, value, tq)
    a0, a1 = F.col(tq) - F.col("t0"), F.col("t1") - F.col(tq)
    later = F.col("t0").isNull() | (a1 <= a0)
    near, near_age = F.when(later, F.col("v1")).otherwise(F.col("v0")), F.least("a0_", "a1_")
    b = b.withColumns({"a0_": a0, "a1_": a1}).withColumns({"near_": near, "near_age_": near_age})
    gap = F.col("t1") - F.col("t0")
    line = F.col("v0") + F.col("a0_") / gap * (F.col("v1") - F.col("v0"))
    exact = F.col("near_age_") <= tolerance
    fresh = F.col("near_age_") <= max_age
    between = F.lit(method == "linear") & F.col("t0").isNotNull() & F.col("t1").isNotNull() & (gap <= max_gap) & (F.greatest("a0_", "a1_") <= max_age)
    missing = F.col("near_age_").isNull()
    value_ = F.when(missing, None).when(exact, F.when(fresh, F.col("near_"))).when(between, line)
    age = F.when(exact, F.col("near_age_")).when(between, F.greatest("a0_", "a1_")).otherwise(F.col("near_age_"))
    out = b.withColumns({"value": value_, "age": age})
    state = F.when(missing, "missing").when(F.col("value").isNull(), "stale").otherwise("ok")
    return out.withColumn("state", state).select(*keys(by), tq, "value", "age", "state")


def interpolate(samples: DataFrame, queries: DataFrame, by, t: str, value: str, tq: str, method: str = "linear") -> DataFrame:
    """Values at query times, linear or nearest (equal distances take the later sample), held at both ends."""
    b = bracket(samples, queries, by, t, value, tq)
    a0, a1 = F.col(tq) - F.col("t0"), F.col("t1") - F.col(tq)
    if method == "nearest":
        inside = F.when(a0 < a1, F.col("v0")).otherwise(F.col("v1"))
    else:
        inside = F.when(a1 == 0, F.col("v1")).otherwise(F.col("v0") + a0 / (F.col("t1") - F.col("t0")) * (F.col("v1") - F.col("v0")))
    return b.withColumn("value", F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull(), F.col("v0")).otherwise(inside)).select(*keys(by), tq, "value")


def resample_uniform(samples: DataFrame, by, t: str, value: str, n: int) -> DataFrame:
    """Each series at n evenly spaced times from its first to its last."""
    k = keys(by)
    ends = samples.groupBy(*k).agg(F.min(F.col(t).cast("double")).alias("a_"), F.max(F.col(t).cast("double")).alias("b_"))
    grid = ends.select(*k, "a_", "b_", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).withColumn("tq", F.col("a_") + F.col("j") * (F.col("b_") - F.col("a_")) / max(n - 1, 1))
    return interpolate(samples, grid, by, t, value, "tq").join(grid.select(*k, "j", "tq"), [*k, "tq"]).select(*k, "j", "tq", "value")


def trigger_average(signal: DataFrame, triggers: DataFrame, by, i: str, x: str, half: int) -> DataFrame:
    """Mean and std of samples by offset from triggers; triggers whose window overruns the series are dropped.

    Each trigger is expanded to its 2 * half + 1 indexes, so the interval join is an equi-join.
    """
    k = keys(by)
    n = signal.groupBy(*k).agg(F.max(i).alias("last_"))
    t = triggers.select(*k, F.col(i).alias("at_")).join(n, k).filter((F.col("at_") >= half) & (F.col("at_") + half <= F.col("last_")))
    wide = t.select(*k, F.col("at_"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("offset")).withColumn(i, F.col("at_") + F.col("offset"))
    return wide.join(signal.select(*k, i, x), [*k, i]).groupBy(*k, "offset").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def remap_1d(old: DataFrame, new: DataFrame, lo: str, hi: str, u: str, width: float) -> DataFrame:
    """Conservative remap of cell values onto new cells: sum(overlap * u) / new width, uncovered parts count as 0.

    Both sides are expanded to the buckets of ``width`` that they touch; a pair meets in several buckets but counts in
    the one that holds the start of its overlap.
    """
    def bucketed(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    a = bucketed(old.select(F.col(lo), F.col(hi), F.col(u).alias("u_")))
    b = bucketed(new.select(F.col(lo), F.col(hi))).withColumnsRenamed({lo: "lo_", hi: "hi_"})
    start, end = F.greatest(F.col(lo), F.col("lo_")), F.least(F.col(hi), F.col("hi_"))
    part = a.join(b, "bucket").filter((start < end) & (F.floor(start / width) == F.col("bucket"))).groupBy("lo_", "hi_").agg(F.sum((end - start) * F.col("u_")).alias("s_"))
    full = new.select(F.col(lo), F.col(hi)).join(part.withColumnsRenamed({"lo_": lo, "hi_": hi}), [lo, hi], "left")
    return full.select(lo, hi, (F.coalesce("s_", F.lit(0.0)) / (F.col(hi) - F.col(lo))).alias(u))


def _cells(df: DataFrame, coordinates: Sequence[str], size: float, around: bool) -> DataFrame:
    cell = [F.floor(F.col(c) / size) for c in coordinates]
    if not around:
        return df.withColumn("cell", F.array(*cell))
    near = [F.array(*(x + d for x, d in zip(cell, ds))) for ds in product((-1, 0, 1), repeat=len(coordinates))]
    return df.withColumn("cell", F.explode(F.array(*near)))


def radius_pairs(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], radius: float) -> DataFrame:
    """(tid, pid, distance) of all points within radius of a target, by cells of that size and their neighbours."""
    p = _cells(points.select(pid, *coordinates), coordinates, radius, False)
    t = _cells(targets.select(F.col(tid), *(F.col(c).alias(f"{c}_t") for c in coordinates)), [f"{c}_t" for c in coordinates], radius, True)
    d = F.sqrt(sum((F.col(c) - F.col(f"{c}_t")) ** 2 for c in coordinates))
    return t.join(p, "cell").withColumn("distance", d).filter(F.col("distance") <= radius).select(tid, pid, "distance")


BLOCK = 1024  # ids of a place that go together
FEW = 10_000  # rows of a table that is broadcast


def _blocks(df: DataFrame, id_: str, coordinates: Sequence[str], ids: str) -> DataFrame:
    """(coordinates, deal_, ids): the ids at each place of df, in lists of some BLOCK; deal_ is a number that follows on from list to list of a place."""
    co, rows = list(coordinates), df.select(id_, *coordinates).dropna(subset=list(coordinates))
    crowded = cut(rows.groupBy(*co).agg(F.ceil(F.count("*") / BLOCK).alias("lists_")).filter("lists_ > 1"))
    rows = rows.join(F.broadcast(crowded) if crowded.count() <= FEW else crowded, co, "left")
    rows = rows.withColumn("list_", F.pmod(F.xxhash64(id_), F.coalesce("lists_", F.lit(1))))
    nulls = F.array_repeat(F.lit(None).cast(dict(df.dtypes)[id_]), F.count_if(F.col(id_).isNull()).cast("int"))
    return rows.groupBy(*co, "list_").agg(F.concat(F.collect_list(id_), nulls).alias(ids)).withColumn("deal_", F.shiftright(F.xxhash64(*co), 1) + F.col("list_")).drop("list_")


def radius_search(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], radius: float, digits: int | None = None, pairs_of_key: int = 10_000_000, pairs_of_task: int = 50_000_000) -> DataFrame:
    """The rows of radius_pairs where many rows share their coordinates or a cell, distances rounded to digits if given.

    Distances are taken once a pair of places, whose lists of ids are expanded last. A cell is dealt into parts of either
    side, and each pair of parts is one key of the join, so the tasks follow the number of pairs, not that of cells.
    """
    co, asked = list(coordinates), [f"{c}_t" for c in coordinates]
    p = cut(_cells(_blocks(points, pid, co, "p_"), co, radius, False))
    t = cut(_cells(_blocks(targets, tid, co, "t_").withColumnsRenamed(dict(zip(co, asked))), asked, radius, True))
    size = lambda df, ids, n: df.groupBy("cell").agg(F.sum(F.size(ids)).cast("double").alias(n))
    cells = size(p, "p_", "np_").join(size(t, "t_", "nt_"), "cell").withColumn("pairs_", F.col("np_") * F.col("nt_"))
    cells = cut(cells.select("cell", "pairs_", F.ceil(F.sqrt(F.col("pairs_") / pairs_of_key)).alias("parts_")))
    n_cells, pairs = cells.agg(F.count("*"), F.coalesce(F.sum("pairs_"), F.lit(0.0))).first()
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / pairs_of_task))
    cells = F.broadcast(cells.drop("pairs_")) if n_cells <= FEW else cells.drop("pairs_")
    own = F.pmod("deal_", "parts_")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_") - 1))
    key = ["cell", "i_", "j_"]
    one = t.join(cells, "cell").select("cell", own.alias("i_"), every.alias("j_"), "t_", *asked)
    other = p.join(cells, "cell").select("cell", every.alias("i_"), own.alias("j_"), "p_", *co)
    d = F.sqrt(sum((F.col(c) - F.col(a)) ** 2 for c, a in zip(co, asked)))
    met = one.repartition(tasks, *key).join(other.repartition(tasks, *key), key).filter(d <= radius)
    near = met.select("t_", "p_", (d if digits is None else F.round(d, digits)).alias("distance"))
    return near.select(F.explode("t_").alias(tid), "p_", "distance").select(tid, F.explode("p_").alias(pid), "distance")


DEEPEST = 15  # quarterings of the first cell of knn


def _places(held: DataFrame, asked: DataFrame, coordinates: Sequence[str], k: int, cell: float) -> tuple[DataFrame, list[int]]:
    """(coordinates, level) of the places of asked whose own cell, of size cell / 4**level, holds k places of held or more, and the levels in use.

    The level is the finest such one. Cells are quartered until none holds over 16 k places.
    """
    at = lambda df, level: _cells(df, coordinates, cell / 4**level, False)
    found = None
    for level in range(DEEPEST + 1):
        full = cut(at(held, level).groupBy("cell").agg(F.count("*").alias("n_")).filter(F.col("n_") >= k))
        here = at(asked, level).join(full.select("cell"), "cell", "left_semi").select(*coordinates, F.lit(level).alias("level"))
        found = here if found is None else found.unionByName(here)
        if full.filter(F.col("n_") > 16 * k).isEmpty():
            break
    found = cut(found.groupBy(*coordinates).agg(F.max("level").alias("level")))
    return found, [r[0] for r in found.select("level").distinct().collect()]  # at most DEEPEST + 1


def knn(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], k: int, cell: float, value: str | None = None, most_rings: int = 60) -> DataFrame:
    """(tid, pid, rank, distance[, value]): the k nearest points of each target, all points if they are fewer; ties by id.

    Rows of equal coordinates are one place: it is searched once and answers with its k smallest ids. A target whose own
    cell holds k places finds its k nearest within that cell's diagonal; cells are quartered while they hold many, so a search
    meets a number of points that the density doesn't change. Others search within rings that grow from cell by twice
    the radius, so no target meets all points unless it must.
    """
    k, co = min(k, points.limit(k).count()), list(coordinates)
    held = cut(points.select(pid, *co).withColumn("n_", F.row_number().over(Window.partitionBy(*co).orderBy(pid))).filter(F.col("n_") <= k).drop("n_"))
    left = cut(targets.select(*co).distinct().withColumn("place_", F.monotonically_increasing_id()))
    w = Window.partitionBy("place_")

    def nearest(near: DataFrame) -> DataFrame:
        got = near.withColumn("n_", F.count("*").over(w)).filter(F.col("n_") >= k).withColumn("rank", F.row_number().over(w.orderBy("distance", pid)))
        return cut(got.filter(F.col("rank") <= k).select("place_", pid, "rank", "distance"))

    asked, out, r = left, None, cell
    if k:
        reach = 2 ** math.ceil(math.log2(len(co)) / 2)  # in cells: no diagonal is longer
        level, used = _places(held.select(*co).distinct(), left, co, k, cell)
        for i in used:
            here = left.join(level.filter(F.col("level") == i), co, "left_semi")
            near = radius_pairs(held, here, pid, "place_", co, reach * cell / 4**i)
            out = near if out is None else out.unionByName(near)
    out = nearest(radius_pairs(held, left.limit(0), pid, "place_", co, r) if out is None else out)
    for _ in range(most_rings):
        left = cut(left.join(out.select("place_").distinct(), "place_", "left_anti"))
        if k == 0 or left.isEmpty():
            break
        out = out.unionByName(nearest(radius_pairs(held, left, pid, "place_", co, r)))
        r *= 2
    else:
        raise ValueError(f"cell {cell} is too small for the extent of the points, or a coordinate is not finite")
    out = targets.select(tid, *co).join(asked, co).drop(*co).join(out, "place_").select(tid, pid, "rank", "distance")
    return out.join(points.select(pid, value), pid) if value else out


def knn_mean(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], value: str, k: int, cell: float) -> DataFrame:
    """Mean of the k nearest values."""
    return knn(points, targets, pid, tid, coordinates, k, cell, value).groupBy(tid).agg(F.avg(value).alias("value"))


def idw(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], value: str, k: int, cell: float, power: float = 2.0, eps: float = 1e-12) -> DataFrame:
    """Inverse-distance mean of the k nearest values."""
    w = 1 / (F.pow("distance", F.lit(power)) + eps)
    return knn(points, targets, pid, tid, coordinates, k, cell, value).groupBy(tid).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("value"))


def _dominated(x: np.ndarray, by: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Which rows of x some row of ``by`` dominates."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), chunk):
        c = x[at : at + chunk, None, :]
        out[at : at + chunk] = ((by[None] <= c).all(axis=2) & (by[None] < c).any(axis=2)).any(axis=1)
    return out


def _objectives(rows: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    x = np.column_stack([np.asarray(rows.column(c).to_pylist() if pa.types.is_decimal(rows.column(c).type) else rows.column(c), float) for c in names])
    return np.nan_to_num(x, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def pareto(df: DataFrame, objectives: Sequence[str], block: int = 2048) -> DataFrame:
    """Rows that no row dominates (all objectives at most, one less; minimisation).

    Equal rows collapse. Each partition drops what its own rows dominate, holding ``block`` rows at most, so what is left
    is little more than the local fronts; these meet by pairs of blocks, a pair a group, so a front of any size is met
    without a broadcast. Objectives are compared as doubles, NaN as infinite; rows with a null objective are no members.
    """
    o = list(objectives)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, len(o)))
        for rows in batches:
            for at in range(0, rows.num_rows, block):
                part = rows.slice(at, block)
                x = _objectives(part, o)
                keep = ~(_dominated(x, held) | _dominated(x, x))
                held = np.concatenate([held[~_dominated(held, x[keep])], x[keep]])[:block]
                yield part.filter(pa.array(keep))

    def beaten(rows: pa.Table) -> pa.Table:
        is_mine = rows.column("mine_")
        mine, others = rows.filter(is_mine), rows.filter(pc.invert(is_mine))
        return mine.filter(pa.array(_dominated(_objectives(mine, o), _objectives(others, o)))).select(o)

    distinct = df.select(*o).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in o)).distinct()
    front = cut(distinct.mapInArrow(local, distinct.schema))
    n = -(-front.count() // block)
    if n == 0:
        return df.limit(0)
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    dealt = front.withColumn("block_", F.pmod(F.hash(*o), F.lit(n)))
    mine = dealt.select(*o, F.lit(True).alias("mine_"), F.col("block_").alias("p_"), F.explode(numbers).alias("q_"))
    others = dealt.select(*o, F.lit(False).alias("mine_"), F.explode(numbers).alias("p_"), F.col("block_").alias("q_"))
    lost = mine.unionByName(others).groupBy("p_", "q_").applyInArrow(beaten, distinct.schema).distinct()
    return df.join(front.join(lost, o, "left_anti"), o, "left_semi")


def compare_fields(truth: DataFrame, prediction: DataFrame, on, value: str) -> DataFrame:
    """Truth and prediction by position, finite pairs only, as t and p."""
    t = truth.select(*keys(on), F.col(value).alias("t"))
    p = prediction.select(*keys(on), F.col(value).alias("p"))
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return t.join(p, keys(on)).filter(~bad("t") & ~bad("p"))


def locate_triangles(points: DataFrame, triangles: DataFrame, pid: str, tri: str, cell: float) -> DataFrame:
    """(pid, tri): the first triangle (ax, ay, bx, by, cx, cy) that holds a point (x, y), edges included; -1 if none.

    Triangles are spread over the cells that their boxes touch, points lie in one cell: an equi-join on cells. Points of
    equal coordinates are searched once; of equal triangles only the first is asked.
    """
    corners = [f"{v}{c}" for v in "abc" for c in "xy"]
    lo = lambda c: F.floor(F.least(f"a{c}", f"b{c}", f"c{c}") / cell)
    hi = lambda c: F.floor(F.greatest(f"a{c}", f"b{c}", f"c{c}") / cell)
    t = triangles.groupBy(*corners).agg(F.min(tri).alias(tri)).withColumn("cx_", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("cy_", F.explode(F.sequence(lo("y"), hi("y"))))
    p = points.select("x", "y").distinct().withColumns({"cx_": F.floor(F.col("x") / cell), "cy_": F.floor(F.col("y") / cell)})
    side = lambda u, v: (F.col(f"{v}x") - F.col(f"{u}x")) * (F.col("y") - F.col(f"{u}y")) - (F.col(f"{v}y") - F.col(f"{u}y")) * (F.col("x") - F.col(f"{u}x"))
    s = [side("a", "b"), side("b", "c"), side("c", "a")]
    tol = 1e-12
    inside = ((s[0] >= -tol) & (s[1] >= -tol) & (s[2] >= -tol)) | ((s[0] <= tol) & (s[1] <= tol) & (s[2] <= tol))
    hit = p.join(t, ["cx_", "cy_"]).filter(inside).groupBy("x", "y").agg(F.min(tri).alias(tri))
    return points.select(pid, "x", "y").join(hit, ["x", "y"], "left").select(pid, F.coalesce(tri, F.lit(-1)).alias(tri))
