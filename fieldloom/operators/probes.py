"""Sampling of fields: lines, probes, walls, phases, gaps, particles and coarser grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import keys, running
from .joins import interpolate, knn, radius_pairs


def line_samples(spark, start: Sequence[float], end: Sequence[float], coordinates: Sequence[str], n: int) -> DataFrame:
    """(sample, coordinates): n points evenly from start to end, both included."""
    s = F.col("id") / max(n - 1, 1)
    return spark.range(n).select(F.col("id").alias("sample"), *((a + s * (b - a)).alias(c) for c, a, b in zip(coordinates, start, end)))


def sample_at(points: DataFrame, targets: DataFrame, pid: str, tid: str, coordinates: Sequence[str], value: str, cell: float, k: int = 1) -> DataFrame:
    """(tid, value): the nearest point's value (k = 1), or the inverse-square-distance mean of the k nearest; an exact hit wins."""
    near = knn(points, targets, pid, tid, coordinates, k, cell, value)
    w = 1 / F.greatest(F.col("distance") ** 2, F.lit(1e-30))
    mean = F.sum(w * F.col(value)) / F.sum(w)
    hit = F.max(F.when((F.col("rank") == 1) & (F.col("distance") < 1e-12), F.col(value)))
    return near.groupBy(tid).agg(F.coalesce(hit, mean).alias("value"))


def line_probe(points: DataFrame, pid: str, coordinates: Sequence[str], value: str, start: Sequence[float], end: Sequence[float], n: int, cell: float, method: str = "nearest") -> DataFrame:
    """(sample, coordinates, value): a field along a line, from the nearest point or the 4 nearest (idw)."""
    line = line_samples(points.sparkSession, start, end, coordinates, n)
    return line.join(sample_at(points, line, pid, "sample", coordinates, value, cell, {"nearest": 1, "idw": 4}[method]), "sample")


def probe_series(snapshots: DataFrame, points: DataFrame, probes: DataFrame, pid: str, tid: str, time: str, value: str, coordinates: Sequence[str], cell: float) -> DataFrame:
    """(tid, time, value): each probe's nearest point over all snapshots. The nearest points are few and found once."""
    at = knn(points, probes, pid, tid, coordinates, 1, cell).select(tid, pid)
    return snapshots.join(at, pid).select(tid, time, value)


def wall_distance(points: DataFrame, wall: DataFrame, pid: str, wid: str, coordinates: Sequence[str], cell: float) -> DataFrame:
    """(pid, distance) to the nearest wall point."""
    return knn(wall, points, wid, pid, coordinates, 1, cell).select(pid, "distance")


def gap_fill(patches: DataFrame, by, center: str, value: str, n: int) -> DataFrame:
    """(by, i, value) for i = 0..n-1: the line between patch centres, held beyond the first and the last."""
    k = keys(by)
    grid = patches.select(*k).distinct().select(*k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("at_", F.col("i").cast("double"))
    return interpolate(patches, grid.select(*k, "at_"), by, center, value, "at_").select(*k, F.col("at_").cast("long").alias("i"), "value")


def cycles(samples: DataFrame, by, t: str, value: str, period: float, n_phase: int, n_cycles: int | None = None, offset: float = 0.0) -> DataFrame:
    """(by, cycle, phase, value): every full cycle of a series at n_phase phases, from the nearest sample.

    Cycles begin at the first sample plus offset periods. Equal distances take the later sample.
    """
    k = keys(by)
    ends = samples.groupBy(*k).agg((F.min(F.col(t).cast("double")) + offset * period).alias("a_"), F.max(F.col(t).cast("double")).alias("b_"))
    full = F.floor((F.col("b_") - F.col("a_")) / period).cast("int")
    full = F.least(full, F.lit(n_cycles)) if n_cycles is not None else full
    grid = ends.withColumn("n_", full).filter("n_ > 0").withColumn("cycle", F.explode(F.sequence(F.lit(0), F.col("n_") - 1))).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(n_phase - 1))))
    grid = grid.withColumn("at_", F.col("a_") + F.col("cycle") * period + F.col("phase") / n_phase * period).select(*k, "cycle", "phase", "at_")
    found = interpolate(samples, grid.select(*k, "at_"), by, t, value, "at_", "nearest")
    return grid.join(found, [*k, "at_"]).select(*k, "cycle", "phase", "value")


def spline_kernel(r: Column, h: float) -> Column:
    """The cubic spline of one dimension: support 2 h, integral 1."""
    q = F.abs(r) / h
    return F.when(q < 1, 1 - 1.5 * q**2 + 0.75 * q**3).when(q < 2, 0.25 * (2 - q) ** 3).otherwise(0.0) * (2 / 3 / h)


#: The spline in t, the other particle's place less the own one in units of h, from t = -2 on, an interval of length 1 each: factors of 1, t, t^2, t^3.
SPLINE = ((2.0, 3.0, 1.5, 0.25), (1.0, 0.0, -1.5, -0.75), (1.0, 0.0, -1.5, 0.75), (2.0, -3.0, 1.5, -0.25))


def density_1d(particles: DataFrame, pid: str, x: str, mass: str, h: float = 1.0) -> DataFrame:
    """(pid, density): masses smoothed by the spline kernel over all particles within 2 h, the own one included.

    No particle meets another. The kernel is a cubic between multiples of h, so a particle needs the moments of what lies
    between its own place and those: it looks into its cell of length h and two to each side, where a running sum gives the
    moments to the left of the same offset and the cell's total those to the right. Moments are taken about a cell's middle.
    """
    at = particles.select(F.col(pid).alias("o_"), F.col(x).cast("double").alias("x_"), F.col(mass).cast("double").alias("mass_")).filter("abs(x_) < double('infinity')")
    at = at.withColumn("own_", F.floor(F.col("x_") / h).cast("long")).withColumn("off_", F.col("x_") / h - F.col("own_"))
    cells = at.select("o_", F.col("own_").alias("cell_"), "off_", (F.col("off_") - 0.5).alias("u_"), "mass_", F.lit(None).cast("int").alias("step_"))
    asked = at.select("o_", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("step_"), "own_", "off_")
    asked = asked.select("o_", (F.col("own_") + F.col("step_")).alias("cell_"), "off_", F.lit(0.0).alias("u_"), F.lit(None).cast("double").alias("mass_"), "step_")
    moment = [F.coalesce(F.col("mass_") * F.col("u_") ** k, F.lit(0.0)) for k in range(4)] + [F.when(F.col("mass_").isNotNull(), 1).otherwise(0)]
    r = running(cells.unionByName(asked), "cell_", ["off_", "step_", "o_"], {f"l{k}_": m for k, m in enumerate(moment)}, {f"t{k}_": F.sum(m) for k, m in enumerate(moment)}).filter("step_ IS NOT NULL")
    z = F.col("off_") - F.col("step_") - 0.5  # the own place from the middle of the cell that is looked into

    def part(m: Sequence[Column], factors: Sequence[float]) -> Column:
        about = [m[0], m[1] - z * m[0], m[2] - 2 * z * m[1] + z * z * m[0], m[3] - 3 * z * m[2] + 3 * z * z * m[1] - z * z * z * m[0]]
        total = F.lit(0.0)
        for a, c in zip(about, factors):
            total = total + a * c
        return total

    left = [F.col(f"l{k}_") for k in range(4)]
    right = [F.col(f"t{k}_") - F.col(f"l{k}_") for k in range(4)]
    # Left of the own offset lies what is less than ``step`` cells away, right of it what is more.
    found, met = F.lit(0.0), F.lit(0)
    for i, factors in enumerate(SPLINE):
        found = found + F.when(F.col("step_") == i - 1, part(left, factors)).when(F.col("step_") == i - 2, part(right, factors)).otherwise(0.0)
        met = met + F.when(F.col("step_") == i - 1, F.col("l4_")).when(F.col("step_") == i - 2, F.col("t4_") - F.col("l4_")).otherwise(0)
    out = r.groupBy(F.col("o_").alias(pid)).agg(F.sum(found).alias("d_"), F.sum(met).alias("n_"))
    return out.select(pid, F.when(F.col("n_") > 0, F.col("d_") * (2 / 3 / h)).alias("density"))


def resample_to_grid(cells: DataFrame, coordinates: Sequence[str], value: str, weight: str, origin: Sequence[float], spacing: float, shape: Sequence[int], cid: str) -> DataFrame:
    """(node, value) of every node of a grid: the weighted mean of the cells nearest to it, so that totals are kept.

    Nodes are numbered with the last coordinate fastest; cells beyond the grid go to its border. A node without cells
    takes the nearest cell's value.
    """
    index = [F.greatest(F.least(F.bround((F.col(c) - o) / spacing).cast("long"), F.lit(n - 1)), F.lit(0)) for c, o, n in zip(coordinates, origin, shape)]
    node = F.lit(0).cast("long")
    for i, n in zip(index, shape):
        node = node * n + i
    held = cells.groupBy(node.alias("node")).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("value"))
    total = 1
    for n in shape:
        total *= n
    nodes, left = cells.sparkSession.range(total).withColumnRenamed("id", "node"), F.col("node")
    for c, o, n in reversed(list(zip(coordinates, origin, shape))):
        nodes, left = nodes.withColumn(c, o + spacing * (left % n)), F.floor(left / n)
    empty = nodes.join(held, "node", "left_anti")
    return held.unionByName(sample_at(cells, empty, cid, "node", coordinates, value, spacing))


def nodal_forces(pressure: Column, area: Column, normal: Sequence[Column]) -> list[Column]:
    """Components of -p A n."""
    return [-pressure * area * n for n in normal]
