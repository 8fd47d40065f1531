"""Exact solutions of laminar flows, and numeric fields against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import error_metrics
from .joins import locate_triangles


def _positive(**sizes: float) -> None:
    for name, v in sizes.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive, not {v}")


def couette(y: Column, u_top: float, h: float) -> Column:
    """Velocity between two plates, the upper one moving."""
    _positive(h=h)
    return u_top * y / h


def plane_poiseuille(y: Column, dpdx: float, mu: float, h: float) -> Column:
    """Velocity between two plates at rest, driven by a pressure gradient."""
    _positive(mu=mu, h=h)
    return -dpdx / (2 * mu) * y * (h - y)


def pipe_poiseuille(r: Column, dpdx: float, mu: float, radius: float) -> Column:
    """Velocity in a round pipe at distance r of its axis, driven by a pressure gradient."""
    _positive(mu=mu, radius=radius)
    return -dpdx / (4 * mu) * (radius**2 - r * r)


def triangle_values(points: DataFrame, triangles: DataFrame, pid: str, tri: str, values: Sequence[str], cell: float) -> DataFrame:
    """(pid, value) at points (x, y) of a field that is linear on triangles; ``values`` are its columns at corners a, b, c.

    Points in no triangle have null. The triangle with the smallest id holds a point on an edge.
    """
    found = locate_triangles(points, triangles, pid, tri, cell)
    t = points.select(pid, "x", "y").join(found.filter(F.col(tri) >= 0), pid).join(triangles, tri)
    area = lambda p, q: (F.col(f"{p}x") - F.col("x")) * (F.col(f"{q}y") - F.col("y")) - (F.col(f"{q}x") - F.col("x")) * (F.col(f"{p}y") - F.col("y"))
    a, b, c = area("b", "c"), area("c", "a"), area("a", "b")
    va, vb, vc = (F.col(v) for v in values)
    value = F.try_divide(a * va + b * vb + c * vc, a + b + c)
    return points.select(pid).join(t.select(pid, value.alias("value")), pid, "left")


def compare_against_analytic(triangles: DataFrame, profile: DataFrame, tri: str, values: Sequence[Sequence[str]], cell: float, sample: str = "sample", at: str = "at", exact: str = "exact", axis: str = "y") -> DataFrame:
    """One row: n, n_outside and the error metrics of a field on triangles against an exact profile across the mesh.

    ``profile`` has a row a sample: its place on ``axis`` and the exact value. The line goes through the middle of the mesh
    in the other direction. A field of several components (one triple of corner columns each) counts by its length. Samples
    outside the mesh are counted, not compared; without any inside, the metrics are null.
    """
    other = {"x": "y", "y": "x"}[axis]
    ends = triangles.agg(F.min(F.least(*(f"{c}{other}" for c in "abc"))).alias("lo_"), F.max(F.greatest(*(f"{c}{other}" for c in "abc"))).alias("hi_"))
    line = profile.select(sample, F.col(at).cast("double").alias(axis), F.col(exact).cast("double").alias("exact_")).crossJoin(F.broadcast(ends))
    line = line.withColumn(other, (F.col("lo_") + F.col("hi_")) / 2)
    got, square = line.select(sample, "exact_"), F.lit(0.0)
    for i, v in enumerate(values):
        got = got.join(triangle_values(line, triangles, sample, tri, v, cell).withColumnRenamed("value", f"v{i}_"), sample)
        square = square + F.col(f"v{i}_") ** 2
    got = got.withColumn("value_", F.sqrt(square) if len(values) > 1 else F.col("v0_"))
    count = got.agg(F.count("*").alias("n"), F.count_if(F.col("value_").isNull()).alias("n_outside")).withColumn("one_", F.lit(1))
    metrics = error_metrics(got.filter("value_ IS NOT NULL").withColumn("one_", F.lit(1)), "one_", "exact_", "value_")
    return count.join(metrics, "one_", "left").drop("one_")
