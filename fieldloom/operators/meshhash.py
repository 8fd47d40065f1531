"""Hashes of meshes that don't depend on the order or the numbers of points and cells.

A point's hash is that of its rounded coordinates, a cell's that of the sum of its points' hashes, a mesh's the sums over
both: sums commute, so partial aggregates serve and no mesh is gathered or sorted. Two lanes of 60 bits each are summed in
wide decimals, so that points that repeat count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lanes(text: Column) -> list[Column]:
    h = F.md5(text)
    return [F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}_") for i, at in enumerate((1, 16))]


def _sums(*more: Column) -> list[Column]:
    return [*(F.sum(f"h{i}_").alias(f"h{i}_") for i in (0, 1)), *more]


def _written() -> Column:
    return F.concat_ws(":", *(F.col(f"h{i}_").cast("string") for i in (0, 1)))


def mesh_hashes(points: DataFrame, cells: DataFrame, mesh: str, pid: str, coordinates: Sequence[str], vertices: str, tolerance: float = 1e-9) -> DataFrame:
    """(mesh, n_points, n_cells, coordinate_hash, topology_hash) of points (mesh, pid, coordinates) and cells (mesh, vertices array of pid).

    Coordinates are rounded to multiples of tolerance; a null one stands for itself. The topology is that of the points'
    places, whatever their numbers, and of cells as sets of corners. A cell whose corner is no point has none there.
    """
    rounded = F.concat_ws(",", *(F.coalesce(F.round(F.col(c).cast("double") / tolerance).cast("long").cast("string"), F.lit("null")) for c in coordinates))
    p = points.select(mesh, pid, *_lanes(rounded))
    of_points = p.groupBy(mesh).agg(*_sums(F.count("*").alias("n_points"))).select(mesh, "n_points", _written().alias("coordinate_hash"))
    named = cells.withColumn("cell_", F.monotonically_increasing_id())
    corner = named.select(mesh, "cell_", F.explode_outer(vertices).alias(pid))
    each = corner.join(p, [mesh, pid], "left").groupBy(mesh, "cell_").agg(*_sums(F.count(pid).alias("k_")))
    hashed = each.select(mesh, *_lanes(F.concat_ws(":", F.col("k_").cast("string"), _written())))
    of_cells = hashed.groupBy(mesh).agg(*_sums(F.count("*").alias("n_cells"))).select(mesh, "n_cells", _written().alias("topology_hash"))
    both = of_points.join(of_cells, mesh, "full")
    return both.select(mesh, F.coalesce("n_points", F.lit(0)).alias("n_points"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"), F.coalesce("coordinate_hash", F.lit("")).alias("coordinate_hash"), F.coalesce("topology_hash", F.lit("")).alias("topology_hash"))


def mesh_classes(hashes: DataFrame, mesh: str, on: Sequence[str] = ("topology_hash", "coordinate_hash")) -> DataFrame:
    """hashes with ``same_as``: the smallest mesh of those whose hashes are equal; one with a null hash equals itself only. A row a mesh, no pairs."""
    first = hashes.dropna(subset=list(on)).groupBy(*on).agg(F.min(mesh).alias("same_as"))
    return hashes.join(first, list(on), "left").withColumn("same_as", F.coalesce("same_as", mesh))
