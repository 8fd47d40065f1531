"""Binary morphology and connected regions of 2-D masks, held as the set of their cells (i, j).

Dilation and erosion are one shuffle of cells and their neighbours a step. Regions are labelled tile by tile; only cells
at the borders of tiles take part in the rounds that join the tiles' regions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .frames import cut, ranked
from .geometry import min_labels

Shape = tuple[int, int]  # rows and columns of the grid


def _neighbourhood(connectivity: int) -> list[tuple[int, int]]:
    """A cell and its 4 neighbours (1) or its 8 (2)."""
    return [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 2 or not (a and b)]


def _votes(cells: DataFrame, i: str, j: str, connectivity: int) -> DataFrame:
    """(i, j, n): how many set cells of the mask have a place in their neighbourhood."""
    around = F.array(*(F.struct((F.col(i) + a).alias(i), (F.col(j) + b).alias(j)) for a, b in _neighbourhood(connectivity)))
    return cells.select(F.explode(around).alias("o_")).select(f"o_.{i}", f"o_.{j}").groupBy(i, j).agg(F.count("*").alias("n"))


def dilate(cells: DataFrame, i: str, j: str, shape: Shape, iterations: int = 1, connectivity: int = 1) -> DataFrame:
    """The cells of the grid with a set cell in their neighbourhood. cells must be distinct."""
    for _ in range(iterations):
        cells = _votes(cells, i, j, connectivity).filter(F.col(i).between(0, shape[0] - 1) & F.col(j).between(0, shape[1] - 1)).select(i, j)
    return cells.select(i, j)


def erode(cells: DataFrame, i: str, j: str, iterations: int = 1, connectivity: int = 1) -> DataFrame:
    """The set cells whose whole neighbourhood is set; beyond the grid nothing is set. cells must be distinct."""
    for _ in range(iterations):
        cells = _votes(cells, i, j, connectivity).filter(F.col("n") == len(_neighbourhood(connectivity))).select(i, j)
    return cells.select(i, j)


def opening(cells: DataFrame, i: str, j: str, shape: Shape, iterations: int = 1, connectivity: int = 1) -> DataFrame:
    """Erosion, then dilation: specks go."""
    return dilate(erode(cells, i, j, iterations, connectivity), i, j, shape, iterations, connectivity)


def closing(cells: DataFrame, i: str, j: str, shape: Shape, iterations: int = 1, connectivity: int = 1) -> DataFrame:
    """Dilation, then erosion: small holes are filled."""
    return erode(dilate(cells, i, j, shape, iterations, connectivity), i, j, iterations, connectivity)


def _regions(n: np.ndarray, width: int, connectivity: int) -> np.ndarray:
    """The least number of each cell's region, of cells numbered row by row."""
    order = np.argsort(n)
    n = n[order]
    root, links = np.arange(len(n)), []
    for a, b in _neighbourhood(connectivity):
        if (a, b) > (0, 0):
            col = n % width + b
            to = n + a * width + b
            at = np.searchsorted(n, to)
            ok = (col >= 0) & (col < width) & (at < len(n)) & (n[np.minimum(at, len(n) - 1)] == to)
            links.append(np.stack([np.flatnonzero(ok), at[ok]]))
    x, y = np.concatenate(links, axis=1)
    while True:  # the roots of both ends of a link hook onto the lesser one, then paths are halved
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while (low[low] != low).any():
            low = low[low]
        if (low == root).all():
            break
        root = low
    out = np.empty(len(n), np.int64)
    out[order] = n[root]
    return out


def components(cells: DataFrame, i: str, j: str, shape: Shape, least: int = 1, connectivity: int = 1, tile: int = 1024) -> DataFrame:
    """(i, j, label, size) of the cells in regions of at least ``least`` cells, regions numbered from 1 by their first cell in row order.

    A tile of tile x tile cells is one group, so the work of a task is bounded whatever the grid.
    """
    width = shape[1]
    c = cells.select(F.col(i).cast("long").alias(i), F.col(j).cast("long").alias(j), (F.col(i) * width + F.col(j)).cast("long").alias("n"))
    placed = c.withColumns({"ti": F.floor(F.col(i) / tile), "tj": F.floor(F.col(j) / tile)})

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(local=_regions(pdf["n"].to_numpy(), width, connectivity))

    local = placed.groupBy("ti", "tj").applyInPandas(label, StructType([*placed.schema.fields, StructField("local", LongType())]))
    local = cut(local)
    edge = ((F.col(i) % tile).isin(0, tile - 1)) | ((F.col(j) % tile).isin(0, tile - 1))
    border = local.filter(edge).select(i, j, "ti", "tj", "local")
    steps = F.array(*(F.struct((F.col(i) + a).alias(i), (F.col(j) + b).alias(j)) for a, b in _neighbourhood(connectivity) if (a, b) > (0, 0)))
    near = border.select(F.explode(steps).alias("o_"), F.col("local").alias("a"), F.col("ti").alias("ai"), F.col("tj").alias("aj")).select(f"o_.{i}", f"o_.{j}", "a", "ai", "aj")
    links = cut(near.join(border, [i, j]).filter("ai <> ti or aj <> tj").select("a", F.col("local").alias("b")).distinct())
    region = local.withColumn("region", F.col("local"))
    if not links.isEmpty():
        joined = min_labels(links, "a", "b").select(F.col("node").alias("local"), F.col("label").alias("joined"))
        region = local.join(joined, "local", "left").withColumn("region", F.coalesce("joined", "local"))
    sizes = region.groupBy("region").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return region.join(ranked(sizes, "region", "label"), "region").select(i, j, "label", "size")
