"""Shared window and column helpers of the operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-30


def keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def ordered(by: str | Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys(by)).orderBy(*keys(order))


def indexed(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], name: str = "i") -> DataFrame:
    """df with the position of each row in its series, from 0. order must be total for a defined result."""
    return df.withColumn(name, F.row_number().over(ordered(by, order)) - 1)


def guarded(x: Column) -> Column:
    """NaN, infinite and missing values as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def safe_div(a: Column, b: Column, least: float = TINY) -> Column:
    """a / max(b, least)."""
    return a / F.greatest(b, F.lit(least))


def mirrored(df: DataFrame, by: str | Sequence[str], index: str, half: int) -> DataFrame:
    """df with ``half`` rows mirrored at both ends of each series, the edge row itself not repeated, and column ``pad``.

    Mirrored rows get indexes below 0 and from n on. A series must hold more than ``half`` rows for a full mirror.
    """
    n = F.count("*").over(Window.partitionBy(*keys(by)))
    sized = df.withColumn("n_", n)
    low = sized.filter(F.col(index).between(1, half)).withColumn(index, -F.col(index))
    high = sized.filter((F.col(index) >= F.col("n_") - 1 - half) & (F.col(index) <= F.col("n_") - 2)).withColumn(index, 2 * (F.col("n_") - 1) - F.col(index))
    low, high = (x.withColumn(index, F.col(index).cast("int")).withColumn("pad", F.lit(True)) for x in (low, high))
    return sized.withColumn(index, F.col(index).cast("int")).withColumn("pad", F.lit(False)).unionByName(low).unionByName(high).drop("n_")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + os.path.join(tempfile.gettempdir(), "fieldloom-checkpoints")
    return root


def cut(df: DataFrame) -> DataFrame:
    """df behind a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


RUN = 500_000  # rows that a task sorts


def _tasks(df: DataFrame) -> int:
    """As many tasks as sort RUN rows each, so what a task holds doesn't grow with the rows; of fewer rows, up to Spark's number of shuffle partitions."""
    rows, usual = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1 + rows // RUN, min(usual, 1 + rows // 10_000))


def ranked(df: DataFrame, order: str | Sequence[str], name: str) -> DataFrame:
    """df with the rows' numbers by order, from 1. order must be total for a defined result.

    Rows are range-partitioned and numbered in their partition; the driver only adds up one count a partition.
    """
    o = keys(order)
    n_tasks = _tasks(df)
    s = cut(df.repartitionByRange(n_tasks, *o).sortWithinPartitions(*o).withColumn("part_", F.spark_partition_id()))
    before, offsets = 0, []
    for r in s.groupBy("part_").count().orderBy("part_").collect():
        offsets.append((r["part_"], before))
        before += r["count"]
    if not offsets:
        return s.drop("part_").withColumn(name, F.lit(0).cast("long"))
    at = df.sparkSession.createDataFrame(offsets, "part_ int, before_ long")
    n = F.row_number().over(Window.partitionBy("part_").orderBy(*o)) + F.col("before_")
    return s.join(F.broadcast(at), "part_").repartition(n_tasks, "part_").withColumn(name, n.cast("long")).drop("part_", "before_")


def running(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str], sums: Mapping[str, Column], totals: Mapping[str, Column] | None = None) -> DataFrame:
    """df with running sums over each group by order, the row itself included, and ``totals`` (aggregates) of its group.

    Rows are range-partitioned by group and order, so a group of any size spreads over as many partitions as it needs; a
    row a group and partition carries what comes before. order must be total in a group for a defined result; null keys
    are a group.
    """
    k, o, totals = keys(by), keys(order), dict(totals or {})
    own = "r_"  # no column of the caller's begins like our own ones
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    part, at_ = f"{own}part", f"{own}at"
    n_tasks = _tasks(df)
    s = cut(df.withColumns({f"{own}s{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(n_tasks, *k, *o).sortWithinPartitions(*k, *o).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(*k).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    at = s.groupBy(part, *k).agg(*(F.sum(f"{own}s{i}").alias(f"{own}b{i}") for i in range(len(sums))))
    offsets = [F.coalesce(F.sum(f"{own}b{i}").over(before), F.lit(0)).alias(f"{own}b{i}") for i in range(len(sums))]
    at = at.select(F.col(part).alias(at_), *(F.col(c).alias(f"{own}k{j}") for j, c in enumerate(k)), *offsets)
    if totals:
        every = s.groupBy(*k).agg(*(c.alias(f"{own}t{i}") for i, c in enumerate(totals.values())))
        every = every.withColumnsRenamed({c: f"{own}g{j}" for j, c in enumerate(k)})
        same = F.lit(True)
        for j in range(len(k)):
            same = same & F.col(f"{own}k{j}").eqNullSafe(F.col(f"{own}g{j}"))
        at = at.join(every, same)
    same = F.col(part) == F.col(at_)
    for j, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"{own}k{j}"))
    w = Window.partitionBy(part, *k).orderBy(*o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: F.sum(f"{own}s{i}").over(w) + F.col(f"{own}b{i}") for i, name in enumerate(sums)}
    return s.join(at, same).repartition(n_tasks, part, *k).select(*df.columns, *(c.alias(n) for n, c in found.items()), *(F.col(f"{own}t{i}").alias(n) for i, n in enumerate(totals)))


def with_totals(df: DataFrame, by: str | Sequence[str], totals: Sequence[Column], few: int = 10_000) -> DataFrame:
    """df with aggregates of each row's group; null keys are a group.

    Partial aggregates carry a group's rows, not a window over it. Up to ``few`` groups are broadcast, more are joined by a shuffle.
    """
    k = keys(by)
    every = cut(df.groupBy(*k).agg(*totals).withColumnsRenamed({c: f"g{j}_" for j, c in enumerate(k)}))
    same = F.lit(True)
    for j, c in enumerate(k):
        same = same & F.col(c).eqNullSafe(F.col(f"g{j}_"))
    return df.join(F.broadcast(every) if every.count() <= few else every, same).drop(*(f"g{j}_" for j in range(len(k))))
