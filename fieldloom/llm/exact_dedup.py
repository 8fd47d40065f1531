"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

A memtable is what a task reads: it is sorted by digest and flushed as a run, without an exchange. A level is sorted
too and holds a row a digest: the row to keep and the number of rows. Compaction merges runs and levels into a level; a
further batch is flushed and merged with the level that is there. A level's filter, a bitmap of the digests that it
holds more than once, tells most other rows that they are alone, so that only hits are looked up. Hits are verified
on their bytes; digests whose texts differ (a collision) are then split by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, flag_in, id_filter, maybe_in, skew_lookup, stored

SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without white space of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _write(df: DataFrame, name: str) -> DataFrame:
    """df, sorted by digest in each file, in the shared folder."""
    return stored(df.sortWithinPartitions("digest"), name)


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Stored sorted runs (digest, doc_id, points, row) of docs, one a task; row tells rows apart that repeat an id."""
    text = F.col(text_col).cast("string")
    rows = docs.select(digest(normalised(text)).cast("string").alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("points"), F.monotonically_increasing_id().alias("row"))
    return _write(rows, "runs")


def as_level(runs: DataFrame) -> DataFrame:
    """Runs in the shape of a level, not merged yet."""
    return runs.select("digest", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"), F.col("row").alias("keep_row"))


def compact(*levels: DataFrame) -> DataFrame:
    """One stored level of several: of a digest the row with the most points, then the smallest id, nulls last, stays."""
    every = reduce(DataFrame.unionByName, levels)
    best = F.min(F.struct((-F.col("keep_points")).alias("p"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("d"), F.col("keep_row").alias("r")))
    merged = every.groupBy("digest").agg(F.sum("group_size").alias("group_size"), best.alias("b"))
    return _write(merged.select("digest", "group_size", F.col("b.d").alias("keep_id"), (-F.col("b.p")).alias("keep_points"), F.col("b.r").alias("keep_row")), "level")


def _look_up(runs: DataFrame, level: DataFrame, flagged: Callable[[DataFrame], DataFrame], total: int) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest): rows that the level's filter rules out are alone; the others are joined."""
    several = level.filter("group_size > 1")
    rows = flagged(runs)
    hits = skew_lookup(rows.filter("found").drop("found"), several, "digest", "group_size", total, how="left")
    hits = hits.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("group_size").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"), "digest")
    alone = rows.filter("not found").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return hits.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) for each row of docs.

    Texts are equal if they are so without white space. Of equal texts the row with the most code points, then the
    smallest id stays. Null texts count as empty, and empty texts are equal to each other. Null ids come last among
    equals. Of rows that repeat id and length in a group exactly one is kept. Other columns are ignored. An empty
    table gives an empty result. ``digest`` may be weak: equality is settled on bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = flush(rows, digest=digest)
    level = compact(as_level(runs))
    n_several, total = level.agg(F.count_if(F.col("group_size") > 1), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    several = level.filter("group_size > 1").select("digest")
    pages, slot = id_filter(several, n_several)
    if n_several:
        # Byte verification: the least and the greatest text of a digest are the same bytes, or the digest collides.
        norm = rows.select(normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")).cast("string"))
        ends = maybe_in(norm, F.col("digest"), pages, slot).groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        clash = stored(ends.filter("lo <> hi").select("digest"), "clash")
        if not clash.isEmpty():
            # Exact way for collided digests: the text becomes part of the digest.
            fixed = rows.withColumn("norm", normalised(F.col("text"))).withColumn("digest", digest(F.col("norm")).cast("string")).join(clash.withColumn("c", F.lit(1)), "digest", "left")
            exact = F.when(F.col("c") == 1, F.concat_ws(":", "digest", "norm")).otherwise(F.col("digest"))
            discard(runs, level)
            runs = _write(fixed.select(exact.alias("digest"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("points"), F.monotonically_increasing_id().alias("row")), "runs")
            level = compact(as_level(runs))
            several = level.filter("group_size > 1").select("digest")
            pages, slot = id_filter(several, several.count())
        discard(clash)
    return _look_up(runs, level, lambda df: flag_in(df, F.col("digest"), pages, slot), total)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
w AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY h ORDER BY points DESC, doc_id) AS n
  FROM t)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, h AS text_sha256 FROM w
"""
