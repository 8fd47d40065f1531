"""Scratch storage, checkpoints and skew-safe joins shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_BITS = 32768  # bits of one page of a broadcast filter
ARROW_BYTES, ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
PAGES_AT_MOST = 2048  # 8 MB: bound of a broadcast filter at every input size


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + os.path.join(tempfile.gettempdir(), "fieldloom-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of at most ``size`` on their way to Python, whatever the length of texts, unless the session has a bound of its own."""
    if spark.conf.get(ARROW_BYTES) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, size)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and survives lost executors.

    Zstandard streams over the heap, while the default codec holds a direct buffer a column until a full collection.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes stored() tables that nothing will read any more."""
    for table in tables:
        path = getattr(table, "_stored_at", None) if table is not None else None
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for small iterative state."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skew_lookup(rows: DataFrame, index: DataFrame, key: str, size: str, total: int, keys_at_most: int = 1000, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with an index of one row per key, where column ``size`` counts a key's rows.

    Keys that hold over 1/keys_at_most of all rows go by broadcast; by counting there are at most keys_at_most
    of them, whatever the input. The rest go by an ordinary join, in which no key is then hot.
    """
    hot_size = max(1000, total // keys_at_most)
    hot = index.filter(F.col(size) >= hot_size)
    cold = index.filter(F.col(size) < hot_size)
    by_broadcast = rows.join(F.broadcast(hot), key)
    by_shuffle = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return by_broadcast.unionByName(by_shuffle)


def id_filter(ids: DataFrame, n: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A bitmap over hashed ids (one hash, about 16 bits an id, PAGES_AT_MOST pages at most), and its hash.

    It has false positives, never false negatives; beyond its bound it only lets more rows pass. A page is an array of
    512 longs.
    """
    pages = 1
    while pages < PAGES_AT_MOST and pages * PAGE_BITS < 16 * n:
        pages *= 2

    def slot(x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(pages * PAGE_BITS))

    hashed = ids.select(slot(ids[0]).alias("h"))
    words = hashed.groupBy(F.expr(f"h div {PAGE_BITS}").alias("page"), F.expr(f"cast((h % {PAGE_BITS}) div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("bits"))
    held = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return held.select("page", F.expr(f"transform(sequence(0, {PAGE_BITS // 64 - 1}), w -> coalesce(m[w], 0L))").alias("bitmap")), slot


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def flag_in(df: DataFrame, key: Column, pages: DataFrame, slot: Callable[[Column], Column], into: str = "found") -> DataFrame:
    """df with a column ``into``, false where the filter rules the key out; the filter goes by broadcast, within its bound."""
    at, page, bitmap = fresh(df, "at_", "page", "bitmap")
    paged = df.withColumn(at, slot(key)).withColumn(page, F.expr(f"`{at}` div {PAGE_BITS}")).join(F.broadcast(pages.toDF(page, bitmap)), page, "left")
    bit = f"shiftright(`{bitmap}`[cast((`{at}` % {PAGE_BITS}) div 64 as int)], cast(`{at}` % 64 as int)) & 1L = 1L"
    return paged.withColumn(into, F.coalesce(F.expr(bit), F.lit(False))).drop(page, at, bitmap)


def maybe_in(df: DataFrame, key: Column, pages: DataFrame, slot: Callable[[Column], Column]) -> DataFrame:
    """The rows whose key the filter doesn't rule out."""
    found = fresh(df, "found")[0]
    return flag_in(df, key, pages, slot, found).filter(F.col(found)).drop(found)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list as (id, component), component being the smallest id.

    Min-label propagation with pointer jumping; the state is a narrow table that is checkpointed each round, and
    rounds end when no label changes. Only ids that have an edge are returned. Nulls are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).dropna().filter("u <> v")
    both = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    total = label.count()
    while True:
        heard = both.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        nearer = label.join(heard, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        # Very many ids may share a label: those labels are looked up once and go by broadcast.
        jump = nearer.select(F.col("u").alias("l"), F.col("l").alias("ll")).join(nearer.groupBy("l").agg(F.count("*").alias("uses")), "l")
        new = cut(skew_lookup(nearer, jump, "l", "uses", total).select("u", "old", F.least("l", "ll").alias("l")))
        label = new.select("u", "l")
        if new.filter("l <> old").isEmpty():
            discard(both)
            return label.select(F.col("u").alias("id"), F.col("l").alias("component"))
