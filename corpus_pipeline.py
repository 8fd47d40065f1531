"""A training-data pipeline over ``documents``: five stages, each with an operator of fieldloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents, others that documents may have among them, whatever their names. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, common, decontaminate, exact_dedup, ngram_join, quality, registry


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a number of each row, whose order is that of doc_id, nulls last; and the number's column, a name that docs don't have.

    If no id is null or repeats, it is the id. Else docs are stored in the order of ids with numbers, so that every
    reader sees the same ones; the text's hash splits ids that very many rows share over several tasks.
    """
    common.bounded_batches(docs.sparkSession)
    row = common.fresh(docs, "row_")[0]
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row
    in_order = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return common.stored(in_order.withColumn(row, F.monotonically_increasing_id()), name), row


def _without(rows: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """rows less those that found names in its column doc_id, which holds numbers of rows; a bitmap keeps most others out of the join."""
    gone = common.stored(found.select(F.col("doc_id").alias(row)), "gone")
    pages, slot = common.id_filter(gone, gone.count())
    maybe = common.fresh(rows, "found")[0]
    flagged = common.flag_in(rows, F.col(row), pages, slot, maybe)
    rest = flagged.filter(F.col(maybe)).drop(maybe).join(gone, row, "left_anti")
    return flagged.filter(~F.col(maybe)).drop(maybe).unionByName(rest).drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are probably toxic or of poor quality: P(best grade) under 0.5; none without labels.

    Each row is judged by its own text, with a null or repeated id too; a null id has no label. An empty table stays empty.
    """
    return quality.select(docs, quality.fit(quality.graded(docs, common.table(spark, sf_dir, "labels"))))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that are equal without white space: the longest, then the smallest id.

    Null ids come last among equals. Of rows that repeat an id each stands for its own text; a repeated row stays once.
    """
    rows, row = _numbered(docs, "exact_rows")
    return _without(rows, row, exact_dedup.exact_dedup(rows, row).filter(~F.col("kept")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each class of near-duplicates.

    Null ids come last in a class. Rows that repeat an id are in the classes of their own texts.
    """
    rows, row = _numbered(docs, "near_rows")
    return _without(rows, row, ngram_join.ngram_join(rows, row).filter(F.col("doc_id") != F.col("class_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    Each row is judged by its own text, with a null or repeated id too.
    """
    rows, row = _numbered(docs, "decontamination_rows")
    found = decontaminate.decontaminate(rows, common.table(spark, sf_dir, "benchmark"), row)
    return _without(rows, row, found.filter("contaminated"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row that is left; ids pass through."""
    common.bounded_batches(spark)
    found = bpe.encode_decode(docs, registry.tokenizer_path())
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_join", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

ORACLE_SQL = None  # a fitted model and BPE have no SQL; tests/llm/test_pipeline.py checks every stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written as Parquet and read again as the next stage's documents."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, name)
    return docs
