"""The registered opN queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, exact_dedup, fim, language, line_dedup, ngram_join, quality, secrets, suffix_dedup, url_filter, warc
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    kinds = F.col("spans.kind")
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.substring_index("digest", ":", 1).alias("text_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near: all words of a window within 20 words of the document, in any order."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=19)
    near = [F.size("near_items").cast("long").alias("n_near_items"), F.sha2(F.concat_ws(",", "near_items"), 256).alias("near_items_sha256")]
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", "contaminated", *near)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.classify(docs, docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "expected_grade", F.element_at("tails", -1).alias("p_best"), "grade", "keep")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer files' place on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"), spark)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.by_document(line_dedup.line_dedup(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fim.restored(F.col("form"), F.col("output"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is the one whose page_id a label names; it is bad if it is toxic or of poor quality."""
    bad = F.greatest((F.col("toxic") == 1), (F.col("quality") == 0))  # of a null and a value the value
    outcomes = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    found = url_filter.url_filter(table(spark, sf_dir, "pages"), outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad", F.round("bound", 4).alias("bad_bound"))


QUERIES = {"op1_secrets": op1_secrets, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_suffix_dedup": op5_suffix_dedup, "op6_warc": op6_warc, "op7_language": op7_language, "op2_exact_dedup": op2_exact_dedup, "op8_benchmark_decontamination": op8_benchmark_decontamination, "op9_line_dedup": op9_line_dedup, "op10_ngram_join": op10_ngram_join, "op11_collocations": op11_collocations, "op12_fill_in_middle": op12_fill_in_middle, "op13_url_filter": op13_url_filter}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_fill_in_middle": fim.ORACLE, "op13_url_filter": url_filter.ORACLE}
