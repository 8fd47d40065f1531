"""The pipeline's stages, each against a plain version on a small corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from fieldloom.llm import decontaminate as D
from fieldloom.llm import registry
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_ngram_join import brute as near


def corpus():
    rng = random.Random(8)
    good = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(160):
        w = [rng.choice(good) for _ in range(rng.randint(20, 60))]
        toxic, poor = i % 8 == 0, i % 8 == 1
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "foul", "nasty"]))
        if poor:
            w = [x + "&&&" for x in w]
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 0 if poor else 1, int(toxic)))
    rows += [(200, rows[2][1], "en", "s", 0), (201, rows[3][1].replace(" ", "\n"), "en", "s", 0), (202, rows[4][1] + " extra", "en", "s", 0), (203, None, "en", "s", 0), (204, "", "en", "s", 0)]
    rows += [(205, rows[5][1] + " " + " ".join(f"bench{i}" for i in range(12)), "en", "s", 0)]
    return rows, labels, [(1, " ".join(f"bench{i}" for i in range(12))), (2, None)]


def test_stages(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, sf = dict(P.STAGES), str(tmp_path)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_join", "decontamination", "bpe"]

    kept = stages["quality_classifier"](spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    bad = {i for i, q, t in labels if t or not q}
    assert len(bad & ids) <= 2 and len([i for i, _, _ in labels if i not in bad and i not in ids]) <= 2

    texts = [(r.doc_id, r.text) for r in docs.collect()]
    once = {r.doc_id for r in stages["exact_dedup"](spark, docs, sf).collect()}
    assert once == {i for i, keep, _, _ in copies(texts) if i == keep}
    apart = {r.doc_id for r in stages["ngram_join"](spark, docs, sf).collect()}
    assert apart == {i for i, c in near(texts).items() if i == c}
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()}
    assert clean == {r[0] for r in D.brute_force(texts, items) if not r[5]} and 205 not in clean
    assert {r.doc_id for r in stages["bpe"](spark, docs, sf).collect()} == {i for i, _ in texts}

    final = {r.doc_id for r in P.run(spark, sf).collect()}
    assert final and final <= ids & clean and not {200, 201, 202, 205} & final


def test_queries_are_registered():
    assert [n for n in registry.QUERIES if n.startswith("op")] and len(registry.QUERIES) == 13


def test_null_and_repeated_ids(spark, tmp_path):
    text = lambda x, n=60: " ".join(f"{x}{i}" for i in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text("bench", 12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(P.STAGES)

    def left(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
        return sorted(((r.doc_id, r.text) for r in stages[stage](spark, docs, str(tmp_path)).collect()), key=str)

    a, b, c = text("a"), text("b"), text("c")
    ids = [(None, a), (None, b), (5, c), (5, c)]
    assert left("quality_classifier", ids) == sorted(ids, key=str)
    # A repeated row stays once; a copy goes though its id stays with another text; an id comes before a null one.
    assert left("exact_dedup", [*ids, (1, b), (7, a), (7, c)]) == [(1, b), (5, c), (7, a)]
    assert left("ngram_join", [*ids, (1, b + " more"), (5, a + " more"), (None, "")]) == sorted([(1, b + " more"), (5, a + " more"), (5, c), (None, "")], key=str)
    bad = a + " " + text("bench", 12)
    assert left("decontamination", [*ids, (5, bad), (None, bad)]) == sorted(ids, key=str)


def test_columns_that_clash_with_helpers_come_back(spark, tmp_path):
    rows, labels, items = corpus()
    extra = ["page", "bitmap", "found", "at_", "row_", "k1", "kept", "class_id", "digest", "h", "expected_grade"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = spark.createDataFrame(rows, schema)
    docs = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, stage in P.STAGES[:4]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        want = {r.doc_id for r in stage(spark, plain, str(tmp_path)).collect()}
        got = got.collect()
        assert {r.doc_id for r in got} == want and all(r[c] == f"{c}{r.doc_id}" for r in got for c in extra), name
    repeated = docs.unionByName(docs.filter("doc_id < 3"))
    assert P.exact_dedup_stage(spark, repeated, str(tmp_path)).columns == docs.columns


def test_empty_documents_stay_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
