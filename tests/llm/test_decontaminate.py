import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate as D

ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and AGAIN."), (2, "short item"), (3, None), (4, "..."), (10, "Quick brown fox jumps over the lazy dog again and again"), (11, "Été été x x x x x x x x x x x")]
DOCS = [
    (1, "say: the QUICK brown fox, jumps over the lazy dog again and again! the end"),
    (2, "a short item is here, short; item"),
    (3, None),
    (4, ""),
    (5, "the quick brown fox jumps over the lazy cat"),
    (6, "x " * 30 + "Été été " + "x " * 11),
    (7, "short"),
    (8, "item and short"),
    (2, "short item"),
    (9, "filler " * 3000 + "short item " * 2),
]


def rows(spark, docs=DOCS, items=ITEMS, **k):
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, b, **k)
    return sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_hit", F.size("items"), "items_sha256", "contaminated").collect())


def test_matches_brute_force(spark):
    assert rows(spark) == sorted(D.brute_force(DOCS, ITEMS))
    assert rows(spark, n=3) == sorted(D.brute_force(DOCS, ITEMS, 3))


def test_blocks_of_phrases_and_small_shards_change_nothing(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = D.build_index(d, words_per_shard=5).cache()
    whole = D.search(index, D.phrases_of(b, n=4))
    parts = D.search(index, D.phrases_of(b, n=4), block=3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_proximity(spark):
    d = spark.createDataFrame([(1, "item a b short"), (2, "item a b c d e short"), (3, "item")], "doc_id long, text string")
    b = spark.createDataFrame([(2, "short item")], "item_id long, text string")
    got = D.search(D.build_index(d), D.phrases_of(b), within=3).collect()
    assert {r.doc_id: r["items"] for r in got} == {1: ["2"], 2: [], 3: []}


def test_empty_tables(spark):
    assert rows(spark, docs=[]) == []
    assert [r[2] for r in rows(spark, items=[])] == [0] * len(DOCS)


def test_null_and_repeated_ids_are_separate_documents_in_any_blocks(spark):
    docs = [(None, "short item here"), (None, "nothing"), (-1, "short item"), (7, "other words"), (7, "a short item")]
    one = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = D.build_index(one.unionByName(one))  # two tasks whose shards begin alike
    phrases = D.phrases_of(spark.createDataFrame([(1, "short item"), (2, "other words"), (3, None)], "item_id long, text string"))
    want = sorted(2 * [(None, 3, 2), (None, 1, 0), (-1, 2, 2), (7, 2, 2), (7, 3, 2)], key=str)
    for block in (1, 100):
        got = D.search(index, phrases, block=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in got), key=str) == want


def test_proximity_matches_brute_force(spark):
    rng = random.Random(8)
    pool = ["a", "b", "c", "d", "e", "rare", "é", "x1"]
    text = lambda k: " ".join(rng.choice(pool) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(None, None), (70, "rare"), (70, "a b"), (71, "filler " * 70 + "rare a " + "b " * 70 + "c")]
    items = [(i, text(rng.randint(1, 9))) for i in range(25)] + [(90, None), (91, "rare rare"), (92, "unknown words")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for n, within in ((4, 6), (3, 2), (1, 0), (10, 31)):  # below n - 1 exact matches are no proximity matches
        got = D.decontaminate(d, b, n=n, within=within)
        assert sorted(((r.doc_id, r.near_items) for r in got.collect()), key=str) == sorted(D.brute_near(docs, items, n, within), key=str)
        assert got.filter("size(array_except(items, near_items)) > 0").isEmpty()
        same = D.decontaminate(d, b, n=n).drop("near_items")
        assert sorted(map(str, same.collect())) == sorted(map(str, got.drop("near_items").collect()))
    index, phrases = D.build_index(d, words_per_shard=40).cache(), D.phrases_of(b, n=4)
    whole = sorted(map(str, D.search(index, phrases, within=6).collect()))
    assert whole == sorted(map(str, D.search(index, phrases, within=6, block_bytes=100).collect()))
    with pytest.raises(ValueError):
        D.search(index, phrases, within=32)
