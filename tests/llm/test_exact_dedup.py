import hashlib

from pyspark.sql import functions as F

from fieldloom.llm import exact_dedup as E
from fieldloom.llm.exact_dedup import exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, "é x"), (7, "éx"), (8, "zz"), (8, "zz"), (None, "z z"), (9, "long " * 5000), (10, "long" * 5000)]


def brute(rows):
    def norm(t):
        return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")

    out = []
    for i, t in rows:
        same = [(-len(u or ""), j is None, j) for j, u in rows if norm(u) == norm(t)]
        out.append((i, min(same)[2], len(same), hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_matches_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, digest string, copies int")
    got = exact_dedup(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=key) == sorted(brute(ROWS), key=key)
    assert sum(r.kept for r in got) == len({r.digest for r in got})


def test_colliding_digests_are_split_on_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup(df, digest=lambda t: F.length(t).cast("string")).collect()
    want = sorted((r[:3] for r in brute(ROWS)), key=key)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=key) == want


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_levels_of_batches_merge_into_the_level_of_all(spark):
    schema = "doc_id long, text string"
    batches = [spark.createDataFrame(ROWS[i::3], schema) for i in range(3)]
    level = E.compact(E.as_level(E.flush(batches[0])), E.as_level(E.flush(batches[1])))
    level = E.compact(level, E.as_level(E.flush(batches[2])))
    whole = E.compact(E.as_level(E.flush(spark.createDataFrame(ROWS, schema))))
    shape = lambda df: sorted((tuple(r) for r in df.drop("keep_row").collect()), key=key)
    assert shape(level) == shape(whole) and level.count() == len({x[3] for x in brute(ROWS)})


def test_flush_has_no_exchange(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS text")
    runs = E.flush(docs)
    assert runs.rdd.getNumPartitions() >= 1 and runs.count() == 1000
    found = exact_dedup(docs).collect()
    assert sum(r.kept for r in found) == 7 and {r.keep_id for r in found} == set(range(7))
