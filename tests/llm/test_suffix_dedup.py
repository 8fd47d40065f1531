import random

import pytest
from pyspark.sql import functions as F

from fieldloom.llm import suffix_dedup as S


def corpus(length, seed=0):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé \0") for _ in range(n))
    passages = [word(length + rng.randint(-3, length)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([word(rng.randint(0, length)), rng.choice(passages)]) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    one = word(3 * length)
    for i in range(80, 95):  # near copies of one text
        x = list(one)
        x[rng.randrange(len(x))] = "Z"
        rows.append((i, "".join(x)))
    rows += [(100, None), (101, ""), (102, "ab" * 3 * length), (103, "x" * (length + 1)), (104, "y" * length), (105, word(50 * length)), (None, passages[0] + "!"), (106, "same row " * length), (106, "same row " * length), (107, "é" * length)]
    return rows


@pytest.mark.parametrize("length,most", [(40, 50_000), (40, 1), (25, 50_000)])
def test_matches_brute_force(spark, length, most, monkeypatch):
    rows = corpus(length, length)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k1 int, lead string")
    got = S.suffix_dedup(df, length=length, group_at_most=most).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(S.brute_force(rows, length), key=str)


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 64)
    data = S.np.frombuffer(corpus(40)[5][1].encode() * 3, S.np.uint8)
    lead, _, _, at, lo, hi = S.picked(data, 40, S.Roller(), S.Roller(*S._SECOND))
    assert sorted(x for a, b in zip(lo, hi) for x in range(a, b + 1)) == list(range(len(data) - 39))
    assert ((at >= hi) & (at <= lo + 20)).all()


def test_empty(spark):
    assert S.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_repeat_id_and_text_cost_no_more_than_others(spark):
    import time

    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(8000))
    other = text[:3000] + "".join(rng.choice("xyz") for _ in range(3000))
    took = []
    for i in ("id", "cast(null as long)"):
        df = spark.range(5000, numPartitions=4).select(F.expr(i).alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(-1, other)], "doc_id long, text string"))
        began = time.time()
        got = S.suffix_dedup(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
        took.append(time.time() - began)
        assert sorted(map(tuple, got)) == [(6000, 3000, 1, 1), (8000, 8000, 1, 5000)]
    assert took[1] < 2 * took[0] + 5


def test_multikey_order():
    rng = S.np.random.default_rng(0)
    for shape, top in (((500, 6), 3), ((40, 1), 5), ((1, 2), 2), ((300, 4), 2**63)):
        m = rng.integers(0, top, shape).astype(S.U)
        order = S.multikey_order(m)
        assert sorted(order.tolist()) == list(range(shape[0]))
        assert m[order].tolist() == sorted(m.tolist())
    assert len(S.multikey_order(S.np.empty((0, 3), S.U))) == 0


def test_bytes_decide_when_fingerprints_collide(monkeypatch):
    length, lead = 8, b"wxyz"
    rows = [(1, 1, i, i, 10, 4, left + lead + right) for i, (left, right) in enumerate([(b"abcd", b"efgh"), (b"abcd", b"efzz"), (b"zzcd", b"efgh"), (b"qqqq", b"qqqq")])]
    want = S.settle(rows, length, S.Roller()).to_pydict()
    assert {k: (lo, hi) for k, lo, hi in zip(want["k1"], want["lo"], want["hi"])} == {0: (6, 10), 1: (6, 8), 2: (8, 10)}
    monkeypatch.setattr(S, "_fingerprints", lambda group, data, which, *a: S.np.zeros(len(which), S.U))
    assert S.settle(rows, length, S.Roller()).to_pydict() == want


def test_groups_without_a_common_window():
    rows = [(1, 1, i, i, 10, 4, left + b"wxyz" + right) for i, (left, right) in enumerate([(b"abcd", b"efgh"), (b"qqqq", b"qqqq")])]
    assert S.settle(rows, 8, S.Roller()).num_rows == 0 and S.settle(rows[:1], 8, S.Roller()).num_rows == 0
