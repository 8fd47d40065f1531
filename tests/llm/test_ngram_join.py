import random

import numpy as np
import pytest

from fieldloom.llm import ngram_join as N
from fieldloom.llm.decontaminate import words


def grams(text, n=5):
    w = words((text or "").encode())
    m = min(n, len(w))
    return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()


def brute(rows, threshold=0.8):
    """Class ids and links by definition, each distinct set once."""
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and a is not None and b is not None and len(x & y) >= threshold * len(x | y) - 1e-12:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) if i is not None else None for i, _ in rows}


def corpus(groups, seed=0):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for size, edits in groups:
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    rng.shuffle(rows)
    return rows


ODD = [(100_000, None), (100_001, ""), (100_002, "..."), (100_003, "a b"), (100_004, "A, b!"), (100_005, "a c"), (None, "a b"), (100_006, "x " * 40_000), (100_007, "x " * 90), (100_008, "a b"), (100_008, "a b")]


def joined(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, key int")
    return N.ngram_join(df, **k).collect()


@pytest.mark.parametrize("groups", [[(1, 0)] * 30 + [(5, 2)] * 6, [(60, 6), (40, 12), (3, 3)]])
def test_classes_match_brute_force(spark, groups):
    rows = corpus(groups) + ODD
    got = joined(spark, rows)
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    alone = {r.doc_id for r in got if r.n_links == 0}
    assert {100_000, 100_001, 100_002, None} <= alone


def test_chains_across_leaders(spark):
    """Each text is similar to the next one only: no leader is similar to all, yet they are one class."""
    rng = random.Random(4)
    w = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        for j in range(3):
            w[(i * 7 + j) % 300] = f"new{rng.random()}"
    got = joined(spark, rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_blocks_of_large_buckets_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = corpus([(60, 10), (40, 14)], 3)
    got = joined(spark, rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_banding():
    for t, recall in ((0.8, 0.9999), (0.5, 0.99)):
        b, r = N.bands_for(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= 128


def test_minhash_estimates_jaccard(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 120, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, 120, dtype=np.uint64)
    base = N._mix(np.arange(1, 5001, dtype=np.uint64))
    same = np.mean(N._minima(base[:4500], a, b) == N._minima(base[500:], a, b))
    assert abs(same - 4000 / 5000) < 0.12


def test_empty(spark):
    assert joined(spark, []) == []


def test_sketches_let_pairs_at_the_threshold_pass():
    import math

    for t in (0.5, 0.8):
        p, most = (1 - t) / 2, N.most_flips(t)
        lost = 1 - sum(math.comb(N.SKETCH, k) * p**k * (1 - p) ** (N.SKETCH - k) for k in range(most + 1))
        assert lost < 1e-6


def degrees(rows, threshold=0.8):
    """Links of each id's text with other distinct texts, by definition."""
    sets = {i: frozenset(grams(t)) for i, t in rows}
    distinct = [x for x in set(sets.values()) if x]
    n = {x: sum(x != y and len(x & y) / len(x | y) >= threshold for y in distinct) for x in distinct}
    return {i: n.get(x, 0) for i, x in sets.items()}


@pytest.mark.parametrize("block", [8, 2048])
def test_links_within_classes_are_counted(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(2)
    w = [f"u{i}" for i in range(200)]
    rows = [(10_000 + i, " ".join(w[:k] + [f"x{i}"] + w[k:])) for i, k in enumerate((20, 90, 150))]
    for g in range(3):
        base = [f"g{g}w{rng.randrange(900)}" for _ in range(150)]
        for i in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(150)] = f"n{rng.random()}"
            rows.append((g * 100 + i, " ".join(w)))
    want, got = degrees(rows), {r.doc_id: r.n_links for r in joined(spark, rows, recall=0.9999)}
    assert [got[10_000 + i] for i in range(3)] == [2, 2, 2]
    # Pairs near the threshold may miss each other in all bands; nothing is counted twice.
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_rows_that_repeat_an_id_keep_their_own_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in joined(spark, [(5, a), (5, b), (6, a + " more"), (7, b + " more")]))
    assert got == [(5, 5, 2), (5, 5, 2), (6, 5, 1), (7, 5, 1)]


def test_default_recall():
    import inspect

    k = inspect.signature(N.ngram_join).parameters
    assert N.bands_for(k["threshold"].default, k["recall"].default) == (24, 5)
