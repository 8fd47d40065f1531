import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\f\r]", (text or "").translate(LOWER))]


def brute(rows, least, longest=5, top=2000, absorb=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    inside = Counter()
    for g, a in cand.items():
        for m in range(2, len(g) - 1):
            for i in range(1, len(g) - m + 1):
                key = (g[0], *g[i : i + m])
                inside[key] = max(inside[key], a)
    out = {}
    for g, a in cand.items():
        if g in inside and 100 * inside[g] >= absorb * a:
            continue
        lang, cut = g[0], []
        for j in range(1, len(g) - 1):
            left, right = f[g[: j + 1]], f[(lang, *g[j + 1 :])]
            cut.append((1000 * a * n[lang] // (left * right), j, left, right))
        score, _, left, right = min(cut)
        out.setdefault(lang, []).append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus():
    rng = random.Random(11)
    words = ["the", "The", "of", "é", "É", "new", "york", "city", "x-1", "語", "w" * 5000, "w" * 4999 + "v", " q", "\x00"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", " "]
    rows = []
    for _ in range(400):
        text = "".join(rng.choice(words[:8] if rng.random() < 0.9 else words) + rng.choice(marks) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice(["en", "en", "en", "de", None]), text + rng.choice(["", "New York City hall", "a b a b a b a"])))
    return rows + [("en", None), ("fr", ""), ("en", ".,;"), ("fr", "z " * 300), ("und", "the of new"), ("de", "one\ntwo")] + [("es", "uno dos tres cuatro cinco seis")] * 7


def found(df, **options):
    return sorted(map(tuple, C.collocations(df, **options).collect()))


@pytest.mark.parametrize("options", [{"least": 4}, {"least": 7, "longest": 3, "top": 10, "absorb": 60}])
def test_matches_brute_force(spark, options):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], "lang string, text string, n int, sub string, key binary").repartition(6)
    got = found(df, **options)
    assert got == brute(rows, **options)
    assert len({r[0] for r in got}) >= 4


def test_ids_that_clash_take_another_seed_or_stop(spark):
    rows = [("en", "a b c d a b c d e%d" % i) for i in range(10)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, least=5, bits=8) == brute(rows, 5)
    with pytest.raises(RuntimeError):
        found(df, least=5, bits=2)


def test_empty_tables_and_no_candidates(spark):
    df = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    assert found(df, least=2) == [] and found(df.limit(0)) == []


def test_words_of_slices():
    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choice("aB é.\n\t ,") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        array = pa.array(["skipped", *texts], pa.string()).slice(1)
        words = C.Words(array)
        ends = np.cumsum(words.sizes)
        got = [(int(d), bool(b), words.data[e - s : e].tobytes().decode()) for d, b, s, e in zip(words.doc, words.breaks, words.sizes, ends)]
        assert got == [(i, j == 0, w) for i, t in enumerate(texts) for p in pieces_of(t) for j, w in enumerate(p)]


def test_runs_sort_keys_that_share_a_hash():
    keys = np.array([[1, 2], [3, 4], [1, 2], [5, 6]], np.uint64)
    f, k, n = C._runs(np.array([7, 7, 7, 9]), keys, np.array([1, 2, 3, 4]))
    assert k.tolist() == [[1, 2], [3, 4], [5, 6]] and n.tolist() == [4, 2, 4] and f.tolist() == [7, 7, 9]
