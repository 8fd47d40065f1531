import zlib

import numpy as np

from fieldloom.llm import language as L

WORDS = {"aa": ["the", "thing", "with", "and", "there"], "bb": ["der", "schön", "und", "nicht", "über"], "cc": ["слово", "язык", "и", "это"]}


def corpus(n=300):
    rng = np.random.default_rng(2)
    return [(i, " ".join(rng.choice(WORDS[lang], rng.integers(3, 40))), lang, "x") for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_held_out_accuracy_and_nulls(spark):
    rows = corpus() + [(1000, None, "aa", "x"), (1001, "123 !?", "bb", "x"), (1002, "the thing", None, "x"), (None, "und nicht über", "bb", "x"), (1003, "und " * 40_000, "bb", "x")]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), dimension=512).collect()}
    assert len(got) == len(rows)
    test = [r for r in corpus() if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in test)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in test]) > 0.98
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(60)
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else g, x) for i, t, g, x in rows]
    schema = "doc_id long, text string, lang string, x string"
    a, b = (sorted(map(tuple, L.identify(spark.createDataFrame(r, schema), dimension=256).collect())) for r in (rows, wrong))
    assert a == b


def test_bundle_is_the_sum_of_bound_permuted_vectors():
    book = L.Codebook(64)
    codes, counts = book.trigrams("Ab a")
    a, b, o = book.letters[1].astype(int), book.letters[2].astype(int), book.letters[0].astype(int)
    bind = lambda x, y, z: np.roll(x, 2) * np.roll(y, 1) * z
    assert (book.bundle(codes, counts) == bind(o, a, b) + bind(a, b, o) + bind(b, o, a) + bind(o, a, o)).all()


def test_empty(spark):
    assert L.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_matches_brute_force(spark):
    """Profiles and cosines by definition: every trigram's vector is bound and added one by one."""
    d, rows = 128, corpus(45)
    rng = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (L.SIGNS, d)).astype(float)
    table = L._fold_table()

    def vector(text):
        signs = [0]
        for c in text:
            s = int(table[min(ord(c), L.TABLE_END)])
            if s or signs[-1]:
                signs.append(s)
        if signs[-1]:
            signs.append(0)
        v, counts = np.zeros(d), {}
        for x, y, z in zip(signs, signs[1:], signs[2:]):
            v += np.roll(rng[x], 2) * np.roll(rng[y], 1) * rng[z]
            counts[x, y, z] = counts.get((x, y, z), 0) + 1
        return v, sum(n * n for n in counts.values()) ** 0.5

    sums = {}
    for i, text, lang, _ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            v, size = vector(text)
            sums[lang] = sums.get(lang, 0) + v / size
    names = sorted(sums)
    unit = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    unit -= unit.mean(axis=0)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, x string"), dimension=d).collect()}
    for i, text, _, _ in rows:
        v, _ = vector(text)
        cosine = unit @ v / np.linalg.norm(v)
        assert got[i].lang_pred == names[int(cosine.argmax())] and abs(got[i].score - (1 + cosine.max()) / 2) < 1e-5
