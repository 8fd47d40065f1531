import numpy as np
import pytest

from fieldloom.llm import quality as Q


def corpus(n=400):
    rng = np.random.default_rng(5)
    good, bad = [f"word{i}" for i in range(300)], ["vile", "nasty", "foul"]
    rows = []
    for i in range(n):
        w = list(rng.choice(good, 30))
        grade = i % 3
        if grade == 0:
            w[3:5] = list(rng.choice(bad, 2))
        if grade == 1:
            w = [x + "&&&" for x in w]
        rows.append((i, " ".join(w), grade))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return Q.fit(spark.createDataFrame([(g, t) for _, t, g in corpus()], "grade int, text string"))


def test_held_out_accuracy_and_order(spark, model):
    rows = [(i, t, g) for i, t, g in corpus(600) if i >= 400]
    got = {r.doc_id: r for r in Q.predict(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert np.mean([got[i].grade == g for i, _, g in rows]) > 0.9
    assert (np.diff(model.thresholds) > 0).all()
    for r in got.values():
        assert r.tails[0] >= r.tails[1] and abs(r.expected_grade - sum(r.tails)) < 1e-9


def test_gradient():
    rng = np.random.default_rng(1)
    flat, size = rng.integers(0, 50, 40).astype(np.int32), np.array([10, 10, 20])
    grade, x = np.array([0, 1, 2]), np.zeros(Q.DIMENSIONS + 2)
    x[:50], x[-2:] = rng.normal(size=50), [-0.3, 0.2]
    _, g = Q._loss(x, grade, flat, size, 3)
    for i in (*range(0, 50, 7), Q.DIMENSIONS, Q.DIMENSIONS + 1):
        d = np.zeros(len(x))
        d[i] = 1e-5
        slope = (Q._loss(x + d, grade, flat, size, 3)[0] - Q._loss(x - d, grade, flat, size, 3)[0]) / 2e-5
        assert abs(slope - g[i]) < 1e-4


def test_nulls_long_texts_and_empty_tables(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "ok", "x"), (3, "word1 " * 50_000, "x")], "doc_id long, text string, grade string")
    got = Q.predict(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.expected_grade <= 2 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = Q.classify(docs, docs, none)
    assert kept.count() == 4 and Q.predict(docs.limit(0), model).count() == 0


def test_labels_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, Q.graded(docs, labels).collect())) == [(0, "a"), (1, "b")]


def test_nothing_is_rejected_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    for labels in ([], [(1, None, 0), (None, 1, 0)], [(99, 1, 0)]):
        got = Q.classify(docs, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 3 and all(r.keep for r in got)


def test_documents_whose_own_grade_is_best_are_kept(spark, monkeypatch):
    # P(best grade) of 0.55 and 0.45 for every text
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for p in (0.55, 0.45):
        at = float(np.log(1 / p - 1))
        monkeypatch.setattr(Q, "fit", lambda *a, **k: Q.OrdinalModel(np.zeros(Q.DIMENSIONS), np.array([at - 1, at])))
        (r,) = Q.classify(docs, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
        assert r.keep == (p > 0.5) == (r.grade == 2)


def test_matches_brute_force(spark, model):
    """Scores by definition from the model's weights, and a fit as good as that of many plain gradient steps."""
    rows = corpus(60)
    got = {r.doc_id: r for r in Q.predict(spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), model).collect()}
    for i, text, _ in rows:
        seen = set()
        for token in text.split():
            word = token.rstrip(Q._MARKS)
            seen.add(Q._feature(Q._SHAPE, (Q._shape(word) + token[len(word) :]).encode()))
            if word := word.lstrip(Q._MARKS).lower():
                seen |= {Q._feature(Q._WORD, word.encode()), Q._feature(Q._FIRST4, word[:4].encode()), Q._feature(Q._FIRST5, word[:5].encode())}
        tokens = text.split()
        seen.add(Q._feature(Q._REPEATS, b"%d" % round(10 * sum(a == b for a, b in zip(tokens, tokens[1:])) / len(tokens))))
        score = sum(float(np.float32(model.weights[f])) for f in seen) / len(seen) ** 0.25
        tails = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert np.allclose(got[i].tails, tails, atol=1e-6) and got[i].grade == sum(t >= 0.5 for t in tails)

    train, memo = corpus(), Q._Tokens()
    found = [Q.features(t, memo) for _, t, _ in train]
    grade, flat, size = np.array([g for _, _, g in train]), np.concatenate(found), np.array([len(f) for f in found])

    def loss(x):
        f, g = Q._loss(x, grade, flat, size, 3)
        g[: Q.DIMENSIONS] += 0.1 * x[: Q.DIMENSIONS]
        return f + 0.05 * x[: Q.DIMENSIONS] @ x[: Q.DIMENSIONS], g

    x = np.concatenate([np.zeros(Q.DIMENSIONS), [-1.0, 0.0]])
    for _ in range(300):
        x -= 0.02 * loss(x)[1]
    own = np.concatenate([model.weights, [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])]])
    assert loss(own)[0] <= 1.05 * loss(x)[0] and (model.gain < 1e-3 or model.steps == 20)


def test_shapes_are_whole():
    long_ = "a1" * 40
    assert Q._shape(long_ + "-") != Q._shape(long_) and Q._shape(long_ + "-b") != Q._shape(long_ + "-")
    memo = Q._Tokens()
    assert Q.features("word!!!!?", memo).tolist() != Q.features("word!!!!", memo).tolist()


def test_rows_that_repeat_an_id_don_t_exceed_the_sample(spark):
    docs = spark.createDataFrame([(i % 4, f"text {j}") for j in range(50) for i in range(8)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(9, 1, 0)], "doc_id long, quality int, toxic int")
    assert Q.graded(docs, labels, max_labelled=3).count() <= 3
    assert {r.text for r in Q.graded(docs, labels).collect()} == {"text 0", None}
