import hashlib
import random

import pytest

from fieldloom.llm import fim


def brute(doc_id, text, plain_from=90, spm_below=20):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    i, j = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in fim.MARKS) or h[2] % 100 >= plain_from:
        return doc_id, len(t), "plain", None, None, t
    pre, mid, suf = t[:i], t[i:j], t[j:]
    spm = h[3] % 100 < spm_below
    return doc_id, len(t), "spm" if spm else "psm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def corpus():
    rng = random.Random(12)
    signs = "ab é\n\t<>PSM/\u0301\U0001f600\u0000語\r"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.choice((1, 2, 5, 63, 64, 65, 127, 128, 129, 500))))) for i in range(300)]
    return rows + [(900, None), (901, ""), (902, "a<P>b"), (903, "<M>"), (904, "<<S<P"), (905, "é" * 3_000_000), (None, "no id"), (None, "no id"), (5, "again"), (-7, "below"), (2**62, "large")]


def test_matches_brute_force_and_restores(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, output string, n int, batch string").repartition(5)
    found = fim.fill_in_middle(df)
    got = found.select("*", fim.restored(found.form, found.output).alias("back")).collect()
    plain = lambda r: (str(r[0]), r[5])
    assert sorted((tuple(r)[:6] for r in got), key=plain) == sorted((brute(i, t) for i, t in rows), key=plain)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_shares_and_parameters(spark):
    df = spark.range(4000).selectExpr("id as key", "concat('some text ', id) as body")
    forms = dict(fim.fill_in_middle(df, "key", "body").groupBy("form").count().collect())
    assert abs(forms["plain"] / 4000 - 0.1) < 0.03 and abs(forms["spm"] / (forms["spm"] + forms["psm"]) - 0.2) < 0.03
    marks = ("it's|", "{s}", "[m]")
    every = fim.fill_in_middle(df, "key", "body", marks=marks, plain_from=100, spm_below=50)
    back = every.select("form", fim.restored(every.form, every.output, marks).alias("t"), "doc_id")
    assert back.filter("t <> concat('some text ', doc_id) or form = 'plain'").isEmpty()


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("marks", [("a", "ab", "c"), ("", "b", "c"), ("ab", "bc", "d"), ("a", "a", "b"), ("aba", "x", "y")])
def test_marks_that_run_together(marks):
    with pytest.raises(ValueError):
        fim.check_marks(marks)
