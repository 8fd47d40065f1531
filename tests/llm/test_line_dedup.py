import random
from collections import Counter

import pytest

from fieldloom.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, k=2):
    """{(doc_id, line_no): (class as a set of lines, links, kept)} for distinct ids."""
    every = [(i, n, x.strip(" \t\r\f")) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f")]
    distinct = sorted({x for _, _, x in every})
    near = {x: [y for y in distinct if y != x and min(len(x), len(y)) >= L.LEAST_CHARS and abs(len(x) - len(y)) <= k and distance(x, y) <= k] for x in distinct}
    seen, classes = {}, []
    for x in distinct:
        if x not in seen:
            todo, members = [x], set()
            while todo:
                y = todo.pop()
                if y not in members:
                    members.add(y)
                    todo += near[y]
            classes.append(frozenset(members))
            for y in members:
                seen[y] = classes[-1]
    first = {}
    for i, n, x in every:
        at = (i is None, i or 0, n)
        first[seen[x]] = min(first.get(seen[x], at), at)
    return {(i, n): (seen[x], len(near[x]), first[seen[x]] == (i is None, i or 0, n)) for i, n, x in every}


def corpus():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdéf ") for _ in range(n)).strip() + "z" for n in (24, 25, 26, 40, 80, 200, 30, 30)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(x))
                op = rng.randint(0, 2)
                if op == 0:
                    x[p] = rng.choice("xyz")
                elif op == 1:
                    del x[p]
                else:
                    x.insert(p, rng.choice("xyü"))
            lines.append("".join(x))
        rows.append((d, "\n".join(lines + [""] * rng.randint(0, 2) + ["short"])))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, " \t" + base[4] + "\r\n" + base[4]), (None, base[5]), (104, "w" * 50_000), (105, "w" * 50_001)]


@pytest.mark.parametrize("k", [1, 2])
def test_matches_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, line string, lid int")
    got = L.line_dedup(df, k=k).cache()
    by_line = {(r.doc_id, r.line_no): r for r in got.collect() if r.line_no is not None}
    want = brute(rows[:-2], k)
    long_ = {key: by_line.pop(key) for key in ((104, 0), (105, 0))}
    assert long_[104, 0].kept and not long_[105, 0].kept and long_[104, 0].n_links == 1
    assert {key: (r.n_links, r.kept) for key, r in by_line.items()} == {key: w[1:] for key, w in want.items()}
    assert len({(by_line[key].class_id, w[0]) for key, w in want.items()}) == len({w[0] for w in want.values()}) == len({r.class_id for r in by_line.values()})
    docs = {r.doc_id: r for r in L.by_document(got).collect()}
    assert len(docs) == len(rows) and docs[100].n_lines == docs[101].n_lines == 0
    assert docs[103].removed in ([1], [0, 1]) and docs[103].n_removed == len(docs[103].removed)


def test_repeated_rows_and_empty(spark):
    schema = "doc_id long, text string"
    got = L.line_dedup(spark.createDataFrame([(1, "same line"), (1, "same line")], schema)).collect()
    assert sorted(r.kept for r in got) == [False, True]
    assert L.by_document(L.line_dedup(spark.createDataFrame([], schema))).count() == 0


@pytest.mark.parametrize("k", [1, 2])
def test_short_lines_have_near_duplicates(spark, k):
    rng = random.Random(1)
    lines = ["All rights reserved.", "All rights reserved", "a", "b", "ab", "ba", "abc"]
    lines += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 23))) for _ in range(150)]
    lines += [x[:-1] + "é" for x in lines[20:60]] + [x + "zz" for x in lines[60:80]]
    lines = sorted(set(lines))
    near = {x: [y for y in lines if y != x and min(len(x), len(y)) > k and distance(x, y) <= k] for x in lines}
    got = L.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), k=k).collect()
    assert {lines[r.doc_id]: r.n_links for r in got} == {x: len(y) for x, y in near.items()}
    of = {lines[r.doc_id]: r.class_id for r in got}
    assert of["All rights reserved."] == of["All rights reserved"] and of["a"] != of["b"]
    assert all(of[x] == of[y] for x in lines for y in near[x])


def two_edits(numbers):
    """Pairs of different numbers of equal length within two edits: those that agree after a deletion of two signs each."""
    by_rest, pairs = {}, set()
    for x in set(numbers):
        for rest in {x[:i] + x[i + 1 : j] + x[j + 1 :] for i in range(len(x)) for j in range(i + 1, len(x))}:
            by_rest.setdefault(rest, []).append(x)
    for same in by_rest.values():
        pairs.update((x, y) for x in same for y in same if x < y and distance(x, y) <= 2)
    return pairs


@pytest.mark.parametrize("k, most", [(1, 0), (2, 0), (2, 20), (3, 40)])
def test_hot_keys_are_split_further(spark, k, most):
    rng = random.Random(k)
    head, tail = "the head of a template ", " and its tail, é."
    lines = [head + "".join(rng.choice("01é") for _ in range(rng.randint(0, 5))) + tail for _ in range(60)]
    lines += [rng.choice(["", "x", "xy"]) + head + tail[: rng.randint(0, 9)] + str(rng.randint(0, 99)) for _ in range(30)]
    lines += ["ab" * 8 + "c" * i for i in range(6)] + ["a" * i for i in range(k + 1, 12)] + ["X" + "ab" * 4, "ab" * 2 + "X" + "ab" * 2, "ab" * 4 + "X"]
    lines = sorted(set(x.strip() for x in lines))
    near = {(y, x) for x in range(len(lines)) for y in range(x) if min(len(lines[x]), len(lines[y])) > k and distance(lines[x], lines[y]) <= k}
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "lid long, line string, len int")
    got = L.line_links(df, k, pairs_at_most=most).collect()
    assert {(r.a, r.b) for r in got} == near and len(got) == len(near)


def test_many_variants_of_a_template(spark):
    # All lines share both outer segments; few are within two edits of each other.
    n, rng = 20_000, random.Random(4)
    numbers = [f"{rng.randrange(10**10):010d}" for _ in range(n)]
    numbers += [x[:3] + ("1" if x[3] == "0" else "0") + x[4:] for x in numbers[:50]]
    lines = [f"GET /index/page/of/the/site request {x} was done in time" for x in numbers]
    got = L.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    links = {r.doc_id: r.n_links for r in got.collect()}
    first = {x: i for i, x in reversed(list(enumerate(lines)))}
    near = Counter()
    for pair in two_edits(numbers):
        near.update(pair)
    assert all(links[i] == near[numbers[i]] for i in first.values()) and all(links[i] >= 1 and links[n + i] >= 1 for i in range(50))


def test_signatures_are_for_lines_that_somebody_may_meet(spark, monkeypatch):
    from fieldloom.llm import line_dedup as module

    plans, stored = {}, module.stored

    def kept(df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name, *more)

    monkeypatch.setattr(module, "stored", kept)
    lines = spark.createDataFrame([(1, "a first line of text"), (2, "a first line of texts"), (3, "nothing like the others")], "lid long, line string").selectExpr("*", "length(line) len")
    assert [tuple(r) for r in module.line_links(lines, 2).collect()] == [(1, 2, 1)]
    plan = plans["live_lines"]
    assert "aggregate(" in plan and plan.index("aggregate(") < plan.index("Join") and "aggregate(" not in plan[plan.index("Join") :]
