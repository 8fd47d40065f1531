import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import url_filter as U

URLS = [
    ("http://Example.NET/en/1?x", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://a.b.example.net/fr/1#t", "a.b.example.net", "/fr/1", "net/", "block"),
    ("https://notexample.net", "notexample.net", "", None, None),
    ("https://xnet/", "xnet", "/", None, None),
    ("x://net/", "net", "/", "net/", "block"),
    ("https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
    ("https://www.example.com/de", "www.example.com", "/de", None, None),
    ("https://example.org/fr/a/b?c#d", "example.org", "/fr/a/b", "org/fr/", "allow"),
    ("https://example.org/FR/a", "example.org", "/FR/a", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("http://h\nost.net/p\nq#r", "h\nost.net", "/p\nq", "net/", "block"),
    ("http://ÄB.org?q=http://z/", "Äb.org", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("http://example.net:80/en/", "example.net:80", "/en/", None, None),
]


def test_urls_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "x", 0.5) for i, u in enumerate(URLS)], "page_id long, url string, site string, bound double")
    none = spark.createDataFrame([], "doc_id long, bad boolean")
    got = sorted(map(tuple, U.url_filter(df, none).select("page_id", "host", "path", "rule", "verdict").collect()))
    # Without labels every bound is the prior's, of mean one half and the greatest strength: over the limit.
    assert got == [(i, h, p, r, v or "block") for i, (_, h, p, r, v) in enumerate(URLS)]


def test_longest_rule_wins(spark):
    rules = (("block", "c", "/"), ("allow", "b.c", "/"), ("block", "b.c", "/x"), ("allow", "c", "/x/yy"))
    df = spark.createDataFrame([("b.c", "/x/yy"), ("b.c", "/x"), ("a.b.c", "/q"), ("c", "/q"), ("d", "/")], "h string, p string")
    rule, verdict = U.rule_of(F.col("h"), F.col("p"), rules)
    assert [tuple(r) for r in df.select(rule, verdict).collect()] == [("c/x/yy", "allow"), ("b.c/x", "block"), ("b.c/", "allow"), ("c/", "block"), (None, None)]


def test_sites(spark):
    hosts = ["www.a.co.uk", "co.uk", "a.b.com", "com", "me@x.a.com:80", "1.2.3.4:5", "[::1]:80", "a.com.", "a.com.:80", "", "x..y"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(*U.site_of(F.col("h"))).collect()]
    assert got == [("www.a.co.uk", "a.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.b.com", "b.com", "com"), ("com", "com", "com"), ("x.a.com", "a.com", "com"), ("1.2.3.4", "1.2.3.4", "1.2.3.4"), ("[::1]",) * 3, ("a.com", "a.com", "com"), ("a.com", "a.com", "com"), ("", "", ""), ("x..y", ".y", "y")]


@pytest.mark.parametrize("a, b", [(1, 1), (3, 9), (0.4, 6), (20, 60), (900, 2500), (12, 0.7)])
def test_bound_is_near_the_exact_quantile(spark, a, b):
    x = (np.arange(400_000) + 0.5) / 400_000
    logs = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    density = np.exp(logs - logs.max())
    exact = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.05)]
    got = spark.range(1).select(U.lower_bound(f"{a}D", f"{b}D", 0.95)).first()[0]
    assert abs(got - exact) < 0.02 + 0.03 * exact


def plain_reputations(pages, bad):
    """{site: (pages, n, k, prior mean, bound's alpha, beta)} by loops, for sites of plain names."""
    count, n, k = Counter(), Counter(), Counter()
    for i, u in pages:
        host = re.match(r"(?s)(?:.*?://([^/?#]*))?", u or "").group(1) or ""
        site = re.sub(r":\d*$", "", host.lower())
        count[site] += 1
        if i in bad:
            n[site] += 1
            k[site] += bad[i]
    levels = [lambda s: s.split(".")[-1], lambda s: ".".join(s.split(".")[-2:]), lambda s: s]
    total = sum(n.values())
    above = {s: (sum(k.values()) / total if total else 0.5) for s in count}
    for level in levels:
        gn, gk, mean = Counter(), Counter(), {}
        for s in count:
            gn[level(s)] += n[s]
            gk[level(s)] += k[s]
            mean[level(s)] = above[s]
        pq = {g: mean[g] * (1 - mean[g]) for g in mean}
        pairs = sum(gn[g] * (gn[g] - 1) * pq[g] for g in mean)
        r = sum((gk[g] - gn[g] * mean[g]) ** 2 - gn[g] * pq[g] for g in mean) / pairs if pairs else 0
        m = min(max(1 / r - 1, 0.5), 10_000) if r > 0 else 10_000
        prior, above = above, {s: (m * mean[level(s)] + gk[level(s)]) / (m + gn[level(s)]) for s in count}
    return {s: (count[s], n[s], k[s], prior[s], m * prior[s] + k[s], m * (1 - prior[s]) + n[s] - k[s]) for s in count}


def labelled():
    rng = np.random.default_rng(13)
    pages, bad = [], {}
    rates = {"good.com": 0.05, "spam.com": 0.9, "mixed.org": 0.3}
    for i in range(3000):
        domain = list(rates)[int(rng.integers(3))] if i % 3 else "spam.com"
        pages.append((i, f"http://h{int(rng.integers(5)) if i % 3 else 0}.{domain}/p{i}"))
        if rng.random() < 0.4:
            bad[i] = int(rng.random() < rates[domain])
    return pages + [(5000, "http://new.spam.com/"), (5001, "http://new.good.com/"), (5002, None), (None, "http://h0.good.com/")], bad


def test_reputations_match_loops_and_block_bad_hosts(spark):
    pages, bad = labelled()
    df = spark.createDataFrame(pages, "page_id long, url string")
    known = spark.createDataFrame([(i, bool(b)) for i, b in bad.items()] + [(None, True), (9, None)], "doc_id long, bad boolean")
    got = {r.site: tuple(r)[1:7] for r in U.reputations(df, known).collect()}
    want = plain_reputations(pages, bad)
    assert got.keys() == want.keys()
    for s, w in want.items():
        assert got[s] == pytest.approx(w)
    verdict = {r.host: r.verdict for r in U.url_filter(df, known, rules=()).collect()}
    assert {v for h, v in verdict.items() if h.endswith("spam.com")} == {"block"}, "also the host without labels"
    assert {v for h, v in verdict.items() if h.endswith("good.com")} == {"allow"}


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (1, "http://b.com/")], "page_id long, url string")
    known = spark.createDataFrame([(1, False), (1, True)], "doc_id long, bad boolean")
    assert {r.site: (r.pages, r.n_labelled, r.n_bad) for r in U.reputations(df, known).collect()} == {"a.com": (2, 2, 2), "b.com": (1, 1, 1)}
    assert U.url_filter(df.limit(0), known).collect() == []
