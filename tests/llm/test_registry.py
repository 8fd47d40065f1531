"""The columns of the registered queries on the smallest tables, each against a plain version of its contract."""

import base64
import hashlib
import os
import re

import pyarrow.parquet as pq
import pytest

from fieldloom.llm import decontaminate, exact_dedup, registry
from tests.llm.test_secrets import brute as secrets_of

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


def rows(name, *columns):
    return list(zip(*(pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns)).column(c).to_pylist() for c in columns)))


def found(spark, name, *columns):
    return sorted(map(tuple, registry.QUERIES[name](spark, DIR).select(*columns).collect()))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_secrets(spark):
    want = []
    for i, text in rows("documents", "doc_id", "text"):
        spans = secrets_of(text)
        line = lambda of: ",".join(f"{k}:{a}:{b}" for a, _, b, k in of)
        base = [s for s in spans if s[3] != "entropy"]
        want.append((i, *(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")), sha(line(base)), line(spans)))
    assert found(spark, "op1_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted(want)


def test_exact_dedup(spark):
    docs = rows("documents", "doc_id", "text")
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = [(i, min(g)[1], len(g), min(g)[1] == i, sha(n)) for n, g in groups.items() for _, i in g]
    assert found(spark, "op2_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want)


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.tokenizer_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows("documents", "doc_id", "text"):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(library.decode(ids, skip_special_tokens=False))))
    assert found(spark, "op4_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_suffix_dedup(spark):
    docs = [(i, (t or "").encode()) for i, t in rows("documents", "doc_id", "text")]
    window = lambda b, s: hashlib.blake2b(b[s : s + 400], digest_size=16).digest()
    count = {}
    for _, b in docs:
        for s in range(len(b) - 399):
            w = window(b, s)
            count[w] = count.get(w, 0) + 1
    want = []
    for i, b in docs:
        gone, runs, at = [], 0, -1
        for s in range(len(b) - 399):
            if count[window(b, s)] > 1:
                runs += s > at
                gone += range(max(s, at), s + 400)
                at = s + 400
        kept = set(range(len(b))).difference(gone)
        want.append((i, len(b), len(gone), runs, sha(bytes(b[x] for x in sorted(kept)))))
    assert found(spark, "op5_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_archives(spark):
    pages = [(i, (h or "").encode()) for i, h in rows("pages", "page_id", "html")]
    top = {}
    for i, h in pages:
        top[h] = max(top.get(h, i), i)
    want = [(i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if top[h] == i else "revisit", None if top[h] == i else top[h]) for i, h in pages]
    got = sorted(map(tuple, registry.QUERIES["op6_warc"](spark, DIR).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == sorted(want, key=str)


def test_decontamination(spark):
    want = decontaminate.brute_force(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"))
    assert found(spark, "op8_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want)


def test_proximity(spark):
    want = [(i, len(near), sha(",".join(near))) for i, near in decontaminate.brute_near(rows("documents", "doc_id", "text"), rows("benchmark", "item_id", "text"), 10, 19)]
    assert found(spark, "op8_benchmark_decontamination", "doc_id", "n_near_items", "near_items_sha256") == sorted(want)


def test_held_out_language(spark):
    lang = dict(rows("documents", "doc_id", "lang"))
    got = registry.QUERIES["op7_language"](spark, DIR).collect()
    assert len(got) == len(lang)
    test = [r for r in got if r.held_out and r.lang_pred != "und" and lang[r.doc_id] is not None]
    assert test and sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.95


def test_oracle_of_exact_dedup_is_registered():
    assert registry.ORACLES["op2_exact_dedup"] == exact_dedup.ORACLE
