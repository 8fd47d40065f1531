"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a row is a shard of some thousand documents and holds its vocabulary and, for
each term, the ascending token positions at which it stands. Documents follow each other with a gap of positions, so
no phrase crosses them. A search takes each phrase's rarest term in the shard and intersects the offset-adjusted
lists of the others, next rarest first. Neither building nor searching shuffles, and a lost shard is recomputed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, on UTF-8 bytes: digits, a-z and all bytes from 0x80 on.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX_SCHEMA = "shard string, doc_ids binary, nulls binary, starts binary, n_words binary, vocabulary binary, offsets binary, positions binary"


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class _Numbering(dict):
    """Numbers terms from 0 on in order of first look-up."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _shard(doc_ids: list[int | None], texts: list[bytes | None], gap: int) -> dict:
    number, ids, starts, counts, at = _Numbering(), [], [], [], 0
    for text in texts:
        found = words(text)
        ids.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        starts.append(at)
        counts.append(len(found))
        at += len(found) + gap
    n_words, starts = np.array(counts, np.int64), np.array(starts, np.int64)
    terms = np.concatenate(ids) if ids else np.empty(0, np.int32)
    places = np.arange(len(terms), dtype=np.int64) + np.repeat(starts - (np.cumsum(n_words) - n_words), n_words)
    order = np.argsort(terms, kind="stable")
    sizes = np.bincount(terms, minlength=len(number))
    return {
        "doc_ids": np.array([0 if x is None else x for x in doc_ids], np.int64).tobytes(),
        "nulls": np.array([x is None for x in doc_ids], bool).tobytes(),
        "starts": starts.tobytes(),
        "n_words": n_words.tobytes(),
        "vocabulary": b" ".join(number),
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes(),
        "positions": places[order].astype(np.int32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words_per_shard: int = 1_000_000, gap: int = 64) -> DataFrame:
    """The positional index of docs, a row a shard of at most about words_per_shard words and at least a document.

    Null and empty texts have no words but stay known to the index. Null ids are marked. Rows that repeat an id are
    separate documents. A shard's name is unique, but another one when the shard is computed anew. An empty table gives an empty index.
    """
    most_bytes = words_per_shard * 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            row = _shard(doc_ids, texts, gap)
            return pa.RecordBatch.from_pylist([{"shard": uuid4().hex} | row], schema=schema)

        schema = pa.schema([("shard", pa.string()), *((c, pa.binary()) for c in ("doc_ids", "nulls", "starts", "n_words", "vocabulary", "offsets", "positions"))])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1] or b"")
                if held >= most_bytes or len(texts) >= 20_000:
                    yield flush()
                    doc_ids, texts, held = [], [], 0
        if doc_ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(build, INDEX_SCHEMA)


def phrases_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", *, n: int = 10) -> DataFrame:
    """(item_id string, phrase array<binary>): each n consecutive words of an item, or all words of a shorter item.

    Null texts and texts without words give no phrase.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_id, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                for i in range(max(1, len(w) - n + 1) if w else 0):
                    out_id.append(item)
                    out.append(w[i : i + n])
            yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.string()), pa.array(out, pa.list_(pa.binary()))], ["item_id", "phrase"])

    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_id string, phrase array<binary>").distinct()


class ShardIndex:
    """Search in one shard."""

    def __init__(self, row: dict):
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.starts = np.frombuffer(row["starts"], np.int64)
        self.n_words = np.frombuffer(row["n_words"], np.int64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.positions = np.frombuffer(row["positions"], np.int32)
        vocabulary = row["vocabulary"].split(b" ") if row["vocabulary"] else []
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.span = int(self.starts[-1] + self.n_words[-1] + 1) if len(self.starts) else 1
        # Term and position in one ascending key: a list membership test is one binary search.
        self.keys = np.repeat(np.arange(len(vocabulary), dtype=np.int64) * self.span, np.diff(self.offsets)) + self.positions

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        key = terms * self.span + places
        at = np.searchsorted(self.keys, key)
        return (places >= 0) & (places < self.span) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def phrases(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, start position) of every exact occurrence. terms: phrases of one length, -1 for unknown terms."""
        known = np.flatnonzero((terms >= 0).all(axis=1)) if len(self.keys) else np.empty(0, np.int64)
        if not len(known):
            return known, known
        terms = terms[known]
        size = np.diff(self.offsets)[terms]
        order = np.argsort(size, axis=1, kind="stable")  # rarest first
        rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
        n = np.diff(self.offsets)[rarest]
        which = np.repeat(np.arange(len(terms)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(self.offsets[rarest], n) + inner].astype(np.int64) - order[which, 0]
        for k in range(1, terms.shape[1]):
            o = order[which, k]
            there = self.has(terms[which, o], start + o)
            which, start = which[there], start[there]
            if not len(which):
                break
        return known[which], start

    def near(self, terms: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, document) wherever all terms of a phrase stand, in any order, at most ``within`` words apart.

        Around each place of the rarest term the others must stand, next rarest first; then their places there, as bits,
        must fit a stretch of within + 1 words. within is below the gap, so no stretch crosses documents.
        """
        known = np.flatnonzero((terms >= 0).all(axis=1)) if len(self.keys) else np.empty(0, np.int64)
        if not len(known):
            return known, known
        terms = terms[known]
        order = np.argsort(np.diff(self.offsets)[terms], axis=1, kind="stable")
        terms = np.take_along_axis(terms, order, 1)  # rarest first
        n = np.diff(self.offsets)[terms[:, 0]]
        which = np.repeat(np.arange(len(terms)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.positions[np.repeat(self.offsets[terms[:, 0]], n) + inner].astype(np.int64)
        for k in range(1, terms.shape[1]):
            t = terms[which, k] * self.span
            i = np.searchsorted(self.keys, t + np.maximum(at - within, 0))
            there = (i < len(self.keys)) & (self.keys[np.minimum(i, len(self.keys) - 1)] <= t + np.minimum(at + within, self.span - 1))
            which, at = which[there], at[there]
        found = []
        full = np.uint64((1 << within + 1) - 1)
        for c in range(0, len(which), 50_000):
            w, p = which[c : c + 50_000], at[c : c + 50_000]
            fits = np.full((within + 1, len(w)), True)
            for k in range(terms.shape[1]):
                bits = np.zeros(len(w), np.uint64)
                for d in range(2 * within + 1):
                    bits |= self.has(terms[w, k], p + (d - within)).astype(np.uint64) << np.uint64(d)
                for s in range(within + 1):
                    fits[s] &= (bits >> np.uint64(s)) & full != 0
            ok = fits.any(axis=0)
            doc = np.searchsorted(self.starts, p[ok], "right") - 1
            found.append(np.unique(np.stack([known[w[ok]], doc]), axis=1))
        pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pairs[0], pairs[1]


def _numbered(phrases: list[list[bytes]], index: ShardIndex) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        by_length.setdefault(len(p), []).append(i)
    for group in by_length.values():
        yield np.array(group), np.array([[index.number.get(t, -1) for t in phrases[i]] for i in group], np.int64)


def search(index: DataFrame, phrases: DataFrame, *, block: int = 200_000, block_bytes: int = 32 << 20, within: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>, exact array<string>) for every document of the index.

    n_hit counts the words inside an occurrence of a phrase; exact are the sorted ids of items with an occurrence. items
    are the same, and with ``within`` also those with a proximity match: all words of a phrase stand in a stretch of
    within + 1 words of the document, in any order. Phrases are a stated query set: they are sent to the shards in blocks
    of about ``block`` rows and ``block_bytes`` bytes at most, each block a pass over the index, so no broadcast grows
    beyond that.
    """
    if within is not None and not 0 <= within <= 31:
        raise ValueError("within is at most 31")
    spark = index.sparkSession
    held = stored(phrases, "phrases")
    size = held.agg(F.count("*"), F.sum(F.octet_length(F.array_join(F.col("phrase").cast("array<string>"), " ")))).first()
    blocks = max(1, -(-size[0] // block), -(-(size[1] or 0) // block_bytes))
    if blocks > 1 and getattr(index, "_stored_at", None) is None:
        index = stored(index, "postings")  # blocks meet by the names of shards
    parts = []
    for b in range(blocks):
        part = held.filter(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(blocks)) == b).select("item_id", "phrase").collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in part], [[bytes(t) for t in r[1]] for r in part]))
        parts.append(index.mapInArrow(_searcher(sent, within), "shard string, doc long, doc_id long, n_words long, hits array<long>, items array<string>, exact array<string>"))
    if blocks == 1:
        return parts[0].select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "exact")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "exact")]
    merged = every.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)
    return merged.select("doc_id", "n_words", F.size(F.array_distinct("hits")).cast("long").alias("n_hit"), *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "exact")))


def _searcher(sent, within: int | None):
    def named(index: ShardIndex, items: list, doc: np.ndarray, who: np.ndarray) -> list[list[str]]:
        """The sorted items whose phrases ``who`` were found in documents ``doc``."""
        found: list[list[str]] = [[] for _ in range(len(index.doc_ids))]
        for d, ps in zip(*_split(doc, who)):
            found[d] = sorted({items[p] for p in ps if items[p] is not None})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, phrases = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                index = ShardIndex(row)
                starts, lengths, whose, near_doc, near_whose = [], [], [], [], []
                for group, terms in _numbered(phrases, index):
                    which, at = index.phrases(terms)
                    starts.append(at)
                    lengths.append(np.full(len(at), terms.shape[1]))
                    whose.append(group[which])
                    if within is not None:
                        which, doc = index.near(terms, within)
                        near_doc.append(doc)
                        near_whose.append(group[which])
                n_docs = len(index.doc_ids)
                hits: list[np.ndarray] = [np.empty(0, np.int64)] * n_docs
                exact: list[list[str]] = [[] for _ in range(n_docs)]
                if starts and sum(map(len, starts)):
                    at, n, who = (np.concatenate(x) for x in (starts, lengths, whose))
                    covered = np.zeros(index.span + 1, np.int64)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + n, -1)
                    covered = np.flatnonzero(np.cumsum(covered) > 0)
                    doc = np.searchsorted(index.starts, covered, "right") - 1
                    for d, places in zip(*_split(doc, covered)):
                        hits[d] = places - index.starts[d]
                    exact = named(index, items, np.searchsorted(index.starts, at, "right") - 1, who)
                both = exact
                if near_doc and sum(map(len, near_doc)):
                    near = named(index, items, np.concatenate(near_doc), np.concatenate(near_whose))
                    both = [sorted({*a, *b}) if b else a for a, b in zip(exact, near)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n_docs, pa.string()), pa.array(range(n_docs), pa.int64()), pa.array(index.doc_ids, mask=index.nulls), pa.array(index.n_words), pa.array(hits, pa.list_(pa.int64())), pa.array(both, pa.list_(pa.string())), pa.array(exact, pa.list_(pa.string()))],
                    ["shard", "doc", "doc_id", "n_words", "hits", "items", "exact"],
                )

    return run


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    unique, first = np.unique(keys[order], return_index=True)
    return unique, np.split(values[order], first[1:])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 10, within: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, items_sha256, contaminated) for each row of docs, and with ``within`` near_items: items with an exact or a proximity match.

    Null and repeated ids pass through; each row is a document. Documents without words have n_hit 0. Without benchmark phrases nothing is hit.
    Columns other than id and text are ignored. An empty table gives an empty result.
    """
    found = search(stored(build_index(docs, id_col, text_col), "postings"), phrases_of(benchmark, n=n), within=within)
    near = [F.col("items").alias("near_items")] if within is not None else []
    found = found.select("doc_id", "n_words", "n_hit", F.col("exact").alias("items"), *near)
    return found.withColumns({"items_sha256": F.sha2(F.concat_ws(",", "items"), 256), "contaminated": F.col("n_hit") > 0})


def brute_force(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    """The same by definition, for tests: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    windows = [(i, tuple(w[k : k + n])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - n + 1))]
    out = []
    for doc_id, text in docs:
        w = split(text)
        hit, whose = set(), set()
        for i, p in windows:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    whose.add(str(i))
        out.append((doc_id, len(w), len(hit), len(whose), sha256(",".join(sorted(whose)).encode()).hexdigest(), bool(hit)))
    return out


def brute_near(docs: list[tuple], items: list[tuple], n: int, within: int) -> list[tuple]:
    """Proximity matches by definition, for tests: (doc_id, sorted ids of items)."""
    out = []
    cut = [(str(i), [set(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []) for i, t in items for w in [words((t or "").encode())]]
    for doc_id, text in docs:
        w = words((text or "").encode())
        stretches = [set(w[k : k + within + 1]) for k in range(len(w))]
        out.append((doc_id, sorted({i for i, phrases in cut if any(p <= s for p in phrases for s in stretches)})))
    return out
