"""Removal of byte strings that repeat anywhere in the corpus, by sorting sampled suffixes.

Every window of ``length`` bytes holds a suffix that its content alone picks: the one whose leading ``length // 2`` bytes
hash lowest (the leftmost of equals). Equal windows pick it at the same offset, so only these suffixes, about one in
a hundred, are compared. Suffixes whose leading bytes stand nowhere else are done. Equal surroundings, by 128 bits of
two independent fingerprints, collapse to one row, and all their windows repeat. What is left, where repeats begin and end, is
range-partitioned by the leading bytes, with splitters that Spark samples; equal leading bytes never cross a boundary.
Each partition sorts its suffixes, and the reversed bytes to their left, by multikey quicksort. What neighbours share
bounds the windows that can repeat; those are found by fingerprints and compared byte by byte. Groups too large for
a task are settled by shuffling two fingerprints of each window.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flag_in, id_filter, maybe_in, skew_lookup, stored

U = np.uint64
_POSITION_BITS = 24
_CHUNK = 1 << 23  # bytes of a text that are worked on at once
_SECOND = 0xD6E8FEB86659FD93, 4  # base and seed of a second, independent fingerprint
_GROUP_AT_MOST = 50_000  # surroundings of one group that a task compares


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Fingerprints of any substring from prefix sums modulo 2**64."""

    def __init__(self, odd: int = 0x9E3779B97F4A7C15, seed: int = 3):
        self.value = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
        self.base, self.inverse = U(odd), U(pow(odd, -1, 2**64))
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(n - 1, b, U)]), dtype=U) for b in (self.base, self.inverse))
        return self.up, self.down

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Along the last axis; one longer than data."""
        up, _ = self.powers(data.shape[-1] + 1)
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), U)
        np.cumsum(self.value[data] * up[: data.shape[-1]], axis=-1, out=out[..., 1:])
        return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(x)
    a = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    a[:n] = x
    a = a.reshape(-1, width)
    before = np.minimum.accumulate(a, axis=1).ravel()
    after = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def picked(data: np.ndarray, length: int, roll: Roller, other: Roller) -> tuple[np.ndarray, ...]:
    """(lead, around, around2, at, lo, hi): suffixes at ``at`` that the windows starting at lo..hi pick.

    lead is the fingerprint of the suffix's leading bytes, around and around2 are independent ones of data[lo : hi + length]
    and its offsets.
    """
    half, parts = length // 2, []
    for start in range(0, max(1, len(data) - length + 1), _CHUNK):
        b = data[start : start + _CHUNK + length - 1]
        if len(b) < length:
            break
        s, n = roll.sums(b), len(b)
        _, down = roll.powers(n + 1)
        lead = _mix((s[half:] - s[:-half]) * down[: n - half + 1])
        m = _least((lead >> U(_POSITION_BITS) << U(_POSITION_BITS)) | np.arange(len(lead), dtype=U), length - half + 1)
        lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        hi = np.concatenate([lo[1:], [len(m)]]) - 1
        at = (m[lo] & U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        place = _mix((at - lo).astype(U) * U(4096) + (hi - lo).astype(U))
        around = [_mix(_mix((x[hi + length] - x[lo]) * y[lo]) + place) for x, y in ((s, down), (other.sums(b), other.powers(n + 1)[1]))]
        parts.append((lead[at], *around, at + start, lo + start, hi + start))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (*[np.empty(0, U)] * 3, *[np.empty(0, np.int64)] * 3)


def _sample(rows: DataFrame, length: int) -> DataFrame:
    """The suffixes that rows (k1, k2, w, text) pick."""
    names = ["k1", "k2", "w", "lead", "around", "around2", "at", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, other = Roller(), Roller(*_SECOND)
        for batch in batches:
            held, n = [], 0
            for i, text in enumerate(batch.column(3)):
                found = picked(np.frombuffer(text.as_buffer(), np.uint8), length, roll, other)
                if len(found[0]):
                    held.append((np.full(len(found[0]), i), *found))
                    n += len(found[0])
                if n > 200_000:
                    yield out(batch, held)
                    held, n = [], 0
            if held:
                yield out(batch, held)

    def out(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        i, *found = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(i)) for c in range(3)), *(pa.array(x.view(np.int64)) for x in found)], names)

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _weighted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (k1, k2, doc_id, text) with w, one for each (k1, k2), w of which there are; and (k, n) of those that repeat, if any do."""
    twice = stored(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "repeated_rows")
    many = twice.count()
    if not many:
        return rows.withColumn("w", F.lit(1).cast("long")), None
    pages, slot = id_filter(twice.select("k1"), many)
    flagged = flag_in(rows, F.col("k1"), pages, slot)
    one = flagged.filter("found").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("w"))
    return flagged.filter("not found").drop("found").withColumn("w", F.lit(1).cast("long")).unionByName(one), twice.select(F.struct("k1", "k2").alias("k"), "n")


def _cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(lead, n, k1, k2, at, before, data): the bytes around each wanted suffix, ``before`` of them left of it."""
    n_rows = wanted.select("k1").distinct()
    pages, slot = id_filter(n_rows, n_rows.count())
    each = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("lead", "n", "at", "lo", "hi")).alias("w"))
    both = maybe_in(rows.select("k1", "k2", "text"), F.col("k1"), pages, slot).join(each, ["k1", "k2"])
    return both.select("k1", "k2", "text", F.explode("w").alias("w")).select("w.lead", "w.n", "k1", "k2", "w.at", (F.col("w.at") - F.col("w.lo")).cast("int").alias("before"), F.expr(f"substring(text, cast(w.lo + 1 as int), cast(w.hi - w.lo + {length} as int))").alias("data"))


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), np.uint8).reshape(len(parts), width)


def multikey_order(m: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of words: a three-way quicksort by one word, the equal part by the next word."""
    out, todo = [], [(np.arange(len(m)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == m.shape[1]:
            out.append(rows)
        elif len(rows) < 24:
            out.append(np.array(sorted(rows.tolist(), key=lambda i: m[i, depth:].tolist())))
        else:
            x = m[rows, depth]
            pivot = np.sort(x[[0, len(x) // 2, -1]])[1]
            low, high = x < pivot, x > pivot
            todo += [(rows[high], depth), (rows[~(low | high)], depth + 1), (rows[low], depth)]  # the last comes first
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _common(group: np.ndarray, parts: list[bytes], width: int) -> np.ndarray:
    """For each part the longest common prefix with another part of its group, -1 if there is none: sort, then look at both neighbours."""
    m = _matrix(parts, -(-width // 8) * 8)
    order = multikey_order(np.concatenate([group[:, None].astype(U), m.view(">u8").astype(U)], axis=1))
    m, group = m[order], group[order]
    differ = m[1:] != m[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    same = np.where(group[1:] == group[:-1], np.minimum(same, width), -1)
    best = np.full(len(parts), -1)
    best[order[1:]] = same
    best[order[:-1]] = np.maximum(best[order[:-1]], same)
    return best


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which = np.repeat(np.arange(len(first)), count)
    return which, first[which] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _fingerprints(lead: np.ndarray, data: list[bytes], which: np.ndarray, start: np.ndarray, before: np.ndarray, length: int, roll: Roller) -> np.ndarray:
    """Of the windows data[which][start : start + length], bound to their group and their place in it."""
    width = 2 * length
    out = np.empty(len(which), U)
    edges = np.searchsorted(which, np.arange(0, len(data) + 2048, 2048))
    for c, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            s = roll.sums(_matrix(data[c * 2048 : (c + 1) * 2048], width))
            w, st = which[a:b] - c * 2048, start[a:b]
            out[a:b] = (s[w, st + length] - s[w, st]) * roll.powers(width + 1)[1][st]
    return _mix(_mix(out) + _mix(lead[which] + (before[which] - start).astype(U)))


def settle(rows: list[tuple], length: int, roll: Roller) -> pa.RecordBatch:
    """(k1, k2, lo, hi) of the windows that repeat, of whole groups of rows (lead, n, k1, k2, at, before, data)."""
    half = length // 2
    lead, n, k1, k2, at, before = (np.array(x, np.int64) for x in list(zip(*rows))[:6])
    data, b = [r[6] for r in rows], before.tolist()
    # Rows come in the order of their leading bytes, so a group's rows follow each other.
    group = np.concatenate([[0], np.cumsum(lead[1:] != lead[:-1])])
    windows = np.array([len(d) for d in data]) - length + 1
    right = _common(group, [d[i + half : i + length] for d, i in zip(data, b)], length - half)
    right = np.where(right < 0, right, right + half)  # a group's leading bytes are equal
    left = _common(group, [d[:i][::-1] for d, i in zip(data, b)], length - half)
    # A window that starts d bytes left of the suffix needs d common bytes to the left and length - d to the right.
    first, last = np.maximum(before - windows + 1, length - right), np.minimum(before, left)
    which, d = _ragged(first, np.maximum(0, last - first + 1))
    key = _fingerprints(group.astype(U), data, which, before[which] - d, before, length, roll)
    _, example, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    other = which[example][inverse]  # the row of the first window with this fingerprint
    several = count[inverse] > 1

    def window(w: int, lo: int, hi: int) -> bytes:
        return data[w][b[w] - hi : b[w] - lo + length]

    # Byte by byte: neighbouring windows with the same example are compared at once.
    new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (other[1:] != other[:-1]) | (d[1:] != d[:-1] + 1)])) if len(which) else np.empty(0, np.int64)
    end = np.concatenate([new[1:], [len(which)]]).astype(np.int64) - 1 if len(which) else new
    wrong = [k for w, o, lo, hi, k in zip(which[new].tolist(), other[new].tolist(), d[new].tolist(), d[end].tolist(), new.tolist()) if w != o and window(w, lo, hi) != window(o, lo, hi)]
    if wrong:  # two windows share a fingerprint by chance: the bytes decide
        exact = Counter((group[w], i, window(w, i, i)) for w, i in zip(which.tolist(), d.tolist()))
        several = np.array([exact[group[w], i, window(w, i, i)] > 1 for w, i in zip(which.tolist(), d.tolist())])
    twice = several & (n[which] == 1)
    which, d = which[twice], d[twice]
    edge = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (d[1:] != d[:-1] + 1)])) if len(which) else np.empty(0, np.int64)
    end = np.concatenate([edge[1:], [len(which)]]).astype(np.int64) - 1 if len(which) else edge
    w = which[edge]
    return pa.RecordBatch.from_arrays([pa.array(k1[w]), pa.array(k2[w]), pa.array(at[w] - d[end]), pa.array(at[w] - d[edge])], ["k1", "k2", "lo", "hi"])


def _compare(cut: DataFrame, length: int) -> DataFrame:
    """(k1, k2, lo, hi): starts of windows that repeat, of rows (lead, n, k1, k2, at, before, data) sorted by their leading bytes; those with n over 1 only serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held = Roller(), []
        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            if len(held) > 8000 and held[-1][0] != held[0][0]:
                cut_at = len(held) - 1
                while held[cut_at - 1][0] == held[-1][0]:
                    cut_at -= 1
                yield settle(held[:cut_at], length, roll)
                held = held[cut_at:]
        if held:
            yield settle(held, length, roll)

    columns = cut.select("lead", "n", "k1", "k2", "at", "before", "data")
    return columns.mapInArrow(run, "k1 long, k2 long, lo long, hi long")


def _spread(cut: DataFrame, length: int) -> DataFrame:
    """The same as _compare for groups of any size: every window's fingerprint is shuffled and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = Roller(), Roller(*_SECOND)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for i in range(0, len(rows), 2048):
                lead, n, k1, k2, at, before = (np.array(x, np.int64) for x in list(zip(*rows[i : i + 2048]))[:6])
                data = [r[6] for r in rows[i : i + 2048]]
                windows = np.array([len(d) for d in data]) - length + 1
                which, start = _ragged(np.zeros(len(data), np.int64), windows)
                keys = [pa.array(_fingerprints(lead.view(U), data, which, start, before, length, roll).view(np.int64)) for roll in rolls]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(n[which]), pa.array(k1[which]), pa.array(k2[which]), pa.array(at[which] - before[which] + start)], ["f1", "f2", "n", "k1", "k2", "lo"])

    columns = cut.select("lead", "n", "k1", "k2", "at", "before", "data")
    windows = stored(columns.mapInArrow(run, "f1 long, f2 long, n long, k1 long, k2 long, lo long").withColumn("key", F.struct("f1", "f2")).drop("f1", "f2"), "windows")
    twice = stored(windows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "twice")
    found = skew_lookup(windows, twice, "key", "size", windows.count())
    return found.filter("n = 1").select("k1", "k2", "lo", F.col("lo").alias("hi"))


def repeated(rows: DataFrame, length: int, group_at_most: int) -> DataFrame:
    """(k1, k2, lo, hi) of all starts of windows that stand elsewhere too, of rows (k1, k2, w, text) without repeats, w of which there are."""
    suffixes = stored(_sample(rows.select("k1", "k2", "w", "text"), length), "suffixes")
    total = suffixes.count()
    leads = stored(suffixes.groupBy("lead").agg(F.sum("w").alias("size")).filter("size > 1"), "leads")
    shared = stored(skew_lookup(suffixes, leads, "lead", "size", total), "shared")
    discard(suffixes, leads)
    around = shared.groupBy("lead", "around", "around2").agg(F.sum("w").alias("n"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one"))
    around = stored(around.select("lead", "around", "around2", "n", "one.*"), "around")
    place = F.struct("lead", "around", "around2").alias("g")
    whole = skew_lookup(shared.select(place, "k1", "k2", "lo", "hi"), around.filter("n > 1").select(place, "n"), "g", "n", total)
    spans = whole.select("k1", "k2", "lo", "hi")

    # Groups of several surroundings, at least one of which stands once: there the windows decide.
    groups = around.groupBy("lead").agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("once")).filter("m > 1 and once > 0")
    groups = stored(groups, "groups")
    open_ = stored(skew_lookup(around.select("lead", "n", "k1", "k2", "at", "lo", "hi"), groups.select("lead", "m"), "lead", "m", total), "open")
    if open_.isEmpty():
        return spans
    small = open_.filter(F.col("m") <= group_at_most)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-small.count() // 20_000))
    leading = F.expr(f"substring(data, before + 1, {length // 2})")
    bucket = _cut_out(rows, small, length).repartitionByRange(tasks, leading).sortWithinPartitions(leading)
    spans = spans.unionByName(_compare(bucket, length))
    large = open_.filter(F.col("m") > group_at_most)
    if not large.isEmpty():
        spans = spans.unionByName(_spread(_cut_out(rows, large, length), length))
    return spans


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 400, group_at_most: int = _GROUP_AT_MOST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of docs.

    A text's UTF-8 bytes that a string of ``length`` bytes covers which also starts anywhere else, in the same text or
    another, are removed; strings are judged on the input. Null texts count as empty. Rows that repeat id and text repeat
    each other; they are worked on once, however many there are. Null ids pass through; other columns are ignored. An
    empty table gives an empty result. kept may cut through a character.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("k1"), F.xxhash64(text, F.col(id_col).cast("long"), F.lit(1)).alias("k2"), F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"))
    weighted, twice = _weighted(rows)
    spans = repeated(weighted, length, group_at_most)
    each = stored(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    pages, slot = id_filter(each.select("k1"), each.count())
    flagged = flag_in(rows, F.col("k1"), pages, slot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, gone, runs, kept, held = [], [], [], [], [], 0
            spans_of = batch.column(2)
            for doc_id, text, found in zip(batch.column(0), batch.column(1), spans_of):
                data, found = text.as_buffer(), found.as_py()
                if found:
                    a = np.array([(x["lo"], x["hi"] + length) for x in found], np.int64)
                    a = a[np.argsort(a[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(a[:, 1])
                    new = np.flatnonzero(np.concatenate([[True], a[1:, 0] > reach[:-1]]))
                    lo, hi = a[new, 0].tolist(), reach[np.concatenate([new[1:], [len(a)]]) - 1].tolist()
                    view = memoryview(data)
                    rest = b"".join([view[i:j] for i, j in zip([0, *hi], [*lo, len(view)])])
                else:
                    lo, rest = [], data.to_pybytes()
                ids.append(doc_id.as_py())
                sizes.append(data.size)
                gone.append(data.size - len(rest))
                runs.append(len(lo))
                kept.append(rest)
                held += len(rest)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names)
                    ids, sizes, gone, runs, kept, held = [], [], [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    found = flagged.filter("found")
    if twice is None:
        touched = found.join(each, ["k1", "k2"], "left")
    else:  # very many rows may be the same one
        index = each.withColumn("k", F.struct("k1", "k2")).join(twice, "k", "left").select("k", "spans", F.coalesce("n", F.lit(1)).alias("n"))
        touched = skew_lookup(found.withColumn("k", F.struct("k1", "k2")), index, "k", "n", rows.count(), how="left")
    touched = touched.select("doc_id", "text", "spans")
    changed = touched.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    same = flagged.filter("not found").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    return changed.unionByName(same)


def brute_force(rows: list[tuple], length: int) -> list[tuple]:
    """The same by definition, for tests: (doc_id, n_bytes, n_removed, n_spans, sha256 of kept)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, b in texts:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for s in range(len(b)) if gone[s] and (not s or not gone[s - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
