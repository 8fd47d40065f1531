"""Jaccard join of documents on word n-grams, by MinHash banding.

Copies (equal n-gram sets) collapse first. Band and row counts follow from the similarity and the target recall. Band
hashes are shuffled; of buckets with the same members one is compared. All pairs of a bucket are compared, whatever
their classes, in the first band that they share: sizes and sketches of 128 bits rule out the clearly unlike, the full
sets settle the rest. Large buckets are cut into blocks, and a task compares two blocks: it counts each text's links
and puts out a forest of them, so no pair rows leave it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, id_filter, maybe_in, skew_lookup, stored
from .decontaminate import words

BLOCK = 2048  # members of a large bucket that a task compares with as many others
BLOCK_GRAMS = 1_000_000  # n-grams that the members of a block hold together, about
SKETCH = 128  # bits of a text's sketch, one a MinHash
_MEMO_WORDS = 100_000


def bands_for(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with the recall, within most_hashes.

    A pair of similarity s meets in a bucket with probability 1 - (1 - s**rows)**bands.
    """
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, most_hashes):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def most_flips(threshold: float, bits: int = SKETCH) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with probability below 1e-7.

    A bit differs with probability (1 - similarity) / 2; 5.5 deviations and one for the coarse tail.
    """
    p = (1 - threshold) / 2
    return math.ceil(bits * p + 5.5 * math.sqrt(bits * p * (1 - p))) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Word: its 64-bit hash; and with it the n-gram sets of texts."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def set_of(self, text: bytes | None) -> np.ndarray:
        """Ascending distinct hashes of the n-grams; of all words if they are fewer than n; empty without words."""
        w = words(text)
        if len(self) > _MEMO_WORDS:
            for k in list(islice(self, len(self) // 2)):
                del self[k]
        h = np.fromiter(map(self.__getitem__, w), np.uint64, len(w))
        m = min(self.n, len(w))
        if not m:
            return h
        out = np.full(len(h) - m + 1, m, np.uint64)
        for i in range(m):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - m + 1 + i])
        return np.unique(out)


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * a + b).min(axis=0), out=low)
    return low


def sign(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, digest, n_set, bands array<long>, s1, s2) of rows (doc_id, text binary); all but n_set are null without words.

    s1 and s2 hold the lowest bits of SKETCH mixed minima.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, rng = Shingler(n), np.random.default_rng(11)
        hashes = max(SKETCH, bands * rows)
        a = rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, hashes, dtype=np.uint64)
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            digests, sizes, keys, sketches = [], [], [], []
            for text in batch.column(1):
                s = shingler.set_of(text.as_py())
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    keys.append(None)
                    sketches.append((None, None))
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                minima, key = _minima(s, a, b), _mix(number + np.uint64(1))
                sketches.append(np.packbits((_mix(minima[:SKETCH]) & np.uint64(1)).astype(np.uint8)).view(np.int64).tolist())
                low = minima[: bands * rows].reshape(bands, rows)
                for i in range(rows):
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), *(pa.array([x[i] for x in sketches], pa.int64()) for i in (0, 1))], ["doc_id", "digest", "n_set", "bands", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, digest binary, n_set int, bands array<long>, s1 long, s2 long")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(id, digest, grams array<long>) of rows (doc_id, text binary); of texts without words too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            found = [shingler.set_of(t.as_py()) for t in batch.column(1)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "digest", "grams"])

    return docs.mapInArrow(run, "id long, digest binary, grams array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, i, j), which follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            here = tuple(at[:, lo].tolist())
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(table: pa.Table, threshold: float, flips: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group, and which of their pairs can be similar and share no earlier band."""
    block, ids, size, s1, s2 = (table.column(x).to_numpy() for x in ("block", "id", "n_set", "s1", "s2"))
    s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # of negative numbers, the bits of the absolute value would be counted
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    before = pa.compute.list_flatten(table.column("before")).to_numpy().reshape(len(block), -1)
    # Keys of a band as small numbers, which are faster to compare.
    before = [np.unique(x, return_inverse=True)[1].astype(np.int16 if len(x) < 2**15 else np.int64) for x in before.T] if len(block) > 64 else before.T
    ok = np.triu(np.ones((len(left), len(right)), bool), 1) if i == j else np.ones((len(left), len(right)), bool)
    for lo in range(0, len(left), 256):
        x, part = left[lo : lo + 256, None], ok[lo : lo + 256]
        part &= ids[x] != ids[right]
        part &= np.minimum(size[x], size[right]) >= threshold * np.maximum(size[x], size[right])
        for b in before:
            part &= b[x] != b[right]
        if part.any():
            part &= np.bitwise_count(s1[x] ^ s1[right]) + np.bitwise_count(s2[x] ^ s2[right]) <= flips
    return left, right, ok


def _links(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, ok: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, root) of each row: how many of the pairs marked in ok it is in whose sets have a Jaccard similarity of threshold
    or more, and the least row of its connected component. Pairs are settled in strips, which bounds the memory."""
    size = np.array([len(g) for g in grams], np.int32)
    n, root = np.zeros(len(grams), np.int64), np.arange(len(grams))
    common = None
    if np.count_nonzero(ok) * size.mean() >= 4 * size.sum():  # many pairs: products of 0-1 matrices, over the n-grams that several texts hold
        _, term, held = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        several = held > 1
        term = term.astype(np.int32)
        shared = several[term]
        owner, term = np.repeat(np.arange(len(grams), dtype=np.int32), size)[shared], (np.cumsum(several, dtype=np.int32) - 1)[term[shared]]
        order = np.argsort(term, kind="stable")
        owner, term = owner[order], term[order]
        common = np.zeros(ok.shape, np.float32)  # counts below 2**24 are exact
        for first in range(0, int(term[-1]) + 1 if len(term) else 0, 1024):
            lo, hi = np.searchsorted(term, [first, first + 1024])
            m = np.zeros((len(grams), 1024), np.float32)
            m[owner[lo:hi], term[lo:hi] - first] = 1
            common += m[left] @ m[right].T
    for lo in range(0, len(left), 128):
        x, y = np.nonzero(ok[lo : lo + 128])
        if not len(x):
            continue
        if common is None:  # few pairs: each by itself
            both = np.array([np.isin(grams[left[lo + a]], grams[right[b]], assume_unique=True, kind="sort").sum() for a, b in zip(x, y)], np.int64)
        else:
            both = common[lo + x, y].astype(np.int64)
        x, y = left[lo + x], right[y]
        similar = both / (size[x] + size[y] - both) >= threshold
        x, y = x[similar], y[similar]
        n += np.bincount(x, minlength=len(n)) + np.bincount(y, minlength=len(n))
        root = _forest(len(n), np.concatenate([x, np.arange(len(n))]), np.concatenate([y, root]))
    return n, root


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row number of each row's connected component, of n rows with links (x, y)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def compare(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root) of rows (key, id, digest, n_set, s1, s2, before, blocks): n links of a text, found in one task; stored.

    root is a text of the same connected component. Each link counts once for both of its texts over all rows. before
    holds the text's keys of earlier bands. sets: (id, digest, grams), once each.
    """
    flips = most_flips(threshold)
    placed = members.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    placed = placed.withColumn("p", meets).select("key", "p.i", "p.j", "block", "id", "digest", "n_set", "s1", "s2", "before")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            left, right, ok = _open_pairs(table, threshold, flips)
            if ok.any():
                needed = np.zeros(table.num_rows, bool)
                needed[left[ok.any(axis=1)]] = True
                needed[right[ok.any(axis=0)]] = True
                yield from table.filter(pa.array(needed)).to_batches()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            left, right, ok = _open_pairs(table, threshold, flips)
            grams = [g for c in table.column("grams").chunks for g in np.split(c.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(c).to_numpy())[:-1])]
            n, root = _links(grams, left, right, ok, threshold)
            at = np.flatnonzero(n)
            if len(at):
                ids = table.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), pa.array(ids[root[at]])], ["id", "n", "root"])

    needed = stored(grouped(placed).mapInArrow(sift, placed.schema), "open")
    out = stored(grouped(needed.join(sets, ["id", "digest"])).mapInArrow(count, "id long, n long, root long"), "found")
    discard(needed)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs.

    Texts are linked if their sets of n-word grams (ASCII letters in lower case, other characters than letters, digits
    and non-ASCII ones part words; a shorter text is one gram) have a Jaccard similarity of threshold or more. class_id is
    the smallest id of a text's connected component, copies included; n_links counts all links between its distinct text
    and others, those within a class too. A pair at the threshold is found with probability recall. Texts without words, nulls among them, and rows with a
    null id are classes of their own, without links. Rows that repeat an id are one node. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    bands, depth = bands_for(threshold, recall)
    signed = stored(sign(rows, bands, depth, n), "signatures")
    known = signed.filter("digest is not null and doc_id is not null")
    texts = stored(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_set").alias("n_set"), *(F.first(c).alias(c) for c in ("bands", "s1", "s2"))), "texts")
    total = known.count()

    # Buckets that hold at least two texts, the first of those with the same texts, and their members.
    in_band = texts.select("id", "digest", "n_set", "s1", "s2", "bands", F.posexplode("bands").alias("band", "key"))
    names = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)]  # 128 bits name a set of texts
    several = in_band.groupBy("key").agg(F.count("*").alias("n"), F.min("band").alias("band"), F.sum("n_set").alias("grams"), *names).filter("n > 1")
    several = several.groupBy("n", "x0", "x1").agg(F.min(F.struct("band", "key", "grams")).alias("b")).select("n", "b.key", "b.grams")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    sizes = stored(several.select("key", "n", blocks), "buckets")
    pages, slot = id_filter(sizes.select("key"), sizes.count())
    held = maybe_in(in_band, F.col("key"), pages, slot).withColumn("before", F.expr("slice(bands, 1, band)")).drop("bands", "band")
    members = stored(skew_lookup(held, sizes, "key", "n", total * bands).drop("n"), "members")
    ids = members.select("id").distinct()
    pages, slot = id_filter(ids, ids.count())
    # Rows that repeat an id may differ in text, so sets go by digest as well.
    own = maybe_in(rows.filter("doc_id is not null"), F.col("doc_id"), pages, slot).select("doc_id", "text")
    sets = stored(sets_of(own, n).groupBy("id", "digest").agg(F.first("grams").alias("grams")), "sets")
    found = compare(members, sets, threshold)
    label = components(found, "id", "root")
    degree = found.groupBy("id").agg(F.sum("n").alias("n_links"))

    by_text = texts.select("digest", "id", "copies").join(label, "id", "left").join(degree, "id", "left")
    classes = stored(by_text.select("digest", "copies", F.coalesce("component", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    discard(sizes, members, sets, found, texts)
    with_words = skew_lookup(known.select("doc_id", "digest"), classes, "digest", "copies", total).select("doc_id", "class_id", "n_links")
    alone = signed.filter("digest is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(alone)
