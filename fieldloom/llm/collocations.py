"""Phrase collocation mining: frequent words get ids, and n-grams of ids are counted as fixed-width keys by sort and run length.

A word's id is a 64-bit hash of language and word; the dictionary (h, lang, word, n) of all words proves that no other word
shares a frequent word's id, else another seed is taken. Phrases of a level are counted in one pass over the texts. A
bitmap of bounded size of what was frequent on the level before breaks pieces at other words and skips phrases with an
infrequent part; where it is full it only lets more phrases pass, which then fall short of the least count. A task packs
its n-grams into binary keys of 8 bytes a word, sorts them and sends one row per key and run of ``_RUN`` n-grams, so that
no phrase is hot; ranges of the keys' hash go to partitions, which are radix-sorted by it and counted by run lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, id_filter, maybe_in, skew_lookup, stored

U = np.uint64
LEAST, LONGEST, TOP = 100, 5, 2000
_BREAKS, _SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in _BREAKS else 32 if c in _SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 21  # bytes of texts that are worked on at once
_RUN = 1 << 20  # n-grams that a task counts before it sends them
_FEW, _MANY = 1 << 15, 1 << 26  # bits of a filter: at least, and at most whatever the input
_SALTS = 256
_OFFSETS = 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Hashes of words by a random coefficient for each place in a word and a random value for each byte."""

    def __init__(self, seed: int, bits: int = 64):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, dtype=U)
        self.place = rng.integers(0, 2**63, _OFFSETS, dtype=U) * U(2) + U(1)
        self.keep = U(2**bits - 1)

    def words(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of words of these sizes that follow each other in data, in chunks of at most _CHUNK bytes or one word."""
        out, ends = np.empty(len(sizes), U), np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            begin = int(ends[at] - sizes[at])
            to = max(at + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
            part, n = data[begin : ends[to - 1]], sizes[at:to]
            first = np.cumsum(n) - n
            place = np.arange(len(part)) - np.repeat(first, n)
            factor = self.place[place & (_OFFSETS - 1)]
            if n.max() > _OFFSETS:
                factor = factor * (_mix((place >> 12).astype(U)) | U(1))
            out[at:to] = np.add.reduceat(self.value[part] * factor, first)
            at = to
        return _mix(out + sizes.astype(U)) & self.keep


def _join(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The fingerprint of a phrase and one more word."""
    return _mix(g * U(0x9E3779B97F4A7C15) + h)


def _fold(keys: np.ndarray) -> np.ndarray:
    g = keys[:, 0]
    for j in range(1, keys.shape[1]):
        g = _join(g, keys[:, j])
    return g


class Words:
    """The words of a slice of documents: their bytes one after the other, sizes, document, and whether a piece begins with them."""

    def __init__(self, text: pa.StringArray):
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = memoryview(text.buffers()[2] or b"")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data = np.frombuffer(bytes(raw).translate(_TABLE), np.uint8)
        inside = (data != 32) & (data != 10)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]  # a document begins a word, and ends the one before
        opens[begin] = inside[begin]
        closes[begin[1:] - 1] = inside[begin[1:] - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.sizes = end - start
        self.doc = np.repeat(np.arange(len(text)), np.diff(np.searchsorted(start, offsets)))
        piece = np.searchsorted(np.flatnonzero(data == 10), start)
        self.breaks = np.ones(len(start), bool)
        self.breaks[1:] = (piece[1:] != piece[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.data = data[inside]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StringArray, pa.StringArray]]:
    """(lang, text) of slices of at most _CHUNK bytes, or of one text."""
    for batch in batches:
        lang, text = batch.column(0), batch.column(1)
        sizes = np.cumsum(np.diff(np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64))) if len(text) else np.empty(0, np.int64)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _CHUNK, "right")))
            yield lang.slice(at, to - at), text.slice(at, to - at)
            at = to


def _ids(words: Words, lang: pa.StringArray, hasher: Hasher) -> np.ndarray:
    code = lang.dictionary_encode()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in code.dictionary.to_pylist()], U)
    h = hasher.words(words.data, words.sizes)
    return _mix(h + salt[code.indices.to_numpy(zero_copy_only=False)[words.doc]]) & hasher.keep if len(h) else h


def _count_words(rows: DataFrame, seed: int, bits: int) -> DataFrame:
    """(h, lang, word, n) of the words of rows (lang, text), counted by slices. Words of a slice are told apart by 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Hasher(seed, bits), Hasher(seed + 1000)
        for lang, text in _slices(batches):
            words = Words(text)
            if not len(words.sizes):
                continue
            h, other = _ids(words, lang, one), _ids(words, lang, two)
            order = np.argsort(h)
            new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])]))
            n, which = np.diff(np.append(new, len(order))), order[new]
            ends = np.concatenate([[0], np.cumsum(words.sizes)]).astype(np.int64)
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.sizes), [None, pa.py_buffer(ends), pa.py_buffer(words.data)])
            word = whole.take(pa.array(which)).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h[which].view(np.int64)), lang.take(pa.array(words.doc[which])), word, pa.array(n)], ["h", "lang", "word", "n"])

    each = rows.mapInArrow(run, "h long, lang string, word string, n long")
    return each.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _bitmap(ids: DataFrame, n: int) -> np.ndarray:
    """Bits at the low ends of ids, about 16 an id; of bounded size, so it may be collected and broadcast."""
    bits = _FEW
    while bits < _MANY and bits < 16 * n:
        bits *= 2
    slot = ids.select(ids[0].bitwiseAND(F.lit(bits - 1)).alias("s"))
    held = slot.groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[held.column(0).to_numpy()] = held.column(1).to_numpy()
    return out.view(U)


def _has(bitmap: np.ndarray, g: np.ndarray) -> np.ndarray:
    slot = g & U(len(bitmap) * 64 - 1)
    return (bitmap[slot >> U(6)] >> (slot & U(63))) & U(1) == 1


def _frequent_parts(h: np.ndarray, breaks: np.ndarray, k: int, words: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The places of phrases of k words that no break and no infrequent word parts, and whose two parts of k - 1 words may be frequent."""
    known = _has(words, h)
    parted = breaks | ~known
    parted[1:] |= ~known[:-1]
    start = np.flatnonzero(parted)
    size = np.diff(np.append(start, len(h)))
    room = np.repeat(start + size, size) - np.arange(len(h))
    at = np.flatnonzero(known & (room >= k))
    if k > 2:
        for shift in (0, 1):
            at = at[_has(before, _fold(np.stack([h[at + j + shift] for j in range(k - 1)], axis=1)))]
    return at


def _runs(f: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by key, of rows in the order of their hash f; keys that share a hash by chance are sorted by themselves."""
    differ = (keys[1:] != keys[:-1]).any(axis=1)
    if (differ & (f[1:] == f[:-1])).any():
        order = np.lexsort((*keys.T, f))
        f, keys, n = f[order], keys[order], n[order]
        differ = (keys[1:] != keys[:-1]).any(axis=1)
    new = np.flatnonzero(np.concatenate([[True], differ]))
    return f[new], keys[new], np.add.reduceat(n, new)


def _packed(keys: np.ndarray) -> pa.Array:
    """Keys of 8 bytes a word, big-endian."""
    width = 8 * keys.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(np.arange(0, width * (len(keys) + 1), width, dtype=np.int32)), pa.py_buffer(keys.astype(">u8"))])


def _unpacked(array: pa.BinaryArray, k: int) -> np.ndarray:
    begin = np.frombuffer(array.buffers()[1], np.int32)[array.offset]
    return np.frombuffer(array.buffers()[2], ">u8", len(array) * k, begin).reshape(-1, k).astype(U)


def _count_phrases(rows: DataFrame, k: int, seed: int, bits: int, words: np.ndarray, before: np.ndarray, least: int, tasks: int) -> DataFrame:
    """(g, key binary, n) of phrases of k words that stand least times: g is a fingerprint for the filter, key the words' ids."""
    share = rows.sparkSession.sparkContext.broadcast((words, before))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (words, before), held, size = Hasher(seed, bits), share.value, [], 0

        def sent() -> pa.RecordBatch:
            keys = np.concatenate(held)
            g = _fold(keys)
            order = np.argsort(g)
            _, keys, n = _runs(g[order], keys[order], np.ones(len(keys), np.int64))
            return pa.RecordBatch.from_arrays([_packed(keys), pa.array(n)], ["key", "n"])

        for lang, text in _slices(batches):
            found = Words(text)
            if len(found.sizes) >= k:
                h = _ids(found, lang, hasher)
                at = _frequent_parts(h, found.breaks, k, words, before)
                if len(at):
                    held.append(np.stack([h[at + j] for j in range(k)], axis=1))
                    size += len(at)
            if size >= _RUN:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keys, n = keys[n >= least], n[n >= least]
            return pa.RecordBatch.from_arrays([pa.array(_fold(keys).view(np.int64)), _packed(keys), pa.array(n)], ["g", "key", "n"])

        rest = None
        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(0).to_numpy(), _unpacked(batch.column(1), k), batch.column(2).to_numpy()
            f, keys, n = (np.concatenate(x) for x in zip(rest, part)) if rest else part
            last = int(np.searchsorted(f, f[-1]))  # what shares the last hash waits for more
            if last:
                yield kept(*_runs(f[:last], keys[:last], n[:last])[1:])
            rest = _runs(f[last:], keys[last:], n[last:])
        if rest:
            yield kept(*rest[1:])

    hashed = F.xxhash64("key")
    grams = rows.mapInArrow(count, "key binary, n long")
    dealt = grams.repartitionById(tasks, F.expr(f"cast(shiftright(shiftrightunsigned(xxhash64(key), 33) * {tasks}, 31) as int)"))
    ordered = dealt.select(hashed.alias("f"), "key", "n").sortWithinPartitions("f")
    return ordered.mapInArrow(merge, "g long, key binary, n long")


def _clash(words: DataFrame, frequent: DataFrame) -> bool:
    """Whether a word shares the id of another one that is frequent."""
    pages, slot = id_filter(frequent.select("h"), frequent.count())
    near = maybe_in(words.select("h"), F.col("h"), pages, slot)
    return not near.groupBy("h").count().filter("count > 1").join(frequent.select("h"), "h").isEmpty()


def _looked_up(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Inner join with an index of one row per key; the keys that very many rows use go by broadcast."""
    uses = rows.groupBy(key).agg(F.count("*").alias("uses"))
    return skew_lookup(rows, index.join(uses, key), key, "uses", rows.count()).drop("uses")


def _best_cut(k: str, longest: int) -> Column:
    """SQL over a, total, l1.., r1..: (score, cut, l, r) of the lowest score, ties to the shortest first part. Exact in decimals of 38 digits."""
    wide = "cast({} as decimal(18, 0))"
    cuts = [f"if({j} < {k}, named_struct('score', ({wide.format('1000 * a')} * {wide.format('total')}) div ({wide.format(f'l{j}')} * {wide.format(f'r{j}')}), 'cut', {j}, 'l', l{j}, 'r', r{j}), null)" for j in range(1, longest)]
    return F.expr(f"array_min(filter(array({', '.join(cuts)}), x -> x is not null))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorb: int = 100, seed: int = 11, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) for the ``top`` phrases of each language.

    Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words. Of
    the n words of a language, phrases of 2 to longest words that stand a >= least times within pieces are candidates.
    Cut after its first k words, l and r are how often the parts stand; the score is floor(1000 a n / (l r)) at the cut
    where that is lowest, then k. A candidate is dropped if a longer one, dropped or not, holds it and stands at least absorb % as
    often. Rank: score and a from above, then the phrase by bytes. A null text has no words, a null language is ``und``;
    other columns, ids among them, are ignored, and repeated rows count again. An empty table gives an empty result.
    ``bits`` shortens ids, for tests.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for attempt in range(8):
        words = stored(_count_words(rows, seed + attempt, bits), "words")
        frequent = stored(words.filter(F.col("n") >= least), "frequent_words")
        if not _clash(words, frequent):
            break
        discard(words, frequent)
    else:
        raise RuntimeError("words share ids with every seed")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"), F.count_if(F.col("n") >= least).alias("size"))
    known = frequent.select(F.unhex(F.lpad(F.hex("h"), 16, "0")).alias("sub"), "lang", "word", "n")
    known = stored(skew_lookup(known, totals, "lang", "size", frequent.count()).select("sub", "lang", "word", "n", "total"), "dictionary")
    first = before = _bitmap(frequent.select("h"), frequent.count())
    levels = []
    for k in range(2, longest + 1):
        grams = stored(_count_phrases(rows, k, seed + attempt, bits, first, before, least, tasks), "phrases")
        levels.append(grams.select(F.lit(k).alias("k"), "key", "n"))
        many = grams.count()
        if not many:
            break
        before = _bitmap(grams.select("g"), many)
    discard(words, frequent)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)

    part = lambda begin, size: f"substring(key, {8 * begin + 1}, 8 * ({size}))"
    cuts = [f"named_struct('side', {s}, 'cut', {j}, 'sub', {p})" for j in range(1, longest) for s, p in ((0, part(0, j)), (1, part(j, f"k - {j}")))]
    parts = grams.select("k", "key", F.col("n").alias("a"), F.explode(F.expr(f"filter(array({', '.join(cuts)}), x -> x.cut < k)")).alias("x")).select("k", "key", "a", "x.*")
    none = F.lit(None)
    index = known.select("sub", F.col("n").alias("m"), "lang", "total").unionByName(grams.select(F.col("key").alias("sub"), F.col("n").alias("m"), none.cast("string").alias("lang"), none.cast("long").alias("total")))
    at = lambda side, j: F.max(F.when((F.col("side") == side) & (F.col("cut") == j), F.col("m")))
    counted = _looked_up(parts, index, "sub").groupBy("k", "key", "a").agg(*(at(s, j).alias(f"{'lr'[s]}{j}") for s in (0, 1) for j in range(1, longest)), F.max("lang").alias("lang"), F.max("total").alias("total"))
    # Whatever is in a longer candidate is in one of one more word, which stands at least as often.
    inner = grams.filter("k > 2").select("n", F.explode(F.expr("array(substring(key, 1, 8 * (k - 1)), substring(key, 9))")).alias("key")).groupBy("key").agg(F.max("n").alias("longer"))
    scored = counted.join(inner, "key", "left").filter(F.coalesce(100 * F.col("longer") < absorb * F.col("a"), F.lit(True)))
    scored = scored.withColumn("best", _best_cut("k", longest)).select("lang", "k", "key", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")
    # Ties in score and count are kept here; the phrases' text decides them below, for few rows.
    ahead = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    leading = stored(scored.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS))).withColumn("place", F.rank().over(ahead)).filter(F.col("place") <= top).drop("salt", "place"), "leading")
    each = leading.select("key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("key", "i", F.expr("substring(key, 8 * i + 1, 8)").alias("sub"))
    text = _looked_up(each, known.select("sub", "word"), "sub").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    phrases = leading.join(text.select("key", F.array_join("w.word", " ").alias("phrase")), "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(_SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (select lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') as w from (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as p from documents)),
totals as (select lang, sum(len(w))::bigint as n from pieces group by lang),
grams as (select lang, k, w[i:i + k - 1] as ph, count(*) as c from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 6) as t(k)) group by all having count(*) >= 100),
cand as (select * from grams where k > 1),
cuts as (select *, unnest(range(1, k)) as j from cand),
scores as (select x.lang, x.ph, x.k, x.c as a, l.c as l, r.c as r, j, n, ((1000::hugeint * x.c * n) // (l.c::hugeint * r.c))::bigint as score
  from cuts x join totals using (lang) join grams l on l.lang = x.lang and l.ph = x.ph[1:j] join grams r on r.lang = x.lang and r.ph = x.ph[j + 1:]),
best as (select * from scores qualify row_number() over (partition by lang, ph order by score, j) = 1),
inside as (select lang, ph[i:i + m - 1] as ph, max(c) as c from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from cand)) group by all),
kept as (select b.* from best b left join inside s on s.lang = b.lang and s.ph = b.ph where s.c is null or 100 * s.c < 100 * b.a),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank, array_to_string(ph, ' ') as phrase, a, l, r, n, score from kept)
select * from ranked where rank <= 2000
"""
