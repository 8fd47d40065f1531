"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' most frequent words are compiled into a minimal acyclic automaton over their UTF-8 bytes whose arcs carry
numbers; the numbers along a word's path add up to its rank, and the rank gives its ids. The automaton is one file in
the shared folder, memory-mapped by the workers. Words outside it are merged exactly by the vocabulary's merge ranks.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, scratch_path, stored

LEXICON_WORDS = 65_536  # bound of the chunks whose words make up the lexicon; all other words are merged when met
SHORT, NO_MERGE = 48, 1 << 40
MEMO_CHUNKS = 400_000  # bound of a worker's memo
OUT_BYTES = 8 << 20
STABLE = "\u0530"  # below it, all Unicode versions in use agree on letters, numbers and cases


class Vocabulary(NamedTuple):
    """What a word-end BPE file holds, as far as encoding and decoding need it."""

    tokens: dict[str, int]
    ranks: dict[int, int]  # of a pair of ids, a << 32 | b
    merged: list[int]  # id of the pair of each rank
    specials: dict[str, int]
    suffix: str
    pattern: str
    steps: str  # the file without its tokens: normaliser and pre-tokeniser only

    @staticmethod
    def load(path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        tokens = model["vocab"]
        ranks = {tokens[a] << 32 | tokens[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        merged = [tokens[a + b] for a, b in model["merges"]]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bare = json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}})
        return Vocabulary(tokens, ranks, merged, specials, model["end_of_word_suffix"] or "", steps[0]["pattern"]["Regex"], bare)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b if b in prints else spare)
        spare += b not in prints
    return out


class Merger:
    """Exact BPE of one pre-tokenised word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.rank, self.merged = vocabulary, vocabulary.ranks.get, vocabulary.merged
        symbols = byte_symbols()
        self.inner = [vocabulary.tokens[s] for s in symbols]
        self.last = [vocabulary.tokens[s + vocabulary.suffix] for s in symbols]
        self.pattern = regex.compile(vocabulary.pattern).findall
        self.steps = Tokenizer.from_str(vocabulary.steps)
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")").split if vocabulary.specials else lambda x: [x]

    def split(self, chunk: str) -> list[str]:
        """The words of a text without white space; special tokens come as they are."""
        if chunk.isascii() and not any(map(chunk.__contains__, self.v.specials)):
            return [chunk.lower()] if chunk.isalpha() else self.pattern(chunk.lower())
        out: list[str] = []
        for part in self.special(chunk):
            if part in self.v.specials:
                out.append(part)
            elif part and max(part) < STABLE:
                # One character at a time, so a sigma never becomes a final one.
                out += self.pattern(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            elif part:
                # Rare scripts: letters and cases differ between versions of Unicode, so the library's own steps split them.
                found = self.steps.pre_tokenizer.pre_tokenize_str(self.steps.normalizer.normalize_str(part))
                out += [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in found]
        return out

    def ids(self, word: str) -> list[int]:
        if word in self.v.specials:
            return [self.v.specials[word]]
        raw = word.encode("utf-8", "surrogatepass")
        ids = list(map(self.inner.__getitem__, raw))
        ids[-1] = self.last[raw[-1]]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        """Lowest rank first, leftmost first among equals, by a scan of all pairs' ranks."""
        rank, none = self.rank, NO_MERGE
        ranks = [rank(a << 32 | b, none) for a, b in pairwise(ids)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = self.merged[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list."""
        rank, none, n = self.rank, NO_MERGE, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (r := rank(a << 32 | b, none)) != none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            new = ids[i] = self.merged[r]
            ids[j], right[i] = -1, right[j]
            if (k := right[i]) >= 0:
                left[k] = i
                if (r := rank(new << 32 | ids[k], none)) != none:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            if (k := left[i]) >= 0 and (r := rank(ids[k] << 32 | new, none)) != none:
                heapq.heappush(heap, (r, k, ids[k], new))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The minimal automaton of the words, suffixes shared, with arc numbers and the ids by rank, as one block of bytes."""
    words = sorted(w.encode("utf-8", "surrogatepass") for w in entries)
    by_word = {w.encode("utf-8", "surrogatepass"): ids for w, ids in entries.items()}
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]  # of the last word: final, arcs (label, state)

    def close(to: int) -> None:
        while len(path) > to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], registry[key])

    before = b""
    for w in words:
        same = next((i for i, (a, b) in enumerate(zip(before, w)) if a != b), min(len(before), len(w)))
        close(same)
        for b in w[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        before = w
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    count, first, labels, targets, numbers = [], [0], [], [], []
    for final, arcs in states:  # children come before parents
        n = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            numbers.append(n)
            n += count[target]
        count.append(n)
        first.append(len(labels))
    outputs = [by_word[w] for w in words]
    flat = np.array([i for o in outputs for i in o], "<u4")
    parts = [np.array(first, "<u4"), np.array([f for f, _ in states], np.uint8), np.array(labels, np.uint8), np.array(targets, "<u4"), np.array(numbers, "<u4"), np.cumsum([0, *map(len, outputs)]).astype("<u4"), flat]
    head = np.array([x for p in parts for x in (len(p), p.itemsize)], "<u8")
    return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)


class Lexicon:
    """Look-up in a compiled lexicon; the buffer is not copied."""

    def __init__(self, buffer):
        head, at, parts = np.frombuffer(buffer, "<u8", 14), 14 * 8, []
        for n, size in head.reshape(7, 2).tolist():
            parts.append(np.frombuffer(buffer, {1: np.uint8, 4: "<u4"}[size], n, at))
            at += n * size + -(n * size) % 8
        first, final, labels, targets, numbers, offsets, flat = parts
        # Views of the mapped file; only the labels are copied, for the C search in them.
        self.first, self.final, self.targets, self.numbers, self.offsets = map(memoryview, (first, final, targets, numbers, offsets))
        self.labels, self.flat = labels.tobytes(), memoryview(flat).cast("B")

    def get(self, word: str) -> bytes | None:
        """The word's ids as little-endian 32-bit integers, None if the word isn't in the lexicon."""
        first, find, targets, numbers = self.first, self.labels.find, self.targets, self.numbers
        state, rank = len(self.final) - 1, 0
        for b in word.encode("utf-8", "surrogatepass"):
            i = find(b, first[state], first[state + 1])
            if i < 0:
                return None
            rank += numbers[i]
            state = targets[i]
        return bytes(self.flat[4 * self.offsets[rank] : 4 * self.offsets[rank + 1]]) if self.final[state] else None


def open_shared(uri: str) -> pa.Buffer:
    """A file of the shared folder: memory-mapped where the folder is mounted, else read."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    if isinstance(filesystem, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with filesystem.open_input_file(path) as f:
        return f.read_buffer()


def write_shared(uri: str, data: bytes) -> None:
    filesystem, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    filesystem.create_dir(path.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(path) as f:
        f.write(data)


def chunks_of(text: str | None) -> list[str]:
    """The parts of a text between white space. U+001C to U+001F are no white space here, though str.split takes them so."""
    if not text:
        return []
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [x for x in regex.split(r"\p{White_Space}+", text) if x]
    return text.split()


def count_chunks(docs: DataFrame, text_col: str = "text", *, held: int = 400_000) -> DataFrame:
    """(chunk, n) over all of docs, a chunk being text between white space; a task holds about ``held`` chunks at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["chunk", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(chunks_of(text.as_py()))
                if len(seen) > held:
                    yield out()
                    seen.clear()
        yield out()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "chunk string, n long")
    return counted.groupBy("chunk").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", *, size: int = LEXICON_WORDS) -> str:
    """Compiles the words of the most frequent chunks of docs, at most ``size`` of them, and returns the file's place.

    Which chunks are frequent enough follows from a histogram of all counts on a logarithmic scale, so the driver gets
    some hundred rows and then only the chunks themselves.
    """
    step = F.floor(F.log2("n") * 16)
    counts = stored(count_chunks(docs, text_col), "chunks")
    cut, room = None, size
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("chunks")).orderBy(F.desc("step")).collect():
        room -= r.chunks
        if room < 0:
            break
        cut = r.step
    merger = Merger(vocabulary)
    top = [] if cut is None else counts.filter(step >= cut).select("chunk").collect()  # at most ``size`` rows
    discard(counts)
    words = {w for r in top for w in merger.split(r.chunk)}
    uri = scratch_path(docs.sparkSession, "lexicon") + "/words.bin"
    uri = uri if "://" in uri else f"file://{uri}"
    write_shared(uri, compile_lexicon({w: merger.ids(w) for w in words}))
    return uri


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, lexicon: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row of docs; ids are little-endian unsigned 32-bit integers.

    ``path`` is a word-end BPE file of the tokenizers library. The ids are what the library's encode gives without
    added special tokens, decoded what its decode gives of them with special tokens kept. Null and empty texts have no
    ids and decode to the empty text. Null and repeated document ids pass through. Other columns are ignored.
    """
    vocabulary = Vocabulary.load(path)
    uri = lexicon or build_lexicon(docs, vocabulary, text_col, size=lexicon_words)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(sent.value, Lexicon(open_shared(uri)))
        for batch in batches:
            doc_ids, ids, texts, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = list(map(memo.__getitem__, chunks_of(text.as_py())))
                memo.trim()
                doc_ids.append(doc_id.as_py())
                ids.append(b"".join([x[0] for x in found]))
                texts.append(" ".join([x[1] for x in found]))
                held += len(texts[-1]) + len(ids[-1])
                if held > OUT_BYTES:
                    yield _encoded(doc_ids, ids, texts)
                    doc_ids, ids, texts, held = [], [], [], 0
            yield _encoded(doc_ids, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, decoded string")


def _encoded(doc_ids: list, ids: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


class _Memo(dict):
    """Chunk of text: its ids as bytes, and what they decode to."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        super().__init__()
        self.merger, self.lexicon = Merger(vocabulary), lexicon
        self.words: dict[str, bytes] = {}
        self.token = {i: t for t, i in (vocabulary.tokens | vocabulary.specials).items()}

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        known, parts = self.words, []
        for w in self.merger.split(chunk):
            if (ids := known.get(w)) is None:
                ids = known[w] = self.lexicon.get(w) or array("I", self.merger.ids(w)).tobytes()
            parts.append(ids)
        ids = b"".join(parts)
        out = self[chunk] = ids, decode(memoryview(ids).cast("I"), self.token)
        return out

    def trim(self) -> None:
        for memo in (self, self.words):
            if len(memo) > MEMO_CHUNKS:
                for k in list(islice(memo, len(memo) // 2)):
                    del memo[k]


def decode(ids: Sequence[int], token: dict[int, str]) -> str:
    """Without a decoder in its file, the library joins tokens with blanks."""
    return " ".join([token[i] for i in ids])
