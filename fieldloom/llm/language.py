"""Language identification with hyperdimensional profiles.

Each sign of a folded alphabet has a random vector of +1 and -1. A trigram binds its letters' vectors, permuted by
place, by multiplication; a text bundles its trigrams by addition. A language's prototype is the bundle of its training
texts, each scaled to unit length, less the mean of all prototypes; a text takes the language of the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNS = 64  # 0: no letter; 1 to 26: a to z; others share the rest
TABLE_END = 0x32400  # beyond the last assigned letters
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Texts that are never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _fold_table() -> np.ndarray:
    table = np.zeros(TABLE_END + 1, np.uint8)
    for cp in range(TABLE_END):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 % (SIGNS - 27)
    return table


class Codebook:
    """Vectors of trigrams; the same for the same seed and dimension."""

    def __init__(self, dimension: int, seed: int = 7):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SIGNS, dimension))
        first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
        self.pairs = (first[:, None, :] * second[None, :, :]).reshape(SIGNS * SIGNS, dimension)
        self.letters, self.dimension, self.table = letters, dimension, _fold_table()

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the text's trigrams; stretches without letters are one sign. Empty if no letter."""
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        signs = self.table[np.minimum(cps, TABLE_END)]
        if not signs.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        signs = np.concatenate([[0], signs, [0]]).astype(np.int64)
        signs = signs[np.concatenate([[True], (signs[1:] != 0) | (signs[:-1] != 0)])]
        codes = signs[:-2] * SIGNS**2 + signs[1:-1] * SIGNS + signs[2:]
        return np.unique(codes, return_counts=True)

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dimension, np.float32)
        for i in range(0, len(codes), 4096):
            c = codes[i : i + 4096]
            bound = self.pairs[c // SIGNS] * self.letters[c % SIGNS]
            out += weights[i : i + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


@dataclass
class Profiles:
    languages: list[str]
    prototypes: np.ndarray  # unit rows
    dimension: int


def fit(texts: DataFrame, *, dimension: int = 1024, held: int = 32) -> Profiles:
    """Prototypes of rows (text, lang). Rows with a null, and texts without a letter, teach nothing.

    A task bundles its texts by language and passes on sums, at most ``held`` languages at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, sums = Codebook(dimension), {}

        def out() -> pa.RecordBatch:
            found = {}
            for lang, w in sums.items():
                codes = np.flatnonzero(w)
                found[lang] = book.bundle(codes, w[codes]).astype(float)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["lang", "v"])

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                codes, counts = book.trigrams(text.as_py())
                if len(codes):
                    key = lang.as_py()
                    if key not in sums and len(sums) >= held:
                        yield out()
                    # Trigram vectors are nearly orthogonal, so this scales the text's bundle to about unit length.
                    w = sums.setdefault(key, np.zeros(SIGNS**3))
                    w[codes] += counts / np.sqrt((counts.astype(float) ** 2).sum())
        yield out()

    rows = texts.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    parts = rows.mapInArrow(run, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    summed = parts.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    # A vector for each language: bounded by the number of languages.
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    raw = np.array([[e.x for e in r.v] for r in found]).reshape(len(found), dimension)
    unit = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    if len(unit) > 1:
        unit = unit - unit.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return Profiles([r.lang for r in found], unit.astype(np.float32), dimension)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs; score is the cosine mapped from [-1, 1] to [0, 1].

    Null texts and texts without a letter get 'und' and 0; so does every text if there are no profiles. Equal cosines
    go to the language first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        book = Codebook(p.dimension)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                codes, counts = book.trigrams(text.as_py() or "")
                if len(codes) and p.languages:
                    v = book.bundle(codes, counts)
                    cosine = p.prototypes @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(cosine.argmax())
                    langs.append(p.languages[best])
                    scores.append(min(1.0, max(0.0, (1 + float(cosine[best])) / 2)))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, *, dimension: int = 1024) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): profiles of the rows that aren't held out, applied to all rows."""
    profiles = fit(docs.filter(~held_out(F.col("doc_id"))), dimension=dimension)
    return predict(docs, profiles).withColumn("held_out", held_out(F.col("doc_id")))
