"""Quality by ordinal cumulative-link regression over hashed text features.

Grades 0 < 1 < ... share one weight a hashed feature; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(score - threshold_k). The fit is full-batch L-BFGS whose gradients Spark tasks sum over the
labelled sample; the driver holds only the weight vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

DIMENSIONS = 1 << 18
MEMO_TOKENS = 150_000
MAX_LABELLED = 20_000  # bound of the sample that the model is fitted on


#: Signs that close a token without being part of its word.
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()) + "«»“”„’…–—"
_WORD, _FIRST4, _FIRST5, _SHAPE, _REPEATS, _EMPTY = range(1, 7)


def _feature(kind: int, value: bytes) -> int:
    return crc32(value, kind) % DIMENSIONS


def _shape(word: str) -> str:
    """The kind of a word: its case if it is all letters, else its signs with letters and digits as a and 0, runs as one."""
    if word.isalpha():
        return "a" if word.islower() else "A" if word.isupper() else "Aa" if word.istitle() else "aA"
    return regex.sub(r"(.)\1+", r"\1", "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class _Tokens(dict):
    """Token: the hashed features of its word, the word's first letters, and its shape with the marks that close it."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        word = token.rstrip(_MARKS)
        shape = _feature(_SHAPE, (_shape(word) + token[len(word) :]).encode("utf-8", "surrogatepass"))
        if word := word.lstrip(_MARKS).lower():
            raw = word.encode("utf-8", "surrogatepass")
            out = shape, _feature(_WORD, raw), _feature(_FIRST4, word[:4].encode("utf-8", "surrogatepass")), _feature(_FIRST5, word[:5].encode("utf-8", "surrogatepass"))
        else:
            out = (shape,)
        self[token] = out
        return out

    def trim(self) -> None:
        if len(self) > MEMO_TOKENS:
            for k in list(islice(self, len(self) // 2)):
                del self[k]


def features(text: str | None, memo: _Tokens) -> np.ndarray:
    """The distinct hashed features of a whole text, ascending; each counts once, however often it stands."""
    tokens = text.split() if text else []
    if not tokens:
        return np.array([_feature(_EMPTY, b"")], np.int32)
    repeats = sum(map(eq, tokens, islice(tokens, 1, None)))
    found = [_feature(_REPEATS, b"%d" % round(10 * repeats / len(tokens)))]
    found += chain.from_iterable(map(memo.__getitem__, set(tokens)))
    memo.trim()
    return np.array(sorted(set(found)), np.int32)


def _scale(n: np.ndarray) -> np.ndarray:
    """A feature's value in a text of n features: damped, so that one telling word still counts in a long text."""
    return n.astype(float) ** -0.25


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool = True  # False: there was nothing to fit it on
    steps: int = 0
    gain: float = 0.0  # the last step's share of the loss; the fit has converged if it is below the tolerance

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. as columns."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -35, 35)))


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered whatever raw is: the first, then steps of exp(raw)."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def _loss(params: np.ndarray, grade: np.ndarray, flat: np.ndarray, size: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Negative log-likelihood and gradient of rows: flat holds their features one after another, size how many each has."""
    w, raw = params[:DIMENSIONS], params[DIMENSIONS:]
    theta = np.concatenate([[-np.inf], _thresholds(raw), [np.inf]])
    row, value = np.repeat(np.arange(len(size)), size), _scale(size)
    score = np.bincount(row, w[flat], len(size)) * value
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    above, below = sig(score - theta[grade]), sig(score - theta[grade + 1])
    above[grade == 0], below[grade == k - 1] = 1, 0
    p = np.maximum(above - below, 1e-12)
    da, db = above * (1 - above) / p, below * (1 - below) / p
    to_score = -(da - db)
    grad = np.zeros(len(params))
    grad[:DIMENSIONS] = np.bincount(flat, (to_score * value)[row], DIMENSIONS)
    to_theta = np.bincount(np.where(grade > 0, grade - 1, 0), np.where(grade > 0, da, 0), k - 1) - np.bincount(np.where(grade < k - 1, grade, 0), np.where(grade < k - 1, db, 0), k - 1)
    step = np.exp(raw)
    grad[DIMENSIONS] = to_theta.sum()
    for i in range(1, k - 1):
        grad[DIMENSIONS + i] = to_theta[i:].sum() * step[i]
    return float(-np.log(p).sum()), grad


def featurise(rows: DataFrame) -> DataFrame:
    """(grade, features array<int>) of rows (grade, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Tokens()
        for batch in batches:
            found = [features(t.as_py(), memo) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "features"])

    return rows.select(F.col("grade").cast("int").alias("grade"), F.col("text").cast("string").alias("text")).mapInArrow(run, "grade int, features array<int>")


def fit(labelled: DataFrame, grades: int = 3, *, ridge: float = 0.1, steps: int = 20, tolerance: float = 1e-3, tasks: int = 8) -> OrdinalModel:
    """Fits rows (grade, text) with grades 0..grades-1. Without rows, all weights are zero and every grade is as likely.

    It ends when a step lowers the loss by less than tolerance of it, or after ``steps``; the model says which.
    """
    spark = labelled.sparkSession
    table = stored(featurise(labelled), "features")
    sample = table.coalesce(tasks)

    def evaluate(params: np.ndarray) -> tuple[float, np.ndarray, int]:
        sent = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, n = 0.0, np.zeros(len(sent.value)), 0
            for b in batches:
                size = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
                one, g = _loss(sent.value, b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), size, grades)
                loss, grad, n = loss + one, grad + g, n + b.num_rows
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n]), pa.array([at.astype(np.int32).tobytes()]), pa.array([grad[at].tobytes()])], ["loss", "n", "at", "grad"])

        loss, grad, n = 0.0, np.zeros(len(params)), 0
        for r in sample.mapInArrow(run, "loss double, n long, at binary, grad binary").collect():  # tasks x a weight vector at most
            loss, n = loss + r.loss, n + r.n
            grad[np.frombuffer(r.at, np.int32)] += np.frombuffer(r.grad)
        w = params[:DIMENSIONS]
        grad[:DIMENSIONS] += ridge * w
        sent.destroy()
        return loss + ridge / 2 * w @ w, grad, n

    x = np.concatenate([np.zeros(DIMENSIONS), [-1.0], np.zeros(grades - 2)])
    f, g, n = evaluate(x)
    if not n:
        discard(table)
        return OrdinalModel(np.zeros(DIMENSIONS), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)), fitted=False)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    taken, gain = 0, np.inf
    while taken < steps and gain >= tolerance:
        taken += 1
        d, alphas = g.copy(), []
        for s, y in reversed(memory):
            alphas.append(s @ d / (s @ y))
            d -= alphas[-1] * y
        d *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1 / max(1.0, float(np.abs(g).sum()) ** 0.5)
        for (s, y), a in zip(memory, reversed(alphas)):
            d += (a - y @ d / (s @ y)) * s
        t, slope = 1.0, g @ d
        while True:
            new = x - t * d
            f2, g2, _ = evaluate(new)
            if f2 <= f - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 3
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            memory = [*memory[-7:], (s, y)]
        gain = (f - f2) / abs(f)
        x, f, g = new, f2, g2
    discard(table)
    return OrdinalModel(x[:DIMENSIONS].copy(), _thresholds(x[DIMENSIONS:]), steps=taken, gain=float(gain))


def _scores(texts: pa.Array, model: OrdinalModel, memo: _Tokens) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        found = features(text.as_py(), memo)
        out[i] = model.weights[found].sum(dtype=float) * len(found) ** -0.25
    return out


def predict(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tails array<double>, grade) for each row of docs; tails[k-1] is P(grade >= k).

    grade is the median grade: the number of tails of a half or more. Null texts count as empty.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Tokens(), sent.value
        for batch in batches:
            tails = m.tails(_scores(batch.column(1), m, memo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64())), pa.array((tails >= 0.5).sum(axis=1).astype(np.int32))], ["doc_id", "expected_grade", "tails", "grade"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, tails array<double>, grade int")


def select(docs: DataFrame, model: OrdinalModel, text_col: str = "text", *, least_tail: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose P(best grade) is at least least_tail; all rows if the model isn't fitted.

    Batches are filtered where they are: no join and no shuffle, so null and repeated ids play no part.
    """
    if not model.fitted:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(OrdinalModel(model.weights.astype(np.float32), model.thresholds))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, m = _Tokens(), sent.value
        for batch in batches:
            yield batch.filter(pa.array(m.tails(_scores(batch.column(at), m, memo))[:, -1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def graded(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(grade, text) of at most max_labelled labelled documents: toxic 0, else poor quality 1, else 2.

    Labels with a null are left out; of repeated labels of a document the worst grade counts, and of rows that repeat its
    id the least text. The sample is taken by a hash of the id, the same at every run. Empty tables give none.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    each = known.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = texts.join(F.broadcast(sample), "doc_id")  # the sample's size is bounded by max_labelled
    return held.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min("text").alias("text")).select("grade", "text")


def classify(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, *, least_tail: float = 0.5, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id") -> DataFrame:
    """predict(docs) with ``keep``: P(best grade) is at least least_tail. The model is fitted on labelled_docs.

    Without a usable label nothing is known against any document, and all are kept. id_col names the rows of
    docs in the result; labels always go by doc_id.
    """
    model = fit(graded(labelled_docs, labels, max_labelled=max_labelled))
    return predict(docs, model, id_col).withColumn("keep", F.element_at("tails", -1) >= least_tail if model.fitted else F.lit(True))
