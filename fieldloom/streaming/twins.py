"""Twins of assets that follow a stream of observations: an ensemble a twin, forecast by a model and corrected by an ensemble Kalman filter.

The same fold serves a stream, where the ensemble is the state of ``transformWithStateInPandas`` and timers tell that a
twin falls silent, and a table. Noise comes from a generator that is seeded by twin and step, so both give the same rows,
however the stream is cut into micro-batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "twin string, t double, kind string, step bigint, estimate array<double>, uncertainty array<double>"
_STATE = "t double, step bigint, quiet boolean, members array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Twin:
    """How twins move and what is seen of them.

    model(members, dt) gives the members (rows, by state) after dt seconds; start(rng) gives the first members. An
    observation is h @ state with noise of covariance r. process_noise is the standard deviation a step adds. A twin
    without an observation for ``gap`` seconds gets one forecast row (kind gap) at that time.
    """

    model: Callable[[np.ndarray, float], np.ndarray]
    start: Callable[[np.random.Generator], np.ndarray]
    h: np.ndarray
    r: np.ndarray
    process_noise: float = 0.01
    gap: float = float("inf")
    seed: int = 0

    def rng(self, twin: str, step: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, zlib.crc32(twin.encode()), step])

    def forecast(self, members: np.ndarray, dt: float, rng: np.random.Generator) -> np.ndarray:
        return self.model(members, dt) + rng.standard_normal(members.shape) * self.process_noise

    def analysis(self, members: np.ndarray, observed: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Members after an observation, perturbed for each: the gain is that of the ensemble's own covariance."""
        seen = members @ self.h.T
        a, b = members - members.mean(axis=0), seen - seen.mean(axis=0)
        scale = max(len(members) - 1, 1)
        gain = np.linalg.solve((b.T @ b / scale + self.r).T, (a.T @ b / scale).T).T
        noise = rng.multivariate_normal(np.zeros(len(self.r)), self.r, size=len(members), method="cholesky")
        return members + (observed + noise - seen) @ gain.T


@dataclass
class Follower:
    """One twin's fold: time, step, members, and whether its silence was told."""

    twin: str
    rules: Twin
    t: float = float("nan")
    step: int = 0
    quiet: bool = False
    members: np.ndarray | None = None

    def _row(self, kind: str) -> tuple:
        return self.twin, self.t, kind, self.step, self.members.mean(axis=0).tolist(), self.members.std(axis=0).tolist()

    def silence(self, now: float) -> list[tuple]:
        """The row of a gap that ended before now, once a gap."""
        due = self.t + self.rules.gap
        if self.members is None or self.quiet or not due < now:
            return []
        self.members = self.rules.forecast(self.members, self.rules.gap, self.rules.rng(self.twin, self.step))
        self.t, self.step, self.quiet = due, self.step + 1, True
        return [self._row("gap")]

    def observe(self, t: float, observed: Sequence[float]) -> list[tuple]:
        """The rows of an observation: that of a gap before it, and its own. One that is older than the state is left out."""
        x = np.asarray(observed, float)
        if not np.isfinite(t) or not np.isfinite(x).all() or len(x) != len(self.rules.r):
            return []
        if self.members is None:
            self.members, self.t = np.asarray(self.rules.start(self.rules.rng(self.twin, -1 & 0xFFFFFFFF)), float), t
            out = []
        elif t < self.t:
            return []
        else:
            out = self.silence(t)
        rng = self.rules.rng(self.twin, self.step)
        if t > self.t:
            self.members = self.rules.forecast(self.members, t - self.t, rng)
        self.members = self.rules.analysis(self.members, x, rng)
        self.t, self.step, self.quiet = t, self.step + 1, False
        return [*out, self._row("observation")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["twin", "t", "kind", "step", "estimate", "uncertainty"])


def fold_twins(observations: DataFrame, rules: Twin, twin: str = "twin", t: str = "t", observed: str = "observed", order: Sequence[str] = ()) -> DataFrame:
    """(twin, t, kind, step, estimate, uncertainty) over a table of observations (t in seconds), in order of t, then ``order``; a twin is a task."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        follower = Follower(str(key[0]), rules)
        out: list[tuple] = []
        for when, x in rows.sort_values(["t", *order], kind="stable")[["t", "observed"]].itertuples(index=False):
            out += follower.observe(float(when), x)
        return _frame(out)

    rows = observations.select(F.col(twin).cast("string").alias("twin"), F.col(t).cast("double").alias("t"), F.col(observed).cast("array<double>").alias("observed"), *order)
    return rows.dropna(subset=["twin", "t", "observed"]).groupBy("twin").applyInPandas(run, OUT)


class _Processor(StatefulProcessor):
    def __init__(self, rules: Twin, order: tuple[str, ...]):
        self.rules, self.order = rules, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("twin", _STATE)

    def _read(self, twin: str) -> Follower:
        follower = Follower(twin, self.rules)
        if self.state.exists():
            t, step, quiet, members = self.state.get()
            follower.t, follower.step, follower.quiet = t, step, quiet
            follower.members = np.array(members).reshape(-1, self.rules.h.shape[1])
        return follower

    def _write(self, f: Follower) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.state.update((float(f.t), int(f.step), bool(f.quiet), f.members.ravel().tolist()))
        if not f.quiet and np.isfinite(self.rules.gap):
            self.handle.registerTimer(int(np.ceil((f.t + self.rules.gap) * 1000)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        follower, out = self._read(str(key[0])), []
        batch = pd.concat(list(rows))
        for when, x in batch.sort_values(["t", *self.order], kind="stable")[["t", "observed"]].itertuples(index=False):
            out += follower.observe(float(when), x)
        if follower.members is not None:
            self._write(follower)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            follower = self._read(str(key[0]))
            out = follower.silence(np.inf)
            if out:
                self._write(follower)
        yield _frame(out)

    def close(self) -> None:
        pass


def follow_twins(observations: DataFrame, rules: Twin, twin: str = "twin", ts: str = "ts", observed: str = "observed", order: Sequence[str] = (), delay: str = "0 seconds") -> DataFrame:
    """The same rows from a stream of observations with timestamps ts; t is in seconds.

    Observations of a twin are taken in order within a micro-batch; one that comes after a later one, or after the twin's
    silence was told, is left out. Gaps are told by event time: when an observation ends them, or the watermark passes.
    """
    spark = observations.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    seconds = (F.unix_micros(ts) / 1e6).alias("t")
    rows = observations.select(F.col(twin).cast("string").alias("twin"), F.col(ts), seconds, F.col(observed).cast("array<double>").alias("observed"), *order)
    rows = rows.dropna(subset=["twin", ts, "observed"]).withWatermark(ts, delay)
    return rows.groupBy("twin").transformWithStateInPandas(_Processor(rules, tuple(order)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
