"""Modes of a growing set of snapshots: a truncated SVD that takes batches, forgets, and merges.

The state holds the mean and the modes as a tall table, a row per point. An update puts the modes, times their singular
values, beside the new snapshots; each partition reduces its rows of that to a small triangle by QR, triangles merge in a
tree, and the SVD of the last one rotates the rows. Points may be very many; modes and snapshots of a batch are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

BATCH_AT_MOST = 256  # snapshots that one QR takes; larger batches go in blocks
_CHUNK = 4096
_FAN = 16


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.flatten().buffers()[1], np.float64)[column.flatten().offset :][: len(column.flatten())].reshape(len(column), -1) if len(column) else np.empty((0, 0))


def triangle(rows: DataFrame, column: str) -> np.ndarray:
    """R of a QR of all rows' arrays: per partition in chunks, then in a tree of _FAN triangles a node."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, part = None, 0
        for batch in batches:
            if len(batch):
                part = batch.column(0)[0].as_py()
                m = _matrix(batch.column(1))
                for at in range(0, len(m), _CHUNK):
                    chunk = m[at : at + _CHUNK]
                    r = np.linalg.qr(chunk if r is None else np.vstack([r, chunk]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_pydict({"node": [part], "k": [r.shape[1]], "r": [r.ravel().tolist()]}, schema)

    def both(found: pd.DataFrame) -> pd.DataFrame:
        k = int(found["k"].iloc[0])
        r = np.linalg.qr(np.vstack([np.reshape(x, (-1, k)) for x in found["r"]]), mode="r")
        return pd.DataFrame({"node": [int(found["node"].iloc[0])], "k": [k], "r": [r.ravel().tolist()]})

    schema, kind = pa.schema([("node", pa.int64()), ("k", pa.int64()), ("r", pa.list_(pa.float64()))]), "node long, k long, r array<double>"
    nodes = cut(rows.select(F.spark_partition_id().cast("long").alias("node"), column).mapInArrow(local, kind))
    while (many := nodes.count()) > _FAN:
        nodes = cut(nodes.withColumn("node", F.expr(f"node div {_FAN}")).groupBy("node").applyInPandas(both, kind))
        if nodes.count() == many:
            break
    found = [np.reshape(r["r"], (-1, r["k"])) for r in nodes.orderBy("node").collect()]
    return np.linalg.qr(np.vstack(found), mode="r") if found else np.empty((0, 0))


@dataclass(frozen=True)
class IncrementalModes:
    """n_modes singular values and modes of the snapshots so far; ``update`` and ``merge`` give a new state.

    center: "running" takes each snapshot less the mean up to it, as a sensor stream would; "exact" gives the SVD of all
    snapshots less their common mean; None doesn't centre. forget multiplies the past at each further snapshot.
    table has (point, mean, u array<double>).
    """

    n_modes: int = 10
    forget: float = 1.0
    center: str | None = "running"
    n: int = 0
    sigma: np.ndarray = field(default_factory=lambda: np.empty(0))
    table: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.n_modes < 1 or not 0 < self.forget <= 1 or self.center not in (None, "running", "exact"):
            raise ValueError("n_modes must be at least 1, forget in (0, 1], and center running, exact or None")
        if self.center == "exact" and self.forget < 1:
            raise ValueError("the exact mean is that of all snapshots, so nothing may be forgotten")

    def update(self, batch: DataFrame, snapshot: str, point: str, value: str) -> IncrementalModes:
        """The state after the snapshots of batch (snapshot, point, value), in their order. What a snapshot or the state lacks counts as 0."""
        ids = [r[0] for r in batch.select(snapshot).distinct().orderBy(snapshot).limit(100_001).collect()]
        if len(ids) > 100_000:
            raise ValueError("a batch has at most 100,000 snapshots")
        state = self
        for at in range(0, len(ids), BATCH_AT_MOST):
            block = ids[at : at + BATCH_AT_MOST]
            state = state._block(batch.filter(F.col(snapshot).isin(block)), block, snapshot, point, value)
        return state

    def _block(self, batch: DataFrame, ids: list, snapshot: str, point: str, value: str) -> IncrementalModes:
        m, n, r = len(ids), self.n, len(self.sigma)
        per_point = batch.groupBy(F.col(point).alias("point")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(snapshot), F.col(value).cast("double")))).alias("by_"))
        x = per_point.select("point", F.array(*(F.coalesce(F.col("by_")[F.lit(i)], F.lit(0.0)) for i in ids)).alias("x"))
        if self.table is None:
            rows = x.select("point", F.lit(0.0).alias("mean"), F.array().cast("array<double>").alias("u"), "x")
        else:
            zeros = lambda k: F.array_repeat(F.lit(0.0), k)
            rows = self.table.join(x, "point", "full").select("point", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("u", zeros(r)).alias("u"), F.coalesce("x", zeros(m)).alias("x"))
        sigma, forget, center = self.sigma * self.forget**m, self.forget, self.center

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                mean, u, x = batch.column(1).to_numpy(), _matrix(batch.column(2)).reshape(len(batch), -1), _matrix(batch.column(3))
                after = (n * mean[:, None] + np.cumsum(x, axis=1)) / (n + np.arange(1, m + 1))
                if center == "running":
                    new = (x - after) * forget ** np.arange(m - 1, -1, -1)
                elif center == "exact":
                    own = x.mean(axis=1, keepdims=True)
                    new = np.hstack([x - own, np.sqrt(n * m / (n + m)) * (mean[:, None] - own)])
                else:
                    new = x * forget ** np.arange(m - 1, -1, -1)
                b = np.hstack([u * sigma, new]) if r else new
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after[:, -1]), pa.FixedSizeListArray.from_arrays(pa.array(b.ravel()), b.shape[1]).cast(pa.list_(pa.float64()))], ["point", "mean", "b"])

        kind = f"point {dict(x.dtypes)['point']}, mean double, b array<double>"
        return replace(self, n=n + m)._rotated(rows.mapInArrow(beside, kind))

    def merge(self, other: IncrementalModes) -> IncrementalModes:
        """The state of both sets of snapshots, those of other the later ones. Not for running means, which depend on the order of single snapshots."""
        if self.center == "running" or self.center != other.center or self.forget != other.forget:
            raise ValueError("states merge that forget alike and centre alike, not by running means")
        if self.table is None or other.table is None:
            return other if self.table is None else self
        n, m = self.n, other.n
        old, new = self.sigma * self.forget**m, other.sigma
        part = lambda c, k: F.coalesce(F.col(c), F.array_repeat(F.lit(0.0), k))
        times = lambda c, s: F.array(*(F.col(c)[j] * float(v) for j, v in enumerate(s))) if len(s) else F.array().cast("array<double>")
        rows = self.table.join(other.table.select("point", F.col("mean").alias("mean2"), F.col("u").alias("u2")), "point", "full").fillna(0.0, ["mean", "mean2"])
        rows = rows.withColumns({"u": part("u", len(old)), "u2": part("u2", len(new))})
        shift = F.array((n * m / (n + m)) ** 0.5 * (F.col("mean") - F.col("mean2"))) if self.center == "exact" else F.array().cast("array<double>")
        rows = rows.select("point", ((n * F.col("mean") + m * F.col("mean2")) / (n + m)).alias("mean"), F.concat(times("u", old), times("u2", new), shift).alias("b"))
        return replace(self, n=n + m)._rotated(rows)

    def _rotated(self, rows: DataFrame) -> IncrementalModes:
        """The state whose modes are the left singular vectors of the rows' arrays b."""
        rows = cut(rows)
        _, s, vt = np.linalg.svd(triangle(rows, "b"), full_matrices=False)
        keep = min(self.n_modes, int((s > 1e-13 * max(s.max(initial=0), 1e-300)).sum()))
        turn = vt[:keep].T / s[:keep] if keep else None

        def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = _matrix(batch.column(2)) @ turn if keep and len(batch) else np.empty((len(batch), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * keep), pa.array(u.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["point", "mean", "u"])

        kind = f"point {dict(rows.dtypes)['point']}, mean double, u array<double>"
        return replace(self, sigma=s[:keep], table=cut(rows.mapInArrow(rotate, kind)))

    def energy(self) -> np.ndarray:
        """Each mode's share of the energy that the modes hold."""
        return self.sigma**2 / max((self.sigma**2).sum(), 1e-300)

    def modes(self) -> DataFrame:
        """(mode, point, phi), each mode's largest entry positive."""
        phi = self.table.select("point", F.posexplode("u").alias("mode", "phi"))
        sign = phi.groupBy("mode").agg(F.signum(F.max_by("phi", F.abs("phi"))).alias("s_"))
        return phi.join(F.broadcast(sign), "mode").select("mode", "point", (F.col("phi") * F.col("s_")).alias("phi"))

    def project(self, fields: DataFrame, snapshot: str, point: str, value: str) -> DataFrame:
        """(snapshot, mode, a): coefficients of fields, less the mean unless center is None."""
        mean = F.lit(0.0) if self.center is None else F.col("mean")
        x = fields.select(F.col(snapshot), F.col(point).alias("point"), F.col(value).cast("double").alias("x_")).join(self.table.select("point", "mean"), "point")
        return x.join(self.modes(), "point").groupBy(snapshot, "mode").agg(F.sum((F.col("x_") - mean) * F.col("phi")).alias("a"))
