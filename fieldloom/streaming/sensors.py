"""Structured Streaming of sensor samples: decoding, upsert by (sensor, time), windows, alarms, filters with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldloom.functions.scalars import decode_payload

SAMPLE = "sensor_id string, timestamp double, values array<double>, quality string, sequence bigint"


def decoded(stream: DataFrame, payload: str, default_sensor: str | None = None) -> DataFrame:
    """Samples of text messages; rows without a finite time or a finite value are left out."""
    p = stream.select("*", decode_payload(F.col(payload)).alias("p_"))
    s = p.select(F.coalesce(F.trim("p_.sensor_id"), F.lit(default_sensor)).alias("sensor_id"), F.col("p_.timestamp").alias("timestamp"), F.col("p_.values").alias("values"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return s.filter(finite(F.col("timestamp")) & F.exists("values", finite) & (F.col("sensor_id") != ""))


def upserted(samples: DataFrame, arrival: str) -> DataFrame:
    """One sample a (sensor, timestamp): the last to arrive, unless both sequences are set and its own is smaller.

    Among samples with sequences the largest wins, equal ones by arrival; one without a sequence that arrives later than
    all others wins. BAD quality is hidden afterwards.
    """
    w = Window.partitionBy("sensor_id", "timestamp")
    later = F.max(F.when(F.col("sequence").isNull(), F.col(arrival))).over(w)
    alive = samples.withColumn("null_", later).filter(F.col("null_").isNull() | (F.col(arrival) >= F.col("null_")))
    best = alive.withColumn("rn_", F.row_number().over(w.orderBy(F.desc_nulls_last("sequence"), F.desc(arrival))))
    return best.filter("rn_ = 1 and lower(coalesce(quality, 'good')) <> 'bad'").drop("rn_", "null_")


def newest(samples: DataFrame, n: int) -> DataFrame:
    """The newest n samples of each sensor."""
    w = Window.partitionBy("sensor_id").orderBy(F.desc("timestamp"))
    return samples.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= n).drop("rn_")


def store_batches(path: str, arrival: str = "arrival_id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is one directory, so a batch that is tried again replaces itself.

    Readers settle repeated keys with upserted(); compacted() writes a settled copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn(arrival, F.lit(batch_id).cast("long") * (1 << 40) + F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def compacted(store: DataFrame, path: str, arrival: str = "arrival_id") -> None:
    """Writes the settled samples of a store to another path, sorted by sensor and time in each file."""
    upserted(store, arrival).drop("batch").repartition("sensor_id").sortWithinPartitions("sensor_id", "timestamp").write.parquet(path)


def metrics(samples: DataFrame, accepted: Column, timestamp: str, now: str) -> DataFrame:
    """One row: accepted and rejected samples, and the latest and the largest lag of accepted ones, at least 0."""
    lag = F.when(accepted, F.greatest(F.col(now) - F.col(timestamp), F.lit(0.0)))
    latest = F.max_by(lag, F.when(accepted, F.struct(now, timestamp)))
    return samples.agg(F.count_if(accepted).alias("accepted_samples"), F.count_if(~accepted).alias("rejected_samples"), F.coalesce(latest, F.lit(0.0)).alias("latest_lag_seconds"), F.coalesce(F.max(lag), F.lit(0.0)).alias("maximum_lag_seconds"))


def windowed(stream: DataFrame, ts: str, by: str, x: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, mean, minimum and maximum per sensor and event-time window, with a watermark for late samples."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))


def kalman_stream(stream: DataFrame, by: str, t: str, x: str, q: float, r: float, x0: float = 0.0, p0: float = 1e3) -> DataFrame:
    """A random-walk Kalman filter per sensor whose state lives in the state store: (by, t, state, variance).

    Samples of a micro-batch are taken in time order; one older than the last seen is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, m, p = state.get if state.exists else (-np.inf, x0, p0)
        rows = pd.concat(list(batches)).sort_values([t, x])
        out = []
        for ti, xi in zip(rows[t], rows[x]):
            if ti < last:
                continue
            p += q
            gain = p / (p + r)
            m, p, last = m + gain * (xi - m), (1 - gain) * p, ti
            out.append((key[0], float(ti), float(m), float(p)))
        state.update((float(last), float(m), float(p)))
        yield pd.DataFrame(out, columns=[by, t, "state", "variance"])

    kind = dict(stream.dtypes)[by]
    return stream.select(by, t, x).groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {t} double, state double, variance double", "last double, m double, p double", "append", GroupStateTimeout.NoTimeout)
