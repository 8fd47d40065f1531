import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.streaming import twins as W

TURN = np.array([[0.0, 1.0], [-0.04, 0.0]])


def model(members, dt):
    return members + dt * members @ TURN.T


def start(rng):
    return rng.normal(size=(30, 2))


RULES = W.Twin(model, start, np.array([[1.0, 0.0]]), np.array([[0.09]]), 0.05, 10.0)


def observations(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        for twin in ("a", "b", "c"):
            if not (twin == "b" and 20 <= i < 45) and not (twin == "c" and i > 30):
                rows.append((twin, 1000.0 + i, [float(3 * np.cos(0.2 * i) + rng.normal(0, 0.3))]))
    return rows, spark.createDataFrame(rows, "twin string, t double, observed array<double>")


def plain(rows, twin):
    """The fold by the formulas, for one twin."""
    members, t, step, quiet, out = None, None, 0, False, []
    for w, when, x in rows:
        if w != twin:
            continue
        if members is None:
            members, t = start(RULES.rng(twin, 0xFFFFFFFF)), when
        if t + 10.0 < when and not quiet:
            members = model(members, 10.0) + RULES.rng(twin, step).standard_normal((30, 2)) * 0.05
            t, step = t + 10.0, step + 1
            out.append((t, "gap", *members.mean(axis=0)))
        rng = RULES.rng(twin, step)
        if when > t:
            members = model(members, when - t) + rng.standard_normal((30, 2)) * 0.05
        p = np.cov(members.T)
        gain = p[:, 0] / (p[0, 0] + 0.09)
        noise = rng.multivariate_normal([0.0], [[0.09]], size=30, method="cholesky")[:, 0]
        members = members + np.outer(x[0] + noise - members[:, 0], gain)
        t, step = when, step + 1
        out.append((t, "observation", *members.mean(axis=0)))
    return out


def test_fold_follows_the_formulas(spark):
    rows, df = observations(spark)
    got = W.fold_twins(df, RULES).collect()
    for twin in "abc":
        mine = sorted((r.t, r.kind, *r.estimate) for r in got if r.twin == twin)
        assert [m[:2] for m in mine] == [w[:2] for w in plain(rows, twin)]
        assert np.allclose([m[2:] for m in mine], [w[2:] for w in plain(rows, twin)])
    assert [r.t for r in got if r.kind == "gap"] == [1029.0]
    truth = {1000 + i: 3 * np.cos(0.2 * i) for i in range(60)}
    late = [abs(r.estimate[0] - truth[int(r.t)]) for r in got if r.twin == "a" and r.t > 1020]
    assert np.mean(late) < 0.3


def test_stream_gives_the_rows_of_the_table(spark, tmp_path):
    _, df = observations(spark)
    stamped = df.select("twin", F.timestamp_seconds("t").alias("ts"), "observed")
    for at in range(1000, 1060, 15):
        stamped.filter(f"ts >= timestamp_seconds({at}) and ts < timestamp_seconds({at + 15})").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = W.follow_twins(stream, RULES).writeStream.format("memory").queryName("twins").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        got = spark.table("twins").orderBy("twin", "step").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = W.fold_twins(df, RULES).orderBy("twin", "step").collect()
    rows = lambda found: [(r.twin, r.t, r.kind, r.step, *r.estimate, *r.uncertainty) for r in found]
    # The silence of c has no observation at its end: only the watermark, in the stream, tells it.
    told = [r for r in rows(got) if r[0] == "c" and r[2] == "gap"]
    assert [r[1] for r in told] == [1040.0]
    assert [r for r in rows(got) if r not in told] == rows(want)


def test_what_cannot_be_taken_is_left_out(spark):
    rows = [("a", 0.0, [1.0]), ("a", 1.0, None), ("a", 1.0, [float("nan")]), ("a", 1.0, [1.0, 2.0]), (None, 1.0, [1.0]), ("a", None, [1.0]), ("a", 2.0, [1.0])]
    df = spark.createDataFrame(rows, "twin string, t double, observed array<double>")
    assert [r.t for r in W.fold_twins(df, RULES).orderBy("t").collect()] == [0.0, 2.0]
    follower = W.Follower("a", RULES)
    follower.observe(5.0, [1.0])
    assert follower.observe(4.0, [1.0]) == [] and follower.step == 1
    assert W.fold_twins(df.limit(0), RULES).collect() == []


def test_analysis_of_several_observed_numbers():
    rules = W.Twin(model, start, np.eye(2), np.diag([0.01, 4.0]))
    members = np.random.default_rng(0).normal(size=(4000, 2))
    after = rules.analysis(members, np.array([2.0, 2.0]), np.random.default_rng(1))
    assert after.mean(axis=0) == pytest.approx([2 / 1.01, 2 / 5], abs=0.1) and after.var(axis=0) == pytest.approx([0.0099, 0.8], rel=0.15)


EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the tables")
def test_stream_of_events_equals_the_fold(spark, tmp_path):
    rules = W.Twin(lambda x, dt: x, lambda rng: rng.normal(40, 30, size=(20, 1)), np.eye(1), np.eye(1) * 900.0, 2.0, 5 * 86_400.0)
    events = spark.read.parquet(EVENTS).filter("user_id < 12").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.array("value").alias("value"), "event_id")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    for k in range(3):
        part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * 3 / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)))), F.lit(2))
        events.filter(part == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = W.follow_twins(stream, rules, "user_id", "ts", "value", ["event_id"]).writeStream.format("memory").queryName("users").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        got = {(r.twin, r.step): (r.t, r.kind, r.estimate[0]) for r in spark.table("users").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    table = events.withColumn("t", F.unix_micros("ts") / 1e6)
    want = {(r.twin, r.step): (r.t, r.kind, r.estimate[0]) for r in W.fold_twins(table, rules, "user_id", "t", "value", ["event_id"]).collect()}
    assert want.keys() <= got.keys() and all(got[k][1] == v[1] and np.allclose([got[k][0], got[k][2]], [v[0], v[2]]) for k, v in want.items())
    # What only the stream tells are silences that no observation ends.
    last = {}
    for twin, step in got:
        last[twin] = max(last.get(twin, -1), step)
    assert all(got[k][1] == "gap" and k[1] == last[k[0]] for k in got.keys() - want.keys())
    assert len(want) > 50
