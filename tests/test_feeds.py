"""Streams give what the batch operators give on the same events."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tabspark.streaming import batch as B
from tabspark.streaming import feeds, rules

SCHEMA = "k int, id long, ts timestamp, tick int, page string, alive boolean"


def source(spark, tmp_path, n=120):
    r = random.Random(11)
    t, rows = 1_700_000_000.0, []
    for i in range(n):
        t += r.choice([1, 5, 20, 200])
        rows.append((r.randint(1, 3), i, t, r.randint(0, 6000), r.choice("ab"), r.random() < 0.8))
    df = spark.createDataFrame(rows, "k int, id long, sec double, tick int, page string, alive boolean")
    df = df.withColumn("ts", F.timestamp_micros((F.col("sec") * 1e6).cast("long")))
    for part in range(3):
        low, high = part * n // 3, (part + 1) * n // 3
        df.where((F.col("id") >= low) & (F.col("id") < high)).select("k", "id", "ts", "tick", "page", "alive").coalesce(1).write.parquet(
            str(tmp_path / "in"), mode="append"
        )
    return df, spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def drained(spark, stream, tmp_path, name):
    out, state = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-state")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.read.parquet(out)


def test_rate_limit_and_lookups(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = drained(spark, feeds.rate_limit(stream, "k", "ts", "id", 2), tmp_path, "limit")
    want = B.rate_limit(df, ["k"], "sec", "id", 2)
    assert {(r.id, r.allowed) for r in got.collect()} == {(r.id, r.allowed) for r in want.collect()}
    got = drained(spark, feeds.ttl_lookups(stream, "k", "ts", "id", 300.0), tmp_path, "ttl")
    want = B.ttl_lookups(df, ["k"], "sec", "id", 300.0)
    assert {(r.id, r.looked_up) for r in got.collect()} == {(r.id, r.looked_up) for r in want.collect()}


def test_loop_rounds(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = drained(spark, feeds.loop_rounds(stream, "k", "ts", "id", "tick", 1000, 5000, 0.75), tmp_path, "loop")
    want = B.loop_rounds(df, ["k"], ["sec", "id"], "tick", F.lit(1000), F.lit(5000), 0.75)
    assert {(r.id, r.next_speed) for r in got.collect()} == {(r.id, r.next_speed) for r in want.collect()}


def test_presence_alarms_of_the_stream_are_those_of_the_table(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = {(r.k, round(r.alarm_s, 3)) for r in drained(spark, feeds.presence(stream, "k", "page", "ts", "id", "alive"), tmp_path, "presence").collect()}
    want = {(r.k, round(r.alarm_s, 3)) for r in B.presence(df, ["k"], "page", "sec", "id", F.col("alive")).collect()}
    # The end of the data may still be open in the stream: its watermark is ten minutes behind.
    last = df.agg(F.max("sec")).first()[0]
    assert got <= want and {a for a in want if a[1] < last - 1500} <= got


def test_limiter_rules():
    assert rules.admit([0.0, 1.0, 2.0], [], 2, 60.0)[0] == [True, True, False]
    assert rules.admit([0.0, 60.0, 60.5], [], 1, 60.0)[0] == [True, False, True]


def test_client_key(spark):
    cases = {"2001:db8:1:2:aaaa::1": "2001:db8:1:2::/64", "2001:db8:1:2:bbbb::2": "2001:db8:1:2::/64", "10.0.0.1": "10.0.0.1", "": "unknown"}
    for host, want in cases.items():
        assert spark.range(1).select(rules.client_key(F.lit(host)).alias("v")).first().v == want


def test_stalled_jobs_of_the_stream_are_those_of_the_table(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = {(r.k, round(r.cut_s, 3), r.why) for r in drained(spark, feeds.stalled(stream, "k", "ts", "id"), tmp_path, "stalled").collect()}
    want = {(r.k, round(r.cut_s, 3), r.why) for r in B.stalled(df, ["k"], "sec", "id").collect()}
    assert got == want


def test_job_status_of_the_stream(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    q = feeds.job_status(stream, "k", "ts", "id", "page").writeStream.format("memory").queryName("jobs").outputMode("complete")
    q = q.option("checkpointLocation", str(tmp_path / "jobs")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    want = df.groupBy("k").agg(F.max_by("page", F.struct("sec", "id")).alias("s"))
    assert {(r.k, r.status) for r in spark.table("jobs").collect()} == {(r.k, r.s) for r in want.collect()}
