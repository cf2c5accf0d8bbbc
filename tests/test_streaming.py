import time

import pytest
from pyspark.sql import functions as F

from quern.operators import activity
from quern.streaming import logs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, sf_dir):
    """The events in three files, as a stream reads them."""
    path = f"file://{tmp_path_factory.mktemp('s')}/e"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"))
    lo, hi = e.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).head()
    for i in range(3):  # one after the other: the stream takes files by their time
        part = F.least(F.floor((F.unix_timestamp("ts") - lo) / ((hi - lo) / 3)), F.lit(2))
        e.where(part == i).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def replay(spark, folder, make, mode, name, **options):
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream, **options).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_hourly_equals_batch(spark, folder):
    got = replay(spark, folder, logs.hourly, "complete", "hourly")
    want = logs.hourly(spark.read.parquet(folder))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_transitions_equal_batch(spark, folder):
    got = replay(spark, folder, logs.transitions, "update", "transitions")
    got = got.groupBy("user_id", "path").agg(F.max("n").alias("n")).groupBy("path").agg(F.sum("n").alias("n"))
    want = activity.transitions(spark.read.parquet(folder), 2)
    assert {r.path: r.n for r in got.collect()} == {r.path: r.n for r in want.collect()}


def test_ring_buffer(spark, folder):
    got = replay(spark, folder, logs.ring_buffer, "update", "ring", capacity=20, drop=5)
    n = {r.user_id: r["count"] for r in spark.read.parquet(folder).groupBy("user_id").count().collect()}
    last = {}
    for r in got.collect():
        last[r.user_id] = r.size if r.user_id not in last else r.size
        assert r.size <= 20
    assert set(last) == set(n) and all(last[u] == n[u] for u in n if n[u] <= 20)


def test_sliding_and_sessions_equal_batch(spark, folder):
    e = spark.read.parquet(folder)
    assert logs.sliding(e).count() > 0
    s = logs.sessions(e, "30 minutes").agg(F.sum("n")).head()[0]
    assert s == e.count()
