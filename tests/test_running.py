import os
import random
from datetime import datetime, timedelta

import pytest

from quern.operators import analytics
from quern.sources import changes as C
from quern.streaming import logs, metrics

START = datetime(2024, 1, 1)


def agent_runs(seed, n=3000):
    rng = random.Random(seed)
    return [(k, rng.randrange(4), START + timedelta(minutes=rng.randrange(3000)), None if rng.random() < 0.02 else int(rng.expovariate(0.01)), rng.randrange(100), rng.choice(["completed"] * (3 + k % 4) + ["failed", "cancelled"])) for k in range(n)] + [(n + k, 9, START, 5, 1, "failed") for k in range(7)]


def test_stream_with_a_restart_equals_batch(spark, tmp_path):
    schema = "event_id long, agent_id long, started_at timestamp, ms long, tokens long, status string"
    rows = agent_runs(1)
    base = f"file://{tmp_path}"
    for part in (rows[:1000], rows[1000:1100], rows[1100:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        q = metrics.run(spark, stream, f"{base}/m", f"{base}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    kept = metrics.RunningMetrics(spark, f"{base}/m")
    kept.update(spark.createDataFrame(rows, schema), 1)  # a batch handed over again
    whole = spark.createDataFrame(rows, schema)
    exact = {(r.agent_id, r.day): r for r in analytics.agent_days(whole).collect()}
    days = kept.days().collect()
    assert len(days) == len(exact)
    times = {k: sorted(r[3] for r in rows if (r[1], r[2].date()) == k and r[3] is not None) for k in exact}
    for r in days:
        e, t = exact[r.agent_id, r.day], times[r.agent_id, r.day]
        assert all(r[c] == e[c] for c in ("total", "completed", "failed", "cancelled", "avg_ms", "min_ms", "max_ms", "tokens", "avg_tokens"))
        for got, q in ((r.p95_ms, 0.95), (r.p99_ms, 0.99)):
            low, high = sum(x < got for x in t) / len(t), sum(x <= got for x in t) / len(t)
            assert low - 0.01 <= q + 1 / len(t) and high + 0.01 >= q - 1 / len(t)
    key = lambda r: (r.agent_id, round(r.success_rate, 9), r.state, r.consecutive_failures)
    assert sorted(map(key, kept.health().collect())) == sorted(map(key, analytics.health(whole).collect()))


def test_agent_totals_equal_batch(spark, tmp_path):
    schema = "event_id long, agent_id long, started_at timestamp, ms long, tokens long, status string"
    spark.createDataFrame(agent_runs(2, 300), schema).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = logs.agent_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    want = logs.agent_totals(spark.read.parquet(f"file://{tmp_path}/in"))
    assert sorted(map(tuple, spark.table("totals").collect())) == sorted(map(tuple, want.collect()))


def test_debounce_equals_a_plain_loop(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted(((f"p{rng.randrange(3)}", "modified", START + timedelta(seconds=rng.randrange(400) / 10)) for _ in range(90)), key=lambda r: r[2])
    rows = list(dict.fromkeys(rows))
    for i in (0, 30, 60):
        spark.createDataFrame(rows[i : i + 30] if i < 60 else rows[60:], "path string, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{i}")
    want, last = [], {}
    for path, kind, ts in rows:
        if path not in last or (ts - last[path]).total_seconds() >= 2:
            last[path] = ts
            want.append((path, ts))
    schema = "path string, kind string, ts timestamp"
    for i in (0, 30, 60):  # one start of the stream for each part
        os.makedirs(tmp_path / "all", exist_ok=True)
        for f in os.listdir(tmp_path / f"in{i}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"in{i}" / f, tmp_path / "all" / f)
        q = logs.debounce(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/all")).writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
        assert q.awaitTermination(100)
    got = [(r.path, r.ts) for r in spark.read.schema(schema).parquet(f"file://{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want)


def write(folder, **files):
    for name, text in files.items():
        path = os.path.join(folder, name.replace("__", "/") + ".txt")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if text is None:
            os.remove(path)
        else:
            with open(path, "w") as f:
                f.write(text)


def test_folder_changes_survive_restarts(spark, tmp_path):
    spark.dataSource.register(C.FolderChanges)
    folder = tmp_path / "docs"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("folder_changes").option("path", f"file://{folder}").option("state", f"file://{tmp_path}/state").load()
        q = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/c").trigger(once=True).format("parquet").start(f"file://{tmp_path}/out")
        assert q.awaitTermination(100)
        return sorted((r.path, r.kind) for r in spark.read.schema(C.SCHEMA).parquet(f"file://{tmp_path}/out").collect())

    write(folder, a="1", b__c="2", _hidden="x")
    first = [("a.txt", "created"), ("b/c.txt", "created")]
    assert run() == first
    assert run() == first  # nothing new, nothing repeated
    write(folder, a="longer", b__c=None, d="4")
    assert run() == sorted([*first, ("a.txt", "modified"), ("b/c.txt", "deleted"), ("d.txt", "created")])
    write(folder, d=None)
    assert run()[-1] == ("d.txt", "deleted") and len(C.Kept(f"file://{tmp_path}/state").numbers()) <= 2


def test_an_offset_always_reads_the_same_changes(tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    reader = C.Reader({"path": f"file://{folder}", "state": f"file://{tmp_path}/s"})
    write(folder, a="1")
    one = reader.latestOffset()
    again = C.Reader({"path": f"file://{folder}", "state": f"file://{tmp_path}/s"})  # lost before the batch was run
    write(folder, b="2")
    two = again.latestOffset()
    read = lambda r, x, y: sorted((p, k) for s in r.partitions(x, y) for p, k, *_ in r.read(s))
    assert read(again, reader.initialOffset(), one) == [("a.txt", "created")]
    assert read(again, one, two) == [("b.txt", "created")] and read(again, reader.initialOffset(), two) == [("a.txt", "created"), ("b.txt", "created")]
    with pytest.raises(Exception):
        C.Reader({"path": "nowhere://x", "state": "nowhere://y"}).latestOffset()
