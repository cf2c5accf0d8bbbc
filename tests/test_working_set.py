import random
from datetime import datetime, timedelta

import pytest

from quern.streaming import working_set as W

START = datetime(2024, 1, 1)


def changes(seed, owners=4, n=240):
    rng = random.Random(seed)
    return [(rng.randrange(owners), k, rng.choice(["add"] * 6 + ["access"] * 3 + ["remove"]), rng.randrange(25), float(rng.randrange(5)), rng.randrange(1, 30), START + timedelta(seconds=k)) for k in range(n)]


def plain(rows, policy, bound):
    """Lists and dictionaries, one change after the other."""
    order, facts, out = {}, {}, []
    for owner, seq, op, i, importance, size, _ in rows:
        have, info = order.setdefault(owner, []), facts.setdefault(owner, {})
        if op == "access" and i in have:
            have.remove(i)
            have.append(i)
        if op == "remove" and i in have:
            have.remove(i)
            out.append((owner, seq, i, "removed"))
        if op == "add":
            if i in have:
                have.remove(i)
            if policy == "recency":
                if len(have) >= bound:
                    out.append((owner, seq, have.pop(0), "evicted"))
            else:
                while have and sum(info[x][1] for x in have) + size > bound:
                    worst = min(have, key=lambda x: (info[x][0], x))
                    have.remove(worst)
                    out.append((owner, seq, worst, "evicted"))
            have.append(i)
            info[i] = (importance, size)
            out.append((owner, seq, i, "added"))
    return sorted(out), {o: sorted(x) for o, x in order.items()}


def alive(events):
    have = {}
    for owner, seq, i, e in sorted(events, key=lambda r: (r[1], r[3] == "added")):
        s = have.setdefault(owner, set())
        s.add(i) if e == "added" else s.discard(i)
    return {o: sorted(s) for o, s in have.items()}


@pytest.fixture
def rocks(spark):
    for k, v in W.needs.items():
        spark.conf.set(k, v)
    yield spark
    for k in W.needs:
        spark.conf.unset(k)


def replay(spark, tmp_path, rows, cuts, policy, bound, runs, ttl_ms=None):
    """Each part is a file; ``runs`` says how many files there are before each start of the stream."""
    schema = "owner long, seq long, op string, id long, importance double, bytes long, ts timestamp"
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    done = 0
    for stop in runs:
        for part in parts[done:stop]:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        done = stop
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        q = W.working_set(stream, policy, bound, ttl_ms).writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
        assert q.awaitTermination(100)
    return sorted(tuple(r) for r in spark.read.schema(W.OUTPUT).parquet(f"file://{tmp_path}/out").collect())


@pytest.mark.parametrize("policy,bound", [("recency", 5), ("importance", 60)])
def test_replayed_with_a_restart_equals_a_plain_store(rocks, tmp_path, policy, bound):
    rows = changes(3)
    got = replay(rocks, tmp_path, rows, [50, 130], policy, bound, [2, 3])
    want, have = plain(rows, policy, bound)
    assert got == want and alive(got) == {o: x for o, x in have.items() if o in alive(got)}


def test_expiry(rocks, tmp_path):
    rows = [(1, 0, "add", 7, 1.0, 5, START), (1, 1, "add", 8, 1.0, 5, START + timedelta(seconds=50)), (2, 2, "add", 9, 1.0, 5, START + timedelta(seconds=120)), (2, 3, "add", 10, 1.0, 5, START + timedelta(seconds=121))]
    got = replay(rocks, tmp_path, rows, [2, 3], "recency", 5, [3], ttl_ms=60_000)
    assert {(o, i) for o, _, i, e in got if e == "expired"} >= {(1, 7)} and {(o, i) for o, _, i, e in got if e == "expired"} <= {(1, 7), (1, 8)}


def test_larger_than_the_bound_and_a_replaced_id():
    held = W.Held({}, "importance", 10)
    log = [e for op in [("add", 1, 1.0, 6, 0), ("add", 1, 1.0, 9, 0), ("add", 2, 0.5, 50, 0), ("add", 3, 0.1, 1, 0)] for e in held.apply(*op)]
    assert log == [(1, "added"), (1, "added"), (1, "evicted"), (2, "added"), (2, "evicted"), (3, "added")] and held.size == 1
