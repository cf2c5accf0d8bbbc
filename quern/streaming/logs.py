"""Structured Streaming twins of the log operators.

Each takes a streaming DataFrame and returns one; the caller writes it.  A batch
DataFrame gives the same rows where the operator has no state of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, retention: str = "72 hours") -> DataFrame:
    """(hour, n, errors, avg_ms): tumbling hours, kept as state for ``retention``."""
    w = timed(events).withWatermark("ts", retention).groupBy(F.window("ts", "1 hour"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("errors"), F.avg("duration_ms").alias("avg_ms"))
    return out.select(F.col("window.start").alias("hour"), "n", "errors", "avg_ms")


def sliding(events: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, stop, n) of sliding windows (an extra)."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n")).select("window.start", F.col("window.end").alias("stop"), "n")


def sessions(events: DataFrame, gap: str = "31 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): sessions closed by a gap."""
    s = timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), "n")


def ring_buffer(events: DataFrame, key: str = "user_id", capacity: int = 2000, drop: int = 500, ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """(key, size, oldest): a buffer per key that drops its oldest ``drop`` rows when it passes ``capacity``.

    The state of a key is a list of at most ``capacity`` + one batch ids.
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values([ts, id_col])
        for x in rows[id_col].tolist():
            ids.append(x)
            if len(ids) > capacity:
                del ids[:drop]
        state.update((ids,))
        yield pd.DataFrame({key: [k[0]], "size": [len(ids)], "oldest": [ids[0]]})

    return events.select(key, ts, id_col).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, size long, oldest long", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def debounce(changes: DataFrame, seconds: float = 2.0) -> DataFrame:
    """File changes (path, kind, ts) at least ``seconds`` after the last accepted change of the path."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        keep = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for row in rows.itertuples(index=False):
            at = row.ts.timestamp()
            if last is None or at - last >= seconds:
                last = at
                keep.append((row.path, row.kind, row.ts))
        state.update((last,))
        yield pd.DataFrame(keep, columns=["path", "kind", "ts"])

    return changes.groupBy("path").applyInPandasWithState(step, "path string, kind string, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def agent_totals(runs: DataFrame) -> DataFrame:
    """Running totals per agent (update or complete mode)."""
    return runs.groupBy("agent_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("tokens").alias("tokens"))


def transitions(events: DataFrame) -> DataFrame:
    """(user_id, path, n): counts of consecutive kinds, learnt batch by batch; the state is the last kind and the counts."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, names, counts = state.get if state.exists else (None, [], [])
        seen = dict(zip(names, counts))
        for kind in pd.concat(list(parts)).sort_values(["ts", "event_id"])["kind"]:
            if last is not None:
                seen[f"{last} > {kind}"] = seen.get(f"{last} > {kind}", 0) + 1
            last = kind
        state.update((last, list(seen), list(seen.values())))
        yield pd.DataFrame({"user_id": k[0], "path": list(seen), "n": list(seen.values())})

    rows = events.select("user_id", "event_id", "ts", "kind")
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, path string, n long", "last string, names array<string>, counts array<long>", "update", GroupStateTimeout.NoTimeout)
