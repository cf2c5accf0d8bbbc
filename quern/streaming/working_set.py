"""Bounded working sets kept as state of a stream: by recency and number, or by importance and bytes.

Input rows are (owner, seq, op, id, importance, bytes, ts): ``op`` is ``add``,
``access`` or ``remove``; ``seq`` orders the rows of an owner.  Output rows (owner, seq,
id, event) tell what happened: ``added``, ``evicted``, ``removed``, ``expired``.

``recency``: an addition to a full set evicts what was added or accessed longest ago.
``importance``: an addition evicts the least important (of equal ones the smallest id)
until it fits; one that is larger than the bound stays alone.  An id that is
added again replaces itself and evicts nothing for its old size.  With ``ttl_ms`` a
memory leaves when the watermark passes ``ts`` + ``ttl_ms``; a timer an owner waits for
the next one.

The state of an owner is a map of at most the bound's number of memories, and only what
changed is written back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "owner long, seq long, id long, event string"


class Held:
    """The memories of one owner: id -> (importance, bytes, used, until)."""

    def __init__(self, rows: dict[int, tuple[float, int, int, int]], policy: str, bound: int):
        self.rows, self.policy, self.bound = rows, policy, bound
        self.size = sum(r[1] for r in rows.values())
        self.used = max((r[2] for r in rows.values()), default=0)
        self.changed: set[int] = set()

    def drop(self, i: int) -> bool:
        row = self.rows.pop(i, None)
        self.size -= row[1] if row else 0
        self.changed.add(i)
        return row is not None

    def victims(self, bytes_: int) -> Iterator[int]:
        if self.policy == "recency":
            if len(self.rows) >= self.bound:
                yield min(self.rows, key=lambda i: self.rows[i][2])
            return
        for i in sorted(self.rows, key=lambda i: (self.rows[i][0], i)):
            if self.size + bytes_ <= self.bound:
                return
            yield i

    def apply(self, op: str, i: int, importance: float, bytes_: int, until: int) -> Iterator[tuple[int, str]]:
        self.used += 1
        if op == "access":
            if i in self.rows:
                self.rows[i] = (*self.rows[i][:2], self.used, self.rows[i][3])
                self.changed.add(i)
        elif op == "remove":
            if self.drop(i):
                yield i, "removed"
        elif op == "add":
            self.drop(i)
            for v in self.victims(bytes_):
                self.drop(v)
                yield v, "evicted"
            self.rows[i] = (importance, bytes_, self.used, until)
            self.size += bytes_
            self.changed.add(i)
            yield i, "added"

    def expire(self, now: int) -> list[int]:
        gone = sorted(i for i, r in self.rows.items() if r[3] <= now)
        for i in gone:
            self.drop(i)
        return gone


class WorkingSet(StatefulProcessor):
    def __init__(self, policy: str, bound: int, ttl_ms: int | None):
        self.policy, self.bound, self.ttl_ms = policy, bound, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "id long", "importance double, bytes long, used long, until long")

    def _load(self) -> Held:
        return Held({k[0]: tuple(v) for k, v in self.held.iterator()}, self.policy, self.bound)

    def _store(self, held: Held) -> None:
        for i in held.changed:
            if i in held.rows:
                self.held.updateValue((i,), held.rows[i])
            elif self.held.containsKey((i,)):
                self.held.removeKey((i,))

    def _wait(self, held: Held) -> None:
        """One timer: for the memory that expires next."""
        if self.ttl_ms is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if held.rows:
            self.handle.registerTimer(min(r[3] for r in held.rows.values()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in batch.itertuples(index=False):
            until = int(r.ts.timestamp() * 1000) + self.ttl_ms if self.ttl_ms is not None else 1 << 62
            out += [(key[0], r.seq, i, e) for i, e in held.apply(r.op, r.id, r.importance, r.bytes, until)]
        self._store(held)
        self._wait(held)
        yield pd.DataFrame(out, columns=["owner", "seq", "id", "event"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._load()
        gone = held.expire(timerValues.getCurrentWatermarkInMs())
        self._store(held)
        self._wait(held)
        yield pd.DataFrame([(key[0], -1, i, "expired") for i in gone], columns=["owner", "seq", "id", "event"])

    def close(self) -> None:
        pass


def working_set(changes: DataFrame, policy: str, bound: int, ttl_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """The events of each owner's set; a stream that keeps its state in RocksDB (``needs``)."""
    if policy not in ("recency", "importance"):
        raise ValueError("policy must be 'recency' or 'importance'")
    mode = "EventTime" if ttl_ms is not None else "None"
    rows = changes.withWatermark("ts", late) if ttl_ms is not None else changes
    return rows.groupBy("owner").transformWithStateInPandas(WorkingSet(policy, bound, ttl_ms), OUTPUT, "Append", mode)


#: Session settings of streams with such state.
needs = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
