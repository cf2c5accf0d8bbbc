"""Snapshots of a space's chunks: create, list, restore into a store, and retention by age and kind.

The chunks of a snapshot are written once below the folder; a commit names the
snapshots that count, so a snapshot is there wholly or not at all and of two
writers one fails.  Retention drops what ``store.expired_snapshots`` names; the files of
dropped snapshots are removed after the commit.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .commits import CommitLog
from .store import VersionedStore, expired_snapshots

KINDS = ("automatic", "manual", "before_change")
LIST = "snapshot string, space_id string, kind string, created_at timestamp, chunks long, automatic boolean"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def _state(self) -> tuple[int, dict]:
        numbers = self.log.numbers()
        return (numbers[-1], self.log.read(numbers[-1])) if numbers else (0, {})

    def create(self, chunks: DataFrame, space_id: str, at: datetime, kind: str = "manual") -> str:
        """Keep the chunks of ``space_id`` as they are now."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        number, state = self._state()
        name = uuid.uuid4().hex
        own = chunks.where(F.col("space_id") == space_id)
        own.write.parquet(f"{self.path}/data/{name}")
        n = self.spark.read.parquet(f"{self.path}/data/{name}").count()
        self.log.commit(number + 1, {**state, name: {"space_id": space_id, "kind": kind, "created_at": at.isoformat(), "chunks": n}})
        return name

    def list(self, space_id: str | None = None) -> DataFrame:
        """Newest first: snapshot, space_id, kind, created_at, chunks, automatic; a row a snapshot, not its chunks."""
        rows = [(k, s["space_id"], s["kind"], datetime.fromisoformat(s["created_at"]), s["chunks"], s["kind"] == "automatic") for k, s in self._state()[1].items() if space_id in (None, s["space_id"])]
        return self.spark.createDataFrame(rows, LIST).orderBy(F.desc("created_at"), "snapshot")

    def read(self, snapshot: str) -> DataFrame:
        if snapshot not in self._state()[1]:
            raise KeyError(snapshot)
        return self.spark.read.parquet(f"{self.path}/data/{snapshot}")

    def restore(self, snapshot: str, kept: VersionedStore) -> int:
        """A new version of ``kept`` in which the space has the snapshot's chunks and no others."""
        chunks, base = self.read(snapshot), kept.versions()[-1]
        space = self._state()[1][snapshot]["space_id"]
        others = kept.read(base).where(~F.col("space_id").eqNullSafe(F.lit(space)))
        return kept.write(others.unionByName(chunks.select(*others.columns)), after=base)

    def clean(self, now: Column, days: int = 30, keep: int = 7) -> int:
        """Drop what is too old, and automatic ones of spaces that have more than ``keep``; the number dropped."""
        number, state = self._state()
        gone = {r.snapshot for r in expired_snapshots(self.list(), now, days, keep).select("snapshot").collect()}
        if gone:
            self.log.commit(number + 1, {k: s for k, s in state.items() if k not in gone})
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for name in gone:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}"), True)
        return len(gone)
