"""Folder ingest that can be stopped and goes on: a ledger of what was read.

Each batch of files is written as texts and then committed to the ledger with one row
per file: path, length, modification time, state (``read``, ``failed``, ``gone``) and error.  A run
lists the folder, leaves out files that the ledger has with the same length and time,
and reads the rest batch by batch; so a run that was stopped or lost goes on after its
last batch, changed files are read again, and files that are no longer there are marked
``gone``.  A failed file is tried again when it changes, or with ``retry``.

What the driver holds are the paths of one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.commits import CommitLog
from ..operators.lineage import cut
from . import files

LEDGER = "path string, length long, modified timestamp, state string, error string, batch long"
TEXTS = "path string, format string, text string, batch long"
BATCH = 1000


class FolderIngest:
    """Texts and ledger below ``home``."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self.log = CommitLog(spark, f"{self.home}/log")

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.home}/{name}/{self.log.read(n)['batch']}" for n in self.log.numbers()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        """The last row of each path."""
        order = Window.partitionBy("path").orderBy(F.desc("batch"))
        return self._table("ledger", LEDGER).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

    def documents(self) -> DataFrame:
        """(path, format, text) as last read, of files that are still there."""
        last = self.ledger().where("state = 'read'").select("path", "batch")
        return self._table("texts", TEXTS).join(last, ["path", "batch"]).drop("batch")

    def todo(self, folder: str, retry: bool = False) -> DataFrame:
        """(path, length, modified) of supported files that are new or changed."""
        there = files.list_files(self.spark, folder).where(files.supported(F.col("path")))
        known = self.ledger().where("state <> 'gone'" + (" AND state <> 'failed'" if retry else ""))
        return there.join(known.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")

    def _commit(self, rows: DataFrame, texts: DataFrame | None) -> None:
        at, name = (self.log.numbers() or [0])[-1] + 1, uuid.uuid4().hex
        if texts is not None:
            texts.withColumn("batch", F.lit(at).cast("long")).write.parquet(f"{self.home}/texts/{name}")
        else:
            self.spark.createDataFrame([], TEXTS).write.parquet(f"{self.home}/texts/{name}")
        rows.withColumn("batch", F.lit(at).cast("long")).write.parquet(f"{self.home}/ledger/{name}")
        self.log.commit(at, {"batch": name})

    def run(self, folder: str, batch_files: int = BATCH, progress: Callable[[int, int], bool] | None = None, retry: bool = False) -> int:
        """Read what is to do; the number of files read.  ``progress(done, total)`` returns False to stop after a batch."""
        gone = self.ledger().where("state <> 'gone'").join(files.list_files(self.spark, folder).select("path"), "path", "left_anti").where(F.col("path").startswith(self._root(folder)))
        gone = cut(gone.select("path", "length", "modified", F.lit("gone").alias("state"), F.lit(None).cast("string").alias("error")))
        if not gone.isEmpty():
            self._commit(gone, None)
        todo = cut(self.todo(folder, retry))
        total, done = todo.count(), 0
        batches = -(-total // batch_files)
        for b in range(batches):
            part = todo.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == b)
            paths = [r.path for r in part.select("path").collect()]  # about ``batch_files``
            if not paths:
                continue
            read = self.spark.read.format("binaryFile").load(paths)
            text = read.select("path", files.format_of(F.col("path")).alias("format"), files.file_text(F.col("path"), F.col("content")).alias("x"))
            text = cut(text.select("path", "format", "x.text", "x.error"))
            state = F.when(F.col("error").isNull(), "read").otherwise("failed")
            self._commit(part.join(text.select("path", state.alias("state"), "error"), "path").select("path", "length", "modified", "state", "error"), text.where("error IS NULL").select("path", "format", "text"))
            done += len(paths)
            if progress is not None and not progress(done, total):
                break
        return done

    def _root(self, folder: str) -> str:
        """The folder as Spark writes its files' paths."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


def preview_files(listed: DataFrame, folder: str, depth: int = 5, sample: int = 100) -> DataFrame:
    """(path, name, format, length): the first ``sample`` supported files, by path, at most ``depth`` levels below ``folder`` (a report)."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")  # noqa: E731  schemes and doubled slashes differ between stores
    below = F.substring(plain(F.col("path")), F.length(plain(F.lit(folder.rstrip("/")))) + 2, F.length("path"))
    near = listed.where(files.supported(F.col("path")) & (F.size(F.split(below, "/")) <= depth))
    return near.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), files.format_of(F.col("path")).alias("format"), "length").orderBy("path").limit(sample)
