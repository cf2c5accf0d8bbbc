"""The chunk store: predicates, listings, deletes, joins to dimensions and versioned Parquet."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import EngineConfig
from .commits import CommitLog
from .lineage import few


@dataclass(frozen=True)
class MetadataFilter:
    """Conditions that all hold; ``None`` asks nothing."""

    space_id: str | None = None
    source: str | None = None
    after: int | None = None
    before: int | None = None
    custom: dict[str, str] = field(default_factory=dict)

    def predicate(self) -> Column | None:
        parts = []
        if self.space_id is not None:
            parts.append(F.col("space_id") == self.space_id)
        if self.source is not None:
            parts.append(F.col("source") == self.source)
        if self.after is not None:
            parts.append(F.col("created_at") >= self.after)
        if self.before is not None:
            parts.append(F.col("created_at") <= self.before)
        parts += [F.col("metadata")[k] == v for k, v in sorted(self.custom.items())]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.predicate()
        return df if p is None else df.where(p)


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is asked for; Spark broadcasts the ids when its statistics allow."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def neighbours(chunks: DataFrame, hits: DataFrame, width: int = 1, most_hits: int | None = None) -> DataFrame:
    """Each hit's text with the texts before and after it in its document.

    The range join is an equi-join: a hit asks for 2 x width + 1 positions.  Where
    the hits are known to be at most ``most_hits`` and that is few, the positions
    are broadcast and no text is shuffled before it is asked for.
    """
    ask = hits.select("query_id", F.col("id").alias("hit"), "doc_id", F.explode(F.sequence(F.greatest(F.col("chunk_index") - width, F.lit(0)), F.col("chunk_index") + width)).alias("chunk_index"))
    if most_hits is not None:
        ask = few(ask, most_hits * (2 * width + 1), EngineConfig.broadcast_rows)
    found = ask.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    return found.groupBy("query_id", F.col("hit").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"))


def first_per_document(chunks: DataFrame) -> DataFrame:
    """Title and source of each document's first chunk, by a minimum and not a sort."""
    return chunks.groupBy("doc_id").agg(F.min(F.struct("chunk_index", "id", "title", "source")).alias("x")).select("doc_id", "x.title", "x.source")


def without(chunks: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Delete by equality; nulls stay."""
    return chunks.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def without_prefix(chunks: DataFrame, prefix: str) -> DataFrame:
    """Delete by source prefix, literally: ``/docs`` takes ``/docs2`` too."""
    return chunks.where(~F.coalesce(F.col("source").startswith(prefix), F.lit(False)))


def without_folder(chunks: DataFrame, folder: str, ignore_case: bool = False) -> DataFrame:
    """Delete a folder's chunks: by normalised prefix; where none fits, by the path as given; where none, by it with forward slashes.

    A path is normalised to forward slashes, and to lower case where paths
    ignore case (sources are then kept in lower case).  Which of the three applies is one aggregate over the sources.
    """
    plain = folder.replace("\\", "/")
    prefix, exact, slashed = F.col("source").startswith(plain.lower() if ignore_case else plain), F.col("source") == folder, F.col("source") == plain
    found = chunks.agg(*(F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in (("prefix", prefix), ("exact", exact), ("slashed", slashed)))).head()
    gone = next((c for n, c in (("prefix", prefix), ("exact", exact), ("slashed", slashed)) if found[n]), F.lit(False))
    return chunks.where(~F.coalesce(gone, F.lit(False)))


def link_rates(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, files, linked, failed, success_rate) for folders (folder) and files (folder, ok); no rate without files."""
    per = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.count_if("ok").alias("linked"))
    out = folders.join(per, "folder", "left").na.fill(0, ["files", "linked"])
    return out.select("folder", "files", "linked", (F.col("files") - F.col("linked")).alias("failed"), F.when(F.col("files") > 0, F.col("linked") * 100.0 / F.col("files")).alias("success_rate"))


def documents_of(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The chunks of the documents asked for (doc_id), as an equality filter and not a search."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def orphans(chunks: DataFrame, spaces: DataFrame) -> DataFrame:
    """Chunks whose space is missing or unknown; null and empty spaces count."""
    return chunks.join(spaces.select("space_id").distinct(), "space_id", "left_anti")


def space_counts(spaces: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks and documents of each space, zeros included."""
    n = chunks.groupBy("space_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"))
    return spaces.join(n, "space_id", "left").na.fill(0, ["chunks", "documents"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def latest_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of each key with the largest ``order``."""
    names = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("x")).select(*key, *(F.col(f"x.{n}") for n in names))


def chat_list(chats: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of chats (conv_id, pinned, updated_at) with their place: pinned first, then the latest."""
    order = [F.desc("pinned"), F.desc("updated_at"), F.col("conv_id")]
    first = chats.orderBy(*order).limit(most)  # a report of bounded size, so one window over it is small
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def expired_snapshots(snapshots: DataFrame, now: Column, days: int = 30, keep: int = 7) -> DataFrame:
    """Older than ``days``, or automatic in a space that has more than ``keep``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("space_id"))
    old = F.col("created_at") < now - F.make_interval(days=F.lit(days))
    return snapshots.withColumn("_n", n).where(old | (F.col("automatic") & (F.col("_n") > keep))).drop("_n")


class VersionedStore:
    """Parquet versions below one folder; the largest number is current.

    A write makes a new version, so readers of the old one are not disturbed,
    and a delete or upsert that reads the current version can write the next.
    Data is written first and becomes a version by a commit that fails with
    ``Conflict`` where another writer has taken the number, so no rows are lost.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def versions(self) -> list[int]:
        return self.log.numbers()

    def folder(self, version: int | None = None) -> str:
        return f"{self.path}/{self.log.read(self.versions()[-1] if version is None else version)['folder']}"

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def write(self, df: DataFrame, by: str | None = None, after: int | None = None) -> int:
        """``after``: the version that ``df`` was made from, if not the current one."""
        at = (self.versions() or [0])[-1] + 1 if after is None else after + 1
        folder = f"data-{uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{folder}")
        self.log.commit(at, {"folder": folder})
        return at

    def append(self, df: DataFrame) -> int:
        base = (self.versions() or [0])[-1]
        return self.write(self.read(base).unionByName(df) if base else df, after=base)

    def delete(self, condition: Column) -> int:
        """The number of rows that went."""
        base = self.versions()[-1]
        old = self.read(base)
        gone = old.where(F.coalesce(condition, F.lit(False))).count()
        if gone:
            self.write(old.where(~F.coalesce(condition, F.lit(False))), after=base)
        return gone

    def compact(self, file_bytes: int = 128 << 20) -> int:
        """Write the current version again in files of about ``file_bytes``; the number of files there are then."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder())
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        n = max(1, -(-size // file_bytes))
        self.write(self.read().repartition(int(n)))
        return int(n)

    def clear(self) -> int:
        return self.write(self.read().limit(0))
