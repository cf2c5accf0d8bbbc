"""A kept IVF-PQ index for cosine search, exact by bounds.

Two Parquet tables below one folder, both in the order of their list: ``codes``
(list_id, id, code, off) and ``vectors`` (list_id, id, v).  A vector at length 1 is
its list's centroid plus a residual, and the residual is coded by a product
quantiser: one byte for each few dimensions.  ``off`` is the distance between the
vector and what its code stands for, so for a query q at length 1

    <q, centroid> + table look-ups - off <= <q, x> <= <q, centroid> + table look-ups + off.

A search reads codes only, skips a list whose widest residual cannot reach a query's
k-th lower bound, and keeps the vectors whose upper bound reaches it.  Only this
short list meets its vectors.  With bounds on, the result is that of the exact search;
with ``short`` it is cut to the best ``short`` by estimate, in each batch and at last,
which is the usual approximate search.

Centroids and code words are fitted on at most ``sample`` vectors; every vector is
indexed.  Vectors without length score 0 and are kept in list 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .vector import PLACES, matrix, query_blocks

Batches = Iterator[pa.RecordBatch]
SAMPLE, ROUNDS, WORDS = 10_000, 8, 256
#: Queries whose look-up tables a task holds at a time.
TABLES = 128
SLACK = 2 * 10.0**-PLACES  # more than rounding of scores and of the estimate can lose


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ (-2 * c.T) + (c**2).sum(1)).argmin(1)


class Codebook:
    """Centroids of the lists and code words of the residuals."""

    def __init__(self, centroids: np.ndarray, words: list[np.ndarray]):
        self.centroids, self.words = centroids, words

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, width: int, rounds: int = ROUNDS, seed: int = 5) -> "Codebook":
        rng = np.random.default_rng(seed)
        c = kmeans(x, lists, rounds, rng)
        rest = x - c[nearest(x, c)]
        return cls(c, [kmeans(rest[:, i : i + width], WORDS, rounds, rng) for i in range(0, x.shape[1], width)])

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and distances to what the codes stand for."""
        own = nearest(x, self.centroids)
        rest, at = x - self.centroids[own], 0
        codes = np.empty((len(x), len(self.words)), np.uint8)
        for j, w in enumerate(self.words):
            part = rest[:, at : at + w.shape[1]]
            codes[:, j] = nearest(part, w)
            rest[:, at : at + w.shape[1]] = part - w[codes[:, j]]
            at += w.shape[1]
        return own, codes, np.linalg.norm(rest, axis=1)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What lists and codes stand for."""
        return self.centroids[own] + np.concatenate([np.zeros((len(own), 0)), *(w[codes[:, j]] for j, w in enumerate(self.words))], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, part, code word): inner products."""
        out, at = np.zeros((len(q), len(self.words), WORDS)), 0
        for j, w in enumerate(self.words):
            out[:, j, : len(w)] = q[:, at : at + w.shape[1]] @ w.T
            at += w.shape[1]
        return out

    def dump(self) -> str:
        return json.dumps({"centroids": self.centroids.tolist(), "words": [w.tolist() for w in self.words]})

    @classmethod
    def load(cls, text: str) -> "Codebook":
        d = json.loads(text)
        return cls(np.array(d["centroids"]), [np.array(w) for w in d["words"]])


class IvfPq:
    """The index below ``path``; ``build`` writes it, ``search`` reads it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, width: int = 2, sample: int = SAMPLE) -> "IvfPq":
        """``lists`` is the root of the number of rows if not given; ``width`` dimensions share a byte."""
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        lists = lists or max(4, round(rows.count() ** 0.5))
        x = matrix(rows.where("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks())  # a documented bound
        book = Codebook.fit(x, lists, width) if len(x) else Codebook(np.zeros((1, 0)), [])
        sent = self.spark.sparkContext.broadcast(book)

        def code(batches: Batches) -> Batches:
            book = sent.value
            for b in batches:
                x = matrix(b.column(1), book.centroids.shape[1])
                own, codes, off = book.code(x)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), v], ["id", "list_id", "code", "off", "v"])

        kind = rows.schema["id"].dataType.simpleString()
        coded = rows.mapInArrow(code, f"id {kind}, list_id int, code binary, off double, v array<double>").repartitionByRange("list_id", "id").sortWithinPartitions("list_id", "id")
        coded.write.mode("overwrite").parquet(f"{self.path}/vectors")  # codes are read from it, so both hold the same coding
        kept = self.spark.read.parquet(f"{self.path}/vectors")
        kept.select("list_id", "id", "code", "off").repartitionByRange("list_id", "id").sortWithinPartitions("list_id", "id").write.mode("overwrite").parquet(f"{self.path}/codes")
        self.spark.createDataFrame([(book.dump(),)], "book string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/book")
        return self

    def short_list(self, queries: DataFrame, k: int, query_col: str = "query_id", short: int | None = None) -> DataFrame:
        """(query_id, id, list_id): the vectors whose code does not rule them out."""
        book = Codebook.load(self.spark.read.parquet(f"{self.path}/book").first().book)
        codes = self.spark.read.parquet(f"{self.path}/codes")
        cores = self.spark.sparkContext.defaultParallelism
        if codes.rdd.getNumPartitions() < cores:  # small files share a split; what is moved is bounded by the cores, as in lineage.spread
            codes = codes.repartitionByRange(cores, "list_id", "id").sortWithinPartitions("list_id", "id")
        kind, query_kind = codes.schema["id"].dataType.simpleString(), queries.schema[query_col].dataType.simpleString()

        def against(names: pa.Array, q: np.ndarray) -> DataFrame:
            q = q if q.shape[1] == book.centroids.shape[1] else np.zeros((len(q), book.centroids.shape[1]))
            sent = self.spark.sparkContext.broadcast((names, q, book))

            def run(batches: Batches) -> Batches:
                names, all_q, book = sent.value
                all_least = np.full(len(all_q), 0.0)  # scores are not below 0
                all_held = np.full((len(all_q), k), -1.0)
                for b in batches:
                    if not b.num_rows:
                        continue
                    own, off = b.column(0).to_numpy(), b.column(3).to_numpy()
                    code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    sizes, widest, stands = np.diff(np.append(at, len(own))), np.maximum.reduceat(off, at), book.decode(own, code)
                    for start in range(0, len(all_q), TABLES):  # look-up tables are much wider than queries, so few are held at a time
                        q, least, held = all_q[start : start + TABLES], all_least[start : start + TABLES], all_held[start : start + TABLES]
                        size = np.linalg.norm(q, axis=1)
                        # A code's reach is the length of its words' best case; the list is left if even that is too little.
                        best = q @ book.centroids[own[at]].T + book.tables(q).max(2).sum(1)[:, None] + widest * size[:, None]
                        rows = np.flatnonzero(np.repeat((best >= least[:, None] - SLACK).any(0), sizes))
                        if not len(rows):
                            continue
                        about, slack = q @ stands[rows].T, size[:, None] * off[rows]  # what the look-ups sum to, as one product
                        low, high = np.maximum(about - slack, 0), np.maximum(about + slack, 0)
                        held[:] = np.partition(np.concatenate((held, low), 1), len(rows), axis=1)[:, len(rows) :]
                        least[:] = np.maximum(least, held.min(1))
                        keep = high >= least[:, None] - SLACK
                        if short is not None and short < len(rows):  # the best by estimate, and those that give the k-th lower bound
                            good = np.where(keep, about, -np.inf)
                            few = good >= np.partition(good, len(rows) - short, axis=1)[:, len(rows) - short, None]
                            keep &= few | (low >= least[:, None])
                        who, which = np.nonzero(keep)
                        if len(who):
                            place = pa.array(rows[which])
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(who + start)), b.column(1).take(place), b.column(0).take(place), pa.array(about[keep]), pa.array(low[keep]), pa.array(high[keep])], ["query_id", "id", "list_id", "about", "low", "high"])

            return codes.mapInArrow(run, f"query_id {query_kind}, id {kind}, list_id int, about double, low double, high double")

        found = query_blocks(queries, query_col, against)
        by_low, by_about = Window.partitionBy("query_id").orderBy(F.desc("low"), "id"), Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
        kth = found.withColumn("r", F.row_number().over(by_low)).where(F.col("r") == k).select("query_id", F.col("low").alias("kth"))
        out = found.join(kth, "query_id", "left").where(F.col("high") >= F.coalesce("kth", F.lit(0.0)) - SLACK)
        if short is not None:
            out = out.withColumn("r", F.row_number().over(by_about)).where(F.col("r") <= short)
        return out.select("query_id", "id", "list_id").distinct()  # rows that share an id come back with the join

    def search(self, queries: DataFrame, k: int, query_col: str = "query_id", vec_col: str = "vector", short: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank) of (query_id, vector); ``near`` is their short list, where it is at hand."""
        from .vector import dot, l2_norm

        if near is None:
            near = self.short_list(queries.select(query_col, F.col(vec_col).alias("vector")), k, query_col, short)
        vectors = self.spark.read.parquet(f"{self.path}/vectors").select("list_id", "id", "v")
        asked = queries.select(F.col(query_col).alias("query_id"), F.col(vec_col).alias("qv"))
        both = near.join(vectors, ["list_id", "id"]).join(asked, "query_id")
        size = l2_norm(F.col("qv"))
        score = F.when(size > 1e-12, F.greatest(dot(F.col("v"), F.col("qv")) / size, F.lit(0.0))).otherwise(0.0)
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), "id")
        return both.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
