"""Hybrid search as one plan over a set of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import EngineConfig
from ..functions import nlq
from ..operators import fts, fusion, rank, vector
from ..operators.lineage import few
from ..operators.store import MetadataFilter
from ..tables import chunks, read


def hybrid(
    spark: SparkSession,
    sf_dir: str,
    config: EngineConfig = EngineConfig(),
    where: MetadataFilter | None = None,
    reranker: Callable | None = None,
    title: bool = False,
) -> DataFrame:
    """Benchmark items as queries; item i's vector is that of embedding i.

    ``where`` holds for both lists before anything is ranked, so a filter never
    leaves a list short.  ``reranker`` (query, text) replaces scores of the fused
    hits.  Only (query_id, id, score) goes through ranking and fusion; text and
    source join last, onto the rows that are left.
    """
    config.check()
    n = config.top_k * config.candidate_factor
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    e = read(spark, sf_dir, "embeddings")
    q = e.join(items.select(F.col("query_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    docs = chunks(spark, sf_dir)
    if where is not None:
        docs = where.apply(docs)
        e = e.join(docs.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    near = vector.knn_batch(e, q, n).select("query_id", "id", F.round("score", 6).alias("score"))
    text = fts.bm25(docs, items, n, id_col="id", title_col="title" if title else None).select("query_id", "id", F.round("score", 6).alias("score"))
    fused = fusion.score_aware_rrf(near, text, config.rrf_k, n, config.score_weight)
    fused = rank.above(fused, config.min_score).drop("rank")
    most = items.count() * n  # hits of all queries
    hits = few(fused, most, config.broadcast_rows).join(docs.select("id", "source"), "id")
    if reranker is not None:
        wide = few(hits, most, config.broadcast_rows).join(docs.select("id", "text"), "id").join(items, "query_id")
        hits = rank.rerank(wide, reranker, n).drop("rank", "text", "query")
    spread = rank.diversify(hits, config.diversity)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)


def candidates_for(query, config: EngineConfig = EngineConfig()):
    """T4: results asked for by a query: many when it is broad, else half as many."""
    return F.when(nlq.is_broad(query), config.broad_k).otherwise(config.narrow_k)
