"""Fusion of ranked lists; a list is (query_id, id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(hits: DataFrame) -> DataFrame:
    """Adds the 0-based rank by score, ties by id."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1)


def min_max(score: Column, floor: float, flat: float) -> Column:
    """Score within its query's range; ``flat`` when the range is below ``floor``."""
    w = Window.partitionBy("query_id")
    lo, span = F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)
    return F.when(span < floor, F.lit(flat)).otherwise((score - lo) / span)


def _both(vec: DataFrame, fts: DataFrame, part: Column) -> DataFrame:
    rows = ranked(vec).withColumn("part", part).withColumn("list", F.lit("vector")).unionByName(ranked(fts).withColumn("part", part).withColumn("list", F.lit("fts")))
    label = F.when(F.count_distinct("list") == 2, "hybrid").when(F.max("list") == "vector", "vector").otherwise("fts")
    return rows.groupBy("query_id", "id").agg(F.sum("part").alias("score"), label.alias("found_by"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(vec: DataFrame, fts: DataFrame, k: int = 60, top: int = 10) -> DataFrame:
    """Reciprocal-rank fusion."""
    return _top(_both(vec, fts, 1 / (k + F.col("pos") + 1)), top)


def score_aware_rrf(vec: DataFrame, fts: DataFrame, k: int = 60, top: int = 10, weight: float = 0.3) -> DataFrame:
    """RRF whose parts grow with the normalised score; the best of a query is 1."""
    part = 1 / (k + F.col("pos") + 1) * (1 + weight * min_max(F.col("score"), 1e-9, 0.5))
    out = _top(_both(vec, fts, part), top)
    return out.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))


def weighted(vec: DataFrame, fts: DataFrame, alpha: float = 0.7, top: int = 10) -> DataFrame:
    """alpha x vector + (1 - alpha) x text, each normalised over its list."""
    norm = min_max(F.col("score"), 1e-6, 0.0)
    v = vec.withColumn("v", norm).select("query_id", "id", "v")
    f = fts.withColumn("f", norm).select("query_id", "id", "f")
    both = v.join(f, ["query_id", "id"], "full_outer")
    return _top(both.select("query_id", "id", (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("f", F.lit(0.0))).alias("score")), top)


def merge_variants(results: DataFrame, top: int) -> DataFrame:
    """Best score per id over the variants of a query."""
    return _top(results.groupBy("query_id", "id").agg(F.max("score").alias("score")), top)


def merge_round_robin(results: DataFrame, top: int) -> DataFrame:
    """Sub-query lists (query_id, list_no, rank, id) dealt in turn; an id keeps its first place."""
    first = results.groupBy("query_id", "id").agg(F.min(F.struct("rank", "list_no")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.rank", "at.list_no", "id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("query_id", "id", "place")
