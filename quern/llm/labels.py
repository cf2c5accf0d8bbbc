"""Bounded labelled samples and folds for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "UTF-8")), F.lit(folds)), F.lit(0))


def hash_sample(ids: DataFrame, limit: int, salt: str) -> DataFrame:
    """At most ``limit`` rows of ``ids`` (doc_id first), the same ones each time."""
    return ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(limit)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): 0/1 per id; several labels of an id are averaged, a tie is 1; nulls are no label."""
    y = F.col(column).cast("double")
    return labels.where(F.col("doc_id").isNotNull() & y.isNotNull()).groupBy("doc_id").agg((F.avg(y) >= 0.5).cast("int").alias("y"))
