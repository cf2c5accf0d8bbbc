"""Retrieval metrics from results (query_id, id, rank from 1) and qrels (query_id, id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def per_query(results: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, rr and recall, precision and ndcg at each k; queries without results score 0.

    Recall divides by all graded ids, precision by the results seen (at most k).
    """
    judged = results.join(qrels, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0.0)))
    hit = F.col("grade") > 0
    found = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        *(F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"h{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"g{k}") for k in ks),
    )
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")))
    best = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("all"), *(F.sum(F.when(F.col("i") <= k, F.col("grade") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias(f"b{k}") for k in ks))
    both = best.join(found, "query_id", "left").na.fill(0, ["n", *(f"h{k}" for k in ks), *(f"g{k}" for k in ks)])
    cols = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr")]
    for k in ks:
        cols += [
            (F.col(f"h{k}") / F.col("all")).alias(f"recall_{k}"),
            (F.col(f"h{k}") / F.greatest(F.least(F.lit(k), F.col("n")), F.lit(1))).alias(f"precision_{k}"),
            F.when(F.col(f"b{k}") > 0, F.col(f"g{k}") / F.col(f"b{k}")).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    return both.select("query_id", *cols)


def mean(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """One row: averages over queries, and the share of queries with a hit at each k."""
    names = [c for c in metrics.columns if c != "query_id"]
    avg = [F.coalesce(F.avg(c), F.lit(0.0)).alias("mrr" if c == "rr" else c) for c in names]
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *avg, *(F.coalesce(F.avg((F.col(f"recall_{k}") > 0).cast("double")), F.lit(0.0)).alias(f"hit_rate_{k}") for k in ks))


def report(means: DataFrame, ks: list[int]) -> DataFrame:
    """The averages as one line of text each."""
    lines = [F.format_string("queries: %d", "n_queries"), F.format_string("MRR: %.4f", "mrr")]
    lines += [F.format_string(f"@{k}: recall %.4f, precision %.4f, nDCG %.4f, hit rate %.4f", f"recall_{k}", f"precision_{k}", f"ndcg_{k}", f"hit_rate_{k}") for k in ks]
    return means.select(F.explode(F.array(*lines)).alias("line"))


def citation_validity(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """``cited`` (query_id, path, line) with reason: null when valid, else ``file`` or ``line``.

    ``sources`` has query_id, path and ranges (array<struct<first,last>>).  A path
    fits a source when either ends with the other; a line must lie in a range of a
    source that fits.  The pairs are those of one answer and its sources.
    """
    slash = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    s = sources.select("query_id", slash(F.col("path")).alias("_source"), "ranges")
    rows = cited.groupBy(*cited.columns).agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_path", slash(F.col("path")))  # repeated citations are judged once
    fits = F.col("_source").endswith(F.col("_path")) | F.col("_path").endswith(F.col("_source"))
    inside = F.exists("ranges", lambda r: F.col("line").between(r["first"], r["last"]))
    both = rows.join(s, "query_id", "left").groupBy("_n", *cited.columns).agg(F.max(fits).alias("_file"), F.max(fits & inside).alias("_line"))
    reason = F.when(~F.coalesce("_file", F.lit(False)), "file").when(F.col("line").isNotNull() & ~F.coalesce("_line", F.lit(False)), "line")
    return both.withColumn("reason", reason).select(*cited.columns, "reason", F.explode(F.array_repeat(F.lit(1), F.col("_n"))).alias("_again")).drop("_again")


def citation_confidence(checked: DataFrame) -> DataFrame:
    """(query_id, total, valid, confidence) of ``citation_validity``'s rows."""
    return checked.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("reason").isNull()).alias("valid")).withColumn("confidence", F.col("valid") / F.col("total"))
