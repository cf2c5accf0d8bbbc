"""Query-log and agent analytics; every operator that looks back takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(log: DataFrame, n: int, by: list[str], ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest n rows of each group; of all rows when ``by`` is empty (a top-k, not a global window)."""
    if not by:
        return log.orderBy(F.desc(ts), F.desc(tie)).limit(n)
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("_n") <= n).drop("_n")


def overview(log: DataFrame, now: Column) -> DataFrame:
    """Totals, error rate in %, mean time of the latest 100 successes, queries in the current clock hour."""
    total = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("success")).alias("errors"),
        F.count_if(F.date_trunc("hour", "ts") == F.date_trunc("hour", now)).alias("this_hour"),
    )
    recent = latest(log.where("success"), 100, []).agg(F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms"))
    return total.crossJoin(F.broadcast(recent)).select("total", "errors", F.when(F.col("total") > 0, 100.0 * F.col("errors") / F.col("total")).otherwise(0.0).alias("error_rate"), "avg_ms", "this_hour")


def top_queries(log: DataFrame, n: int = 10) -> DataFrame:
    return (
        log.where("success")
        .groupBy(F.lower(F.trim("query")).alias("query"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_ms"), F.avg("result_count").alias("avg_results"), F.max("ts").alias("last_used"))
        .orderBy(F.desc("n"), "query")
        .limit(n)
    )


def hit_rate(log: DataFrame, last: int = 100) -> DataFrame:
    """Share of the latest events with results; errors are misses, an empty log is 1."""
    hit = F.col("success") & (F.coalesce("result_count", F.lit(0)) > 0)
    return latest(log, last, []).agg(F.coalesce(F.avg(hit.cast("double")), F.lit(1.0)).alias("hit_rate"))


def hourly(log: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(hour, n, avg_ms) for the last hours, with zeros for hours without events."""
    top = F.date_trunc("hour", now)
    spine = log.sparkSession.range(hours).select((top - F.make_interval(hours=F.col("id").cast("int"))).alias("hour"))
    counts = log.where((F.col("ts") > top - F.make_interval(hours=F.lit(hours))) & (F.col("ts") < top + F.make_interval(hours=F.lit(1)))).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg_ms"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"))


def agent_days(runs: DataFrame) -> DataFrame:
    """Per agent and day: counts by status, times with p95 and p99, tokens."""
    day = F.to_date("started_at").alias("day")
    return runs.groupBy("agent_id", day).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.floor(F.avg("ms")).alias("avg_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
        F.percentile("ms", F.lit(0.95)).alias("p95_ms"),
        F.percentile("ms", F.lit(0.99)).alias("p99_ms"),
        F.sum("tokens").alias("tokens"),
        F.floor(F.avg("tokens")).alias("avg_tokens"),
    )


def tool_usage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("agent_id", F.to_date("started_at").alias("day"), "tool").agg(F.count(F.lit(1)).alias("n"))


def last_day(days: DataFrame) -> DataFrame:
    """The row of each agent's latest day."""
    return days.groupBy("agent_id").agg(F.max_by(F.struct(*days.columns), "day").alias("x")).select("x.*")


def summary_24h(runs: DataFrame, now: Column) -> DataFrame:
    recent = runs.where((F.col("started_at") > now - F.expr("INTERVAL 24 HOURS")) & (F.col("started_at") <= now))
    ok = F.count_if(F.col("status") == "completed")
    n = F.count(F.lit(1))
    return recent.agg(n.alias("total"), ok.alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.when(n > 0, 100.0 * ok / n).otherwise(0.0).alias("success_rate"))


def health_state(rate: Column) -> Column:
    return F.when(rate >= 0.95, "healthy").when(rate >= 0.7, "degraded").otherwise("down")


def health(runs: DataFrame, last: int = 100) -> DataFrame:
    """Success share of each agent's latest runs, its state, and failures since the last success."""
    recent = latest(runs, last, ["agent_id"], "started_at")
    ok = F.col("status") == "completed"
    share = recent.groupBy("agent_id").agg(F.avg(ok.cast("double")).alias("success_rate"))
    at = F.struct("started_at", "event_id")
    good = runs.groupBy("agent_id").agg(F.max(F.when(ok, at)).alias("good"))
    failing = runs.join(good, "agent_id").where((F.col("good").isNull() | (at > F.col("good")))).groupBy("agent_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return share.join(failing, "agent_id", "left").select("agent_id", "success_rate", health_state(F.col("success_rate")).alias("state"), F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"))


def active_runs(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Started runs without an end."""
    return starts.join(ends, "run_id", "left_anti")


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, tokens / (ms / 1000)).otherwise(0.0)


def latest_per_key(log: DataFrame, key: list[str], group: list[str], cap: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest row of each key within its group, newest first, at most ``cap`` of a group (a history feature)."""
    one = latest(log, 1, [*group, *key], ts, tie)
    return latest(one, cap, group, ts, tie)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, documents, vocabulary and mean chunk size in whole bytes."""
    words = chunks.select(F.explode(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda w: F.lower(F.trim(w))))).alias("w")).where(F.octet_length("w") > 2)
    vocabulary = words.distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.floor(F.sum(F.octet_length("text")) / F.count(F.lit(1))).alias("avg_chunk_bytes")).crossJoin(F.broadcast(vocabulary))


def df_ratio(chunks: DataFrame) -> DataFrame:
    """Share of chunks that hold each word."""
    n = chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    words = chunks.select(F.explode(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda w: F.lower(F.trim(w))))).alias("word")).where(F.octet_length("word") > 2)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("word", "df", (F.col("df") / F.col("n")).alias("ratio"))
