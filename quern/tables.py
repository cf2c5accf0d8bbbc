"""Views of the given tables as the engine's chunks, queries and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: a source is a document of many chunks, a language a space."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("doc_id"),
        F.floor(F.col("doc_id") / 20).alias("chunk_index"),
        "text",
        F.concat(F.lit("title of "), "source").alias("title"),
        F.col("source"),
        F.col("lang").alias("space_id"),
        (1_700_000_000 + F.col("doc_id") * 3600).alias("created_at"),
        "n_chars",
    )


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log: query, ts, duration_ms, result_count, success."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.initcap("event_type"), F.lit(" "), (F.col("user_id") % 7).cast("string"), F.lit(" ")).alias("query"),
        "ts",
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("result_count"),
        (F.col("event_type") != "error").alias("success"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent runs: agent_id, started_at, ms, tokens, status."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 10).alias("agent_id"),
        F.col("ts").alias("started_at"),
        F.floor(F.abs("value")).cast("bigint").alias("ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "cancelled").otherwise("completed").alias("status"),
        F.col("event_type").alias("tool"),
    )


#: The same views for DuckDB.
SQL = {
    "chunks": "SELECT doc_id AS id, source AS doc_id, doc_id // 20 AS chunk_index, text, 'title of ' || source AS title, source, lang AS space_id, 1700000000 + doc_id * 3600 AS created_at, n_chars FROM documents",
    "log": "SELECT event_id, upper(event_type[1]) || event_type[2:] || ' ' || (user_id % 7)::VARCHAR || ' ' AS query, ts, value AS duration_ms, (props::JSON->>'k')::INT AS result_count, event_type <> 'error' AS success FROM events",
    "runs": "SELECT event_id, user_id % 10 AS agent_id, ts AS started_at, floor(abs(value))::BIGINT AS ms, (props::JSON->>'k')::BIGINT AS tokens, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' ELSE 'completed' END AS status, event_type AS tool FROM events",
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after a WITH that defines the named views; ``sql`` may go on with ', name AS (...) SELECT'."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {head} {sql}"
