"""Dashboards, agent metrics and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import analytics as A
from ..operators.lineage import shared_folder
from ..streaming import metrics
from ..tables import chunks, executions, read, search_events, with_views
from . import ORACLE_SQL, query

_NOW = "TIMESTAMP '2024-01-15 12:30:00'"


def now():
    return F.lit("2024-01-15 12:30:00").cast("timestamp")


@query(with_views(f"SELECT count(*) AS total, count(*) FILTER (NOT success) AS errors, 100.0 * count(*) FILTER (NOT success) / count(*) AS error_rate, (SELECT round(avg(duration_ms), 6) FROM (SELECT duration_ms FROM log WHERE success ORDER BY ts DESC, event_id DESC LIMIT 100)) AS avg_ms, count(*) FILTER (date_trunc('hour', ts) = date_trunc('hour', {_NOW})) AS this_hour FROM log", "log").replace("100.0 * count(*) FILTER (NOT success) / count(*) AS error_rate", "round(100.0 * count(*) FILTER (NOT success) / count(*), 6) AS error_rate"))
def a4_overview(spark, sf_dir):
    return A.overview(search_events(spark, sf_dir), now()).withColumns({"error_rate": F.round("error_rate", 6), "avg_ms": F.round("avg_ms", 6)})


@query(with_views("SELECT lower(trim(query)) AS query, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, round(avg(result_count), 6) AS avg_results, max(ts) AS last_used FROM log WHERE success GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "log"))
def a5_top_queries(spark, sf_dir):
    return A.top_queries(search_events(spark, sf_dir)).withColumns({"avg_ms": F.round("avg_ms", 6), "avg_results": F.round("avg_results", 6)})


@query(with_views("SELECT avg(CASE WHEN success AND result_count > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 100)", "log"))
def a6_hit_rate(spark, sf_dir):
    return A.hit_rate(search_events(spark, sf_dir))


@query(with_views("SELECT round(avg(duration_ms), 6) AS avg_ms FROM (SELECT * FROM log WHERE success ORDER BY ts DESC, event_id DESC LIMIT 50)", "log"))
def a7_performance(spark, sf_dir):
    return A.latest(search_events(spark, sf_dir).where("success"), 50, []).agg(F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


_DAYS = """SELECT agent_id, started_at::DATE AS day, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled,
    floor(avg(ms))::BIGINT AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, sum(tokens)::BIGINT AS tokens, floor(avg(tokens))::BIGINT AS avg_tokens FROM runs GROUP BY 1, 2"""


@query(with_views(_DAYS, "runs"))
def a8_agent_days(spark, sf_dir):
    return A.agent_days(executions(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("p95_ms", "p99_ms")})


@query(with_views("SELECT agent_id, started_at::DATE AS day, tool, count(*) AS n FROM runs GROUP BY ALL", "runs"))
def a8_tool_usage(spark, sf_dir):
    return A.tool_usage(executions(spark, sf_dir))


@query(with_views(f", d AS ({_DAYS}) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY day DESC) = 1", "runs"))
def a9_last_day(spark, sf_dir):
    return A.last_day(a8_agent_days(spark, sf_dir))


@query(with_views(f"SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(100.0 * count(*) FILTER (status = 'completed') / count(*), 6) AS success_rate FROM runs WHERE started_at > {_NOW} - INTERVAL 24 HOURS AND started_at <= {_NOW}", "runs"))
def a10_summary_24h(spark, sf_dir):
    return A.summary_24h(executions(spark, sf_dir), now()).withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def a11_by_hour(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, hour AS busiest_hour, n FROM (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) = 1")
def a12_busiest_hour(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("user_id").agg(F.max(F.struct("n", (-F.col("hour")).alias("h"))).alias("x"))
    return best.select("user_id", (-F.col("x.h")).alias("busiest_hour"), F.col("x.n").alias("n"))


_WORDS = "SELECT id, unnest(list_distinct(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(trim(w))))) AS word FROM chunks"


@query(with_views(f", w AS ({_WORDS}) SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, floor(sum(strlen(text)) / count(*))::BIGINT AS avg_chunk_bytes, (SELECT count(DISTINCT word) FROM w WHERE strlen(word) > 2) AS vocabulary FROM chunks", "chunks"))
def a1_corpus_stats(spark, sf_dir):
    return A.corpus_stats(chunks(spark, sf_dir))


@query(with_views(f", w AS ({_WORDS}) SELECT word, count(*) AS df, round(count(*) / (SELECT count(*) FROM chunks), 9) AS ratio FROM w WHERE strlen(word) > 2 GROUP BY word", "chunks"))
def a2_df_ratio(spark, sf_dir):
    return A.df_ratio(chunks(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query("SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT max(len(embedding)) FROM embeddings)::INT AS dimension")
def a3_engine_stats(spark, sf_dir):
    c = chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"))
    v = read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimension"))
    return c.crossJoin(F.broadcast(v))  # one row each


@query("SELECT o_custkey AS query_id, l_partkey AS result_id, count(*) FILTER (l_returnflag = 'R') AS clicks, count(*) FILTER (l_returnflag = 'A') AS ignores, round(avg(l_quantity), 6) AS avg_dwell FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def a13_clicks(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("result_id"))
    return j.agg(F.count_if(F.col("l_returnflag") == "R").alias("clicks"), F.count_if(F.col("l_returnflag") == "A").alias("ignores"), F.round(F.avg("l_quantity"), 6).alias("avg_dwell"))


@query("SELECT source AS doc_id, count(*) AS chunks, min(lower('title of ' || source)) AS title FROM documents GROUP BY source")
def a14_chunks_per_document(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.min(F.lower("title")).alias("title"))


@query("SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'Other' END AS kind, count(*) AS n, list(doc_id ORDER BY doc_id)[1:5] AS first_five FROM documents GROUP BY 1")
def a15_by_type(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise("Other").alias("kind"))
    n = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("kind").orderBy("doc_id")  # WindowGroupLimit keeps five rows a task
    five = d.withColumn("i", F.row_number().over(w)).where("i <= 5").groupBy("kind").agg(F.sort_array(F.collect_list("doc_id")).alias("first_five"))
    return n.join(five, "kind")


@query("SELECT count(*) AS total, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (n_chars < 100) AS short, count(DISTINCT lang) AS spaces, count(DISTINCT source) AS sources FROM documents")
def a16_diagnostics(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.col("n_chars") < 100).alias("short"), F.count_distinct("lang").alias("spaces"), F.count_distinct("source").alias("sources"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS folder, count(*) AS files, count(*) FILTER (url LIKE '%.html%') AS supported FROM pages GROUP BY 1")
def a17_by_folder(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("url").contains(".html")).alias("supported"))


@query("SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def a18_messages(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS full_text FROM conversations GROUP BY conv_id")
def a19_full_text(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: t["text"]), "\n\n").alias("full_text"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM conversations WHERE role = 'assistant') WHERE strlen(word) > 4 GROUP BY word ORDER BY n DESC, word LIMIT 10")
def a20_concepts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
    return c.where(F.octet_length("word") > 4).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query("SELECT source AS topic, count(*) AS n, 5 + least(0.5 * count(*), 10) AS topic_size, 4 + least(0.4 * count(*), 8) AS entity_size FROM documents GROUP BY source".replace("5 + least(0.5 * count(*), 10)", "(5 + least(0.5 * count(*), 10))::DOUBLE").replace("4 + least(0.4 * count(*), 8)", "(4 + least(0.4 * count(*), 8))::DOUBLE"))
def a21_node_sizes(spark, sf_dir):
    n = F.count(F.lit(1))
    return read(spark, sf_dir, "documents").groupBy(F.col("source").alias("topic")).agg(n.alias("n"), (5 + F.least(0.5 * n, F.lit(10.0))).alias("topic_size"), (4 + F.least(0.4 * n, F.lit(8.0))).alias("entity_size"))


@query("SELECT doc_id, regexp_extract(text, '^([^.]*)\\.', 1) AS heading, count(*) OVER (PARTITION BY regexp_extract(text, '^([^.]*)\\.', 1)) AS n FROM documents")
def a22_by_heading(spark, sf_dir):
    """Documents under their headings and how many share it; no heading gathers its documents in a row or a task."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^([^.]*)\.", 1).alias("heading"))
    return d.join(d.groupBy("heading").agg(F.count(F.lit(1)).alias("n")), "heading").select("doc_id", "heading", "n")


@query("SELECT o_orderstatus AS state, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY 1")
def a25_approximate(spark, sf_dir):
    """A25 (an extra): the sketch's count lies within a tenth of the exact one."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state"))
    exact, about = F.count_distinct("o_custkey"), F.approx_count_distinct("o_custkey", 0.02)
    return o.agg(exact.alias("exact"), (F.abs(about - exact) <= 0.1 * exact).alias("near"))


@query(with_views("""SELECT r.agent_id, round(r.rate, 6) AS success_rate, CASE WHEN rate >= 0.95 THEN 'healthy' WHEN rate >= 0.7 THEN 'degraded' ELSE 'down' END AS state, coalesce(f.n, 0) AS consecutive_failures
    FROM (SELECT agent_id, avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) AS rate FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY started_at DESC, event_id DESC) <= 100) GROUP BY agent_id) r
    LEFT JOIN (SELECT agent_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY started_at DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM runs) WHERE good = 0 GROUP BY agent_id) f USING (agent_id)""", "runs"))
def w8_health(spark, sf_dir):
    return A.health(executions(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


def _metrics(spark, sf_dir):
    """The runs merged in three batches, the middle one handed over twice."""
    runs, kept = executions(spark, sf_dir), metrics.RunningMetrics(spark, shared_folder(spark, "metrics"))
    for batch, part in enumerate((2, 0, 0, 1)):
        kept.update(runs.where(F.col("event_id") % 3 == part), min(batch, 1) if batch < 3 else 2)
    return runs, kept


@query(with_views(_DAYS.replace("round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(quantile_cont(ms, 0.99), 6) AS p99_ms, ", "true AS near, "), "runs"))
def x5_running_days(spark, sf_dir):
    """a8 from batches that were merged; ``near``: the rank of p95 and p99 is off by 0.02 of the rows or one row at most."""
    runs, kept = _metrics(spark, sf_dir)
    days = kept.days()
    rank = lambda p: F.count_if(F.col("ms") < F.col(p)), lambda p: F.count_if(F.col("ms") <= F.col(p))
    both = runs.withColumn("day", F.to_date("started_at")).join(days.select("agent_id", "day", "p95_ms", "p99_ms"), ["agent_id", "day"])
    room = F.greatest(0.02 * F.count(F.lit(1)), F.lit(1))
    good = [(rank[0](p) <= q * F.count(F.lit(1)) + room) & (rank[1](p) >= q * F.count(F.lit(1)) - room) for p, q in (("p95_ms", 0.95), ("p99_ms", 0.99))]
    near = both.groupBy("agent_id", "day").agg((good[0] & good[1]).alias("near"))
    return days.drop("p95_ms", "p99_ms").join(near, ["agent_id", "day"])


@query(ORACLE_SQL["w8_health"])
def x5_running_health(spark, sf_dir):
    """w8 from the kept state."""
    return _metrics(spark, sf_dir)[1].health().withColumn("success_rate", F.round("success_rate", 6))


@query(with_views("SELECT agent_id, event_id, started_at FROM runs QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY started_at DESC, event_id DESC) <= 5", "runs"))
def w9_recent_runs(spark, sf_dir):
    return A.latest(executions(spark, sf_dir), 5, ["agent_id"], "started_at").select("agent_id", "event_id", "started_at")


@query("WITH e AS (SELECT event_id, ts, user_id, event_type FROM events), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_type, event_id FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def w10_history(spark, sf_dir):
    return A.latest_per_key(read(spark, sf_dir, "events"), ["event_type"], ["user_id"], 3).select("user_id", "event_type", "event_id")


@query(with_views(f", s AS (SELECT date_trunc('hour', {_NOW}) - INTERVAL (i) HOUR AS hour FROM range(24) r(i)), c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, avg(duration_ms) AS a FROM log GROUP BY 1) SELECT s.hour, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS avg_ms FROM s LEFT JOIN c ON s.hour = c.hour", "log"))
def w14_hourly(spark, sf_dir):
    return A.hourly(search_events(spark, sf_dir), now()).withColumn("avg_ms", F.round("avg_ms", 6))


@query(with_views("SELECT event_id, CASE WHEN ms > 0 THEN round(tokens / (ms / 1000), 6) ELSE 0 END AS per_second FROM runs", "runs"))
def l10_tokens_per_second(spark, sf_dir):
    return executions(spark, sf_dir).select("event_id", F.round(A.tokens_per_second(F.col("tokens"), F.col("ms")), 6).alias("per_second"))


@query(with_views("SELECT agent_id, floor(avg(ms))::BIGINT AS avg_ms, count(*) AS n FROM runs GROUP BY agent_id", "runs"))
def l7_mean_time(spark, sf_dir):
    return executions(spark, sf_dir).groupBy("agent_id").agg(F.floor(F.avg("ms")).alias("avg_ms"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def l8_active(spark, sf_dir):
    starts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    return A.active_runs(starts, read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("run_id")))


@query(with_views(f"""SELECT r.agent_id, total, ok, recent FROM (SELECT agent_id, count(*) AS total, count(*) FILTER (status = 'completed') AS ok FROM runs WHERE started_at > {_NOW} - INTERVAL 24 HOURS AND started_at <= {_NOW} GROUP BY 1) r
    JOIN (SELECT agent_id, list(event_id ORDER BY started_at DESC, event_id DESC)[1:5] AS recent FROM runs GROUP BY 1) USING (agent_id)""", "runs"))
def l6_dashboard(spark, sf_dir):
    """Per agent, its last 24 hours and its latest five runs."""
    e = executions(spark, sf_dir)
    day = e.where((F.col("started_at") > now() - F.expr("INTERVAL 24 HOURS")) & (F.col("started_at") <= now())).groupBy("agent_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("ok"))
    five = A.latest(e, 5, ["agent_id"], "started_at").groupBy("agent_id").agg(F.sort_array(F.collect_list(F.struct("started_at", "event_id")), asc=False).alias("x"))
    return day.join(five.select("agent_id", F.transform("x", lambda v: v["event_id"]).alias("recent")), "agent_id")
