"""Activity, memory and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import activity as A, memory as M
from ..operators.lineage import cut
from ..streaming import working_set
from ..tables import read
from . import query


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def _log(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("kind"), "value")


_S = "s0 AS (SELECT *, floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w))) / 60) AS gap FROM events {} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(CASE WHEN gap > {} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s0)"


@query("WITH " + _S.format("", 30) + " SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS start, max(ts) AS stop FROM s GROUP BY 1, 2")
def w5_sessions(spark, sf_dir):
    s = A.sessions(_log(spark, sf_dir))
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("stop"))


@query("WITH " + _S.format("WHERE ts <= TIMESTAMP '2024-01-20'", 600) + " SELECT user_id, event_id FROM s QUALIFY session = max(session) OVER (PARTITION BY user_id)")
def w5_last_session(spark, sf_dir):
    return A.last_session(_log(spark, sf_dir), _now(), 600).select("user_id", "event_id")


@query("""WITH p AS (SELECT user_id, event_type AS first, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second FROM events), n AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1),
    c AS (SELECT user_id, first, second, count(*) AS n FROM p WHERE second IS NOT NULL GROUP BY ALL),
    k AS (SELECT * FROM c WHERE n > 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, second) <= 5)
    SELECT user_id, first, second, k.n, round(k.n / n.total, 6) AS confidence FROM k JOIN n USING (user_id)""")
def w6_bigrams(spark, sf_dir):
    return A.bigrams(_log(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


_T3 = "SELECT lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS b, event_type AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT a || ' > ' || b || ' > ' || c AS path, count(*) AS n, least(round(0.1 * count(*), 6), 1.0) AS weight FROM ({_T3}) WHERE a IS NOT NULL GROUP BY 1 UNION ALL SELECT b || ' > ' || c, count(*), least(round(0.1 * count(*), 6), 1.0) FROM ({_T3}) WHERE b IS NOT NULL GROUP BY 1")
def w7_transitions(spark, sf_dir):
    log = _log(spark, sf_dir)
    return A.transitions(log, 3).unionByName(A.transitions(log, 2))


@query("SELECT before, after, count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type AS after FROM events) WHERE before IS NOT NULL AND before <> after GROUP BY ALL")
def w7_changes(spark, sf_dir):
    return A.changes(_log(spark, sf_dir), "kind")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS ignores, round(avg(value) FILTER (event_type = 'view'), 6) AS avg_dwell,
    round(greatest(-0.5, least(1.0, 0.3 * count(*) FILTER (event_type = 'click') - 0.2 * count(*) FILTER (event_type = 'error') + CASE WHEN avg(value) FILTER (event_type = 'view') > 10 THEN 0.15 ELSE 0 END)), 6) AS boost FROM events GROUP BY user_id""")
def v15_personalisation(spark, sf_dir):
    kind = lambda k: F.col("kind") == k
    c = _log(spark, sf_dir).groupBy("user_id").agg(F.count_if(kind("click")).alias("clicks"), F.count_if(kind("error")).alias("ignores"), F.avg(F.when(kind("view"), F.col("value"))).alias("avg_dwell"))
    return A.boosts(c).withColumns({"boost": F.round("boost", 6), "avg_dwell": F.round("avg_dwell", 6)})


#: Conversation turns as memories.
_MEM = """WITH m AS (SELECT conv_id * 100 + turn AS id, conv_id, CASE role WHEN 'user' THEN 'Conversation' WHEN 'system' THEN 'Decision' ELSE 'Learning' END AS type, text AS content, regexp_extract_all(text, '[A-Z][a-z]+')[1:turn] AS entities,
    TIMESTAMP '2024-01-01' + INTERVAL (conv_id % 19) DAY AS created_at FROM conversations),
    i AS (SELECT *, least(0.3 + CASE type WHEN 'Decision' THEN 0.3 WHEN 'Learning' THEN 0.25 ELSE 0.1 END + CASE WHEN strlen(content) > 200 THEN 0.15 WHEN strlen(content) > 50 THEN 0.05 ELSE 0 END + CASE WHEN len(entities) > 3 THEN 0.1 WHEN len(entities) >= 1 THEN 0.05 ELSE 0 END, 1.0) AS importance FROM m)"""


def _memories(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    m = c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", F.when(F.col("role") == "user", "Conversation").when(F.col("role") == "system", "Decision").otherwise("Learning").alias("type"), F.col("text").alias("content"),
        F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), F.lit(1), F.col("turn").cast("int")).alias("entities"), F.timestamp_add("DAY", (F.col("conv_id") % 19).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("created_at"),
    )
    return m.withColumn("importance", M.importance(F.col("type"), F.col("content"), F.col("entities"), F.lit(0)))


@query(_MEM + " SELECT id, round(importance, 6) AS importance FROM i")
def f31_importance(spark, sf_dir):
    return _memories(spark, sf_dir).select("id", F.round("importance", 6).alias("importance"))


@query(_MEM + """, s AS (SELECT id, round(0.6 * ((contains(lower(content), 'the')::INT + contains(lower(content), 'que')::INT) / 2) + 0.25 * 0.5 ** ((epoch(TIMESTAMP '2024-01-20') - epoch(created_at)) / 86400.0 / 7.0) + 0.15 * importance, 9) AS score FROM i)
    SELECT id, round(score, 6) AS score FROM s WHERE score > 0.05 ORDER BY s.score DESC, id LIMIT 20""")
def f32_retrieve(spark, sf_dir):
    """Top 20 by hybrid score (a top-k report)."""
    return M.retrieve(_memories(spark, sf_dir), "the que", _now(), 20).select("id", F.round("score", 6).alias("score"))


@query(_MEM + " SELECT id FROM i WHERE round(importance, 6) >= 0.6 AND type IN ('Learning', 'Decision') AND created_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-15'")
def p11_memory_filter(spark, sf_dir):
    m = _memories(spark, sf_dir).withColumn("importance", F.round("importance", 6))
    return M.hard_filter(m, 0.6, ("Learning", "Decision"), F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")).select("id")


@query(_MEM + " SELECT id FROM i WHERE NOT (created_at < TIMESTAMP '2024-01-05' OR round(importance, 6) < 0.5 OR regexp_matches(content, 'tion'))")
def p12_forget(spark, sf_dir):
    m = _memories(spark, sf_dir).withColumn("importance", F.round("importance", 6))
    return M.forget(m, F.lit("2024-01-05").cast("timestamp"), 0.5, "tion").select("id")


@query(_MEM + " SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY round(importance, 6) DESC, id) AS r FROM i) WHERE n <= 4 OR r <= 2")
def x6_memory_cap(spark, sf_dir):
    return M.keep_most_important(_memories(spark, sf_dir).withColumn("importance", F.round("importance", 6)), "conv_id", 2).select("id")


@query(_MEM + " SELECT id FROM i QUALIFY sum(strlen(content)) OVER (PARTITION BY conv_id ORDER BY round(importance, 6) DESC, id ROWS UNBOUNDED PRECEDING) <= 800")
def x7_memory_bytes(spark, sf_dir):
    return M.within_bytes(_memories(spark, sf_dir).withColumn("importance", F.round("importance", 6)), "conv_id", 800).select("id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w11_last_messages(spark, sf_dir):
    """The last three messages of a session."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).where("n <= 3").select("conv_id", "turn", "role")


@query("SELECT conv_id, arg_max(text, turn) AS last_question FROM conversations WHERE role = 'user' AND length(text) > 20 GROUP BY conv_id")
def w16_last_question(spark, sf_dir):
    """The last substantive user message."""
    c = read(spark, sf_dir, "conversations").where((F.col("role") == "user") & (F.length("text") > 20))
    return c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_question"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (n <= 5) AS recent, count(*) FILTER (n > 5) AS older, coalesce(string_agg(left(text, 30), ' | ' ORDER BY turn) FILTER (n > 5), '') AS summary FROM r GROUP BY conv_id""")
def w17_context(spark, sf_dir):
    """The last five turns verbatim, the older ones in short."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = read(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(w)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "n"))).alias("x"))
    old = F.filter("x", lambda t: t["n"] > 5)
    recent = F.transform(F.filter("x", lambda t: t["n"] <= 5), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return r.select("conv_id", F.array_join(recent, "\n").alias("recent"), F.size(old).cast("long").alias("older"), F.array_join(F.transform(old, lambda t: F.left(t["text"], F.lit(30))), " | ").alias("summary"))


@query("SELECT o_orderkey AS id, 'Task: ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' Status: done' ELSE '' END || ' Due: ' || strftime(o_orderdate, '%Y-%m-%d') AS text, 'calendar://task/' || o_orderkey AS source FROM orders")
def c9_task_text(spark, sf_dir):
    """Tasks as indexable text."""
    o = read(spark, sf_dir, "orders")
    text = F.concat_ws(" ", F.concat(F.lit("Task: "), "o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "Status: done"), F.concat(F.lit("Due: "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"), F.concat(F.lit("calendar://task/"), F.col("o_orderkey").cast("string")).alias("source"))


@query("""WITH e AS (SELECT user_id AS task, event_id, event_type, ts, event_type = 'purchase' AND coalesce(lag(event_type) OVER w <> 'purchase', true) AS enters FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT task, event_id, CASE WHEN event_type = 'purchase' THEN max(CASE WHEN enters THEN ts END) OVER (PARTITION BY task ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS completed_at FROM e""")
def l5_task_state(spark, sf_dir):
    """A task's log; completion time is set on entering 'completed' (here purchase), stays and is cleared on leaving."""
    w = Window.partitionBy("task").orderBy("event_id")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "event_id", "ts", (F.col("event_type") == "purchase").alias("done"))
    enters = F.col("done") & ~F.coalesce(F.lag("done").over(w), F.lit(False))
    e = e.withColumn("entered", F.when(enters, F.col("ts")))
    last = F.last("entered", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return e.select("task", "event_id", F.when(F.col("done"), last).alias("completed_at"))


@query("""WITH l AS (SELECT user_id AS owner, abs(hash_id) AS id, max(event_id) AS seq FROM (SELECT user_id, event_id, event_id * 7919 % 61 AS hash_id FROM events) GROUP BY ALL)
    SELECT owner, id, seq FROM l QUALIFY row_number() OVER (PARTITION BY owner ORDER BY seq DESC) <= 8""")
def x7_working_set(spark, sf_dir):
    """What is left of each user's set of eight when every event adds or touches a memory; the operator of the stream, over a batch."""
    e = read(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("long").alias("owner"), F.col("event_id").alias("seq"), F.lit("add").alias("op"), (F.col("event_id") * 7919 % 61).alias("id"), F.lit(1.0).alias("importance"), F.lit(1).cast("long").alias("bytes"), F.col("ts").cast("timestamp").alias("ts"))
    spark.streams.active  # starts what coordinates state stores, which a batch does not
    kept = {k: spark.conf.get(k) for k in working_set.needs}
    try:
        for k, v in working_set.needs.items():
            spark.conf.set(k, v)
        events = cut(working_set.working_set(rows, "recency", 8))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    last = events.groupBy("owner", "id").agg(F.max_by("event", "seq").alias("event"), F.max("seq").alias("seq"))
    return last.where("event = 'added'").select("owner", "id", "seq")
