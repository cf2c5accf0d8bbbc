"""Sessions, sequences and personalisation from activity logs (user_id, event_id, ts, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import similarity


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Adds session: a new one after a gap of more than ``gap_minutes`` whole minutes."""
    w = by_user()
    gap = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))) / 60)
    fresh = F.coalesce((gap > gap_minutes).cast("int"), F.lit(0))
    return log.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w)).drop("_new")


def last_session(log: DataFrame, now: Column, gap_minutes: int = 30) -> DataFrame:
    """Rows of each user's last session up to ``now``."""
    s = sessions(log.where(F.col("ts") <= now), gap_minutes)
    return s.withColumn("_last", F.max("session").over(Window.partitionBy("user_id"))).where(F.col("session") == F.col("_last")).drop("_last")


def bigrams(log: DataFrame, more_than: int = 2, top: int = 5) -> DataFrame:
    """(user_id, first, second, n, confidence): a user's frequent pairs of consecutive kinds."""
    pairs = log.select("user_id", "kind", F.lead("kind").over(by_user()).alias("second"))
    n = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("all"))
    counts = pairs.where("second IS NOT NULL").groupBy("user_id", F.col("kind").alias("first"), "second").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), "first", "second")
    ranked = counts.withColumn("i", F.row_number().over(order)).where(F.col("i") <= top)
    return ranked.join(n, "user_id").select("user_id", "first", "second", "n", (F.col("n") / F.col("all")).alias("confidence"))


def transitions(log: DataFrame, length: int = 2) -> DataFrame:
    """(path, n, weight) of runs of ``length`` kinds; the weight grows by 0.1 up to 1."""
    path = F.array(*(F.lag("kind", length - 1 - k).over(by_user()) if k < length - 1 else F.col("kind") for k in range(length)))
    paths = log.select(path.alias("p")).where(~F.exists("p", lambda x: x.isNull()))
    return paths.groupBy(F.array_join("p", " > ").alias("path")).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.least(F.round(0.1 * F.col("n"), 6), F.lit(1.0)))


def changes(log: DataFrame, column: str) -> DataFrame:
    """(before, after, n): moves between different values."""
    moves = log.select(F.lag(column).over(by_user()).alias("before"), F.col(column).alias("after"))
    return moves.where("before IS NOT NULL AND before <> after").groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def boosts(clicks: DataFrame) -> DataFrame:
    """Adds boost: 0.3 a click, -0.2 an ignore, 0.15 for long dwell, held to [-0.5, 1]."""
    raw = 0.3 * F.col("clicks") - 0.2 * F.col("ignores") + F.when(F.col("avg_dwell") > 10, 0.15).otherwise(0.0)
    return clicks.withColumn("boost", F.greatest(F.lit(-0.5), F.least(F.lit(1.0), raw)))


def suggestions(history: DataFrame, typed: DataFrame, recent: int = 20, most: int = 5) -> DataFrame:
    """(owner, text, query, score, place): of an owner's ``recent`` last searches (owner, query, ts, event_id) those that hold what is typed (owner, text)."""
    last = Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = history.withColumn("_age", F.row_number().over(last)).where(F.col("_age") <= recent)
    hits = rows.join(typed, "owner").where(F.lower("query").contains(F.lower("text")))
    scored = hits.withColumn("score", similarity(F.col("query"), F.col("text")))
    order = Window.partitionBy("owner", "text").orderBy(F.desc("score"), "_age")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("owner", "text", "query", "score", "place")
