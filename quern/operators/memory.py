"""Memories (id, type, content, entities, metadata, importance, created_at): scoring, retrieval, forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What a type adds to importance.
TYPE_WEIGHT = {"Decision": 0.3, "Error": 0.25, "Learning": 0.25, "Discovery": 0.25, "Pattern": 0.25, "Task": 0.15, "Conversation": 0.1, "Search": 0.05, "Context": 0.05}


def importance(kind: Column, content: Column, entities: Column, metadata_size: Column) -> Column:
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv))[kind], F.lit(0.05))
    n = F.octet_length(content)
    size = F.when(n > 200, 0.15).when(n > 50, 0.05).otherwise(0.0)
    who = F.when(F.size(entities) > 3, 0.1).when(F.size(entities) >= 1, 0.05).otherwise(0.0)
    return F.least(F.lit(0.3) + weight + size + who + F.when(metadata_size > 2, 0.05).otherwise(0.0), F.lit(1.0))


def hybrid_score(text_score: Column, created_at: Column, now: Column, importance_: Column) -> Column:
    """0.6 text + 0.25 recency with a half-life of 7 days + 0.15 importance."""
    days = (F.unix_timestamp(now) - F.unix_timestamp(created_at)) / 86400.0
    return 0.6 * text_score + 0.25 * F.pow(F.lit(0.5), days / 7.0) + 0.15 * importance_


def matching_share(content: Column, query: str) -> Column:
    """Share of the query's words that the content holds."""
    words = [w for w in query.lower().split() if w]
    low = F.lower(content)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)) / max(len(words), 1)


def hard_filter(memories: DataFrame, least: float = 0.0, types: tuple[str, ...] = (), start: Column | None = None, end: Column | None = None) -> DataFrame:
    out = memories.where(F.col("importance") >= least)
    out = out.where(F.col("type").isin(*types)) if types else out
    out = out if start is None else out.where(F.col("created_at") >= start)
    return out if end is None else out.where(F.col("created_at") <= end)


def retrieve(memories: DataFrame, query: str, now: Column, k: int) -> DataFrame:
    """Top k by hybrid score above 0.05; the score has a column of its own."""
    s = hybrid_score(matching_share(F.col("content"), query), F.col("created_at"), now, F.col("importance"))
    return memories.withColumn("score", F.round(s, 9)).where("score > 0.05").orderBy(F.desc("score"), "id").limit(k)


def forget(memories: DataFrame, before: Column | None = None, below: float | None = None, pattern: str | None = None) -> DataFrame:
    """What stays after forgetting the older, the less important and what fits the pattern."""
    gone = F.lit(False)
    gone = gone if before is None else gone | (F.col("created_at") < before)
    gone = gone if below is None else gone | (F.col("importance") < below)
    gone = gone if pattern is None else gone | F.col("content").rlike(pattern)
    return memories.where(~F.coalesce(gone, F.lit(False)))


def keep_most_important(memories: DataFrame, by: str, most: int) -> DataFrame:
    """Per owner, the ``most`` important memories once there are more than twice as many."""
    w = Window.partitionBy(by)
    rows = memories.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(F.desc("importance"), "id")))
    return rows.where((F.col("_n") <= 2 * most) | (F.col("_i") <= most)).drop("_n", "_i")


def within_bytes(memories: DataFrame, by: str, most: int) -> DataFrame:
    """Per owner, the most important memories that fit in ``most`` bytes together."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return memories.withColumn("_s", F.sum(F.octet_length("content")).over(w)).where(F.col("_s") <= most).drop("_s")


def line(kind: Column, content: Column, importance_: Column) -> Column:
    """A memory in one line: its type, first 100 characters and importance."""
    return F.format_string("[%s] %s (importance: %.2f)", kind, F.left(content, F.lit(100)), importance_)


def open_item(content: Column) -> Column:
    """What a conversation left open, or null."""
    return F.when(content.contains("?"), "unanswered question").when(F.lower(content).contains("todo"), "incomplete task")


def continuations(memories: DataFrame, by: str, now: Column, days: int = 7, most: int = 5) -> DataFrame:
    """(by, id, suggestion): open items among an owner's ``most`` latest memories of the last ``days`` that are conversations."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), "id")
    recent = memories.where(F.col("created_at").between(now - F.make_interval(days=F.lit(days)), now)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    item = open_item(F.col("content"))
    return recent.where((F.col("type") == "Conversation") & item.isNotNull()).select(by, "id", F.concat(F.lit("Continue discussing: "), item).alias("suggestion"))


def retrieve_by_time(memories: DataFrame, by: str, k: int) -> DataFrame:
    """The temporal mode: each owner's latest ``k``."""
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), "id")
    return memories.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def retrieve_by_entities(memories: DataFrame, by: str, wanted: list[str], k: int) -> DataFrame:
    """The causal and associative modes: most wanted entities first, then the latest."""
    hits = F.size(F.array_intersect("entities", F.array(*map(F.lit, wanted))))
    w = Window.partitionBy(by).orderBy(F.desc("hits"), F.desc("created_at"), "id")
    return memories.withColumn("hits", hits).where("hits > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
