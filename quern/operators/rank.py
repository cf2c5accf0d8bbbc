"""Curation of result lists (query_id, id, score, ...)."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def by_query():
    return Window.partitionBy("query_id")


def above(hits: DataFrame, least: float) -> DataFrame:
    return hits.where(F.col("score") >= least)


def above_share_of_best(hits: DataFrame, share: float) -> DataFrame:
    return hits.withColumn("_best", F.max("score").over(by_query())).where(F.col("score") >= share * F.col("_best")).drop("_best")


def diversify(hits: DataFrame, factor: float = 0.5, source: str = "source") -> DataFrame:
    """The n-th hit of a source counts factor ** n."""
    nth = F.row_number().over(Window.partitionBy("query_id", source).orderBy(F.desc("score"), "id")) - 1
    return hits.withColumn("score", F.col("score") * F.pow(F.lit(factor), nth))


def cut_at_cliff(hits: DataFrame, keep: int = 5, of_best: float = 0.05, of_previous: float = 0.4) -> DataFrame:
    """Cut at the first hit past ``keep`` that falls below 5 % of the best or 40 % of the one before."""
    order = by_query().orderBy(F.desc("score"), "id")
    rows = hits.withColumns({"_n": F.row_number().over(order), "_prev": F.lag("score").over(order), "_best": F.max("score").over(by_query())})
    cliff = (F.col("_n") > keep) & ((F.col("score") < of_best * F.col("_best")) | (F.col("score") < of_previous * F.col("_prev")))
    rows = rows.withColumn("_cut", F.min(F.when(cliff, F.col("_n"))).over(by_query()))
    return rows.where(F.col("_cut").isNull() | (F.col("_n") < F.col("_cut"))).drop("_n", "_prev", "_best", "_cut")


def word_set(text: Column, lower: bool = False) -> Column:
    """White-space words; or lower-cased letter-digit words over 2 bytes."""
    if lower:
        return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 2))
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dedup_greedy(hits: DataFrame, threshold: float, lower: bool = False, source: str = "source", text: str = "text") -> DataFrame:
    """Keep a hit unless a kept, better hit of its query and source is more similar than ``threshold``.

    Whether a hit stays depends on what was kept before it, so the hits of one
    (query, source) go through a small helper in score order.  Lists are
    candidates of a query (5 k rows), not the corpus.
    """
    rows = hits.withColumn("_words", word_set(F.col(text), lower))
    schema = hits.schema

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        stay = []
        for words in group.sort_values(["score", "id"], ascending=[False, True])["_words"].map(set):
            same = any((len(words & o) / len(words | o) if words | o else 1.0) > threshold for o in kept)
            stay.append(not same)
            if not same:
                kept.append(words)
        return group.sort_values(["score", "id"], ascending=[False, True])[stay].drop(columns="_words")

    return rows.groupBy("query_id", source).applyInPandas(keep, schema)


def dedup_adjacent(rows: DataFrame, value: str, order: str, most: int) -> DataFrame:
    """The first ``most`` values of each query once values equal to the one before have gone; equal values apart stay."""
    w = by_query().orderBy(order)
    kept = rows.withColumn("_prev", F.lag(value).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def token_estimate(text: Column) -> Column:
    return F.floor((F.octet_length(text) + 3) / 4)


def within_budget(blocks: DataFrame, budget: int, order: str = "seq", text: str = "text") -> DataFrame:
    """Leading blocks of each query that fit; each block costs a separator token more, a first block too long is cut."""
    w = by_query().orderBy(order)
    cost = token_estimate(F.col(text)) + 1
    rows = blocks.withColumns({"_sum": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w)})
    rows = rows.where((F.col("_sum") <= budget) | (F.col("_n") == 1))
    return rows.withColumn(text, F.when((F.col("_n") == 1) & (F.col("_sum") > budget), F.substring(text, 1, 4 * budget)).otherwise(F.col(text))).drop("_sum", "_n")


def last_within_budget(lines: DataFrame, budget: int, order: str = "seq", text: str = "text") -> DataFrame:
    """Trailing lines of each query that fit."""
    w = by_query().orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_sum", F.sum(token_estimate(F.col(text)) + 1).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def until_size(chunks: DataFrame, most: int, order: str = "seq", text: str = "text") -> DataFrame:
    """Chunks up to and with the one that crosses ``most`` bytes."""
    before = F.coalesce(F.sum(F.octet_length(text)).over(by_query().orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def budget_split(window: int, response: int, query: int) -> tuple[int, int, int]:
    """Documents, history and memory: 60, 25 and 15 % of what is left of the window."""
    left = max(window - 2000 - response - query, 0)
    return left * 60 // 100, left * 25 // 100, left * 15 // 100


def lexical_overlap(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's words that the text has."""
    q = word_set(query, lower=True)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, word_set(text, lower=True))) / F.size(q))


def rerank(hits: DataFrame, scorer, k: int) -> DataFrame:
    """Replace scores by ``scorer(query, text)`` (a Column function or pandas UDF), held to [0, 1] per query."""
    raw = hits.withColumn("score", scorer(F.col("query"), F.col("text")))
    lo, hi = F.min("score").over(by_query()), F.max("score").over(by_query())
    scaled = raw.withColumn("score", F.when((lo >= 0) & (hi <= 1), F.col("score")).when(hi - lo < 1e-9, 0.5).otherwise((F.col("score") - lo) / (hi - lo)))
    order = by_query().orderBy(F.desc("score"), "id")
    return scaled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def content_boost(hits: DataFrame, query: str = "query", snippet: str = "text", path: str = "source") -> DataFrame:
    """Order key: score + 0.5 x query words in the snippet + 0.05 x words only in the path."""
    terms = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: F.octet_length(w) > 2)
    text, where = F.col("_text"), F.col("_path")  # lowered once a row, not once a word
    inside = F.size(F.filter(terms, lambda w: text.contains(w)))
    only = F.size(F.filter(terms, lambda w: ~text.contains(w) & where.contains(w)))
    rows = hits.withColumns({"_text": F.lower(F.col(snippet)), "_path": F.lower(F.col(path))})
    return rows.withColumn("order_key", F.col("score") + 0.5 * inside + 0.05 * only).drop("_text", "_path")


def parse_ranking(output: str | None, n: int) -> list[int] | None:
    """0-based order from a model's answer: a JSON array, else the first bracketed list, else numbers in the prose."""
    if not output:
        return None

    def inside(numbers: Iterable[str], distinct: bool) -> list[int]:
        got = [int(x) - 1 for x in numbers if 1 <= int(x) <= n]
        return list(dict.fromkeys(got)) if distinct else got

    body = re.sub(r"^```\w*|```$", "", output.strip(), flags=re.M).strip()
    for text in (body, (re.search(r"\[[^\]]*\]", output) or [""])[0]):
        if re.fullmatch(r"\[\s*\d+(\s*,\s*\d+)*\s*\]", text):
            got = inside(re.findall(r"\d+", text), False)
            if got:
                return got
    got = inside(re.findall(r"\d+", output), True)
    return got if len(got) >= -(-n // 2) and got else None


def apply_ranking(hits: DataFrame, order: DataFrame) -> DataFrame:
    """``order`` is (query_id, rank, new_rank), 0-based; hits it lacks follow in their old order."""
    n = F.count(F.lit(1)).over(by_query())
    both = hits.join(order, ["query_id", "rank"], "left")
    place = F.coalesce(F.col("new_rank"), n + F.col("rank"))
    return both.withColumn("rank", F.row_number().over(by_query().orderBy(place, "id")) - 1).drop("new_rank")
