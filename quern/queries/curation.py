"""Thresholds, diversity, cliffs, budgets, dedup and rank edits over result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import EngineConfig
from ..operators import fts, rank
from ..operators.lineage import few
from ..tables import read
from . import query
from .retrieval import _BM25

#: Result lists: a customer's part hits, scored by price; the order date's year is the source.
_H = """WITH h AS (SELECT o_custkey AS query_id, l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 100000 AS score,
    'src' || (l_suppkey % 4) AS source, l_shipdate, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey)
    return rows.select(
        F.col("o_custkey").alias("query_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_extendedprice") / 100000).alias("score"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 4).cast("string")).alias("source"),
        "l_shipdate",
        "l_quantity",
    )


@query(_H + " SELECT query_id, id, score FROM h WHERE score >= 0.3")
def p8_threshold(spark, sf_dir):
    return rank.above(_hits(spark, sf_dir), 0.3).select("query_id", "id", "score")


@query(_H + " SELECT query_id, id, score FROM h QUALIFY score >= 0.15 * max(score) OVER (PARTITION BY query_id)")
def p9_share_of_best(spark, sf_dir):
    return rank.above_share_of_best(_hits(spark, sf_dir), 0.15).select("query_id", "id", "score")


@query(_H + " SELECT query_id, id, round(score * 0.5 ** (row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) - 1), 9) AS score FROM h")
def w3_diversity(spark, sf_dir):
    return rank.diversify(_hits(spark, sf_dir)).select("query_id", "id", F.round("score", 9).alias("score"))


@query(_H + """, n AS (SELECT *, row_number() OVER w AS n, lag(score) OVER w AS prev, max(score) OVER (PARTITION BY query_id) AS best FROM h WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)),
    c AS (SELECT *, min(CASE WHEN n > 5 AND (score < 0.05 * best OR score < 0.4 * prev) THEN n END) OVER (PARTITION BY query_id) AS cut FROM n)
    SELECT query_id, id, score FROM c WHERE cut IS NULL OR n < cut""")
def w4_score_cliff(spark, sf_dir):
    return rank.cut_at_cliff(_hits(spark, sf_dir)).select("query_id", "id", "score")


@query(_H + " SELECT query_id, id, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50")
def t2_candidates(spark, sf_dir):
    """Five times k candidates of each list, ties by id."""
    h = _hits(spark, sf_dir)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return h.withColumn("n", F.row_number().over(w)).where("n <= 50").select("query_id", "id", "score")


_T = "WITH b AS (SELECT conv_id AS query_id, turn AS seq, text FROM conversations)"


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), "text")


@query(_T + """, s AS (SELECT *, sum((strlen(text) + 3) // 4 + 1) OVER (PARTITION BY query_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS n FROM b)
    SELECT query_id, seq, CASE WHEN n = 1 AND s > 120 THEN substr(text, 1, 480) ELSE text END AS text FROM s WHERE s <= 120 OR n = 1""")
def t5_budget_prefix(spark, sf_dir):
    return rank.within_budget(_turns(spark, sf_dir), 120)


@query(_T + " SELECT query_id, seq, text FROM b QUALIFY sum((strlen(text) + 3) // 4 + 1) OVER (PARTITION BY query_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) <= 120")
def t6_budget_suffix(spark, sf_dir):
    return rank.last_within_budget(_turns(spark, sf_dir), 120)


@query(_T + " SELECT query_id, seq FROM b QUALIFY coalesce(sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 600")
def t8_until_size(spark, sf_dir):
    return rank.until_size(_turns(spark, sf_dir), 600).select("query_id", "seq")


@query(_T + " SELECT query_id, max(seq) AS turns, greatest(8000 - 2000 - 1000 - sum((strlen(text) + 3) // 4), 0)::BIGINT * 60 // 100 AS documents, greatest(8000 - 2000 - 1000 - sum((strlen(text) + 3) // 4), 0)::BIGINT * 25 // 100 AS history, greatest(8000 - 2000 - 1000 - sum((strlen(text) + 3) // 4), 0)::BIGINT * 15 // 100 AS memory FROM b GROUP BY query_id")
def t7_budget_split(spark, sf_dir):
    left = F.greatest(F.lit(8000 - 2000 - 1000) - F.sum(rank.token_estimate(F.col("text"))), F.lit(0))
    rows = _turns(spark, sf_dir).groupBy("query_id").agg(F.max("seq").alias("turns"), left.alias("left"))
    return rows.select("query_id", "turns", *(F.floor(F.col("left") * p / 100).alias(n) for n, p in (("documents", 60), ("history", 25), ("memory", 15))))


_WORDS = "list_distinct(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_LOW = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 2))"


def best_hits(spark, sf_dir):
    """(query_id, id, score) of the best documents of every benchmark item by BM25, as many as the search takes for candidates; and the most rows they can be."""
    c = EngineConfig()
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    k = c.top_k * c.candidate_factor
    return fts.bm25(d, b, k).select("query_id", "id", F.round("score", 6).alias("score")), b.count() * k


def found_hits(spark, sf_dir):
    """The best hits with the source and text of the document and the query; while they are few, no text but theirs leaves the scan."""
    top, most = best_hits(spark, sf_dir)
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = few(top, most, EngineConfig.broadcast_rows).join(d.select(F.col("doc_id").alias("id"), "source", "text"), "id")
    return hits.join(b, "query_id").select("query_id", "id", "score", "source", "text", "query")


#: The same hits for DuckDB.
_D = f"""WITH h AS (WITH {_BM25} SELECT query_id, id, score, source, d.text, b.text AS query FROM fts JOIN documents d ON d.doc_id = fts.id JOIN benchmark b ON b.item_id = fts.query_id)"""


@query(_D + f""", w AS (SELECT query_id, id, source, {_WORDS.format('text')} AS w FROM h)
    SELECT a.query_id, a.id AS id_a, b.id AS id_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity
    FROM w a JOIN w b ON a.query_id = b.query_id AND a.source = b.source AND a.id < b.id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.3""")
def j6_similar_pairs(spark, sf_dir):
    """Pairs of a query's hits from one source with a word Jaccard above 0.3."""
    w = found_hits(spark, sf_dir).select("query_id", "id", "source", rank.word_set(F.col("text")).alias("w"))
    a, b = (w.select("query_id", "source", F.col("id").alias(f"id_{s}"), F.col("w").alias(f"w_{s}")) for s in "ab")
    pairs = a.join(b, ["query_id", "source"]).where("id_a < id_b").withColumn("similarity", rank.jaccard(F.col("w_a"), F.col("w_b")))
    return pairs.where("similarity > 0.3").select("query_id", "id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def _greedy_sql(words: str, most: float) -> str:
    """Hit after hit of a query and source, with the word sets of those kept so far."""
    return f"""WITH RECURSIVE {_D.removeprefix("WITH ")}, w AS (SELECT query_id, id, score, source, list_distinct({words}) AS w, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS i FROM h),
    k AS (SELECT query_id, id, score, source, i, true AS stays, [w] AS kept FROM w WHERE i = 1
        UNION ALL SELECT n.query_id, n.id, n.score, n.source, n.i, n.stays, CASE WHEN n.stays THEN list_append(n.kept, n.w) ELSE n.kept END
        FROM (SELECT w.*, k.kept, len(list_filter(k.kept, lambda o: CASE WHEN len(o) + len(w.w) = 0 THEN 1.0 ELSE len(list_intersect(o, w.w)) / (len(o) + len(w.w) - len(list_intersect(o, w.w))) END > {most})) = 0 AS stays
              FROM k JOIN w ON w.query_id = k.query_id AND w.source = k.source AND w.i = k.i + 1) n)
    SELECT query_id, id, score, source FROM k WHERE stays"""


@query(_greedy_sql(r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')", 0.75))
def d1_dedup_results(spark, sf_dir):
    """Greedy by score within query and source, word Jaccard above 0.75."""
    return rank.dedup_greedy(found_hits(spark, sf_dir), 0.75).select("query_id", "id", "score", "source")


@query(_greedy_sql(r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: strlen(x) > 2)", 0.60))
def d2_dedup_content(spark, sf_dir):
    """As D1 on lower-cased words over 2 bytes, above 0.60."""
    return rank.dedup_greedy(found_hits(spark, sf_dir), 0.60, lower=True).select("query_id", "id", "score", "source")


@query(_D + f", s AS (SELECT query_id, id, len(list_intersect({_LOW.format('query')}, {_LOW.format('text')})) / len({_LOW.format('query')}) AS score FROM h) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10")
def v10_rerank(spark, sf_dir):
    """V10 with the lexical default scorer."""
    return rank.rerank(found_hits(spark, sf_dir), rank.lexical_overlap, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_D + """, t AS (SELECT *, list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda w: strlen(w) > 2) AS ws FROM h)
    SELECT query_id, id, round(score / 100000 + 0.5 * len(list_filter(ws, lambda w: contains(lower(text), w))) + 0.05 * len(list_filter(ws, lambda w: NOT contains(lower(text), w) AND contains(lower(source), w))), 6) AS order_key FROM t""")
def v14_content_boost(spark, sf_dir):
    h = found_hits(spark, sf_dir).withColumn("score", F.col("score") / 100000)
    return rank.content_boost(h).select("query_id", "id", F.round("order_key", 6).alias("order_key"))


@query(_H + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM h),
    o AS (SELECT *, CASE WHEN rank < 6 AND rank % 2 = 0 THEN 4 - rank END AS nr, count(*) OVER (PARTITION BY query_id) AS n FROM r)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nr, n + rank), id) - 1 AS rank FROM o""")
def v13_apply_ranking(spark, sf_dir):
    """An order for some hits (here 4, 2, 0); the rest keep theirs behind."""
    h = _hits(spark, sf_dir)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    r = h.withColumn("rank", F.row_number().over(w) - 1)
    order = r.where("rank < 6 AND rank % 2 = 0").select("query_id", "rank", (4 - F.col("rank")).alias("new_rank"))
    return rank.apply_ranking(r, order).select("query_id", "id", "rank")


@query(_H + " SELECT query_id, coalesce(avg(score), 0) AS confidence FROM (SELECT query_id, round(score, 2) AS score FROM h) GROUP BY query_id".replace("coalesce(avg(score), 0)", "round(coalesce(avg(score), 0), 6)"))
def p15_confidence(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.round("score", 2)), F.lit(0.0)), 6).alias("confidence"))
