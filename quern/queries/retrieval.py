"""Vector search, full-text search, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import evaluate, fts, fusion, ivfpq, segments, vector
from ..operators.lineage import cut, shared_folder
from ..tables import chunks, read
from . import query

_TOK = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND strlen(w) <= 40)"
_TOK_T, _TOK_Q = _TOK.format("text"), _TOK.format("text")
_BM25 = f"""
    q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK_Q}) AS term FROM benchmark),
    d AS (SELECT doc_id AS id, {_TOK_T} AS ws FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
    e AS (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM d),
    p AS (SELECT term, id, dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    h AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
          FROM p JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
    fts AS (SELECT query_id, id, round(score, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) <= 50)"""
_VEC = """
    qv AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
    vs AS (SELECT query_id, vec_id AS id, round(greatest(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 0), 6) AS score FROM embeddings, qv),
    vec AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k})"""
#: Ranked lists made from the events table, for fusion at any size.
_LISTS = """
    vec AS (SELECT user_id AS query_id, event_id AS id, value AS score FROM events WHERE event_type IN ('click', 'view')),
    fts AS (SELECT user_id AS query_id, event_id AS id, value * 0.1 + (event_id % 17) AS score FROM events WHERE event_type IN ('view', 'purchase'))"""
_POS = """
    , v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM vec),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM fts),
    u AS (SELECT 'vector' AS list, * FROM v UNION ALL SELECT 'fts', * FROM f)"""
_FOUND = "CASE WHEN count(DISTINCT list) = 2 THEN 'hybrid' ELSE max(list) END AS found_by"


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), "value", "event_type")
    vec = e.where(F.col("event_type").isin("click", "view")).select("query_id", "id", F.col("value").alias("score"))
    fts_ = e.where(F.col("event_type").isin("view", "purchase")).select("query_id", "id", (F.col("value") * 0.1 + F.col("id") % 17).alias("score"))
    return vec, fts_


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("SELECT vec_id, label, round(greatest(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 0), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def v1_knn(spark, sf_dir):
    """Cosine top 10 of the first vector (a top-k report)."""
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("embedding").head()
    rows = e.withColumn("score", F.round(vector.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, first[0])))), 6))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "label", "score")


@query("SELECT vec_id, label, round(greatest(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 0), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def v1_knn_filtered(spark, sf_dir):
    """V1 with a filter before the ranking."""
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select("embedding").head()
    rows = e.where(F.col("label").isin(1, 2, 3)).withColumn("score", F.round(vector.cosine(F.col("embedding"), F.array(*map(F.lit, map(float, first[0])))), 6))
    return rows.orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "label", "score")


@query("WITH" + _VEC.format(k=10) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec) SELECT query_id, id, score, rank FROM r")
def v2_knn_batch(spark, sf_dir):
    """V2: every 50th vector against all vectors."""
    e = read(spark, sf_dir, "embeddings")
    return vector.knn_batch(e, _query_vectors(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH" + _VEC.format(k=10) + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec) SELECT query_id, id, score, rank FROM r")
def v3_ivf(spark, sf_dir):
    """V3: a kept IVF-PQ index, fitted on a bounded sample, every row indexed; every 50th vector as a query.

    Codes give bounds, so the answer is the exact one though few vectors are read.
    """
    index = ivfpq.IvfPq(spark, shared_folder(spark, "ivfpq")).build(read(spark, sf_dir, "embeddings"))
    return index.search(_query_vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_queries, true AS recall_reached, true AS few_vectors_read FROM embeddings WHERE vec_id % 50 = 0")
def v3_work(spark, sf_dir):
    """V3: whether the approximate search (a short list of 60) has recall@10 of 0.9 or more, and whether less than a fifth of the vectors were read."""
    e, q = read(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir)
    index = ivfpq.IvfPq(spark, shared_folder(spark, "ivfpq")).build(e)
    exact = vector.knn_batch(e, q, 10).select("query_id", "id", F.lit(1).alias("true"))
    short = cut(index.short_list(q, 10, short=60))  # searched and counted
    near = index.search(q, 10, near=short).select("query_id", "id", F.lit(1).alias("found"))
    recall = exact.join(near, ["query_id", "id"], "left").agg((F.count("found") / F.count("true")).alias("recall"))
    some = short.agg(F.count(F.lit(1)).alias("vectors"))
    size = e.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % 50 == 0).alias("n_queries"))
    one = recall.crossJoin(some).crossJoin(size)  # one row each
    return one.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("vectors") < 0.2 * F.col("rows") * F.col("n_queries")).alias("few_vectors_read"))


@query("WITH" + _BM25 + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 10")
def v4_bm25(spark, sf_dir):
    """V4: BM25 top 10 of each benchmark item over documents."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return fts.bm25(read(spark, sf_dir, "documents"), q, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _kept(spark, sf_dir):
    """An index of all documents, added in three batches, some of them twice."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    index = segments.SegmentIndex(spark, shared_folder(spark, "segments"))
    index.add(d.where("id % 3 = 0").withColumn("text", F.upper("text")))
    index.add(d.where("id % 3 <> 1"))
    index.add(d.where("id % 3 = 1"))
    return index, d, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXED = "WITH" + _BM25 + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fts QUALIFY rank <= 10"


@query(_INDEXED)
def v4_index(spark, sf_dir):
    """BM25 from the kept index, the same as v4_bm25 scans."""
    index, _, q = _kept(spark, sf_dir)
    return index.search(q, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_INDEXED.replace("AS ws FROM documents", "AS ws FROM documents WHERE lang <> 'fr'"))
def v4_index_deleted(spark, sf_dir):
    """The same after a language is deleted."""
    index, d, q = _kept(spark, sf_dir)
    index.delete(d.where("lang = 'fr'"))
    return index.search(q, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK_T}) AS term FROM documents) GROUP BY term")
def v5_terms(spark, sf_dir):
    """The term statistics of the index."""
    post = fts.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))


@query("WITH" + _LISTS + _POS + f"""SELECT query_id, id, round(score, 9) AS score, found_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM (SELECT query_id, id, sum(1 / (60 + pos + 1)) AS score, {_FOUND} FROM u GROUP BY ALL)) WHERE rank <= 10""")
def v6_rrf(spark, sf_dir):
    return fusion.rrf(*_lists(spark, sf_dir)).select("query_id", "id", F.round("score", 9).alias("score"), "found_by", "rank")


@query("WITH" + _LISTS + _POS + f"""SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, found_by, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM (SELECT query_id, id, sum(1 / (60 + pos + 1) * (1 + 0.3 * CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END)) AS score, {_FOUND} FROM u GROUP BY ALL)) WHERE rank <= 10""")
def v7_score_aware_rrf(spark, sf_dir):
    """V7, V9, W1, W2, J3."""
    return fusion.score_aware_rrf(*_lists(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"), "found_by", "rank")


@query("WITH" + _LISTS + _POS + """, n AS (SELECT list, query_id, id, CASE WHEN hi - lo < 1e-6 THEN 0 ELSE (score - lo) / (hi - lo) END AS s FROM u),
    w AS (SELECT query_id, id, sum(s * CASE list WHEN 'vector' THEN 0.7 ELSE 0.3 END) AS score FROM n GROUP BY ALL)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM w QUALIFY rank <= 10""")
def v8_weighted_fusion(spark, sf_dir):
    return fusion.weighted(*_lists(spark, sf_dir)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH" + _LISTS + """, a AS (SELECT * FROM vec UNION ALL SELECT * FROM fts), m AS (SELECT query_id, id, max(score) AS score FROM a GROUP BY ALL)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM m QUALIFY rank <= 10""")
def u2_merge_variants(spark, sf_dir):
    vec, f = _lists(spark, sf_dir)
    return fusion.merge_variants(vec.unionByName(f), 10)


@query("WITH" + _LISTS + """, a AS (SELECT query_id, id, 0 AS list_no, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM vec
    UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM fts),
    b AS (SELECT query_id, id, min(r * 2 + list_no) AS k FROM a GROUP BY ALL)
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k, id) AS place FROM b QUALIFY place <= 10""")
def u1_round_robin(spark, sf_dir):
    """Lists dealt in turn, first place wins."""
    vec, f = (fusion.ranked(x).select("query_id", "id", (F.col("pos") + 1).alias("rank")) for x in _lists(spark, sf_dir))
    return fusion.merge_round_robin(vec.withColumn("list_no", F.lit(0)).unionByName(f.withColumn("list_no", F.lit(1))), 10)


_EVAL = "WITH" + _VEC.format(k=10) + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec),
    rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id, CASE WHEN a.vec_id % 3 = b.vec_id % 3 THEN 1.0 ELSE 0.5 END AS grade FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0),
    j AS (SELECT r.*, coalesce(grade, 0.0) AS grade FROM r LEFT JOIN rel USING (query_id, id)),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS i FROM rel),
    b AS (SELECT query_id, count(*) AS total, """ + ", ".join(f"sum(CASE WHEN i <= {k} THEN grade / log2(i + 1.0) ELSE 0 END) AS b{k}" for k in (1, 3, 5, 10)) + """ FROM g GROUP BY query_id),
    f AS (SELECT query_id, count(*) AS n, min(CASE WHEN grade > 0 THEN rank END) AS first, """ + ", ".join(f"count(*) FILTER (grade > 0 AND rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1.0) ELSE 0 END) AS g{k}" for k in (1, 3, 5, 10)) + """ FROM j GROUP BY query_id),
    m AS (SELECT query_id, coalesce(1.0 / first, 0) AS rr, """ + ", ".join(f"coalesce(h{k}, 0) / total AS recall_{k}, coalesce(h{k}, 0) / greatest(least({k}, coalesce(n, 0)), 1) AS precision_{k}, CASE WHEN b{k} > 0 THEN coalesce(g{k}, 0) / b{k} ELSE 0 END AS ndcg_{k}" for k in (1, 3, 5, 10)) + " FROM b LEFT JOIN f USING (query_id))"
_KS = [1, 3, 5, 10]


def _metrics(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    results = vector.knn_batch(e, _query_vectors(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"))
    results = results.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    qrels = a.join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id", F.when(F.col("query_id") % 3 == F.col("id") % 3, 1.0).otherwise(0.5).alias("grade"))
    return evaluate.per_query(results, qrels, _KS)


@query(_EVAL + "SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["rr", *(f"{m}_{k}" for k in _KS for m in ("recall", "precision", "ndcg"))]) + " FROM m")
def e_per_query(spark, sf_dir):
    """Metrics of each query; same-label vectors are relevant."""
    m = _metrics(spark, sf_dir)
    return m.select("query_id", *(F.round(c, 6).alias(c) for c in m.columns if c != "query_id"))


@query(_EVAL + "SELECT count(*) AS n_queries, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in _KS for m in ("recall", "precision", "ndcg")) + ", " + ", ".join(f"round(avg(CASE WHEN recall_{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_{k}" for k in _KS) + " FROM m")
def e_means(spark, sf_dir):
    """Averages and hit rates."""
    m = evaluate.mean(_metrics(spark, sf_dir), _KS)
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in m.columns if c != "n_queries"))


@query(_EVAL + ", a AS (SELECT count(*) AS n, avg(rr) AS mrr, " + ", ".join(f"avg({m}_{k}) AS {m}_{k}" for k in _KS for m in ("recall", "precision", "ndcg")) + ", " + ", ".join(f"avg(CASE WHEN recall_{k} > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate_{k}" for k in _KS) + ") SELECT unnest([printf('queries: %d', n), printf('MRR: %.4f', mrr), ".replace(") SELECT", " FROM m) SELECT") + ", ".join(f"printf('@{k}: recall %.4f, precision %.4f, nDCG %.4f, hit rate %.4f', recall_{k}, precision_{k}, ndcg_{k}, hit_rate_{k})" for k in _KS) + "]) AS line FROM a")
def e6_report(spark, sf_dir):
    """The report as lines."""
    return evaluate.report(evaluate.mean(_metrics(spark, sf_dir), _KS), _KS)


_HY = "WITH" + _BM25 + """,
    qv AS (SELECT item_id AS query_id, (SELECT embedding FROM embeddings e WHERE e.vec_id = item_id) AS qe FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings)),
    vs AS (SELECT query_id, vec_id AS id, round(greatest(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 0), 6) AS score FROM embeddings, qv),
    vec AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50)""" + _POS + f""",
    fu AS (SELECT query_id, id, sum(1 / (60 + pos + 1) * (1 + 0.3 * CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END)) AS score, {_FOUND} FROM u GROUP BY ALL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fu QUALIFY rank <= 50),
    sc AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS score, found_by FROM tp),
    j AS (SELECT sc.*, source FROM sc JOIN documents d ON d.doc_id = sc.id WHERE score >= 0.02),
    dv AS (SELECT query_id, id, source, found_by, score * 0.5 ** (row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) - 1) AS score FROM j),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dv QUALIFY rank <= 10)
    SELECT query_id, id, source, found_by, round(score, 6) AS score, rank FROM rk"""


@query(_HY)
def hybrid_search(spark, sf_dir):
    """The search pipeline: k-NN and BM25, score-aware RRF, threshold, payload join, diversity, top 10."""
    from ..plans.search import hybrid

    return hybrid(spark, sf_dir).select("query_id", "id", "source", "found_by", F.round("score", 6).alias("score"), "rank")
