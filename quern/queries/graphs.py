"""Graphs: co-occurrence, k-hop, knowledge maps, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G, neighbours, vector
from ..tables import read
from . import query

_EDGES = "SELECT DISTINCT s_suppkey AS src, s_suppkey * 7 + s_nationkey AS dst FROM supplier"


def _edges(spark, sf_dir):
    """Edges between suppliers' keys."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 7 + F.col("s_nationkey")).alias("dst")).distinct()


#: The stated set of starts.
_STARTS = "src % 50 = 0"


@query("SELECT c_mktsegment AS name, min(n_name) AS entity_type, list_sort(list(DISTINCT c_nationkey)) AS doc_ids FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def g1_entities(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    m = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return G.entities(m.select(F.col("c_mktsegment").alias("name"), F.col("n_name").alias("entity_type"), F.col("c_nationkey").alias("doc_id")))


@query("SELECT o_orderkey AS src, o_custkey AS dst, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL")
def g2_valid_edges(spark, sf_dir):
    """Edges whose ends both exist, counted."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    nodes = o.select(F.col("src").alias("name")).distinct()
    return G.valid_edges(o, nodes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT src AS start, src AS name, 0 AS depth FROM e WHERE {_STARTS}
    UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src WHERE r.depth < 3) SELECT start, name, min(depth) AS depth FROM r GROUP BY ALL""")
def j12_within_hops(spark, sf_dir):
    """Nodes within three hops."""
    e = _edges(spark, sf_dir)
    return G.within_hops(e, e.where(_STARTS).select(F.col("src").alias("name")).distinct(), 3)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT src AS start, src AS name, 0 AS depth FROM e WHERE {_STARTS}
    UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON r.name = e.src WHERE r.depth < 2), m AS (SELECT start, name, min(depth) AS depth FROM r GROUP BY ALL)
    SELECT start, c_custkey AS doc_id, min(depth) AS depth FROM m JOIN customer ON c_custkey = name GROUP BY ALL""")
def g3_related_documents(spark, sf_dir):
    e = _edges(spark, sf_dir)
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.lit("customer").alias("entity_type"), F.col("c_custkey").alias("doc_id"))
    return G.related_documents(G.entities(c), e, e.where(_STARTS).select(F.col("src").alias("name")).distinct(), 2)


@query("""WITH n AS (SELECT s_suppkey AS id, s_nationkey AS directory, s_suppkey % 3 AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'C/C++' WHEN 1 THEN 'Go' END AS lang, (s_acctbal::DECIMAL(15, 2) * 100)::BIGINT AS c FROM supplier),
    o AS (SELECT *, row_number() OVER (ORDER BY kind, c, id) AS place, count(*) OVER (PARTITION BY directory) - 1 AS n_same_directory FROM n)
    SELECT id, 'topic-' || kind AS category, 'entity-' || lang AS language, directory, n_same_directory, kind, c / 1000000 AS score, place, min(place) OVER w AS first, max(place) OVER w AS last, count(*) OVER w - count(*) OVER d AS n_semantic FROM o
    WINDOW w AS (PARTITION BY kind ORDER BY c RANGE BETWEEN 499999 PRECEDING AND 499999 FOLLOWING), d AS (PARTITION BY kind, directory ORDER BY c RANGE BETWEEN 499999 PRECEDING AND 499999 FOLLOWING)""")
def j7_edges(spark, sf_dir):
    """All category, language, directory and similarity (above 0.5) edges, as one row a document from which each pair follows."""
    key = F.col("s_suppkey")
    score = (F.col("s_acctbal").cast("decimal(15,2)") / 10000).cast("decimal(18,6)")
    n = read(spark, sf_dir, "supplier").select(key.alias("id"), F.col("s_nationkey").alias("directory"), (key % 3).alias("kind"), F.when(key % 5 == 0, "C/C++").when(key % 5 == 1, "Go").alias("language"), score.alias("score"))
    return G.similarity_edges(n)


@query("SELECT count(*) AS nodes, true AS recall_reached, true AS degree_bounded FROM embeddings")
def g5_similarity_graph(spark, sf_dir):
    """The graph of the ten most similar vectors by cells and neighbour descent; recall of 0.9 or more against the exact lists of every node."""
    e = read(spark, sf_dir, "embeddings")
    near = neighbours.knn_graph(e, 10).select("src", "dst")
    exact = vector.knn_batch(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 11, places=9)
    exact = exact.where("query_id <> id AND rank <= 11").select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    found = exact.join(near.withColumn("found", F.lit(1)), ["src", "dst"], "left").agg((F.count("found") / F.count(F.lit(1))).alias("recall"))
    degree = near.groupBy("src").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("nodes"))
    return found.crossJoin(degree).select("nodes", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("most") <= 10).alias("degree_bounded"))  # one row each


@query("WITH n AS (SELECT s_suppkey AS id, s_nationkey AS kind, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) SELECT a.id AS src, b.id AS dst, 0.6 AS weight FROM n a JOIN n b ON a.kind = b.kind AND b.i - a.i BETWEEN 1 AND 2")
def j8_knowledge_map(spark, sf_dir):
    """Edges to the next two of a kind."""
    return G.next_in_group(read(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", 2, 0.6)


_PLAN = "steps AS (SELECT p_partkey AS step, p_size::DOUBLE AS cost, p_size % 7 + 1 AS duration, (p_size % 10) / 10 AS risk FROM part), needs AS (SELECT step, step // 2 AS need FROM steps WHERE step // 2 > 0)"


def _plan(spark, sf_dir):
    steps = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"), F.col("p_size").cast("double").alias("cost"), (F.col("p_size") % 7 + 1).alias("duration"), ((F.col("p_size") % 10) / 10).alias("risk"))
    return steps, steps.select("step", F.floor(F.col("step") / 2).alias("need")).where("need > 0")


@query(f"WITH RECURSIVE {_PLAN}, l AS (SELECT step, 0 AS level FROM steps WHERE step NOT IN (SELECT step FROM needs) UNION ALL SELECT n.step, l.level + 1 FROM l JOIN needs n ON n.need = l.step) SELECT step, max(level) AS level FROM l GROUP BY step")
def w15_levels(spark, sf_dir):
    return G.levels(*_plan(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PLAN}, l AS (SELECT step, 0 AS level FROM steps WHERE step NOT IN (SELECT step FROM needs) UNION ALL SELECT n.step, l.level + 1 FROM l JOIN needs n ON n.need = l.step),
    p AS (SELECT level, sum(cost) AS cost, sum(duration) AS serial, max(duration) AS parallel, max(risk) AS risk FROM steps JOIN (SELECT step, max(level) AS level FROM l GROUP BY step) USING (step) GROUP BY level)
    SELECT sum(cost) AS cost, sum(serial)::BIGINT AS serial, sum(parallel)::BIGINT AS parallel, max(risk) AS risk, CASE WHEN max(risk) >= 0.8 THEN 'critical' WHEN max(risk) >= 0.6 THEN 'high' WHEN max(risk) >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM p""")
def a23_plan_cost(spark, sf_dir):
    steps, needs = _plan(spark, sf_dir)
    return G.plan_cost(steps, G.levels(steps, needs))
