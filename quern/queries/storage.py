"""Scans, filters, joins to dimensions, deletes, governance and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..config import EngineConfig
from ..operators import governance as G, store, snapshots
from ..operators.lineage import few, shared_folder
from ..tables import chunks, read, with_views
from . import query
from .curation import best_hits
from .retrieval import _BM25


@query(with_views("SELECT id, source, created_at FROM chunks WHERE space_id = 'en' AND created_at >= 1700100000 AND created_at <= 1703000000", "chunks"))
def p1_metadata_filter(spark, sf_dir):
    """The conjunctive filter, pushed to the scan."""
    return store.MetadataFilter(space_id="en", after=1_700_100_000, before=1_703_000_000).apply(chunks(spark, sf_dir)).select("id", "source", "created_at")


@query(with_views("SELECT id, doc_id, chunk_index FROM chunks ORDER BY doc_id, chunk_index, id LIMIT 100", "chunks"))
def s1_list(spark, sf_dir):
    """A listing with a limit and an order of its own."""
    return chunks(spark, sf_dir).select("id", "doc_id", "chunk_index").orderBy("doc_id", "chunk_index", "id").limit(100)


@query("SELECT doc_id AS id, source, n_chars FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)")
def s3_by_ids(spark, sf_dir):
    """S3, J4."""
    ids = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("id"))
    return store.by_ids(chunks(spark, sf_dir), ids).select("id", "source", "n_chars")


@query(with_views(f""", h AS (WITH {_BM25} SELECT query_id, id, doc_id, chunk_index FROM fts JOIN chunks USING (id))
    SELECT h.query_id, h.id, string_agg(c.text, chr(10) ORDER BY c.chunk_index, c.text) AS text FROM h JOIN chunks c ON c.doc_id = h.doc_id AND abs(c.chunk_index - h.chunk_index) <= 1 GROUP BY ALL""", "chunks"))
def j5_neighbours(spark, sf_dir):
    """The text of each of the search's hits with its neighbours'."""
    c = chunks(spark, sf_dir)
    top, most = best_hits(spark, sf_dir)
    hits = few(top.select("query_id", "id"), most, EngineConfig.broadcast_rows).join(c.select("id", "doc_id", "chunk_index"), "id")
    return store.neighbours(c, hits, most_hits=most)


@query("SELECT count(DISTINCT source) AS documents, count(*) AS chunks FROM documents WHERE source NOT IN ('', '__seed__')")
def s5_counts(spark, sf_dir):
    """S5, S7."""
    return chunks(spark, sf_dir).where(~F.col("doc_id").isin("", "__seed__")).agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))


@query(with_views("SELECT doc_id, title, source FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, id) = 1", "chunks"))
def s6_documents(spark, sf_dir):
    """S6, D3."""
    return store.first_per_document(chunks(spark, sf_dir))


@query("SELECT doc_id AS id, source FROM documents WHERE source NOT IN ('src1', 'src2') AND NOT starts_with(source, 'src1')")
def s9_deletes(spark, sf_dir):
    """What deletes by document and by prefix leave."""
    return store.without_prefix(store.without(chunks(spark, sf_dir), "source", ["src1", "src2"]), "src1").select("id", "source")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 2 THEN 'new' ELSE o_orderstatus END AS v FROM orders")
def s8_upsert(spark, sf_dir):
    """Rows with a known key are replaced, others added; every order is old, new or both."""
    o = read(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 <> 1").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return store.upsert(old, o.where("o_orderkey % 3 <> 2").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("SELECT doc_id AS id FROM documents WHERE contains(source, 'c1')")
def p2_source_contains(spark, sf_dir):
    return chunks(spark, sf_dir).where(F.col("source").contains("c1")).select("id")


@query("SELECT doc_id AS id, lang FROM documents WHERE coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'document') = 'document'")
def p4_global_documents(spark, sf_dir):
    """Rows whose type is document or missing."""
    d = read(spark, sf_dir, "documents").withColumn("meta", F.create_map(F.lit("doc_type"), F.when(F.col("lang") != "en", F.col("lang"))))
    return d.where(F.coalesce(F.col("meta")["doc_type"], F.lit("document")) == "document").select(F.col("doc_id").alias("id"), "lang")


_META = "SELECT event_id, {} AS {} FROM events"


@query("SELECT event_id, coalesce(props::JSON->>'file_path', event_type) AS path, TRY_CAST(coalesce(props::JSON->>'page_number', props::JSON->>'k') AS INT) AS page, CASE WHEN props::JSON->>'k' IS NOT NULL AND props::JSON->>'end' IS NOT NULL THEN (props::JSON->>'k') || '-' || (props::JSON->>'end') END AS lines FROM events")
def p13_fallbacks(spark, sf_dir):
    """First of several metadata keys; a line range needs both ends."""
    m = F.from_json("props", "map<string,string>")
    e = read(spark, sf_dir, "events").withColumn("m", m)
    k = lambda *n: F.coalesce(*(F.col("m")[x] for x in n))
    return e.select("event_id", F.coalesce(k("file_path"), F.col("event_type")).alias("path"), k("page_number", "k").try_cast("int").alias("page"), F.concat(k("k"), F.lit("-"), k("end")).alias("lines"))


@query("SELECT doc_id AS id, CASE WHEN position('tion' IN text) > 0 THEN substr(text, greatest(position('tion' IN text) - 200, 1), 404) END AS context FROM documents")
def p14_context(spark, sf_dir):
    """200 characters around a snippet."""
    at = F.instr("text", "tion")
    return chunks(spark, sf_dir).select("id", F.when(at > 0, F.substring(F.col("text"), F.greatest(at - 200, F.lit(1)), F.lit(404))).alias("context"))


@query("SELECT DISTINCT c_name AS file, c_mktsegment AS space FROM customer WHERE c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND regexp_full_match(c_custkey::VARCHAR, '[0-9]+') AND c_custkey % 5 = 0)")
def p16_source_files(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    hit = (F.col("c_mktsegment") == "BUILDING") | ((F.col("c_mktsegment") == "MACHINERY") & F.col("c_custkey").cast("string").rlike("^[0-9]+$") & (F.col("c_custkey") % 5 == 0))
    return c.where(hit).select(F.col("c_name").alias("file"), F.col("c_mktsegment").alias("space")).distinct()


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'O' AND strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01' AND strftime(o_orderdate, '%Y-%m-%d') <= '1997-06-30'")
def p10_tasks(spark, sf_dir):
    """P10: status and due date, the date compared as text."""
    o = read(spark, sf_dir, "orders").withColumn("due", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.where((F.col("o_orderstatus") == "O") & (F.col("due") >= "1996-01-01") & (F.col("due") <= "1997-06-30")).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


#: Customers and parts as governed documents.
_GOV = """WITH g AS (SELECT p_partkey AS doc_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS department, p_size % 4 AS access_level, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS language,
    p_partkey * 1000 AS timestamp, string_split(p_type, ' ') AS tags, p_name AS author, p_size % 3 = 0 AS pii_present, p_size % 5 = 0 AS gdpr_relevant, p_size % 11 = 0 AS hipaa_relevant, p_size % 6 = 1 AS financial_data, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size * 10 END AS retention_days FROM part)"""


def _governed(spark, sf_dir) -> DataFrame:
    n = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("doc_id"), F.when(n % 7 != 0, F.col("p_brand")).alias("department"), (n % 4).alias("access_level"), F.when(n % 2 == 0, "en").otherwise("de").alias("language"),
        (F.col("p_partkey") * 1000).alias("timestamp"), F.split("p_type", " ").alias("tags"), F.col("p_name").alias("author"), (n % 3 == 0).alias("pii_present"), (n % 5 == 0).alias("gdpr_relevant"),
        (n % 11 == 0).alias("hipaa_relevant"), (n % 6 == 1).alias("financial_data"), F.when(n % 9 != 0, n * 10).alias("retention_days"),
    )


@query(_GOV + " SELECT doc_id FROM g WHERE department IN ('Brand#1', 'Brand#2', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') AND access_level <= 2 AND language = 'en' AND timestamp >= 10000 AND len(list_intersect(tags, ['ECONOMY', 'LARGE', 'SMALL'])) > 0 AND NOT list_contains(tags, 'PROMO')")
def p5_governance(spark, sf_dir):
    f = G.GovernanceFilter(departments=("Brand#1", "Brand#2", "Brand#12", "Brand#13", "Brand#21", "Brand#22"), max_access=2, languages=("en",), start=10_000, any_tags=("ECONOMY", "LARGE", "SMALL"), excluded_tags=("PROMO",))
    return _governed(spark, sf_dir).where(f.predicate()).select("doc_id")


@query(_GOV + " SELECT doc_id FROM g WHERE NOT pii_present AND NOT financial_data AND coalesce(retention_days >= 100, false)")
def p6_compliance(spark, sf_dir):
    return _governed(spark, sf_dir).where(G.ComplianceFilter(exclude_pii=True, exclude_financial=True, min_retention=100).predicate()).select("doc_id")


@query(_GOV + """, u AS (SELECT s_suppkey AS user_id, ['Brand#' || (11 + s_suppkey % 3), 'Brand#' || (21 + s_suppkey % 3)] AS departments, s_nationkey % 4 AS level, s_suppkey % 25 = 0 AS is_admin FROM supplier),
    uc AS (SELECT *, array_to_string(departments, ',') || '|' || level || '|' || is_admin AS class FROM u), gc AS (SELECT *, coalesce(department, '') || '|' || access_level AS class FROM g)
    SELECT 'user' AS kind, user_id AS id, class, NULL::VARCHAR AS other, NULL::BOOLEAN AS allowed, NULL::BIGINT AS user_id, NULL::BIGINT AS doc_id FROM uc UNION ALL SELECT 'document', doc_id, class, NULL, NULL, NULL, NULL FROM gc
    UNION ALL SELECT 'pair', NULL, a.class, b.class, b.access_level <= a.level AND (a.is_admin OR b.department IS NULL OR list_contains(a.departments, b.department)), NULL, NULL
    FROM (SELECT DISTINCT class, departments, level, is_admin FROM uc) a, (SELECT DISTINCT class, department, access_level FROM gc) b
    UNION ALL SELECT 'access', NULL, NULL, NULL, true, user_id, doc_id FROM u, g WHERE access_level <= level AND (is_admin OR department IS NULL OR list_contains(departments, department))""")
def p7_can_access(spark, sf_dir):
    """Every supplier with every part they may read (kind access), and the same as classes: the class of each, and the answer for each two classes."""
    s = F.col("s_suppkey")
    brand = lambda n: F.concat(F.lit("Brand#"), (n + s % 3).cast("string"))
    users = read(spark, sf_dir, "supplier").select(s.alias("user_id"), F.array(brand(11), brand(21)).alias("departments"), (F.col("s_nationkey") % 4).alias("level"), (s % 25 == 0).alias("is_admin"))
    docs = _governed(spark, sf_dir)
    access = G.readable(docs, users).select(F.lit("access").alias("kind"), F.lit(True).alias("allowed"), F.col("user_id").cast("long"), F.col("doc_id").cast("long"))
    return G.access_classes(docs, users).unionByName(access, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def j9_orphans(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "space_id")
    return store.orphans(c, read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("space_id"))).select("c_custkey")


@query("SELECT n_nationkey AS space_id, n_name, count(c_custkey) AS chunks, count(DISTINCT c_mktsegment) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def j10_space_counts(spark, sf_dir):
    """Counts back onto the dimension, zeros included."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("space_id"), "n_name")
    return store.space_counts(n, read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("space_id"), F.col("c_mktsegment").alias("doc_id")))


@query("SELECT c_custkey, coalesce(n_name, 'Unknown') AS space FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def j11_lookup(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("space"))


@query("SELECT c_custkey, coalesce(sum(o_totalprice), 0) > 0 AS bought FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def j1_join_shapes(spark, sf_dir):
    """Inner, semi and anti joins of ids to payloads."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    c = c.join(read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_semi")
    c = c.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    sums = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    return c.join(sums, "c_custkey", "left").select("c_custkey", (F.coalesce("s", F.lit(0.0)) > 0).alias("bought"))


@query("SELECT l_orderkey, string_agg(CASE WHEN l_linenumber = 1 THEN 'X' ELSE f END, ',' ORDER BY l_linenumber) AS merged FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) GROUP BY 1")
def u4_map_merge(spark, sf_dir):
    """U4: two maps, the right one wins (here key 1)."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag")).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("v")))).alias("a"), F.max(F.when(F.col("l_linenumber") == 1, 1)).alias("one"))
    right = F.when(F.col("one") == 1, F.create_map(F.lit(1), F.lit("X"))).otherwise(F.create_map().cast("map<int,string>"))
    merged = F.map_concat(F.map_filter("a", lambda k, v: ~F.map_contains_key(right, k)), right)
    return li.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: e["value"]), ",").alias("merged"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def u5_except(spark, sf_dir):
    """U5 (an extra)."""
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT o_orderkey AS snapshot FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 30 DAYS OR (o_orderstatus = 'O' AND n > 7)")
def w12_retention(spark, sf_dir):
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot"), F.col("o_custkey").alias("space_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "O").alias("automatic"))
    return store.expired_snapshots(s, F.lit("1997-01-01").cast("timestamp")).select("snapshot")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def l4_latest_wins(spark, sf_dir):
    """L4: an upsert log as its current rows."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return store.latest_wins(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id AS id, lang AS space_id, n_chars FROM documents WHERE lang = 'de' OR doc_id % 2 = 0")
def s32_restore(spark, sf_dir):
    """A space is snapshot, then half of all chunks go and the space is changed, then it is restored; the others stay as they were changed."""
    kept, shots = store.VersionedStore(spark, shared_folder(spark, "space")), snapshots.Snapshots(spark, shared_folder(spark, "snapshots"))
    kept.write(chunks(spark, sf_dir).select("id", "space_id", "n_chars"))
    name = shots.create(kept.read(), "de", datetime(2024, 1, 1), "before_change")
    kept.write(kept.read().where("id % 2 = 0").withColumn("n_chars", F.when(F.col("space_id") == "de", -1).otherwise(F.col("n_chars"))))
    shots.restore(name, kept)
    return kept.read()


@query("""WITH c AS (SELECT conv_id, max(turn) AS turns, conv_id % 7 = 0 AS pinned, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (conv_id * 7919 % 1009) AS updated_at FROM conversations GROUP BY conv_id)
    SELECT *, row_number() OVER (ORDER BY pinned DESC, updated_at DESC, conv_id) AS place FROM c QUALIFY place <= 50""")
def l4_chat_list(spark, sf_dir):
    """L4: the first 50 conversations, pinned ones first, then the latest (a top-k report)."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    hours = F.make_interval(hours=(F.col("conv_id") * 7919 % 1009).cast("int"))
    c = c.withColumns({"pinned": F.col("conv_id") % 7 == 0, "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp") + hours})
    return store.chat_list(c, 50)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS markdown, count(*) AS n FROM conversations GROUP BY conv_id")
def s31_chat_export(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n").alias("markdown"), "n")


@query("""SELECT conv_id, '{"turn":' || max(turn) || ',"messages":' || count(*) || '}' AS report FROM conversations GROUP BY conv_id""")
def s30_json_report(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count(F.lit(1)).alias("messages"))
    return c.select("conv_id", F.to_json(F.struct("turn", "messages")).alias("report"))
