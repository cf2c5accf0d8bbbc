"""Text functions, field extraction, chunking and query analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, nlq, text as T
from ..config import EngineConfig
from ..operators import chunking, rank
from ..operators.lineage import spread
from ..sources.html import BLOCKS, ENTITIES, strip_tags
from ..tables import read
from . import query
from .curation import found_hits


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rule_sql(rules: list, default: str, q: str) -> str:
    """The rules as a CASE for DuckDB."""
    n = f"len(list_filter(regexp_split_to_array({q}, '\\s+'), lambda w: w <> ''))"

    def one(kind, v):
        if kind in ("any", "none"):
            s = "(" + " OR ".join(f"contains({q}, {_quote(x)})" for x in v) + ")"
            return s if kind == "any" else f"NOT {s}"
        if kind == "all":
            return "(" + " AND ".join(f"contains({q}, {_quote(x)})" for x in v) + ")"
        if kind == "starts":
            return "(" + " OR ".join(f"starts_with({q}, {_quote(x)})" for x in v) + ")"
        if kind == "equals":
            return f"{q} IN ({', '.join(map(_quote, v))})"
        if kind == "regex":
            return f"regexp_matches({q}, {_quote(v)})"
        if kind == "words_at_most":
            return f"{n} <= {v}"
        if kind == "words_over":
            return f"{n} > {v}"
        return f"length({q}) - length(replace({q}, '?', '')) > {v}"

    return "CASE " + " ".join(f"WHEN {' AND '.join(one(k, v) for k, v in cs)} THEN '{name}'" for name, cs in rules) + f" ELSE '{default}' END"


#: Queries made of the turns: a lead phrase by conversation, then the turn.
_LEADS = ["", "what is the clause ", "hi ", "compare ", "how many ", "find ", "calculate ", "show me that ", "where and ", "in 2023 the ", "explain ", "latest ", "create a function ", "ok ", "my salary is "]
_Q_SQL = "SELECT conv_id, turn, lead || array_to_string(regexp_split_to_array(text, '\\s+'), ' ') AS q FROM (SELECT *, (" + "CASE conv_id % 15 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(_LEADS)) + " END) AS lead FROM conversations)"


def _queries(spark, sf_dir):
    """The lead and the turn."""
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("conv_id") % 15 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, F.array_join(F.split("text", r"\s+"), " ")).alias("q"))


@query(f"SELECT conv_id, turn, {_rule_sql(nlq.INTENTS, 'GeneralKnowledge', 'lower(q)')} AS intent, {_rule_sql(nlq.CONTEXTS, 'DocumentQuery', 'lower(q)')} AS context, {_rule_sql(nlq.RETRIEVAL, 'false', 'lower(q)')} = 'true' AS retrieve, {_rule_sql(nlq.ROUTES, 'search', 'lower(q)')} AS route FROM ({_Q_SQL})")
def f7_intent(spark, sf_dir):
    """Intents, context, the retrieval gate and the route."""
    q = F.col("q")
    return _queries(spark, sf_dir).select("conv_id", "turn", nlq.intent(q).alias("intent"), nlq.context_intent(q).alias("context"), nlq.should_retrieve(q).alias("retrieve"), nlq.route(q).alias("route"))


_TAILS = ["", " where total > 10.5", " amount <  99 and > 7", " greater than 3", " since 1998 < x", " less than 2.5.1 > 4.x"]
_TAIL_SQL = "CASE (conv_id + turn) % 6 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(_TAILS)) + " END"


@query(f"""WITH t AS (SELECT conv_id, turn, q || {_TAIL_SQL} AS q FROM ({_Q_SQL})),
    y AS (SELECT *, TRY_CAST(nullif(regexp_extract(q, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INT) AS year FROM t)
    SELECT conv_id, turn, contains(q, '>') OR contains(q, '<') OR contains(q, 'where') OR contains(q, 'greater than') OR contains(q, 'less than') AS filtering, year, make_date(year, 1, 1)::VARCHAR AS first_day, make_date(year, 12, 31)::VARCHAR AS last_day,
        TRY_CAST(nullif(regexp_extract(q, '^[^>]*>\\s*([0-9.]+)', 1), '') AS DOUBLE) AS above, TRY_CAST(nullif(regexp_extract(q, '^[^<]*<\\s*([0-9.]+)', 1), '') AS DOUBLE) AS below,
        array_to_string(list_sort(list_distinct(regexp_extract_all(q, '[A-Z][a-z]+(?: [A-Z][a-z]+)*'))), '|') AS names FROM y""")
def f9_requirements(spark, sf_dir):
    """filters, years, bounds and names of each turn, some of which go on with a condition."""
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    r = _queries(spark, sf_dir).select("conv_id", "turn", nlq.requirements(F.concat("q", tail)).alias("r")).select("conv_id", "turn", "r.*")
    return r.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string"), "names": F.array_join(F.array_sort("names"), "|")})


def _of_intent(field: int) -> str:
    return "CASE intent " + " ".join(f"WHEN {_quote(n)} THEN {_quote(v[field]) if isinstance(v[field], str) else v[field]}" for n, v in nlq.STRATEGIES.items()) + " END"


@query(f"SELECT *, {_of_intent(0)} AS strategy, {_of_intent(1)} AS k, {_of_intent(2)}::DOUBLE AS confidence FROM (SELECT conv_id, turn, {_rule_sql(nlq.INTENTS, 'GeneralKnowledge', 'lower(q)')} AS intent FROM ({_Q_SQL}))")
def f10_strategy(spark, sf_dir):
    """The whole analysis of a query as one row."""
    q = _queries(spark, sf_dir)
    s = nlq.strategy(nlq.intent(F.col("q")))
    return q.select("conv_id", "turn", nlq.intent(F.col("q")).alias("intent"), s["strategy"].alias("strategy"), s["k"].alias("k"), s["confidence"].alias("confidence"))


@query("SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: strlen(w) > 1 AND w NOT IN (" + ", ".join(map(_quote, nlq.STOP_WORDS)) + f")), ' ') AS keywords FROM ({_Q_SQL})")
def f18_keywords(spark, sf_dir):
    return _queries(spark, sf_dir).select("conv_id", "turn", F.array_join(nlq.keywords(F.col("q")), " ").alias("keywords"))


_KEYWORDS = "list_filter(list_transform(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), lambda w: strlen(w) > 1 AND w NOT IN (" + ", ".join(map(_quote, nlq.STOP_WORDS)) + "))"
_SYNONYM = "CASE " + " ".join(f"WHEN contains(l, {_quote(t)}) AND NOT contains(l, {_quote(w)}) THEN regexp_replace(l, {_quote(t)}, {_quote(w)})" for t, ws in nlq.SYNONYMS for w in ws.split()) + " END"


@query(f"""WITH q AS (SELECT conv_id, turn, lower(q) AS l, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) AS n, array_to_string({_KEYWORDS}, ' ') AS kw FROM ({_Q_SQL})),
    a AS (SELECT *, list_filter([l, kw, {_SYNONYM}], lambda v: v IS NOT NULL AND v <> '') AS v FROM q),
    d AS (SELECT conv_id, turn, CASE WHEN n BETWEEN 2 AND 20 THEN list_filter(v, lambda x, i: list_position(v, x) = i)[1:3] ELSE [l] END AS v FROM a)
    SELECT conv_id, turn, i - 1 AS n, v[i] AS variant FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM d)""")
def f13_expansion(spark, sf_dir):
    return _queries(spark, sf_dir).select("conv_id", "turn", F.posexplode(nlq.expand(F.col("q"))).alias("n", "variant"))


@query()
def f6_decompose(spark, sf_dir):
    """the parts of each turn, whose sentences are asked in one breath."""
    d = nlq.decompose(F.replace("q", F.lit(". "), F.lit(" and ")))
    return _queries(spark, sf_dir).select("conv_id", "turn", d.alias("d")).select("conv_id", "turn", F.col("d.strategy").alias("strategy"), F.posexplode("d.parts").alias("place", "part"))


@query("SELECT doc_id, (strlen(text) + 3) // 4 AS tokens, length(text) AS chars, strlen(text) AS bytes FROM documents")
def f1_token_estimate(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", rank.token_estimate(F.col("text")).alias("tokens"), F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"))


_FIELD_SQL = ", ".join(f"nullif(array_to_string(regexp_extract_all(text, {_quote(p)}), {_quote(s)}), '') AS {n}" for n, (p, s) in T.FIELDS.items() if n != "phones")


@query(f"SELECT doc_id, {_FIELD_SQL}, nullif(regexp_extract(text, {_quote(T.INVOICE)}, 1), '') AS invoice_no FROM documents")
def c5_fields(spark, sf_dir):
    f = T.extracted_fields(F.col("text"))
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(v.alias(k) for k, v in f.items() if k != "phones"))


@query("SELECT doc_id, nullif(array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?:\\+91[ \\t-]?)?(?:[0-9][ \\t-]?){10}'), lambda p: regexp_replace(p, '[^0-9+]', '', 'g')), lambda p: length(p) >= 10), ', '), '') AS phones FROM documents")
def c5_phones(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.extracted_fields(F.col("text"))["phones"].alias("phones"))


@query()
def c1_chunks(spark, sf_dir):
    """Chunks with byte offsets, headings and context."""
    d = spread(read(spark, sf_dir, "documents"))
    return chunking.chunks(d, title=F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), source=F.col("source"))


def _sections(spark, sf_dir):
    """Customers as tables of their orders and as forms, documents as pages of text."""
    o, c, d = (read(spark, sf_dir, t) for t in ("orders", "customer", "documents"))
    none = {"fields": "array<struct<k:string,v:string>>", "headers": "array<string>", "rows": "array<array<string>>", "content": "string", "page": "int"}
    fill = lambda *have: [F.lit(None).cast(t).alias(n) for n, t in none.items() if n not in have]
    tables = o.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("doc_id")).agg(F.sort_array(F.collect_list(F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))).alias("rows"))
    tables = tables.select("doc_id", F.lit("table").alias("kind"), "rows", F.array(F.lit("order"), F.lit("status"), F.lit("priority")).alias("headers"), *fill("rows", "headers"))
    forms = c.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("doc_id"), F.lit("form").alias("kind"), F.array(F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v"))).alias("fields"), *fill("fields"))
    texts = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("text").alias("kind"), F.col("text").alias("content"), (F.col("doc_id") % 9).cast("int").alias("page"), *fill("content", "page"))
    return tables, forms, texts


@query()
def c4_section_chunks(spark, sf_dir):
    """C4: chunks of tables, forms and pages of text."""
    tables, forms, texts = _sections(spark, sf_dir)
    return chunking.section_chunks(tables.unionByName(forms).unionByName(texts))


@query("""WITH RECURSIVE o AS (SELECT 'c' || o_custkey AS doc_id, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey::VARCHAR, o_orderstatus, o_orderpriority) AS i FROM orders),
    g AS (SELECT doc_id, i, line, strlen(line) + 1 AS size, 0 AS chunk FROM o WHERE i = 1
        UNION ALL SELECT o.doc_id, o.i, o.line, CASE WHEN g.size + strlen(o.line) + 1 > 180 - 58 THEN strlen(o.line) + 1 ELSE g.size + strlen(o.line) + 1 END, g.chunk + CASE WHEN g.size + strlen(o.line) + 1 > 180 - 58 THEN 1 ELSE 0 END FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1)
    SELECT doc_id, 'table' AS kind, chunk AS chunk_index, '| order | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text FROM g GROUP BY doc_id, chunk
    UNION ALL SELECT 'f' || c_custkey, 'form', 0, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment FROM customer""".replace("- 58", f"- {len('| order | status | priority |') + len('| --- | --- | --- |') + 2}"))
def c4_tables(spark, sf_dir):
    """C4: tables and forms in chunks of at most 180 bytes."""
    tables, forms, _ = _sections(spark, sf_dir)
    small = EngineConfig(chunk_size=180, chunk_overlap=20, min_chunk=1)
    return chunking.section_chunks(tables.unionByName(forms), small).select("doc_id", "kind", "chunk_index", "text")


_LOOSE = """'chart {"type": "bar", "title": "{' || conv_id || '", "data": {"labels": ["}", "b"], "datasets": [{"label": "n", "data": [' || turn || ', 2]}]}}'"""


@query(f"""SELECT conv_id, turn, role, length({_LOOSE}) - 6 AS chart_chars, '{{' || conv_id AS title, turn::DOUBLE AS first_value, coalesce(length(text), 0) + 11 AS text_chars FROM conversations""")
def f26_loose_charts(spark, sf_dir):
    """turns that hold a chart without a fence, and a broken one that stays text."""
    c = read(spark, sf_dir, "conversations")
    chart = F.format_string('chart {"type": "bar", "title": "{%d", "data": {"labels": ["}", "b"], "datasets": [{"label": "n", "data": [%d, 2]}]}}', "conv_id", "turn")
    spans = c.select("conv_id", "turn", "role", answers.loose_charts(F.concat(F.coalesce("text", F.lit("")), chart, F.lit(" chart {no}"))).alias("s"))
    of = lambda kind: F.filter("s", lambda x: x["kind"] == kind)
    body = F.get(of("chart"), F.lit(0))["body"]
    texts = F.aggregate(of("text"), F.lit(0), lambda n, x: n + F.length(x["body"]))
    return spans.select("conv_id", "turn", "role", F.length(body).alias("chart_chars"), F.get_json_object(body, "$.title").alias("title"), F.get_json_object(body, "$.data.datasets[0].data[0]").cast("double").alias("first_value"), texts.alias("text_chars"))


@query()
def f4_compress(spark, sf_dir):
    """The three best sentences of each hit for its benchmark item."""
    return found_hits(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("query_id").alias("item_id"), T.compress(F.col("text"), F.col("query"), 3).alias("text"))


@query("SELECT doc_id, CASE WHEN lower(text) = lower(source) THEN 1.0 WHEN starts_with(lower(text), lower(source)) THEN 0.9 WHEN contains(lower(text), lower(source)) THEN 0.7 + 0.2 * length(source) / length(text) ELSE round(len(list_filter(string_split(lower(source), ''), lambda c: contains(lower(text), c))) / greatest(length(text), length(source)), 6) END AS similarity FROM documents WHERE length(text) >= length(source)")
def f23_similarity(spark, sf_dir):
    """a document's source name against its text, where the text is the longer one."""
    d = read(spark, sf_dir, "documents").where(F.length("text") >= F.length("source"))
    return d.select("doc_id", F.round(T.similarity(F.col("source"), F.col("text")), 6).alias("similarity"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\b\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}\\b', '[DATE]', 'g'), '[A-Z][a-z]+ [A-Z][a-z]+', '[NAME]', 'g'), '\\d+', '[NUMBER]', 'g') AS masked FROM documents")
def f33_placeholders(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.placeholders(F.col("text")).alias("masked"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped, trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g')) AS safe FROM documents")
def f35_escape(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.escape_html(F.col("text")).alias("escaped"), T.safe_id(F.col("source")).alias("safe"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS hour_key, hour(ts) AS hour, (isodow(ts) - 1) AS weekday, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part FROM events")
def f39_dates(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd-HH").alias("hour_key"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), T.time_of_day(F.col("ts")).alias("part"))


@query("SELECT conv_id, turn, contains(text, '?') OR contains(lower(text), 'todo') OR contains(lower(text), 'to do') AS unresolved FROM conversations")
def f37_unresolved(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.unresolved(F.col("text")).alias("unresolved"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN floor(c_acctbal)::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.4f', c_acctbal), '0+$', ''), '\\.$', '') END AS cell FROM customer")
def s21_cells(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", T.cell(F.col("c_acctbal")).alias("cell"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def f30_norms(spark, sf_dir):
    from ..operators import vector

    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.l2_norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT p_partkey, CASE WHEN p_size * 49999 < 1024 THEN (p_size * 49999) || ' B' WHEN p_size * 49999 < 1048576 THEN printf('%.1f KB', p_size * 49999 / 1024) ELSE printf('%.1f MB', p_size * 49999 / 1048576) END AS size FROM part")
def l12_file_size(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.file_size(F.col("p_size") * 49_999).alias("size"))


def _strip_sql() -> str:
    t = "regexp_replace(html, '(?is)<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)|<!--.*?(?:-->|\\z)', '', 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'g'), '(?i)</?(?:td|th)\\b[^>]*>', chr(9), 'g'), '<[^>]*>', '', 'g')"
    for a, b in ENTITIES:
        t = f"replace({t}, {_quote(a)}, {_quote(b)})"
    t = f"regexp_replace(regexp_replace({t}, '[ \\r\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    return f"trim(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'))"


@query(f"SELECT page_id, {_strip_sql()} AS text FROM pages")
def s16_html_text(spark, sf_dir):
    """Tags stripped, block elements as lines."""
    return read(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))
