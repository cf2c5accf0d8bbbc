"""Field and phrase search, filtered hybrid search, relevance, history, follow-ups, index upkeep and exports."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import answers, nlq
from ..operators import activity, chunking, evaluate, fts, hooks, memory as M, rank, segments, store
from ..operators.lineage import shared_folder
from ..plans import search
from ..tables import chunks, read, search_events, with_views
from . import ORACLE_SQL, query
from .curation import best_hits
from .retrieval import _BM25, _TOK
from .texts import _Q_SQL, _queries, _quote


def _items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# ------------------------------------------------------------------ search

_FIELDS = f"""
    q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK.format('text')}) AS term FROM benchmark),
    d AS (SELECT 'text' AS field, id, {_TOK.format('text')} AS ws FROM chunks UNION ALL SELECT 'title', id, {_TOK.format('title')} FROM chunks),
    st AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM d GROUP BY field),
    e AS (SELECT field, id, len(ws) AS dl, unnest(ws) AS term FROM d),
    p AS (SELECT field, term, id, dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL),
    h AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
          FROM p JOIN df USING (field, term) JOIN st USING (field) JOIN q USING (term) GROUP BY ALL)"""


@query(with_views("," + _FIELDS + " SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM h QUALIFY rank <= 10", "chunks"))
def v4_bm25_fields(spark, sf_dir):
    """V4: BM25 over text and title, each field with its own statistics."""
    return fts.bm25(chunks(spark, sf_dir), _items(spark, sf_dir), 10, id_col="id", title_col="title").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_PHRASE = f"""
    ask AS (SELECT item_id AS query_id, {_TOK.format('text')} AS ph FROM benchmark),
    d AS MATERIALIZED (SELECT doc_id AS id, ws, ' ' || array_to_string(ws, '  ') || ' ' AS s FROM (SELECT doc_id, {_TOK.format('text')} AS ws FROM documents)),
    st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
    t AS (SELECT DISTINCT query_id, unnest(ph) AS term FROM ask),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY term),
    idf AS (SELECT query_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM t JOIN df USING (term), st GROUP BY query_id),
    h AS (SELECT query_id, id, len(ws) AS dl, (length(s) - length(replace(s, ' ' || array_to_string(ph, '  ') || ' ', ''))) / length(' ' || array_to_string(ph, '  ') || ' ') AS tf FROM ask JOIN d ON contains(s, ' ' || array_to_string(ph, '  ') || ' ') WHERE len(ph) > 0),
    s AS (SELECT query_id, id, round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM h JOIN idf USING (query_id), st WHERE tf > 0)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"""


@query("WITH" + _PHRASE)
def v4_phrase_fallback(spark, sf_dir):
    """V4: a query with a stray quotation mark does not parse and is searched as a phrase over the text; the whole item."""
    words = fts.tokens(F.col("query"))
    q = _items(spark, sf_dir).select("query_id", F.concat(F.lit('"'), F.array_join(words, " ")).alias("query"))
    return fts.search(read(spark, sf_dir, "documents"), q, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_KEEP = "lang = 'en' AND 1700000000 + doc_id * 3600 >= 1700100000"


@query(ORACLE_SQL["hybrid_search"].replace("WITH", f"WITH docs_f AS (SELECT * FROM documents WHERE {_KEEP}), emb_f AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM docs_f)),", 1).replace("FROM documents)", "FROM docs_f)").replace("AS score FROM embeddings, qv", "AS score FROM emb_f, qv").replace("JOIN documents d ON", "JOIN docs_f d ON"))
def hybrid_search_filtered(spark, sf_dir):
    """The space and date filter holds for both lists before they are ranked."""
    where = store.MetadataFilter(space_id="en", after=1_700_100_000)
    return search.hybrid(spark, sf_dir, where=where).select("query_id", "id", "source", "found_by", F.round("score", 6).alias("score"), "rank")


@query()
def hybrid_search_reranked(spark, sf_dir):
    """V10 and V4 in the search pipeline: text and title, hits reranked by a hook."""
    return search.hybrid(spark, sf_dir, reranker=rank.lexical_overlap, title=True).select("query_id", "id", "source", F.round("score", 6).alias("score"), "rank")


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(q), {_quote(x)})" for x in parts) + ")"


@query(f"SELECT conv_id, turn, CASE WHEN {_any(nlq.BROAD)} OR ({_any(nlq.BROAD_PLACES)} AND {_any(nlq.BROAD_PLURALS)}) THEN 40 ELSE 20 END AS k FROM ({_Q_SQL})")
def t4_broad_k(spark, sf_dir):
    """T4: results asked for by a broad query and by any other."""
    return _queries(spark, sf_dir).select("conv_id", "turn", search.candidates_for(F.col("q")).alias("k"))


# ------------------------------------------------------------------ relevance and citations

_SPLIT = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: w <> '')"
_STOP = ", ".join(map(_quote, nlq.RELEVANCE_STOP_WORDS))


@query(f"""WITH v AS (SELECT term, count(*) / (SELECT count(*) FROM documents) AS share FROM (SELECT DISTINCT doc_id, unnest({_SPLIT.format('text')}) AS term FROM documents) GROUP BY term),
    q AS (SELECT conv_id, turn, q FROM ({_Q_SQL})),
    k AS (SELECT conv_id, turn, unnest(list_filter({_SPLIT.format('q')}, lambda w: strlen(w) > 2 AND w NOT IN ({_STOP}))) AS term FROM q),
    c AS (SELECT conv_id, turn, count(share) / count(*) AS coverage, coalesce(avg(share), 0) AS term_frequency FROM k LEFT JOIN v USING (term) GROUP BY ALL),
    t AS (SELECT bool_or({' OR '.join(f"contains(source, {_quote(x)})" for x in nlq.LEGAL_TYPES)}) AS legal, bool_or({' OR '.join(f"contains(source, {_quote(x)})" for x in nlq.TAX_TYPES)}) AS tax FROM documents),
    m AS (SELECT conv_id, turn, CASE WHEN ({_any(nlq.LEGAL_TERMS)} AND legal) OR ({_any(nlq.TAX_TERMS)} AND tax) THEN 0.9 WHEN ({_any(nlq.LEGAL_TERMS)} AND NOT legal) OR ({_any(nlq.TAX_TERMS)} AND NOT tax) THEN 0.1 ELSE 0.5 END AS domain FROM q, t)
    SELECT conv_id, turn, round(coverage, 6) AS coverage, round(CASE WHEN coverage IS NULL THEN 0 ELSE domain END, 6) AS domain, round(term_frequency + 1e-9, 6) AS term_frequency, round(1e-9 + coverage * 0.4 + domain * 0.4 + term_frequency * 0.2, 6) AS confidence FROM c JOIN m USING (conv_id, turn)""")
def f8_relevance(spark, sf_dir):
    """Share of a query's keywords that the corpus has, its domain and how common its terms are."""
    d, q = read(spark, sf_dir, "documents"), _queries(spark, sf_dir)
    vocabulary = d.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    vocabulary = vocabulary.crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("n")))).select("term", (F.col("df") / F.col("n")).alias("share"))  # one row
    has = lambda parts: F.max(nlq._holds_any(F.col("source"), parts))
    types = d.agg(has(nlq.LEGAL_TYPES).alias("legal"), has(nlq.TAX_TYPES).alias("tax"))  # one row
    k = q.select("conv_id", "turn", F.explode(nlq.relevance_keywords(F.col("q"))).alias("term")).where("term <> ''").join(vocabulary, "term", "left")
    c = k.groupBy("conv_id", "turn").agg((F.count("share") / F.count(F.lit(1))).alias("coverage"), F.coalesce(F.avg("share"), F.lit(0.0)).alias("term_frequency"))
    m = q.crossJoin(F.broadcast(types)).select("conv_id", "turn", nlq.domain_match(F.col("q"), F.col("legal"), F.col("tax")).alias("domain"))
    score = F.col("coverage") * 0.4 + F.col("domain") * 0.4 + F.col("term_frequency") * 0.2
    return c.join(m, ["conv_id", "turn"]).select("conv_id", "turn", F.round("coverage", 6).alias("coverage"), "domain", F.round(F.col("term_frequency") + 1e-9, 6).alias("term_frequency"), F.round(score + 1e-9, 6).alias("confidence"))


@query("""WITH c AS (SELECT l_orderkey AS query_id, row_number() OVER () AS n, 'lib/p' || (l_partkey % 50) || '.rs' AS path, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity::INT END AS line FROM lineitem),
    s AS (SELECT l_orderkey AS query_id, CASE WHEN l_linenumber % 4 = 1 THEN 'src\\lib\\p' ELSE 'p' END || (l_partkey % 50) || '.rs' AS path, l_linenumber * 5 AS first, l_linenumber * 5 + 20 AS last FROM lineitem WHERE l_linenumber % 2 = 1),
    j AS (SELECT c.*, s.first, s.last, ends_with(replace(s.path, '\\', '/'), c.path) OR ends_with(c.path, replace(s.path, '\\', '/')) AS fits FROM c LEFT JOIN s USING (query_id)),
    r AS (SELECT query_id, n, CASE WHEN NOT coalesce(bool_or(fits), false) THEN 'file' WHEN any_value(line) IS NOT NULL AND NOT coalesce(bool_or(fits AND line BETWEEN first AND last), false) THEN 'line' END AS reason FROM j GROUP BY ALL)
    SELECT query_id, count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason = 'file') AS bad_files, round(count(*) FILTER (reason IS NULL) / count(*), 6) AS confidence FROM r GROUP BY query_id""")
def j13_citations(spark, sf_dir):
    """Order lines as citations of an answer, its odd lines as the sources retrieved."""
    li = read(spark, sf_dir, "lineitem")
    part = (F.col("l_partkey") % 50).cast("string")
    n = F.col("l_linenumber")
    cited = li.select(F.col("l_orderkey").alias("query_id"), n, F.concat(F.lit("lib/p"), part, F.lit(".rs")).alias("path"), F.when(n % 3 > 0, F.col("l_quantity").cast("int")).alias("line"))
    ranges = F.array(F.struct((n * 5).alias("first"), (n * 5 + 20).alias("last")))
    sources = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("query_id"), F.concat(F.when(n % 4 == 1, F.lit("src\\lib\\p")).otherwise(F.lit("p")), part, F.lit(".rs")).alias("path"), ranges.alias("ranges"))
    checked = evaluate.citation_validity(cited, sources)
    bad = checked.groupBy("query_id").agg(F.count_if(F.col("reason") == "file").alias("bad_files"))
    return evaluate.citation_confidence(checked).join(bad, "query_id").withColumn("confidence", F.round("confidence", 6))


# ------------------------------------------------------------------ history and follow-ups

@query("WITH" + _BM25 + " SELECT item_id AS query_id, text AS query, 'global' AS space_id, count(id) AS result_count FROM benchmark LEFT JOIN fts ON query_id = item_id GROUP BY ALL")
def l9_search_history(spark, sf_dir):
    """Searches appended to the history with their number of results."""
    found = best_hits(spark, sf_dir)[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return _items(spark, sf_dir).join(found, "query_id", "left").select("query_id", "query", F.lit("global").alias("space_id"), F.coalesce("n", F.lit(0)).alias("result_count"))


@query(with_views(""", h AS (SELECT user_id AS owner, log.query, log.ts, log.event_id FROM log JOIN events USING (event_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY log.ts DESC, event_id DESC) <= 20),
    a AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS age FROM h),
    t AS (SELECT DISTINCT owner, text FROM h, (SELECT unnest(['cli', 'w 3', 'signup']) AS text)),
    s AS (SELECT owner, text, query, age, CASE WHEN starts_with(lower(query), text) THEN 0.9 ELSE 0.7 + 0.2 * length(text) / length(query) END AS score FROM a JOIN t USING (owner) WHERE contains(lower(query), text))
    SELECT owner, text, query, round(score, 6) AS score, row_number() OVER (PARTITION BY owner, text ORDER BY score DESC, age) AS place FROM s QUALIFY place <= 5""", "log"))
def f24_suggestions(spark, sf_dir):
    """what a user typed, completed from the last searches."""
    log = search_events(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("owner")), "event_id")
    typed = log.select("owner").distinct().select("owner", F.explode(F.array(F.lit("cli"), F.lit("w 3"), F.lit("signup"))).alias("text"))
    return activity.suggestions(log, typed).withColumn("score", F.round("score", 6))


@query("""WITH p AS (SELECT user_id AS query_id, ts, event_id, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
    SELECT query_id, value, row_number() OVER (PARTITION BY query_id ORDER BY event_id) AS place FROM p WHERE prev IS NULL OR prev <> value QUALIFY place <= 5""")
def d4_adjacent_dedup(spark, sf_dir):
    """Completions without adjacent repeats, five of each."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), "event_id", F.col("event_type").alias("value"))
    return rank.dedup_adjacent(e, "value", "event_id", 5).select("query_id", "value", "place")


_FOLLOW = ["what is her salary", "tell me more", "and the PAN?", "explain", "google", "open it please", "what about the address", "Is that? right", "PAN", "and then", "find the total of all invoices", " salary "]


@query()
def f12_rewrite(spark, sf_dir):
    """Follow-ups of each turn, rewritten by rules; the generating hook stands in where it has an answer."""
    c = read(spark, sf_dir, "conversations")
    pick = lambda n: F.col("conv_id") % n + F.col("turn")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lead = F.element_at(F.array(*map(F.lit, _FOLLOW)), (pick(97) % len(_FOLLOW) + 1).cast("int"))
    said = F.when(pick(2) == 0, lead).when(pick(2) == 1, F.col("text")).otherwise(F.concat(lead, F.lit(" "), F.split("text", r"\.")[0]))  # a phrase, the turn, or both
    rows = c.select("conv_id", "turn", "role", said.alias("q"), F.when(pick(5) % 3 > 0, "Asha Rao").alias("entity"), F.when(pick(7) % 4 == 0, "report.pdf").alias("file"), F.when(pick(3) % 2 == 0, "payroll").alias("topic"), F.when(pick(11) % 2 == 0, F.array(*map(F.lit, ["tax", "rent", "loan", "fee"]))).otherwise(F.array().cast("array<string>")).alias("concepts"), F.lag("text").over(w).alias("last"))
    plain = answers.rewrite_in_context(*(F.col(n) for n in ("q", "entity", "file", "topic", "concepts", "last")))
    hooked = answers.rewrite_with(F.col("q"), F.concat_ws("\n", "last", "q"), lambda p: F.when(F.col("role") == "system", F.upper(p)), plain)
    return rows.select("conv_id", "turn", "role", "q", "entity", "file", "topic", "concepts", "last", plain.alias("rewritten"), hooked.alias("with_hook"))


_MEMORY = "m AS (SELECT conv_id AS owner, turn AS id, CASE WHEN role = 'user' THEN 'Conversation' WHEN role = 'assistant' THEN 'Learning' ELSE 'Context' END AS type, text AS content, ((turn * 37 + conv_id * 11) % 100) / 100 AS importance, TIMESTAMP '2024-01-20' - INTERVAL 1 DAY * (turn + conv_id % 6) AS created_at FROM conversations)"


def _memories(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "Conversation").when(F.col("role") == "assistant", "Learning").otherwise("Context")
    age = (F.col("turn") + F.col("conv_id") % 6).cast("int")
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("owner"), F.col("turn").alias("id"), kind.alias("type"), F.col("text").alias("content"), ((F.col("turn") * 37 + F.col("conv_id") * 11) % 100 / 100).alias("importance"),
        (F.lit("2024-01-20").cast("timestamp") - F.make_interval(days=age)).alias("created_at"), F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("entities"),
    )


@query(f"WITH {_MEMORY} SELECT owner, id, '[' || type || '] ' || substr(content, 1, 100) || ' (importance: ' || printf('%.2f', importance) || ')' AS line FROM m")
def l16_memory_lines(spark, sf_dir):
    return _memories(spark, sf_dir).select("owner", "id", M.line(F.col("type"), F.col("content"), F.col("importance")).alias("line"))


@query(f"""WITH {_MEMORY}, k AS (SELECT * REPLACE (replace(content, ',', '?') AS content) FROM m), r AS (SELECT * FROM k WHERE created_at BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id, content) <= 5)
    SELECT owner, id, 'Continue discussing: ' || CASE WHEN contains(content, '?') THEN 'unanswered question' ELSE 'incomplete task' END AS suggestion FROM r WHERE type = 'Conversation' AND (contains(content, '?') OR contains(lower(content), 'todo'))""")
def l17_continuations(spark, sf_dir):
    """What recent conversations left open; a comma stands for a question mark, as the table has none."""
    asked = _memories(spark, sf_dir).withColumn("content", F.replace("content", F.lit(","), F.lit("?")))
    return M.continuations(asked, "owner", F.lit("2024-01-20").cast("timestamp"))


@query(f"WITH {_MEMORY} SELECT owner, id, created_at, row_number() OVER (PARTITION BY owner ORDER BY created_at DESC, id, content) AS place FROM m QUALIFY place <= 3")
def f32_temporal(spark, sf_dir):
    return M.retrieve_by_time(_memories(spark, sf_dir), "owner", 3).select("owner", "id", "created_at", "place")


@query(f"""WITH {_MEMORY}, h AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(content), '\\s+')), ['the', 'of', 'and', 'was'])) AS hits FROM m)
    SELECT owner, id, hits, row_number() OVER (PARTITION BY owner ORDER BY hits DESC, created_at DESC, id, content) AS place FROM h WHERE hits > 0 QUALIFY place <= 3""")
def f32_by_entities(spark, sf_dir):
    """F32: the causal and associative modes."""
    return M.retrieve_by_entities(_memories(spark, sf_dir), "owner", ["the", "of", "and", "was"], 3).select("owner", "id", F.col("hits").cast("long").alias("hits"), "place")


# ------------------------------------------------------------------ the store and its index

@query("WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Docs\\' || c_mktsegment ELSE 'Docs\\' || c_mktsegment || '\\' || c_custkey END AS source FROM customer) SELECT c_custkey, source FROM s WHERE source <> 'Docs\\BUILDING'")
def l2_folder_delete(spark, sf_dir):
    """L2: no source begins with the normalised path, so the path as given decides."""
    folder = F.concat(F.lit("Docs\\"), "c_mktsegment")
    c = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, folder).otherwise(F.concat(folder, F.lit("\\"), F.col("c_custkey").cast("string"))).alias("source"))
    return store.without_folder(c, "Docs\\BUILDING")


@query("""WITH f AS (SELECT user_id AS folder, count(*) AS files, count(*) FILTER (event_type <> 'error') AS linked FROM events GROUP BY 1)
    SELECT c_custkey AS folder, coalesce(files, 0) AS files, coalesce(linked, 0) AS linked, coalesce(files - linked, 0) AS failed, round(linked * 100.0 / files, 6) AS success_rate FROM customer LEFT JOIN f ON folder = c_custkey""")
def l3_link_rates(spark, sf_dir):
    """L3: a folder's files, what could not be read, and the rate; none without files."""
    files = read(spark, sf_dir, "events").select(F.col("user_id").alias("folder"), (F.col("event_type") != "error").alias("ok"))
    return store.link_rates(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder")), files).withColumn("success_rate", F.round("success_rate", 6))


@query("SELECT doc_id AS id, lang AS space_id, n_chars FROM documents")
def s12_compact(spark, sf_dir):
    """A table of many small files, written again in few; the rows stay."""
    kept = store.VersionedStore(spark, shared_folder(spark, "compact"))
    kept.write(chunks(spark, sf_dir).select("id", "space_id", "n_chars").repartition(16))
    kept.compact()
    return kept.read()


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents WHERE lang <> 'fr') GROUP BY term")
def s13_kept_index(spark, sf_dir):
    """Chunks added in two batches (one twice) and a language deleted; the term statistics that are left."""
    c = chunks(spark, sf_dir).select("id", "text", "space_id")
    index = segments.SegmentIndex(spark, shared_folder(spark, "index"))
    index.add(c.where("id % 3 = 0"))
    index.add(c)
    index.delete(c.where("space_id = 'fr'"))
    return index.terms()


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK.format(chr(39) + 'title of ' + chr(39) + ' || source || chr(10) || lang || chr(10) || text')}) AS term FROM documents) GROUP BY term")
def s14_rebuilt_index(spark, sf_dir):
    """The index rebuilt from the store over the contextual text, as ingest has it."""
    c = chunks(spark, sf_dir).select("id", fts.contextual(F.col("title"), F.col("space_id"), F.col("text")).alias("text"))
    index = segments.SegmentIndex(spark, shared_folder(spark, "index"))
    index.rebuild(c)
    return index.terms()


@query()
def c7_ingest(spark, sf_dir):
    """Documents chunked, embedded by the default hook and kept with their contextual text; (doc_id, chunk_index, length, norm)."""
    d = read(spark, sf_dir, "documents")
    parts = chunking.chunks(d, title=F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), source=F.col("source"))
    kept = store.VersionedStore(spark, shared_folder(spark, "ingest"))
    kept.write(hooks.embed(parts, "text"))
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), 4)
    return kept.read().select("doc_id", "chunk_index", F.length("text").alias("length"), norm.alias("norm"))


@query("SELECT doc_id AS id, source FROM documents WHERE source IN (SELECT source FROM documents JOIN benchmark ON doc_id = item_id * 3)")
def y7_document_chunks(spark, sf_dir):
    """The chunks of the documents that tool calls name, each once, by a filter on the document; a call names the source of a chunk."""
    c = chunks(spark, sf_dir)
    ask = c.join(read(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("id")), "id", "left_semi").select("doc_id")
    return store.documents_of(c, ask).select("id", "source")


@query(with_views("SELECT doc_id, space_id, count(*) AS chunks, sum(n_chars) AS chars FROM chunks GROUP BY ALL", "chunks"))
def y7_sources(spark, sf_dir):
    """The sources of each space."""
    return chunks(spark, sf_dir).groupBy("doc_id", "space_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"))


@query("SELECT conv_id AS note_id, max_by(text, turn) AS body, max(turn) AS version FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role <> 'system' GROUP BY ALL) GROUP BY conv_id HAVING max(turn) >= 2")
def l19_notes(spark, sf_dir):
    """Notes saved again and again, the last version of each; notes with fewer than three versions are deleted."""
    c = read(spark, sf_dir, "conversations").where("role <> 'system'").groupBy(F.col("conv_id").alias("note_id"), F.col("turn").alias("version")).agg(F.min("text").alias("body"))
    notes = store.latest_wins(c, ["note_id"], "version")
    return notes.where("version >= 2").select("note_id", "body", "version")


# ------------------------------------------------------------------ exports

@query("SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id")
def s31_chat_text(spark, sf_dir):
    """A chat as plain text."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), t["text"])), "\n\n").alias("body"))


@query("SELECT conv_id, string_agg('{\"turn\":' || turn || ',\"role\":\"' || role || '\"}', ',' ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id")
def s31_chat_json(spark, sf_dir):
    """A chat as JSON objects in order (turn and role)."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return c.select("conv_id", F.array_join(F.transform("x", lambda t: F.to_json(F.struct(t["turn"].alias("turn"), t["role"].alias("role")))), ",").alias("body"))


_REP = "r AS (SELECT c_mktsegment AS title, c_nationkey AS item, count(*) AS n, round(avg(c_acctbal), 2) AS score FROM customer GROUP BY ALL)"


def _report(spark, sf_dir):
    """Sections with one row per item, small by their number of nations."""
    r = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("title"), F.col("c_nationkey").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 2).alias("score"))
    return r.groupBy("title").agg(F.sort_array(F.collect_list(F.struct("item", "n", "score"))).alias("rows"))


@query(f"WITH {_REP} SELECT title, '# ' || title || chr(10) || chr(10) || '| item | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || item || ' | ' || n || ' |', chr(10) ORDER BY item) AS md, '<h1>' || title || '</h1><table>' || string_agg('<tr><td>' || item || '</td><td>' || n || '</td></tr>', '' ORDER BY item) || '</table>' AS html, 'item,n' || chr(10) || string_agg(item || ',' || n, chr(10) ORDER BY item) AS csv, upper(title) || chr(10) || string_agg(item || ': ' || n, chr(10) ORDER BY item) AS txt FROM r GROUP BY title")
def s30_reports(spark, sf_dir):
    """One report as Markdown, HTML, CSV and text."""
    join = lambda sep, make: F.array_join(F.transform("rows", make), sep)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    t = F.col("title")
    return _report(spark, sf_dir).select(
        "title",
        text("# ", t, "\n\n| item | n |\n| --- | --- |\n", join("\n", lambda r: text("| ", r["item"], " | ", r["n"], " |"))).alias("md"),
        text("<h1>", t, "</h1><table>", join("", lambda r: text("<tr><td>", r["item"], "</td><td>", r["n"], "</td></tr>")), "</table>").alias("html"),
        text("item,n\n", join("\n", lambda r: text(r["item"], ",", r["n"]))).alias("csv"),
        text(F.upper(t), "\n", join("\n", lambda r: text(r["item"], ": ", r["n"]))).alias("txt"),
    )
