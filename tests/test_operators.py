import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.config import EngineConfig
from quern.functions import nlq, text as T
from quern.operators import chunking, evaluate, fusion, graph, rank, store
from quern.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_chunk_tail():
    assert chunking.spans(b"a" * 4000, 1750, 200, 100) == [(0, 1750), (1550, 3300), (3100, 4000), (3800, 4000)]
    assert chunking.spans(b"a" * 99, 1750, 200, 100) == []
    assert chunking.spans(b"a" * 100, 1750, 200, 100) == [(0, 100)]


def test_chunks_cover_the_text_at_character_bounds():
    data = ("Sätze über Ähnliches. " * 400).encode()
    spans = chunking.spans(data, 300, 50, 10)
    assert spans[0][0] == 0 and max(b for _, b in spans) == len(data)
    assert all(a[1] > b[0] for a, b in zip(spans, spans[1:]))
    for a, b in spans:
        data[a:b].decode()


def test_score_aware_rrf(spark):
    vec = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5)], "query_id int, id string, score double")
    fts = spark.createDataFrame([(1, "b", 10.0), (1, "c", 2.0)], "query_id int, id string, score double")
    rows = fusion.score_aware_rrf(vec, fts).orderBy("rank").collect()
    b = 1 / 62 + 1 / 61 * 1.3
    assert [r.id for r in rows] == ["b", "a", "c"] and rows[0].found_by == "hybrid"
    assert [round(r.score, 9) for r in rows] == [1.0, round(1 / 61 * 1.3 / b, 9), round(1 / 62 / b, 9)]


def test_diversity(spark):
    h = spark.createDataFrame([(1, 1, 1.0, "s"), (1, 2, 0.9, "s"), (1, 3, 0.8, "t")], "query_id int, id int, score double, source string")
    assert {r.id: round(r.score, 6) for r in rank.diversify(h).collect()} == {1: 1.0, 2: 0.45, 3: 0.8}


def test_metrics(spark):
    res = spark.createDataFrame([(1, x, i + 1) for i, x in enumerate("abcde")] + [(2, "z", 1)], "query_id int, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "y", 1.0)], "query_id int, id string, grade double")
    m = {r.query_id: r for r in evaluate.per_query(res, qrels, [1, 3]).collect()}
    assert (m[1].recall_1, m[1].recall_3, m[1].precision_1, m[1].rr, m[1].ndcg_3) == (0.5, 1.0, 1.0, 1.0, 1.0)
    assert m[2].rr == 0
    mean = evaluate.mean(evaluate.per_query(res, qrels, [1, 3]), [1, 3]).head()
    assert mean.mrr == 0.5 and mean.hit_rate_1 == 0.5


def test_ranking_parse_and_apply(spark):
    assert rank.parse_ranking("[3, 1, 2]", 3) == [2, 0, 1]
    assert rank.parse_ranking("```json\n[2, 1]\n```", 2) == [1, 0]
    assert rank.parse_ranking("The order is 2, then 4, then 1.", 5) == [1, 3, 0]
    assert rank.parse_ranking("no idea", 3) is None and rank.parse_ranking(None, 3) is None
    assert rank.parse_ranking("[2, 4, 1]", 5) == [1, 3, 0]
    h = spark.createDataFrame([(1, x, i) for i, x in enumerate("abcd")], "query_id int, id string, rank int")
    order = spark.createDataFrame([(1, 2, 0), (1, 0, 1)], "query_id int, rank int, new_rank int")
    assert [r.id for r in rank.apply_ranking(h, order).orderBy("rank").collect()] == ["c", "a", "b", "d"]


def test_greedy_dedup_keeps_chains(spark):
    rows = [(1, 1, 3.0, "s", "a b c d"), (1, 2, 2.0, "s", "a b c d e"), (1, 3, 1.0, "s", "a b c d e f g"), (1, 4, 1.0, "t", "a b c d")]
    h = spark.createDataFrame(rows, "query_id int, id int, score double, source string, text string")
    assert sorted(r.id for r in rank.dedup_greedy(h, 0.6).collect()) == [1, 3, 4]
    once = rank.dedup_greedy(h, 0.6)
    assert rank.dedup_greedy(once, 0.6).count() == once.count()


def test_cliff_keeps_five(spark):
    h = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.1, 0.09, 0.08, 0.07, 0.06, 0.01, 0.009])], "query_id int, id int, score double")
    assert rank.cut_at_cliff(h).count() == 6


@pytest.mark.parametrize(
    ("q", "strategy", "n"),
    [
        ("what is the PAN number and what is the monthly salary", "Conjunction", 2),
        ("what are the pros and cons of this approach", "Single", 1),
        ("hello there", "Single", 1),
        ("what is the difference between cats and dogs", "Comparative", 3),
        ("What is the name? What is the age?", "MultiQuestion", 2),
        ("1. find the first thing\n2. find the second thing", "Enumerated", 2),
    ],
)
def test_decompose(spark, q, strategy, n):
    d = one(spark, nlq.decompose(F.lit(q)))
    assert (d.strategy, len(d.parts)) == (strategy, n)


def test_intents(spark):
    want = {"hi there": "Greeting", "calculate 2 + 3 for me please now": "Calculation", "compare the two offers in detail today": "ComparativeAnalysis", "how many people are in the list": "AggregationQuery", "what is the clause on liability": "DefinitionQuery"}
    for q, name in want.items():
        assert one(spark, nlq.intent(F.lit(q))) == name, q


def test_text_functions(spark):
    t = one(spark, T.markdown_table(F.lit("| Name | Age | City |\n|---|---|---|\n| A | 1 | X |\n| B | 2 | Y |\n| odd |")))
    assert t.headers == ["Name", "Age", "City"] and len(t.rows) == 2
    assert one(spark, T.strip_bad_citations(F.lit("a [1] b [0] c [7]"), F.lit(3))) == "a [1] b  c "
    c = one(spark, T.citations(F.lit("see src/rag/x.rs:324 and docs/a.md or e.g. this")))
    assert [(x.path, x.line) for x in c] == [("src/rag/x.rs", 324), ("docs/a.md", None)]
    assert one(spark, rank.token_estimate(F.lit("123456789"))) == 3
    assert one(spark, T.sentences(F.lit("One here. Two there! 3 more? end"))) == ["One here.", "Two there!", "3 more? end"]
    assert one(spark, T.cell(F.lit(2.5))) == "2.5" and one(spark, T.cell(F.lit(7.0))) == "7"
    f = {k: one(spark, v) for k, v in T.extracted_fields(F.lit("a@b.org, ABCDE1234F, Rs. 1,200.50 on 01/02/2023, invoice no: INV-77, +91 98765 43210")).items()}
    assert f["emails"] == "a@b.org" and f["pan"] == "ABCDE1234F" and f["amounts"] == "Rs. 1,200.50" and f["dates"] == "01/02/2023" and f["phones"] == "+919876543210" and f["gstin"] is None
    assert one(spark, T.bullets(F.lit("One thing. Two things."))) == "- One thing\n- Two things"
    assert one(spark, T.garble_score(F.lit("a     b     c and more\n" * 4))) == 1.0
    assert one(spark, T.template_variables(F.lit("Dear {{name}}, [DATE]"))) == ["name", "DATE"]


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, "/docs/a"), (2, "/docs2/b"), (3, None)], "id int, source string")
    s.write(rows)
    assert s.append(rows.limit(0)) == 2
    assert s.delete(F.col("source").startswith("/docs")) == 2 and s.read().count() == 1
    assert s.delete(F.lit(False)) == 0 and s.read(1).count() == 3
    s.clear()
    assert s.read().count() == 0


def test_plan_with_a_cycle(spark):
    steps, needs = spark.createDataFrame([(1,), (2,)], "step int"), spark.createDataFrame([(1, 2), (2, 1)], "step int, need int")
    with pytest.raises(ValueError):
        graph.levels(steps, needs)


def test_config():
    EngineConfig().check()
    with pytest.raises(ValueError):
        EngineConfig(chunk_size=100, chunk_overlap=100).check()


def test_files(spark, tmp_path):
    def pack(name, parts):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for n, x in parts.items():
                z.writestr(n, x)
        (tmp_path / name).write_bytes(buf.getvalue())

    pack("a.docx", {"word/document.xml": "<w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'> you &amp; me</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p>"})
    pack("b.pptx", {"ppt/slides/slide2.xml": "<a:p><a:t>B</a:t></a:p>", "ppt/slides/slide1.xml": "<a:p><a:t>A</a:t></a:p>"})
    pack("c.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/sheet1.xml": '<row r="1"><c t="s"><v>0</v></c><c><v>5</v></c></row><row r="2"><c/></row>'})
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "bad.docx").write_text("no zip")
    (tmp_path / "e.bin").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.ingest(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"][0] == "Hello you & me\nTwo" and got["b.pptx"][0] == "--- Slide 1 ---\nA\n\n--- Slide 2 ---\nB" and got["c.xlsx"][0] == "Name | 5" and got["d.txt"][0] == "plain"
    assert got["bad.docx"][0] is None and "BadZipFile" in got["bad.docx"][1] and "e.bin" not in got
    p = {r.format: r.files for r in files.preview(files.list_files(spark, f"file://{tmp_path}")).collect()}
    assert p == {"Word": 2, "Presentation": 1, "Spreadsheet": 1, "Text": 1}
    n = {r.column: r.numeric for r in files.numeric_columns(spark.createDataFrame([("1", "x"), ("2", "3"), (None, None)], "a string, b string"), ["a", "b"]).collect()}
    assert n == {"a": True, "b": False}


def test_answers(spark):
    from quern.functions import answers as A

    text = "Here:\n```mermaid\ngraph TD\n```\n```python\n" + "x = 1\n" * 7 + "```\n| a | b |\n| 1 | 2 |"
    b = one(spark, A.blocks(F.lit(text)))
    assert [x.kind for x in b] == ["diagram", "code", "table"]
    assert len(one(spark, A.artifacts(F.lit(text)))) == 1
    r = one(spark, A.router(F.lit('Sure: {"intent": "search", "query": "tax", "confidence": 0.8} ok')))
    assert (r.intent, r.query, r.confidence) == ("search", "tax", 0.8)
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("ok"), F.lit("true"))
    assert one(spark, A.substitute(F.lit("x {{a}} {{b}}"), m)) == "x 1 {{b}}"
    assert one(spark, A.holds(F.lit("a == '1'"), m)) and one(spark, A.holds(F.lit("ok"), m)) and not one(spark, A.holds(F.lit("b"), m))
    assert one(spark, A.rewrite_follow_up(F.lit("what does it cost"), F.lit("Plan $9"))) == "what does Plan $9 cost"
    assert one(spark, A.rewrite_follow_up(F.lit("and price"), F.lit("Plan"))) == "Plan price"
    assert one(spark, A.entities(F.lit("The Acme Corp met John Smith there."))) == ["Acme Corp", "John Smith"]
    fields = F.array(F.struct(F.lit("age").alias("name"), F.lit("number").alias("type"), F.lit(True).alias("required")))
    assert one(spark, A.json_schema(F.lit("T"), fields)) == '{"type":"object","title":"T","properties":{"age":{"type":"number"}},"required":["age"]}'


def test_hooks(spark):
    from quern.operators import hooks, vector

    df = hooks.embed(spark.createDataFrame([("a b",), ("a b",), (None,)], "text string"), "text")
    rows = df.select("vector", vector.l2_norm(F.col("vector")).alias("n")).collect()
    assert rows[0].vector == rows[1].vector and all(abs(r.n - 1) < 1e-5 for r in rows)
    with pytest.raises(KeyError):
        hooks.get("scorer", "none")


def test_long_tables_take_linear_time(spark):
    import time

    from quern.config import EngineConfig
    from quern.operators import chunking

    kind = "doc_id int, kind string, page int, heading string, content string, fields array<struct<k:string,v:string>>, headers array<string>, rows array<array<string>>"
    rows = [[str(i), "x" * (i % 90), None] for i in range(100_000)]
    data = [(1, "table", None, None, None, None, ["a", "b", "c"], rows), (2, "form", 3, None, None, [("k", "v"), ("", "v"), ("q", None), ("z", "é" * 300)], None, None), (3, "table", None, None, None, None, ["h"], [])]
    start = time.time()
    got = chunking.section_chunks(spark.createDataFrame(data, kind), EngineConfig(chunk_size=250, chunk_overlap=0, min_chunk=1)).collect()
    assert time.time() - start < 20
    tables = sorted((r.chunk_index, r.text) for r in got if r.doc_id == 1)
    head = "| a | b | c |\n| --- | --- | --- |\n"
    lines = [x for _, t in tables for x in t.removeprefix(head).split("\n")]
    assert lines == [f"| {r[0]} | {r[1]} |" for r in rows] and all(len(t) <= 250 for _, t in tables)
    assert all(len(a[1]) + len(b[1].removeprefix(head).split("\n")[0]) + 1 > 249 for a, b in zip(tables, tables[1:]))
    assert [(r.page, r.text) for r in got if r.doc_id == 2] == [(3, "k: v"), (3, "z: " + "é" * 300)]
    assert not [r for r in got if r.doc_id == 3]


def test_loose_charts(spark):
    from quern.functions import answers

    good = '{"type": "Pie", "title": "a \\"}\\" {", "data": {"labels": [], "datasets": [{"label": "x", "data": [1, 2.5]}]}}'
    cases = {
        f"see chart {good} and chart{good}": ["text", "chart", "text", "chart"],
        f"chart {good}": ["chart"],
        "chart {": ["text"],
        'chart {"type": "pie"} chart {"a": "}': ["text"],
        f"chart {{ chart {good}": ["text", "chart"],
        good.replace("Pie", "cake"): ["text"],
        "": [],
        None: [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", answers.loose_charts(F.col("t")).alias("s")).collect():
        assert [x.kind for x in r.s] == cases[r.t], r.t
        assert [(x.start, x.stop) for x in r.s] == list(zip([0, *(x.stop for x in r.s)], [x.stop for x in r.s]))


def test_bm25_scores_where_documents_are_read(spark, monkeypatch):
    """Few queries: no posting and no (query, document) pair is shuffled, with the same hits as by joins of postings, ties and string ids too."""
    from quern.operators import fts

    rng = random.Random(4)
    docs = [(f"d{i:03}", " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 6))), rng.choice(["ab", "zz", None])) for i in range(300)] + [("e1", None, "cd"), ("e2", "é ab", "")]
    df = spark.createDataFrame(docs, "doc_id string, text string, title string").repartition(5)
    q = spark.createDataFrame([(1, "ab cd cd"), (2, "nothing"), (3, ""), (4, "kl zz")], "query_id int, query string")
    key = lambda r: (r.query_id, r["rank"], r.id, round(r.score, 6))
    monkeypatch.setattr(fts, "PRODUCTS", 40)
    for title in (None, "title"):
        few = fts.bm25(df, q, 7, title_col=title)
        assert sorted(map(key, few.collect())) == sorted(map(key, fts.bm25(df, q, 7, title_col=title, broadcast_terms=0).collect()))
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "MapInArrow" in plan


def test_bm25_reads_the_documents_twice(spark):
    """Once for the terms' frequencies and the lengths, once for the scores."""
    from quern.operators import fts

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 7}") for i in range(40)], "doc_id long, raw string").withColumn("text", told.asNondeterministic()("raw"))
    q = spark.createDataFrame([(1, "w1 w5"), (2, "w2")], "query_id int, query string")
    assert len(fts.bm25(docs, q, 3).collect()) == 6
    assert seen.value == 2 * 40


def test_texts_are_not_shuffled_to_meet_few_hits(spark, sf_dir):
    """Hits of a counted set of queries are broadcast, so no document leaves its scan but those hit; more hits are joined."""
    from quern.config import EngineConfig
    from quern.operators import lineage
    from quern.plans import search
    from quern.queries import QUERIES
    from quern.queries.curation import found_hits

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {f.__name__: f(spark, sf_dir)._jdf.queryExecution().executedPlan().toString() for f in (found_hits, QUERIES["v14_content_boost"], QUERIES["j5_neighbours"], search.hybrid)}
        counted = QUERIES["l9_search_history"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for name, plan in plans.items():
        assert "hashpartitioning(id#" not in plan and "hashpartitioning(doc_id#" not in plan, name
        assert "BroadcastHashJoin" in plan, name
    assert counted.count("Join") == 1  # hits are counted without their documents
    few = lineage.few(spark.range(3), 3, EngineConfig.broadcast_rows)._jdf.queryExecution().logical().toString()
    assert "broadcast" in few and "broadcast" not in lineage.few(spark.range(3), 3, 2)._jdf.queryExecution().logical().toString()


def test_section_chunks_take_few_rows_at_a_time(spark, monkeypatch):
    """Texts, tables and forms become Python objects some rows at a time, with the same chunks."""
    import pyarrow as pa

    kind = "doc_id string, kind string, page int, content string, fields array<struct<k:string,v:string>>, headers array<string>, rows array<array<string>>"
    rows = [(f"d{i}", "text", i % 3 or None, None if i == 4 else f"é{i} word. " * (20 * i), None, None, None) for i in range(40)]
    rows += [(f"t{i}", "table", None, None, None, ["a"], [[str(j)] for j in range(i)]) for i in range(9)]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = sorted((r.doc_id, r.chunk_index, r.text) for r in chunking.section_chunks(df).collect())
    want = [(d, i, (f"Page {p}: " if p else "") + t.encode()[a:b].decode()) for d, k, p, t, *_ in rows if k == "text" for i, (a, b) in enumerate(chunking.spans((t or "").encode(), 1750, 200, 100))]
    assert [x for x in got if x[0][0] == "d"] == sorted(want)
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    assert [b.num_rows for b in chunking.pieces([batch])] == [chunking.PIECE] * (1000 // chunking.PIECE)
