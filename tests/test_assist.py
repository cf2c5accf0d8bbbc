"""Follow-ups, folders, citations, the kept index and rendering against plain Python."""

import re

from pyspark.sql import functions as F

from quern.functions import answers as A, nlq
from quern.operators import evaluate, fts, memory, rank, store


def rewritten(q, entity, file, topic, concepts, last):
    """The rules in order, in plain Python."""
    out, changed, resolved = q, False, False
    low = q.strip().lower()

    def once(text, word, new):
        at = text.lower().find(word)
        return None if at < 0 else text[:at] + new + text[at + len(word) :]

    if last is not None and any(low == b or low.startswith(b + " ") for b in A.BARE_COMMANDS):
        out, changed = f"{q.strip()} {last.strip()}", True
    for words, name in ((A.PRONOUNS, entity), (A.DEMONSTRATIVES, file or entity)):
        for w in words if name else ():
            new = once(out, w, w.replace(w.strip(" ?"), name))
            if new is not None:
                out, changed, resolved = new, True, True
                break
    about = entity or topic or ""
    n = len(q.split())
    if n <= 5 and not resolved and about:
        for begin, long in A.ELLIPSES:
            if low.startswith(begin):
                out = long.replace("{topic}", about) + q[len(begin) :] if long else f"{about} {q[len(begin):].strip()}"
                changed = True
                break
    if n <= 2 and not changed and low:
        if entity:
            out = f"{entity} {q.strip()}"
        elif concepts:
            out = f"{q.strip()} {' '.join(concepts[:3])}"
    return out


def test_follow_ups(spark, sf_dir):
    from quern.queries import QUERIES

    rows = QUERIES["f12_rewrite"](spark, sf_dir).collect()
    assert len(rows) > 50 and len({r.rewritten for r in rows}) > 10
    for r in rows:
        assert r.rewritten == rewritten(r.q, r.entity, r.file, r.topic, r.concepts, r["last"]), r
        assert r.with_hook == ("\n".join(x for x in (r["last"], r.q) if x is not None).strip().upper() if r.role == "system" else r.rewritten)


def test_folders(spark):
    df = spark.createDataFrame([("/docs/a",), ("/docs2/b",), ("C:\\Data",), ("C:/Data/x",), (None,)], "source string")
    left = lambda folder, ignore=True: {r.source for r in store.without_folder(df, folder, ignore).collect()}
    assert left("C:\\Data", False) == {"/docs/a", "/docs2/b", "C:\\Data", None}  # the prefix with forward slashes fits
    assert left("/docs") == {"C:\\Data", "C:/Data/x", None}
    assert left("C:\\Data") == {"/docs/a", "/docs2/b", "C:/Data/x", None}
    assert left("C:\\Data\\x") == {"/docs/a", "/docs2/b", "C:\\Data", None}
    assert left("/none") == {"/docs/a", "/docs2/b", "C:\\Data", "C:/Data/x", None}
    rates = {r.folder: r.success_rate for r in store.link_rates(spark.createDataFrame([("a",), ("b",)], "folder string"), spark.createDataFrame([("a", True), ("a", False)], "folder string, ok boolean")).collect()}
    assert rates == {"a": 50.0, "b": None}


def test_citations(spark):
    cited = spark.createDataFrame([(1, "rag/x.rs", 324), (1, "rag\\x.rs", 999), (1, "y.rs", None), (2, "z.rs", 1)], "query_id int, path string, line int")
    sources = spark.createDataFrame([(1, "src\\rag\\x.rs", [(300, 400)])], "query_id int, path string, ranges array<struct<first:int,last:int>>")
    got = {(r.query_id, r.path, r.line): r.reason for r in evaluate.citation_validity(cited, sources).collect()}
    assert got == {(1, "rag/x.rs", 324): None, (1, "rag\\x.rs", 999): "line", (1, "y.rs", None): "file", (2, "z.rs", 1): "file"}


def test_compaction(spark, tmp_path):
    kept = store.VersionedStore(spark, f"file://{tmp_path}/t")
    kept.write(spark.range(1000).repartition(20))
    assert kept.compact() == 1 and kept.read().count() == 1000 and len(kept.read().inputFiles()) == 1


def test_phrases_and_parsing(spark):
    q = spark.createDataFrame([(1, '"b c'), (2, "b c"), (3, "(x"), (4, "")], "query_id int, query string")
    assert {r.query_id: r.bad for r in q.select("query_id", fts.unparsable(F.col("query")).alias("bad")).collect()} == {1: True, 2: False, 3: True, 4: False}
    docs = spark.createDataFrame([(1, "a b c", "t"), (2, "c b", "t"), (3, "B, C b c", "b"), (4, None, None)], "doc_id int, text string, title string")
    hits = {(r.query_id, r.id) for r in fts.search(docs, q, 10, title_col="title").collect()}
    assert hits == {(1, 1), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_small_functions(spark):
    df = spark.createDataFrame([("List all emails",), ("emails from the invoices",), ("emails",), ("who is it",)], "q string")
    assert [r.b for r in df.select(nlq.is_broad(F.col("q")).alias("b")).collect()] == [True, True, False, False]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "query_id int, seq int, v string")
    assert [r.v for r in rank.dedup_adjacent(rows, "v", "seq", 5).orderBy("place").collect()] == ["a", "b", "a"]
    line = spark.range(1).select(memory.line(F.lit("Task"), F.lit("x" * 200), F.lit(0.456)).alias("l")).head().l
    assert re.fullmatch(r"\[Task\] x{100} \(importance: 0\.46\)", line)
