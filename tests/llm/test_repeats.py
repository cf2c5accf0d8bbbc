import hashlib
import random

from quern.llm import repeats as R


def brute(rows, window):
    """(id, n_words, n_removed, kept) per row, from all windows of all documents."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    rank = lambda i: float("inf") if i is None else i
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, float("inf")), rank(i))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < rank(i):
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def run(spark, rows, window=50, first=20, parts=5):
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, row string, nid int").repartition(parts)
    return sorted((tuple(r) for r in R.strip_repeats(df, window=window, first=first).collect()), key=str)


def test_levels():
    assert R.levels(50, 20) == [25, 50]
    assert R.levels(100, 10) == [13, 25, 50, 100]
    assert R.levels(6, 20) == [3, 6]


def test_random_texts_at_several_depths(spark):
    rng = random.Random(7)
    shared = [[rng.choice("abcdefg") for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice("abcdefghij") for _ in range(rng.randint(0, 30))] + rng.choice(shared)
        rows.append((rng.randint(0, 50), " ".join(w)))
    for window, first in ((12, 2), (7, 20), (24, 3), (1, 1)):
        assert run(spark, rows, window, first) == brute(rows, window)


def test_edges(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"q{i % 7001}" for i in range(40_000))
    rows = [(1, passage), (2, "x " + passage + " y"), (3, None), (4, ""), (5, " \t\n"), (6, "short text"), (7, passage.upper()), (None, "k " + passage), (None, "m " + passage)]
    rows += [(8, long), (9, long + " end"), (10, "same " * 200), (11, "same " * 120 + "other"), (12, passage), (12, "Z " + passage), (12, passage), (13, passage.replace(" ", " ")), (14, passage.replace(" ", "\x0b \r\n"))]
    got = run(spark, rows)
    assert got == brute(rows, 50)
    assert (10, 200, 0, ("same " * 200).strip()) in got and (2, 62, 60, "x y") in got


def test_repeated_rows_of_the_smallest_document_stay(spark):
    passage = " ".join(f"w{i}" for i in range(50))
    assert run(spark, [(1, passage), (1, passage), (1, passage + " t")]) == brute([(1, passage), (1, passage), (1, passage + " t")], 50)


def test_empty_table(spark):
    assert run(spark, [(1, "a")])[0][1:] == (1, 0, "a")
    df = spark.createDataFrame([], "doc_id int, text string")
    assert R.strip_repeats(df).count() == 0


def test_entries_settle_the_same_however_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD", 50)
    monkeypatch.setattr(R, "CHUNK_WORDS", 30)
    rng = random.Random(1)
    shared = " ".join(rng.choice("abcd") for _ in range(40))
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(9)) + " " + shared[: 2 * rng.randint(8, 40)]) for i in range(30)]
    assert run(spark, rows, 10, 2, 1) == brute(rows, 10) == run(spark, rows, 10, 2, 9)


def test_digest_of_what_is_kept(spark):
    import sys

    sys.path.insert(0, "tests")
    from quern.llm.queries import op11_repeats

    rows = op11_repeats(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(docs, 50)]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted(want, key=str)
