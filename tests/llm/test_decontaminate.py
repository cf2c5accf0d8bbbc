import random
import re

from quern.llm import decontaminate as D


def brute(docs, items, k=5, t=0.8):
    w = lambda s: [x for x in re.split(r"[^\w]+|_", (s or "").lower()) if x]
    out = {}
    for i, it in items:
        ws = w(it)
        kk, tt = (k, t) if len(ws) >= k else (len(ws), 1.0)
        if not ws:
            continue
        sh = {tuple(ws[j : j + kk]) for j in range(len(ws) - kk + 1)}
        for d, text in docs:
            dw = w(text)
            n = len(sh & {tuple(dw[j : j + kk]) for j in range(len(dw) - kk + 1)})
            if n >= tt * len(sh) - 1e-9:
                out[(d, i)] = n
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    v = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([2, 4, 5, 8, 20, 40])))) for i in range(30)] + [(90, None), (91, ""), (92, "Solo"), (93, items_dup := "a b c d e f g")]
    items.append((94, items_dup))
    docs = [(0, None), (1, ""), (2, "solo"), (3, "A, b; c! d e f g h")]
    for d in range(4, 120):
        ws = rng.choices(v, k=rng.randint(1, 150))
        for _ in range(rng.randint(0, 3)):
            it = rng.choice(items)[1] or ""
            leak = it.split()
            if leak and rng.random() < 0.4:
                leak[rng.randrange(len(leak))] = "edited"
            at = rng.randint(0, len(ws))
            ws[at:at] = leak
        docs.append((d, ", ".join(ws)))
    docs.append((5, docs[5][1]))  # a repeated row
    want = brute(docs, items)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, n_shared int")
    it = spark.createDataFrame(items, "item_id long, text string")
    for rows in (500_000, 0):
        got = {(r.doc_id, r.item_id): r.n_shared for r in D.contaminated(df, it, broadcast_rows=rows).collect()}
        assert got == want
    kept = {r.doc_id for r in D.drop_contaminated(df, it).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_rows_that_share_an_id_go_for_their_own_text(spark):
    leak = "one two three four five six"
    df = spark.createDataFrame([(1, leak, 5), (1, "clean text", 6), (None, leak, 7), (None, "fine", 8), (2, leak * 20_000, 9)], "doc_id long, text string, k_id long")
    it = spark.createDataFrame([(1, leak), (None, "nine ten"), (1, "another item of seven words stands here")], "item_id long, text string")
    for rows in (500_000, 0):
        assert sorted(r.k_id for r in D.drop_contaminated(df, it, broadcast_rows=rows).collect()) == [6, 8]


def test_short_documents_skip_the_partitions_of_large_items(spark):
    it = spark.createDataFrame([(1, "a b c d e f g"), (2, " ".join(f"x{i}" for i in range(300)))], "item_id long, text string")
    got = {(r.k, r.size_class): r.n_shingles for r in D.sketches(it, 5, 0.8).collect()}
    assert got == {(5, 1): 3, (5, 8): 296}


def test_empty_tables(spark):
    df, none = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(df, none).count() == 0
    assert D.contaminated(df.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
