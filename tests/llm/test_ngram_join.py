import random

import pytest
from pyspark.sql import functions as F

from quern.llm import ngram_join as J
from quern.llm.components import connected_components


def brute(docs):
    import re

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(v, k=14))
    bases = [rng.choices(v, k=rng.randint(1, 160)) for _ in range(25)]
    docs = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one TWO"), (1005, "one"), (1006, "É é a b c"), (1007, "é é a b c")]
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else rng.choices(v, k=rng.randint(1, 120))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(["new", *v])
        if rng.random() < 0.3:
            w.insert(rng.randint(0, len(w)), line)
        if rng.random() < 0.2:
            w = w[: rng.randint(1, len(w))]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs + docs[:20], "doc_id long, text string").withColumns({"n": F.lit(1), "d": F.lit("x"), "id": F.lit(2)})
    for rows in (500_000, 0)[: 3 - seed]:
        got = J.jaccard_components(df.repartition(3), broadcast_rows=rows).collect()
        assert len(got) == len(docs) + 20
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs)


@pytest.mark.parametrize("block", [256, 3])
def test_links_of_large_groups(spark, monkeypatch, block):
    """Groups of near copies with edits of their own and edits in common; every link is counted."""
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(11)
    docs = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        family = list(base)
        family[30:33] = ["x", "y", "z"]
        for i in range(45):
            w = list(family if i % 3 == 0 else base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(["p", "q", "r"])
            docs.append((1000 * g + i, " ".join(w)))
    docs += [(9000 + i, docs[i][1]) for i in range(6)]
    got = {r.doc_id: r for r in J.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    sets = {i: set(J.shingle_set(t).tolist()) for i, t in docs}
    want = {a: sum(a != b and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()) for a, x in sets.items()}
    assert {i: r.n_links for i, r in got.items()} == want and len(set(want.values())) > 10
    assert {i: r.component_id for i, r in got.items()} == {i: c for i, (_, c) in brute(docs).items()}


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(5)
    name = list(range(300))
    rng.shuffle(name)
    edges = [(name[i], name[i + 1]) for i in range(299) if i != 150] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    left, right = name[:151], name[151:]
    assert got == {**dict.fromkeys(left, min(left)), **dict.fromkeys(right, min(right))}


def test_link_counts(spark):
    """n_links is the number of other rows with a linked text, in groups of near copies too."""
    docs = corpus(3)
    rows = docs + docs[:30]
    sets = [frozenset(J.shingle_set(t).tolist()) for _, t in rows]
    want = sorted((i, sum(bool(x) and 5 * len(x & y) >= 4 * len(x | y) for m, y in enumerate(sets) if m != n)) for n, ((i, _), x) in enumerate(zip(rows, sets)))
    got = sorted((r.doc_id, r.n_links) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == want and max(n for _, n in want) > 5


def test_texts_of_one_id_are_one_node(spark):
    a, b = ("one two three four five six", "seven eight nine ten eleven twelve")
    rows = [(1, a), (5, b), (3, a), (3, b), (4, "alone")]
    rest = [(100 + i, t) for i, t in corpus(2)]
    got = {(r.doc_id, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows + rest, "doc_id long, text string")).where("doc_id < 100").collect()}
    assert got == {(1, 1), (3, 1), (5, 1), (4, 4)}


def test_one_row_of_each_stays_and_no_text_is_lost(spark):
    a, b = "one two three four five six seven eight nine ten eleven twelve", "a quite different text of more than five words"
    rows = [(3, a, 1), (5, a + " ", 2), (5, b, 3), (7, "alone here", 4), (7, "alone here", 5), (None, a, 6), (None, "nothing like it at all here", 7), (8, "", 8), (8, "", 9), (9, None, 10), (10, "long words " * 60_000, 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_id long").repartition(3)
    kept = J.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r.k_id for r in kept.collect())
    assert got in ([1, 3, 4, 7, 8, 9, 10, 11], [1, 3, 5, 7, 8, 9, 10, 11])
    assert J.one_of_each(df.limit(0)).count() == 0
