import random
from decimal import Decimal

import numpy as np

from quern.operators import graph, neighbours


def test_next_rows_across_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(40), k) for k in range(300)] + [(None, 1, 999), ("c", 5, 1000)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(7)
    for ahead in (1, 4):
        want = []
        for g in "abc":
            own = sorted((o, k) for x, o, k in rows if x == g)
            want += [(k, own[j][1]) for i, (_, k) in enumerate(own) for j in range(i + 1, min(i + 1 + ahead, len(own)))]
        assert sorted((r.src, r.dst) for r in graph.ordered_neighbours(df, "g", "o", "k", ahead).collect()) == sorted(want)
    assert graph.ordered_neighbours(df.limit(0), "g", "o", "k", 2).count() == 0


def test_graph_recall_on_clusters_and_a_hub(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (50, 8)) for c in rng.normal(0, 1, (8, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8)]
    got = neighbours.knn_graph(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    exact = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(exact & {(r.src, r.dst) for r in got}) >= 0.9 * len(exact)
    assert all(abs(r.sim - s[r.src, r.dst]) < 1e-9 for r in got) and {r.src for r in got} == set(range(len(x)))


def test_lists_widen_until_the_recall_is_reached(spark):
    """Vectors without clusters, for which the first width is far too small."""
    x = np.random.default_rng(4).normal(size=(400, 24))
    s = (unit := x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T
    np.fill_diagonal(s, -2)
    exact = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r.src, r.dst) for r in neighbours.knn_graph(vectors, 5, width=5, reverse=3, rounds=2).collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(got) == 5 * len(x)


def test_every_link_follows_from_one_row_a_document(spark):
    """Ties, no directory, no kind, no score; far more documents of a directory or kind than once were linked."""
    rng = random.Random(6)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice(["a", "a", "b", None]), rng.choice([None, "Go", "C C"]), Decimal(rng.randrange(20)) / 10 if i % 40 else None) for i in range(240)]
    nodes = spark.createDataFrame(rows, "id long, directory int, kind string, language string, score decimal(18,6)").repartition(6)
    got = {r.id: r for r in graph.similarity_edges(nodes).collect()}
    assert len(got) == len(rows)
    at = {r.place: r.id for r in got.values() if r.place}
    for i, d, k, lang, s in rows:
        r = got[i]
        near = {j for j, e, l, _, t in rows if i != j and k is not None and k == l and (d is None or d != e) and None not in (s, t) and 1 - abs(s - t) > Decimal("0.5")}
        told = {at[p] for p in range(r.first, r.last + 1)} if r.place else set()
        assert {j for j in told if j != i and (d is None or got[j].directory != d)} == near and r.n_semantic == len(near)
        assert r.n_same_directory == sum(i != j and d is not None and d == e for j, e, *_ in rows)
        assert (r.category, r.language) == (k and f"topic-{k}", lang and f"entity-{lang.replace(' ', '_')}")
    assert graph.similarity_edges(nodes.limit(0)).count() == 0


def _exact(x, k):
    """The ``k`` nearest of each row by cosine at nine decimals, then place."""
    s = np.round((unit := x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T, 9)
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]}


def test_few_bytes_a_node_are_shuffled(spark):
    """A node's vector travels some times a cell; it once went to some fifty hubs a round, 55 kB a node on this table."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    before = written()
    assert neighbours.knn_graph(e, 10).groupBy("src").count().where("count = 10").count() == 2000
    assert written() - before < 2000 * 5000


def test_few_cells_are_followed_by_descent(spark, monkeypatch):
    """Where the cells that may be asked hold too little, rounds go on until the recall is reached."""
    x = np.random.default_rng(4).normal(size=(400, 24))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    turns, real = [], neighbours._compare
    monkeypatch.setattr(neighbours, "_compare", lambda *a: turns.append(1) or real(*a))
    got = {(r.src, r.dst) for r in neighbours.knn_graph(vectors, 5, width=5, reverse=3, rounds=2, cell=20, cells=2).collect()}
    assert len(_exact(x, 5) & got) >= 0.9 * len(x) * 5 == 0.9 * len(got) and turns


def test_large_cells_are_cut_into_blocks(spark):
    """Many copies in one cell, asked by all, with names as ids; all cells asked, so the lists are exact, ties by id."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile(rng.normal(size=6), (150, 1)), rng.normal(size=(90, 6))])[rng.permutation(240)].astype(np.float32)
    vectors = spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<float>").repartition(3)
    got = {(int(r.src[1:]), int(r.dst[1:])) for r in neighbours.knn_graph(vectors, 4, cell=40, recall=1.0).collect()}
    assert got == _exact(x.astype(np.float64), 4)
    assert neighbours.knn_graph(vectors.limit(0), 4).count() == 0
    assert sorted((r.src, r.dst) for r in neighbours.knn_graph(vectors.limit(2), 4).collect()) == sorted((a.vec_id, b.vec_id) for a in vectors.limit(2).collect() for b in vectors.limit(2).collect() if a != b)
