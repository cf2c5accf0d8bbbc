import numpy as np

from quern.operators import ivfpq, vector
from quern.queries import QUERIES


def test_same_as_exact_search(spark):
    for sf in ("0.01", "0.1"):
        exact, near = ({(r.query_id, r.id, r.rank) for r in QUERIES[n](spark, f"/root/testdata/sf{sf}").select("query_id", "id", "rank").collect()} for n in ("v2_knn_batch", "v3_ivf"))
        assert exact == near


def test_short_list_reads_few_vectors_and_a_cut_one_keeps_recall(spark):
    row = QUERIES["v3_work"](spark, "/root/testdata/sf0.1").first()
    assert row.recall_reached and row.few_vectors_read


def test_bounds_hold_and_edges(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 6)) for c in rng.normal(0, 1, (5, 6))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, x[0].tolist()), (902, x[0].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 40)] + [(-1, [0.0] * 6), (-2, None)], "query_id long, vector array<double>")
    index = ivfpq.IvfPq(spark, f"file://{tmp_path}/i").build(vectors, lists=7, sample=100)
    got = sorted((r.query_id, r["rank"], r.id) for r in index.search(queries, 5).collect() if r.query_id >= 0)
    want = sorted((r.query_id, r["rank"], r.id) for r in vector.knn_batch(vectors, queries, 5).collect() if r.query_id >= 0)
    assert got == want and index.short_list(queries.where("query_id >= 0"), 5).count() < 0.5 * 8 * len(rows)
    book = ivfpq.Codebook.fit(x / np.linalg.norm(x, axis=1, keepdims=True), 7, 2)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    own, code, off = book.code(unit.copy())
    about = (unit @ book.centroids.T)[:, own] + np.stack([book.tables(unit)[:, np.arange(3), c].sum(1) for c in code], 1)
    assert (np.abs(about - unit @ unit.T) <= off + 1e-9).all()
    assert ivfpq.Codebook.load(book.dump()).dump() == book.dump()


def test_several_blocks_of_queries(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.withColumnsRenamed({"vec_id": "query_id", "embedding": "vector"})
    one = sorted(map(tuple, vector.knn_batch(vectors, queries, 3).collect()))
    assert sorted(map(tuple, vector.knn_batch(vectors, queries, 3, block_bytes=500).collect())) == one


def test_tables_of_few_queries_are_held(spark, tmp_path, monkeypatch):
    """Look-up tables are made for some queries at a time, in the task; what is broadcast grows with the queries' vectors only."""
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))], "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    index = ivfpq.IvfPq(spark, f"file://{tmp_path}/i").build(vectors, lists=5, sample=100)
    want = sorted((r.query_id, r["rank"], r.id) for r in vector.knn_batch(vectors, queries, 4).collect())
    monkeypatch.setattr(ivfpq, "TABLES", 7)
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or real(self, x))
    assert sorted((r.query_id, r["rank"], r.id) for r in index.search(queries, 4).collect()) == want
    assert max(x.nbytes for row in sent for x in row if isinstance(x, np.ndarray)) == 100 * 6 * 8


def test_short_list_is_made_once_from_decoded_vectors(spark, monkeypatch):
    made, real = [], ivfpq.IvfPq.short_list
    monkeypatch.setattr(ivfpq.IvfPq, "short_list", lambda self, *a, **b: made.append(1) or real(self, *a, **b))
    row = QUERIES["v3_work"](spark, "/root/testdata/sf0.01").first()
    assert row.n_queries == 10 and row.recall_reached and len(made) == 1
    x = np.random.default_rng(5).normal(size=(50, 5))
    book = ivfpq.Codebook.fit(x, 4, 2)
    own, code, _ = book.code(x.copy())
    tables = book.tables(x)
    told = (x @ book.centroids.T)[:, own] + sum(tables[:, j, code[:, j]] for j in range(3))
    assert np.allclose(x @ book.decode(own, code).T, told)


def test_scores_equal_at_six_decimals_tie_by_id(spark, tmp_path):
    """The SQL ranks by the score at six decimals: of vectors that differ beyond them the smallest ids are found."""
    rows = [(i, [1.0, 1e-3 + 1e-6 * ((i * 7) % 40), 0.0, 0.0]) for i in range(40)] + [(i, [1.0, float(i), 1.0, 2.0]) for i in range(100, 160)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    index = ivfpq.IvfPq(spark, f"file://{tmp_path}/i").build(vectors, lists=5)
    assert sorted((r["rank"], r.id) for r in index.search(queries, 5).collect()) == [(i + 1, i) for i in range(5)]
