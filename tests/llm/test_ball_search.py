import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import ball_search as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        found = []
        for i, b in bags:
            if b:
                m = 100 - 50 + (50 * sum(b.values()) * n_docs) // length
                s = sum(w[t] * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in own if t in b)
                if s > 0:
                    found.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=50, parts=3, **more):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n int").repartition(parts)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, item int")
    got = S.ranked(d, q, k, **more).collect()
    assert all(r.leaves <= r.all_leaves for r in got)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str), got


def table(seed, n_docs, n_items):
    rng = random.Random(seed)
    tongues = [[f"{a}{k}" for k in range(300)] for a in "xyzw"]
    def text(size):
        words = rng.choice(tongues)
        return " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(size))
    docs = [(i, text(rng.randint(0, 80))) for i in range(n_docs)]
    return docs + [(n_docs + i, docs[i][1]) for i in range(n_docs // 5)], [(i, text(12)) for i in range(n_items)]


@pytest.mark.parametrize("more", [{}, {"tree_docs": 60, "leaf_docs": 4}, {"block_chars": 200, "tree_docs": 64, "leaf_docs": 1}])
def test_same_as_scoring_all(spark, more):
    docs, items = table(1, 300, 12)
    assert run(spark, docs, items, k=7, **more)[0] == brute(docs, items, 7)


def test_subtrees_are_left_out(spark):
    docs, items = table(2, 1500, 10)
    same, rows = run(spark, docs, items, k=5, parts=1, leaf_docs=8)
    assert same == brute(docs, items, 5)
    work = {r.item_id: (r.leaves, r.all_leaves) for r in rows}
    assert sum(a for a, _ in work.values()) < 0.8 * sum(b for _, b in work.values())


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "--- !!"), (4, "Été été ETE"), (5, "a" * 50_000), (6, "tie tie"), (7, "tie tie"), (6, "tie tie"), (None, "tie tie"), (8, "naïve café 中文"), (9, "snake_case 42-43"), (10, "w " * 30_000)]
    items = [(1, "tie"), (2, None), (3, "?"), (4, "été ete 中文 café"), (5, "unknown"), (None, "snake case 43"), (1, "42 w"), (6, "a" * 50_000)]
    for k in (2, 50):
        assert run(spark, docs, items, k)[0] == brute(docs, items, k)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert S.ranked(d.limit(0), q).count() == 0 == S.ranked(d, q.limit(0)).count()
    assert [tuple(r)[:3] for r in S.ranked(d, q).collect()] == [("1", 1, 1)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(200, rng.integers(1, 40), replace=False)) for _ in range(500)]
    value = rng.integers(1, 10**10, sum(map(len, rows))).astype(float)
    at = np.append(0, np.cumsum([len(r) for r in rows]))
    tree = S.BallTree(at, np.concatenate(rows), value, np.arange(200) // 25, 16)
    dense = np.zeros((500, 200))
    for i, r in enumerate(rows):
        dense[i, r] = value[at[i] : at[i + 1]]
    for _ in range(20):
        item = rng.choice(200, 15, replace=False)
        bound = tree.bounds(item)
        for node, docs in enumerate(tree.docs):
            assert dense[docs][:, item].sum(1).max() <= bound[node]
