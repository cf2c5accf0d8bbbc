import random
import re
from collections import Counter
from zlib import crc32

import pytest

from quern.llm import variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_count=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}
    near, form = {}, {}
    for w in words:
        near[w] = [x for x in words if edit_one(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    return sorted(tuple(r) for r in V.variants(df, **more).select("word", "n", "n_near", "form", "form_n", "root").collect())


def texts(seed, size):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(4, 8))) for _ in range(size)]
    weights = [1 / (1 + k % 50) for k in range(size)]
    return [(i if i % 9 else None, " ".join(w.title() for w in rng.choices(words, weights, k=120))) for i in range(60)]


@pytest.mark.parametrize("more", [{}, {"node_words": 40}, {"node_words": 1, "most_nodes": 100_000}])
def test_random_words_whatever_the_nodes(spark, more):
    rows = texts(3, 400)
    got = run(spark, rows, **more)
    assert got == brute(rows)
    assert any(r[3] and r[5] != r[3] for r in got) or more


def test_chains_ties_and_long_runs(spark):
    long = "ab" * 400
    rows = [(1, "house " * 60 + "houze " * 30 + "houzes " * 14 + "houzess " * 7 + "houzesss " * 3), (2, "tiger " * 4 + "tigar " * 8 + "tigor " * 8)]
    rows += [(3, f"{long} " * 6 + f"{long}x " * 3 + f"{long[1:]} " * 3 + "q" * 48 + " " + ("q" * 48 + " ") * 2 + ("q" * 49 + " ") * 7), (4, None), (5, ""), (6, "÷×÷×÷ " * 3 + "naïve42naïve_naïvesĀnaïve"), (7, "MIXED mixed Mixed ÉTUDE étude")]
    rows += [(8, "aaaaa " * 3 + "aaaaaa " * 6 + "aaaa " * 9)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[5] for r in got}["houzesss"] == "house" and {r[0]: r[3] for r in got}["tiger"] == "tigar"


def test_empty_table_and_no_word(spark):
    assert run(spark, [(1, None)]) == [] == run(spark, [(1, "a b c 1234")])
    assert V.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    import sys

    sys.path.insert(0, "tests")
    from quern.llm.queries import op12_variants

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op12_variants(spark, "/root/testdata/sf0.001").select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_one_edit_and_search_agree_with_plain_python():
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc\xe9") for _ in range(rng.randint(5, 9))) for _ in range(1500)})
    n = [rng.randint(3, 9) for _ in words]
    import numpy as np

    count, form_n, form = V.near_words(words, np.array(n), words)
    for k in range(0, len(words), 37):
        near = [j for j, w in enumerate(words) if edit_one(words[k], w)]
        assert count[k] == len(near)
        assert form[k] == min(near, key=lambda j: (-n[j], words[j]), default=-1)
