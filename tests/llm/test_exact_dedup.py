import hashlib
from collections import defaultdict

from quern.llm import exact_dedup as E

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((i, best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["A b", "a B", "É", "é", "", None, " ", "x" * 50_000, "X" * 50_000, "tie", "TIE"])]
    rows += [(100 + i, "Hot TEXT" if i % 2 else "hot text") for i in range(700)] + [(5000, "solo"), (5000, "solo")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], "doc_id long, text string, sha string, salt int")
    for keep, best in (("largest", max), ("smallest", min)):
        got = sorted(tuple(r) for r in E.exact_groups(df.repartition(5), keep=keep).collect())
        assert got == brute(rows, best)
    kept = E.drop_copies(df, keep="largest")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, b, n, k, s in brute(rows, max) if k})


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (1, "A"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in E.exact_groups(df).collect()), key=str)
    assert got == sorted([(None, 1, 2), (1, 1, 2), (None, None, 1)], key=str)
    assert E.exact_groups(df.limit(0)).count() == 0


def test_no_text_is_lost_and_none_stays_twice(spark):
    rows = [(5, "a"), (9, "A"), (5, "only copy of b"), (7, "c"), (7, "c"), (8, "d"), (8, "D"), (None, "e"), (None, "E"), (4, None), (3, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, k_id string").repartition(3)
    kept = [(r.doc_id, (r.text or "").translate(LOWER)) for r in E.drop_copies(df, keep="largest").collect()]
    assert sorted(kept, key=str) == sorted([(9, "a"), (5, "only copy of b"), (7, "c"), (8, "d"), (None, "e"), (4, "")], key=str)


def test_runs_of_a_hot_text_are_joined_by_text(spark):
    rows = [(i, "x" * 40 + ("one" if i % 3 else "two")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(tuple(r) for r in E.exact_groups(df, hot_fraction=0.01, salts=16).collect())
    assert got == brute(rows, min)
