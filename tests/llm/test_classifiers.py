import math
import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import host_reputation as H, pu_quality as Q, toxicity as X
from quern.llm.labels import fold


def distance(a, b):
    t = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, t[0] = t[0], i
        for j, y in enumerate(b, 1):
            prev, t[j] = t[j], min(t[j] + 1, t[j - 1] + 1, prev + (x != y))
    return t[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(6)
    terms = [("loser", False, 5.0), ("scum", False, 5.0), ("disgusting", False, 5.0), ("vequ", True, 5.0), ("lower", False, 1.0)]
    trie = X.FuzzyTrie(terms)
    words = ["loser", "lser", "losser", "lower", "scum", "scm", "disgustng", "dsgustng", "disgusting", "vequille", "veq", "", "xdisgusting"]
    words += ["".join(rng.choice("loserwdigut") for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    for w in words:
        best = [(0, i) for i, (t, stem, _) in enumerate(terms) if stem and w.startswith(t)]
        best = best or [(distance(w, t), i) for i, (t, stem, _) in enumerate(terms) if not stem and distance(w, t) <= (0 if len(t) < 5 else 1 if len(t) < 8 else 2)]
        got = trie.find(w)
        assert (got is None) == (not best), w
        if best:
            assert got[1] == min(best)[0], w


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(2)
    v = ["".join(rng.choice("abdeimnrt") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [(9001, None), (9002, ""), (9003, " ")], []
    for i in range(600):
        w = rng.choices(v, k=60)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(["moron", "loser", "vequxa", "vequxi", "vequxo", "vequxu"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(9100, " ".join(rng.choices(v, k=30) + ["m0ron", "l0ser", "l0ooser"])), (9101, " ".join(rng.choices(v, k=30)))]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in X.toxicity(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[9100].score > got[9101].score and got[9101].predicted == got[9001].predicted == 0
    kept = X.reject(df, lab)
    assert kept.columns == df.columns and {9001, 9002, 9003, 9101} <= {r.doc_id for r in kept.collect()}
    assert X.toxicity(df.limit(0), lab.limit(0)).count() == 0


def test_quotation_counts_apart():
    c = X.Counter([("moron", False, 5.0)])
    assert c.features('you are a moron today')[0] > 0
    quoted = c.features('the word "moron" is rude')
    assert quoted[0] == 0 and quoted[3] > 0
    assert c.features(None) == c.features("") == [0.0] * 5


def abusive_corpus(rng):
    """(rows, labels) in which five words mark toxic documents; each has a look-alike of its own nowhere else."""
    v = ["".join(rng.choice("abdegikl") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    bad = ["worthless", "disgusting", "idiotic", "pathetic", "moronic"]
    rows, labels = [], []
    for i in range(600):
        ws, toxic = rng.choices(v, k=rng.randint(30, 90)), i % 5 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            ws.insert(rng.randint(1, len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return v, rows, labels


def test_misspelling_and_quotation_on_fitted_weights(spark):
    rng = random.Random(5)
    v, rows, labels = abusive_corpus(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(X.FEATURES, model.weights))
    assert weight["misspelt"] > 0.1 and weight["disguised"] > 0.1 and weight["exact"] > 0.1 and weight["quoted"] < weight["exact"]
    filler = lambda: " ".join(rng.choices(v, k=12))
    texts = {
        "plain": f"{filler()} worthless {filler()} pathetic {filler()} disgusting",
        "misspelt": f"{filler()} wortless {filler()} pathetyc {filler()} disgustimg",
        "disguised": f"{filler()} w0rthl3ss {filler()} p4th3t1c {filler()} d1sgust1ng",
        "quoted": f"{filler()} \u201cworthless\u201d {filler()} \u201cpathetic\u201d {filler()} \u201cdisgusting\u201d",
        "reported": f"{filler()} he said worthless {filler()} called pathetic {filler()} quoted disgusting",
        "clean": filler() + " " + filler(),
        "long": filler() * 20_000,
    }
    test = spark.createDataFrame([(1, t) for t in texts.values()], "doc_id long, text string")
    got = dict(zip(texts, (r.score for r in X.score(test.coalesce(1), model).collect()), strict=True))
    assert {k for k, s in got.items() if s >= 0.7} == {"plain", "misspelt", "disguised"}, got


def test_score_against_brute_force(spark):
    """Small lexicon: edits by dynamic programming, windows and sums by hand."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    model = X.Model([("moron", False, 3.0), ("scumbags", False, 2.0)], [0.9, 0.7, 0.5, 0.1, 0.3], -2.0, frozenset(["moran"]))
    rng = random.Random(9)
    pool = ["moron", "moran", "maron", "scumbag", "scumbgs", "skumbogs", "scumbags", "m0ron", "said", "the", "a", "tree", "\u201cmoron\u201d", "house"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(200)]

    def want(text):
        ws, c, near = text.split(), [0.0] * 4, lambda w: min(((edits(w, t), i) for i, (t, _, _) in enumerate(model.terms) if edits(w, t) <= (1 if len(t) < 8 else 2)), default=None)
        for i, chunk in enumerate(ws):
            w = chunk.strip("\u201c\u201d")
            hit, kind = near(w), 0
            if hit and hit[0] == 0:
                kind = 1
            elif w == "m0ron":
                kind, hit = 2, (0, 0)
            elif hit and w not in model.ordinary:
                kind = 3
            if kind:
                quoted = chunk != w or any(x == "said" for x in ws[max(0, i - 3) : i] + ws[i + 1 : i + 3])
                opened = any(x[0] == "\u201c" and x[-1] != "\u201d" for x in ws[max(0, i - 6) : i])
                c[0 if quoted or opened else kind] += model.terms[hit[1]][2]
        x = [math.log1p(c[1]), math.log1p(c[2]), math.log1p(c[3]), math.log1p(c[0]), math.log1p(1000 * (c[1] + c[2]) / (len(ws) + 50))]
        return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights)) + model.bias)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in X.score(df, model).collect():
        assert abs(r.score - want(texts[r.doc_id])) < 1e-9, texts[r.doc_id]


def test_rejection_is_by_row(spark):
    v, rows, labels = abusive_corpus(random.Random(6))
    toxic = next(t for i, t in rows if i == 0)
    more = [(5000, toxic, 1), (5000, "clean enough", 2), (None, toxic, 3), (None, None, 4), (5001, "", 5), (5002, toxic, 6), (5002, toxic, 7)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows] + more, "doc_id long, text string, score int").repartition(3)
    kept = X.reject(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == df.columns
    assert sorted(r.score for r in kept.where("score > 0").collect()) == [2, 4, 5]
    assert X.reject(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_quality_separates(spark):
    rng = random.Random(3)
    v = ["".join(rng.choice("abdeimnrt") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [(9001, None), (9002, "")], []
    for i in range(800):
        good = i % 5 != 0
        w = rng.choices(v, k=rng.randint(20, 120))
        text = ". ".join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9)) if good else rng.choice([" ".join([w[0]] * 60), "!! ".join(x.upper() for x in w), " | ".join(w)])
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in Q.quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.mean([got[i].predicted == (i % 5 != 0) for i in range(800) if got[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    assert Q.quality(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_risk_and_gradient_against_brute_force():
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (6, 3)), rng.normal(0, 1, (9, 3))
    par = [rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, 2), rng.normal(0, 1, 1)]
    loss = lambda z: math.log(1 + math.exp(-z))
    g = lambda x: sum(par[2][j] * math.tanh(sum(x[i] * par[0][i, j] for i in range(3)) + par[1][j]) for j in range(2)) + par[3][0]
    for prior in (0.3, 0.95):
        first = prior * sum(loss(g(x)) for x in p) / len(p)
        second = sum(loss(-g(x)) for x in u) / len(u) - prior * sum(loss(-g(x)) for x in p) / len(p)
        assert np.allclose(Q.risk(par, p, u, prior), (first, second))
        got = Q.gradient(par, p, u, prior)
        for a, k in enumerate(par):
            for at in np.ndindex(k.shape):
                old, two = k[at], []
                for d in (1e-5, -1e-5):
                    k[at] = old + d
                    r = Q.risk(par, p, u, prior)
                    two.append(-r[1] if second < 0 else sum(r))
                k[at] = old
                assert abs((two[0] - two[1]) / 2e-5 - got[a][at]) < 1e-6


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.6, 0.85):
        pos = rng.normal(2, 1, (3000, 4))
        unl = np.vstack([rng.normal(2, 1, (int(6000 * share), 4)), rng.normal(-1, 1, (6000 - int(6000 * share), 4))])
        assert abs(Q.estimate_prior(pos, rng.permutation(unl)) - share) < 0.06


def test_quality_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("x", F.lit("y"))
    docs = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 7").withColumn("text", F.lit("word " * 200_000)))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("score", F.lit(1.0)).withColumn("text", F.lit("t"))
    one, many = (sorted((r.doc_id, r.score) for r in Q.quality(d, labels).collect()) for d in (docs.repartition(1), docs.repartition(7)))
    assert one == many and len(one) == docs.count()


def test_folds(spark):
    import zlib

    r = spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", fold(F.col("i"), 5).alias("f")).collect()
    assert all(x.f == zlib.crc32(str(x.i).encode()) % 5 for x in r)


def test_hosts_urls_and_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = ["http://A.Example.NET/en/1?x#y", "https://example.net/EN/", "ftp://x.org/fr/a?b", "http://xnet/", "http://b.net", "nothing", None, "http://www.example.com/de/1", "a://b://c/d", "http://h?q/de/", "http://example.com/deep"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    out = spark.createDataFrame([(0, True), (0, False), (7, False), (99, True), (None, True)], "page_id long, good boolean")
    rows = H.judge(pages, rules, out).collect()
    assert len(rows) == len(urls) + 1
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert got == {
        0: ("a.example.net", "/en/1", "example.net/en/"), 1: ("example.net", "/EN/", "net/"), 2: ("x.org", "/fr/a", "org/fr/"), 3: ("xnet", "/", None), 4: ("b.net", "", None), 5: ("", "", None), 6: ("", "", None),
        7: ("www.example.com", "/de/1", "example.com/de/"), 8: ("b:", "//c/d", None), 9: ("h", "", None), 10: ("example.com", "/deep", None),
    }
    assert all(r.verdict in ("allow", "block") for r in rows)
    assert H.judge(pages.limit(0), rules, out).count() == 0 and H.judge(pages.limit(0), rules).count() == 0
    both = {r.page_id: r for r in H.judge(pages, rules).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in both.items()} == got
    assert both[10].verdict == "block"  # its one judged neighbour by domain is blocked


def test_domains_by_suffix_rules(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.y.ck", "w.x.y.ck", "www.ck", "a.www.ck", "one", "a.b.c.com", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffix, domain = H.domain_parts(F.col("h"), ("co.uk", "*.ck", "!www.ck"))
    got = {r.h: (r.s, r.d) for r in df.select("h", suffix.alias("s"), domain.alias("d")).collect()}
    assert got == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.ck": ("y.ck", "x.y.ck"), "w.x.y.ck": ("y.ck", "x.y.ck"),
        "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "one": ("one", "one"), "a.b.c.com": ("com", "c.com"), "": ("", ""),
    }


def test_reputation_shrinks_to_the_domain(spark):
    rows = [("a.bad.com", False)] * 40 + [("b.bad.com", False)] * 30 + [("a.good.com", True)] * 40 + [("b.good.com", True)] * 30 + [("new.bad.com", True), ("new.good.com", True), ("none.bad.com", None)]
    r = {x.host: x.alpha / (x.alpha + x.beta) for x in H.reputations(spark.createDataFrame(rows, "host string, good boolean")).collect()}
    assert r["a.bad.com"] < 0.1 and r["a.good.com"] > 0.9 and r["new.bad.com"] < r["new.good.com"] and r["none.bad.com"] < 0.2
    assert all(math.isfinite(v) for v in r.values())


def test_both_readings_of_a_sign_and_long_quotations(spark):
    rng = random.Random(21)
    v, rows, labels = abusive_corpus(rng)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = X.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    c = X.Counter(model.terms, model.ordinary, model.crowded)
    for word, seen in {"1d10t1c": 2, "w0rth1ess": 2, "path3t1c": 2, "m0ron1c": 2, "1111": 0, "3.14": 0}.items():
        assert c.kind(word)[0] == seen, word
    filler = lambda n: " ".join(rng.choices(v, k=n))
    bad = "worthless pathetic disgusting idiotic moronic".split()

    def text(kind):
        words = filler(30).split()
        for w in rng.sample(bad, 4):
            at = rng.randrange(1, 29)
            words.insert(at, {"misspelt": X.misspelt, "disguised": X.disguised}.get(kind, str)(w))
        return f"{filler(20)} “{' '.join(words)}” {filler(20)}" if kind == "quoted" else " ".join(words)

    cases = [(kind, text(kind)) for kind in ("plain", "misspelt", "disguised", "quoted") for _ in range(25)] + [("clean", filler(40)) for _ in range(25)]
    bad_kinds = {"plain", "misspelt", "disguised"}

    def rates(m):
        test = spark.createDataFrame(list(enumerate(t for _, t in cases)), "doc_id long, text string")
        hit = {cases[r.doc_id][0] + str(r.doc_id) for r in X.score(test, m).where("score >= 0.7").collect()}
        good = sum(any(h.startswith(k) for k in bad_kinds) for h in hit)
        return good / max(len(hit), 1), good / 75

    whole = rates(model)
    assert whole[0] > 0.95 and whole[1] > 0.9
    by_name = dict(zip(X.FEATURES, range(5)))
    for name in ("misspelt",):  # the rate of hits counts disguised ones too
        less = X.Model(model.terms, [0.0 if i == by_name[name] else w for i, w in enumerate(model.weights)], model.bias, model.ordinary, model.crowded)
        assert rates(less)[1] < whole[1] - 0.1, name
    assert all(c.features(t)[1] > 0 == c.features(t)[0] for k, t in cases if k == "disguised")
    told = X.Counter(model.terms, model.ordinary, model.crowded)
    told.quoted = lambda chunks, at: False
    assert all(told.features(t)[0] == 0 for k, t in cases if k == "quoted")  # by the open quotation alone
    assert X.quotations('a "b c" d "e f'.split()) == {1, 2} and X.quotations('he said "no" (“x y”).'.split()) == {2, 3, 4}
