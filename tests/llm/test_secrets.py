import hashlib
import random
import re

from quern.llm import secrets as S

ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    a = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    c = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    h = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return a, c, h


def test_base_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["password = ", "Secret:'", 'api_key":"', "APIKEY=", "token: ", "abc", "abcdef12", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é😀", " ", "\n", "x=", "passwd=token=secret:", "==", "AKIAAKIA", "/+_."]
    texts = [None, "", "password=short", "secret=token: abcdefgh", "😀é password=abcdef12", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "f" * 24, "f" * 23, "token=" + "a" * 60_000]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_hex int")
    got = {r.doc_id: r for r in S.scan(df).collect()}
    for i, t in enumerate(texts):
        a, c, h = base(t)
        spans = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a + c + h))
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == (len(a), len(c), len(h)), t
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), t
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(",")), t


def test_weak_parts_need_a_complement(spark):
    opaque = "Ab3dEfGh1JkLmN0pQrStUvWxYz12345678AbCd"
    rows = [
        (1, f"user=alice {opaque}"),
        (2, f"only {opaque} here"),
        (3, "see https://example.com/x and user=bob"),
        (4, "https://db.example.com:5432 password=hunter22"),
        (5, f"user=alice {'. ' * 400} {opaque}"),
        (6, "https://example.com " + "x " * 119 + opaque),
    ]
    got = {r.doc_id: [x.split(":")[0] for x in r.spans.split(",") if x] for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["login", "opaque"], 2: [], 3: [], 4: ["endpoint", "assign"], 5: [], 6: ["endpoint", "opaque"]}


def parts(text):
    """(start, kind, end) of every part, weak ones clear of base findings."""
    a, c, h = base(text)
    strong = a + c + h
    out = list(strong)
    for k, pattern in ((3, S.ENDPOINT), (4, S.LOGIN.replace("(?i:", "(?:")), (5, S.OPAQUE)):
        for m in re.compile(pattern, re.I if k == 4 else 0).finditer(text):
            if not any(s < m.end() and m.start() < e for s, _, e in strong):
                out.append((m.start(), k, m.end()))
    return out


def test_linking_against_brute_force(spark):
    rng = random.Random(12)
    opaque = "".join(rng.choices("ABCdef123+/", k=40))
    bits = ["https://db.example.com:80 ", "user=alice ", "login: bob-1 ", opaque + " ", "password=hunter22 ", "AKIA" + "B" * 16 + " ", "é. " * 30, ". " * 60, "x y z " * 25]
    texts = ["".join(rng.choices(bits, k=rng.randint(2, 14))) for _ in range(300)]
    got = {r.doc_id: r.spans for r in S.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    linked = 0
    for i, text in enumerate(texts):
        all_parts = parts(text)
        role = lambda k: "id" if k in (1, 3, 4) else "secret"
        want = [
            (s, k, e) for s, k, e in all_parts
            if k < 3 or any(role(k2) != role(k) and s2 <= e + S.REACH and e2 >= s - S.REACH for s2, k2, e2 in all_parts)
        ]
        linked += sum(k > 2 for _, k, _ in want)
        assert got[i] == ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want)), text
    assert linked > 100


def test_many_matches_in_one_text(spark):
    text = "token=abcdef12 é " * 20_000
    r = S.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    a, c, h = base(text)
    assert r.n_assign == 20_000 and r.base_sha256 == hashlib.sha256(",".join(f"assign:{s}:{e}" for s, _, e in a).encode()).hexdigest()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "user=al password=abcdef1"), (1, "user=al password=abcdef1"), (None, "token=abcdefg")], "doc_id long, text string")
    assert sorted(r.n_assign for r in S.scan(df).collect()) == [1, 1, 1]
    assert S.scan(df.limit(0)).count() == 0
