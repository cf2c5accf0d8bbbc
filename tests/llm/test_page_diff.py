import random

from quern.llm import page_diff as P


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 25)) for _ in range(2))
        got = sorted(P.shared_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site">Site</header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><header><h1>A  &lt;b&gt;</h1></header><p><b>bold</b>word<br>line<p>second &eacute;&#233;&#xe9; &nbsp; end <form><input>mail</form><section class="comments"><p>Me too</p></section><p>third</article>
<aside>side</aside><footer>&copy; f</footer></body></html>"""
OTHER = """<body><div>Menu line</div><div>Unique one</div><div>Shared foot</div>"""
OTHER2 = """<body><div>Menu line</div><div>Unique two</div><div>Shared foot</div><p>cut off <b"""


def test_large_pairs_are_aligned_in_parts(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(P, "ALIGN_BITS", 300)
    for _ in range(100):
        a, b = (rng.choices("abcdefgh", k=rng.randint(0, 80)) for _ in range(2))
        got = sorted(P.shared_lines(a, b))
        assert len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_very_long_pages():
    import time
    import tracemalloc

    rng = random.Random(4)
    a = [f"line {i}" for i in range(200_000)]
    b = [x if rng.random() < 0.9 else "other" for x in a]
    tracemalloc.start()
    began = time.perf_counter()
    assert len(P.shared_lines(a, b)) >= sum(x == y for x, y in zip(a, b))
    assert time.perf_counter() - began < 120 and tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_names_do_not_hide_what_holds_the_text():
    text = lambda page: P.main_text(P.text_lines(page), None)[0]
    assert text('<main class="no-sidebar"><p>kept</p></main>') == "kept"
    assert text('<article class="post ad-free"><p>kept</p></article>') == "kept"
    assert text('<article class="ad comments"><p>kept</p></article>') == "kept"
    assert text('<div class="content has-sidebar"><p>kept</p></div>') == "kept"
    assert text('<div class="sidebar-right"><div><p>The long text</p></div><div><p>of the page</p></div></div><div class="ad">Buy</div>') == "The long text of the page"


PLAIN = """<body><div><p>Home</p><p>News</p></div><div><div><h1>Title {0}</h1><p>First paragraph of page {0}</p><p>A passage that many share</p><p>Last {0}</p></div></div><div><p>Foot</p><p>Terms</p></div></body>"""


def test_differencing_alone_finds_the_article(spark, monkeypatch):
    """Without article, nav and class names only the comparison with the neighbour tells text from furniture."""
    rows = [(i, f"http://a.org/{i}", PLAIN.format(i)) for i in range(20)] + [(3, "http://a.org/3", PLAIN.format(3)), (50, "http://a.org/3b", PLAIN.format(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = lambda i: f"Title {i} First paragraph of page {i} A passage that many share Last {i}"
    assert {(r.page_id, r.text) for r in P.extract(df).collect()} == {(i, want(3 if i == 50 else i)) for i, _, _ in rows}
    lines = P.text_lines(PLAIN.format(1))
    assert P.main_text(lines, P.text_lines(PLAIN.format(2)))[0] == want(1)
    assert P.main_text(lines, None)[0] == f"Home News {want(1)} Foot Terms"  # differencing switched off


def test_a_shared_passage_in_a_flat_page_stays():
    page = "<p>Menu</p><p>Own beginning {0}</p><p>Shared passage</p><p>More {0}</p><p>Foot</p>"
    assert P.main_text(P.text_lines(page.format(1)), P.text_lines(page.format(2)))[0] == "Own beginning 1 Shared passage More 1"


def test_text_does_not_depend_on_partitions(spark):
    rng = random.Random(7)
    rows = [(i, f"http://h{rng.randint(0, 3)}.org/{rng.randint(0, 9)}/{i % 25}", PLAIN.format(rng.randint(0, 12))) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(tuple(r) for r in P.extract(df.repartition(5)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 150


def test_pages(spark):
    rows = [(1, "http://a.org/x/1", PAGE), (2, "http://a.org/y/1", OTHER), (3, "http://a.org/y/2", OTHER2), (4, None, None), (5, "nothing", ""), (6, "http://b.org", "<nav>x"), (6, "http://b.org", "<nav>x"), (7, "http://c.org/", "<div class=ad>open <article>kept &amp; well</article>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in P.extract(df.coalesce(1)).collect()))
    assert all(r.n_chars == len(r.text) for r in P.extract(df).collect())
    assert got == [(1, "A <b> boldword line second ééé end third"), (2, "Unique one"), (3, "Unique two cut off"), (4, ""), (5, ""), (6, ""), (6, ""), (7, "kept & well")]


def test_empty_table(spark):
    assert P.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_article(spark):
    """On the given pages the text is that of the article's headline and paragraphs."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(/?(p|h1)|br)>", " ", body))).split())
    assert {r.page_id: r.text for r in P.extract(pages).collect()} == want


def test_differencing_decides_outside_articles(spark):
    """Lines outside an article go when shared and stay when not; a whole copy is no evidence."""
    page = "<div>Menu line</div><article><p>Text {0}</article><div>Byline {0}</div><div>Shared foot</div>"
    rows = [(1, "http://a.org/1", page.format("one")), (2, "http://a.org/2", page.format("two")), (3, "http://alone.org/1", page.format("three"))]
    rows += [(4, "http://copy.org/1", "<p>Same</p><p>words</p>"), (5, "http://copy.org/2", "<p>Same</p><p>words</p>")]
    rows += [(6, "http://three.org/a/1", page.format("x")), (7, "http://three.org/a/2", page.format("x")), (8, "http://three.org/b", page.format("y"))]
    got = {r.page_id: (r.text, r.paired_with) for r in P.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got == {
        1: ("Text one Byline one", 2),
        2: ("Text two Byline two", 1),
        3: ("Text three", None),
        4: ("Same words", None),
        5: ("Same words", None),
        6: ("Text x Byline x", 8),
        7: ("Text x Byline x", 8),
        8: ("Text y Byline y", 7),
    }


INSIDE = [
    '<section id="comments"><article>Reader says hi</article></section>',
    "<aside><article>Related teaser</article></aside>",
    "<footer><article>Newest post</article></footer>",
    "<nav><article>Menu</article></nav>",
    '<p class="advert">Buy now',
    '<p class="notice">We use crumbs</p>',
    '<h2 id="comments">Two comments</h2>',
    '<ul><li class="share">Post it<li class="share">Mail it</ul>',
    '<figure><figcaption class="promo">Sale</figcaption></figure>',
    "<div hidden>Not seen</div>",
    '<p style="color:red; display : none">Not seen</p>',
    '<div role="complementary"><div><article>Side</article></div></div>',
]


def test_furniture_wins_over_an_article_inside_it():
    for extra in INSIDE:
        for page in (f"<article><p>Main one</p><p>Main two</p></article>{extra}<p>", f"<article><p>Main one</p>{extra}<p>Main two</p></article>", f"{extra}<main><p>Main one<p>Main two</main>"):
            for other in (None, P.text_lines("<article><p>Other text</article>"), P.text_lines(page.replace("Main", "New"))):
                assert P.main_text(P.text_lines(page), other)[0] == "Main one Main two", (page, other)
    page = '<article><p>Buy <span class="ad">this <span>very</span> thing</span>nothing <span>at</span> all</p></article>'
    assert P.main_text(P.text_lines(page), None)[0] == "Buy nothing at all"
    assert P.main_text(P.text_lines('<p class="hidden">kept <a hidden-x="1">too</a> <div class="is-hidden">seen</div>'), None)[0] == "kept too seen"


def test_shared_container_inside_an_article_goes():
    page = "<article><p>{0} text of its own and some</p><div><p>Follow us</p><p>Write to us</p></div><div><p>{0} more and more</p><p>Both say so</p></div></article>"
    one, two = (P.text_lines(page.format(x)) for x in ("First", "Second"))
    assert P.main_text(one, two)[0] == "First text of its own and some First more and more Both say so"
    near = P.text_lines(page.format("First").replace("more", "mere"))
    assert P.main_text(one, near)[0] == "First text of its own and some Follow us Write to us First more and more Both say so"  # a near copy is no evidence


def plain_text(lines, other):
    """main_text with the quadratic table of the alignment and the rules written out."""
    a, b = [t for t, _, _ in lines], [t for t, _, _ in other]
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = size[i][j] + 1 if a[i] == b[j] else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


def test_random_pages_against_a_quadratic_table():
    rng = random.Random(11)
    words = ["Menu", "Foot", "News", "One", "Two", "Three", "Four"]
    def page():
        out = []
        for _ in range(rng.randint(0, 12)):
            tag = rng.choice(["p", "div", "nav", "article", "section class=ad", "li", "h2 id=comments", "aside", "span"])
            out.append(f"<{tag}>{rng.choice(words)} {rng.choice(words)}" + rng.choice(["", f"</{tag.split()[0]}>"]))
        return "".join(out)
    for _ in range(400):
        lines, other = P.text_lines(page()), P.text_lines(page())
        text, shared = P.main_text(lines, other)
        assert shared == plain_text(lines, other)
        assert set(text.split()) <= {w for t, z, _ in lines if z != 0 for w in t.split()}


def test_clashing_names(spark):
    names = "host path hx lines k own range other text n_chars paired_with place".split()
    rows = [(1, "http://a.org/1", "<nav>N</nav><p>One</p>", *["x"] * len(names)), (2, "http://a.org/2", "<nav>N</nav><p>Two</p>", *["x"] * len(names))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((r.page_id, r.text) for r in P.extract(df).collect()) == [(1, "One"), (2, "Two")]


def test_ranges_lose_no_pair(spark):
    """Every page of a host has a neighbour wherever the ranges are cut."""
    rows = [(i, f"http://h{i % 30:02}.org/{i:03}", f"<div>Menu {i % 30}</div><p>Own {i}</p><div>Foot</div>") for i in range(60)]
    rows += [(100 + i, f"http://z.org/{i:03}", f"<div>Menu z</div><p>Own {100 + i}</p><div>Foot</div>") for i in range(40)] + [(None, "http://z.org/new", "<p>Foot</p><p>Own None</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 7, 150):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = P.extract(df).collect()
            assert sorted(r.text for r in got) == sorted(f"Own {r[0]}" for r in rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
