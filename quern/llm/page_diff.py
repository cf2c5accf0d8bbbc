"""HTML extraction by nearest-URL page differencing.

Pages are dealt to ranges of (host, path, id) and sorted, so each page's
neighbours by URL path within its host stand beside it, and a host with very
many pages spreads over several ranges.  Copies of one html are one run; a page
is compared with the nearest other html before and after its run, which travels to
the page's range where it lies in another one, so where the ranges are cut changes
nothing.  Of the two, the one whose path has the longer common prefix is the
pair (one without text, or with the same lines, says nothing and the other one is
taken); the lines of both are aligned by longest common subsequence.

Shared lines are site furniture and go, and what decides on a line is its
container (the innermost sectioning element around it):

* a container whose characters are mostly the page's own stays whole, since a
  passage that two articles share is text; in the body itself, which holds
  everything, a shared line stays only between lines of the page's own;
* of other containers only the lines stay that are not shared.

Elements and names add to that.  Lines inside an article or main element stay, but for
shared lines of a container inside it that is mostly shared, if the article is
mostly the page's own.  Lines inside navigation, headers, footers, sidebars, notices,
adverts, forms and reader comments go whether shared or not, also if an article
stands in them; where only a class, id or role says so (paragraphs, list items, headings
and spans have them too), not if that container holds more than half of what the page
has of its own.  Only where furniture was left open before the page's one article, and
that is most of its text, the article stays.  Hidden elements go.

A page without a neighbour to compare with has only its article's lines, if it
has one, else all its lines.  A null or empty page gives an empty text; a page that
is cut off is read to its end; very long pages are aligned in bounded memory;
repeated rows and copies give a row each, with one text per pair; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .host_reputation import url_parts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|iframe|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements by their part in a page, and words of class, id and role that mark furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
NO_DISPLAY = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)\bdisplay\s*:\s*none", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
KEY = ("host", "path", "page_id")
SAMPLE = 20  # keys a range from which the ranges are cut
CONTENT = frozenset(["article", "main"])
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset".split())
NEGATED = frozenset("has have no not non with without is free less".split())
ENDS = frozenset("p li h1 h2 h3 h4 h5 h6 figcaption dd dt td th".split())  # containers only where their names mark furniture
NESTED = frozenset("div section ul ol dl table details figure body html center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adsense banner sponsor sponsored sponsors promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead topbar footer contentinfo sidebar sidenav aside complementary widget widgets "
    "related recommended recommendations share sharing social newsletter subscribe subscription cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist reply replies respond disqus "
    "form login signup search pagination pager toolbar skip copyright".split()
)


def marks_furniture(attributes: str) -> bool:
    """A class, id or role names furniture; ``has-sidebar``, ``no-ads`` or ``ad-free`` do not."""
    for a, b, c in NAMES.findall(attributes):
        for token in (a or b or c).lower().split():
            parts = [p for p in re.split(r"[^a-z0-9]+", token) if p]
            if parts and parts[0] not in NEGATED and parts[-1] not in NEGATED and MARKS.intersection(parts):
                return True
    return False


def is_hidden(attributes: str) -> bool:
    """The attribute ``hidden``, or a style that does not display."""
    return bool(HIDDEN.search(QUOTED.sub('""', attributes)) or NO_DISPLAY.search(attributes))


#: A block's text, its zone and its container's number.  Zones: 2 in an article, 3 in a container inside one,
#: 1 elsewhere, 0 furniture by element or hidden, -1 furniture by name, -2 an article within furniture.
Line = tuple[str, int, int]
BODY = 0


def text_lines(page: str | None) -> list[Line]:
    """The blocks in page order; the body is container 0."""
    page = page or ""
    lines: list[Line] = []
    held: list[str] = []
    open_: list[tuple[str, int, int]] = [("", 1, BODY)]
    made = BODY

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                lines.append((text, *open_[-1][1:]))
            held.clear()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                flush()
            continue
        name = name.lower()
        marked = not m[2] and bool(m[4]) and name not in ("body", "html") and name not in VOID and (is_hidden(m[4]) or marks_furniture(m[4]))
        if name in INLINE and not (name == "span" and (marked or open_[-1][0] == "span")):
            continue
        if name == "br":
            held.append("\n")
            continue
        if name == "span" and not marked:  # inside a span that is furniture
            if m[2]:
                flush()
                open_.pop()
            else:
                open_.append(("span", *open_[-1][1:]))
            continue
        flush()
        if m[2]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
            continue
        if name in VOID:
            continue
        while open_[-1][0] in ENDS and (name not in INLINE) and (open_[-1][0] not in ("li", "dd", "dt", "td", "th") or name in (open_[-1][0], "dt", "dd", "tr")):
            open_.pop()  # a paragraph or heading that was not closed ends here
        if name in ENDS or name == "span":
            if not marked:
                continue
        elif name not in NESTED and name not in CONTENT and name not in FURNITURE:
            continue
        _, zone, container = open_[-1]
        if marked and is_hidden(m[4]):
            zone = 0
        elif name in CONTENT:
            zone = 2 if zone > 0 else -2 if zone != -2 and not any(z >= 2 for _, z, _ in open_) else zone
        elif name in FURNITURE and not (name == "header" and zone in (2, 3, -2)):
            zone = 0
        elif zone and marked:
            zone = -1
        elif zone == 2 and name in NESTED:
            zone = 3
        if name not in ("body", "html") and not zone == open_[-1][1] == -1:  # what a name marks is one container
            made += 1
            container = made
        open_.append((name, zone, container))
    if at < len(page) and "<" not in page[at:]:
        held.append(page[at:])
    elif at < len(page):
        held.append(page[at:] if not re.match(r"<[a-zA-Z/!]", page[page.index("<", at) :]) else page[at : page.index("<", at)])
    flush()
    # An article within furniture is the page's own only if furniture was left open before it: there is no other, and it is most of the text.
    size = {z: sum(len(t) for t, y, _ in lines if y == z) for z in {z for _, z, _ in lines}}
    inner = 2 if not (size.get(2) or size.get(3)) and size.get(-2, 0) >= size.get(1, 0) else 0
    return [(t, inner if z == -2 else z, c) for t, z, c in lines]


ALIGN_BITS = 1 << 28  # of kept rows and of masks, in one alignment


def _masks(b: list[int]):
    """line -> integer whose bit j says b[j] is that line; only ``ALIGN_BITS`` of them are remembered."""
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    known: dict[int, int] = {}
    room = max(1, ALIGN_BITS // (len(b) + 64))

    def mask(x: int) -> int:
        at = known.get(x)
        if at is None:
            own = places.get(x, ())
            if len(own) < 8:
                at = sum(1 << j for j in own)
            else:
                bits = np.zeros(len(b), np.uint8)
                bits[own] = 1
                at = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(known) < room:
                known[x] = at
        return at

    return mask


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of ``a``: an integer whose bit j is 0 where its LCS with b[:j + 1] is longer than with b[:j]."""
    full, mask = (1 << len(b)) - 1, _masks(b)
    v = full
    yield v
    for x in a:
        u = v & mask(x)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS of ``a`` with each prefix of ``b``."""
    v = 0
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` on one longest common subsequence of both lists.

    Rows of the bit-parallel table are kept while they fit; larger pairs are
    cut where the best alignment passes the middle of ``a``, and so on.
    """
    number: dict[str, int] = {}
    x, y = ([number.setdefault(t, len(number)) for t in side] for side in (a, b))
    out: set[int] = set()
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and x[i0] == y[j0]:
            out.add(i0)
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and x[i1 - 1] == y[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.add(i1)
        if i0 == i1 or j0 == j1:
            continue
        part_a, part_b = x[i0:i1], y[j0:j1]
        if len(part_a) * len(part_b) > ALIGN_BITS and len(part_a) > 1:
            mid = len(part_a) // 2
            j = int((_lengths(part_a[:mid], part_b) + _lengths(part_a[mid:][::-1], part_b[::-1])[::-1]).argmax())
            todo += [(i0, i0 + mid, j0, j0 + j), (i0 + mid, i1, j0 + j, j1)]
            continue
        rows = list(_rows(part_a, part_b))
        i, j = len(part_a), len(part_b)
        while i and j:
            bit = 1 << (j - 1)
            if rows[i] & bit:  # b[j - 1] adds nothing here
                j -= 1
            elif not rows[i - 1] & bit:  # nor does a[i - 1]
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.add(i0 + i)
    return out


def main_text(lines: list[Line], other: list[Line] | None) -> tuple[str, int]:
    """(main text, number of lines shared with the paired page)."""
    shared = shared_lines([t for t, _, _ in lines], [t for t, _, _ in other]) if other is not None else set()
    own: dict[int, int] = {}
    size: dict[int, int] = {}
    for i, (t, z, c) in enumerate(lines):
        size[c] = size.get(c, 0) + len(t)
        own[c] = own.get(c, 0) + (0 if i in shared else len(t))
    everything = sum(n for c, n in own.items())
    article = any(z >= 2 for _, z, _ in lines)
    if other is None and article:
        return " ".join(t for t, z, _ in lines if z >= 2), 0
    believed = {c for _, z, c in lines if z == -1 and (article or 2 * own[c] <= everything)}
    open_lines = [i for i, (_, z, c) in enumerate(lines) if z == 1 or z == -1 and c not in believed]
    mine = [i for i in open_lines if i not in shared and lines[i][2] == BODY]
    between = range(mine[0], mine[-1] + 1) if mine else range(0)
    size[BODY] = sum(len(lines[i][0]) for i in between if lines[i][2] == BODY)
    inside = [i for i, (_, z, _) in enumerate(lines) if z >= 2]
    # Of an article that is mostly the page's own, containers that are mostly shared lose what is shared.
    compared = 2 * sum(len(lines[i][0]) for i in inside if i not in shared) > sum(len(lines[i][0]) for i in inside)
    kept = {i for i in inside if not (compared and i in shared and lines[i][1] == 3 and 2 * own[lines[i][2]] <= size[lines[i][2]])}
    for i in open_lines:
        c = lines[i][2]
        mostly_own = 2 * own[c] > size[c]
        if i not in shared or mostly_own and (c != BODY or i in between):
            kept.add(i)
    return " ".join(lines[i][0] for i in sorted(kept)), len(shared)


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with (range, own), and the number of ranges.

    The nearest row of another html before and after a range also comes to it,
    not as its own.  Only one short row a range is gathered at the driver.
    """
    spark, want = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(rows.select(F.struct(*KEY).alias("k"), "hx"))
    found = {tuple(r.k) for r in keys.select("k").orderBy(F.rand(3)).limit(SAMPLE * want).collect()}
    order = lambda k: (k[0], k[1], k[2] is not None, k[2])
    found = sorted(found, key=order)
    step = max(1, -(-len(found) // want))
    starts = found[step::step]
    kind = keys.schema["k"].dataType.simpleString()
    fixed = F.broadcast(spark.createDataFrame([(starts,)], f"starts array<{kind}>"))  # one row

    def ranged(to: DataFrame) -> DataFrame:
        return to.crossJoin(fixed).withColumn("range", F.size(F.filter("starts", lambda x: x <= F.col("k")))).drop("starts")

    ends = []  # by side: range -> (key, html) of its last (first) row, and of the last (first) with another html
    for best in (F.max, F.min):
        edge = ranged(keys).groupBy("range").agg(best(F.struct("k", "hx")).alias("e"))
        edge = cut(edge)  # one row a range
        second = ranged(keys).join(F.broadcast(edge), "range").where(F.col("hx") != F.col("e.hx")).groupBy("range").agg(best(F.struct("k", "hx")).alias("s"))
        both = edge.join(second, "range", "left").collect()
        ends.append({r["range"]: [(tuple(x.k), x.hx) for x in (r.e, r.s) if x is not None] for r in both})
    lasts, firsts = ends
    extra = set()
    for here, own in ((r, e[0]) for r, e in firsts.items()):
        extra.add((next((e for r in range(here - 1, -1, -1) for e in lasts.get(r, ()) if e[1] != own[1]), None), here))
    for here, own in ((r, e[0]) for r, e in lasts.items()):
        extra.add((next((e for r in range(here + 1, len(starts) + 1) for e in firsts.get(r, ()) if e[1] != own[1]), None), here))
    more = spark.createDataFrame([(k, x, r) for e, r in extra if e for k, x in (e,)], f"b_k {kind}, b_hx bigint, b_range int")  # two rows a range
    all_rows = rows.withColumn("k", F.struct(*KEY))
    columns = ["page_id", "url", "html", "host", "path", "hx"]
    home = ranged(all_rows).select(*columns, "range", F.lit(True).alias("own"))
    guests = all_rows.join(F.broadcast(more), F.col("k").eqNullSafe(F.col("b_k")) & (F.col("hx") == F.col("b_hx"))).select(*columns, F.col("b_range").alias("range"), F.lit(False).alias("own"))
    return home.unionByName(guests), len(starts) + 1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, paired_with, shared_lines."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumns({"host": host, "path": path, "hx": F.xxhash64(F.coalesce("html", F.lit("")))})
    rows, ranges = _dealt(rows)
    rows = rows.repartitionById(ranges, "range").sortWithinPartitions("range", *KEY, "hx")
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page_id", "url", "text", "n_chars", "paired_with", "shared_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Run:
            """Neighbouring rows of one html in one host and range: what they share, and (id, url, path) of those to put out."""

            def __init__(self, row: tuple):
                _, _, page, self.host, self.first, self.hx, self.range, _ = row
                self.first_id, self.lines, self.members = row[0], text_lines(page), []
                self.add(row)

            def fits(self, row: tuple) -> bool:
                return (row[3], row[5], row[6]) == (self.host, self.hx, self.range)

            def add(self, row: tuple) -> None:
                self.last, self.last_id = row[4], row[0]
                if row[7]:
                    self.members.append((row[0], row[1], row[4]))

        def done(before: Run | None, this: Run, after: Run | None) -> Iterator[tuple]:
            sides = []
            for rank, (x, path, at) in enumerate(((before, before and before.last, before and before.last_id), (after, after and after.first, after and after.first_id))):
                if x and (x.host, x.range) == (this.host, this.range) and x.lines and [t for t, _, _ in x.lines] != [t for t, _, _ in this.lines]:
                    sides.append((rank, path, at, x.lines))
            known: dict[int, tuple[str, int]] = {}
            for page_id, url, path in this.members:
                rank, _, at, lines = max(sides, key=lambda s: (len(os.path.commonprefix([path, s[1]])), -s[0]), default=(-1, None, None, None))
                if rank not in known:
                    known[rank] = main_text(this.lines, lines)
                text, n = known[rank]
                yield page_id, url, text, len(text), at, n

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [id_type, pa.string(), pa.string(), pa.int64(), id_type, pa.int32()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            out.clear()
            return made

        id_type = pa.int64()
        before = this = None
        for b in batches:
            id_type = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this and this.fits(row):
                    this.add(row)
                    continue
                following = Run(row)
                if this:
                    for x in done(before, this, following):
                        out.append(x)
                        if len(out) >= 500:
                            yield batch()
                before, this = this, following
        if this:
            for x in done(before, this, None):
                out.append(x)
                if len(out) >= 500:
                    yield batch()
        if out:
            yield batch()

    return rows.select("page_id", "url", "html", "host", "path", "hx", "range", "own").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, paired_with {kind}, shared_lines int")
