"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What ingest extracts from texts.
FIELDS = {
    "emails": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", ", "),
    "phones": (r"(?:\+91[ \t-]?)?(?:[0-9][ \t-]?){10}", ", "),
    "pan": (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", ", "),
    "gstin": (r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9]Z[A-Z0-9]\b", ", "),
    "amounts": (r"(?:Rs\.?|INR|₹)[ \t]*[0-9,]+(?:\.[0-9]{1,2})?", "; "),
    "dates": (r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b", ", "),
}
INVOICE = r"(?i)(?:invoice|inv|bill)[ \t.#:_-]*(?:no\.?|number)?[ \t.#:_-]*([A-Z0-9/-]+)"


def extracted_fields(text: Column) -> dict[str, Column]:
    """One column per field; null when the text has none."""
    out = {}
    for name, (pattern, sep) in FIELDS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if name == "phones":
            found = F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[^0-9+]", "")), lambda p: F.length(p) >= 10)
        out[name] = F.when(F.size(found) > 0, F.array_join(found, sep))
    out["invoice_no"] = F.nullif(F.regexp_extract(text, INVOICE, 1), F.lit(""))
    return out


def field_suffix(fields: dict[str, Column]) -> Column:
    """'Label: value' parts joined by ' | '."""
    return F.concat_ws(" | ", *(F.when(v.isNotNull(), F.concat(F.lit(f"{k.capitalize()}: "), v)) for k, v in fields.items()))


def sentences(text: Column) -> Column:
    """Lines when there are more than 3, else cuts after . ! ? before a capital or a digit."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(F.split(text, "\n")) > 3) & (F.size(lines) >= 3), lines).otherwise(F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: F.trim(x) != ""))


def sentence_scores(sents: Column, terms: Column) -> Column:
    """Score of each sentence: matched terms, density, place, key-value form and structure."""
    n = F.size(sents)

    def one(s: Column, i: Column) -> Column:
        low = F.lower(s)
        hit = F.size(F.filter(terms, lambda t: low.contains(t)))
        ws = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
        place = F.when((i == 0) | (i == n - 1), 0.1).when(i <= 2, 0.05).otherwise(0.0)
        kv = F.when(s.contains(":") & (F.octet_length(s) < 200), 0.15).otherwise(0.0)
        kept = F.when(s.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]{4,}"), 0.35).otherwise(0.0)
        return 0.6 * hit / F.greatest(F.size(terms), F.lit(1)) + 0.15 * hit / F.greatest(ws, F.lit(1)) + place + kv + kept

    return F.transform(sents, one)


def query_terms(query: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: F.octet_length(w) > 2))


def compress(text: Column, query: Column, most: int) -> Column:
    """The ``most`` best sentences in their order, joined by spaces; short texts stay."""
    s = sentences(text)
    scored = F.arrays_zip(F.transform(sentence_scores(s, query_terms(query)), lambda x: -F.round(x, 9)).alias("o"), F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))).alias("i"))
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: x["i"]))
    return F.when(F.size(s) <= most, text).otherwise(F.array_join(F.transform(best, lambda i: F.get(s, i)), " "))


def garble_score(text: Column) -> Column:
    """Share of lines of 15 bytes or more with two five-space windows or three tabs; 0 below 3 lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(x) >= 15)
    wide = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(" {5,}"), F.lit(0)), F.lit(0), lambda a, r: a + F.length(r) - 4)
    bad = F.filter(lines, lambda x: (wide(x) >= 2) | (F.length(x) - F.length(F.replace(x, F.lit("\t"), F.lit(""))) >= 3))
    return F.when(F.size(lines) < 3, 0.0).otherwise(F.size(bad) / F.size(lines))


def similarity(a: Column, b: Column) -> Column:
    """1 equal, 0.9 prefix, 0.7 to 0.9 contained, else shared characters by the longer length."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    shorter = F.least(F.length(x), F.length(y))
    common = F.size(F.filter(F.split(x, ""), lambda c: (c != "") & y.contains(c)))
    return F.when(x == y, 1.0).when(x.startswith(y) | y.startswith(x), 0.9).when(x.contains(y) | y.contains(x), 0.7 + 0.2 * shorter / longer).otherwise(F.coalesce(common / longer, F.lit(0.0)))


def strip_bad_citations(text: Column, sources: Column) -> Column:
    """Drop [N] where N is 0 or above the number of sources."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))
    bad = F.filter(cited, lambda n: n.cast("long").isNull() | (n.cast("long") == 0) | (n.cast("long") > sources))
    return F.aggregate(bad, text, lambda t, n: F.replace(t, F.concat(F.lit("["), n, F.lit("]")), F.lit("")))


def citations(text: Column) -> Column:
    """array<struct<path,line>>: file.ext:line, then file.ext alone."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_./-]+\.[A-Za-z]{1,5}(?::[0-9]+)?)"), F.lit(1)))
    files = F.filter(found, lambda x: x.rlike(r"\.(rs|py|js|ts|tsx|java|go|c|h|cpp|md|txt|json|toml|yaml|yml|pdf|docx|csv|html)(:[0-9]+)?$"))
    return F.transform(files, lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("path"), F.split_part(x, F.lit(":"), F.lit(2)).try_cast("int").alias("line")))


def bullets(text: Column) -> Column:
    """One bullet per sentence when the text has no list, table or heading of its own."""
    parts = F.filter(F.transform(F.split(text, r"[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    shaped = text.rlike(r"(?m)^\s*(?:[-*•#|]|\d+[.)])")
    return F.when(shaped | (F.size(parts) < 2), text).otherwise(F.array_join(F.transform(parts, lambda s: F.concat(F.lit("- "), s)), "\n"))


def markdown_table(text: Column) -> Column:
    """struct(headers, rows) of the pipe lines; rows of another width and separator lines go."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    plain = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")))
    return F.when(F.size(plain) >= 2, F.struct(F.get(plain, 0).alias("headers"), F.filter(F.slice(plain, 2, 10_000), lambda r: F.size(r) == F.size(F.get(plain, 0))).alias("rows")))


def line_diff(old: Column, new: Column) -> Column:
    """struct(changed, added, removed) of two texts, line by line."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    changed = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != y) & x.isNotNull() & y.isNotNull()), lambda c: c))
    return F.struct(changed.alias("changed"), F.greatest(F.size(b) - F.size(a), F.lit(0)).alias("added"), F.greatest(F.size(a) - F.size(b), F.lit(0)).alias("removed"))


def placeholders(text: Column) -> Column:
    """Dates, then names, then numbers replaced by masks."""
    text = F.regexp_replace(text, r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b", "[DATE]")
    text = F.regexp_replace(text, r"[A-Z][a-z]+ [A-Z][a-z]+", "[NAME]")
    return F.regexp_replace(text, r"\d+", "[NUMBER]")


def template_variables(text: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\{\{\s*(\w+)\s*\}\}"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\[([A-Z_]{2,})\]"), F.lit(1))))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_id(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"))


def cell(x: Column) -> Column:
    """Whole numbers without a fraction, others at four places without trailing zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", ""))


def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def unresolved(text: Column) -> Column:
    low = F.lower(text)
    return text.contains("?") | low.contains("todo") | low.contains("to do")


def has_numeric_table(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|"))
    return (F.size(lines) > 2) & F.exists(F.slice(lines, 3, 10_000), lambda x: x.rlike(r"\|\s*[$₹€]?[0-9][0-9,.]*%?\s*\|"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(kept, F.transform(F.get(vectors, 0), lambda x: F.lit(0.0)), lambda a, x: F.zip_with(a, x["v"], lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
