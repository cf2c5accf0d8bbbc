"""Secret scan with multipart credential linking (native DataFrame operators only).

Base findings are regular-expression matches; their positions come from the
pieces between matches (``split``) and the matches (``regexp_extract_all``),
which run over the same leftmost, non-overlapping matches.  Weak parts (an
endpoint, a short login name, an unlabelled base64-like string) mean little
alone.  They are reported only when a complementary part lies in the same
document within ``reach`` code points: a weak secret needs an identifier or an
endpoint, an identifier or endpoint needs a secret.

The link is an interval join on (document, block of ``reach`` code points).  The
complementary side is first reduced to one row per block (first start, last
end), so each weak part meets three rows at most and never the pairs of its
scope.  Blocks of a scope are separate keys, so a very long text spreads.

A null or empty text has no finding and gives one row with zero counts; a very
long text is read whole, in time that grows little faster than its matches;
parts at equal distance are all reported; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, let

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
ENDPOINT = r"(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"
LOGIN = r"""(?i:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
KINDS = ("assign", "access", "hex", "endpoint", "login", "opaque")
REACH = 240


def _matches(text: Column, pattern: str, hint: str, keep) -> Column:
    """array<struct<s,e>> of the matches, in code points; keep(match) drops some."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), F.length).alias("g"))

    def state(at: Column) -> Column:
        return F.struct(at.alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    # Appending copies the array, so blocks of sqrt(n) matches are summed up one by one and then joined.
    def summed(seq: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(seq).cast("double"))).cast("int"), F.lit(1))

        def block(acc: Column, first: Column) -> Column:
            own = F.aggregate(F.slice(seq, first, size), state(acc["at"]), step)
            return let(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

        return F.when(F.size(seq) > 0, F.aggregate(F.sequence(F.lit(1), F.size(seq), size), state(F.lit(0)), block, lambda acc: acc["out"])).otherwise(empty)

    def spans(f: Column) -> Column:
        n = F.size(f["m"])
        pieces = F.zip_with(F.slice(f["g"], F.lit(1), n), F.transform(f["m"], F.length), lambda g, m: F.struct(F.coalesce(g, F.lit(0)).alias("g"), F.coalesce(m, F.lit(0)).alias("n")))
        out = let(pieces, summed)
        if keep is None:
            return out
        return F.transform(F.filter(F.zip_with(out, f["m"], lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: keep(x["m"])), lambda x: x["p"])

    return F.when(text.rlike(hint), let(found, spans)).otherwise(empty)


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _render(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def weak_links(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with a complementary part within ``reach``.

    ``parts`` has row_key, role ('id' or 'secret'), weak, k, s, e.  The
    complement of a role is the other role; distance is between nearest ends.
    """
    block = lambda c: F.floor(c / reach).cast("long")
    other = F.when(F.col("role") == "secret", "id").otherwise("secret")
    # A long part is entered in the blocks of both its ends.
    ends = parts.select("row_key", other.alias("need"), F.explode(F.array_distinct(F.array(block(F.col("s")), block(F.col("e"))))).alias("b"), "s", "e")
    index = ends.groupBy("row_key", "need", "b").agg(F.min("s").alias("first_s"), F.max("e").alias("last_e"))
    weak = parts.where("weak").select("row_key", "k", "s", "e", F.col("role").alias("need"))
    probe = weak.withColumn("b", F.explode(F.sequence(block(F.col("s")) - 1, block(F.col("e")) + 1)))
    hit = probe.join(index, ["row_key", "need", "b"]).where((F.col("first_s") <= F.col("e") + reach) & (F.col("last_e") >= F.col("s") - reach))
    return hit.groupBy("row_key", "k", "s", "e").agg(F.lit(1).alias("linked")).drop("linked")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, counts by base kind, base_sha256, spans.

    Rows that share a doc_id are scanned separately; their weak parts are
    linked within the union of their scopes, keyed by (doc_id, text digest).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = F.col("_t")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id",
        F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("_t").cast("string")).alias("row_key"),
        _matches(raw, ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6).alias("a"),
        _matches(raw, ACCESS, "AKIA", None).alias("c"),
        _matches(raw, HEX, "[0-9a-f]{24}", None).alias("h"),
        F.when(raw.contains("://"), _matches(raw, ENDPOINT, "://", None)).otherwise(F.array().cast("array<struct<s:int,e:int>>")).alias("p"),
        _matches(raw, LOGIN, r"(?i:user|login|client|account|access_?key)[A-Za-z_]{0,4}[\"']?\x20*[:=]", None).alias("l"),
        _matches(raw, OPAQUE, "[A-Za-z0-9+/]{32}", None).alias("o"),
    )
    strong = F.concat(_tagged(F.col("a"), 0), _tagged(F.col("c"), 1), _tagged(F.col("h"), 2))
    clear = lambda c: F.filter(c, lambda w: ~F.exists(F.concat("a", "c", "h"), lambda x: (x["s"] < w["e"]) & (w["s"] < x["e"])))
    weak = F.concat(_tagged(clear(F.col("p")), 3), _tagged(clear(F.col("l")), 4), _tagged(clear(F.col("o")), 5))
    found = base.select("doc_id", "row_key", F.size("a").alias("n_a"), F.size("c").alias("n_c"), F.size("h").alias("n_h"), strong.alias("strong"), weak.alias("weak_parts"))

    found = cut(found)  # a few numbers a document, so its text is searched once
    # Only documents with a weak part and a second part can link.
    some = found.where((F.size("weak_parts") > 0) & (F.size("weak_parts") + F.size("strong") > 1))
    parts = some.select("row_key", F.explode(F.concat("strong", "weak_parts")).alias("x")).distinct()
    parts = parts.select("row_key", F.when(F.col("x.k").isin(1, 3, 4), "id").otherwise("secret").alias("role"), (F.col("x.k") > 2).alias("weak"), "x.k", "x.s", "x.e")
    linked = weak_links(parts, reach).groupBy("row_key").agg(F.collect_list(F.struct("s", "k", "e")).alias("more"))

    out = found.join(linked, "row_key", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    return out.select(
        "doc_id",
        F.col("n_a").cast("long").alias("n_assign"),
        F.col("n_c").cast("long").alias("n_access"),
        F.col("n_h").cast("long").alias("n_hex"),
        F.sha2(F.encode(_render(F.col("strong")), "UTF-8"), 256).alias("base_sha256"),
        _render(F.concat("strong", F.coalesce("more", none))).alias("spans"),
    )
