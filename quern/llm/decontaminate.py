"""Benchmark decontamination by size-partitioned MinHash containment (native DataFrame operators only).

Items are short and documents long, so Jaccard estimates are useless; what is
asked for is the share of an item's word shingles that a document contains.

* Items are partitioned by their number of shingles n, in powers of two.  The
  sketch of an item is the bottom-k of its shingle hashes (a MinHash sketch) with
  k = floor((1 - threshold) * n) + 1.  A document with at least ``threshold`` of
  the shingles misses fewer than k of them, so it holds one of the sketch: the
  search loses nothing.
* A document is looked up only in the partitions that it is long enough for: it
  needs ``threshold`` times the shingles of the partition's smallest item.
  Documents that are too short for every partition are not exploded at all.
* Shingle hashes of documents are exploded next to the scan, for all lengths of
  shingles at once, and meet the sketch table in a broadcast join while it is
  small (its rows are counted first), or in a shuffled join beyond that.  Only
  matches survive.
* Candidate pairs are verified by exact containment of the shingle strings.

Words are runs of letters and digits, lower-cased, so punctuation and case do
not hide a leak.  An item with fewer than ``k`` words is one shingle of all its
words (found anywhere in a text by the shingle length of the item); an item or
text without words matches nothing.  Nulls count as empty; an empty table of
documents or items gives no pairs; very long texts are read whole; other
columns are ignored.  Rows that repeat an id are searched each for itself; the
pair list names the id once, with the best of its rows, and dropping works by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, let, row_key, without_rows

SHINGLE = 5
THRESHOLD = 0.8
#: Most sketch or pair rows (some 30 bytes each), and most bytes of shingles, that are broadcast.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column, k: int) -> Column:
    """Distinct shingles of exactly ``k`` words, as strings."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return let(ws, lambda w: F.when(F.size(w) >= k, F.array_distinct(each(w))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(hashes: Column, k: int) -> Column:
    """Distinct hashes of the shingles of ``k`` words, from the words' hashes."""
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
    return F.when(F.size(hashes) >= k, F.array_distinct(each(hashes))).otherwise(F.array().cast("array<bigint>"))


def sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """item_id, k (words of a shingle), size_class, n_shingles, item_shingles, sketch (hashes), of (item_id, text)."""
    own = items.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    own = own.withColumns({"k": F.least(F.size("_w"), F.lit(k)), "_h": F.transform("_w", lambda w: F.xxhash64(w))})

    def by_length(make) -> Column:
        out = make(k)
        for n in range(1, k):
            out = F.when(F.col("k") == n, make(n)).otherwise(out)
        return out

    own = own.withColumns({"_hashes": by_length(lambda n: shingle_hashes(F.col("_h"), n)), "item_shingles": by_length(lambda n: shingles(F.col("_w"), n))})
    n = F.size("_hashes")
    keep = F.when(F.col("k") < k, 1).otherwise((F.floor((1 - threshold) * n + 1e-9) + 1).cast("int"))
    return own.select(
        "item_id",
        "k",
        F.floor(F.log2(n)).cast("int").alias("size_class"),
        F.size("item_shingles").alias("n_shingles"),
        "item_shingles",
        F.slice(F.array_sort("_hashes"), F.lit(1), keep).alias("sketch"),
    )


def _search(docs: DataFrame, items: DataFrame, k: int, threshold: float, broadcast_rows: int) -> DataFrame:
    """Verified pairs (k_id, k_text, item_id, n_shared, n_shingles); docs is (k_id, k_text, text)."""
    index = cut(sketches(items, k, threshold))  # one small row per item; read several times below
    about = index.agg(
        F.sort_array(F.collect_set("k")).alias("lengths"),  # k values at most
        F.sum(F.size("sketch")).alias("rows"),
        F.sum(F.octet_length(F.array_join("item_shingles", ""))).alias("bytes"),
    ).head()
    lengths = about["lengths"] or [k]
    small = (about["rows"] or 0) <= broadcast_rows
    # The words that a document needs for a size class; fewer cannot hold enough of its smallest item.
    need = F.greatest(F.ceil(F.min("n_shingles") * threshold - 1e-9), F.lit(1)) + F.col("k") - 1
    classes = index.groupBy("k", "size_class").agg(need.cast("int").alias("need"))
    sketch = index.join(F.broadcast(classes), ["k", "size_class"]).select("item_id", "k", "need", F.explode("sketch").alias("_x"))  # classes: k times 31 rows at most
    least = classes.agg(F.coalesce(F.min("need"), F.lit(0)).alias("least")).head()["least"]
    side = F.broadcast(sketch) if small else sketch

    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    # One expression, so that a text's words are taken and hashed once.
    looked = let(hashes, lambda h: F.when(F.size(h) >= least, F.transform(F.concat(*(shingle_hashes(h, n) for n in lengths)), lambda x: F.struct(F.size(h).alias("n"), x.alias("x")))))
    found = docs.select("k_id", "k_text", F.explode(looked).alias("_l")).select("k_id", "k_text", F.col("_l.n").alias("n_words"), F.col("_l.x").alias("_x"))
    pairs = found.join(side, "_x").where("n_words >= need").select("k_id", "k_text", "item_id", "k").distinct()
    pairs = cut(pairs)
    few = pairs.count() <= broadcast_rows

    ids = pairs.select("k_id", "k_text", "k").distinct()
    texts = docs.alias("d").join((F.broadcast(ids) if few else ids).alias("i"), F.expr("d.k_id <=> i.k_id AND d.k_text = i.k_text"))
    own = F.array().cast("array<string>")
    for n in lengths:
        own = F.when(F.col("i.k") == n, shingles(words(F.col("d.text")), n)).otherwise(own)
    again = texts.select(F.col("i.k_id").alias("k_id"), F.col("i.k_text").alias("k_text"), F.col("i.k").alias("k"), own.alias("doc_shingles"))
    both = again.alias("t").join((F.broadcast(pairs) if few else pairs).alias("p"), F.expr("t.k_id <=> p.k_id AND t.k_text = p.k_text AND t.k = p.k")).select("p.k_id", "p.k_text", "p.item_id", "p.k", "doc_shingles")
    index = index.select("item_id", "k", "n_shingles", "item_shingles")
    light = small and (about["bytes"] or 0) <= BROADCAST_BYTES
    both = both.alias("b").join((F.broadcast(index) if light else index).alias("x"), F.expr("b.item_id <=> x.item_id AND b.k = x.k"))
    shared = F.size(F.array_intersect("doc_shingles", "item_shingles"))
    least_shared = F.when(F.col("b.k") < k, F.col("n_shingles")).otherwise(F.ceil(F.col("n_shingles") * threshold - 1e-9))
    checked = both.select("k_id", "k_text", F.col("b.item_id").alias("item_id"), shared.cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles"), least_shared.alias("least"))
    return checked.where("n_shared >= least").drop("least")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own_id, own_text = row_key(id_col, text_col)
    return docs.select(own_id.alias("k_id"), own_text.alias("k_text"), F.col(text_col).alias("text"))


def _items(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = SHINGLE,
    threshold: float = THRESHOLD,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of every pair at or above the threshold.

    Items of 1 to k - 1 words are searched with shingles of their own length.
    """
    pairs = _search(_keyed(docs, id_col, text_col), _items(items, item_col, item_text_col), k, threshold, broadcast_rows)
    best = pairs.groupBy(F.col("k_id").alias("doc_id"), "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shared").alias("n_shared"), F.col("m.n_shingles").alias("n_shingles"), (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns.

    A row goes for its own text: other rows with its id, or a null id, stay.
    """
    pairs = _search(_keyed(docs, id_col, text_col), _items(items, item_col, item_text_col), k, threshold, broadcast_rows)
    return without_rows(docs, pairs.select("k_id", "k_text").distinct(), id_col, text_col)
