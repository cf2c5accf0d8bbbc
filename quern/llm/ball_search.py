"""Ranked lexical search by an exact sparse ball-tree inner-product search.

Score of a document for an item: the sum over the item's terms, once each, of
w * ((SCALE * tf) div (1000 * tf + 20 * m)), in 64-bit integers; so it is the inner
product of the item's 0/1 vector with the document's vector y of these summands.

1. One pass over the texts keeps, for each document, its number of terms and the
   term numbers and frequencies of the items' terms; these rows are written to the
   shared folder, since N, L and df have to be known before a score is.
2. A task reads such rows and builds a ball tree of every ``TREE_DOCS`` of them: a
   node is split at the median of the distances to two far documents.  A node has
   its centroid c, the terms that occur in it, and for each band of terms of like
   frequency the radius r, the largest distance of a document to c inside the band.
3. A document x of a node scores at most <q, c> + sum over bands of r * sqrt(number of
   the item's terms in the band that occur in the node).  Floating-point bounds are
   raised by more than their rounding can lose.  Nodes are taken best-first; a
   subtree is left out if its bound is below the item's ``k``-th score so far.  Equal
   bounds are searched, as ties go by id.
4. At a leaf scores are integers and exact.  A task keeps ``k`` documents an item from
   tree to tree, so later trees are pruned by what earlier ones gave.

Items are searched in blocks whose text is at most ``BLOCK_CHARS`` on average; the
terms of a block are what is broadcast.  Terms are runs without ASCII characters
other than letters and digits, A-Z lower-cased.  Null and empty texts have none.
Rows that share an item id are one item with the terms of all of them; repeated
documents are ranked row by row; a null document id sorts last and must not meet
2**63 - 1.  An empty table on either side gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_folder

SCALE = 1_000_000_000
TREE_DOCS = 4096
LEAF_DOCS = 32
TREE_CELLS = 24_000_000  # most (node, term) cells of a tree, which bounds its memory
BLOCK_CHARS = 1_000_000
LAST_ID = np.iinfo(np.int64).max
Batches = Iterator[pa.RecordBatch]

#: ASCII letters and digits (A-Z lower-cased) and bytes of other characters as they are, else a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


# ------------------------------------------------------------------ documents

def document_rows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, term, tf): terms of a document and, packed as 32-bit integers, which of ``vocabulary`` and how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        get, size = known.value.get, len(known.value)
        for b in batches:
            n, term, tf = [], [], []
            for text in b.column(1):
                words = terms(text.as_py())
                own = np.fromiter(map(get, words, repeat(size)), np.int32, len(words))
                found, count = np.unique(own, return_counts=True)
                keep = slice(0, -1 if len(found) and found[-1] == size else None)
                n.append(len(words))
                term.append(found[keep].tobytes())
                tf.append(count[keep].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; a task sends one number a term."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


# ------------------------------------------------------------------ the tree

class BallTree:
    """Balls over the rows of a sparse matrix: ``at`` are the rows' bounds in ``term`` and ``value``."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, band: np.ndarray, leaf_docs: int = LEAF_DOCS):
        self.at, self.term, self.value, self.band, self.leaf_docs = at, term, value, band, leaf_docs
        self.centre: list[np.ndarray] = []
        self.has: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.docs: list[np.ndarray] = []
        self._build(np.arange(len(at) - 1))
        self.centre, self.has, self.radius = np.array(self.centre), np.array(self.has), np.array(self.radius)

    def cells(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' entries and which document of ``docs`` each belongs to."""
        n = self.at[docs + 1] - self.at[docs]
        own = np.repeat(np.arange(len(docs)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.at[docs][own], own

    def _far(self, cell: np.ndarray, own: np.ndarray, size: int, point: np.ndarray) -> np.ndarray:
        """Squared distances to ``point``, but for the same constant."""
        v = self.value[cell]
        return np.bincount(own, v * (v - 2 * point[self.term[cell]]), size)

    def _build(self, docs: np.ndarray) -> int:
        node, size = len(self.kids), len(self.band)
        cell, own = self.cells(docs)
        t, v = self.term[cell], self.value[cell]
        centre = np.bincount(t, v, size) / len(docs)
        bands = int(self.band.max(initial=0)) + 1
        # Inside a band |x - c|^2 = |c|^2 + sum over x's terms of (v - c)^2 - c^2.
        inside = np.bincount(own * bands + self.band[t], (v - centre[t]) ** 2 - centre[t] ** 2, len(docs) * bands).reshape(-1, bands)
        whole = np.bincount(self.band, centre**2, bands)
        # What the subtraction may have lost is far below this share of the sums that went into it.
        slack = 1e-9 * (np.bincount(own * bands + self.band[t], v**2, len(docs) * bands).reshape(-1, bands) + whole)
        self.radius.append(np.sqrt(np.maximum(inside + whole + slack, 0).max(0)))
        has = np.zeros(size, bool)
        has[t] = True
        self.centre.append(centre)
        self.has.append(has)
        self.kids.append(None)
        self.docs.append(docs)
        if len(docs) > self.leaf_docs:
            point = np.zeros(size)
            ends = []
            for start in (centre, None):
                far = self._far(cell, own, len(docs), start if start is not None else point)
                pick = int(far.argmax())
                point = np.zeros(size)
                mine = self.at[docs[pick]], self.at[docs[pick] + 1]
                point[self.term[mine[0] : mine[1]]] = self.value[mine[0] : mine[1]]
                ends.append(self._far(cell, own, len(docs), point))
            order = np.argsort(ends[0] - ends[1], kind="stable")
            half = len(docs) // 2
            self.kids[node] = (self._build(docs[order[:half]]), self._build(docs[order[half:]]))
        return node

    def bounds(self, item: np.ndarray) -> np.ndarray:
        """For each node at least the greatest inner product with ``item`` (term numbers) below it."""
        centre = self.centre[:, item].sum(1)
        spread = np.zeros(len(centre))
        has = self.has[:, item]
        for g in np.unique(self.band[item]):
            spread += self.radius[:, g] * np.sqrt(has[:, self.band[item] == g].sum(1))
        return (centre + spread) * (1 + 1e-9) + 1


def search(tree: BallTree, ids: np.ndarray, whole: np.ndarray, item: np.ndarray, k: int, score: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(score, doc) of the best ``k``, best first, after what was best before; and the number of leaves scored."""
    if not len(item):
        return score, doc, 0
    bound = tree.bounds(item)
    asked = np.zeros(len(tree.band), np.int64)
    asked[item] = 1
    heap, leaves = [(-bound[0], 0)], 0
    while heap:
        top, node = heapq.heappop(heap)
        if len(score) >= k and -top < score[-1]:
            break  # every other bound is as low or lower
        if tree.kids[node]:
            for kid in tree.kids[node]:
                heapq.heappush(heap, (max(top, -bound[kid]), kid))
            continue
        leaves += 1
        docs = tree.docs[node]
        cell, own = tree.cells(docs)
        hit = asked[tree.term[cell]] > 0
        got = np.zeros(len(docs), np.int64)
        np.add.at(got, own[hit], whole[cell[hit]])
        good = got > 0 if len(score) < k else got >= score[-1]
        if good.any():
            score, doc = np.append(score, got[good]), np.append(doc, ids[docs[good]])
            best = np.lexsort((doc, -score))[:k]
            score, doc = score[best], doc[best]
    return score, doc, leaves


# ------------------------------------------------------------------ the operator

def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def top_of_block(rows: DataFrame, items: list[np.ndarray], size: int, k: int, tree_docs: int, leaf_docs: int) -> DataFrame:
    """(item, doc_id, score, leaves, all_leaves): each task's best of each item of a block; ``item`` is its number."""
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = document_counts(rows, size)
    given = rows.sparkSession.sparkContext.broadcast((items, weights(total.n, df), np.log2(df + 1).astype(np.int64)))
    n_docs, length = total.n, max(total.l, 1)
    most = max(min(tree_docs, TREE_CELLS // max(size, 1) * leaf_docs // 4), leaf_docs)

    def run(batches: Batches) -> Batches:
        items, weight, band = given.value
        score = [np.empty(0, np.int64) for _ in items]
        doc = [np.empty(0, np.int64) for _ in items]
        done = np.zeros(len(items), np.int64)
        all_leaves = 0

        def one(ids: list, n: list, term: list[bytes], tf: list[bytes]) -> int:
            sizes = np.array([len(t) // 4 for t in term], np.int64)
            term_at, f = np.frombuffer(b"".join(term), np.int32).astype(np.int64), np.frombuffer(b"".join(tf), np.int32).astype(np.int64)
            m = 100 - 50 + (50 * np.array(n, np.int64) * n_docs) // length
            whole = weight[term_at] * ((SCALE * f) // (1000 * f + 20 * np.repeat(m, sizes)))
            tree = BallTree(np.append(0, np.cumsum(sizes)), term_at, whole.astype(np.float64), band, leaf_docs)
            own = np.array([LAST_ID if i is None else i for i in ids], np.int64)
            for i, item in enumerate(items):
                score[i], doc[i], leaves = search(tree, own, whole, item, k, score[i], doc[i])
                done[i] += leaves
            return sum(x is None for x in tree.kids)

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[2]:
                    held.append(row)
                if len(held) >= most:
                    all_leaves += one(*zip(*held, strict=True))
                    held = []
        if held:
            all_leaves += one(*zip(*held, strict=True))
        for i in range(len(items)):
            ids = pa.array(doc[i], pa.int64(), mask=doc[i] == LAST_ID)
            same = lambda v, m=len(doc[i]): pa.array(np.full(m, v), pa.int64())
            yield pa.RecordBatch.from_arrays([same(i), ids, pa.array(score[i], pa.int64()), same(done[i]), same(all_leaves)], ["item", "doc_id", "score", "leaves", "all_leaves"])

    return rows.select("doc_id", "n", "term", "tf").mapInArrow(run, "item long, doc_id long, score long, leaves long, all_leaves long")


def item_blocks(items: DataFrame, item_id: str, text_col: str, block_chars: int) -> Iterator[tuple[list, list[set[bytes]]]]:
    """(ids, terms) of the items, block by block; a block is what the driver and a broadcast hold at a time."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first().c
    blocks = -(-chars // block_chars)
    for b in range(blocks):
        own: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():
            own.setdefault(r.item_id, set()).update(terms((r.text or "").encode("utf-8", "replace")))
        yield list(own), list(own.values())


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tree_docs: int = TREE_DOCS, leaf_docs: int = LEAF_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The best ``k`` documents of each item: item_id, rank, doc_id, score; ``leaves`` of ``all_leaves`` were scored for the item."""
    spark: SparkSession = docs.sparkSession
    kind, id_kind = items.schema[item_id].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {id_kind}, score long, leaves long, all_leaves long")
    for ids, sets in item_blocks(items, item_id, item_text, block_chars):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        if not vocabulary:
            continue
        path = shared_folder(spark, "ball-search")
        document_rows(docs, vocabulary, id_col, text_col).write.parquet(path)
        numbers = [np.array(sorted(vocabulary[t] for t in s), np.int64) for s in sets]
        found = top_of_block(spark.read.parquet(path), numbers, len(vocabulary), k, tree_docs, leaf_docs)
        # k rows of each task and item; Spark cuts them to k a partition again before the shuffle.
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")  # of one block
        out = out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc_id").cast(id_kind).alias("doc_id"), "score", "leaves", "all_leaves"))
    return out
