"""N-gram Jaccard join with set-relation skipping.

Links documents whose sets of word shingles have a Jaccard similarity of at
least ``threshold`` and labels the connected components.  Exact, in these steps:

1. Sets that are equal are one class; only class representatives go on.
2. Extended prefix filter.  In hash order, two linked sets share the first
   l common elements within prefixes of n - ceil(t n) + l.  A set of whose prefix
   too few elements occur in another set is linked with nothing and leaves.
   Elements travel as packed arrays by hash bucket.  Elements that a map task
   sees in several sets are counted there and sent twice at most, so a line
   that a third of all documents share costs two entries per task.
3. Index lists.  What stays is ordered by document frequency (rare first); an
   element's list holds (set, size, position) for positions within the prefix.
4. Answers by relation.  Each set is compared with the leading set of its lists
   (least position).  A set that is linked to its leader takes the leader's label:
   that joins it to the leader's other members; which of them it is linked to is
   computed only for counts.
5. Lists are cut into blocks by label, position and size; pairs of blocks with
   the same label, or whose bounds on size and overlap fail, are skipped whole.
   Pairs of the other blocks pass the position bound and a parity-bitmap bound
   on the symmetric difference, and are then verified on the sets.

6. Links are counted where asked for, weighted by the rows of a class.  Those of
   two labels come from step 5.  Those of one label are derived from the centre of
   its sets: a set is described by what it lacks and has beside it, two small
   enough descriptions are linked for sure and are counted by a histogram, and for
   the rest the overlap follows from what the descriptions share, in blocks of
   sets that are separate rows.  No pair of a label is put out.

64-bit shingle hashes stand for shingles.  Null and empty texts have the empty
set, which is linked with nothing; fewer than ``k`` words make one shingle; very
long texts are read whole.  Rows that share an id are one node.  An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, once, row_key, without_rows
from .components import connected_components

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Most ids (8 bytes each) that are broadcast to fetch the texts of the sets that stay.
BROADCAST_ROWS = 500_000
SKETCH = 16  # 64-bit words of the parity bitmap
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ sets

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles.

    Words are what bytes.split leaves: runs without ASCII white space, with A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    s = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        s = _mix(s * _MUL + h[i : len(words) - size + 1 + i])
    return np.unique(s)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_overlap(n: int, t: Fraction) -> int:
    """Fewest elements that a set of n shares with any set it is linked to: ceil(t n)."""
    return -(-t.numerator * n // t.denominator)


def spare(n: int) -> int:
    """l: common elements asked for within the extended prefix; grows with n."""
    return 3 * n // 20 + 1


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def set_digests(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, d, d64) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            ds = [digest(s) for s in sets]
            d64 = np.array([int.from_bytes(d[:8], "little", signed=True) for d in ds], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ds, pa.binary()), pa.array(d64, pa.int64())], ["doc_id", "n", "d", "d64"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, d binary, d64 long")


# ------------------------------------------------------------------ step 2

def _prefix_entries(sets: list[np.ndarray], ids: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Elements of the extended prefixes and the ids of their sets."""
    cut_at = [len(s) - least_overlap(len(s), t) + spare(len(s)) if len(s) else 0 for s in sets]
    tokens = np.concatenate([s[:p] for s, p in zip(sets, cut_at, strict=True)] or [np.empty(0, np.uint64)])
    return tokens, np.repeat(ids, [min(p, len(s)) for s, p in zip(sets, cut_at, strict=True)])


def shared_counts(docs: DataFrame, k: int, t: Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d64, shared): elements of a set's extended prefix that also lie in another set's, or more."""
    buckets = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own: dict[int, np.ndarray] = {}
            for x in b.column(1).to_pylist():
                s = shingle_set(x, k)
                own.setdefault(int.from_bytes(digest(s)[:8], "little", signed=True), s)
            tokens, ids = _prefix_entries(list(own.values()), np.fromiter(own, np.int64, len(own)), t)
            if not len(tokens):
                continue
            order = np.argsort(tokens, kind="stable")
            tokens, ids = tokens[order], ids[order]
            first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            # Of a run, the first two entries travel; the rest are known to be shared.
            rest = ~first & ~np.concatenate(([False], first[:-1]))
            if rest.any():
                got, n = np.unique(ids[rest], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got % buckets, pa.int64()), pa.array(got, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(got), pa.binary())], ["bucket", "d64", "shared", "packed"])
            tokens, ids = tokens[~rest], ids[~rest]
            home = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            home, low, ids = home[order], (tokens[order] // np.uint64(buckets)).astype(np.uint32), ids[order]
            at = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True])))
            packed = [low[i:j].tobytes() + ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(home[at[:-1]], pa.int64()), pa.nulls(len(packed), pa.int64()), pa.nulls(len(packed), pa.int64()), pa.array(packed, pa.binary())], ["bucket", "d64", "shared", "packed"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            """One packed row a bucket of sets, so that rows do not grow with the number of tasks."""
            if not len(ids):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["bucket", "packed"])
            order = np.argsort(ids % buckets, kind="stable")
            ids, n = ids[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], np.diff(ids % buckets) != 0, [True])))
            packed = [ids[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(ids[at[:-1]] % buckets, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])

        def total(parts: list) -> tuple[np.ndarray, np.ndarray]:
            ids, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys, at = np.unique(ids, return_inverse=True)
            return keys, np.bincount(at, n, len(keys)).astype(np.int64)

        def settle(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            sizes = [len(p) // 12 for p in packed]
            low = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(packed, sizes, strict=True)])
            ids = np.concatenate([np.frombuffer(p, np.int64, n, 4 * n) for p, n in zip(packed, sizes, strict=True)])
            order = np.argsort(low, kind="stable")
            low, ids = low[order], ids[order]
            at = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
            mixed = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            return np.unique(ids[np.repeat(mixed, np.diff(np.append(at, len(low))))], return_counts=True)

        parts, bucket, held = [], None, []
        for b in batches:
            for h, d, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p is None:
                    parts.append((np.array([d]), np.array([n])))
                else:
                    if h != bucket and held:
                        parts.append(settle(held))
                        held = []
                    bucket = h
                    held.append(p)
            if sum(len(x[0]) for x in parts) > 2_000_000 or len(parts) > 20_000:
                parts = [total(parts)]
                if len(parts[0][0]) > 1_000_000:
                    yield batch(*parts.pop())
        if held:
            parts.append(settle(held))
        if parts:
            yield batch(*total(parts))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(p, np.int64).reshape(2, -1) for b in batches for p in b.column(1).to_pylist()]
        if parts:
            ids, n = np.concatenate(parts, 1)
            keys, at = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.bincount(at, n, len(keys)).astype(np.int64), pa.int64())], ["d64", "shared"])

    packed = _rows(docs, id_col, text_col).mapInArrow(spread, "bucket long, d64 long, shared long, packed binary")
    counts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "bucket long, packed binary")
    return counts.repartition("bucket").mapInArrow(add, "d64 long, shared long")


# ------------------------------------------------------------------ steps 3 to 5

def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, tokens, bits) of (doc_id, text); the id is the set's 64-bit digest, so rows of one set are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            bits = []
            for s in sets:
                cell = np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
                bits.append(np.packbits(cell.astype(np.uint8)).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([int.from_bytes(digest(s)[:8], "little", signed=True) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["id", "n", "tokens", "bits"]
            )

    return docs.mapInArrow(run, "id long, n long, tokens array<long>, bits array<long>")


def _enough(overlap: Column, na: Column, nb: Column, t: Fraction) -> Column:
    """overlap / (na + nb - overlap) >= t, in integers."""
    return overlap * (t.numerator + t.denominator) >= (na + nb) * t.numerator


def _links(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The (a, b) of ``pairs`` that are linked: parity bound first, then the sets."""
    side = lambda x, *c: sets.select(F.col("id").alias(x), *(F.col(n).alias(f"{n}_{x}") for n in c))
    near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.get("bits_a", F.lit(i)).bitwiseXOR(F.get("bits_b", F.lit(i))))
    size = F.col("n_a") + F.col("n_b")
    # The symmetric difference is at most (1 - t) / (1 + t) of the summed sizes.
    near = near.where(apart * (t.denominator + t.numerator) <= size * (t.denominator - t.numerator)).select("a", "b")
    both = near.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    return both.where(_enough(F.size(F.array_intersect("tokens_a", "tokens_b")), F.col("n_a"), F.col("n_b"), t)).select("a", "b")


def index_lists(sets: DataFrame, t: Fraction) -> DataFrame:
    """(token, id, n, pos) for elements in at least two sets, within the prefix of the rare-first order."""
    flat = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_set = flat.join(often, "token").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))  # bounded by the set
    # A repeated row repeats its elements; they lie side by side here (array_distinct compares structs pair by pair).
    per_set = per_set.select("id", "n", F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1) != x)).alias("own"))
    alone = F.col("n") - F.size("own")  # elements of no other set come first and have no list
    last = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator)
    take = F.greatest((last - alone + 1).cast("int"), F.lit(0))
    return per_set.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("own", F.lit(1), take)).alias("i", "x")).select(F.col("x.token").alias("token"), "id", "n", (F.col("alone") + F.col("i")).alias("pos"))


def _overlap_bound(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Most elements in common when the first common one lies at these positions."""
    return F.least(na - pa_, nb - pb)


def set_links(sets: DataFrame, t: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(a, b): links of ``sets`` (id, n, tokens, bits) that span the components of all links and hold all between two labels; (id, label) of sets linked to their leader."""
    lists = cut(index_lists(sets, t))
    leader = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "id")).alias("top"))
    votes = lists.join(leader, "token").where(F.col("id") != F.col("top.id")).where(_enough(_overlap_bound(F.col("n"), F.col("pos"), F.col("top.n"), F.col("top.pos")), F.col("n"), F.col("top.n"), t))
    votes = votes.groupBy("id", F.col("top.id").alias("lead")).agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy("id").agg(F.max(F.struct("v", F.col("lead").alias("b"))).alias("x")).select(F.col("id").alias("a"), F.col("x.b").alias("b"))
    stars = cut(_links(best, sets, t).distinct())

    label = stars.select(F.col("a").alias("id"), F.col("b").alias("label"))
    entries = lists.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")).withColumn("pb", F.floor(F.col("pos") / 8)).withColumn("nb", F.floor(F.log(F.col("n").cast("double")) * 8))
    key = ["token", "label", "pb", "nb"]
    block = entries.groupBy(*key).agg(F.min("pos").alias("p0"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    x, y = (block.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("label", "pb", "nb", "p0", "n0", "n1"))) for s in "xy")
    # Bounds for the best pair of two blocks: overlap below min(n1 - p0), sizes at least the smaller n0.
    fits = (F.col("label_x") < F.col("label_y")) & _enough(F.least(F.col("n1_x") - F.col("p0_x"), F.col("n1_y") - F.col("p0_y")), F.col("n0_x"), F.col("n0_y"), t)
    fits = fits & (F.col("n1_x") * t.denominator >= F.col("n0_y") * t.numerator) & (F.col("n1_y") * t.denominator >= F.col("n0_x") * t.numerator)
    meet = x.join(y, "token").where(fits).select("token", *(f"{c}_{s}" for s in "xy" for c in key[1:]))
    side = lambda s: entries.select("token", *(F.col(c).alias(f"{c}_{s}") for c in (*key[1:], "id", "n", "pos")))
    pairs = meet.join(side("x"), ["token", "label_x", "pb_x", "nb_x"]).join(side("y"), ["token", "label_y", "pb_y", "nb_y"])
    pairs = pairs.where(_enough(_overlap_bound(F.col("n_x"), F.col("pos_x"), F.col("n_y"), F.col("pos_y")), F.col("n_x"), F.col("n_y"), t))
    pairs = pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    return stars.unionByName(_links(cut(pairs), sets, t)), label


#: Sets of a block, on average, where pairs of a label are counted.
BLOCK = 256


def _deltas(members: DataFrame, t: Fraction) -> DataFrame:
    """(label, id, size, c, delta, k) of the sets of ``members`` (label, m, id, tokens, size) against their label's centre.

    The centre holds the elements of more than half of the label's sets; it has
    k of them and need not be a set itself.  A set that lacks r of them and has a
    others is described by those r + a, its delta.  Two sets whose deltas share s
    elements overlap in k - r1 - r2 + s, so with t = p / q they are linked where
    c1 + c2 - (p + q) s <= (q - p) k, c being q r + p a.
    """
    p, q = t.numerator, t.denominator
    own = members.select("label", "m", F.explode(F.array_distinct("tokens")).alias("x"))
    centre = own.groupBy("label", "m", "x").agg(F.count(F.lit(1)).alias("n")).where("2 * n > m").groupBy("label").agg(F.collect_list("x").alias("centre"))  # at most twice a set
    both = members.join(centre, "label", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<bigint>")))
    lacks, has = F.array_except("centre", "tokens"), F.array_except("tokens", "centre")
    both = both.select("label", "id", "size", F.size("centre").alias("k"), lacks.alias("lacks"), has.alias("has"))
    return both.select("label", "id", "size", (q * F.size("lacks") + p * F.size("has")).cast("long").alias("c"), F.concat("lacks", "has").alias("delta"), (F.col("k") * (q - p)).cast("long").alias("k"))


def _sure_counts(deltas: DataFrame) -> DataFrame:
    """(id, links): rows of sets that are linked whatever their deltas share, from a histogram of c a label."""
    hist = deltas.groupBy("label", "c").agg(F.sum("size").alias("rows")).groupBy("label").agg(F.collect_list(F.struct("c", "rows")).alias("hist"))  # as many as there are values of c, some times a set's size
    near = F.aggregate(F.filter("hist", lambda h: h["c"] + F.col("c") <= F.col("k")), F.lit(0).cast("long"), lambda acc, h: acc + h["rows"])
    own = F.when(2 * F.col("c") <= F.col("k"), F.col("size")).otherwise(0)
    return deltas.join(hist, "label").select("id", (near - own).alias("links"))


def _open_counts(deltas: DataFrame, t: Fraction) -> DataFrame:
    """(id, links): rows of linked sets whose link hangs on what the deltas share.

    Sets are dealt to blocks by label, quarter of c and hash; pairs of blocks
    that are sure or that cannot be open are skipped, each other pair is one row.
    """
    step = t.numerator + t.denominator
    part = F.when(F.col("k") > 0, F.least(F.floor(4 * F.col("c") / F.col("k")), F.lit(4))).otherwise(4).cast("int")
    rows = deltas.withColumn("part", part)
    sizes = rows.groupBy("label", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = rows.join(sizes, ["label", "part"]).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = rows.groupBy("label", "part", "at").agg(F.max("k").alias("k"), F.collect_list(F.struct("id", "size", "c", "delta")).alias("x"))  # some BLOCK sets
    field = lambda n: F.transform("x", lambda r: r[n])
    blocks = cut(packed.select("label", "part", "at", "k", field("id").alias("ids"), field("size").alias("sizes"), field("c").alias("cs"), F.transform("x", lambda r: F.size(r["delta"])).alias("lens"), F.flatten(field("delta")).alias("flat")))
    key = ["label", "part", "at"]
    x, y = (blocks.select("label", F.col("part").alias(f"part_{e}"), F.col("at").alias(f"at_{e}")) for e in "xy")
    meet = x.join(y, "label").where("(part_x < part_y OR part_x = part_y AND at_x <= at_y) AND part_x + part_y >= 3")
    side = lambda e: blocks.select(F.col("label").alias("label"), F.col("part").alias(f"part_{e}"), F.col("at").alias(f"at_{e}"), *(F.col(c).alias(f"{c}_{e}") for c in ("k", "ids", "sizes", "cs", "lens", "flat")))
    pairs = meet.join(side("x"), ["label", "part_x", "at_x"]).join(side("y"), ["label", "part_y", "at_y"])
    pairs = pairs.select(((F.col("part_x") == F.col("part_y")) & (F.col("at_x") == F.col("at_y"))).alias("same"), "k_x", *(f"{c}_{e}" for e in "xy" for c in ("ids", "sizes", "cs", "lens", "flat")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                same, k = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                ids_x, size_x, c_x, len_x, flat_x, ids_y, size_y, c_y, len_y, flat_y = (b.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(2, 12))
                token, at = np.unique(np.concatenate([flat_x, flat_y]), return_inverse=True)
                at_x, at_y = at[: len(flat_x)], at[len(flat_x) :]
                both = np.zeros((2, len(token)), bool)
                both[0, at_x], both[1, at_y] = True, True
                place = np.cumsum(both.all(0)) - 1  # elements of one side only are in no overlap
                width = int(place[-1]) + 1 if len(token) else 0

                def matrix(lens: np.ndarray, own: np.ndarray) -> np.ndarray:
                    m = np.zeros((len(lens), width), np.float32)
                    row, keep = np.repeat(np.arange(len(lens)), lens), both[:, own].all(0)
                    m[row[keep], place[own[keep]]] = 1
                    return m

                shared = (matrix(len_x, at_x) @ matrix(len_y, at_y).T).astype(np.int64)
                cost = c_x[:, None].astype(np.int64) + c_y[None].astype(np.int64)
                near = (cost > k) & (cost - step * shared <= k)
                if same:
                    np.fill_diagonal(near, False)
                out = [(ids_x, near @ size_y)] + ([] if same else [(ids_y, near.T @ size_x)])
                ids, links = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links.astype(np.int64), pa.int64())], ["id", "links"])

    return pairs.mapInArrow(count, "id long, links long")


def link_counts(sets: DataFrame, links: DataFrame, label: DataFrame, sizes: DataFrame, t: Fraction) -> DataFrame:
    """(id, links): rows of other sets that a set is linked to; ``sizes`` is (id, size), the rows of a set."""
    named = cut(sets.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("label", "id").alias("label")).join(sizes, "id"))
    shared = named.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = sets.select("id", "tokens").dropDuplicates(["id"]).join(named.join(shared, "label"), "id")
    deltas = cut(_deltas(members, t))
    side = lambda x: named.select(F.col("id").alias(x), F.col("label").alias(f"label_{x}"), F.col("size").alias(f"size_{x}"))
    across = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b").where("label_a <> label_b")
    ends = across.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("size_b").alias("links")), F.struct(F.col("b").alias("id"), F.col("size_a").alias("links")))).alias("x")).select("x.*")
    return _sure_counts(deltas).unionByName(_open_counts(deltas, t)).unionByName(ends).groupBy("id").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: Fraction = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS, count_links: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    With ``count_links`` also n_links, the number of other rows whose set is linked with the row's.
    """
    own = cut(set_digests(docs, k, id_col, text_col))
    classes = own.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("d64").alias("d64"), F.count(F.lit(1)).alias("size"))
    counts = shared_counts(docs, k, threshold, id_col, text_col)
    # Partners of a set of n have ceil(t n) elements or more, so this many are sure to be shared.
    sure = F.floor(F.ceil(F.col("n") * threshold.numerator / threshold.denominator) * 3 / 20) + 1
    stay = cut(classes.join(counts, "d64").where(F.col("shared") >= sure).select(F.col("rep").alias("doc_id")))
    ids = F.broadcast(stay) if stay.count() <= broadcast_rows else stay
    texts = _rows(docs, id_col, text_col).join(ids, "doc_id")
    sets = cut(_sets(texts, k))
    links, label = set_links(sets, threshold)
    links = cut(links)
    rep = lambda x: classes.select(F.col("d64").alias(x), F.col("rep").alias(f"rep_{x}"))
    edges = links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # Rows that share an id are one node, so the classes of its texts are joined.
    texts_of = own.where("n > 0").join(classes.select("d", "rep"), "d").groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    comp = connected_components(edges.unionByName(texts_of.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))))
    named = classes.join(comp, F.col("rep") == F.col("node"), "left").select("d", "d64", "size", F.coalesce("component", "rep").alias("component_id"))
    if count_links:
        named = named.join(link_counts(sets, links, label, classes.select(F.col("d64").alias("id"), "size"), threshold), F.col("d64") == F.col("id"), "left")
        named = named.select("d", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = own.join(named, "d", "left")
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    return out.select(*cols, F.coalesce("n_links", F.lit(0)).alias("n_links")) if count_links else out.select(*cols)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` per component, with their columns: the one with the smallest id (null ids last).

    Here a row is a node of its own: rows that share an id are joined only by
    their texts, so none goes for another one's.  Rows without words all stay.
    """
    own_id, own_text = row_key(id_col, text_col)
    row = F.struct(own_id.isNull().alias("none"), own_id.alias("k_id"), own_text.alias("k_text"))
    out = cut(jaccard_components(docs.select(row.alias("doc_id"), F.col(text_col).alias("text")), count_links=False, **options))
    gone = out.where("component_id <> doc_id").select("doc_id.k_id", "doc_id.k_text").distinct()
    again = out.where("component_id = doc_id AND n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id.k_id", "doc_id.k_text")
    return once(without_rows(docs, gone, id_col, text_col), again, id_col, text_col)
