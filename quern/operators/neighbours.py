"""A graph of nearest neighbours: cells first, then neighbour descent; degree bounded, recall measured.

Nodes are dealt to cells, the lists of a k-means fitted on at most ``SAMPLE`` of them, and every node
is compared with the nodes of the cells nearest to it.  How many cells that takes depends on the vectors, so the search
measures itself: ``probes`` nodes, drawn by hash, have their exact lists, one scan of the vectors, and as many cells
are taken as hold the share ``recall`` of those, at most ``cells``.  A vector travels once for each cell that its node
asks, and some times for its own, so what is shuffled is some hundred bytes a node and cell; a cell of very many nodes, or that very
many ask, is cut into blocks of bounded size.

Where ``cells`` hold less, rounds of descent follow.  A round gathers, at each node, the vectors of its neighbours and of at
most ``reverse`` nodes that chose it, compares them with each other, and keeps for every node the best
``width`` it has seen; pairs that would not enter a node's list stay in the task.  So a
round costs (width + reverse) vectors and (width + reverse)^2 products a node,
whatever the number of nodes; a node that very many others chose takes ``reverse``
of them, drawn by hash.  Rounds go on until the graph has the share ``recall``; where less
than ``still`` of the edges change, or after ``rounds`` of one width, the lists are widened by half.
The graph is approximate; callers measure its recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, Window, functions as F

from .ivfpq import ROUNDS, SAMPLE, kmeans
from .lineage import cut
from .vector import PRODUCT, knn_batch, table, unit

Batches = Iterator[pa.RecordBatch]
#: Cells that nodes are dealt to, and least and most nodes of one; as many nodes that ask it meet it in one block.
CELLS, LEAST, MOST = 12, 8192, 65_536


def _best(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _vectors(v: pa.Array, real: str) -> np.ndarray:
    """Bytes of numbers of type ``real`` as vectors at length 1, a row each."""
    flat = np.frombuffer(b"".join(v.to_pylist()), real).astype(np.float64)
    return unit(flat.reshape(len(v), -1) if len(v) else np.empty((0, 0)))


def _far(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(node, cell): squared distances less those of the nodes from 0."""
    return x @ (-2 * centroids.T) + (centroids**2).sum(1)


def _asked(x: np.ndarray, centroids: np.ndarray, cells: int) -> np.ndarray:
    """(node, i): its nearest ``cells`` cells, in any order."""
    return np.argpartition(_far(x, centroids), cells - 1, axis=1)[:, :cells]


def _times(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i ``n[i]`` times, and which of them each is."""
    who = np.repeat(np.arange(len(n)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


def _meet_in_cells(listed: DataFrame, centroids: np.ndarray, cells: int, block: int, k: int, kind: str, real: str) -> DataFrame:
    """(src, dst, sim): each node's best ``k`` in each block of its nearest ``cells`` cells, from (id, v, cell, h) with a hash ``h`` of the id."""
    spark, n_cells = listed.sparkSession, len(centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def count(batches: Batches) -> Batches:
        n = np.zeros((2, n_cells), np.int64)
        for b in batches:
            if b.num_rows:
                n[0] += np.bincount(b.column(1).to_numpy(), minlength=n_cells)
                n[1] += np.bincount(_asked(_vectors(b.column(0), real), sent.value, cells).ravel(), minlength=n_cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_cells)), pa.array(n[0]), pa.array(n[1])], ["cell", "own", "asking"])

    n = listed.select("v", "cell").mapInArrow(count, "cell long, own long, asking long").groupBy("cell").agg(F.sum("own"), F.sum("asking")).orderBy("cell").toArrow()  # a row a cell
    parts, turns = (-(-n.column(i).to_numpy() // block) for i in (1, 2))
    first = np.cumsum(parts * turns) - parts * turns  # a block is a part of a cell and a part of those that ask it

    def deal(batches: Batches) -> Batches:
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                own, h = b.column(2).to_numpy(), b.column(3).to_numpy()
                who, turn = _times(turns[own])
                at = own[who]
                place = first[at] + h[who] % parts[at] * turns[at] + turn
                asked = _asked(_vectors(b.column(1), real), sent.value, cells)
                asks, part = _times(parts[asked.ravel()])
                at, asks = asked.ravel()[asks], asks // cells
                place = np.concatenate((place, first[at] + part * turns[at] + (h[asks] >> 24) % turns[at]))
                rows = pa.array(np.concatenate((who, asks)))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.arange(len(rows)) >= len(who)), b.column(0).take(rows), b.column(1).take(rows)], ["block", "asks", "id", "v"])

    def meet(ids: pa.Array, x: np.ndarray, asking: pa.Array, q: np.ndarray) -> Batches:
        step = max(1, PRODUCT * LEAST // max(len(x), LEAST))  # products of bounded size
        for start in range(0, len(q), step):
            s = q[start : start + step] @ x.T
            least = np.partition(s, len(x) - k - 1, axis=1)[:, len(x) - k - 1] if k + 1 < len(x) else np.full(len(s), -np.inf)  # one more: a node meets itself
            who, at = np.nonzero(s >= least[:, None] - 2e-9)
            sim = np.round(s[who, at], 9)
            order = np.lexsort((at, -sim, who))  # members are in the order of their ids
            _, place = _times(np.bincount(who, minlength=len(s)))
            order = order[place <= k]
            yield pa.RecordBatch.from_arrays([asking.take(pa.array(who[order] + start)), ids.take(pa.array(at[order])), pa.array(sim[order])], ["src", "dst", "sim"])

    def compare(batches: Batches) -> Batches:
        met, ids, x = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() * 2 + b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if met != key[i] // 2:
                    met, ids, x = key[i] // 2, [], []
                some, v = b.column(2).slice(i, j - i), _vectors(b.column(3).slice(i, j - i), real)
                if key[i] % 2 == 0:
                    ids.append(some)
                    x.append(v)
                elif ids:
                    ids, x = [pa.concat_arrays(ids)], [np.concatenate(x)]
                    yield from meet(ids[0], x[0], some, v)

    dealt = listed.select("id", "v", "cell", "h").mapInArrow(deal, f"block long, asks boolean, id {kind}, v binary")
    tasks = min(int((parts * turns).sum()), int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work: not put together by size
    dealt = dealt.repartition(max(tasks, 1), "block").sortWithinPartitions("block", "asks", "id")
    return dealt.mapInArrow(compare, f"src {kind}, dst {kind}, sim double").where("src <> dst")


def _compare(members: DataFrame, k: int, kind: str, real: str) -> DataFrame:
    """(src, dst, sim): each node's best ``k`` among those that meet it at a hub and reach its ``least``.

    ``members`` is (hub, id, v, least) with v as bytes.
    """

    def run(batches: Batches) -> Batches:
        def meet(b: pa.RecordBatch, bounds: np.ndarray) -> pa.RecordBatch:
            x = _vectors(b.column(2), real)
            least, parts = b.column(3).to_numpy(), []
            for i, j in zip(bounds[:-1], bounds[1:]):
                s = np.round(x[i:j] @ x[i:j].T, 9)
                np.fill_diagonal(s, -np.inf)
                if k < j - i - 1:
                    low = np.maximum(np.partition(s, j - i - k, axis=1)[:, j - i - k], least[i:j])
                else:
                    low = least[i:j]
                a, c = np.nonzero((s >= low[:, None]) & (s > -np.inf))
                parts.append((a + i, c + i, s[a, c]))
            a, c, sim = (np.concatenate(p) for p in zip(*parts))
            ids = b.column(1)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(c)), pa.array(sim)], ["src", "dst", "sim"])

        rest = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            hub = b.column(0)
            cuts = np.flatnonzero(pa.compute.not_equal(hub[1:], hub[:-1]).to_numpy(zero_copy_only=False)) + 1
            if len(cuts):
                yield meet(b.slice(0, cuts[-1]), np.concatenate(([0], cuts)))
            rest = b.slice(cuts[-1]) if len(cuts) else b
        if rest is not None:
            yield meet(rest, np.array([0, rest.num_rows]))

    return members.repartition("hub").sortWithinPartitions("hub").select("hub", "id", "v", "least").mapInArrow(run, f"src {kind}, dst {kind}, sim double")


def knn_graph(
    vectors: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rounds: int = 6,
    width: int | None = None,
    reverse: int = 25,
    still: float = 0.02,
    seed: int = 7,
    recall: float = 0.93,
    probes: int = 500,
    cell: int | None = None,
    cells: int = 64,
) -> DataFrame:
    """(src, dst, sim): about the ``k`` most similar nodes of each, by cosine; ids are unique, vectors without length are left out.

    ``width`` is the length of the lists that descent begins with, ``k`` + 15 if not given.  ``cell`` is about
    the number of nodes of a cell, a twelfth of all from ``LEAST`` to ``MOST`` if not given.
    """
    most, k = k, width or k + 15
    kind = vectors.schema[id_col].dataType.simpleString()
    real = "f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "f8"

    def long(batches: Batches) -> Batches:
        for b in batches:
            m = table(b.column(1))
            keep = np.linalg.norm(unit(m), axis=1) > 0.5 if m.size else np.zeros(len(m), bool)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array([r.tobytes() for r in m[keep].astype(real)], pa.binary())], ["id", "v"])

    given = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    rows = given.mapInArrow(long, f"id {kind}, v binary").withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 48)))
    n = rows.count()
    drawn = rows.where(F.col("h") <= (1 << 48) * 2 * SAMPLE // max(n, 1)).orderBy("h", "id")  # some twice as many as are taken
    x = _vectors(drawn.select("v").limit(SAMPLE).toArrow().column("v").combine_chunks(), real)  # a documented bound
    cell = cell or min(max(-(-n // CELLS), LEAST), MOST)
    centroids = kmeans(x, min(-(-n // cell), len(x)), ROUNDS, np.random.default_rng(seed)) if n else np.zeros((1, 0))

    def nearest(batches: Batches) -> Batches:
        for b in batches:
            own = _far(_vectors(b.column(1), real), centroids).argmin(1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32())], ["id", "v", "h", "cell"])

    listed = cut(rows.mapInArrow(nearest, f"id {kind}, v binary, h long, cell int"))
    v = listed.select("id", "v")
    drawn = cut(drawn.limit(probes))  # for the recall only; every node is searched
    asked = given.join(F.broadcast(drawn.select("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    sought = knn_batch(given, asked, most + 1, "id", "v", places=9).where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "rank")
    sought = cut(sought.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).where(F.col("rank") <= most).drop("rank"))

    def found(best: DataFrame) -> float:
        near = _best(best.join(F.broadcast(sought.select("src").distinct()), "src", "left_semi"), most).select("src", "dst", F.lit(1).alias("found"))
        return sought.join(near, ["src", "dst"], "left").agg(F.coalesce(F.try_divide(F.count("found"), F.count(F.lit(1))), F.lit(1.0))).head()[0]

    # Of each neighbour sought, how many cells of its node come before the one that holds it.
    held = listed.join(F.broadcast(sought.select(F.col("dst").alias("id"), "src")), "id").join(F.broadcast(drawn.select(F.col("id").alias("src"), F.col("v").alias("q"))), "src").select("q", "cell").toArrow()  # a row a neighbour sought
    if held.num_rows:
        far = _far(_vectors(held.column("q").combine_chunks(), real), centroids)
        before = np.sort((far < far[np.arange(len(far)), held.column("cell").to_numpy()][:, None]).sum(1))
        need = 1 + int(before[max(int(np.ceil(recall * len(before))), 1) - 1])
    else:
        need = 1
    first = most if need <= cells else k  # descent follows only where the cells do not do
    best = cut(_best(_meet_in_cells(listed, centroids, min(need, cells, len(centroids)), cell, first, kind, real), first))
    selves = v.select(F.col("id").alias("hub"), "id")
    turn = tries = 0
    while found(best) < recall:
        draw = Window.partitionBy("hub").orderBy(F.xxhash64("id", F.lit(turn)), "id")
        back = best.select(F.col("dst").alias("hub"), F.col("src").alias("id")).withColumn("r", F.row_number().over(draw)).where(F.col("r") <= reverse).drop("r")
        own = best.select(F.col("src").alias("hub"), F.col("dst").alias("id"))
        least = best.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(float("-inf")).alias("least"))
        members = own.unionByName(back).unionByName(selves).distinct().join(v.join(least, "id", "left").fillna(float("-inf"), ["least"]), "id")
        seen = _compare(members, k, kind, real).unionByName(best).repartition("src").dropDuplicates(["src", "dst"])  # one shuffle for both
        new = cut(_best(seen, k))
        changed = new.join(best.select("src", "dst"), ["src", "dst"], "left_anti").count()
        best, turn, tries = new, turn + 1, tries + 1
        if changed < still * max(best.count(), 1) or tries == rounds:
            if k >= n:
                break
            k, reverse, tries = min(-(-k * 3 // 2), n), -(-reverse * 3 // 2), 0
    return _best(best, most)
