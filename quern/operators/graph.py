"""Entity graphs as two DataFrames: nodes (name, entity_type, doc_ids) and edges (src, dst, relation, weight)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut


def entities(mentions: DataFrame) -> DataFrame:
    """Nodes from (name, entity_type, doc_id): documents gathered without repeats, the smallest type wins."""
    return mentions.groupBy("name").agg(F.min("entity_type").alias("entity_type"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist; parallel edges stay."""
    n = nodes.select("name")
    return edges.join(n.withColumnRenamed("name", "src"), "src", "left_semi").join(n.withColumnRenamed("name", "dst"), "dst", "left_semi")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, name, depth): nodes reached along out-edges in at most ``hops``, at their least depth.

    One equi-join a hop; nodes already reached leave the frontier.
    """
    e = cut(edges.select("src", "dst").distinct())
    seen = starts.select(F.col("name").alias("start"), "name", F.lit(0).alias("depth"))
    frontier = seen
    for h in range(1, hops + 1):
        new = frontier.join(e, F.col("name") == F.col("src")).select("start", F.col("dst").alias("name")).distinct()
        frontier = new.join(seen.select("start", "name"), ["start", "name"], "left_anti").withColumn("depth", F.lit(h))
        frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen


def related_documents(nodes: DataFrame, edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, doc_id, depth) of documents of the nodes within reach."""
    docs = nodes.select("name", F.explode("doc_ids").alias("doc_id"))
    return within_hops(edges, starts, hops).join(docs, "name").groupBy("start", "doc_id").agg(F.min("depth").alias("depth"))


def ordered_neighbours(rows: DataFrame, group: str, order: str, key: str, ahead: int) -> DataFrame:
    """(src, dst, src_at, dst_at): the next ``ahead`` rows of each row's group by (order, key), with both rows' ``order``.

    Rows are range-partitioned by (group, order, key), so one large group is spread over
    tasks; the first ``ahead`` rows of a part are lent to as many parts before it.
    """
    at = ["_g", "_o", "_k"]
    dealt = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(key).alias("_k")).where("_g IS NOT NULL")
    dealt = cut(dealt.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*at)
    heads = dealt.withColumn("_i", F.row_number().over(inside)).where(F.col("_i") <= ahead).drop("_i")
    lent = heads.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.lit(ahead)), lambda d: F.col("_p") - d))).where("_p >= 0")
    both = dealt.withColumn("_own", F.lit(True)).unionByName(lent.withColumn("_own", F.lit(False)))
    later = F.array(*(F.struct(F.lead("_g", d).over(inside).alias("g"), F.lead("_o", d).over(inside).alias("o"), F.lead("_k", d).over(inside).alias("k")) for d in range(1, ahead + 1)))
    out = both.withColumn("_later", later).where("_own").select("_g", "_k", "_o", F.explode("_later").alias("x"))
    return out.where(F.col("x.g") == F.col("_g")).select(F.col("_k").alias("src"), F.col("x.k").alias("dst"), F.col("_o").alias("src_at"), F.col("x.o").alias("dst_at"))


def next_in_group(rows: DataFrame, group: str, order: str, ahead: int, weight: float) -> DataFrame:
    """Edges from each row to the next ``ahead`` rows of its group."""
    return ordered_neighbours(rows, group, order, order, ahead).select("src", "dst", F.lit(weight).alias("weight"))


def spans(rows: DataFrame, groups: list[str], value: Column, key: str, reach: Decimal) -> DataFrame:
    """(key, place, first, last): each row's place in the order (groups, value, key), and those of the first and last of its group less than ``reach`` away.

    So every pair of near rows is known from one row each.  Keys are unique and values exact to nine
    decimals; rows without a group or value are left out.  Rows and both ends of their spans are
    range-partitioned and counted part by part, so one large group or value is spread over tasks.
    """
    at = [*(f"_g{i}" for i in range(len(groups))), "_v", "_t", "_k"]
    v = value.cast("decimal(28,9)")
    ends = F.array(*(F.struct(x.cast("decimal(38,9)").alias("v"), F.lit(t).alias("t")) for x, t in ((v + F.lit(reach), 0), (v, 1), (v - F.lit(reach), 2))))
    named = rows.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col(key).alias("_k"), F.explode(ends).alias("_e"))
    dealt = named.dropna(subset=at[: len(groups)]).where("_e.v IS NOT NULL").select(*at[: len(groups)], F.col("_e.v").alias("_v"), F.col("_e.t").alias("_t"), "_k")
    dealt = cut(dealt.repartitionByRange(*at).sortWithinPartitions(*at).withColumn("_p", F.spark_partition_id()))
    row = F.when(F.col("_t") == 1, 1).otherwise(0)
    parts = dealt.groupBy("_p").agg(F.sum(row).alias("_n"))  # a row a partition
    before = parts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("_p").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    counted = dealt.withColumn("_n", F.sum(row).over(inside)).join(F.broadcast(before), "_p").withColumn("_n", F.col("_n") + F.col("_b"))
    of = lambda t: F.max(F.when(F.col("_t") == t, F.col("_n")))
    return counted.groupBy(F.col("_k").alias(key)).agg(of(1).alias("place"), (of(2) + 1).alias("first"), of(0).alias("last"))


def similarity_edges(nodes: DataFrame, least: str = "0.5") -> DataFrame:
    """All edges of documents (id, directory, kind, language, score), one row a document.

    ``category`` (weight 0.8) and ``language`` (0.7) name nodes that the document leads to.  Every two
    documents of a ``directory`` are linked (0.8), ``n_same_directory`` of them to this one.  Two of one ``kind``
    in different directories (or none) whose similarity s = 1 - |difference of scores| is above ``least`` are linked (0.6 s):
    those are the documents with a ``place`` from ``first`` to ``last`` outside this directory, ``n_semantic`` of them.
    """
    text = lambda c: F.col(c).cast("string")
    node = lambda name, of: F.concat(F.lit(f"{name}-"), F.replace(text(of), F.lit(" "), F.lit("_")))
    reach, width = 1 - Decimal(least), F.col("last") - F.col("first") + 1
    home = spans(nodes, ["directory"], F.lit(0), "id", Decimal(1)).select("id", (width - 1).alias("n_same_directory"))
    own = spans(nodes, ["kind", "directory"], F.col("score"), "id", reach).select("id", width.alias("_own"))
    like = spans(nodes, ["kind"], F.col("score"), "id", reach)
    rows = nodes.join(home, "id", "left").join(like, "id", "left").join(own, "id", "left")
    semantic = F.coalesce(width - F.coalesce("_own", F.lit(1)), F.lit(0))
    return rows.select("id", node("topic", "kind").alias("category"), node("entity", "language").alias("language"), "directory", F.coalesce("n_same_directory", F.lit(0)).alias("n_same_directory"), "kind", F.col("score").cast("double").alias("score"), "place", "first", "last", semantic.alias("n_semantic"))


def levels(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """(step, level) of an acyclic plan: one more than the deepest step it needs.

    Levels settle from the roots; a cycle raises ValueError.  The loop runs once
    a level, each an equi-join of the steps still open.
    """
    steps, needs = cut(steps), cut(needs)
    done = cut(steps.join(needs.select("step").distinct(), "step", "left_anti").select("step", F.lit(0).alias("level")))
    total, count, level = steps.count(), done.count(), 0
    while count < total:
        level += 1
        blocked = needs.join(done.select(F.col("step").alias("need")), "need", "left_anti").select("step").distinct()
        ready = steps.select("step").join(done.select("step"), "step", "left_anti").join(blocked, "step", "left_anti").withColumn("level", F.lit(level))
        done = cut(done.unionByName(ready))
        new = done.count()
        if new == count:
            raise ValueError("the plan has a cycle")
        count = new
    return done


def plan_cost(steps: DataFrame, level: DataFrame) -> DataFrame:
    """One row: cost, serial and parallel duration, risk and its band."""
    per = steps.join(level, "step").groupBy("level").agg(F.sum("cost").alias("cost"), F.sum("duration").alias("serial"), F.max("duration").alias("parallel"), F.max("risk").alias("risk"))
    all_ = per.agg(F.sum("cost").alias("cost"), F.sum("serial").alias("serial"), F.sum("parallel").alias("parallel"), F.max("risk").alias("risk"))
    return all_.withColumn("band", F.when(F.col("risk") >= 0.8, "critical").when(F.col("risk") >= 0.6, "high").when(F.col("risk") >= 0.3, "medium").otherwise("low"))
