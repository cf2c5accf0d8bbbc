"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, for nodes that have an edge (a, b).

    Each round hooks a node to its smallest neighbour, follows pointers twice
    and contracts the edges, which leaves a quarter of a chain or less.  Degrees
    enter only as minima (partial aggregation); rounds are cut by checkpoints.
    Loops and repeated edges do no harm; rows with a null end are left out.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    comp: DataFrame | None = None
    while True:
        hook = e.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        for _ in range(2):
            up = hook.select(F.col("a").alias("_k"), F.col("p").alias("_up"))
            hook = hook.join(up, F.col("p") == F.col("_k"), "left").select("a", F.coalesce("_up", "p").alias("p"))
        hook = cut(hook)
        if comp is None:
            comp = hook.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = hook.select(F.col("a").alias("_k"), F.col("p").alias("_up"))
            comp = comp.join(step, F.col("component") == F.col("_k"), "left").select("node", F.coalesce("_up", "component").alias("component"))
        pa = hook.select(F.col("a").alias("a"), F.col("p").alias("pa"))
        pb = hook.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        e = cut(e.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
        if e.isEmpty():
            return comp
