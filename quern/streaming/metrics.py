"""Running metrics of agents, merged batch by batch, with percentiles from mergeable sketches.

The kept state lies below one folder and has three tables: ``days``, one row per agent and
day with counts, sums and a KLL sketch of the times; ``recent``, the latest runs of each
agent; ``failing``, the failures after an agent's last success.  A batch is folded into the
same form and merged: sums add, sketches merge, the latest are chosen again.  All of
it but the percentiles is exact in whatever order rows arrive.  A percentile's rank is
off by at most about 1.7 / ``SKETCH`` of the rows (99 % confidence).

A commit names the tables and the batch, so a batch that a restarted stream hands over
again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics
from ..operators.commits import CommitLog

SKETCH = 400  # k of the KLL sketches
LATEST = 100

_SUMS = ("total", "completed", "failed", "cancelled", "sum_ms", "n_ms", "tokens", "n_tokens")


def fold_days(runs: DataFrame) -> DataFrame:
    """(agent_id, day, counts, sums, least and greatest time, sketch) of (agent_id, started_at, ms, tokens, status)."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.groupBy("agent_id", F.to_date("started_at").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), status("completed"), status("failed"), status("cancelled"), F.sum("ms").alias("sum_ms"), F.count("ms").alias("n_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum("tokens").alias("tokens"), F.count("tokens").alias("n_tokens"), F.kll_sketch_agg_bigint("ms", SKETCH).alias("times"),
    )


def merge_days(parts: DataFrame) -> DataFrame:
    return parts.groupBy("agent_id", "day").agg(*(F.sum(c).alias(c) for c in _SUMS), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("times", SKETCH).alias("times"))


def report_days(days: DataFrame) -> DataFrame:
    """The columns of ``analytics.agent_days``; p95 and p99 by the sketches."""
    at = lambda q: F.when(F.col("n_ms") > 0, F.kll_sketch_get_quantile_bigint("times", F.lit(q))).cast("double")
    mean = lambda s, n: F.floor(F.col(s) / F.nullif(F.col(n), F.lit(0)))
    return days.select("agent_id", "day", "total", "completed", "failed", "cancelled", mean("sum_ms", "n_ms").alias("avg_ms"), "min_ms", "max_ms", at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"), "tokens", mean("tokens", "n_tokens").alias("avg_tokens"))


class RunningMetrics:
    """State below ``path``; ``update`` is a function for ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def _state(self) -> tuple[int, dict]:
        numbers = self.log.numbers()
        return (numbers[-1], self.log.read(numbers[-1])) if numbers else (0, {"batch": -1})

    def _table(self, state: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/{state['tables']}")

    def update(self, runs: DataFrame, batch: int) -> None:
        """Merge (event_id, agent_id, started_at, ms, tokens, status); a batch that was merged before is left out."""
        number, state = self._state()
        if batch <= state["batch"]:
            return
        runs = runs.persist()
        days = fold_days(runs)
        rows = runs.select("agent_id", "started_at", "event_id", "status")
        known = "tables" in state
        every = self._table(state, "recent").unionByName(rows) if known else rows
        days = merge_days(self._table(state, "days").unionByName(days)) if known else days
        failing = rows.where(F.col("status") != "completed")
        failing = self._table(state, "failing").unionByName(failing) if known else failing
        good = rows.where("status = 'completed'").groupBy("agent_id").agg(F.max(F.struct("started_at", "event_id")).alias("good"))
        good = self._table(state, "good").unionByName(good).groupBy("agent_id").agg(F.max("good").alias("good")) if known else good
        later = F.col("good").isNull() | (F.struct("started_at", "event_id") > F.col("good"))
        name = uuid.uuid4().hex
        for what, table in {
            "days": days,
            "recent": analytics.latest(every, LATEST, ["agent_id"], "started_at").select(*rows.columns),
            "good": good,
            "failing": failing.join(good, "agent_id", "left").where(later).select(*rows.columns),
        }.items():
            table.write.parquet(f"{self.path}/{what}/{name}")
        runs.unpersist()
        self.log.commit(number + 1, {"batch": batch, "tables": name})

    def days(self) -> DataFrame:
        return report_days(self._table(self._state()[1], "days"))

    def health(self) -> DataFrame:
        """The columns of ``analytics.health``."""
        state = self._state()[1]
        share = self._table(state, "recent").groupBy("agent_id").agg(F.avg((F.col("status") == "completed").cast("double")).alias("success_rate"))
        failing = self._table(state, "failing").groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))
        return share.join(failing, "agent_id", "left").select("agent_id", "success_rate", analytics.health_state(F.col("success_rate")).alias("state"), F.coalesce("n", F.lit(0)).alias("consecutive_failures"))


def run(spark: SparkSession, runs: DataFrame, path: str, checkpoint: str):
    """Start a stream of ``runs`` into the metrics below ``path``."""
    metrics = RunningMetrics(spark, path)
    return runs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(metrics.update)
