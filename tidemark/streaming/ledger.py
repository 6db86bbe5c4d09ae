"""Shared budget of the action queue over the batches of a scored stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import cut_lineage
from ..operators.live import KEY, held_triggers, queue_by_day, trigger_actions
from .latest import Latest

_ROW = f"{KEY} bigint, status string, cents bigint, day date, used array<string>, action struct<event_id: bigint, timestamp: timestamp, intervention_intensity: string, coupon_cost: double>"


@dataclass
class QueueLedger:
    """Sink for a scored stream.

    Each batch's queue is written to a folder of its own; what later batches need is kept
    as one row per customer, per day and for the whole, which a batch reads for its own
    customers and days only.  A repeated batch changes nothing.
    """

    spark: SparkSession
    root: str
    candidates: DataFrame
    budget: float = 5_000_000
    daily_capacity: int = 500
    folders: int = 16

    def __post_init__(self):
        self._customers = Latest(self.spark, f"{self.root}/customers", KEY, self.folders)
        self._days = Latest(self.spark, f"{self.root}/days", "day", 8)
        self._total = Latest(self.spark, f"{self.root}/total", "id", 1)
        self._scores = Latest(self.spark, f"{self.root}/last_scores", KEY, self.folders)

    def __call__(self, scored: DataFrame, batch_id: int) -> None:
        """Queues the actions of one batch in event order.

        Capacity is counted per event day over all batches, money in cents.  What is spent
        is the cost of the customers' latest rows that are queued: a newer row replaces the
        older one, which gives its cost and its day's slot back to later batches.  Each
        customer gets one row a batch.
        """
        scored = cut_lineage(scored)
        hits = cut_lineage(scored.where("trigger_reason <> ''"))
        if hits.isEmpty():
            self._keep_scores(scored, batch_id)
            return
        keys = hits.select(KEY).distinct()
        before = self._customers.before(batch_id, keys)
        before = cut_lineage(before if before is not None else self.spark.createDataFrame([], _ROW))
        used = before.select(KEY, F.explode("used").alias("intervention_intensity"))
        acts = cut_lineage(trigger_actions(hits, self.candidates, used=used).withColumn("_day", F.to_date("timestamp")))
        held = held_triggers(hits, self.candidates, used=used)
        whole = self._total.before(batch_id, self.spark.range(1).selectExpr("cast(0 AS int) AS id"))
        spent = (whole.first() or {"cents": 0})["cents"] if whole is not None else 0
        filled = self._days.before(batch_id, acts.select(F.col("_day").alias("day")).distinct())
        queued = queue_by_day(acts, remaining_cents=round(self.budget * 100) - spent, daily_capacity=self.daily_capacity, filled=filled)
        out = cut_lineage(held.unionByName(queued))
        out.write.mode("overwrite").parquet(f"{self.root}/queue/batch_id={batch_id}")
        self._keep(out, before, spent, batch_id)
        self._keep_scores(scored, batch_id)

    def _keep(self, out: DataFrame, before: DataFrame, spent: int, batch_id: int) -> None:
        taken = F.col("action_queue_status") == "queued"
        new = out.select(KEY, F.col("action_queue_status").alias("status"), F.when(taken, F.expr("cast(round(coupon_cost * 100) AS bigint)")).otherwise(F.lit(0)).cast("long").alias("cents"),
                         F.to_date("timestamp").alias("day"), F.when(taken, F.array("intervention_intensity")).otherwise(F.array().cast("array<string>")).alias("now"),
                         F.expr("struct(event_id, timestamp, intervention_intensity, coupon_cost) AS action"))
        old = before.select(KEY, F.col("status").alias("_status"), F.col("cents").alias("_cents"), F.col("day").alias("_day"), F.col("used").alias("_used"))
        both = cut_lineage(new.join(old, KEY, "left"))
        moves = both.selectExpr("inline(array(struct(day AS day, int(status = 'queued') AS n, cents), struct(_day AS day, -int(coalesce(_status = 'queued', false)) AS n, -coalesce(_cents, 0L) AS cents)))")
        change = cut_lineage(moves.groupBy("day").agg(F.sum("n").cast("long").alias("n"), F.sum("cents").cast("long").alias("cents")))
        days = change.where("day IS NOT NULL").select("day", "n")
        was = self._days.before(batch_id, days)
        if was is not None:
            days = days.unionByName(was).groupBy("day").agg(F.sum("n").alias("n"))
        self._days.put(days, batch_id)
        total = change.agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("c")).selectExpr("cast(0 AS int) AS id", f"cast({spent} + c AS bigint) AS cents")
        self._total.put(total, batch_id)
        self._customers.put(both.select(KEY, "status", "cents", "day", F.array_sort(F.array_union(F.coalesce("_used", F.array().cast("array<string>")), "now")).alias("used"), "action"), batch_id)

    def _keep_scores(self, scored: DataFrame, batch_id: int) -> None:
        now = scored.groupBy(KEY).agg(F.max_by(F.struct("realtime_churn_score", F.col("timestamp").alias("last_event_at")), F.struct("timestamp", "event_id")).alias("r")).select(KEY, "r.*")
        was = self._scores.before(batch_id, now)
        if was is not None:
            now = now.unionByName(was).groupBy(KEY).agg(F.max_by(F.struct("realtime_churn_score", "last_event_at"), "last_event_at").alias("r")).select(KEY, "r.*")
        self._scores.put(now, batch_id)

    def open_actions(self) -> DataFrame:
        """Each customer's newest row: what the budget is committed to."""
        return self._customers.rows().select(KEY, "action.*", F.col("status").alias("action_queue_status"), "batch_id")

    def spent(self) -> float:
        there = self._total.rows()
        return there.first()["cents"] / 100 if there is not None else 0.0

    def queue(self) -> DataFrame:
        """All rows of all batches."""
        return self.spark.read.parquet(f"{self.root}/queue")

    def latest_scores(self) -> DataFrame:
        return self._scores.rows().select(KEY, "realtime_churn_score", "last_event_at")
