"""Counters, scores and actions of changed customers, written per batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ordered import cut_lineage
from ..operators.live import KEY, live_policy, score_changed
from .latest import Latest

_SCORES = ("churn_score", "clv", "uplift_score", "risk_segment")


@dataclass
class ServingTables:
    """foreachBatch sink for the counter stream: rescores only the customers of the batch.

    What earlier batches scored goes before ``existing``; a repeated batch does not see its
    own rows.  ``warm_model`` is a fitted pipeline, or the path of a saved one, that adds
    ``churn_score``, ``clv`` and ``uplift_score`` to the counters of warm customers.  Every
    batch's rows are written to a folder of their own; a customer's newest row is kept
    beside them, so a batch reads earlier scores of its own customers only.
    """

    spark: SparkSession
    root: str
    existing: DataFrame
    warm_model: object | str | None = None
    costs: DataFrame | None = None
    folders: int = 16

    def __post_init__(self):
        if isinstance(self.warm_model, str):
            from pyspark.ml import PipelineModel

            self.warm_model = PipelineModel.load(self.warm_model)
        self._newest = Latest(self.spark, f"{self.root}/newest", KEY, self.folders)

    def _known(self, batch_id: int, keys: DataFrame) -> DataFrame:
        cols = [KEY, "churn_score", "clv", "uplift_score"]
        given = self.existing.select(*cols, F.col("risk_segment") if "risk_segment" in self.existing.columns else F.lit(None).cast("string").alias("risk_segment")).join(keys, KEY, "left_semi")
        before = self._newest.before(batch_id, keys)
        if before is None:
            return given
        scored = cut_lineage(before.select(KEY, *_SCORES))
        return scored.unionByName(given.join(scored.select(KEY), KEY, "left_anti"))

    def __call__(self, states: DataFrame, batch_id: int) -> None:
        states = cut_lineage(states)
        warm = self.warm_model.transform(states) if self.warm_model is not None else None
        scores = score_changed(states, states, self._known(batch_id, states.select(KEY)), warm, self.costs)
        scores = scores.withColumn("scored_at", F.col("last_event_time"))
        if "expected_roi" not in scores.columns:
            scores = scores.withColumn("expected_roi", F.lit(None).cast("double"))
        rows = cut_lineage(live_policy(scores))
        rows.write.mode("overwrite").parquet(f"{self.root}/live/batch_id={batch_id}")
        self._newest.put(rows, batch_id)

    def history(self) -> DataFrame:
        """All rows of all batches."""
        return self.spark.read.parquet(f"{self.root}/live")

    def latest(self) -> DataFrame:
        """Newest row per customer over all batches."""
        return self._newest.rows()
