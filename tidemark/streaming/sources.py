"""Event streams from files; late rows leave at the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "event_id bigint, customer_id bigint, timestamp timestamp, event_type string, amount double"


def event_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1, watermark: str | None = "1 day", types=None, fmt: str = "parquet") -> DataFrame:
    """Ordered event log; rows without a time or customer are dropped. No watermark is set if it is None."""
    s = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)
    s = s.where("timestamp IS NOT NULL AND customer_id IS NOT NULL")
    if types:
        s = s.where(F.col("event_type").isin(*types))
    return s.withWatermark("timestamp", watermark) if watermark else s


RAW_SCHEMA = "event_id string, customer_id string, timestamp string, event_type string, amount string"


def parsed_events(raw: DataFrame) -> DataFrame:
    """Events of text columns with repaired times; ``reject_reason`` names what a row that cannot be used lacks, else null."""
    from ..functions.expr import repair_timestamp

    out = raw.select(F.expr("try_cast(event_id AS bigint) AS event_id"), F.expr("try_cast(customer_id AS bigint) AS customer_id"), repair_timestamp("timestamp").alias("timestamp"),
                     F.lower(F.trim("event_type")).alias("event_type"), F.expr("try_cast(amount AS double) AS amount"))
    return out.withColumn("reject_reason", F.expr("CASE WHEN customer_id IS NULL THEN 'customer' WHEN timestamp IS NULL THEN 'timestamp' END"))


def raw_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Text events (CSV) as they came."""
    return spark.readStream.schema(RAW_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path)


def text_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """Text events (CSV) with ``reject_reason``: a sink can count what ``text_event_stream`` leaves out."""
    return parsed_events(raw_stream(spark, path, files_per_trigger=files_per_trigger))


def text_event_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1, watermark: str = "1 day") -> DataFrame:
    """The usable rows of ``text_stream``."""
    return text_stream(spark, path, files_per_trigger=files_per_trigger).where("reject_reason IS NULL").drop("reject_reason").withWatermark("timestamp", watermark)


def replay_tick(events: DataFrame, offset: int, size: int) -> tuple[DataFrame, int, bool]:
    """The next ``size`` events after ``offset`` in time order (ties by id) with their ``position``, the new offset, and whether the replay began anew.

    An offset at or past the end starts again at the first event.
    """
    from ..functions.ordered import row_index

    events = events.where("timestamp IS NOT NULL")
    total = events.count()
    wrapped = total > 0 and offset >= total
    start = 0 if wrapped else offset
    stop = min(start + max(size, 1), total)
    rows = row_index(events, [("timestamp", True), ("event_id", True)], "position")
    return rows.where(F.col("position").between(start + 1, stop)), stop, wrapped


def unique_events(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The same source event counts once; state is bounded by the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def unique_forever(stream: DataFrame, key: str = "event_id") -> DataFrame:
    """The same source event counts once, however late it comes again; events without an id are never the same.

    The ids stay in the state store (on disk, a few bytes each), so this must come before
    the watermark is set, which would drop late rows unseen.
    """
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(stream.where(F.col(key).isNull()))


#: Keeps keyed state on disk beside the executor; needed for timers and for state that grows with the keys.
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(stream: DataFrame, sink, checkpoint: str, mode: str = "append", on_disk: bool = False):
    """Reads all files that are there, in order, one trigger per batch of files, then stops."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    usual = conf.get(name)
    if on_disk:
        conf.set(name, _ON_DISK)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        q.awaitTermination()
    finally:
        conf.set(name, usual)
    return q


class SideTable:
    """Sink that keeps each batch's rows in a folder of its own: a repeated batch replaces them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/batch_id={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.root)


def counted(q, name: str) -> dict[str, int]:
    """Sums of the counts that ``DataFrame.observe(name, ...)`` saw over the batches of a finished query."""
    out: dict[str, int] = {}
    for p in q.recentProgress:
        row = p.observedMetrics.get(name) if hasattr(p, "observedMetrics") else (p.get("observedMetrics") or {}).get(name)
        for k, n in (row.asDict() if hasattr(row, "asDict") else row or {}).items():
            out[k] = out.get(k, 0) + int(n)
    return out


def accounted(raw: DataFrame, live) -> DataFrame:
    """What became of every text event: ``status, reason`` beside its id, customer, time and type.

    ``live`` turns usable events into rows with a ``status``.  Rows that cannot be used are
    ``rejected`` with their reason.  Repeated ids are left out, forever; how many rows were
    usable is observed as ``usable``, so that repeats can be counted.
    """
    cols = ("event_id", "customer_id", "timestamp", "event_type")
    events = parsed_events(raw)
    good = events.where("reject_reason IS NULL").observe("usable", F.count(F.lit(1)).alias("rows"))
    used = live(unique_forever(good.drop("reject_reason"))).where("status <> 'silent'").select(*cols, "status", F.lit(None).cast("string").alias("reason"))
    return used.unionByName(events.where("reject_reason IS NOT NULL").select(*cols, F.lit("rejected").alias("status"), F.col("reject_reason").alias("reason")))
