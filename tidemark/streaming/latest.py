"""A table with one row per key that batches bring up to date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ordered import cut_lineage


@dataclass
class Latest:
    """Newest row of every key, in folders by a hash of the key.

    A batch reads and rewrites only the folders of its own keys, so its work follows the
    keys that changed and never the batches before.  A row also keeps what it replaced: a
    batch that is run again, after whatever part of the first run, sees each key as it
    stood before and writes the same rows.
    """

    spark: SparkSession
    root: str
    key: str
    folders: int = 16

    def _folder(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.folders)).cast("int")

    def _there(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.option("basePath", self.root).parquet(self.root) if fs.exists(path) else None

    def _touched(self, keys: DataFrame) -> DataFrame | None:
        """Stored rows of the folders that ``keys`` fall into."""
        there = self._there()
        if there is None:
            return None
        hit = [r[0] for r in keys.select(self._folder().alias("f")).distinct().collect()]  # ``folders`` rows at most
        return there.where(F.col("_folder").isin(hit))

    def before(self, batch_id: int, keys: DataFrame) -> DataFrame | None:
        """Rows of ``keys`` (distinct) as they stood before the batch; None if nothing was written yet."""
        there = self._touched(keys)
        if there is None:
            return None
        row = F.when(F.col("_batch") < batch_id, F.col("_row")).otherwise(F.col("_old"))
        return there.join(keys.select(self.key), self.key, "left_semi").select(row.alias("r")).where("r IS NOT NULL").select("r.*")

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Replaces the rows of the keys of ``rows`` (one row for each key)."""
        rows = cut_lineage(rows)
        new = rows.select(self.key, F.struct(*rows.columns).alias("_new"))
        there = self._touched(rows)
        if there is None:
            merged = new.select(self.key, F.col("_new").alias("_row"), F.expr("CASE WHEN false THEN _new END").alias("_old"), F.lit(batch_id).cast("long").alias("_batch"))
        else:
            was = F.when(F.col("_batch") < batch_id, F.col("_row")).otherwise(F.col("_old"))
            both = there.join(new, self.key, "full")
            merged = both.select(self.key, F.coalesce("_new", "_row").alias("_row"), F.when(F.col("_new").isNotNull(), was).otherwise(F.col("_old")).alias("_old"),
                                 F.when(F.col("_new").isNotNull(), F.lit(batch_id)).otherwise(F.col("_batch")).cast("long").alias("_batch"))
        merged = cut_lineage(merged.withColumn("_folder", self._folder()))
        merged.repartition("_folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_folder").parquet(self.root)

    def rows(self) -> DataFrame | None:
        there = self._there()
        return None if there is None else there.select("_row.*", F.col("_batch").alias("batch_id"))
