"""Table access: delimited and columnar readers, writers, the feature store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.expr import pick_alias, whole_days
from .schema import SCHEMAS

# The encodings an upload may have, in the order they are tried.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "latin-1")
SPARK_CHARSET = {"utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR", "latin-1": "ISO-8859-1"}


def probe_encoding(spark: SparkSession, path: str) -> str:
    """First encoding that decodes every line of the file."""
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).select(F.encode("value", "ISO-8859-1").alias("b"))
    if lines.where("NOT is_valid_utf8(cast(b AS string))").isEmpty():
        return ENCODINGS[0]
    for name in ENCODINGS[1:-1]:
        def bad(it, name=name):
            import pandas as pd

            for pdf in it:
                def fails(b):
                    try:
                        bytes(b).decode(name)
                        return False
                    except UnicodeDecodeError:
                        return True
                yield pd.DataFrame({"n": [int(pdf["b"].map(fails).sum())]})
        if (lines.mapInPandas(bad, "n long").agg(F.sum("n")).first()[0] or 0) == 0:
            return name
    return ENCODINGS[-1]


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """Header row; tab for .tsv, comma otherwise; encoding probed when not given."""
    sep = "\t" if path.lower().rstrip("/").endswith(".tsv") else ","
    enc = encoding or probe_encoding(spark, path)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", SPARK_CHARSET.get(enc, enc))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


@dataclass
class Catalog:
    """Named tables; an absent optional table is an empty frame of its schema."""

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    fmt: str = "parquet"

    def table(self, name: str, columns=None) -> DataFrame:
        if name not in self.paths:
            df = self.spark.createDataFrame([], SCHEMAS[name])
        elif self.fmt == "csv":
            df = read_delimited(self.spark, self.paths[name], SCHEMAS.get(name))
        else:
            df = self.spark.read.format(self.fmt).load(self.paths[name])
        return prune(df, columns) if columns else df

    def load(self, names=tuple(SCHEMAS)) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names}


def prune(df: DataFrame, columns) -> DataFrame:
    """Only the listed columns that exist; the scan reads nothing else."""
    return df.select(*[x for x in columns if x in df.columns])


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        (w.option("header", True) if fmt == "csv" else w).save(f"{root}/{name}")


class FeatureStore:
    """Features and their metadata by dataset name."""

    def __init__(self, root: str):
        self.root = root

    def save(self, features: DataFrame, metadata: DataFrame, name: str = "customer_features") -> None:
        features.write.mode("overwrite").parquet(f"{self.root}/{name}/features")
        metadata.write.mode("overwrite").json(f"{self.root}/{name}/metadata")

    def load(self, spark: SparkSession, name: str = "customer_features") -> tuple[DataFrame, DataFrame]:
        return (spark.read.parquet(f"{self.root}/{name}/features"), spark.read.json(f"{self.root}/{name}/metadata"))


def data_span_days(events: DataFrame, orders: DataFrame) -> DataFrame:
    t = events.select(F.col("timestamp").alias("t")).unionByName(orders.select(F.col("order_time").alias("t")))
    return t.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(
        F.coalesce(whole_days("a", "b"), F.lit(0)).alias("span_days"))


def latest_activity_date(events: DataFrame, orders: DataFrame) -> DataFrame:
    e = events.agg(F.max("timestamp").alias("e"))
    o = orders.agg(F.max("order_time").alias("o"))
    return e.crossJoin(o).select(F.to_date(F.greatest("e", "o")).alias("latest_date"))


def resolve_horizon(span, requested: int):
    """Prediction horizon that the observed history can support."""
    r = F.lit(int(requested))
    third = F.greatest(F.lit(15), F.floor(span / 3))
    half = F.greatest(F.lit(30), F.floor(span / 2))
    return (
        F.when(span < 60, F.least(r, third)).when(span < 90, F.lit(30)).when(span < 180, half).otherwise(r)
    ).cast("long")


# The columns a customer list may be sorted by.
SORTABLE = ("customer_id", "churn_probability", "clv", "uplift_score", "expected_roi", "expected_incremental_profit", "coupon_cost")


def list_customers(summary: DataFrame, *, persona=None, uplift_segment=None, treatment_group=None,
                   min_churn_probability=None, sort_by="customer_id", descending=False, limit=None, offset=0) -> DataFrame:
    df = summary
    for name, v in (("persona", persona), ("uplift_segment", uplift_segment), ("treatment_group", treatment_group)):
        if v:
            df = df.where(F.col(name) == v)
    if min_churn_probability is not None:
        df = df.where(F.col("churn_probability") >= float(min_churn_probability))
    key = sort_by if sort_by in SORTABLE and sort_by in df.columns else "customer_id"
    first = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    out = df.orderBy(first, F.col("customer_id")).offset(offset)
    return out if limit is None else out.limit(limit)


def normalize_customer_id(df: DataFrame, aliases=("customer_id", "user_id", "cust_id", "client_id", "id")) -> DataFrame:
    name = pick_alias(df.columns, aliases)
    return df.withColumn("customer_id", F.col(name).try_cast("long")).where("customer_id is not null")


def merge_on_customer(frames: list[DataFrame], order_col: str | None = None) -> DataFrame:
    """Full outer merge of several frames, one row per customer; the left value wins.

    Of repeated ids the row that is greatest by ``order_col``, then by all columns, stays.
    """
    merged = None
    for raw in frames:
        df = normalize_customer_id(raw)
        cols = [x for x in df.columns if x != "customer_id"]
        if cols:
            newest = [order_col] if order_col and order_col in df.columns else []
            df = df.groupBy("customer_id").agg(F.max_by(F.struct(*cols), F.struct(*newest, *cols)).alias("r")).select(
                "customer_id", *[F.col(f"r.{x}").alias(x) for x in cols])
        if merged is None:
            merged = df
            continue
        both = [x for x in df.columns if x in merged.columns and x != "customer_id"]
        right = df
        for x in both:
            right = right.withColumnRenamed(x, f"_r_{x}")
        j = merged.join(right, "customer_id", "full")
        merged = j.select("customer_id", *[
            F.coalesce(x, f"_r_{x}").alias(x) if x in both else F.col(x)
            for x in merged.columns + [y for y in df.columns if y not in merged.columns] if x != "customer_id"])
    return merged


def keep_first(df: DataFrame, key, order) -> DataFrame:
    """One row per key by an explicit order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
