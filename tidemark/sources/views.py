"""Two customer domains derived from the driver's test tables.

Long history (``t_*``): orders and line items over seven years.
Dense month (``e_*``): the event stream of January 2024.
They do not overlap in time and are never mixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import at, bound

PERSONA_BY_SEGMENT = {
    "BUILDING": "vip_loyal",
    "AUTOMOBILE": "regular_loyal",
    "MACHINERY": "price_sensitive",
    "HOUSEHOLD": "explorer",
    "FURNITURE": "churn_progressing",
}
EVENT_BY_FLAG = {"N": "visit", "R": "support_contact", "A": "page_view"}
LIVE_EVENT_NAMES = {
    "view": "page_view",
    "click": "visit",
    "signup": "search",
    "error": "support_contact",
    "purchase": "purchase",
}
T_AS_OF = "2001-06-17 00:00:00"
T_ASSIGNED = "2001-01-01 00:00:00"
E_AS_OF = "2024-01-25 00:00:00"


def _case(col: str, mapping: dict, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    # ---- long history -------------------------------------------------
    def orders(self, quantity: bool = False) -> DataFrame:
        o, qty = self.table("orders"), "1D"
        if quantity:
            lines = self.table("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
            o, qty = o.join(lines, o.o_orderkey == lines.l_orderkey, "left"), "coalesce(q, 1D)"
        coupon = "CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE 0 END"
        return o.selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderdate AS order_time", "o_orderpriority AS item_category",
            f"{qty} AS quantity", "o_totalprice AS net_amount", f"{coupon} * 0.1D * o_totalprice AS discount_amount",
            f"{coupon} AS coupon_used")

    def customers(self) -> DataFrame:
        geo = self.table("nation").join(self.table("region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name")
        first = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("f"))
        signup = f"coalesce(f, {at('1995-01-01 00:00:00')})"
        return (
            self.table("customer").join(first, F.expr("o_custkey = c_custkey"), "left")
            # nation and region are fixed lists of 25 and 5 rows
            .join(F.broadcast(geo), F.expr("c_nationkey = n_nationkey"), "left")
            .selectExpr(
                "c_custkey AS customer_id", f"{_case('c_mktsegment', PERSONA_BY_SEGMENT, chr(39) + 'unknown' + chr(39))} AS persona",
                f"{signup} AS signup_date", f"date_format({signup}, 'yyyy-MM') AS acquisition_month", "r_name AS region",
                "(c_custkey % 100) / 100D AS price_sensitivity", "(c_custkey % 37) / 37D AS coupon_affinity"))

    def events(self) -> DataFrame:
        buy = self.table("orders").selectExpr(
            "o_custkey AS customer_id", "o_orderdate AS timestamp", "'purchase' AS event_type", "o_orderpriority AS item_category")
        ship = (
            self.table("lineitem").selectExpr("l_orderkey", "l_shipdate", f"{_case('l_returnflag', EVENT_BY_FLAG, 'NULL')} AS event_type")
            .where("event_type IS NOT NULL")
            .join(self.table("orders"), F.expr("l_orderkey = o_orderkey"))
            .selectExpr("o_custkey AS customer_id", "l_shipdate AS timestamp", "event_type", "o_orderpriority AS item_category"))
        return buy.unionByName(ship).selectExpr(
            "*", "concat(cast(customer_id AS string), '-', date_format(timestamp, 'yyyyMMdd')) AS session_id")

    def assignments(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS customer_id", "cast(c_custkey % 2 AS int) AS treatment_flag",
            "CASE WHEN c_custkey % 2 = 1 THEN 'treatment' ELSE 'control' END AS treatment_group",
            f"{at(T_ASSIGNED)} AS assigned_at", "cast(3000 + (c_custkey % 13) * 1000 AS double) AS coupon_cost")

    def exposures(self) -> DataFrame:
        return (
            self.assignments().where("treatment_flag = 1")
            .selectExpr("customer_id", "assigned_at", "coupon_cost", "explode(sequence(0, cast(customer_id % 3 AS int))) AS n")
            .selectExpr("customer_id", "assigned_at + make_dt_interval(7 * n) AS exposure_time", "coupon_cost"))

    def scores(self) -> DataFrame:
        """Deterministic stand-ins for model scores, from scaled order history."""
        from ..operators.scoring import micro_features

        o = self.table("orders").selectExpr("o_custkey AS customer_id", "o_totalprice / 1000 AS amount", "'purchase' AS event_type")
        return micro_features(o).select("customer_id", "churn_probability", "uplift_score", "clv", F.col("coupon_cost").alias("score_cost"))

    def summary(self) -> DataFrame:
        """Customer summary used by the decision operators."""
        from ..operators.scoring import uplift_band

        last = self.table("orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
            F.max("o_orderdate").alias("last_order"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("m"))
        base = (
            self.customers().join(self.assignments().drop("assigned_at"), "customer_id", "left")
            .join(self.scores().selectExpr("customer_id", "churn_probability AS p", "uplift_score AS u", "clv * 100 AS v"), "customer_id", "left")
            .join(last, "customer_id", "left")
            .selectExpr("*", "coalesce(p, 0.5) AS churn_probability", "coalesce(u, 0.02) AS uplift_raw", "coalesce(v, 2000D) AS clv")
            .selectExpr("*", "clv * uplift_raw * (0.6 + 0.4 * coupon_affinity) AS expected_incremental_profit",
                        "uplift_raw - CASE WHEN customer_id % 5 = 0 THEN 0.04D * 3 ELSE 0D END AS uplift_score"))
        return base.selectExpr(
            "customer_id", "persona", "region", "signup_date", "acquisition_month", "treatment_group", "treatment_flag",
            "price_sensitivity", "coupon_affinity", "coalesce(n, 0) AS frequency", "coalesce(m, 0D) AS monetary",
            f"cast(coalesce(datediff({at('2001-08-01 00:00:00')}, last_order), 999) AS bigint) AS recency_days",
            "churn_probability", "uplift_score", "clv", "coupon_cost", "expected_incremental_profit",
            "(expected_incremental_profit - coupon_cost) / coupon_cost AS expected_roi",
            "(customer_id % 11) / 5D AS discount_pressure_score", "(customer_id % 7) / 7D AS brand_sensitivity",
            f"{uplift_band()} AS uplift_segment")

    def survival(self) -> DataFrame:
        """Survival predictions at a fixed constant hazard."""
        s = self.summary().selectExpr("customer_id", "exp(1.2 * (churn_probability - 0.3) + 0.002 * least(recency_days, 400)) AS hr")
        return s.selectExpr(
            "customer_id", "hr AS predicted_hazard_ratio", "exp(-0.25 * hr) AS survival_prob_30d", "exp(-0.5 * hr) AS survival_prob_60d",
            "exp(-0.75 * hr) AS survival_prob_90d",
            f"{bound('90 * 0.6931471805599453D / (0.75 * hr)', '1D', '90D')} AS predicted_median_time_to_churn_days")

    def snapshots(self) -> DataFrame:
        from ..operators.snapshots import activity_snapshots

        return activity_snapshots(self.summary().select("customer_id", "signup_date", "frequency", "monetary"), self.events(), self.orders())

    def churners(self) -> DataFrame:
        from ..operators.journey import final_churn_run

        return final_churn_run(self.snapshots())

    # ---- dense month --------------------------------------------------
    def live_events(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id", "user_id AS customer_id", "ts AS timestamp",
            f"{_case('event_type', LIVE_EVENT_NAMES, chr(39) + 'other' + chr(39))} AS event_type", "value AS amount",
            "concat(cast(user_id AS string), '-', date_format(ts, 'yyyyMMdd')) AS session_id",
            "concat('cat_', cast(event_id % 7 AS string)) AS item_category", "props")

    def live_orders(self) -> DataFrame:
        return self.live_events().where("event_type = 'purchase'").selectExpr(
            "event_id AS order_id", "customer_id", "timestamp AS order_time", "item_category", "1D AS quantity", "amount AS net_amount",
            "0D AS discount_amount", "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS coupon_used")
