"""Churn training: leakage guards, split, fit, curves and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.ordered import cheap, cut_lineage, pct_ranks, running_totals, shared

KEY = "customer_id"
# Names and name parts that reveal the target, risk-derived fields, identifiers.
LEAKAGE_NAMES = (
    "label", "target", "target_label", "target_churn", "churn", "churn_flag", "churn_label", "churn_label_observed", "churn_probability", "churn_prob",
    "churn_score", "is_churn", "is_churned", "is_churner", "will_churn", "label_observed", "retention", "retention_label", "retention_rate", "retained",
    "is_retained", "rolling_retention", "survival", "survived", "inactive_label", "inactive_45d", "future_active", "future_activity", "future_purchase",
    "next_purchase", "next_event", "outcome", "observed_outcome", "prediction", "predicted_label", "predicted_churn", "probability", "score", "risk_score",
    "rank_score", "selected_threshold", "uplift_score", "uplift_segment_true", "expected_roi", "expected_incremental_profit", "retention_probability",
    "retention_prob", "business_value", "current_journey_stage", "journey_stage", "customer_journey_stage", "lifecycle_stage", "customer_status",
    "risk_stage", "risk_segment", "risk_tier", "churn_risk_stage", "churn_segment", "inactivity_days", "inactive_days", "days_since_last_event",
    "days_since_last_activity", "recency_days", "current_non_purchase_days", "non_purchase_days", "days_from_simulation_start")
LEAKAGE_TOKENS = (
    "target", "label", "churn", "retention", "retained", "survival", "outcome", "future_", "next_", "after_", "post_", "predicted", "prediction", "probability",
    "risk_score", "rank_score", "selected_threshold", "days_to_churn", "days_until_churn", "uplift_score", "expected_roi", "expected_incremental_profit")
INACTIVITY_TOKENS = ("inactivity_days", "inactive_days", "days_since_last_event", "days_since_last_activity", "recency_days", "current_non_purchase_days", "non_purchase_days")
INACTIVITY_SOURCES = ("inactivity_rule", "current_inactivity_rule", "inactivity_rule_current_snapshot_fallback", "uploaded_inactivity_rule_observed")
FORBIDDEN_TOKENS = (
    "current_journey_stage", "journey_stage", "customer_journey_stage", "lifecycle_stage", "customer_status", "churn_risk", "at_risk", "risk_stage", "risk_segment",
    "risk_tier", "churn_segment", "dormant", "base_visit_prob", "base_purchase_prob", "base_exposure_prob", "visit_probability", "purchase_probability",
    "exposure_probability", "visit_prob", "purchase_prob", "exposure_prob", "recent_visit_score", "recent_purchase_score", "recent_exposure_score",
    "churn_probability", "uplift_score", "expected_roi", "expected_incremental_profit", "selection_score", "priority_score", "recommendation_score")
ID_TOKENS = ("customer_id", "user_id", "member_id", "account_id", "client_id", "order_id", "invoice", "session_id", "event_id", "transaction_id", "email", "phone", "uuid", "name")
NAME_PREFIXES = ("ext_num__", "ext_cat__", "num__", "cat__", "feature__", "features__")
NAME_SUFFIXES = ("_mean", "_median", "_max", "_min", "_mode", "_sum", "_std", "_avg", "_cnt", "_count", "_rate", "_ratio", "_flag", "_value")


def _plain(name: str) -> str:
    s = name.strip().lower()
    for p in NAME_PREFIXES:
        s = s.replace(p, "")
    for x in NAME_SUFFIXES:
        s = s.removesuffix(x)
    return s


def name_leaks(name: str, label_source: str | None = None) -> bool:
    forms = {name.strip().lower(), _plain(name)}
    has = lambda tokens: any(t in f for f in forms for t in tokens)
    if has(INACTIVITY_TOKENS):
        same_rule = (label_source or "").strip().lower() in INACTIVITY_SOURCES
        return same_rule or has(FORBIDDEN_TOKENS)
    return bool(forms & set(LEAKAGE_NAMES)) or has(LEAKAGE_TOKENS) or has(FORBIDDEN_TOKENS)


def leakage_filter(df: DataFrame, label_source: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drops leaking, risk-derived and identifying columns; keeps customer_id and label."""
    fixed = (KEY, "label")
    drop = [c for c in df.columns if c not in fixed and (name_leaks(c, label_source) or any(t in c.lower() for t in ID_TOKENS))]
    rest = df.drop(*drop)
    text = [c for c, t in rest.dtypes if t == "string" and c not in fixed]
    if text:
        rest = shared(rest)
        pairs = ", ".join(f"struct('{c}' AS feature, `{c}` AS v)" for c in text)
        levels = rest.selectExpr(f"inline(array({pairs}))").where("v IS NOT NULL").distinct().groupBy("feature").count()
        n, row = rest.count(), dict.fromkeys(text, 0) | {r["feature"]: r["count"] for r in levels.collect()}  # one row a column
        wide = [c for c in text if row[c] > 50 and ("sequence" in c.lower() or row[c] / max(n, 1) >= 0.5)]
        rest, drop = cheap(rest.drop(*wide)), drop + wide
    return rest, drop


def column_auc(df: DataFrame, columns, label: str = "label") -> DataFrame:
    """AUC of every single numeric column, from average-tie ranks."""
    ranks = pct_ranks(df, KEY, {c: c for c in columns}).join(df.select(KEY, label), KEY)
    pairs = ", ".join(f"struct('{c}' AS feature, {c} AS r)" for c in columns)
    g = ranks.selectExpr(label, f"inline(array({pairs}))").where("r IS NOT NULL").groupBy("feature").agg(*[F.expr(x) for x in (
        "count(1) AS n", f"count_if({label} = 1) AS p", f"sum(r) FILTER (WHERE {label} = 1) AS s")])
    return g.selectExpr("feature", "n", "CASE WHEN n >= 10 AND p > 0 AND p < n THEN (s * n - p * (p + 1) / 2D) / (cast(p AS double) * (n - p)) END AS auc").selectExpr(
        "feature", "n", "auc", "greatest(auc, 1 - auc) AS separability")


def category_purity(df: DataFrame, columns, label: str = "label") -> DataFrame:
    pairs = ", ".join(f"struct('{c}' AS feature, coalesce(cast({c} AS string), '__missing__') AS v)" for c in columns)
    g = df.selectExpr(label, f"inline(array({pairs}))").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("m"))
    return g.groupBy("feature").agg(F.expr("sum(greatest(m, 1 - m) * n) / sum(n) AS purity"))


def target_proxy_filter(df: DataFrame, *, numeric, categorical, cutoff: float = 0.995, label: str = "label") -> DataFrame:
    """Separability per column and whether it gives the target away."""
    a = column_auc(df, numeric, label).selectExpr("feature", "separability AS strength")
    out = a.unionByName(category_purity(df, categorical, label).selectExpr("feature", "purity AS strength")) if categorical else a
    return out.withColumn("is_proxy", F.expr(f"coalesce(strength >= {cutoff}, false)"))


def datetime_parts(df: DataFrame) -> DataFrame:
    times = [c for c, t in df.dtypes if t.startswith(("timestamp", "date"))]
    return df.select(*[c for c in df.columns if c not in times], *[F.expr(x) for c in times for x in (
        f"year({c}) AS {c}_year", f"month({c}) AS {c}_month", f"weekday({c}) AS {c}_dayofweek")])


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value: min and max say it, no distinct count needed."""
    cols = [c for c in df.columns if c != KEY]
    one = df.agg(*[F.expr(f"coalesce(min({c}) = max({c}), true) AS {c}") for c in cols])
    rows = ", ".join(f"struct('{c}' AS feature, {c} AS is_constant)" for c in cols)
    return one.selectExpr(f"inline(array({rows}))")


def group_split(df: DataFrame, *, test_size: float = 0.2, tries: int = 50, seed: int = 42, label: str = "label") -> DataFrame:
    """Customer-level split: of many hash splits the one whose positive rate is closest. One pass scores all tries."""
    share = f"(pmod({KEY}, 2147483647) * 48271 + {{i}} * 69621) % 2147483647 % 10000 < {int(test_size * 10000)}"
    aggs = [F.expr(f"avg({label}) AS a")] + [F.expr(f"avg({label}) FILTER (WHERE {share.format(i=seed + i)}) AS t{i}") for i in range(tries)]
    row = df.agg(*aggs).first()
    best = min((i for i in range(tries) if row[f"t{i}"] not in (None, 0.0, 1.0)), key=lambda i: abs(row[f"t{i}"] - row["a"]), default=0)
    return df.withColumn("is_test", F.expr(share.format(i=seed + best)))


def classification_curve(df: DataFrame, *, score: str = "score", label: str = "label") -> DataFrame:
    """Counts at or above every distinct score: the base of ROC, PR and thresholds."""
    g = cut_lineage(df.groupBy(F.expr(f"cast({score} AS double) AS threshold")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p")))
    total = g.agg(F.sum("_n").alias("n"), F.sum("_p").alias("p"))
    c = running_totals(g, [("threshold", False)], {"_cn": F.col("_n"), "tp": F.col("_p")}).crossJoin(F.broadcast(total))
    return c.selectExpr("threshold", "tp", "_cn - tp AS fp", "p - tp AS fn", "_p AS pos_here", "_n - _p AS neg_here", "n - p AS negatives", "p AS positives",
                        "tp / nullif(p, 0) AS recall", "(_cn - tp) / nullif(n - p, 0) AS fpr", "tp / _cn AS precision")


def curve_metrics(curve: DataFrame) -> DataFrame:
    """AUC and average precision as plain sums over the distinct scores."""
    return curve.agg(F.expr("sum(neg_here * (tp - pos_here / 2D)) / nullif(cast(max(positives) AS double) * max(negatives), 0D) AS auc"),
                     F.expr("sum(pos_here * precision) / nullif(max(positives), 0) AS average_precision"))


def business_threshold(curve: DataFrame, *, tp_value: float = 120000.0, fp_cost: float = 18000.0, fn_cost: float = 60000.0) -> DataFrame:
    """Threshold of the highest value; the lowest one on ties."""
    v = curve.withColumn("business_value", F.expr(f"tp * {tp_value}D - fp * {fp_cost}D - fn * {fn_cost}D"))
    best = v.agg(F.expr("max_by(struct(threshold, precision, recall, tp, fp, fn, business_value), struct(business_value, -threshold)) AS b"))
    return best.select("b.*")


_NUMERIC = ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean", "decimal")


def churn_columns(df: DataFrame, *, label_source: str | None = None, label: str = "label", cutoff: float = 0.995) -> tuple[DataFrame, dict[str, str]]:
    """The frame that may be trained on, and what became of each column.

    In turn: leaking and identifying columns go, dates become their parts, columns with one
    value go, columns that give the target away go.  Columns are ``numeric`` or
    ``category`` if they stay, else ``leakage``, ``constant`` or ``proxy``.
    """
    rest, leaking = leakage_filter(df, label_source)
    rest = cheap(datetime_parts(shared(rest)))
    fate = dict.fromkeys(leaking, "leakage")
    same = [r["feature"] for r in constant_columns(rest.drop(label)).where("is_constant").collect()]  # one row a column
    rest = rest.drop(*same)
    fate |= dict.fromkeys(same, "constant")
    kinds = {c: "numeric" if t.startswith(_NUMERIC) else "category" for c, t in rest.dtypes if c not in (KEY, label)}
    rest = rest.select(KEY, label, *[F.col(c).cast("double").alias(c) if k == "numeric" else F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c, k in kinds.items()])
    side = lambda kind: [c for c, k in kinds.items() if k == kind]
    strength = target_proxy_filter(rest, numeric=side("numeric"), categorical=side("category"), cutoff=cutoff, label=label)
    given_away = [r["feature"] for r in strength.where("is_proxy").collect()]  # one row a column
    return rest.drop(*given_away), fate | kinds | dict.fromkeys(given_away, "proxy")


def train_churn_table(df: DataFrame, *, label_source: str | None = None, label: str = "label", folds: int = 3):
    """From a labelled table of any columns to a model: ``churn_columns``, categories by frequency, then ``train_churn``.

    Returns the model, the scored test side, the cross-validated AUC and the fate of each column.
    """
    from pyspark.ml.feature import StringIndexer

    rest, fate = churn_columns(df, label_source=label_source, label=label)
    features = [c for c, k in fate.items() if k == "numeric"]
    categories = [c for c, k in fate.items() if k == "category"]
    if categories:
        coded = [f"{c}__code" for c in categories]
        rest = StringIndexer(inputCols=categories, outputCols=coded, handleInvalid="keep").fit(rest).transform(rest)
        features += coded
    if not features:
        raise ValueError("no column is left to train on")
    return *train_churn(rest, features, label=label, folds=folds), fate


def train_churn(df: DataFrame, features, *, label: str = "label", folds: int = 3):
    """Boosted trees and a forest, four settings each, chosen by AUC with customer folds and class weights."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from .uplift import _assembled

    rate = df.agg(F.avg(label)).first()[0]
    data = _assembled(df, features).select(KEY, F.col(label).cast("double").alias("label"), "features", F.expr(
        f"CASE WHEN {label} = 1 THEN {0.5 / max(rate, 1e-9)!r}D ELSE {0.5 / max(1 - rate, 1e-9)!r}D END AS weight"), F.expr(f"cast(pmod(xxhash64({KEY}, 7), {folds}) AS int) AS fold"))
    data = cut_lineage(group_split(data))
    train, test = data.where("NOT is_test"), data.where("is_test")
    ev = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    best, score = None, -1.0
    for est in (GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=10, seed=42),
                RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=20, seed=42)):
        step = est.stepSize if isinstance(est, GBTClassifier) else est.minInstancesPerNode
        grid = ParamGridBuilder().addGrid(est.maxDepth, [3, 5]).addGrid(step, [0.05, 0.1] if isinstance(est, GBTClassifier) else [5, 20]).build()
        cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol="fold", parallelism=4).fit(train)
        if max(cv.avgMetrics) > score:
            best, score = cv.bestModel, max(cv.avgMetrics)
    return best, best.transform(test), score


def feature_importance(spark, model, features, top: int = 10) -> DataFrame:
    vals = model.featureImportances.toArray()
    total = float(vals.sum()) or 1.0
    rows = sorted(((f, float(v), float(v) / total) for f, v in zip(features, vals)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double, share double")
