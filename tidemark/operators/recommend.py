"""Product category recommendations from own, recent, segment and global demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.ordered import cut_lineage, pct_ranks, shared

KEY = "customer_id"
# Browse-like events, finance labels of categories and reasons.
BROWSE_TYPES = ("view", "browse", "page_view", "search", "product_view", "add_to_cart")
FINANCE_CATEGORIES = {
    "fashion": "카드/소비", "beauty": "예·적금", "personal_care": "생활금융", "grocery": "입출금계좌", "sports": "대출", "health": "보험/연금",
    "electronics": "디지털금융", "home": "주거금융", "books": "금융교육/콘텐츠", "kids": "가족금융", "pet": "펫보험/특화상품",
    "deposit": "예금", "deposits": "예금", "savings": "적금", "saving": "적금", "savings_account": "적금", "checking": "입출금계좌",
    "checking_account": "입출금계좌", "account": "입출금계좌", "credit_card": "신용카드", "debit_card": "체크카드", "card": "카드",
    "loan": "대출", "loans": "대출", "mortgage": "주택담보대출", "personal_loan": "신용대출", "insurance": "보험", "pension": "연금",
    "fund": "펀드", "funds": "펀드", "investment": "투자상품", "wealth": "자산관리", "wealth_management": "자산관리",
    "asset_management": "자산관리", "remittance": "송금", "transfer": "이체", "digital_banking": "디지털금융", "mobile_banking": "모바일뱅킹",
}
FINANCE_REASONS = {
    "own_purchase_history": "고객 본인의 과거 금융거래 이력",
    "recent_browse_signal": "최근 금융상품 조회 신호",
    "segment_popularity": "유사 금융고객군 선호",
    "global_popularity": "전체 금융고객 선호",
}
_DAYS = "greatest(floor((unix_micros(cast(_max AS timestamp)) - unix_micros(cast({t} AS timestamp))) / 86400000000), 0)"


def category_preferences(orders: DataFrame) -> DataFrame:
    last = orders.agg(F.max("order_time").alias("_max"))
    return orders.crossJoin(F.broadcast(last)).groupBy(KEY, "item_category").agg(F.expr(
        f"sum(coalesce(net_amount, 0D) * exp(-{_DAYS.format(t='order_time')} / 90D) + coalesce(quantity, 0D) * 5000) AS customer_pref_score"))


def interest_scores(events: DataFrame) -> DataFrame:
    e = events.where(F.col("item_category").isNotNull() & F.lower("event_type").isin(*BROWSE_TYPES))
    last = e.agg(F.max("timestamp").alias("_max"))
    return e.crossJoin(F.broadcast(last)).groupBy(KEY, "item_category").agg(F.expr(f"sum(exp(-{_DAYS.format(t='timestamp')} / 60D)) AS view_score"))


def segment_popularity(summary: DataFrame, orders: DataFrame) -> DataFrame:
    # orders shrink to one row per customer and category before the join
    per = orders.groupBy(KEY, "item_category").agg(F.sum("net_amount").alias("a"), F.count(F.lit(1)).alias("n"))
    return per.join(summary.select(KEY, "persona", "uplift_segment"), KEY, "left").where("persona IS NOT NULL AND uplift_segment IS NOT NULL").groupBy(
        "persona", "uplift_segment", "item_category").agg(F.expr("sum(a) + sum(n) * 3000 AS segment_popularity"))


def global_popularity(orders: DataFrame) -> DataFrame:
    return orders.where("item_category IS NOT NULL").groupBy("item_category").agg(F.expr("sum(net_amount) + count(1) * 2000 AS global_popularity"))


def risk_targets(summary: DataFrame, limit: int | None = None, min_churn: float = 0.45) -> DataFrame:
    summary = shared(summary)
    ranks = pct_ranks(summary, KEY, {"_u": "coalesce(uplift_score, 0D)", "_v": "coalesce(clv, 0D)"}, zero_when_constant=True)
    out = summary.join(ranks, KEY).withColumn("recommendation_priority", F.expr(
        "0.45 * least(greatest(coalesce(churn_probability, 0D), 0D), 1D) + 0.25 * _u + 0.30 * _v")).drop("_u", "_v").where(
        f"churn_probability >= {min_churn}").withColumn("target_priority_score", F.col("recommendation_priority"))
    out = out.orderBy(F.desc("target_priority_score"), F.desc("clv"), KEY)
    return out.limit(limit) if limit else out


def given_targets(summary: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Targets chosen elsewhere; their newer values win over the summary."""
    extra = [x for x in targets.columns if x != KEY]
    j = summary.join(targets.select(KEY, *[F.col(x).alias(f"_t_{x}") for x in extra]), KEY)
    df = j.select(*[F.expr(f"coalesce(_t_{x}, {x}) AS {x}") if x in extra else F.col(x) for x in summary.columns],
                  *[F.col(f"_t_{x}").alias(x) for x in extra if x not in summary.columns])
    if "churn_score" in df.columns:
        df = df.withColumn("churn_probability", F.expr("coalesce(churn_score, churn_probability)"))
    z = lambda n, d="0D": f"coalesce({n}, {d})" if n in df.columns else d
    df = shared(df)
    ranks = pct_ranks(df, KEY, {"_p": z("priority_score"), "_u": z("uplift_score"), "_v": z("clv"), "_r": f"greatest({z('expected_roi')}, 0D)"}, zero_when_constant=True)
    df = df.join(ranks, KEY).withColumn("recommendation_priority", F.expr(
        f"least(greatest(0.30 * _p + 0.22 * least(greatest({z('churn_probability')}, 0D), 1D) + 0.14 * _u + 0.14 * _v + 0.10 * _r "
        f"+ 0.10 * least(greatest({z('timing_urgency_score')}, 0D), 1D), 0D), 1D)")).withColumn("target_priority_score", F.expr(z("priority_score"))).drop("_p", "_u", "_v", "_r")
    sort = [F.desc("target_priority_score"), *[F.desc(x) for x in ("expected_incremental_profit", "expected_roi") if x in df.columns], F.desc("recommendation_priority"),
            *[F.col(x) for x in ("intervention_window_days",) if x in df.columns], F.desc("clv"), F.col(KEY)]
    out = df.orderBy(*sort)
    return out.limit(limit) if limit else out


#: Categories up to which the catalog and its popularity are broadcast.
CATALOG_ROWS = 20_000


_SIGNALS = ("customer_pref_score", "view_score", "segment_popularity", "global_popularity")


def _scaled(s: str) -> str:
    return f"CASE WHEN _hi_{s} - _lo_{s} < 1e-9 THEN 0D ELSE ({s} - _lo_{s}) / (_hi_{s} - _lo_{s}) END"


def _near_the_top(base: DataFrame, cats: DataFrame, pref: DataFrame, view: DataFrame, seg: DataFrame, glob: DataFrame, k: int) -> DataFrame:
    """Rows of customer and category that can be among the first ``k``, with the signals and their least and largest value over the whole catalog."""
    n = cats.count()
    own = cut_lineage(pref.join(view, [KEY, "item_category"], "full").join(cats, "item_category", "left_semi").na.fill(0.0, list(_SIGNALS[:2])))
    # a customer without a row for some category has zero there
    ends = own.groupBy(KEY).agg(F.count(F.lit(1)).alias("_m"), *[F.expr(f"CASE WHEN count(1) = {n} THEN {f}({s}) ELSE {g}({f}({s}), 0D) END AS _{e}_{s}") for s in _SIGNALS[:2] for f, g, e in (("min", "least", "lo"), ("max", "greatest", "hi"))])
    groups = cut_lineage(base.select("persona", "uplift_segment").distinct().withColumn("_g", F.monotonically_increasing_id()))  # persona and segment: a few
    shown = groups.crossJoin(cats).join(seg, ["persona", "uplift_segment", "item_category"], "left").join(glob, "item_category", "left").na.fill(0.0, list(_SIGNALS[2:])).select("_g", "item_category", *_SIGNALS[2:])
    shown = cut_lineage(shown)
    limits = shown.groupBy("_g").agg(*[F.expr(f"{f}({s}) AS _{e}_{s}") for s in _SIGNALS[2:] for f, e in (("min", "lo"), ("max", "hi"))])
    ranked = shown.join(F.broadcast(limits), "_g")
    ranked = cut_lineage(ranked.withColumn("_rank", F.row_number().over(W.partitionBy("_g").orderBy(F.expr(f"0.20 * {_scaled(_SIGNALS[2])} + 0.15 * {_scaled(_SIGNALS[3])}").desc(), "item_category"))))
    same = base["persona"].eqNullSafe(groups["persona"]) & base["uplift_segment"].eqNullSafe(groups["uplift_segment"])
    who = base.join(F.broadcast(groups), same).select(*[base[c] for c in base.columns], "_g").join(ends, KEY, "left").na.fill(0)
    who = cut_lineage(who)
    mine = who.join(own, KEY).join(ranked.drop("_rank"), ["_g", "item_category"])
    first = who.withColumn("_rank", F.expr(f"explode(sequence(1, cast(least({k} + _m, {n}) AS int)))")).join(ranked, ["_g", "_rank"]).join(own.select(KEY, "item_category"), [KEY, "item_category"], "left_anti")
    return mine.unionByName(first.drop("_rank").withColumns({s: F.lit(0.0) for s in _SIGNALS[:2]}))


def recommend_topk(targets: DataFrame, orders: DataFrame, events: DataFrame, summary: DataFrame, k: int = 3) -> DataFrame:
    """The best ``k`` of all categories for each target, each signal min-max scaled per customer.

    Up to CATALOG_ROWS categories every target meets the whole catalog, which is broadcast.
    In a larger one, categories without a signal of the customer's own stand in the same
    order for all customers of a segment: the segment's ranking is made once, and a customer
    meets its own categories and as many of the ranking's first as can still matter.
    """
    targets = shared(targets)
    glob = global_popularity(orders)
    seen = events.where(F.col("item_category").isNotNull() & F.lower("event_type").isin(*BROWSE_TYPES)).select("item_category")
    cats = cut_lineage(glob.select("item_category").unionByName(seen).distinct())
    small = cats.count() <= CATALOG_ROWS
    base = targets.select(KEY, "persona", "uplift_segment", F.expr("coalesce(coupon_affinity, 0D) AS _ca"))
    keys = targets.select(KEY)
    pref = category_preferences(orders).join(keys, KEY, "left_semi")
    view = interest_scores(events).join(keys, KEY, "left_semi")
    seg, w = segment_popularity(summary, orders), W.partitionBy(KEY)
    if small:
        j = (base.crossJoin(F.broadcast(cats)).join(pref, [KEY, "item_category"], "left").join(view, [KEY, "item_category"], "left")
             .join(seg, ["persona", "uplift_segment", "item_category"], "left").join(F.broadcast(glob), "item_category", "left").na.fill(0.0, list(_SIGNALS)))
        j = j.select("*", *[F.min(s).over(w).alias(f"_lo_{s}") for s in _SIGNALS], *[F.max(s).over(w).alias(f"_hi_{s}") for s in _SIGNALS])
    else:
        j = _near_the_top(base, cats, pref, view, seg, glob, k)
    j = j.withColumn("recommendation_score", F.expr(f"0.50 * {_scaled(_SIGNALS[0])} + 0.15 * {_scaled(_SIGNALS[1])} + 0.20 * {_scaled(_SIGNALS[2])} + 0.15 * {_scaled(_SIGNALS[3])} + 0.05 * _ca"))
    j = j.withColumn("recommendation_rank", F.row_number().over(w.orderBy(F.desc("recommendation_score"), "item_category"))).where(f"recommendation_rank <= {k}")
    return j.selectExpr(
        KEY, "persona", "uplift_segment", "recommendation_rank", "item_category AS recommended_category", "recommendation_score",
        "CASE WHEN customer_pref_score > 0 OR view_score > 0 OR segment_popularity > 0 THEN concat_ws(', ', "
        "CASE WHEN customer_pref_score > 0 THEN 'own_purchase_history' END, CASE WHEN view_score > 0 THEN 'recent_browse_signal' END, "
        "CASE WHEN segment_popularity > 0 THEN 'segment_popularity' END) ELSE 'global_popularity' END AS reason_tags")


def recommendation_summary(recs: DataFrame, top: int | None = None) -> DataFrame:
    out = recs.groupBy("recommended_category").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(KEY).alias("customers")).orderBy(
        F.desc("rows"), "recommended_category")
    return out.limit(top) if top else out


def localize_categories(recs: DataFrame, column: str = "recommended_category") -> DataFrame:
    """Finance wording for categories and reasons; unknown names stay."""
    table = recs.sparkSession.createDataFrame(list(FINANCE_CATEGORIES.items()), "_k string, _label string")
    out = recs.withColumn("_k", F.expr(f"replace(replace(lower(trim({column})), ' ', '_'), '-', '_')")).join(F.broadcast(table), "_k", "left")
    out = out.withColumn(column, F.expr(f"coalesce(_label, trim({column}))")).drop("_k", "_label")
    if "reason_tags" in recs.columns:
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in FINANCE_REASONS.items())
        out = out.withColumn("reason_tags", F.expr(
            f"concat_ws(', ', transform(filter(split(reason_tags, ','), x -> trim(x) <> ''), x -> coalesce(try_element_at(map({pairs}), trim(x)), trim(x))))"))
    return out
