"""From a free-form upload to the standard tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import add, bound, chain
from ..functions.ordered import cut_lineage, exact_quantiles, pct_ranks, quantile_row, row_index, shared
from . import onboarding_words as words
from .scoring import uplift_by_median

KEY = "customer_id"
_DATE = r"\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}|\\d{1,2}[-/]\\d{1,2}[-/]\\d{2,4}"


def _norm(name: str) -> str:
    s = re.sub(r"[^a-z0-9가-힣_]", "_", name.strip().lower())
    return re.sub(r"_+", "_", s).strip("_")


def slug(name: str) -> str:
    s = re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z가-힣]+", "_", name.strip().lower())).strip("_")
    return (s or "col")[:64]


def slugs(names: list[str]) -> dict[str, str]:
    """A result name for each column; a number goes after names that would meet, as cut ones do."""
    out: dict[str, str] = {}
    for c in names:
        s, k = slug(c), 1
        while s in out.values():
            k += 1
            s = f"{slug(c)[:64 - len(str(k)) - 1]}_{k}"
        out[c] = s
    return out


def find_column(df: DataFrame, names) -> str | None:
    have = {slug(c): c for c in df.columns}
    return next((have[slug(n)] for n in names if slug(n) in have), None)


# ---- profile ----------------------------------------------------------
def profile_columns(df: DataFrame) -> DataFrame:
    """Missing rate, distinct count and type per column; two grouped passes over long form."""
    pairs = ", ".join(f"struct('{c}' AS column_name, cast(`{c}` AS string) AS v)" for c in df.columns)
    long = df.selectExpr(f"inline(array({pairs}))")
    per = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy("column_name").agg(F.sum("n").alias("rows"), F.expr("coalesce(sum(n) FILTER (WHERE v IS NULL), 0) AS missing"), F.count("v").alias("distinct_values"), F.min("v").alias("sample_value"))
    kinds = df.sparkSession.createDataFrame([(c, "numeric" if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal") else
                                              "datetime" if t.startswith(("timestamp", "date")) else "text") for c, t in df.dtypes], "column_name string, kind string")
    return g.join(F.broadcast(kinds), "column_name").selectExpr("column_name", "kind", "rows", "missing / rows AS missing_rate", "distinct_values", "sample_value")


def quality_warnings(profile: DataFrame, id_column: str) -> DataFrame:
    p = profile.selectExpr("column_name", "missing_rate", "distinct_values / greatest(rows, 1) AS unique_share")
    return p.selectExpr("column_name", f"CASE WHEN missing_rate > 0.5 THEN 'mostly_missing' WHEN column_name = '{id_column}' AND unique_share < 0.5 THEN 'transaction_level' END AS warning").where("warning IS NOT NULL")


def granularity(df: DataFrame, id_column: str) -> DataFrame:
    per = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.expr("sum(n) AS rows"), F.expr(f"count({id_column}) AS ids")).selectExpr("rows", "ids", "CASE WHEN ids / greatest(rows, 1) < 0.5 THEN 'transaction' ELSE 'customer' END AS granularity")


def detect_column_roles(df: DataFrame) -> DataFrame:
    """Role and confidence per column: by name, else by what the values look like (one aggregate for all columns, distinct values counted exactly)."""
    numeric_kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    aggs, unnamed = [], [c for c, t in df.dtypes if (t in numeric_kinds or t.startswith("decimal")) and not any(_norm(c) in syn or any(w in _norm(c) or _norm(c) in w for w in syn) for syn in words.ROLE_WORDS.values())]
    distinct = {r["column_name"]: r["distinct_values"] for r in profile_columns(df.select(*unnamed)).collect()} if unnamed else {}
    for i, c in enumerate(df.columns):
        v = f"cast(`{c}` AS string)"
        aggs += [f"count(`{c}`) AS n{i}", f"avg(CASE WHEN {v} RLIKE '{_DATE}' THEN 1D ELSE 0D END) FILTER (WHERE `{c}` IS NOT NULL) AS d{i}",
                 f"bool_and({v} IN ('0', '1', 'true', 'false', 'yes', 'no', 'Y', 'N')) AS b{i}"]
    row = df.agg(*[F.expr(x) for x in aggs]).first()
    out = []
    for i, (c, t) in enumerate(df.dtypes):
        n, role, score = _norm(c), "unknown", 0.0
        for r, syn in words.ROLE_WORDS.items():
            s = 1.0 if n in syn else 0.7 if any(w in n or n in w for w in syn) else 0.0
            if s > score:
                role, score = r, s
        if score < 0.5 and row[f"n{i}"]:
            if c in distinct and distinct[c] / row[f"n{i}"] > 0.9:
                role, score = "potential_id", 0.3
            elif t == "string" and (row[f"d{i}"] or 0) > 0.7:
                role, score = "timestamp", 0.6
            elif row[f"b{i}"]:
                role, score = "potential_binary", 0.3
        out.append((c, role, score))
    return df.sparkSession.createDataFrame(out, "column_name string, role string, confidence double")


def relevance_score(roles: DataFrame, rows: int) -> DataFrame:
    """Weighted confidence of the best column per role; three unrelated names reject the file."""
    w = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in words.ROLE_WEIGHTS.items()) + " ELSE 0D END"
    bad = ", ".join(f"'{x}'" for x in words.UNRELATED)
    per = roles.groupBy("role").agg(F.max("confidence").alias("c"), F.expr(f"count_if(lower(column_name) IN ({bad})) AS x"))
    return per.agg(F.expr(f"least(sum({w} * c), 1D) AS relevance_score"), F.expr("sum(x) >= 3 AS is_unrelated")).selectExpr(
        "relevance_score", "is_unrelated", f"NOT is_unrelated AND relevance_score >= 0.25 AND {rows} >= 10 AS is_valid")


# ---- event types ------------------------------------------------------
def standard_event_type(column: str = "raw") -> str:
    """Standard type of a value as an expression: the exact word, else the longest word of four letters or more inside it; ``other`` for null."""
    n = f"regexp_replace(regexp_replace(regexp_replace(lower(trim(cast({column} AS string))), '[^a-z0-9가-힣]', '_'), '_+', '_'), '^_|_$', '')"
    exact, inside = [], []
    for i, (std, syn) in enumerate(words.EVENT_WORDS.items()):
        exact.append(f"WHEN n IN ({', '.join(chr(39) + w + chr(39) for w in syn)}) THEN '{std}'")
        inside += [f"struct({-len(w)} AS a, {i} AS i, '{std}' AS std, '{w}' AS w)" for w in syn if len(w) >= 4]
    hit = f"array_min(filter(array({', '.join(inside)}), s -> contains(n, s.w))).std"
    return f"transform(array({n}), n -> CASE WHEN n IS NULL OR n = '' THEN 'other' {' '.join(exact)} ELSE coalesce({hit}, 'other') END)[0]"


def event_type_map(values: DataFrame, column: str = "raw") -> DataFrame:
    """Standard type of each distinct value."""
    return values.select(column).distinct().withColumn("event_type", F.expr(standard_event_type(column)))


def event_mapping_report(values: DataFrame, column: str = "raw") -> DataFrame:
    """Rows and standard type of each value, and the share of rows with a type; null values are no values and are not counted."""
    n = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    j = cut_lineage(n.withColumn("event_type", F.expr(standard_event_type(column))))
    total = j.agg(F.expr("1 - coalesce(sum(rows) FILTER (WHERE event_type = 'other'), 0) / greatest(sum(rows), 1) AS coverage_rate"))
    return j.crossJoin(F.broadcast(total)).selectExpr(f"{column} AS value", "event_type", "rows", "event_type = 'other' AS is_unmapped", "coverage_rate")


# ---- customers --------------------------------------------------------
def encode_customer_id(df: DataFrame, id_column: str) -> DataFrame:
    """Whole-number ids stay; other ids get codes 1..n by sorted value, original kept."""
    bad = df.agg(F.expr(f"count_if({id_column} IS NOT NULL AND try_cast({id_column} AS bigint) IS NULL) AS b")).first()["b"]
    if bad == 0:
        return df.withColumn(KEY, F.expr(f"try_cast({id_column} AS bigint)"))
    ids = df.select(F.expr(f"cast({id_column} AS string) AS customer_id_original")).where("customer_id_original IS NOT NULL").distinct()
    coded = row_index(cut_lineage(ids), [("customer_id_original", True)], KEY)
    return df.drop(*([KEY] if KEY in df.columns and KEY != id_column else [])).withColumn("customer_id_original", F.expr(f"cast({id_column} AS string)")).drop(
        *([KEY] if id_column == KEY else [])).join(coded, "customer_id_original", "left")


def rfm(df: DataFrame, time: str = "ts", amount: str = "amount") -> DataFrame:
    last = df.agg(F.max(time).alias("_max"))
    g = df.groupBy(KEY).agg(F.max(time).alias("_t"), F.count(time).alias("frequency"), F.expr(f"coalesce(sum(try_cast({amount} AS double)), 0D) AS monetary"))
    return g.crossJoin(F.broadcast(last)).selectExpr(
        KEY, "cast(coalesce(greatest(floor((unix_micros(cast(_max AS timestamp)) - unix_micros(cast(_t AS timestamp))) / 86400000000), 0), 999) AS bigint) AS recency_days", "frequency", "monetary")


def external_features(df: DataFrame, core, order: str) -> tuple[DataFrame, dict]:
    """Every non-core column becomes customer features; kinds are read in one pass, features in one grouping."""
    cols = [c for c in df.columns if c != KEY and c not in core]
    kinds = dict(df.dtypes)
    row = df.agg(*[F.expr(x) for i, c in enumerate(cols) for x in (
        f"avg(CASE WHEN try_cast(cast(`{c}` AS string) AS double) IS NOT NULL THEN 1D ELSE 0D END) AS n{i}",
        f"avg(CASE WHEN cast(`{c}` AS string) RLIKE '{_DATE}' THEN 1D ELSE 0D END) FILTER (WHERE `{c}` IS NOT NULL) AS d{i}")]).first() if cols else None
    aggs, used, texts, named = [], {}, [], slugs(cols)
    for i, c in enumerate(cols):
        s = named[c]
        if kinds[c].startswith(("timestamp", "date")) or (kinds[c] == "string" and (row[f"d{i}"] or 0) >= 0.6):
            t = f"try_cast(`{c}` AS timestamp)"
            aggs += [f"min({t}) AS ext_date__{s}_first", f"max({t}) AS ext_date__{s}_last"]
            used[c] = "datetime"
        elif row[f"n{i}"] >= 0.85:
            aggs += [f"{fn}(try_cast(`{c}` AS double)) AS ext_num__{s}_{n}" for fn, n in (("avg", "mean"), ("sum", "sum"), ("min", "min"), ("max", "max"))]
            used[c] = "numeric"
        else:
            aggs += [f"min_by(`{c}`, {order}) FILTER (WHERE `{c}` IS NOT NULL) AS ext_cat__{s}_mode"]
            texts.append(c)
            used[c] = "categorical"
    out = df.groupBy(KEY).agg(*[F.expr(x) for x in aggs])
    if texts:  # one row for each customer, column and value: a distinct count in the grouping would copy every row for every column
        pairs = ", ".join(f"struct('{named[c]}' AS c, cast(`{c}` AS string) AS x)" for c in texts)
        values = df.select(KEY, F.expr(f"inline(array({pairs}))")).where("x IS NOT NULL").distinct()
        n = values.groupBy(KEY).agg(*[F.expr(f"count_if(c = '{named[c]}') AS ext_num__{named[c]}_nunique") for c in texts])
        out = out.join(n, out[KEY].eqNullSafe(n[KEY]), "left").drop(n[KEY]).na.fill(0, [f"ext_num__{named[c]}_nunique" for c in texts])
    dates = [f"ext_date__{named[c]}_last" for c, k in used.items() if k == "datetime"]
    if dates:
        top = out.agg(*[F.expr(f"max({d}) AS _m_{d}") for d in dates])
        out = out.crossJoin(F.broadcast(top)).withColumns({
            d.replace("ext_date__", "ext_num__").replace("_last", "_days_since_last"): F.expr(f"coalesce((unix_micros(_m_{d}) - unix_micros({d})) / 86400000000D, 999D)") for d in dates}).drop(*[f"_m_{d}" for d in dates])
    return out, used


def attach_external(summary: DataFrame, external: DataFrame) -> DataFrame:
    clash = [c for c in external.columns if c in summary.columns and c not in (KEY, "customer_id_original")]
    return summary.join(external.select(*[F.col(c).alias(f"ext_uploaded__{c}") if c in clash else F.col(c) for c in external.columns]), KEY, "left")


def coalesce_known_columns(summary: DataFrame, df: DataFrame, *, amount: str | None = None, order: str = "ts", domain: str = "ecommerce") -> DataFrame:
    """Common retail and finance columns of the upload mapped to standard customer columns."""
    f = lambda *names: find_column(df, names)
    truth = ", ".join(f"'{w}'" for w in words.TRUE_WORDS)
    flag = lambda c: (f"sum(CASE WHEN try_cast(cast(`{c}` AS string) AS double) IS NOT NULL THEN cast(try_cast(cast(`{c}` AS string) AS double) > 0 AS int) "
                      f"ELSE cast(lower(trim(coalesce(cast(`{c}` AS string), ''))) IN ({truth}) AS int) END)")
    num = lambda fn, c: f"{fn}(try_cast(cast(`{c}` AS string) AS double))"
    agg: dict[str, str] = {}
    disc, exposure = f("discount_amount", "discount", "coupon_discount"), f("coupon_exposure", "coupon_exposed", "coupon_sent", "coupon_offer", "promotion_exposure", "campaign_exposure")
    redeem, campaign = f("coupon_used", "coupon_use", "coupon_redeemed", "coupon_redemption", "redeemed_coupon"), f("campaign_id", "campaign", "campaign_name", "promotion_id", "coupon_id")
    plain = {"_freq": ("max", f("total_order_count", "order_count", "orders_count", "purchase_count")), "_reg": ("max", f("days_since_registration", "customer_age_days", "days_from_signup")),
             "avg_session_duration_sec_uploaded": ("avg", f("session_duration_sec", "session_duration", "duration_sec")), "pageviews_per_session_uploaded": ("avg", f("page_views", "pageviews", "views")),
             "discount_amount_total": ("sum", disc), "point_used_total": ("sum", f("point_used", "points_used", "mileage_used")), "_amount": ("sum", amount)}
    if domain == "finance":
        plain |= {"account_balance_current": ("max", f("account_balance", "balance", "current_balance")), "credit_score": ("max", f("credit_score")), "delinquency_days": ("max", f("delinquency_days", "days_past_due", "dpd"))}
    agg |= {k: num(fn, c) for k, (fn, c) in plain.items() if c}
    if exposure or campaign:
        agg["coupon_exposure_count"] = flag(exposure) if exposure else f"count_if(trim(coalesce(cast(`{campaign}` AS string), '')) <> '')"
    if redeem or disc:
        agg["coupon_redeem_count"] = flag(redeem or disc)
    modes = {"_channel": f("access_channel", "channel", "device", "platform"), "gender": f("gender"), "age_group": f("age_group", "age_band", "age_range"), "payment_method": f("payment_method"),
             "delivery_type": f("delivery_type", "shipping_type"), "refund_reason": f("refund_reason", "return_reason", "cancel_reason")}
    per = df.groupBy(KEY).agg(*[F.expr(f"{e} AS {k}") for k, e in agg.items()], F.max(order).alias("_last")) if agg else df.groupBy(KEY).agg(F.max(order).alias("_last"))
    for out_name, c in modes.items():
        if c:
            n = df.where(F.col(c).isNotNull()).groupBy(KEY, F.expr(f"cast(`{c}` AS string) AS v")).agg(F.count(F.lit(1)).alias("n"))
            per = per.join(n.groupBy(KEY).agg(F.expr(f"min_by(v, struct(-n, v)) AS {out_name}")), KEY, "left")
    base = summary.drop(*[c for c in per.columns if c in summary.columns and c != KEY])
    out = base.join(per, KEY, "left")
    have = set(out.columns)
    z = lambda c, d="0D": f"coalesce({c}, {d})" if c in have else d
    steps: dict[str, str] = {}
    if "_amount" in have:
        steps["monetary"] = "coalesce(_amount, 0D)"
    if "_freq" in have:
        steps["frequency"] = f"cast(greatest({z('frequency', '0')}, coalesce(_freq, 0)) AS bigint)"
    if "_reg" in have:
        top = df.agg(F.expr(f"date_trunc('day', max({order})) AS _base"))
        out = out.crossJoin(F.broadcast(top))
        steps["customer_age_days_uploaded"] = "greatest(coalesce(_reg, 0D), 0D)"
        steps["signup_date"] = "cast(_base AS timestamp_ntz) - make_dt_interval(cast(customer_age_days_uploaded AS int))"
    if "_channel" in have:
        steps["acquisition_channel"] = "coalesce(_channel, 'unknown')"
        steps["device_type"] = "CASE WHEN lower(acquisition_channel) RLIKE 'mobile|app|ios|android' THEN 'mobile' WHEN lower(acquisition_channel) RLIKE 'web|pc|desktop' THEN 'web' ELSE acquisition_channel END"
    if "discount_amount_total" in have:
        steps["discount_amount_total"] = "coalesce(discount_amount_total, 0D)"
        steps["discount_dependency_score"] = bound(f"discount_amount_total / greatest({z('_amount')}, 1D)", "0D", "1D")
        steps["price_sensitivity"] = bound("0.35 + 0.8 * discount_dependency_score", "0D", "1D")
        steps["coupon_affinity"] = bound("0.30 + 0.7 * discount_dependency_score", "0D", "1D")
    if "coupon_exposure_count" in have:
        steps["coupon_exposure_count"] = f"greatest(coalesce(coupon_exposure_count, 0), {z('coupon_redeem_count', '0')})"
        steps["coupon_fatigue_score"] = bound("coupon_exposure_count / 3D", "0D", "2D")
    if "coupon_redeem_count" in have:
        steps["coupon_redeem_count"] = "coalesce(coupon_redeem_count, 0)"
        shown = "coupon_exposure_count" if "coupon_exposure_count" in have else "coupon_redeem_count"
        steps["coupon_redeem_rate_uploaded"] = f"coupon_redeem_count / greatest({shown}, 1)"
    dep = "discount_dependency_score" if "discount_dependency_score" in steps else "0D"
    fat = "coupon_fatigue_score / 2" if "coupon_fatigue_score" in steps else "0D"
    steps["discount_pressure_score"] = bound(f"0.65 * {dep} + 0.35 * {fat}", "0D", "1D")
    steps["discount_effect_penalty"] = bound("1 - 0.25 * discount_pressure_score", 0.50, "1D")
    if "refund_reason" in have:
        steps["refund_reason"] = "coalesce(refund_reason, 'none')"
        steps["support_contact_propensity"] = f"CASE WHEN lower(refund_reason) NOT IN ('', 'none', 'nan', 'no', '없음') THEN greatest({z('support_contact_propensity', '0.1D')}, 0.65D) ELSE {z('support_contact_propensity', '0.1D')} END"
    if "delinquency_days" in have:
        steps["service_contact_propensity"] = f"CASE WHEN coalesce(delinquency_days, 0) > 0 THEN greatest({z('support_contact_propensity', '0.1D')}, 0.55D) ELSE {z('support_contact_propensity', '0.1D')} END"
        steps["support_contact_propensity"] = "service_contact_propensity"
    if "credit_score" in have:
        steps["credit_risk_score"] = bound("(750 - coalesce(credit_score, 700D)) / 350D", "0D", "1D")
    if "account_balance_current" in have:
        steps["balance_value_score"] = bound("log1p(greatest(coalesce(account_balance_current, 0D), 0D)) / 16D", "0D", "1D")
    out = chain(out, **steps)
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def finance_aliases(df: DataFrame, table: str) -> DataFrame:
    have = set(df.columns)
    new = {} if "financial_customer_id" in have or KEY not in have else {"financial_customer_id": KEY}
    if table == "events":
        kind = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.FINANCE_EVENT_LABELS.items()) + " ELSE '기타 금융활동' END"
        new |= {"transaction_time": "timestamp", "financial_event_type": kind}
    for src, dst in words.FINANCE_ALIASES.get("customer_summary" if table == "customers" else table, {}).items():
        if src in have and dst not in have:
            new[dst] = src
    return add(df, **new)


def dedupe_summary(df: DataFrame, order: str) -> DataFrame:
    """One row per customer: rates averaged, money and counts at their maximum, everything else from the last row."""
    aggs = []
    for c, t in df.dtypes:
        if c == KEY:
            continue
        numeric = t in ("int", "bigint", "double", "float")
        if numeric and any(k in c for k in ("probability", "score", "rate", "roi", "affinity", "sensitivity", "propensity")):
            aggs.append(f"avg({c}) AS {c}")
        elif numeric and any(k in c for k in ("monetary", "amount", "clv", "cost", "profit", "frequency", "count", "total")):
            aggs.append(f"max({c}) AS {c}")
        else:
            aggs.append(f"max_by({c}, {order}) AS {c}")
    return df.groupBy(KEY).agg(*[F.expr(x) for x in aggs])


def infer_churn_label(df: DataFrame, *, flag: str | None = None, time: str = "ts", threshold: int = 30, domain: str = "ecommerce") -> DataFrame:
    """Uploaded flag per customer if given, else silence of the threshold or longer."""
    if flag:
        v = f"lower(trim(cast({flag} AS string)))"
        value = "CASE " + " ".join(f"WHEN {v} = '{k}' THEN {x}D" for k, x in words.CHURN_VALUES.items()) + f" ELSE least(greatest(coalesce(try_cast({v} AS double), 0D), 0D), 1D) END"
        if domain == "finance":
            value = f"CASE WHEN {v} IN ({', '.join(chr(39) + w + chr(39) for w in words.FINANCE_CHURN_VALUES)}) THEN 1D ELSE {value} END"
        return df.groupBy(KEY).agg(F.expr(f"max({value}) AS churn_label"))
    last = df.agg(F.max(time).alias("_max"))
    g = df.groupBy(KEY).agg(F.max(time).alias("_t"))
    return g.crossJoin(F.broadcast(last)).selectExpr(KEY, f"CASE WHEN coalesce(floor((unix_micros(cast(_max AS timestamp)) - unix_micros(cast(_t AS timestamp))) / 86400000000), 999) >= {threshold} THEN 1D ELSE 0D END AS churn_label")


def estimate_churn_probability(df: DataFrame, label: str | None = None) -> DataFrame:
    """Weighted ranks on a logit scale. Ties are spread by a hash of the customer, never at random."""
    have = set(df.columns)
    z = lambda c, d="0D": f"coalesce(cast({c} AS double), {d})" if c in have else d
    tie = f"(pmod(xxhash64({KEY}), 1000003) / 1000003D)"
    src = {"_rec": z("recency_days"), "_ina": z("inactivity_days") if "inactivity_days" in have else z("recency_days"), "_fre": z("frequency"), "_mon": z("monetary")}
    eng = [c for c in ("avg_session_duration_sec_uploaded", "pageviews_per_session_uploaded") if c in have]
    df = shared(df)
    ranks = pct_ranks(df, KEY, {**{k: f"{e} + 1e-7 * {tie}" for k, e in src.items()}, **{f"_e{i}": c for i, c in enumerate(eng)}})
    d = df.join(ranks, KEY)
    e = "0.5D"
    for i in range(len(eng)):
        e = f"(0.5 * {e} + 0.5 * (1 - coalesce(_e{i}, 0.5D)))"
    d = d.withColumn("_b", F.expr(bound(f"0.28 * _rec + 0.20 * _ina + 0.16 * (1 - _fre) + 0.12 * (1 - _mon) + 0.12 * {bound(z('support_contact_propensity', '0.1D'), '0D', '1D')} "
                                        f"+ 0.06 * {bound(z('discount_dependency_score'), '0D', '1D')} + 0.06 * {e}", 0.01, 0.99)))
    d = cut_lineage(d)
    lab = f"coalesce(cast({label} AS double), _rate)" if label else None
    mean = d.agg(F.avg("_b").alias("_mean"), F.expr(f"avg(cast({label} AS double)) AS _raw" if label else "cast(NULL AS double) AS _raw"))
    d = d.crossJoin(F.broadcast(mean)).withColumn("_rate", F.expr(bound("coalesce(_raw, 0D)", 0.03, 0.97) if label else bound("0.06 + 0.34 * _mean", 0.08, 0.36)))
    r2 = pct_ranks(d, KEY, {"_sig": f"_b + 0.35 * ({lab} - _rate)" if label else "_b"})
    tail = f"2.35 * (_sig - 0.5) + 1.10 * ({lab} - _rate) + 0.75 * (_b - _mean)" if label else "2.15 * (_sig - 0.5) + 0.65 * (_b - _mean)"
    p = f"1 / (1 + exp(-(ln(_rate / (1 - _rate)) + {tail} + 0.05 * ({tie} - 0.5))))"
    out = d.join(r2, KEY).withColumn("churn_probability", F.expr(bound(p, 0.02, 0.98 if label else 0.82)))
    return out.select(*[c for c in out.columns if not c.startswith("_")])


def assign_persona(df: DataFrame) -> DataFrame:
    df = shared(df)
    ranks = pct_ranks(df, KEY, {"_m": "coalesce(monetary, 0D)", "_f": "coalesce(frequency, 0)"})
    return df.join(ranks, KEY).withColumn("persona", F.expr(
        "CASE WHEN _m >= 0.80 AND _f >= 0.70 THEN 'vip_loyal' WHEN _m >= 0.50 AND _f >= 0.50 THEN 'regular_loyal' WHEN churn_probability >= 0.60 THEN 'churn_progressing' "
        "WHEN recency_days <= 30 AND frequency <= 2 THEN 'new_signup' WHEN _m < 0.30 THEN 'price_sensitive' ELSE 'explorer' END")).drop("_m", "_f")


def assign_uplift_by_median(df: DataFrame) -> DataFrame:
    df = shared(df)
    med = quantile_row(df, {"_med": "coalesce(monetary, 0D)"}, [0.5])
    return df.crossJoin(F.broadcast(med)).withColumn("uplift_segment", F.expr(uplift_by_median("churn_probability", "monetary", "_med_0"))).drop("_med_0")


# ---- events and orders ------------------------------------------------
def extract_events(df: DataFrame, *, time: str = "ts", event_type: str = "event_type", row_id: str = "row_id", category: str | None = None, user_map: dict | None = None) -> DataFrame:
    """Standard events; ids follow (customer, time, source row). A null type is ``other``; only types mapped to ignore or skip are left out."""
    raw = F.col(event_type)
    j = df.where(f"{time} IS NOT NULL AND {KEY} IS NOT NULL").withColumn("raw", raw).withColumn("_std", F.expr(standard_event_type("raw")))
    if user_map:
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in user_map.items())
        j = j.withColumn("_std", F.expr(f"coalesce(try_element_at(map({pairs}), raw), _std)"))
    e = j.where("_std NOT IN ('ignore', 'skip')").selectExpr(
        f"{row_id} AS source_row_id", KEY, f"{time} AS timestamp", "_std AS event_type", "raw AS event_type_original",
        f"concat(cast({KEY} AS string), '-', date_format({time}, 'yyyyMMdd')) AS session_id", f"{f'cast({category} AS string)' if category else chr(39) + 'general' + chr(39)} AS item_category")
    idx = row_index(cut_lineage(e), [(KEY, True), ("timestamp", True), ("source_row_id", True)], "_i")
    return idx.withColumn("event_id", F.expr("concat('EVT-', cast(_i - 1 AS string))")).drop("_i")


def orders_from_events(events: DataFrame, df: DataFrame, *, amount: str = "amount", row_id: str = "row_id") -> DataFrame:
    disc, coupon = find_column(df, ["discount_amount", "discount", "coupon_discount"]), find_column(df, ["coupon_used", "coupon_use", "coupon_redeemed"])
    n = lambda c: f"coalesce(try_cast({c} AS double), 0D)" if c else "0D"
    src = df.selectExpr(f"{row_id} AS source_row_id", f"{n(amount)} AS _a", f"{n(disc)} AS _d", f"cast({n(coupon or disc)} > 0 AS int) AS coupon_used")
    j = events.where("event_type = 'purchase'").join(src, "source_row_id", "left")
    return j.selectExpr("concat('ORD-', substr(event_id, 5)) AS order_id", KEY, "timestamp AS order_time", "item_category", "1 AS quantity", "bround(coalesce(_a, 0D), 2) AS gross_amount",
                        "bround(least(coalesce(_d, 0D), coalesce(_a, 0D)), 2) AS discount_amount", "bround(coalesce(_a, 0D) - least(coalesce(_d, 0D), coalesce(_a, 0D)), 2) AS net_amount",
                        "coalesce(coupon_used, 0) AS coupon_used")


def upload_cohort_retention(customers: DataFrame, events: DataFrame, orders: DataFrame, periods: int = 7) -> DataFrame:
    """Seven months from the first signup of each cohort; three activity definitions."""
    act = events.selectExpr(KEY, "timestamp AS t", "event_type AS k").unionByName(orders.selectExpr(KEY, "order_time AS t", "'purchase' AS k")).where("t IS NOT NULL")
    co = customers.groupBy("acquisition_month").agg(F.count(F.lit(1)).alias("cohort_size"), F.min("signup_date").alias("_start"))
    grid = co.selectExpr("acquisition_month", "cohort_size", "_start", f"explode(sequence(0, {periods - 1})) AS period").withColumn("_lo", F.expr("_start + make_ym_interval(0, period)")).withColumn(
        "_hi", F.expr("_start + make_ym_interval(0, period + 1)"))
    daily = act.groupBy(KEY, F.expr("to_date(t) AS d"), "k", "t").agg(F.lit(1).alias("_one")).join(customers.select(KEY, "acquisition_month"), KEY)
    hit = daily.join(F.broadcast(grid.select("acquisition_month", "period", "_lo", "_hi")), "acquisition_month").where("t >= _lo AND t < _hi")
    per = hit.groupBy("acquisition_month", "period", KEY).agg(F.expr("bool_or(k = 'purchase') AS p"), F.expr("bool_or(k IN ('visit', 'page_view', 'search', 'add_to_cart', 'purchase')) AS c"))
    n = per.groupBy("acquisition_month", "period").agg(F.count(F.lit(1)).alias("n_all"), F.expr("count_if(p) AS n_buy"), F.expr("count_if(c) AS n_core"))
    j = grid.join(n, ["acquisition_month", "period"], "left")
    rows = ", ".join(f"struct('{d}' AS activity_definition, '{m}' AS retention_mode, CASE WHEN period = 0 THEN cohort_size ELSE coalesce({c}, 0) END AS retained_customers)"
                     for d, c in (("all_activity", "n_all"), ("purchase_only", "n_buy"), ("core_engagement", "n_core")) for m in ("rolling", "point"))
    return j.selectExpr("acquisition_month AS cohort_month", "period", "cohort_size", f"inline(array({rows}))").selectExpr("*", "retained_customers / greatest(cohort_size, 1) AS retention_rate")


def customer_cycles(rows: DataFrame) -> DataFrame:
    """Rows of each customer and the mean of their gaps of more than 0 and at most 365 days, from times ``t``.

    Gaps inside a day are added up beside its rows; one row per customer and day then has the
    gap to the day before, so that the times are sorted once. Equal times are gaps of zero.
    """
    micros = lambda a, b: f"unix_micros(cast({a} AS timestamp)) - unix_micros(cast({b} AS timestamp))"
    fits = "> 0 AND {0} <= 365 * 86400000000"
    inside = rows.select(KEY, "t", F.to_date("t").alias("_day")).withColumn("_p", F.lag("t").over(W.partitionBy(KEY, "_day").orderBy("t"))).withColumn("_g", F.expr(micros("t", "_p")))
    days = inside.groupBy(KEY, "_day").agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_first"), F.max("t").alias("_last"), *[
        F.expr(f"{x} FILTER (WHERE _g {fits.format('_g')}) AS {k}") for x, k in (("sum(_g)", "_sum"), ("count(1)", "_gaps"))])
    days = days.withColumn("_before", F.lag("_last").over(W.partitionBy(KEY).orderBy("_day"))).withColumn("_b", F.expr(micros("_first", "_before")))
    per = days.groupBy(KEY).agg(F.sum("_n").alias("rows"), F.expr(f"coalesce(sum(_sum), 0) + coalesce(sum(_b) FILTER (WHERE _b {fits.format('_b')}), 0) AS _sum"),
                                F.expr(f"sum(_gaps) + count_if(_b {fits.format('_b')}) AS _gaps"))
    return per.selectExpr(KEY, "rows", "CASE WHEN _gaps > 0 THEN _sum / 86400000000D / _gaps END AS cycle")


def recommend_churn_days(df: DataFrame, *, time: str = "ts", event_type: str | None = None) -> DataFrame:
    """1.75 x the median of the customers' mean gaps, 7..180 days; purchases alone when there are at least twenty.

    All rows are only gone through if the purchases do not suffice.
    """
    base = df.select(KEY, F.col(time).alias("t"), *[F.col(x).alias("_type") for x in [event_type] if x]).where(f"t IS NOT NULL AND {KEY} IS NOT NULL")
    cyc = None
    if event_type:
        cyc = cut_lineage(customer_cycles(base.where("_type = 'purchase'")))
        facts = cyc.agg(F.sum("rows").alias("rows"), F.count("cycle").alias("customers")).first()  # one row
        if (facts["rows"] or 0) < 20 or facts["customers"] < 3:
            cyc = None
    if cyc is None:
        cyc = cut_lineage(customer_cycles(base))
    med = exact_quantiles(cyc, {"c": "cycle"}, [0.5]).crossJoin(F.broadcast(cyc.agg(F.count("cycle").alias("customers")))).where("customers >= 3")
    return med.agg(F.max("q_0").alias("q")).selectExpr("q AS median_cycle_days", "cast(least(greatest(bround(q * 1.75, 0), 7), 180) AS bigint) AS churn_days")


def summary_scores(df: DataFrame, *, domain: str = "ecommerce") -> DataFrame:
    """Lifetime value, incremental profit and ROI of the uploaded summary."""
    cost = {"coupon_cost": bound("0.0025 * monetary", "3000D", "30000D")} if domain == "finance" else {}
    return chain(
        df, _aov="CASE WHEN frequency > 0 THEN monetary / frequency ELSE 0D END",
        clv="greatest(monetary * (1.30 + 1.25 * least(greatest(1.15 - churn_probability, 0.20), 1.15)) + frequency * greatest(_aov, 20000D) * 0.55, 15000D)",
        **cost, expected_incremental_profit="greatest(clv * uplift_score, -50000D)",
        expected_roi="CASE WHEN coupon_cost <> 0 THEN (expected_incremental_profit - coupon_cost) / coupon_cost ELSE 0D END").drop("_aov")


# ---- the whole chain --------------------------------------------------
def preprocess(df: DataFrame, *, id_column: str, time: str, event_type: str, amount: str, row_id: str, category: str | None = None, threshold: int = 30, domain: str = "ecommerce") -> dict[str, DataFrame]:
    """Upload to standard tables: no loop over rows or customers anywhere."""
    up = cut_lineage(encode_customer_id(df, id_column).withColumn("ts", F.expr(f"try_cast({time} AS timestamp_ntz)")))
    ev = extract_events(up, event_type=event_type, row_id=row_id, category=category)
    od = orders_from_events(ev, up, amount=amount, row_id=row_id)
    ext, _ = external_features(up, [id_column, time, "ts", event_type, row_id, "customer_id_original"], row_id)
    base = rfm(up, amount=amount).withColumn("inactivity_days", F.col("recency_days"))
    base = coalesce_known_columns(base, up, amount=amount, domain=domain)
    first = up.groupBy(KEY).agg(F.min("ts").alias("_first"))
    base = base.join(first, KEY, "left")
    base = base.withColumn("signup_date", F.expr("coalesce(signup_date, _first)") if "signup_date" in base.columns else F.col("_first")).drop("_first").withColumn("acquisition_month", F.date_format("signup_date", "yyyy-MM"))
    base = estimate_churn_probability(base.join(infer_churn_label(up, threshold=threshold).withColumnRenamed("churn_label", "churn_label_observed"), KEY, "left"))
    base = assign_uplift_by_median(assign_persona(cut_lineage(base)))
    base = summary_scores(add(base, uplift_score="0.02 + 0.22 * churn_probability", coupon_cost="5000D"), domain=domain)
    summary = cut_lineage(attach_external(base, ext))
    if domain == "finance":
        summary, ev, od = finance_aliases(summary, "customer_summary"), finance_aliases(ev, "events"), finance_aliases(od, "orders")
    from .snapshots import activity_snapshots

    cu = summary.select(KEY, "persona", "signup_date", "acquisition_month")
    return {"customers": cu, "customer_summary": summary, "events": ev, "orders": od,
            "state_snapshots": activity_snapshots(summary.select(KEY, "signup_date", "frequency", "monetary"), ev, od, threshold=threshold),
            "cohort_retention": upload_cohort_retention(cu, ev, od),
            "treatment_assignments": cu.selectExpr(KEY, f"cast(pmod(xxhash64({KEY}), 2) AS int) AS treatment_flag"),
            "event_mapping": event_mapping_report(up.select(F.col(event_type).alias("raw")))}


