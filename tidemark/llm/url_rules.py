"""URL verdicts: a fixed list of host and path rules, then association rules mined from labelled pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, let

#: Verdict, host and path prefix of a rule.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "label=block"
#: Share of the labelled pages, and their number, that must hold a combination; share of those that must be bad; times the usual share.
SUPPORT, LEAST, CONFIDENCE, LIFT = 0.005, 8, 0.6, 1.5
BROADCAST_ROWS = 200_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, verdict = F.when(fits, rh + rp).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, words of the path with digits as ``#``, names of query parameters."""
    labels = F.transform(F.filter(F.split(host(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(F.lower(path(url)), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda x: F.concat(F.lit("query="), x))
    return F.array_distinct(F.concat(labels, parts, names))


def mine(pages: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Combinations of tokens that point to bad pages: ``anchor, antecedent, confidence``; None without any.

    A page's label is the row of ``labels`` with its id: bad if quality is 0 or toxic is 1.
    Rules are combinations that reach the support among bad pages, the confidence and the
    lift.  Every token of every labelled URL is counted.  A token that is a rule by itself
    needs no combination, and its pages are explained by it: combinations are mined from the
    others.  A token that is no more frequent on bad pages than elsewhere, or too rare among
    them, says nothing in one; FP-growth sees all others.  Tokens that always come together
    are one item of it, so that URLs of many tokens cannot make it enumerate the same rule
    over and over, and any of them stands for the item in other URLs: an antecedent lists the
    tokens of each of its items.  The anchor is a token of the item of a rule that is rarest
    in the labelled pages; a rule has a row for each such token.
    """
    bad = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.expr("quality = 0 OR coalesce(toxic, 0) = 1")).alias("bad"))
    known = scratch.keep(pages.select("page_id", tokens(F.col("url")).alias("items")).join(bad, F.col("page_id") == F.col("_id")).select(F.monotonically_increasing_id().alias("rid"), "items", "bad"), "labelled")
    n = known.count()
    if not n or known.where("bad").isEmpty():
        return None
    usual = known.where("bad").count() / n
    support = max(SUPPORT, LEAST / n)
    own = F.col("bad").cast("int")
    seen = known.select(F.xxhash64("rid").alias("page"), own.alias("bad"), F.explode("items").alias("t"))
    # pages of a token by number, bad ones, and as two sums of hashes that tell sets of pages apart
    counts = seen.groupBy("t").agg(F.count("*").alias("n"), F.sum("bad").alias("b"), F.sum(F.col("page").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("page", F.lit(1))).alias("s2"))
    counts = scratch.keep(counts.where(F.col("b") >= support * n).withColumn("share", F.col("b") / F.col("n")), "tokens")  # 1 / support times the tokens of a bad page at most
    is_rule = (F.col("share") >= CONFIDENCE) & (F.col("share") >= LIFT * usual)
    alone = counts.where(is_rule).select(F.col("t").alias("anchor"), F.array(F.array("t")).alias("antecedent"), F.col("share").alias("confidence"))
    open_ = scratch.keep(counts.where(~is_rule & (F.col("share") > usual * (1 + 1e-9))).groupBy("n", "b", "s1", "s2").agg(F.min("t").alias("t"), F.array_sort(F.collect_list("t")).alias("alike")), "items")
    told = seen.join(counts.where(is_rule).select("t"), "t").select("page").distinct()
    kept = seen.select("page", "bad", "t").join(open_.select("t"), "t").join(told, "page", "left_anti").groupBy("page", "bad").agg(F.collect_set("t").alias("items"))
    baskets = kept.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items"))
    rules = alone
    baskets = scratch.keep(baskets, "baskets")
    here = baskets.count()  # pages without such a token take no part: shares are of those that do
    if here >= support * n:
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / here), minConfidence=CONFIDENCE).fit(baskets)
        more = found.associationRules.where(F.col("consequent") == F.array(F.lit(LABEL))).where(F.col("confidence") >= LIFT * usual)
        more = scratch.keep(more.select(F.monotonically_increasing_id().alias("rule_id"), "antecedent", "confidence"), "combinations")
        items = more.select("rule_id", "confidence", F.explode("antecedent").alias("t")).join(open_, "t")
        whole = items.groupBy("rule_id").agg(F.first("confidence").alias("confidence"), F.collect_list("alike").alias("antecedent"), F.min(F.struct("n", "t", "alike"))["alike"].alias("anchors"))
        rules = rules.unionByName(whole.select(F.explode("anchors").alias("anchor"), "antecedent", "confidence"))
    rules = scratch.keep(rules, "index")
    return None if rules.isEmpty() else rules


def judge(pages: DataFrame, labels: DataFrame, scratch: Scratch | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    The longest listed rule that fits decides (a tie goes to the later one of the list);
    else a URL that holds all tokens of a mined rule is blocked, the rest allowed.  Mined
    rules are found through an index of their rarest token.  Null URLs and those without
    ``://`` have no host and path, fit no rule and, without a token, are allowed.  Repeated
    rows stay; other columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    rows = pages.select("page_id", "url")
    index = mine(rows, labels, scratch)
    if index is None:
        bad = rows.select("page_id", "url", F.lit(False).alias("hit"))
    else:
        small = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
        urls = rows.select("url").where("url IS NOT NULL").distinct()
        open_urls = urls.where(listed(host(F.col("url")), path(F.col("url")), rules)[1].isNull())
        probes = open_urls.select("url", F.explode_outer(let(tokens(F.col("url")), lambda t: F.transform(t, lambda x: F.struct(x.alias("t"), t.alias("all"))))).alias("p"))
        hits = probes.join(small, F.col("p.t") == F.col("anchor")).where(F.forall("antecedent", lambda alike: F.arrays_overlap(alike, F.col("p.all")))).select(F.col("url").alias("_url")).distinct()
        hits = scratch.keep(hits, "hits")
        bad = rows.join(hits, F.col("url") == F.col("_url"), "left").select("page_id", "url", F.col("_url").isNotNull().alias("hit"))
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = listed(h, p, rules)
    return bad.select("page_id", h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))
