"""Quality rules: fixed counts per document, then a hashed n-gram likelihood ratio against the trusted part of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, Scratch, let, once, rows_of, unpacked, words

WINDOW = 5
MIN_WORDS = 10
#: Percent of the words that may lie in repeated windows.
MAX_REPEAT = 20
SYMBOLS = "#*$%&|<>"

BUCKETS = 1 << 14
#: Digits of a score that a threshold tells apart; they bound the levels that are counted for it.
DIGITS = 4
#: Blocks of 32,768 neighbouring ids whose labels are broadcast as bits (12 KB a block); with ids further apart labels are joined.
BIT_BLOCKS = 4_096
#: Which labels make a side.
SIDES = {"good": "quality = 1 AND coalesce(toxic, 0) = 0", "bad": "quality = 0", "toxic": "toxic = 1"}
#: Toxic n-grams that are kept, the documents that must hold one, and how many of a document's decide.
TOXIC_GRAMS, TOXIC_LEAST, TOXIC_TOP = 512, 3, 3
#: Pseudo-count of a bucket: how many expected occurrences it takes to trust a ratio.
PRIOR = 5.0
#: Share of trusted documents that the threshold may reject.
FALSE_REJECTS = 0.002


def base_counts(w: Column, text: Column, pairs: Column | None = None) -> list[Column]:
    """The counts of the contract from a text and its words; ``pairs`` are ``_pairs(w)`` if they are there already."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.btrim(s, F.lit(SPACE)) != "")
    n = F.size(w)
    shorter = let(_pairs(w) if pairs is None else pairs, _joined_pairs)
    repeats = let(shorter, lambda q: _unless_distinct(q, let(_neighbours(q), lambda h: _unless_distinct(h, _covered(h)))))
    return [
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.when(n < WINDOW, F.lit(0)).otherwise(repeats).cast("long").alias("n_repeat_words"),
    ]


def _neighbours(x: Column, gap: int = 1) -> Column:
    """Hashes of every two elements that are ``gap`` apart."""
    n = F.greatest(F.size(x) - gap, F.lit(0))
    return F.zip_with(F.slice(x, 1, n), F.slice(x, gap + 1, n), lambda a, b: F.xxhash64(a, b))


def _pairs(w: Column) -> Column:
    """Hashes of the pairs of neighbouring words."""
    return _neighbours(w)


def _joined_pairs(pairs: Column) -> Column:
    """Hashes of the windows of four words, one less than WINDOW, from those of two: without a repeated one no longer window is repeated."""
    return _neighbours(pairs, 2)


def _unless_distinct(h: Column, use: Column) -> Column:
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(use)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs again: positions of such windows, five words each, overlaps once."""
    def repeated(s: Column) -> Column:
        again = F.filter(s, lambda x, j: F.get(s, j + 1)["h"].eqNullSafe(x["h"]) | F.get(s, j - 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(again["i"])

    def length(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i"))), lambda s: let(repeated(s), length))


def _singles(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _grams(w: Column) -> Column:
    """Hashes of the single words and of the pairs of neighbours."""
    return F.concat(_singles(w), _pairs(w))


def _each_gram(docs: DataFrame, grams: Column) -> DataFrame:
    """A row ``h`` for each of a document's n-grams, beside the columns of ``docs`` but its text.

    They are a column first, so that compiled code makes the rows of them; ``explode`` would add a filter that computes them again.
    """
    kept = [c for c in docs.columns if c != "text"]
    return once(docs, grams.alias("_g")).select(*kept, F.explode_outer("_g").alias("h")).where("h IS NOT NULL")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _literal(values, kind: str) -> Column:
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


@dataclass(frozen=True)
class Model:
    """Log ratio per bucket and the least score that is kept; toxic n-grams with their weights and the least toxic score that is not.

    No threshold keeps everything.
    """

    weights: tuple[float, ...]
    threshold: float | None
    toxic: tuple[tuple[int, float], ...] = ()
    toxic_threshold: float | None = None

    def score(self, grams: Column) -> Column:
        """Mean log ratio of a document's n-grams; null without a word."""
        table = _literal((f"{x:.4f}" for x in self.weights), "double")
        return F.when(F.size(grams) > 0, F.aggregate(grams, F.lit(0.0), lambda a, h: a + F.get(table, _bucket(h))) / F.size(grams))

    def held(self, grams: Column) -> Column:
        """The toxic n-grams among a document's."""
        return F.array_intersect(grams, _literal((str(h) for h, _ in self.toxic), "bigint")) if self.toxic else F.array().cast("array<bigint>")

    def toxic_score(self, held: Column) -> Column:
        """Sum of the TOXIC_TOP largest weights of the toxic n-grams that a document holds, however long it is."""
        if not self.toxic:
            return F.lit(0.0)
        keys, values = _literal((str(h) for h, _ in self.toxic), "bigint"), _literal((f"{x:.4f}" for _, x in self.toxic), "double")
        weights = F.transform(held, lambda h: F.get(values, (F.array_position(keys, h) - 1).cast("int")))
        return F.aggregate(F.slice(F.sort_array(weights, asc=False), 1, TOXIC_TOP), F.lit(0.0), lambda a, x: a + x)


def _toxic_grams(part: DataFrame) -> tuple[tuple[int, float], ...]:
    """N-grams that more of the toxic documents hold than of the trusted ones, with the log ratio of the two shares; the most telling TOXIC_GRAMS."""
    n_toxic, n_good = part.agg(*[F.count_if(F.array_contains("sides", x)) for x in ("toxic", "good")]).first()
    told = part.where(F.arrays_overlap("sides", F.array(F.lit("toxic"), F.lit("good"))))
    flags = told.select(F.array_contains("sides", "toxic").alias("toxic"), F.array_contains("sides", "good").alias("good"), "text")
    held = _each_gram(flags, F.array_distinct(let(words(F.col("text")), _grams)))
    counts = held.groupBy("h").agg(F.count_if("toxic").alias("t"), F.count_if("good").alias("g")).where(F.col("t") >= min(TOXIC_LEAST, n_toxic))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("g") + 0.5) / (n_good + 1))
    top = counts.select("h", "t", weight.alias("w")).where("w > 0").orderBy((F.col("t") * F.col("w")).desc(), "h").limit(TOXIC_GRAMS)
    return tuple((r.h, round(r.w, 4)) for r in top.collect())


def _parting(good: dict[float, int], bad: dict[float, int]) -> float | None:
    """The level below which a score is bad: least sum of error rates among those that reject at most FALSE_REJECTS of the good. Scores come with their numbers."""
    if not good or not bad:
        return None
    levels = np.array(sorted({*good, *bad}))
    below_of = lambda side: (lambda n: (np.cumsum(n) - n) / n.sum())(np.array([side.get(x, 0) for x in levels.tolist()], float))
    wrong, caught = below_of(good), below_of(bad)
    allowed = np.flatnonzero(wrong <= FALSE_REJECTS)
    best = allowed[np.argmax((caught - wrong)[allowed])]
    below = levels[best - 1] if best else levels[best] - 1.0
    return float(round((levels[best] + below) / 2, 6))


def _sided(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, text`` of every document with a flag for each side of SIDES; texts are only shuffled if the ids lie far apart."""
    ids = labels.where("doc_id IS NOT NULL")
    bits = scratch.keep(ids.groupBy(F.bitmap_bucket_number("doc_id").alias("_block")).agg(*[F.expr(f"bitmap_construct_agg(bitmap_bit_position(doc_id)) FILTER (WHERE {x})").alias(f"_{side}") for side, x in SIDES.items()]), "bits")
    rows = docs.select("doc_id", "text")
    if bits.count() <= BIT_BLOCKS:
        at = "bitmap_bit_position(doc_id)"
        held = lambda side: f"coalesce(bit_get(cast(conv(hex(substring(_{side}, cast({at} div 8 AS int) + 1, 1)), 16, 10) AS int), cast({at} % 8 AS int)) = 1, false) AS {side}"
        return rows.withColumn("_block", F.bitmap_bucket_number("doc_id")).join(F.broadcast(bits), "_block", "left").selectExpr("doc_id", "text", *[held(side) for side in SIDES])
    flags = ids.groupBy("doc_id").agg(*[F.expr(f"bool_or(coalesce({x}, false)) AS {side}") for side, x in SIDES.items()])
    return rows.join(flags, "doc_id", "left").selectExpr("doc_id", "text", *[f"coalesce({side}, false) AS {side}" for side in SIDES])


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Trusted against raw multinomials over hashed n-grams.

    Raw counts come from every document, trusted counts from every one that is labelled good
    and not toxic; one pass over the texts makes both, and only bucket counts leave a task.
    Ratio of a bucket: (trusted count + prior) over (expected trusted count + prior).  The
    threshold is the score, to DIGITS, that best parts all trusted documents and all of low
    quality (least sum of error rates), among those that reject at most FALSE_REJECTS of the
    trusted ones.  Without trusted documents nothing is judged by it.

    Documents labelled toxic, whatever their quality, have a model of their own, since a few
    words make them so: the n-grams are found on one half of the labelled documents and the
    threshold is set on the other by the same rule (on all of them if a half has no toxic document).
    """
    marked = _sided(docs, labels, scratch)
    grams = let(words(F.col("text")), _grams)
    each = _each_gram(marked.select(F.when(F.col("good"), 1).alias("good"), "text"), grams)
    counted = each.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():  # BUCKETS rows at most
        raw[r.b], good[r.b] = r.raw, r.good
    if not good.sum():
        return Model((0.0,) * BUCKETS, None)
    weights = np.log((good + PRIOR) / (raw * (good.sum() / raw.sum()) + PRIOR))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    sides = F.filter(F.array(*[F.when(F.col(side), F.lit(side)) for side in SIDES]), lambda x: x.isNotNull())
    part = marked.where(" OR ".join(SIDES)).select(half.alias("half"), "text", sides.alias("sides"))
    halves = {r.half for r in part.where(F.array_contains("sides", "toxic")).select("half").distinct().collect()}
    learn, held_out = (part.where("half"), F.expr("NOT half")) if len(halves) == 2 else (part, F.lit(True))
    model = Model(tuple(weights.round(4).tolist()), None, _toxic_grams(learn) if halves else ())
    made = let(grams, lambda g: F.struct(F.round(model.score(g), DIGITS).alias("s"), g.alias("g")))
    found = once(once(part.select("sides", "text", held_out.alias("held_out")), made.alias("_m")), model.held(F.col("_m.g")).alias("_held"))
    scored = once(found, F.struct(F.col("_m.s").alias("s"), F.round(model.toxic_score(F.col("_held")), DIGITS).alias("t")).alias("m")).where("m.s IS NOT NULL")
    each = scored.select(F.explode("sides").alias("side"), F.expr("m.s AS s"), F.expr("CASE WHEN held_out THEN m.t END AS t")).select("side", F.expr("inline(array(struct('s' AS kind, s AS v), struct('t' AS kind, t AS v)))"))
    levels: dict = {}
    for r in each.where("v IS NOT NULL").groupBy("side", "kind", "v").count().collect():  # scores to DIGITS
        levels.setdefault((r.side, r.kind), {})[r.v] = r["count"]
    threshold = _parting(levels.get(("good", "s"), {}), levels.get(("bad", "s"), {}))
    turned = lambda side: {-v: n for v, n in levels.get((side, "t"), {}).items()}
    limit = _parting(turned("good"), turned("toxic")) if model.toxic else None
    return Model(model.weights, threshold, model.toxic, None if limit is None else -limit)


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``score`` and ``kept``.

    A document fails the base rules with under ten words or with over a fifth of its words
    in repeated windows; the others are kept if their score reaches the model's threshold
    and their toxic n-grams stay within theirs.
    Null or empty text has no words and fails.  Each row is judged by itself, so repeated
    rows and ids get the same verdict.  Columns of ``docs`` with the names of the results
    are replaced; ``kept_rows`` leaves them as they are.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
    mine = [c for c in docs.columns if c.lower() not in (*names, "base_failed", "kept")]
    out = _judged(docs, labels, scratch)
    return out.select(*unpacked(mine), *[f"_q.{c}" for c in names], "base_failed", "kept")


def kept_rows(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with just their own columns."""
    out = _judged(docs, labels, scratch).where("kept")
    return out.select(*unpacked(docs.columns))


def _judged(docs: DataFrame, labels: DataFrame, scratch: Scratch | None) -> DataFrame:
    """``_row`` (a row of ``docs``), ``_q`` (counts and scores), ``base_failed`` and ``kept``."""
    scratch = scratch or Scratch(docs.sparkSession)
    model = fit(docs, labels, scratch)
    text = F.coalesce("_row.text", F.lit(""))
    of_grams = lambda w, p: let(F.concat(_singles(w), p), lambda g: F.struct(*base_counts(w, text, p), model.score(g).alias("score"), g.alias("grams")))
    made = let(words(text), lambda w: let(_pairs(w), lambda p: of_grams(w, p)))
    n, r = F.col("_q.n_words"), F.col("_q.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT * n)
    good = F.lit(True) if model.threshold is None else F.coalesce(F.round("_q.score", DIGITS) >= model.threshold, F.lit(False))
    clean = F.lit(True) if model.toxic_threshold is None else F.col("_toxic") <= model.toxic_threshold
    # the n-grams are a column of their own, so that the toxic ones are looked up in compiled code
    found = once(once(rows_of(docs), made.alias("_q")), model.held(F.col("_q.grams")).alias("_held"))
    return once(found, model.toxic_score(F.col("_held")).alias("_toxic")).select("_row", "_q", failed.alias("base_failed"), (~failed & good & clean).alias("kept"))
