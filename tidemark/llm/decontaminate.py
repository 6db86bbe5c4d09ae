"""Benchmark items inside documents: size-partitioned MinHash search, verified by exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, let, once, rows_of, unpacked

SHINGLE = 5
CONTAINMENT = 0.8
#: Rows up to which the item sketches (24 bytes a row) or the candidate pairs (16 bytes) are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(w: Column, make) -> Column:
    """``make`` of each run of five words; of all words if there are fewer; nothing without a word."""
    n = F.size(w)
    short = F.array(make(F.array_join(w, " ")))
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make(*[F.get(w, i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, runs).when(n > 0, short).otherwise(F.slice(short, 1, 0))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast if the counted rows allow it, else left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, text_hash, item_id, shared, item_shingles, containment`` of items of which a document holds ``threshold`` of the shingles.

    Words are runs of letters and digits in lower case; five make a shingle, repeats count
    once, a text of fewer words is one shingle.  Items are parted by size (powers of two of
    their shingle count).  An item's sketch is the bottom of its MinHash order, as many
    values as the upper end of its size class may miss at the threshold, plus one: a
    document that holds enough of the item must hold one of them, so the search loses
    nothing.  Documents with fewer shingles than an item needs are passed over.  Candidates
    are verified on the shingles themselves, which are made after the candidate pairs have
    met the raw texts: nothing but raw texts is ever shipped, and those only if the pairs
    are too many to broadcast.

    Null or empty texts and items hold nothing and match nothing.  Null ids are compared like
    values.  ``text_hash`` tells rows that share a doc_id apart; identical rows give one.
    """
    scratch, text = scratch or Scratch(docs.sparkSession), F.col("text")
    item_words = _words(F.col("text"))
    sized = items.select("item_id", F.array_distinct(let(item_words, lambda w: _shingles(w, _joined))).alias("_item"), F.array_distinct(let(item_words, lambda w: _shingles(w, F.xxhash64))).alias("_order"))
    sized = scratch.keep(sized.where(F.size("_item") > 0).withColumn("_n", F.size("_item")).distinct(), "items")
    top = F.pow(F.lit(2), F.floor(F.log2("_n")) + 1).cast("int") - 1
    least = F.ceil(F.col("_n") * F.lit(threshold) - 1e-9).cast("int")
    misses = F.floor(F.lit(1 - threshold) * top + 1e-9).cast("int") + 1
    sketch = scratch.keep(sized.select("item_id", least.alias("_least"), F.explode(F.slice(F.array_sort("_order"), 1, misses)).alias("_h")), "sketch")
    hashed = once(docs.select("doc_id", "text"), let(_words(text), lambda w: _shingles(w, F.xxhash64)).alias("_s"))
    probes = hashed.select("doc_id", F.size("_s").alias("_size"), F.explode_outer("_s").alias("_h"))
    found = probes.join(_bounded(sketch), "_h").where("_size >= _least").select("doc_id", "item_id").distinct()
    found = scratch.keep(found, "candidates")
    pairs = found.withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").join(_bounded(pairs), F.expr("doc_id <=> _id"))
    texts = once(texts, F.xxhash64("text").alias("text_hash"), F.array_distinct(let(_words(text), lambda w: _shingles(w, _joined))).alias("_doc")).drop("text")
    whole = sized.select("item_id", "_item", "_n")
    both = texts.join(F.broadcast(whole) if items_fit(sized) else whole, "item_id")
    shared = F.size(F.array_intersect("_item", "_doc"))
    out = once(both.select("doc_id", "text_hash", "item_id", "_n", "_item", "_doc"), shared.cast("long").alias("shared"))
    out = out.select("doc_id", "text_hash", "item_id", "shared", F.col("_n").cast("long").alias("item_shingles"), (F.col("shared") / F.col("_n")).alias("containment"))
    return out.where(F.col("containment") >= threshold - 1e-12).distinct()


def items_fit(sized: DataFrame) -> bool:
    """True if the shingles of all items are few enough to broadcast."""
    return (sized.agg(F.sum("_n")).first()[0] or 0) <= BROADCAST_ROWS


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the rows that contain an item; all columns stay, whatever their names."""
    scratch = scratch or Scratch(docs.sparkSession)
    bad = scratch.keep(contained_items(docs, items, scratch=scratch).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "contaminated")
    clean = rows_of(docs).join(_bounded(bad), F.expr("_row.doc_id <=> _id AND xxhash64(_row.text) = _hash"), "left_anti")
    return clean.select(*unpacked(docs.columns))
