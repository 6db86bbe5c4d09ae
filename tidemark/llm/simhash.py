"""SimHash near-duplicates by multi-index hashing over two fingerprint halves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import Scratch, rows_of, unpacked
from .components import components

DISTANCE = 2
#: A segment bucket with more fingerprints than this is searched through shared neighbours instead of by pairs.
CROWDED = 64


def _fingerprint(text: bytes | None) -> int:
    """Bitwise majority of the XXH64 values of the 3-word shingles; 0 without a word.

    Eight strided byte counters are added at once: up to 255 hashes, masked to one bit per
    byte, sum without a carry.
    """
    joined = b" ".join((text or b"").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < 3:
        return digest(joined, 42)
    n = len(starts) - 2
    votes = np.zeros((8, 8), np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + (1 << 16)], ends[at + 2:at + 2 + (1 << 16)])], np.uint64)
        rows = np.concatenate([h, np.zeros(-len(h) % 255, np.uint64)]).reshape(-1, 255)
        for bit in range(8):
            ones = (rows >> np.uint64(bit)) & np.uint64(0x0101010101010101)
            votes[:, bit] += np.ascontiguousarray(ones.sum(axis=1, dtype=np.uint64)).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    set_bits = (votes.reshape(-1) * 2 > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    """The 64-bit fingerprint, as a signed long, of each whole text (given as binary)."""
    return pd.Series(np.array([_fingerprint(t) for t in text], np.uint64).view(np.int64))


def _bit(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def links(fps: DataFrame, scratch: Scratch, crowded: int = CROWDED) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints (``fp``, distinct) within two bits of each other.

    Two halves of 32 bits: of two bits of difference, either the upper half has at most one
    or the lower has none.  So the upper half is probed with its ball of radius one and the
    lower with itself.  Of two values that differ in one bit, one has the bit cleared, so
    balls are enumerated by setting cleared bits only, and each pair meets once.  Matches
    are verified over all 64 bits.

    Buckets above ``crowded`` would emit pairs in the square of their size.  Fingerprints
    that lie in one or probe one are linked through shared neighbours instead: two values
    are within two bits exactly if some value is within one bit of both, so each gives its
    65 values of radius one and all that meet at a value (65 at most) are joined to the
    smallest.  The edges connect the same components; no pair within two bits is left apart.
    """
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))
    table = scratch.keep(fps.select("fp", F.explode(halves).alias("k")).select("k.seg", "k.key", "fp"), "segments")
    sizes = table.groupBy("seg", "key").count().where(F.col("count") > crowded).select("seg", "key")
    full = scratch.keep(sizes, "crowded")
    cleared = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.col("key").bitwiseAND(_bit(b)) == 0)
    ball = F.when(F.col("seg") == 0, F.concat(F.array("key"), F.transform(cleared, lambda b: F.col("key") + _bit(b)))).otherwise(F.array("key"))
    probes = table.select("seg", F.explode(ball).alias("probe"), F.col("fp").alias("by"), F.col("key").alias("own")).select("seg", F.col("probe").alias("key"), "by", (F.col("probe") == F.col("own")).alias("same"))
    apart = F.bit_count(F.col("by").bitwiseXOR(F.col("fp")))
    roomy = table.join(full, ["seg", "key"], "left_anti")
    pairs = probes.join(roomy, ["seg", "key"]).where((~F.col("same") | (F.col("by") < F.col("fp"))) & (apart <= DISTANCE)).selectExpr("by AS a", "fp AS b")
    inside = table.join(full, ["seg", "key"], "left_semi").select("fp")
    around = probes.join(full, ["seg", "key"], "left_semi").select(F.col("by").alias("fp"))
    dense = inside.union(around).distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("fp").bitwiseXOR(_bit(b))))
    meets = dense.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.collect_set("fp").alias("all"), F.min("fp").alias("a")).where(F.size("all") > 1)
    stars = meets.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars)


def named(rows: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """``rows`` (``doc_id, fp``) with ``component_id``, the least id of those that ``edges`` (or what they are of the distinct ``fp``) connect, and ``root``."""
    nodes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(edges if isinstance(edges, DataFrame) else edges(nodes.select("fp")), scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    names = scratch.keep(rooted.join(least, "root").select("fp", "component_id", "root"), "named")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, fingerprint, component_id, fp, root`` for every row of ``docs`` (``doc_id, text``).

    Texts are lower-cased (A-Z), cut into words and 3-word shingles with repeats; fewer words
    give one shingle, none gives fingerprint zero, which links like any other.  Null text is
    an empty text.  ``component_id`` is the smallest doc_id reachable over links of two bits
    or less; null ids take part and are never the smallest, so it is null only where all are.
    Repeated rows stay.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long"), fingerprint(F.col("text").cast("binary")).alias("fp")), "fingerprints")
    found = named(rows, lambda nodes: links(nodes, scratch, crowded), scratch)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id", "fp", "root")


def one_per_group(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The documents with one row of each group of near-duplicates: the one whose doc_id names the group.

    All columns stay.  If that id occurs on several rows, one of those with the group's
    smallest fingerprint stays; a group without any id keeps one row in the same way.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    names = scratch.keep(near_duplicates(docs, scratch).select("doc_id", "fp", "component_id", "root"), "classes")
    return _keep_named(docs, names, scratch)


def _keep_named(docs: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of ``docs`` for each group of ``names`` (``doc_id, fp, component_id, root``)."""
    times = names.groupBy("doc_id").agg(F.count("*").alias("n"))
    chosen = names.where("doc_id <=> component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("_fp"))
    chosen = scratch.keep(chosen.alias("c").join(times.alias("t"), F.expr("c.doc_id <=> t.doc_id")).selectExpr("c.doc_id AS _id", "_fp", "n = 1 AND c.doc_id IS NOT NULL AS plain"), "chosen")
    rows = rows_of(docs)
    kept = rows.join(chosen.where("plain").select("_id"), F.expr("_row.doc_id = _id"), "left_semi").select(*unpacked(docs.columns))
    odd = chosen.where("NOT plain").select("_id", "_fp")
    if odd.isEmpty():
        return kept
    rows = rows.join(odd.select("_id").distinct(), F.expr("_row.doc_id <=> _id"), "left_semi").withColumn("_fp", fingerprint(F.col("_row.text").cast("binary")))
    rows = rows.withColumn("_doc", F.col("_row.doc_id")).join(odd.withColumnRenamed("_fp", "_want"), F.expr("_doc <=> _id AND _fp = _want"), "left_semi").dropDuplicates(["_doc", "_fp"])
    return kept.unionByName(rows.select(*unpacked(docs.columns)))
