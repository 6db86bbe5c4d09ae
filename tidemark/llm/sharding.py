"""Shards of near equal bytes: a minimax contiguous partition of the ordered groups of equal texts."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Scratch, rows_of, unpacked

SHARDS = 24
#: Bytes that every document counts besides its text.
OVERHEAD = 8
#: Bits of a group's key: it orders the groups and tells equal texts.
KEY_BITS = 60
#: Bits of the first cut of the key range into blocks, and how many more a block that may hold a border is cut by.
FIRST_BITS, MORE_BITS = 13, 8
#: Rows of one shard that one task ranks: an even share, within these bounds.
RANKED_ROWS = (100, 20_000)


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def key_of(text: Column) -> Column:
    """The first 60 bits of the text's MD5: equal texts (null counts as empty) share it, and its order has nothing to do with the texts."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


@dataclass
class Blocks:
    """Ordered stretches of groups: first key, bits of the key that are fixed, bytes and number of groups."""

    key: np.ndarray
    bits: np.ndarray
    size: np.ndarray
    groups: np.ndarray
    end: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.key, kind="stable")
        self.key, self.bits, self.size, self.groups = (x[order] for x in (self.key, self.bits, self.size, self.groups))
        self.end = np.cumsum(self.size)

    def ends(self, capacity: int, n: int, loose: bool) -> np.ndarray:
        """Where each of up to ``n`` shards ends, in bytes, if every one is filled as far as ``capacity`` allows.

        ``loose`` lets a shard end anywhere inside a block of several groups, else borders
        of blocks are the only ends: what is possible lies between the two.
        """
        out, at, total = [], 0, int(self.end[-1]) if len(self.end) else 0
        while at < total and len(out) < n:
            b = int(np.searchsorted(self.end, at + capacity, side="right"))
            to = total if b == len(self.end) else int(self.end[b - 1]) if b else 0
            if loose and b < len(self.end) and self.groups[b] > 1:
                to = at + capacity
            if to <= at:  # the next block alone is too large
                break
            out.append(to)
            at = to
        return np.array(out, np.int64)

    def least(self, n: int, loose: bool) -> int:
        """The smallest capacity at which ``n`` shards hold everything, by binary search over greedy checks."""
        total = int(self.end[-1])
        low, high = -(-total // n), total
        while low < high:
            mid = (low + high) // 2
            ends = self.ends(mid, n, loose)
            low, high = (low, mid) if len(ends) and ends[-1] == total else (mid + 1, high)
        return low

    def starts(self, capacity: int, n: int, loose: bool) -> np.ndarray:
        """Where the last 1, 2 ... ``n`` shards begin at the earliest, in bytes, if all from there on fit into them."""
        begin, out, at = self.end - self.size, [], int(self.end[-1]) if len(self.end) else 0
        for _ in range(n):
            b = int(np.searchsorted(begin, at - capacity, side="left"))
            if at <= capacity:
                at = 0
            elif loose and b and self.groups[b - 1] > 1:
                at = at - capacity
            else:
                at = min(at, int(begin[b])) if b < len(begin) else at
            out.append(at)
        return np.array(out, np.int64)

    def unsure(self, n: int) -> np.ndarray:
        """Blocks of several groups in which a border may lie: between the earliest and the latest place of each."""
        loose, tight = self.least(n, True), self.least(n, False)
        first, last = self.ends(loose, n, False), self.ends(tight, n, True)
        first = np.concatenate([first, np.full(max(0, len(last) - len(first)), first[-1] if len(first) else 0)])[:len(last)]
        first = np.minimum(first, np.append(self.starts(tight, n, True)[::-1][1:], self.end[-1])[:len(last)])
        begin = self.end - self.size
        many = np.zeros(len(self.size), bool)
        for a, b in zip(first, last):
            many |= (self.end >= a) & (begin <= b)
        return np.flatnonzero(many & (self.groups > 1))

    def cuts(self, n: int) -> list[int]:
        """Ends of the shards under the least capacity: each as near to an even share of what is left as the capacity allows for it and for the rest."""
        capacity, total = self.least(n, False), int(self.end[-1])
        earliest, out, at = [total, *self.starts(capacity, n, False).tolist()], [], 0
        for left in range(n, 0, -1):
            if at == total:
                break
            share = at + (total - at) // left
            i = int(np.searchsorted(self.end, share, side="right"))
            below, above = int(self.end[i - 1]) if i else at, int(self.end[i]) if i < len(self.end) else total
            near = below if below > at and share - below <= above - share else above
            furthest = int(self.end[int(np.searchsorted(self.end, at + capacity, side="right")) - 1])
            at = min(max(near, earliest[left - 1]), furthest)
            out.append(at)
        return out


def _block(bits: int) -> Column:
    shift = KEY_BITS - bits
    return F.shiftleft(F.shiftright("key", shift), shift)


def _blocks(groups: DataFrame, block: Column, bits) -> Blocks:
    rows = groups.groupBy(block.alias("key")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas()
    return Blocks(rows.key.to_numpy(np.int64), np.full(len(rows), bits), rows["size"].to_numpy(np.int64), rows.n.to_numpy(np.int64))


@dataclass(frozen=True)
class Plan:
    """Keys of the groups that have a shard of their own, and the first key of each further shard but the first."""

    alone: tuple[int, ...]
    borders: tuple[int, ...]

    def shard(self, key: Column) -> Column:
        later = F.lit(len(self.alone))
        for k in self.borders:
            later = later + (key >= k).cast("int")
        for i, k in enumerate(self.alone):
            later = F.when(key == k, i).otherwise(later)
        return later.cast("int")


def plan(groups: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> Plan:
    """The contiguous partition of ``groups`` (``key, size``, one row each) whose largest shard is smallest.

    A group that is no smaller than an even share of what is left sets the largest shard by
    itself: it comes first in the order, has a shard of its own and the rest is parted into
    one shard less.  The others are ordered by key.  The driver sees them as blocks of
    neighbours: the greedy check of a capacity is a few searches in the running sum of
    block sizes.  Blocks in which a border may lie are cut further until they are single
    groups, so the result is exact while the driver holds a number of blocks that does not
    depend on the number of groups.  At the least capacity many cuts are possible; filling
    shard by shard would leave the last one short, so each border is the possible one that
    is nearest to an even share of the rest.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone = []
    for r in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if r["size"] * (shards - len(alone)) < total:
            break
        alone.append(r["key"])
        total -= r["size"]
    if not total:
        return Plan(tuple(alone), ())
    n, rest = shards - len(alone), groups.where(~F.col("key").isin(alone)) if alone else groups
    blocks = _blocks(rest, _block(first_bits), first_bits)
    while len(cut := blocks.unsure(n)):
        keep = np.setdiff1d(np.arange(len(blocks.key)), cut)
        parts = [Blocks(*(x[keep] for x in (blocks.key, blocks.bits, blocks.size, blocks.groups)))]
        for bits in np.unique(blocks.bits[cut]):
            finer = min(int(bits) + more_bits, KEY_BITS)
            these = groups.sparkSession.createDataFrame([(int(k),) for k in blocks.key[cut][blocks.bits[cut] == bits]], "_key long")  # blocks beside a border
            parts.append(_blocks(rest.join(F.broadcast(these), _block(int(bits)) == F.col("_key"), "left_semi"), _block(finer), finer))
        blocks = Blocks(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("key", "bits", "size", "groups")))
    first = np.searchsorted(blocks.end, blocks.cuts(n)[:-1], side="right")
    return Plan(tuple(alone), tuple(int(k) for k in blocks.key[first]))


def shard(docs: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``bytes``: shards are near equal in UTF-8 bytes (and ``OVERHEAD`` a row),
    equal texts share a shard, so that a shard is never smaller than its largest group.
    Slots count a shard's rows without gaps, in the order of a hash of the id (of rows
    without an id in any fixed order); equal ids with equal texts follow each other.

    Null text counts as empty.  Null and repeated ids and repeated rows are kept, a slot
    each.  No documents give no rows; with few groups the last shards stay empty.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key_of(text).alias("key"), F.monotonically_increasing_id().alias("rid"))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), "rid"))), 1, KEY_BITS // 4), 16, 10).cast("long")
    rows = scratch.keep(rows.withColumn("place", place), "rows")
    groups = scratch.keep(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    rows = rows.withColumn("shard", plan(groups, shards).shard(F.col("key")))
    n = groups.agg(F.sum("n")).first()[0] or 0
    share = min(max(n // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANKED_ROWS[0]), RANKED_ROWS[1])
    bits = max(0, int(np.ceil(np.log2(max(n / share / shards, 1)))))  # a slice of a shard is a range of places
    rows = rows.withColumn("slice", F.shiftright("place", KEY_BITS - bits))
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy("shard", "slice").agg(F.count("*").alias("n")).select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = W.partitionBy("shard", "slice").orderBy("place", "doc_id", "key", "rid")
    placed = rows.withColumn("i", F.row_number().over(inside) - 1).join(tops, ["shard", "slice"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n0") + F.col("i")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, scratch: Scratch | None = None) -> None:
    """Writes ``docs`` as Parquet under ``path``, a folder ``_shard=i`` for each shard; all columns stay and no row is moved between tasks."""
    scratch = scratch or Scratch(docs.sparkSession)
    groups = scratch.keep(docs.select(key_of(F.col("text")).alias("key"), size_of(F.col("text")).alias("size")).groupBy("key").agg(F.sum("size").alias("size")), "groups")
    where = plan(groups, shards).shard(key_of(F.col("_row.text")))
    rows_of(docs).select(*unpacked(docs.columns), where.alias("_shard")).write.partitionBy("_shard").parquet(path)
