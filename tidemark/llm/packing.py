"""Packing of documents into sequences: cutting stock over a histogram of lengths, solved by column generation."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch

LENGTH = 2048
#: Lengths are counted in classes of so many tokens; a class takes its upper end in a pattern.
GRAIN = 8
END_ID = 1
#: Share of a sequence by which a new pattern must pay for itself; at the end the program is within that share of its optimum.
GAP = 1e-3
#: Rows of one class that one task ranks: its even share, within these bounds.
RANKED_ROWS = (100, 20_000)

_encoders: dict = {}


def default_vocabulary() -> tuple[str, str]:
    """The byte-level BPE vocabulary as a file of the tokenizers library and, the same, as ranks of tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(vocabulary: tuple[str, str]):
    """``ids(text)`` as the tokenizers library gives them without added special tokens.

    Texts of Latin-1 characters go through tiktoken, which has the same vocabulary and the
    same ids and is several times faster; texts with others, where the character classes of
    the two libraries may differ in age, and those on whose long runs of blanks the pattern
    of tiktoken gives up, go through the tokenizers library itself.
    """
    if vocabulary in _encoders:
        return _encoders[vocabulary]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": len(ranks)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slow = Tokenizer.from_file(vocabulary[0])

    def ids(text: str) -> np.ndarray:
        try:
            text.encode("latin-1")
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        except ValueError:  # another character, or a run beyond the pattern's stack
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    _encoders[vocabulary] = ids
    return ids


def _pieces(ids: np.ndarray, length: int) -> list[int]:
    return [zlib.crc32(ids[at:at + length].astype("<u4").tobytes()) for at in range(0, len(ids), length)]


def tokenized(docs: DataFrame, vocabulary: tuple[str, str], length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """``doc_id, doc_tokens, crcs`` (one checksum for each cut of ``length`` ids), with ``ids`` if asked for."""
    schema = "doc_id long, doc_tokens long, crcs array<long>" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            keys, counts, crcs, kept = batch.column(0), [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                counts.append(len(ids))
                crcs.append(_pieces(ids, length))
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            arrays = [keys, pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))] + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "crcs"] + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Pattern:
    """``bins`` sequences that each hold ``take[c]`` pieces of class c."""

    take: dict[int, int]
    bins: int


def _knapsack(value: np.ndarray, size: np.ndarray, room: int) -> np.ndarray:
    """Pieces of each class that fill ``room`` with most value, by dynamic programming over the room; ``size`` ascends."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if n := fits[r]:
            got = best[r - size[:n]] + value[:n]
            j = int(got.argmax())
            if got[j] > best[r] + 1e-12:
                best[r], pick[r] = got[j], j
    take, r = np.zeros(len(size)), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            take[pick[r]] += 1
            r -= size[pick[r]]
    return take


def _inverse(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan in plain array steps; a threaded linear algebra library can hang beside the session's JVM."""
    m = len(basis)
    a = np.concatenate([basis, np.eye(m)], axis=1)
    for i in range(m):
        k = i + int(np.abs(a[i:, i]).argmax())
        a[[i, k]] = a[[k, i]]
        a[i] /= a[i, i]
        f = a[:, i].copy()
        f[i] = 0.0
        a -= f[:, None] * a[i]
    return a[:, m:]


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (matrix * x).sum(axis=1)


def patterns(demand: dict[int, int], room: int) -> list[Pattern]:
    """Cutting patterns that cover ``demand`` (pieces wanted by class size) with few sequences of ``room``.

    The linear program over patterns is solved by column generation: a simplex basis starts
    with one pattern for each class, its dual prices go into a knapsack, and the pattern
    found replaces one of the basis until none is worth more than a sequence by GAP.  Whole
    parts of the solution are taken; what is left, at most a few pieces for each pattern, is
    packed largest first.  The work depends on the number of classes only.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), dtype=int)
    m = len(sizes)
    if not m:
        return []
    want = np.array([demand[s] for s in sizes], float)
    loose = want + np.linspace(0.0, 1e-3, m)  # parts ties, which could make the steps run in a circle
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(1, 12 * m + 50):
        price = inverse.sum(axis=0)
        column = _knapsack(np.maximum(price, 0), sizes, room)
        if (column * price).sum() <= 1 + GAP:
            break
        x, move = _times(inverse, loose), _times(inverse, column)
        ok = move > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, np.maximum(x, 0) / np.where(ok, move, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if step % 200:
            row = inverse[out] / move[out]
            inverse -= np.outer(move, row)
            inverse[out] = row
        else:
            inverse = _inverse(basis)
    x = np.maximum(_times(_inverse(basis), want), 0)
    left, out = want.astype(np.int64), []
    for j in range(m):
        take = basis[:, j].astype(np.int64)
        bins = int(np.floor(x[j] + 1e-9))
        if bins:
            out.append(Pattern({int(sizes[c]): int(take[c]) for c in np.flatnonzero(take)}, bins))
            left -= take * bins
    left = np.maximum(left, 0)
    while left.any():
        take, space = {}, room
        for c in range(m - 1, -1, -1):
            if n := int(min(left[c], space // sizes[c])):
                take[int(sizes[c])], space = n, space - n * int(sizes[c])
        bins = min(int(left[c]) // take[int(sizes[c])] for c in range(m) if int(sizes[c]) in take)
        out.append(Pattern(take, bins))
        for c in range(m):
            left[c] -= bins * take.get(int(sizes[c]), 0)
    return out


def pack(docs: DataFrame, vocabulary: tuple[str, str] | None = None, length: int = LENGTH, grain: int = GRAIN, scratch: Scratch | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    A document is its ids and the end id.  It is cut every ``length`` ids; whole cuts fill a
    sequence each.  The lengths of the last pieces are counted in classes of ``grain``; the
    patterns for that histogram say how many pieces of each class a sequence takes.  Pieces
    are ranked within their class (slices by hash, counts of the slices, row numbers in
    them) and rank intervals belong to patterns, so assigning is a join with a small table.

    Null or empty texts are one piece with the end id.  Null and repeated ids are kept, one
    set of pieces for each row.  No documents give no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    vocabulary = vocabulary or default_vocabulary()
    rest = F.col("doc_tokens") % length
    rows = tokenized(docs, vocabulary, length, keep_ids).withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("class", F.ceil(rest / grain).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / length)), "tokens")
    histogram = {r["class"]: (r.n, r.full) for r in rows.groupBy("class").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()}  # length / grain rows at most
    plan, first = [], 0
    taken = dict.fromkeys(histogram, 0)
    for p in patterns({c: n for c, (n, _) in histogram.items() if c > 0}, length // grain):
        for c, n in p.take.items():
            plan.append((c, taken[c], taken[c] + n * p.bins, n, first))
            taken[c] += n * p.bins
        first += p.bins
    begin, totals = first, []
    for c, (_, full) in sorted(histogram.items()):
        totals.append((c, begin))
        begin += full
    share = sum(n for n, _ in histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(max(share, RANKED_ROWS[0]), RANKED_ROWS[1])
    slices = max(1, -(-max((n for n, _ in histogram.values()), default=0) // share))
    ranked = rows.withColumn("slice", F.pmod(F.xxhash64("rid"), F.lit(slices)))
    before = W.partitionBy("class").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    tops = ranked.groupBy("class", "slice").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    tops = tops.select("class", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    tops = tops.join(F.broadcast(spark.createDataFrame(totals, "class int, begin long")), "class")  # one row for each class
    inside = W.partitionBy("class", "slice").orderBy("doc_id", "rid")
    placed = ranked.withColumn("i", F.row_number().over(inside) - 1).withColumn("f", F.coalesce(F.sum("full").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(tops, ["class", "slice"]).withColumn("rank", F.col("n0") + F.col("i")).withColumn("whole", F.col("begin") + F.col("f0") + F.col("f"))
    ids = (lambda start, n: [F.slice("ids", start + 1, n).alias("ids")]) if keep_ids else (lambda start, n: [])
    cuts = placed.where("full > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    start = F.col("i") * length
    whole = cuts.select("doc_id", start.alias("start"), F.lit(length).cast("long").alias("length"), F.get("crcs", F.col("i").cast("int")).alias("ids_crc32"), "doc_tokens",
                        (F.col("whole") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *ids(start.cast("int"), F.lit(length)))
    table = spark.createDataFrame(plan, "class int, low long, high long, each long, first long")  # at most a few rows for each pair of class and pattern
    last = placed.where("class > 0").join(F.broadcast(table), "class").where("rank >= low AND rank < high")
    last = last.withColumn("sequence_id", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).withColumn("length", rest)
    up_to = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("doc_tokens") - F.col("length")
    tails = last.select("doc_id", start.alias("start"), "length", F.get("crcs", F.col("full").cast("int")).alias("ids_crc32"), "doc_tokens", "sequence_id",
                        F.coalesce(F.sum("length").over(up_to), F.lit(0)).alias("offset"), *ids(start.cast("int"), F.col("length").cast("int")))
    return whole.unionByName(tails)


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed sequences from pieces with ``ids``: ``sequence_id, ids`` of up to the packing length."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
