"""Tokens of two tokenizers over the same bytes: token-byte incidence matrices and their products."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Bytes of text, about, whose matrices are multiplied at once; longer texts are cut where tokens of both sides end.
SEGMENT = 1 << 20
#: Linked id pairs, the most frequent ones, that are broadcast (16 bytes each); the others meet their counts in a join.
BROADCAST_PAIRS = 1 << 20


class CSR(NamedTuple):
    """A sparse matrix by rows: the entries of row i are ``start[i]`` to ``start[i + 1]`` of ``column`` and ``value``."""

    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def transposed(self) -> CSR:
        order = np.argsort(self.column, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(self.column, minlength=self.width))])
        return CSR(start, self.rows[order], self.value[order], len(self.start) - 1)

    def times(self, other: CSR) -> CSR:
        """The product by rows (Gustavson): each entry (i, k) adds its multiple of the other's row k to row i."""
        length = np.diff(other.start)[self.column]
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(other.start[self.column] - first, length)
        row, column = np.repeat(self.rows, length), other.column[at]
        value = np.repeat(self.value, length) * other.value[at]
        place = row * other.width + column
        if len(place) and (np.diff(place) < 0).any():
            order = np.argsort(place, kind="stable")
            row, column, value, place = row[order], column[order], value[order], place[order]
        new = np.flatnonzero(np.concatenate([[True], np.diff(place) > 0])) if len(place) else np.zeros(0, np.int64)
        start = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(self.start) - 1))])
        return CSR(start, column[new], np.add.reduceat(value, new) if len(new) else value, other.width)


def incidence(ends: np.ndarray, width: int) -> CSR:
    """Tokens by bytes: row i has a one for each byte of the token that ends at ``ends[i]``; the tokens cover ``width`` bytes."""
    return CSR(np.concatenate([[0], ends]), np.arange(width), np.ones(width, np.int64), width)


def membership(group: np.ndarray, groups: int) -> CSR:
    """Tokens by groups."""
    return CSR(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray) -> CSR:
    """A·Bᵀ of the token-byte incidences: how many bytes token i of A and token j of B share."""
    width = int(ends_a[-1]) if len(ends_a) else 0
    return incidence(ends_a, width).times(incidence(ends_b, width).transposed())


def group_links(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> CSR:
    """The product of the token-group memberships: the pairs of tokens in one group."""
    return membership(group_a, groups).times(membership(group_b, groups).transposed())


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets where tokens of both sides end, and the group of each token of A and of B."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


@dataclass(frozen=True)
class Vocabularies:
    """Files of A: a byte-level BPE of the tokenizers library, the same as ranks of tiktoken; of B: a sentencepiece model."""

    a: str
    a_ranks: str
    b: str

    @staticmethod
    def default() -> Vocabularies:
        import public_tokenizers as P

        return Vocabularies(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))


class _Side(NamedTuple):
    """Encodes texts; of every id the bytes, their number, and its decimal number after the sign that opens a group, parts tokens, or opens B's half."""

    encode: object
    bytes: np.ndarray
    length: np.ndarray
    written: dict


_loaded: dict = {}


def _side(encode, tokens: list[bytes]) -> _Side:
    table = np.empty(len(tokens), object)
    table[:] = tokens
    written = {sign: np.array([f"{sign}{i}" for i in range(len(tokens))], object) for sign in ";,|"}
    return _Side(encode, table, np.array([len(t) for t in tokens], np.int64), written)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 characters are themselves, the other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _sides(v: Vocabularies) -> tuple[_Side, _Side]:
    if v in _loaded:
        return _loaded[v]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    with open(v.a_ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(v.a)
    slow.encode_special_tokens = True
    stand_in = _byte_of_char()
    tokens = [b""] * slow.get_vocab_size(with_added_tokens=True)
    for text, i in slow.get_vocab(with_added_tokens=True).items():
        tokens[i] = bytes(stand_in[c] for c in text) if all(c in stand_in for c in text) else text.encode()

    def encode_a(text: str) -> list[int]:
        try:
            text.encode("latin-1")  # beyond it the character classes of the two libraries may differ
            return fast.encode_ordinary(text)
        except ValueError:  # another character, or a run beyond the pattern's stack
            return slow.encode(text, add_special_tokens=False).ids

    model = sentencepiece.SentencePieceProcessor(model_file=v.b)
    of_byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(m[1], 16)]) if (m := of_byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
    _loaded[v] = _side(encode_a, tokens), _side(lambda text: model.encode(text, num_threads=1), pieces)
    return _loaded[v]


def _written(a: _Side, b: _Side, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> str:
    """``a1,a2|b1;a3|b2,b3``: the groups in order, put together from ready parts."""
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    at_a = np.arange(len(ids_a)) + before_b[group_a]
    at_b = np.arange(len(ids_b)) + (before_a + in_a)[group_b]
    out = np.empty(len(ids_a) + len(ids_b), object)
    first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
    for at, ids, first, side, sign in ((at_a, ids_a, first_a, a, ";"), (at_b, ids_b, first_b, b, "|")):
        out[at[first]] = side.written[sign][ids[first]]
        out[at[~first]] = side.written[","][ids[~first]]
    return "".join(out.tolist())[1:]


class _Text(NamedTuple):
    """One encoded text; without tokens all arrays are empty."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray


def _encoded(text: str | None, a: _Side, b: _Side) -> _Text:
    none = np.zeros(0, np.int64)
    if text:
        ids_a, ids_b = np.array(a.encode(" " + text), np.int64), np.array(b.encode(text), np.int64)
        raw = (" " + text).encode()
        if b"".join(a.bytes[ids_a].tolist()) == raw and b"".join(b.bytes[ids_b].tolist()) == raw:
            return _Text(ids_a, ids_b, np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b]))
    return _Text(none, none, none, none)


def _segments(common: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Stretches of about SEGMENT bytes between common ends: first and last token of A and of B, and where the bytes begin."""
    at = a0 = b0 = 0
    while at < len(common):
        begin = int(common[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(common, begin + SEGMENT, side="right")))
        a1, b1 = (int(np.searchsorted(e, common[at - 1], side="right")) for e in (ends_a, ends_b))
        yield a0, a1, b0, b1, begin
        a0, b0 = a1, b1


def _links(texts: list[_Text], n_b: int) -> tuple[list[tuple], list[int], list[int]]:
    """Of each text its distinct linked id pairs (A's id times ``n_b`` plus B's) and their links; its groups; its pairs of tokens in one group.

    The texts lie behind one another in one matrix, which is multiplied in segments.
    """
    shift = np.cumsum([0] + [int(t.ends_a[-1]) if len(t.ends_a) else 0 for t in texts])
    ends_a = np.concatenate([t.ends_a + s for t, s in zip(texts, shift)])
    ends_b = np.concatenate([t.ends_b + s for t, s in zip(texts, shift)])
    ids_a, ids_b = np.concatenate([t.ids_a for t in texts]), np.concatenate([t.ids_b for t in texts])
    of_text = np.repeat(np.arange(len(texts)), [len(t.ids_a) for t in texts])
    common, group_a, group_b = groups_of(ends_a, ends_b)
    keys, base = [], np.int64(2) ** 40
    for a0, a1, b0, b1, begin in _segments(common, ends_a, ends_b):
        linked = overlap_links(ends_a[a0:a1] - begin, ends_b[b0:b1] - begin)
        row = linked.rows + a0
        keys.append(of_text[row] * base + ids_a[row] * n_b + ids_b[linked.column + b0])
    key, times = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) * base)
    pairs = [(key[x:y] % base, times[x:y]) for x, y in zip(cut, cut[1:])]
    text_of_group = np.searchsorted(shift[1:], common)
    shared = np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common))  # entries of group_links, by group
    return pairs, np.bincount(text_of_group, minlength=len(texts)).tolist(), np.bincount(text_of_group, weights=shared, minlength=len(texts)).astype(np.int64).tolist()


def _chunks(texts: Iterator, limit: int = 4 * SEGMENT) -> Iterator[list]:
    """Runs of texts of about ``limit`` characters; a long one is alone."""
    out, n = [], 0
    for t in texts:
        size = len(t) if t else 0
        if out and n + size > limit:
            yield out
            out, n = [], 0
        out.append(t)
        n += size
    if out:
        yield out


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs array<long>, links array<int>"


def aligned(docs: DataFrame, vocabularies: Vocabularies | None = None, written: bool = False) -> DataFrame:
    """Each row's alignment: ``doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, links`` (and ``groups``, as text, if ``written``).

    A reads a blank and the text, B the text, to which it puts a blank itself; strings of
    special tokens are plain text.  ``pairs`` are the distinct linked id pairs (A's id times
    B's vocabulary plus B's id), ``links`` their occurrences, ``n_shared`` the token pairs
    of one group.  Null and empty texts, and those whose tokens do not give the bytes back,
    have no tokens: zeros, no pairs, an empty string.  Repeated rows each have theirs.
    """
    v = vocabularies or Vocabularies.default()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(v)
        for batch in batches:
            at = 0
            for chunk in _chunks(x.as_py() for x in batch.column(1)):
                texts = [_encoded(t, a, b) for t in chunk]
                pairs, n_groups, n_shared = _links(texts, len(b.length))
                lines = []
                for t in texts:
                    common, group_a, group_b = groups_of(t.ends_a, t.ends_b)
                    lines.append(_written(a, b, t.ids_a, t.ids_b, group_a, group_b, len(common)))
                number = lambda x: pa.array(x, pa.int64())
                lists = lambda k, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p[k]) for p in pairs]), pa.int32()), pa.array(np.concatenate([p[k] for p in pairs]), kind))
                columns = [batch.column(0).slice(at, len(chunk)), number([len(t.ids_a) for t in texts]), number([len(t.ids_b) for t in texts]), number(n_groups), number([int(p[1].sum()) for p in pairs]), number(n_shared),
                           pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]), lists(0, pa.int64()), lists(1, pa.int32())] + [pa.array(lines)] * written
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ALIGNED.split(", ")] + ["groups"] * written)
                at += len(chunk)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ALIGNED + ", groups string" * written)


def pair_counts(rows: DataFrame, n_b: int, scratch: Scratch) -> DataFrame:
    """``pair, n, best``: in how many rows of ``aligned`` an id pair is linked, and whether no pair of the same id of A has more."""
    counts = scratch.keep(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    of_a = F.floor(F.col("pair") / n_b)
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A at most
    return scratch.keep(counts.withColumn("a", of_a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def _frequent(counts: DataFrame, bound: int) -> int:
    """The least count, a power of two, that at most ``bound`` pairs reach."""
    left, least = bound, 1 << 62
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect(), key=lambda r: -r["power"]):  # 63 rows at most
        if r["count"] > left:
            return least
        left, least = left - r["count"], 1 << r["power"]
    return 1


def link_scores(docs: DataFrame, vocabularies: Vocabularies | None = None, scratch: Scratch | None = None, bound: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` without the pairs, and of each row ``n_best`` and ``count_sum``: its links whose pair is the most widespread of A's id, and the counts of all its links.

    A pair's count is the number of rows that hold it linked.  The ``bound`` most frequent
    pairs are broadcast and looked up in arrays; what is rarer, if there are more, meets its
    counts in a join, where by its rarity no key is hot.  Ties at the top are all best.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    v = vocabularies or Vocabularies.default()
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=v.b).get_piece_size()
    rows = scratch.keep(aligned(docs, v).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows, n_b, scratch)
    least = _frequent(counts, bound)
    top = counts.where(F.col("n") >= least).toPandas().sort_values("pair")  # bound rows at most
    table = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    shown = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            row = np.repeat(np.arange(len(batch)), np.diff(pairs.offsets.to_numpy()))
            pair, times = pairs.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            found = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
            np.add.at(sums[0], row[found], times[found] * best[at[found]])
            np.add.at(sums[1], row[found], times[found] * n[at[found]])
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=len(batch)))])
            rest = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[~found], kind)) for x, kind in ((pair, pa.int64()), (links.flatten().to_numpy(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in shown] + [batch.column("rid")] + [pa.array(s) for s in sums] + rest, names=[*shown, "rid", "n_best", "count_sum", "pairs", "links"])

    kinds = {c.split()[0]: c for c in _ALIGNED.split(", ")}
    looked = rows.mapInArrow(look_up, ", ".join(kinds[c] for c in shown) + f", rid long, n_best long, count_sum long, {kinds['pairs']}, {kinds['links']}")
    if least == 1:
        return looked.drop("rid", "pairs", "links")
    looked = scratch.keep(looked, "looked")
    rare = looked.select("rid", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("times")).join(counts.where(F.col("n") < least), "pair")
    more = rare.groupBy("rid").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    whole = looked.drop("pairs", "links").join(more, "rid", "left")
    return whole.select(*shown, *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "b"), ("count_sum", "s"))])


def links(docs: DataFrame, vocabularies: Vocabularies | None = None, same_group: bool = False) -> DataFrame:
    """The links themselves: ``doc_id, a, b, a_id, b_id, bytes`` by token positions; ``same_group`` adds those that share a group but no byte (``bytes`` 0).

    Rows without tokens give none.  Links that share a group only grow with the square of a
    group, which tokenizers of written language keep to a few tokens.
    """
    v = vocabularies or Vocabularies.default()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _sides(v)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                t = _encoded(text.as_py(), a, b)
                common, group_a, group_b = groups_of(t.ends_a, t.ends_b)
                for a0, a1, b0, b1, begin in _segments(common, t.ends_a, t.ends_b):
                    found = overlap_links(t.ends_a[a0:a1] - begin, t.ends_b[b0:b1] - begin)
                    row, column, shared = found.rows, found.column, found.value
                    if same_group:
                        low = group_a[a0]
                        all_ = group_links(group_a[a0:a1] - low, group_b[b0:b1] - low, int(group_a[a1 - 1] - low) + 1)
                        place = lambda m: m.rows * m.width + m.column
                        value = np.zeros(len(all_.column), np.int64)
                        value[np.searchsorted(place(all_), place(found))] = shared  # what overlaps is in one group
                        row, column, shared = all_.rows, all_.column, value
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(row), pa.int64()), *[pa.array(x, pa.int64()) for x in (row + a0, column + b0, t.ids_a[row + a0], t.ids_b[column + b0], shared)]], names=["doc_id", "a", "b", "a_id", "b_id", "bytes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, a long, b long, a_id long, b_id long, bytes long")
