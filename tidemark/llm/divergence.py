"""How the sources of a language differ in their words: smoothed term shares compared over a cube of (group block, group block, term block) cells."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Scratch

#: Documents of its language that must hold a term.
MIN_DOCS = 30
#: Terms that each group names, and the fixed point of a share.
TOP, SCALE, PSEUDO = 50, 1_000_000_000, 5
#: Groups and terms along the sides of a cell, about: a cell's tables have at most so many rows and columns.
GROUP_BLOCK, TERM_BLOCK = 64, 512
#: Entries of a task's table of counts before it is handed on.
FLUSH = 200_000
#: Texts above so many bytes are read match by match.
LONG_TEXT = 1 << 22

#: Over UTF-8 bytes in lower case: runs of letters and of all that is not ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: str) -> Counter:
    raw = text.encode().lower()  # bytes: A-Z only
    return Counter(_TERM.findall(raw) if len(raw) < LONG_TEXT else (m.group() for m in _TERM.finditer(raw)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by language, source and term, summed within the task while the table is small; a null term names each group."""
    table: dict[tuple, list[int]] = {}

    def flush() -> pa.RecordBatch:
        langs, sources, terms = zip(*table)
        n, docs = zip(*table.values())
        out = pa.RecordBatch.from_arrays([pa.array(langs), pa.array(sources), pa.array([t if t is None else t.decode() for t in terms], pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        table.clear()
        return out

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            table.setdefault((lang, source, None), [0, 0])[1] += 1
            for term, n in _terms(text.as_py() or "").items():
                had = table.setdefault((lang, source, term), [0, 0])
                had[0] += n
                had[1] += 1
            if len(table) > FLUSH:
                yield flush()
    if table:
        yield flush()


def _share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + PSEUDO) / (total + PSEUDO * kept))``, exactly."""
    up, down = ((c).cast("decimal(20,0)") for c in (n + PSEUDO, total + PSEUDO * kept))
    return F.lit(1) + F.call_function("div", up * F.lit(SCALE).cast("decimal(10,0)"), down)


def _cell(key: tuple, rows: pd.DataFrame, group_block: int) -> pd.DataFrame:
    """Partial divergences of all pairs of groups of two blocks over one term block."""
    lang, i, j, _ = key
    width = int(rows["width"].iloc[0])
    block = rows["g"].to_numpy() // group_block

    def table(side: int) -> tuple[np.ndarray, np.ndarray]:
        own = rows[block == side]
        first = own[own["t"] < 0].sort_values("g")  # one row for each group: its share of a term it does not hold
        names = first["g"].to_numpy()
        out = np.repeat(first["p"].to_numpy()[:, None], width, axis=1)
        held = own[own["t"] >= 0]
        out[np.searchsorted(names, held["g"].to_numpy()), held["t"].to_numpy()] = held["p"].to_numpy()
        return names, out

    left, a = table(i)
    right, b = (left, a) if i == j else table(j)
    parts = [(np.full(len(right), g), right, np.abs(b - a[x]).sum(axis=1)) for x, g in enumerate(left)]
    g, h, value = (np.concatenate([p[k] for p in parts]) for k in range(3))
    if i != j:
        g, h, value = np.concatenate([g, h]), np.concatenate([h, g]), np.concatenate([value, value])
    other = g != h
    return pd.DataFrame({"lang": lang, "g": g[other], "h": h[other], "value": value[other]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far a source's terms are from each other source's and which terms it has too much of.

    Terms are runs of letters and non-ASCII characters, A-Z in lower case; a language keeps
    those in at least ``min_docs`` of its documents.  A (lang, source) group and a language
    give every kept term a share in billionths, smoothed by five occurrences.  Part ``pair``
    has the sum of the absolute differences to each other source of the language; part
    ``term`` the terms the group holds and uses more than its language, the ``top`` largest
    differences.  Ranks go down by value, ties up by item.

    The shares meet in a cube: a cell is a pair of group blocks and a term block, and gets
    the slices of its two group blocks over its terms (a slice goes to as many cells as
    there are group blocks).  Cells sum absolute differences, and the sums are added along
    the term axis.  A term block is a hash of the term, so no cell grows with the data.

    Null text, language and source count as empty.  Rows without terms still make a group;
    a language without kept terms has pairs of value 0.  Repeated rows count.  No documents
    give no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    raw = scratch.keep(read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    held = raw.where("term IS NOT NULL")
    kept = held.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n")
    kept = scratch.keep(kept, "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    langs = raw.where("term IS NULL").select("lang").distinct().join(sizes, "lang", "left").select("lang", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "total")])
    langs = scratch.keep(langs.withColumn("parts", F.greatest(F.ceil(F.col("kept") / term_block), F.lit(1))), "langs")
    # every kept term: its block, its place there, its share in the language
    placed = kept.join(langs, "lang").withColumn("k", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    in_block = W.partitionBy("lang", "k")
    placed = placed.select("lang", "term", "k", (F.row_number().over(in_block.orderBy("term")) - 1).alias("t"), F.count("*").over(in_block).cast("int").alias("width"), _share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    placed = scratch.keep(placed, "terms")
    # every group: its number within the language, its total over kept terms
    counted = scratch.keep(held.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "held")
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = raw.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang")
    by_lang = W.partitionBy("lang")
    groups = groups.select("lang", "source", F.coalesce("group_total", F.lit(0)).alias("group_total"), "kept", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("g"), F.ceil(F.count("*").over(by_lang) / group_block).cast("int").alias("blocks"))
    empty = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("group_total"), F.greatest("kept", F.lit(1)))).otherwise(F.lit(0))
    groups = scratch.keep(groups.withColumn("p0", empty), "groups")
    shares = counted.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("group_total"), F.col("kept")))
    shares = scratch.keep(shares.select("lang", "source", "term", "g", "blocks", "k", "t", "width", "p", "q"), "shares")
    term_blocks = placed.select("lang", "k", "width").distinct().unionByName(langs.where("kept = 0").select("lang", F.lit(0).alias("k"), F.lit(0).alias("width")))
    blanks = groups.join(term_blocks, "lang").select("lang", "g", "blocks", "k", F.lit(-1).alias("t"), "width", F.col("p0").alias("p"))
    slices = shares.select("lang", "g", "blocks", "k", "t", "width", "p").unionByName(blanks)
    own, other = F.floor(F.col("g") / group_block).cast("int"), F.col("other")
    cells = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"), "k", "g", "t", "width", "p")
    parts = cells.groupBy("lang", "i", "j", "k").applyInPandas(lambda key, rows: _cell(key, rows, group_block), "lang string, g int, h int, value long")
    apart = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    name = lambda number, alias: groups.select("lang", F.col("g").alias(number), F.col("source").alias(alias))
    pairs = apart.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
