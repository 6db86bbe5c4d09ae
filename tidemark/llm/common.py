"""Helpers that the operators of this folder share: written tables, words, spans of a pattern."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts: blank and the characters from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
SPACES = "[ \\t-\\r]+"
#: One white space; Java looks a class of listed characters up in a table, other than one with a range.
BLANK = "[ \\t\\n\\x0B\\f\\r]"

_folders: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only for a local master without one, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="tidemark-llm-")
    return _folders[app]


class Scratch:
    """Tables of one run in the shared folder.

    ``keep`` writes a frame and reads it back: what several steps use is computed once,
    and a lost executor costs a task, not the chain before it.  ``drop`` removes a table
    that nothing reads any more; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{folder(spark)}/llm-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        fs, p = self._fs(df._scratch_path)
        fs.delete(p, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def once(df: DataFrame, *fields: Column) -> DataFrame:
    """``df`` with further columns that are computed once per row.

    A generator's output stands between them and later filters, which would otherwise be
    pushed below the projection and compute the same expressions again.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*fields))))


def rows_of(df: DataFrame, *more: str) -> DataFrame:
    """``df`` as one struct column ``_row``, with the columns ``more`` beside it: names of ``df`` cannot clash with those of later steps."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *more)


def unpacked(columns: list[str]) -> list[Column]:
    """The columns that ``rows_of`` put away."""
    return [F.col(f"_row.`{c}`") for c in columns]


def sampled(df: DataFrame, key: str, n: int, bound: int) -> DataFrame:
    """About ``bound`` of the ``n`` rows of ``df``, chosen by a hash of ``key``; all of them if there are no more."""
    whole = 1 << 30
    return df if n <= bound else df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(whole)) < whole * bound // n)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


SPAN = "array<struct<start:int,end:int,s:string>>"
_CHUNK = 256


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``start, end, s`` in code points.

    The text between the matches (a split by the same pattern) gives the gaps, so running
    sums of lengths are the positions.  They are added up in chunks, which keeps texts with
    very many matches from costing the square of their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def place(parts: Column, at: Column) -> Column:
        step = F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(parts, step, lambda a, p: F.struct(
            (a["at"] + p["gap"] + p["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + p["n"]).alias("end"), p["s"].alias("s")))).alias("out")))

    def spans(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / _CHUNK).cast("int")), lambda i: F.slice(parts, i * _CHUNK + 1, F.lit(_CHUNK)))
        state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,parts:array<struct<gap:int,n:int,s:string>>>>").alias("out"))
        begun = F.aggregate(chunks, state, lambda a, ch: F.struct(
            (a["at"] + F.aggregate(ch, F.lit(0), lambda t, p: t + p["gap"] + p["n"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), ch.alias("parts")))).alias("out")))
        return F.flatten(F.transform(begun["out"], lambda b: place(b["parts"], b["at"])["out"]))

    parts = let(gaps, lambda g: F.transform(found, lambda s, i: F.struct(F.length(g[i]).alias("gap"), F.length(s).alias("n"), s.alias("s"))))
    return let(parts, lambda p: F.when(F.size(p) == 0, F.array().cast(SPAN)).otherwise(spans(p)))
