"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

BITS = 16
ORDERS = (1, 2, 3)
#: Documents of a language that the model learns from, about; the hash of the id chooses them.
SAMPLE = 1_500
#: Languages that the model learns, those with the most documents: the matrix has a column of 256 KB for each.
LANGUAGES = 400
SMOOTHING = 0.5
CHUNK = 1 << 20
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; fractions, powers and Roman numerals are not."""
    return any(c.isalpha() for m in LETTERS.finditer(text) for c in m.group())


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 1- to 3-character runs of the lower-cased text, a chunk at a time."""
    step = CHUNK - max(ORDERS) + 1
    for at in range(0, len(text), step):
        part = f" {text[at:at + CHUNK].lower()} "
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        for order in ORDERS:
            n = len(c) - order + 1
            h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                h = (h ^ c[k:k + n]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            yield (h >> np.uint32(32 - BITS)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """True for the documents kept for testing; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability matrix (buckets x languages), uniform prior.

    Learns from the text and the lang of rows that have an id, a text and a lang and are not
    held out, of the LANGUAGES languages with the most of them.  Of a language with more than
    ``sample`` such rows the hash of the id takes that share, so the model's input is bounded.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    rates = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    rates = scratch.keep(rates.select(F.col("lang").alias("_lang"), (F.lit(float(sample)) / F.col("n")).alias("rate")), "rates")
    languages = sorted(r._lang for r in rates.collect())
    if not languages:
        return [], np.zeros((1 << BITS, 0), np.float32)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where(share < F.col("rate")).select("lang", "text")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), 1 << BITS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for h in _grams(text.as_py()):
                    total[place[lang.as_py()]] += np.bincount(h, minlength=1 << BITS)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(bucket, pa.int64()), pa.array(total[lang, bucket], pa.int64())], names=["l", "b", "n"])

    counts = chosen.mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()  # buckets x languages at most
    matrix = np.full((1 << BITS, len(languages)), SMOOTHING)
    np.add.at(matrix, (counts.b.to_numpy(), counts.l.to_numpy()), counts.n.to_numpy())
    return languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Scores add the log probabilities of all n-grams of the whole text; ``score`` is the
    posterior of the best language.  ``und`` with score 0 for a null text, one without a
    letter, or when there is nothing to learn from.  Ties go to the first language by name.
    Repeated rows stay; columns other than doc_id, text and (to learn) lang are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    languages, matrix = fit(docs, scratch)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # 2**BITS rows, a float for each language, LANGUAGES at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            names, scores = [], []
            for value in batch.column(2):
                text = value.as_py()
                if not text or not languages or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = np.zeros(len(languages))
                for h in _grams(text):
                    total += table.take(h, axis=0).sum(axis=0, dtype=np.float64)
                best = int(np.argmax(total))
                names.append(languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")
