"""The corpus pipeline: documents through quality rules, near-duplicates, decontamination, redaction and packing.

Every stage takes rows with ``doc_id`` and ``text`` and any further columns, whose names may
be those of the operators' own results: they are handed on untouched.  Null columns,
repeated rows and ids, and empty tables go through; what becomes of null and empty texts is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, packing, pii, quality, simhash
from tidemark.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules.

    Null, empty and very short texts fail them; very long ones are judged whole.  Each row
    is judged by itself, so repeated rows stay or go together.  No documents give none.
    """
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose fingerprints (3-word shingles) are linked by two bits or less.

    Null and empty texts have fingerprint zero and are one group.  Of repeated rows one
    stays; rows without an id take part.  No documents give none.
    """
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item.

    Null and empty texts contain none and stay, whole long texts are searched, repeated
    rows go together, and rows without an id are compared like others.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows the text.

    Null and empty texts stay as they are; every row is kept, repeated ones alike.
    """
    out = pii.redact(docs)
    return out.selectExpr(*["CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences; one row for each piece.

    A null or empty text is one piece with the end id, a long one as many as it fills;
    repeated rows have pieces of their own.  Other columns are not read.
    """
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", redaction), ("packing", packed)]

#: SQL has neither the hash of the fingerprints nor the fitted models and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read back as the next one's input."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(before)
    return docs
