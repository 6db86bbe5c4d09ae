import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import packing, pii, quality, simhash
from tidemark.llm.common import Scratch

SF = "/root/testdata/sf0.001"
#: Names that the operators use for their own columns; every stage has to hand them on.
NAMES = ["rid", "score", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fp", "root", "component_id", "fingerprint", "least_id", "node",
         "_id", "_fp", "_want", "_doc", "_row", "_q", "_hash", "_item", "_n", "_s", "_h", "_size", "_least", "_base", "_spans", "_cands", "_more", "item_id", "text_hash", "shared", "side", "half",
         "good", "b", "raw", "start", "end", "k", "p", "label", "key", "part", "features", "length", "slice", "class", "full", "rank", "whole", "sequence_id", "offset", "doc_tokens", "crcs", "quality", "toxic"]


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark)
    counts = [docs.count()]
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame
        frame = scratch.keep(stage(spark, frame, SF), "stage")
        assert frame.columns == docs.columns
        counts.append(frame.count())
        assert frame.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[4] == counts[3]
    assert simhash.near_duplicates(scratch.keep(corpus_pipeline.near_duplicates(spark, docs, SF), "again")).groupBy("component_id").count().where("count > 1").count() == 0
    assert frame.where("n_chars <> length(text)").count() == 0 and frame.where(F.size(pii.base_spans(F.coalesce("text", F.lit("")))) > 0).count() == 0
    want = packing.pack(frame).groupBy("doc_id").sum("length").count()
    got = corpus_pipeline.run(spark, SF)
    assert got.select("doc_id").distinct().count() == want
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and one column of every name the operators use."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) BETWEEN 200 AND 4000 AND doc_id < 60")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    long = " ".join(f"word{i * 7919 % 100003}" for i in range(60_000))
    given = spark.createDataFrame([(None, None, None, None, None), (1_000_001, None, "en", None, 0), (1_000_002, "", None, "src0", 0), (1_000_003, long, "en", "src1", len(long)), (None, f"{long} {item} tail", "en", "src1", 9),
                                   (1_000_004, "write to jane.doe@example.org or +44 20 7946 0958 0 soon please and thank you all very much", "en", "src1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.unionByName(given).unionByName(plain.where("doc_id < 20")).unionByName(given.where("doc_id IS NULL"))
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])
    return Scratch(spark).keep(docs, "odd")


@pytest.mark.parametrize("i", range(4))
def test_stage_hands_on_every_column(spark, odd, i):
    out = Scratch(spark).keep(corpus_pipeline.STAGES[i][1](spark, odd, SF), "out")
    assert out.columns == odd.columns and out.count() > 0
    assert out.drop("n_chars").exceptAll(odd.drop("n_chars")).where("text NOT LIKE '%[%]%'").count() == 0  # only redacted rows are new
    spoilt = " OR ".join(f"`{n}` <> concat('{n}:', coalesce(cast(doc_id AS string), '-'))" for n in NAMES)
    assert out.where(spoilt).count() == 0
    none = corpus_pipeline.STAGES[i][1](spark, odd.where(F.lit(False)), SF)
    assert none.count() == 0 and none.columns == odd.columns


def test_each_stage_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    n = odd.count()
    judged = quality.judge(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    assert judged.count() == n and judged.where("kept AND (text IS NULL OR text = '')").count() == 0
    single = Scratch(spark).keep(stages["near-duplicates"](spark, odd, SF), "single")
    assert single.where("coalesce(text, '') = ''").count() == 1 and single.groupBy("text").count().where("count > 1").count() == 0
    clean = stages["decontamination"](spark, odd, SF)
    assert clean.where("doc_id IS NULL AND text IS NOT NULL").count() == 0 and clean.where("doc_id = 1000003 OR coalesce(text, '') = ''").count() == odd.where("doc_id = 1000003 OR coalesce(text, '') = ''").count()
    cut = stages["personal data"](spark, odd, SF)
    assert cut.count() == n and cut.where("doc_id = 1000004").first().text.startswith("write to [EMAIL] or [PHONE]")
    assert cut.where("text IS NULL").count() == odd.where("text IS NULL").count()
    pieces = stages["packing"](spark, odd, SF)
    assert pieces.where("start = 0").count() == n and stages["packing"](spark, odd.where(F.lit(False)), SF).count() == 0
