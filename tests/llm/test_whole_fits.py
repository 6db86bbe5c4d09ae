"""Models and thresholds come from every row there is, not from a sample."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, quality
from tidemark.llm.common import Scratch


class Kept(Scratch):
    """Remembers what was written under which name."""

    def __init__(self, spark):
        super().__init__(spark)
        self.tables = {}

    def keep(self, df, name):
        self.tables[name] = super().keep(df, name)
        return self.tables[name]


def test_every_candidate_counts(spark):
    n = 5000
    text = F.concat(F.lit("call "), F.when(F.col("id") % 2 == 0, F.concat(F.lit("+1 555 "), F.lpad(F.col("id").cast("string"), 7, "1"))).otherwise(F.concat(F.lit("12:30 "), F.lpad(F.col("id").cast("string"), 8, "9"))))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    scratch = Kept(spark)
    pii.find(docs, ["doc_id"], scratch).count()
    all_of = scratch.tables["candidates"].count()
    assert all_of >= n and scratch.tables["shapes"].agg(F.sum("n")).first()[0] == all_of
    assert scratch.tables["shapes"].count() < n / 10


@pytest.mark.parametrize("blocks", [quality.BIT_BLOCKS, 0])
def test_every_label_is_used(spark, monkeypatch, blocks):
    monkeypatch.setattr(quality, "BIT_BLOCKS", blocks)
    ids = [*range(-40, 40), 32_767, 32_768, 32_769, 65_536, -32_768, -32_769, 10**12, None]
    labels = [(i, 0 if j % 3 == 0 else None if j % 11 == 0 else 1, 1 if j % 4 == 0 else None if j % 5 == 0 else 0) for j, i in enumerate(ids) if j % 7] + [(5, 1, 0), (5, 0, 1), (None, 1, 0)]
    docs = spark.createDataFrame([(i, "x") for i in ids + [5]], "doc_id long, text string")
    got = quality._sided(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), Scratch(spark)).collect()
    assert len(got) == len(ids) + 1
    for r in got:
        mine = [(q, t) for i, q, t in labels if i == r.doc_id and i is not None]
        assert (r.good, r.bad, r.toxic) == (any(q == 1 and not t for q, t in mine), any(q == 0 for q, _ in mine), any(t == 1 for _, t in mine)), r


def test_threshold_from_counted_scores():
    assert quality._parting({1.0: 999, 0.5: 1}, {0.0: 5, 0.6: 5}) == 0.8
    assert quality._parting({1.0: 99, 0.5: 1}, {0.0: 5, 0.6: 5}) == 0.25
    assert quality._parting({}, {1.0: 2}) is None
