"""The n-grams of a document are computed once, and all of them counted."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import let, words


def test_grams_are_computed_once_and_whole(spark):
    rng = random.Random(4)
    rows = [(i % 2, "".join(rng.choice(["ab", "c", "é", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.randint(0, 90)))) for i in range(60)] + [(0, None), (1, ""), (1, " \n")]
    docs = spark.createDataFrame(rows, "good int, text string")
    each = quality._each_gram(docs, let(words(F.col("text")), quality._grams))
    plan = each._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1, plan
    want = []
    for good, text in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        want += [(good, x, None) for x in w] + [(good, *x) for x in zip(w, w[1:])]
    grams = spark.createDataFrame(want, "good int, a string, b string").select("good", F.xxhash64("a", "b").alias("h"))
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, grams.collect()))
