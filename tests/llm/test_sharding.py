import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def least_capacity(sizes, n):
    """The smallest largest part of a contiguous partition, by dynamic programming."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = sums.astype(float)
    for _ in range(n - 1):
        best = np.array([min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))])
    return int(best[-1])


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, size double, key string, _row int")


def made(rng, n):
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 300))) for _ in range(n)] + ["x" * 9000, None, ""]
    return texts


def test_least_capacity_and_even_shards(spark):
    rng = random.Random(3)
    texts = made(rng, 300) + ["copy"] * 40
    rows = [(i, t, "mine", 7, 0.5, "k", 1) for i, t in enumerate(texts)]
    got = sharding.shard(frame(spark, rows), 8).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    shards, of_text = {}, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        of_text.setdefault(texts[r.doc_id] or "", set()).add(r.shard)
    assert all(len(v) == 1 for v in of_text.values()) and set(shards) == set(range(8))
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    alone = [v for v in shards.values() if len(v) == 1]
    rest = [v for v in shards.values() if len(v) > 1]
    assert [r.size for v in alone for r in v] == [9008]  # larger than an even share of all
    groups = {}
    keys = {r.doc_id: r.k for r in frame(spark, rows).select("doc_id", sharding.key_of(F.col("text")).alias("k")).collect()}
    for r in got:
        if r.size < 9000:
            groups[keys[r.doc_id]] = groups.get(keys[r.doc_id], 0) + r.size
    want = least_capacity([groups[k] for k in sorted(groups)], 7)
    sums = [sum(r.size for r in v) for v in rest]
    assert max(sums) == want and min(sums) > 0.8 * want
    order = sorted((keys[r.doc_id], r.shard) for v in rest for r in v)
    assert [s for _, s in order] == sorted(s for _, s in order)  # shards are stretches of the key order


@pytest.mark.parametrize("seed", range(4))
def test_refined_blocks_give_the_same_cuts(spark, seed):
    rng = random.Random(seed)
    sizes = [(rng.getrandbits(60), rng.randint(8, rng.choice([20, 400]))) for _ in range(500)]
    groups = spark.createDataFrame(sizes, "key long, size long")
    n = rng.choice([3, 9, 24])
    whole, ordered = sharding.plan(groups, n, first_bits=60), sorted(sizes)
    cut = lambda p: (p.alone, np.searchsorted([k for k, _ in ordered], p.borders).tolist())
    assert cut(sharding.plan(groups, n, first_bits=3, more_bits=2)) == cut(whole) == cut(sharding.plan(groups, n))
    parts = cut(whole)[1]
    sums = [sum(s for _, s in part) for part in np.split(np.array(ordered, object), parts)]
    assert not whole.alone and len(sums) == n and max(sums) == least_capacity([s for _, s in ordered], n)


def test_hot_group_null_ids_repeated_rows_and_none(spark, tmp_path):
    rows = [(None, "same words here", "s", 0, 0.0, "k", 1)] * 60 + [(5, f"text {i % 20}", "s", 0, 0.0, "k", 1) for i in range(40)] + [(i, f"other {i} " * 3, "s", 0, 0.0, "k", 1) for i in range(60)]
    docs = frame(spark, rows)
    got = sharding.shard(docs, 5).collect()
    assert len(got) == len(rows)
    hot = {r.shard for r in got if r.doc_id is None}
    assert len(hot) == 1 and all(r.doc_id is None for r in got if r.shard in hot)
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(docs.limit(0), 5).count() == 0
    few = sharding.shard(docs.where("doc_id = 5 OR doc_id IS NULL"), 24)
    assert few.groupBy("shard").count().count() == 22  # a shard for each text, the others empty
    sharding.write(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "_shard"] and back.drop("_shard").exceptAll(docs).count() == 0 and back.count() == len(rows)
    assert back.where("doc_id IS NULL").select("_shard").distinct().count() == 1
