import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import Scratch
from tidemark.llm.components import components


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts():
    rng = random.Random(5)
    pool = "the of and to red blue Green cat DOG sun moon École ß naïve".split()
    base = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    out = list(base)
    for b in base[:15]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "odd"
            out.append(" ".join(v))
    return out + [None, "", " \n\t ", "one", "one two", "ONE  two", "a b c", "x" * 70000, "w " * 30000, "nb sp x y z", out[3], out[3]]


def test_against_brute_force(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long")
    fps = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups(fps)
    for crowded in (64, 1):
        got = {r.doc_id: r for r in simhash.near_duplicates(docs.select("doc_id", "text", "fp", "root"), crowded=crowded).collect()}
        assert len(got) == len(rows)
        assert [got[i].fingerprint for i in range(len(rows))] == [f"{f:016x}" for f in fps]
        assert [got[i].component_id for i in range(len(rows))] == groups
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_links_between_random_fingerprints(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps for _ in range(8)]
    fps += [fps[0] ^ (1 << b) for b in range(64)] + [fps[0] ^ 3 ^ (1 << b) for b in range(2, 64)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    groups = brute_groups(fps)
    for crowded in (2, 64, 10_000):
        scratch = Scratch(spark)
        got = {r.node: r.root for r in components(simhash.links(df, scratch, crowded), scratch).collect()}
        found = {}
        for f, g in zip(signed, groups):
            found.setdefault(g, set()).add(got.get(f, f))
        assert all(len(v) == 1 for v in found.values()) and len({min(v) for v in found.values()}) == len(found)


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, i) for i in range(1001, 1400)]
    back = [(5000 - i, 5001 - i) for i in range(50)]
    edges = spark.createDataFrame(chain + star + back + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400)) and all(got[5001 - i] == 4951 for i in range(50))
    assert components(edges.limit(0), Scratch(spark)).count() == 0


def test_null_and_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "p q r s"), (None, "p q r s"), (3, "p q r s"), (3, "p q r s"), (4, "z y x w v"), (4, "k l m n o p q"), (None, "only nulls here now")], "doc_id long, text string")
    got = simhash.near_duplicates(docs)
    assert got.count() == 7 and got.where("fingerprint IS NULL").count() == 0
    assert {r.component_id for r in got.where("doc_id = 3 OR doc_id IS NULL").collect()} == {3, None}
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.one_per_group(docs).collect())
    assert kept == [(-1, "only nulls here now"), (3, "p q r s"), (4, "k l m n o p q"), (4, "z y x w v")]
    none = docs.where(F.lit(False))
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_per_group(none).count() == 0
