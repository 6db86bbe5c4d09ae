import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import let, words


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", s)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= set(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(2)
    pool = ["a", "b", "c", "dé", "x|y", "#", "€", "\n", " \n", "\t", "q\x0bz", "nb\u00a0sp"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    return out + [None, "", " \n\t\r\x0b\x0c ", "x", "a b c d e a b c d e", "a a a a a a a", "l\nl\nl\n\n\n", "w " * 4000, "one two three four five " * 300, "\n".join(["same line here"] * 50)]


def test_counts_match_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    got = df.select("doc_id", let(words(F.col("text")), lambda w: F.struct(*quality.base_counts(w, text))).alias("c")).collect()
    for r in got:
        assert tuple(r.c) == brute(rows[r.doc_id][1]), rows[r.doc_id]


def test_junk_goes_clean_stays(spark):
    rng = random.Random(6)
    pool = [f"w{i}" for i in range(300)]
    clean = [" ".join(rng.choice(pool) for _ in range(rng.randint(12, 200))) for _ in range(300)]
    junk = [" ".join(rng.choice(pool) + rng.choice(["%%%", "###", "$$$"]) for _ in range(rng.randint(12, 200))) for _ in range(100)]
    rows = [(i, t, 5, 1.0) for i, t in enumerate(clean + junk)] + [(900, None, 5, 1.0), (901, "", 5, 1.0), (902, "too short", 5, 1.0), (None, clean[0], 5, 1.0), (3, clean[3], 5, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, score double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150)] + [(300 + i, 0, 0) for i in range(50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels)
    assert got.count() == len(rows) and got.columns.count("n_words") == 1
    kept = {(r.doc_id, r.text) for r in got.where("kept").collect()}
    ids = {k[0] for k in kept}
    assert all(i in ids for i in range(300)) and None in ids and not ids & set(range(300, 400)) and not ids & {900, 901, 902}
    again = {(r.doc_id, r.text) for r in quality.judge(docs, labels).where("kept").collect()}
    assert again == kept
    no_labels = quality.judge(docs, labels.limit(0))
    assert no_labels.where("kept").count() == no_labels.where("NOT base_failed").count()
    assert quality.judge(docs.where(F.lit(False)), labels).count() == 0


def test_toxic_documents_of_good_quality_go(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(2000)]
    insults = [f"insult{i}" for i in range(10)]

    def text(toxic):
        w = [rng.choice(pool) for _ in range(rng.randint(60, 400))]
        for x in rng.sample(insults, 3) if toxic else ():
            w[rng.randrange(len(w))] = x
        return " ".join(w)

    toxic = [i % 5 == 0 for i in range(1000)]
    docs = spark.createDataFrame([(i, text(t)) for i, t in enumerate(toxic)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(500)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    held_out = range(500, 1000)  # without labels
    assert sum(i in kept for i in held_out if toxic[i]) <= 5 and sum(i not in kept for i in held_out if not toxic[i]) <= 4
