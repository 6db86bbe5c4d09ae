import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing


def texts():
    rng = random.Random(9)
    pool = "the of And été straße naïve 12 345 ... !! \n \t don't we'll x€y 日本 <|endoftext|> | a\u00a0b \x85 ½".split(" ")
    out = [" ".join(rng.choice(pool) for _ in range(int(rng.expovariate(1 / 300)) + 1)) for _ in range(120)]
    return out + [None, "", "a", "z" * 9000, "word " * 9000, out[0], out[0]]


def test_pieces_round_trip(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "no id", 1), (3, "same id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    pieces = packing.pack(df, keep_ids=True)
    got = [r.asDict() for r in pieces.collect()]
    seqs = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        assert any(ids[r["start"]:r["start"] + r["length"]] == r["ids"] and len(ids) == r["doc_tokens"] for ids in want[r["doc_id"]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(len(x) for v in want.values() for x in v)
    for i, v in want.items():
        assert sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i) == sorted((a, min(2048, len(x) - a)) for x in v for a in range(0, len(x), 2048))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 2048) * 1.06 + 1
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(pieces).collect()}
    assert whole == {s: sum(n for _, n in p) for s, p in seqs.items()}
    assert packing.pack(df.limit(0)).count() == 0


def test_fast_and_slow_ids_agree_on_latin():
    ids = packing._encoder(packing.default_vocabulary())
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    chars = [chr(c) for c in range(256)]
    for _ in range(1500):
        t = "".join(rng.choice(chars) * rng.choice((1, 1, 2)) for _ in range(rng.randint(1, 60)))
        assert ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_patterns_cover_demand_near_the_bound():
    rng = random.Random(4)
    for room, n in ((128, 1), (128, 7), (128, 5000), (64, 100_000)):
        demand = {}
        for _ in range(n):
            c = min(room, int(rng.expovariate(3 / room)) + 1)
            demand[c] = demand.get(c, 0) + 1
        got = packing.patterns(demand, room)
        assert all(sum(c * k for c, k in p.take.items()) <= room and p.bins > 0 for p in got)
        assert all(sum(p.take.get(c, 0) * p.bins for p in got) >= k for c, k in demand.items())
        assert sum(p.bins for p in got) <= -(-sum(c * k for c, k in demand.items()) // room) * 1.02 + 1
    assert packing.patterns({}, 128) == []
    assert sum(p.bins for p in packing.patterns({128: 9, 65: 4}, 128)) == 13


def test_long_runs_of_blanks_are_encoded():
    vocabulary = packing.default_vocabulary()
    slow = Tokenizer.from_file(vocabulary[0])
    text = "a" + " " * 700_000 + "b"
    assert packing._encoder(vocabulary)(text).tolist() == slow.encode(text, add_special_tokens=False).ids
