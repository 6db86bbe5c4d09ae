import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment as al


def test_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    for _ in range(20):
        m, k, n = rng.integers(1, 9, 3)
        dense = [rng.integers(0, 3, shape) for shape in ((m, k), (k, n))]

        def csr(d):
            rows, cols = np.nonzero(d)
            return al.CSR(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(d)))]), cols, d[rows, cols], d.shape[1])

        def back(c):
            out = np.zeros((len(c.start) - 1, c.width), int)
            out[c.rows, c.column] = c.value
            return out

        a, b = map(csr, dense)
        assert (back(a.times(b)) == (dense[0][:, :, None] * dense[1][None]).sum(axis=1)).all() and (back(a.transposed()) == dense[0].T).all()


def texts():
    rng = random.Random(5)
    words = ["the", "quick", "naïve", "Straße", "日本語", "x" * 30, "123456", "<|endoftext|>", "<s>", "don't", "emoji😀", "á", "\t", "\n\n", "  ", "é", "œuvre", "'ll"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return out + [None, "", " ", "\n", "▁", "a▁b", "\x00", "​", "ﬁ", "one", "one", "the quick", "<0x41>", " lead", "trail ", "word " * 3000]


def brute(rows):
    v = al.Vocabularies.default()
    a, b = al._sides(v)
    import sentencepiece
    from tokenizers import Tokenizer

    slow, model = Tokenizer.from_file(v.a), sentencepiece.SentencePieceProcessor(model_file=v.b)
    slow.encode_special_tokens = True
    docs = []
    for text in rows:
        ids_a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a.bytes[i] for i in ids_a) != raw or b"".join(b.bytes[i] for i in ids_b) != raw:
            ids_a = ids_b = []
        spans = []
        for ids, side in ((ids_a, a), (ids_b, b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(side.bytes[i]), i))
                at += len(side.bytes[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(ids_a) < 500 else [(x[2], y[2]) for x in spans[0] for y in spans[1][max(0, x[0] // 6 - 60):x[1] // 2 + 60] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, begin = [], 0
        for e in ends:
            groups.append(tuple([s[2] for s in side if begin <= s[0] and s[1] <= e] for side in spans))
            begin = e
        line = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        docs.append((len(ids_a), len(ids_b), groups, links, line))
    counts = Counter(p for d in docs for p in set(d[3]))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if n_a else "", sum(len(g) * len(h) for g, h in groups))
            for n_a, n_b, groups, links, line in docs]


@pytest.mark.parametrize("bound", [al.BROADCAST_PAIRS, 20, 0])
def test_scores_equal_brute_force(spark, bound):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = al.link_scores(docs, bound=bound).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")
    want = brute(rows)
    for r in got.collect():
        assert tuple(r)[1:] == want[r.doc_id], (r.doc_id, rows[r.doc_id])
    assert got.count() == len(rows)


def test_segments_change_nothing(spark, monkeypatch):
    a, b = al._sides(al.Vocabularies.default())
    encoded = [al._encoded(t, a, b) for t in texts()]
    whole = al._links(encoded, len(b.length))
    for size in (1, 7, 100):
        monkeypatch.setattr(al, "SEGMENT", size)
        cut = al._links(encoded, len(b.length))
        assert cut[1:] == whole[1:] and all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(cut[0], whole[0]))
    assert al._links([al._encoded(None, a, b)], len(b.length))[1:] == ([0], [0])


def test_links_of_both_kinds_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Donaudampfschifffahrt and internationalisation"), (None, "one two"), (None, "one two"), (3, None), (4, "")], "doc_id long, text string")
    plain, both = al.links(docs).collect(), al.links(docs, same_group=True).collect()
    assert all(r.bytes > 0 for r in plain) and {tuple(r) for r in both if r.bytes} == {tuple(r) for r in plain} and len(both) > len(plain)
    by_doc = {r.doc_id: r for r in al.link_scores(docs).collect() if r.doc_id}
    assert sum(r.doc_id == 1 for r in plain) == by_doc[1].n_links and sum(r.doc_id == 1 for r in both) == by_doc[1].n_shared
    shown = al.aligned(docs, written=True).where("doc_id = 1").first()
    assert hashlib.sha256(shown.groups.encode()).hexdigest() == shown.groups_sha256
    assert al.link_scores(docs).count() == 5 and by_doc[3].n_a == by_doc[4].n_links == 0 and by_doc[3].groups_sha256 == ""
    assert al.link_scores(docs.where(F.lit(False))).count() == 0 and al.links(docs.limit(0)).count() == 0
