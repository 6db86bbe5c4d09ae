import random
import re
from collections import Counter, defaultdict

from tidemark.llm import divergence


def brute(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(term.findall((text or "").translate(low)))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = [t for t in df if df[t] >= min_docs]
        count = defaultdict(Counter)
        for _, s, c in own:
            count[s].update({t: c[t] for t in kept if t in c})
        share = lambda c: (lambda n: {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c.values()))
        q = share(sum(count.values(), Counter()))
        p = {s: share(count[s]) for s in {d[1] for d in own}}
        ranked = lambda part, found, s: [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())))]
        for s in p:
            out += ranked("pair", [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s], s)
            out += ranked("term", [(t, p[s][t] - q[t]) for t in kept if count[s][t] and p[s][t] > q[t]], s)[:top]
    return sorted(out)


def test_equals_brute_force_in_blocks_of_any_size(spark):
    rng = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}" for i in range(60)] + ["UPPER", "ÀB", "x_y", "a1b", "日本", "naïve", " "]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "de", None, "", "xx"]) if i % 9 else "en"
        source = "hot" if i % 3 == 0 else rng.choice([f"s{k}" for k in range(9)] + [None, "é", "Z"])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.choice([5, 67])]) for _ in range(rng.randint(0, 60)))))
    rows += [("one", "alone", "nothing kept here"), ("two", "a", None), ("two", "b", ""), ("en", "hot", None)] + rows[:5]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    want = brute(rows, 4, 6)
    for group_block, term_block in ((64, 512), (3, 7), (1, 1)):
        got = divergence.audit(docs, 4, 6, group_block, term_block)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_very_long_text_is_read_match_by_match(spark, monkeypatch):
    text = "Alpha beta, " * 1000 + "é" * 50 + "9z"
    whole = divergence._terms(text)
    monkeypatch.setattr(divergence, "LONG_TEXT", 10)
    assert divergence._terms(text) == whole == Counter({b"alpha": 1000, b"beta": 1000, ("é" * 50).encode(): 1, b"z": 1})
