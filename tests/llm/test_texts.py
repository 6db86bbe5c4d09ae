"""Decontamination, licenses, page text, languages and URL rules on small hand-made cases."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, html_text, langid, licenses, url_rules


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_contained_items_match_brute_force(spark):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(60)]
    make = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [make(n) for n in (5, 6, 9, 14, 30, 31, 32, 64, 100, 3)] + [[]]
    docs = []
    for k in range(80):
        w = make(rng.randint(0, 300))
        it = list(rng.choice(items))
        for _ in range(rng.randint(0, 3)):
            if it:
                it[rng.randrange(len(it))] = "other"
        at = rng.randint(0, len(w))
        docs.append(w[:at] + it + w[at:])
    docs += [items[0], items[9], [], items[4] * 20]
    d = [(i, " ".join(w).upper() if i % 3 else ", ".join(w), 1) for i, w in enumerate(docs)] + [(900, None, 1), (None, " ".join(items[5]), 1), (2, " ".join(items[6]), 1)]
    t = [(i, " ".join(w), 1) for i, w in enumerate(items)] + [(50, None, 1)]
    df, tf = spark.createDataFrame(d, "doc_id long, text string, item_id int"), spark.createDataFrame(t, "item_id long, text string, doc_id int")
    want = set()
    for i, x, _ in d:
        for j, y, _ in t:
            if shingles(y) and 10 * len(shingles(x) & shingles(y)) >= 8 * len(shingles(y)):
                want.add((i, j, len(shingles(x) & shingles(y))))
    got = {(r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(df, tf).collect()}
    assert got == want and len(want) > 20
    bad = {i for i, _, _ in want}
    kept = decontaminate.drop_contaminated(df, tf)
    assert kept.columns == df.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {i for i, _ in rows} >= {i for i, _, _ in d} - bad and (2, d[2][1]) in rows or 2 in {i for i, j, _ in want if j != 6}
    assert decontaminate.drop_contaminated(df, tf.limit(0)).count() == len(d) and decontaminate.drop_contaminated(df.limit(0), tf).count() == 0


def test_large_sides_take_the_shuffled_way(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "a b c d q")], "doc_id long, text string")
    tf = spark.createDataFrame([(7, "a b c d e f g h")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contained_items(df, tf).collect()] == [(1, 7)]


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_license_sentences_and_sequences(spark):
    cases = {
        "text\nReleased under the MIT License.": (["MIT"], ["is-mit"]),
        "x. Licensed under the Apache License, Version 2.0.": (["Apache-2.0"], ["is-apache-2.0"]),
        "This work is licensed under the GNU General Public License, version 3.": (["GPL-3.0"], ["is-gpl-3.0"]),
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.": (["CC-BY-NC-4.0"], ["is-cc-by-nc-4.0"] * 2),
        "SPDX-License-Identifier: BSD-3-Clause\n": (["BSD-3-Clause"], ["is-bsd-3-clause"]),
        MIT: (["MIT"], ["mit-grant", "mit-notice"]),
        "The committee was licensed under the old law of the land.": ([], []),
        "All rights reserved.\nReleased under the MIT License": (["Proprietary", "MIT"], ["rights", "is-mit"]),
        "": ([], []), "no such thing": ([], []),
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)] + [(99, None, "x")], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan(df, ["doc_id"]).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ([], [])
    assert all(re.search(licenses.GATE, k if not k.startswith("under ") else "licensed " + k) for k in licenses.known())
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><a href=/>Home of the site with some words</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
    <div class="cookie-notice">We use cookies to make this site better for you and for us.</div><!-- x -->
    <div class="ad">Buy this now, it is a very good offer for all of you.</div>
    <article><h1>The &amp; title</h1><p><b>First
       paragraph</b> of the text, which is long enough to be told from menus.<br>next<p>Short.</p>
    <aside>Read also: another story about something else</aside><p>Second paragraph, that again holds a fair number of words &eacute;.</p>
    <section id="comments"><p>Reader: I do not agree with any of this at all, sorry.</p></section></article>
    <form><label>Mail</label><input><button>Send</button></form><footer>&copy; all of it</footer></body></html>"""
    assert html_text.main_text(page) == "The & title First paragraph of the text, which is long enough to be told from menus. next Short. Second paragraph, that again holds a fair number of words é."
    plain = "<div id=menu>a | b</div><div><p>Only a division holds this article, no other tag does it.</p><p>And it goes on a little.</p></div><div class=footer>end of page text</div>"
    assert html_text.main_text(plain) == "Only a division holds this article, no other tag does it. And it goes on a little."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<nav>only a menu</nav>")] == [""] * 4
    assert html_text.main_text("no markup at all") == "no markup at all"
    big = "<article>" + "<p>word word word</p>" * 30_000 + "</article>"
    assert len(html_text.main_text(big)) == 30_000 * 15 - 1


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>hello there</p></article>", "x"), (1, "u", "<article><p>hello there</p></article>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(0, None, "", 0), (1, "u", "hello there", 11), (1, "u", "hello there", 11)] and html_text.extract(df.limit(0)).count() == 0


def test_languages_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(test) > 100 and sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (2, "", None), (None, "the words of it", "fr"), (5, "the only words here", "en"), (6, "x" * 100_000, "en")], "doc_id long, text string, lang string")
    preds = {(r.doc_id, r.lang_pred) for r in langid.predict(odd).collect()}
    assert {(1, "und"), (2, "und")} <= preds and langid.predict(odd).count() == 6
    assert {r.lang_pred for r in langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_url_rules_and_mined_rules(spark):
    urls = {"http://A.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
            "http://x.org/": ("x.org", "/", "org/", "allow"), "http://x.org": ("x.org", "", None, "allow"), "http://b.com/fr/2#t": ("b.com", "/fr/2", "com/fr/", "allow"), "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
            "http://notcom/de/": ("notcom", "/de/", None, "allow"), "mailto:x": ("", "", None, "allow"), "": ("", "", None, "allow"), "x://H\n.org/a": ("h\n.org", "/a", "org/", "allow")}
    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(90, None, "r")]
    rows += [(1000 + i, f"http://bad{i % 3}.net/win/{i}", "r") for i in range(60)] + [(2000 + i, f"http://good{i % 5}.net/news/{i}", "r") for i in range(200)] + [(5000, "http://bad1.net/win/77", "r"), (5001, "http://good1.net/win/news", "r")]
    rows += [(6000, "http://q.net/" + "/".join(f"s{i}" for i in range(60)), "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    labels = spark.createDataFrame([(1000 + i, 0, 0) for i in range(50)] + [(2000 + i, 1, 0) for i in range(150)] + [(6000, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, want in enumerate(urls.values()):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == want, (i, by[i])
    assert by[90].verdict == "allow" and by[90].host == "" and by[5000].verdict == "block" and by[1059].verdict == "block" and by[2199].verdict == "allow"
    assert {r.verdict for r in url_rules.judge(pages.where("page_id >= 1000"), labels.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), labels).count() == 0


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(i, "the quick brown fox jumps over it" if i % 2 else "der schnelle braune Fuchs springt", "en" if i % 2 else "de") for i in range(40)]
                                 + [(100 + i, t, "en") for i, t in enumerate(["½", "² ³", "Ⅷ", "12 _ 3", "", None])] + [(200, "ª quick fox", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs).collect()}
    assert all(got[100 + i] == ("und", 0.0) for i in range(6)) and got[200][0] in ("en", "de")


def test_language_scores_equal_plain_naive_bayes(spark):
    rng = random.Random(3)
    words = {"aa": ["tala", "mona", "riva"], "bb": ["krun", "zolt", "prax"], "cc": ["tala", "krun", "öäü"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 9))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(docs).collect()
    held = {r.doc_id for r in out if r.held_out}
    import math
    from collections import Counter

    counts = {x: Counter() for x in words}
    grams = lambda t: [int(h) for part in langid._grams(t) for h in part]
    for i, t, lang in rows:
        if i not in held:
            counts[lang].update(grams(t))
    size, total = 1 << langid.BITS, {x: sum(c.values()) for x, c in counts.items()}
    for r in out:
        logs = {x: sum(math.log((counts[x][h] + langid.SMOOTHING) / (total[x] + langid.SMOOTHING * size)) for h in grams(rows[r.doc_id][1])) for x in words}
        best = max(logs.values())
        share = 1 / sum(math.exp(v - best) for v in logs.values())
        assert logs[r.lang_pred] >= best - 1e-3 and abs(r.score - share) < 1e-3
