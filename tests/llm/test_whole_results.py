"""Page text, URL rules and licenses: nothing lost to a cap, a class word or one of two cuts."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, licenses, url_rules

WORDS = "word " * 60
THREE = "".join(f"<p>{WORDS}</p>" for _ in range(3))
ARTICLE = " ".join([WORDS.strip()] * 3)


@pytest.mark.parametrize("page", [
    f'<div class="content has-sidebar">{THREE}</div>', f'<article class="post no-comments">{THREE}</article>', f'<div class="search-page">{THREE}</div>', f"<form action=x>{THREE}</form>",
    f'<nav>Home News</nav><main><div class="page-with-sidebar">{THREE}</div><aside>Other</aside></main>', f'<article>{THREE}</article><section class="comments">{THREE * 5}</section>',
    f'<div class="wrap">{THREE}<div id="comments">{THREE * 4}</div></div><h1 class="banner">Buy</h1>'])
def test_marks_do_not_drop_the_page_and_comments_go(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == ARTICLE


def test_headline_and_sibling_parts_stay():
    assert html_text.main_text(f'<body><article><header class="entry-header"><h1>Headline</h1></header>{THREE}</article></body>') == "Headline " + ARTICLE
    last = "last " * 50
    got = html_text.main_text(f'<body><div id="text"><div>{THREE * 4}</div><div><p>{last}</p></div></div></body>')
    assert got.endswith(last.strip()) and got.startswith(WORDS.strip())


def test_deeply_nested_pages_take_linear_time():
    began = time.process_time()
    assert html_text.main_text("<div>" * 40_000 + "x " * 50).split() == ["x"] * 50
    html_text.main_text("<div>" * 40_000 + "</section>" * 40_000 + "<p>a</p>" * 1000)
    assert time.process_time() - began < 8


def plain_rules(rows):
    """Blocked pages by all rules: tokens that each speak for bad pages, together in enough of them and rarely elsewhere."""
    n, bad = len(rows), sum(b for _, b in rows)
    least, usual = max(url_rules.SUPPORT * n, url_rules.LEAST), bad / n
    tell = lambda s: (lambda hit: (sum(hit), sum(hit) / len(hit) if hit else 0))([b for t, b in rows if s <= t])
    single = {t: tell({t}) for t in set().union(*(t for t, _ in rows))}
    good = lambda x: x[0] >= least and x[1] >= url_rules.CONFIDENCE and x[1] >= url_rules.LIFT * usual
    rules = [{t} for t, x in single.items() if good(x)]
    open_ = [t for t, x in single.items() if x[0] >= least and not good(x) and x[1] > usual]
    left = [(t, b) for t, b in rows if not any(r <= t for r in rules)]
    tell = lambda s: (lambda hit: (sum(hit), sum(hit) / len(hit) if hit else 0))([b for t, b in left if s <= t])
    rules += [set(s) for k in (1, 2, 3, 4) for s in itertools.combinations(open_, k) if good(tell(set(s)))]
    return {i for i, (t, _) in enumerate(rows) if any(r <= t for r in rules)}


def pages(spark, rows):
    urls = [(i, "http://h.net/" + "/".join(sorted(t))) for i, (t, _) in enumerate(rows)]
    return spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(rows)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"t{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(260):
        t = set(rng.sample(names, rng.randint(2, 6)))
        bad = {"ta", "tb"} <= t or "tc" in t and rng.random() < 0.8 or rng.random() < 0.08
        rows.append((t, int(bad)))
    got = {r.page_id for r in url_rules.judge(*pages(spark, rows)).where("verdict = 'block'").collect()}
    assert got == plain_rules(rows) and got


@pytest.mark.parametrize("width", [10, 30])
def test_a_rare_telling_token_is_found_in_urls_of_any_width(spark, width):
    rng = random.Random(width)
    names = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(2 * width)]
    for draw in (lambda: names[:width], lambda: rng.sample(names, width)):
        rows = [(set(draw()) | ({"casino"} if i < 30 else set()), int(i < 30)) for i in range(400)]
        blocked = {r.page_id for r in url_rules.judge(*pages(spark, rows)).where("verdict = 'block'").collect()}
        assert blocked == set(range(30))


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n'
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."


def test_licenses_in_every_form(spark):
    hashed, starred = "\n".join(("# " + x).rstrip() for x in MIT.split("\n")), "/*\n" + "\n".join((" * " + x).rstrip() for x in MIT.split("\n")) + "\n */"
    cases = [(APACHE + "\n" + MIT, {"Apache-2.0", "MIT"}), (" ".join(APACHE.split()), {"Apache-2.0"}), (hashed, {"MIT"}), (starred, {"MIT"}), (MIT.replace("\n", "\r\n"), {"MIT"}), (MPL, {"MPL-2.0"}),
             ("This project is licensed under the MIT License - see the LICENSE file for details.", {"MIT"}), ("Released under the Apache 2.0 license, or the terms below.", {"Apache-2.0"}),
             ("We spoke about the MIT License. It was licensed under protest.", set()), (None, set()), ("", set()), ("plain text\n" * 3000 + APACHE, {"Apache-2.0"})]
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases)] * 2, "doc_id long, text string, licenses string")
    got = licenses.scan(docs, ["doc_id"]).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert set(r.licenses) == cases[r.doc_id][1], (r, cases[r.doc_id][0])
    both = next(r for r in got if r.doc_id == 0)
    assert both.sentence_ids == ["apache-grant", "apache-use", "apache-copy", "mit-grant", "mit-notice", "mit-warranty"]  # in the order of the text


def test_order_is_that_of_the_words(spark):
    text = MIT + "\n" + APACHE + "\n" + MIT
    ids = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).first().sentence_ids
    assert ids == ["mit-grant", "mit-notice", "mit-warranty", "apache-grant", "apache-use", "apache-copy", "mit-grant", "mit-notice", "mit-warranty"]
    assert licenses.scan(spark.createDataFrame([(1, "")], "doc_id long, text string").where(F.lit(False)), ["doc_id"]).count() == 0
