"""Mined rules hold for every token that they were found with."""

from test_whole_results import pages
from tidemark.llm import url_rules


def test_any_of_tokens_that_came_together_stands_for_them(spark):
    rows = [({"ta", "tx"}, 0)] * 20 + [({"ta", "tx"}, 1)] * 8 + [({"tb", "ty"}, 0)] * 20 + [({"tb", "ty"}, 1)] * 8 + [({"ta", "tx", "tb", "ty"}, 1)] * 10 + [({"tz"}, 0)] * 34
    urls, labels = pages(spark, rows + [({"tx", "tb"}, 0), ({"ta", "ty"}, 0), ({"tx", "ty"}, 0), ({"ta", "tx"}, 0)])
    got = {r.page_id for r in url_rules.judge(urls, labels.where("doc_id < 100")).where("verdict = 'block'").collect()}
    assert got == {*range(56, 66), 100, 101, 102}
