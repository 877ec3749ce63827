from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leafmill.sources import markdown


def blocks(spark, *sources):
    d = spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string")
    return markdown.markdown_blocks(d).orderBy("doc_id", "text_id", "block").collect()


CASES = {
    "# One\n\ntext\nmore\n\nTitle\n=====\nsub\n---\n### Three ###": [("heading", 1, "One"), ("paragraph", None, "text more"), ("heading", 1, "Title"), ("heading", 2, "sub"), ("heading", 3, "Three")],
    "```py\n# no heading\n\n- no item\n``\n```\nafter\n~~~\nopen to the end": [("code", None, "# no heading\n\n- no item\n``"), ("paragraph", None, "after"), ("code", None, "open to the end")],
    "    code\n\n    more\n\n\npara\n    lazy": [("code", None, "code\n\nmore"), ("paragraph", None, "para lazy")],
    "> a\nlazy\n> b\n\nout\n\n---\n***": [("quote", None, "a lazy b"), ("paragraph", None, "out"), ("rule", None, None), ("rule", None, None)],
    "<!-- pagebreak -->\n<div>\nx\n</div>\n\np": [("page-break", None, None), ("omitted", None, None), ("paragraph", None, "p")],
    "\n\n": [], "": [], "#hash\n####### seven": [("paragraph", None, "#hash ####### seven")], "a\r\nb\rc": [("paragraph", None, "a b c")],
}


def test_blocks(spark):
    found = {s: [] for s in CASES}
    for r in blocks(spark, *CASES):
        found[list(CASES)[r["doc_id"]]].append((r["kind"], r["level"], r["text"]))
    assert found == CASES
    assert [r["language"] for r in blocks(spark, "```py x\n```\n```\n```")] == ["py", None]


def test_lists(spark):
    one, two, three, four = (r for r in blocks(spark, "- a\n  more\nlazy\n  - b\n    1. c\n- d\n\n  still d\n\n- e\n\nnew", "3. x\n4) y\n- z") if r["kind"] == "list" or r["text"] == "new")
    assert [tuple(i) for i in one["items"]] == [(0, False, "a more lazy"), (1, False, "b"), (2, True, "c"), (0, False, "d still d"), (0, False, "e")]
    assert two["text"] == "new" and (three["ordered"], three["start"], [i["text"] for i in three["items"]]) == (True, 3, ["x", "y"])
    assert (four["ordered"], four["start"], [i["text"] for i in four["items"]]) == (False, None, ["z"])


def test_tables(spark):
    rows = blocks(spark, "before\n| a | b\\|c |\n|:--|--:|\n| 1 | 2 |\n3 | 4\n\nx | y", "a|b\nno delimiters")
    assert [(r["kind"], r["rows"]) for r in rows] == [("paragraph", None), ("table", [["a", "b|c"], ["1", "2"], ["3", "4"]]), ("paragraph", None), ("paragraph", None)]


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, "# a", "clash"), (1, "# a", "clash"), (None, "b", "clash"), (2, None, "clash")], "doc_id long, source string, block string")
    got = markdown.markdown_blocks(d).collect()
    assert sorted((str(r["doc_id"]), r["kind"], r["block"]) for r in got) == [("1", "heading", 0), ("1", "heading", 0), ("None", "paragraph", 0)] and len({r["text_id"] for r in got}) == 3
    long = spark.createDataFrame([(1, "- item\n  text\n" * 20_000)], "doc_id long, source string")
    assert markdown.markdown_blocks(long).select(F.size("items")).first()[0] == 20_000


@pytest.mark.parametrize(("text", "plain"), [("a **b _c_** `d*`", "a b c d*"), ("![f](g) ![](h) [i](http://j)", "[Image: f] [Image] i"), ("snake_case_name \\*k\\* ~~l~~ 2 * 3 * 4", "snake_case_name *k* l 2 * 3 * 4")])
def test_inline_marks(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(markdown.inline_plain(F.col("t"))).first()[0] == plain
