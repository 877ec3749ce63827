from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from leafmill.operators import terms


def squeeze(t):
    return re.sub(r"[\s﻿]+", "", t).lower()


@pytest.mark.parametrize("piece", [5, 4096])
def test_terms_are_those_of_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(terms, "PIECE", piece)
    r = random.Random(piece)
    word = lambda: "".join(r.choices("abAB é日", k=r.choice([1, 2, 3, 5, 9])))
    texts = [" ".join(word() for _ in range(r.choice([0, 1, 10, 80]))) for _ in range(60)] + [None, "", "𝒳𝒴𝒵 and more", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    asked = [" ".join(word() for _ in range(r.choice([1, 2, 4]))) for _ in range(400)] + [t[5:40] for t in texts if t] + [None, "", "  a  ", "𝒳𝒴𝒵", "a\ta a", "a" * 24, "a" * 25, "     "]
    found = terms.terms_found(spark.createDataFrame([(t, "clash") for t in texts], "text string, gram string"), spark.createDataFrame([(t, "clash") for t in asked * 2], "term string, needle string"))
    strip = lambda t: t.strip(" \t\n\r\x0b\x0c  ﻿")
    hays = [squeeze(t) for t in texts if t]
    wanted = {strip(t) for t in asked if t and len(strip(t)) >= 3 and squeeze(strip(t)) and any(squeeze(strip(t)) in h for h in hays)}
    got = [x["term"] for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_there_is_no_limit_of_terms(spark):
    n = 200_000
    many = spark.range(n).select(F.concat(F.lit("common beginning "), F.col("id").cast("string"), F.lit(" end")).alias("term"))
    texts = spark.range(300).select(F.concat(F.lit("x common beginning "), (F.col("id") * 1001).cast("string"), F.lit(" end; common beginning of no term")).alias("text"))
    assert terms.terms_found(texts, many).count() == len([k for k in range(300) if k * 1001 < n])


def test_only_grams_that_may_be_wanted_are_sent(spark):
    """Of a text's thousands of grams those of no term stay in its row."""
    text = " ".join(f"word{i * 7919}" for i in range(3000)).replace(" ", "")
    texts = spark.createDataFrame([("k", text)], "key string, hay string")
    got = terms._text_grams(texts, [3, 6], spark.createDataFrame([("word79",), ("d79",), ("absent",)], "gram string"))
    found = {r["gram"] for r in got.collect()}
    assert {"word79", "d79"} <= found and len(found) < 100 and all(g in text for g in found)
