"""Cleaning steps case by case, nulls and empty texts among them."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import cleaning as C
from lexloom.functions.profiles import OWN, PRESETS, Found, Profile, Toggles, from_json, merged, profiles, to_json, universal, valid_patterns


def one(spark, step, text):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t")).alias("x")).first()[0]


CASES = [
    (C.punctuation, "“a” – b… ‘c’", "\"a\" - b... 'c'"),
    (C.hyphenation, "exam-\nple and well- known \nend", "example and wellknown \nend"),
    (C.unwrap, "a\nb\n\nc\n\n\nd", "a b\n\nc\n\n\nd"),
    (lambda c: C.protect(c, ("Dr", "etc")), "dr. A, etc. xdr.", "Dr<DOT> A, etc<DOT> xdr."),
    (C.urls, "see https://x.org/a?b and www.y.com now", "see  and  now"),
    (C.emails, "to a.b@c.de, ok", "to , ok"),
    (C.verses, "as Gen 1:1-3 says; so,  it is", "as says so it is"),
    (lambda c: C.headings(c, ("Chapter",)), "Chapter 4\n chapter IV \nChapter one", "Chapter one"),
    (C.strip_lines, "a\n  page 12\n-----\nb", "a\nb"),
    (C.consonants, "this is bcdfg xyz strngth", "this is  xyz "),
    (lambda c: C.singles(c, ("a",)), "a b\nA cc d", "a A cc"),
    (lambda c: C.ocr(c, (("rn", "m"), ("l1", "li"))), "rn born rn, l1", "m born m, li"),
    (C.whitespace, "  a \t b\n\n\n\nc ", "a b\n\nc"),
    (C.unicode, "éa", "éa"),
    (lambda c: C.unicode(c, True), "ﬁ", "fi"),
]


@pytest.mark.parametrize(("step", "text", "want"), CASES)
def test_steps(spark, step, text, want):
    assert one(spark, step, text) == want
    assert one(spark, step, None) is None
    assert one(spark, step, "") == ""


def test_counters_take_each_steps_own_input(spark):
    row = spark.createDataFrame([("x-\ny http://a.b www.c.d e@f.gh\n\nChapter 2\n\nz",)], "t string").select(*(c.alias(k) for k, c in C.counters(F.col("t")).items())).first()
    assert row.asDict() == {"hyphens": 1, "urls": 2, "emails": 1, "headings": 1}


def test_chain_and_switches(spark):
    text = "“Tbe’ rn” a@b.cd\n\n\nx qwrtp Mr. Y"
    assert one(spark, lambda c: C.chain(c, Profile(), PRESETS["pristine"]), text) == text
    out = one(spark, C.chain, text)
    assert "@" not in out and "“" not in out and "Mr. Y" in out
    assert one(spark, C.chain, out) == out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t-.@é", max_size=30), min_size=1, max_size=20))
def test_whitespace_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.whitespace(F.col("t")).alias("a"))
    assert all(r.a == r.b and not re.search(r"  |\n{3}", r.a) for r in df.withColumn("b", C.whitespace(F.col("a"))).collect())


def test_profiles():
    p = profiles()["de"]
    assert "Kapitel" in p.chapter_words and "Chapter" in p.chapter_words
    assert dict(merged(Profile(), {"ocr": {"rn": "x"}}).ocr)["rn"] == "x"
    assert set(OWN["fr"]["abbreviations"]) <= set(universal().abbreviations)
    assert from_json(to_json(p, Toggles(verses=True))) == (p, Toggles(verses=True))
    assert valid_patterns(("a", "(")) == () and valid_patterns(("a",)) == ("a",)
    assert Found({"a": {"b": 0}}).first("x", "a.c", "a.b") == 0
    assert merged(Profile(), {"single_chars": [False]}).single_chars[-1] == "False"
