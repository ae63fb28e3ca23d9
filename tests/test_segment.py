from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.functions import segment as S
from lexloom.operators import stats


def one(spark, step, text):
    return spark.createDataFrame([(text,)], "t string").select(step(F.col("t")).alias("x")).first()[0]


def test_sentences(spark):
    assert one(spark, S.sentences, "Mr. A came. Did he? 3.5 yes: ok") == ["Mr. A came.", "Did he?", "5 yes:"]
    assert one(spark, S.sentences, "") == [] and one(spark, S.sentences, None) is None
    long = "x" * 700 + ", " + "y" * 700
    assert one(spark, S.sentences, long) == ["x" * 700 + ",", "y" * 700]


def test_app_sentences(spark):
    assert one(spark, S.app_sentences, "a b\n\nc. d") == ["a b", "c. d"]
    assert one(spark, S.app_sentences, "a b. C d! e") == ["a b.", "C d!", "e"]


def test_tokens_and_offsets(spark):
    text = "  Hé, the U.N. 3.5 ok-go "
    assert one(spark, S.punct_tokens, text) == ["Hé", ",", "the", "U", ".", "N", ".", "3.5", "ok", "-", "go"]
    for t in one(spark, S.offsets, text):
        assert text[t.start : t.stop] == t.form
    assert one(spark, S.offsets, None) is None and one(spark, S.offsets, " ") == []


@pytest.mark.parametrize(("word", "kind"), [("...", "punct"), ("12.5", "number"), ("mi", "number"), ("mia", "word")])
def test_types(spark, word, kind):
    assert one(spark, S.token_type, word) == kind


def test_flags(spark):
    assert [one(spark, S.doubled, w) for w in ("lyalya", "abab", "balima", "ab")] == [True, True, False, False]
    assert one(spark, lambda c: S.token_type(c, strict=True), "mi") == "word"
    assert [one(spark, S.code_switch, w) for w in ("hello", "tóne", "abc")] == [True, False, False]
    assert one(spark, lambda c: S.clitics(c, ("na", "n"), ("mu", "po")), "nabantumu") == ("na", "bantu", "mu")
    assert one(spark, lambda c: S.clitics(c, ("na",), ("mu",)), "na") == ("", "na", "")


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "A b. C d e.", "en"), (2, None, "en"), (3, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.sentences, r.words) for r in stats.by_document(docs, "doc_id", "text").collect()}
    assert got[1] == (2, 5) and got[3] == (0, 0)
    runs = spark.createDataFrame([(True, None, 10, 5, 2, 6), (False, "read", 0, 0, 0, 0)], "success boolean, stage string, chars_before int, chars_after int, sentences int, words int")
    r = stats.run_report(runs).first()
    assert (r.files, r.failed, r.success_pct, r.reduction_pct, r.words_per_sentence) == (2, 1, 50.0, 50.0, 3.0)
    assert stats.errors_by_stage(runs).collect()[0].stage == "read"
    assert stats.run_report(runs.limit(0)).first().success_pct == 0.0
    levels = spark.createDataFrame([(["HIGH", "LOW"],), ([],), (["LOW"],)], "l array<string>").select(stats.confidence(F.col("l")).alias("c"))
    assert [x.c for x in levels.collect()] == ["MEDIUM", "NONE", "LOW"]
    votes = spark.createDataFrame([("k", "a", 0), ("k", "b", 1), ("k", "b", 2), ("k", "a", 3), ("k", None, 4)], "k string, v string, o int")
    assert stats.mode_first(votes, ["k"], "v", "o").first()["mode"] == "a"
    tok = spark.createDataFrame([("word", True, False), ("word", False, True), ("punct", False, False)], "type string, oov boolean, analysed boolean")
    c = stats.coverage(tok).first()
    assert (c.oov_rate, round(c.oov_all, 4)) == (0.5, 0.6667)
    files = spark.createDataFrame([("en", "b"), ("en", "a")], "lang string, path string")
    assert stats.file_lists(files).first().files == ["a", "b"]


def test_special_spans(spark):
    f = S.special_spans({"word": "[a-z]+", "mail": r"[a-z]+@[a-z]+", "none": "x*"})
    got = one(spark, lambda c: f(c), "ab@cd ef")
    assert [(x.start, x.stop, x.kind) for x in got] == [(0, 5, "mail"), (6, 8, "word")]
    assert one(spark, lambda c: f(c), None) is None and one(spark, lambda c: f(c), "") == []
    both = spark.createDataFrame([("ab@cd, ef",)], "t string").select(f("t").alias("s"), S.offsets("t").alias("o"))
    t = both.select(S.special_tokens(F.col("s"), F.col("o")).alias("x")).first().x
    assert [(x.form, x.kind) for x in t] == [("ef", "word")]


def test_normalised_boundaries_and_ids(spark):
    df = spark.createDataFrame([(1, "e\u0301 tbe\u00adtbeme a,b"), (2, None)], "doc_id int, t string")
    got = df.select(S.normalised(F.col("t"), {"tbe": "the", "tbeme": "theme"}).alias("n"), S.boundary_tokens(F.col("t"), r"[\s,]+").alias("b")).collect()
    assert got[0].n == "é thetheme a,b" and got[0].b[-2:] == ["a", "b"] and got[1].n is None and got[1].b is None
    s = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (1, 3, " "), (2, 1, "c")], "doc_id int, n int, sentence string")
    assert sorted((r.sentence, r.sent_id) for r in S.sentence_ids(s, "p", ["doc_id", "n"]).collect()) == [("a", "p-1-000001"), ("b", "p-1-000002"), ("c", "p-2-000001")]
