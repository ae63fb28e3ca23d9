"""Steps that have to stay within bounds on large tables: no exchange of tokens, bounded Python objects, one pass over a text."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import cleaning as C
from lexloom.functions import segment as S
from lexloom.operators import annotate as A
from lexloom.operators import stats
from lexloom.operators import tagging as T
from lexloom.plans import morph as P
from lexloom.plans.queries import QUERIES
from lexloom.sources import sinks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sentences(spark):
    return P.sentences(spark, DATA).filter("doc_id % 9 = 0").cache()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["jsonl_rows", "tag_tokens", "conllu_lines", "agree_nearest"])
def test_no_exchange(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, DATA))


@pytest.mark.parametrize("name", ["agree_asof", "annotation_totals"])
def test_no_window_or_join(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "Window" not in text and "Join" not in text and text.count("MapInArrow") == 1


def test_counts_and_columns(spark, sentences):
    own = A.Annotator(*P.tables())
    flat = A.tokens(sentences, own).cache()
    assert rows(A.tokens(sentences, own, columns=["pos", "upos", "nc"])) == rows(flat.select("doc_id", "sent", "pos", "upos", "nc"))
    counted = A.counts(sentences, own, ["upos", "nc"], ("doc_id",))
    assert counted.count() < flat.count() / 5
    assert rows(counted.groupBy("doc_id", "upos", "nc").agg(F.sum("n").alias("n"))) == rows(flat.groupBy("doc_id", "upos", "nc").agg(F.count("*").alias("n")))
    last = T.last_noun(flat, "doc_id", "sent").filter("upos = 'VERB'").select("doc_id", "sent", "pos", "sm_class", "last_nc", "agrees")
    assert rows(A.last_nouns(sentences, own)) == rows(last)
    parses = P.M.verb_parses(P.M.distinct_forms(flat.filter("type = 'word'")), P.tables()[0])
    assert A.run_totals(sentences, own, "doc_id", "sent").first() == A.totals(flat, ["doc_id", "sent"], parses).first()
    assert A.run_totals(sentences.limit(0), own, "doc_id", "sent").first() == A.totals(flat.limit(0), ["doc_id", "sent"], parses).first()
    seen = flat.select("doc_id", "type", F.col("known").isNull().alias("oov"), (F.col("flag") == "parsed").alias("analysed"))
    assert rows(stats.coverage(seen.groupBy("doc_id", "type", "oov", "analysed").agg(F.count("*").alias("n")), "doc_id", weight="n")) == rows(stats.coverage(seen, "doc_id"))


@pytest.mark.parametrize("slim", [False, True])
def test_json_lines(spark, slim):
    texts = [(1, 'a"b \\u00zz \\ \u0001\u001f x@y Thth', None), (2, "thing lyalya thth\u0085thth. 12 \u007f", "s")]
    s = spark.createDataFrame([(i, 1, "en", x, t) for i, t, x in texts], "doc_id long, sent int, lang string, source string, text string").withColumn("forms", S.punct_tokens(F.col("text")))
    own = A.Annotator(*P.tables(), switched=str.istitle)
    want = sinks.sentence_lines(A.tokens(s.select("doc_id", "sent", "forms"), own), s.drop("forms"), ["doc_id", "sent"], slim=slim)
    assert rows(sinks.annotated_lines(s, own, ["doc_id", "sent"], slim=slim)) == rows(want)


def test_slices(spark):
    sizes = []

    def part(x: pa.Array) -> pa.Array:
        sizes.append(sum(len(t.as_py() or "") for t in x))
        return x

    texts = pa.array(["x" * 300_000, None, ""] * 12)
    assert C.in_slices(part, texts).equals(texts) and max(sizes) <= C.SLICE + 300_000 and C.in_slices(part, texts[:0]).equals(texts[:0])
    f = {"mail": r"[a-z]+@[a-z]+", "n": "[0-9]+", "two": "a b"}
    df = spark.createDataFrame([("ab@cd 12 x3 4\n5 a b 6,",), ("",), (None,)], "t string").select("t", S.special_spans(f)("t").alias("s"), S.offsets("t").alias("o"), S.special_words(f)("t").alias("w"))
    assert df.filter(~S.special_tokens(F.col("s"), F.col("o")).eqNullSafe(F.col("w"))).count() == 0


def test_memo_is_small():
    own = A.Annotator(*P.tables())
    for i in range(3 * A.MEMO):
        own(f"w{i}")
    assert len(own.new) + len(own.old) <= 120_000


PAIRS = {
    "hyphens": (lambda c: F.regexp_replace(F.regexp_replace(c, C.HYPHEN, "$1$2"), C.HYPHEN_SPACE, "$1$2"), C.hyphenation), "count": (lambda c: F.regexp_count(c, F.lit(C.HYPHEN)), C.count_hyphens), "emails": (lambda c: F.regexp_replace(c, C.EMAIL, ""), C.emails),
    "consonants": (lambda c: F.regexp_replace(c, rf"(?i){C.EDGE}(?=[a-z]{{5,}})[^aeiouy \t\r\n]+{C.EDGE_AFTER}", ""), C.consonants), "unwrap": (lambda c: F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " "), C.unwrap), "strip": (lambda c: F.regexp_replace(c, C.STRIP, ""), C.strip),
    "ocr": (lambda c: F.regexp_replace(F.regexp_replace(c, rf"{C.EDGE}tbe{C.EDGE_AFTER}", "the"), rf"{C.EDGE}rn{C.EDGE_AFTER}", "m"), lambda c: C.ocr(c, (("tbe", "the"), ("rn", "m")))),
    "protect": (lambda c: F.regexp_replace(F.regexp_replace(c, rf"(?i){C.EDGE}vol\.", "vol<DOT>"), rf"(?i){C.EDGE}Dr\.", "Dr<DOT>"), lambda c: C.protect(c, ("Dr", "vol"))),
}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_patterns_from_rare_characters(spark, name):
    """The same results as the plain patterns."""
    import random

    random.seed(3)
    atoms = ["a", "é", "_", "-", "- ", "-\n", "\n", "\n\n", " ", "\t", ".", "@", "x@y.co", "a@b.cc_", "strng", "STRNGTH", "tbe", "rn", "9", "Dr.", "dR.", "vol.", "\r\n"]
    texts = spark.createDataFrame([("".join(random.choice(atoms) for _ in range(random.randint(1, 20))),) for _ in range(4000)], "t string")
    old, new = PAIRS[name]
    assert texts.filter(~old(F.col("t")).eqNullSafe(new(F.col("t")))).count() == 0


def test_long_words_take_no_squares(spark):
    """Patterns were tried anew at every letter of a run: 80,000 letters took minutes."""
    import time

    began = time.time()
    x = spark.createDataFrame([("a" * 80_000,)], "t string").select(C.hyphenation(F.col("t")).alias("h"), C.emails(F.col("t")).alias("e")).first()
    assert len(x.h) == len(x.e) == 80_000 and time.time() - began < 20


BLANKS = ["the", "the,", "The", "XII", "Dr.", "3.5", "http://a.b/c,d", "a\u00a0b", "é", "\x0b", "\x0c", "|", "日本", " ", "  ", "\t", "\n", "\r\n"]


def chunk_texts(n: int) -> list[str | None]:
    import random

    random.seed(5)
    return [None, "", " ", "end", *("".join(random.choice(BLANKS) for _ in range(random.randint(0, 30))) for _ in range(n))]


def test_chunks_are_counted_within_tasks(spark, monkeypatch):
    """every token went through the distinct one by one; now a task's equal chunks are one row."""
    docs = spark.createDataFrame([(i % 3 or None, "xy"[i % 2], t) for i, t in enumerate(chunk_texts(500))], "a int, b string, text string")
    for keys in ((), ("b",), ("a", "b")):
        plain = docs.select(*keys, F.explode(S.words(F.col("text"))).alias("chunk")).groupBy(*keys, "chunk").agg(F.count("*").alias("n"))
        got = S.chunk_counts(docs, "text", *keys)
        assert rows(got.groupBy(*keys, "chunk").agg(F.sum("n").alias("n"))) == rows(plain)
    batches = [pa.record_batch([pa.array(t.split("/"))], names=["text"]).slice(k) for t, k in (("a b a/b", 0), ("x/b c/a", 1))]
    whole = lambda: [tuple(r.values()) for b in S._counted_chunks([*batches, batches[0].slice(0, 0)], ["chunk", "n"]) for r in b.to_pylist()]
    assert sorted(whole()) == [("a", 3), ("b", 3), ("c", 1)]
    monkeypatch.setattr(S, "HELD", 0)
    assert sorted(whole()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]


def test_words_of_chunks_are_those_of_texts(spark, tmp_path):
    spark.createDataFrame([("en", t) for t in chunk_texts(300)], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for at in (DATA, str(tmp_path)):
        w = F.filter(S.punct_tokens(F.col("text")), lambda w: S.token_type(w, strict=True) == "word")
        plain = spark.read.parquet(f"{at}/documents.parquet").select("lang", F.explode(F.transform(w, F.lower)).alias("form"))
        got = P.tokens(spark, at, "lang")
        assert rows(got.groupBy("lang", "form").agg(F.sum("n").alias("n"))) == rows(plain.groupBy("lang", "form").agg(F.count("*").alias("n")))
        assert rows(P.forms(spark, at)) == rows(plain.select("form").distinct()) and (at != DATA or got.count() < plain.count() / 2)


def test_only_sums_are_exchanged(spark):
    """each language's forms went through an exchange before they were looked up."""
    import re

    assert re.findall(r"hashpartitioning\((lang[^)]*|[^)]*form[^)]*)\)", plan(QUERIES["oov_rate"](spark, DATA))) and not re.search(r"hashpartitioning\([^)]*form", plan(QUERIES["oov_rate"](spark, DATA)))


def test_slot_search_matches_no_equal_strings(monkeypatch):
    """every hypothesis was matched letter by letter with the word that it spells."""
    from difflib import SequenceMatcher

    p, words = P.M.SlotParser(P.G.LEXEME), ["theaate", "unthhatie", "anouoning", "e", "na", "re" * 150 + "q" + "a" * 20]
    assert all(SequenceMatcher(None, w, w).ratio() == 1 for w in words)
    want = [p.analyse(w) for w in words]
    root = {"ROOT": ("xyz", "ROOT")}
    assert p.score("xyzzy", root, ["ROOT"]) == round(0.6 * 0.40 + 0.20 / 3 + 0.10 + 0.075 + SequenceMatcher(None, "xyzzy", "xyz").ratio() * 0.20, 4)
    monkeypatch.setattr(P.M, "SequenceMatcher", None)
    assert [p.analyse(w) for w in words] == want and all(x[0][1].replace("-", "") == w for x, w in zip(want, words))


def test_spans_need_no_exchange(spark):
    """all hypotheses were made to keep the first one, and a window over all morphemes summed what is in one row."""
    assert "Window" not in plan(QUERIES["verb_morpheme_spans"](spark, DATA))
    v = P.tables()[0]
    found = P.forms(spark, DATA).limit(3000).cache()
    for w in [r.form for r in found.collect()] + ["", "a"]:
        assert v.parse(w, 1) == v.parse(w)[:1]
    one = P.M.verb_parses(found, v, top=1)
    assert rows(one) == rows(P.M.verb_parses(found, v).filter("hyp = 1"))
    ends = {}
    for r in sorted(P.M.spans(one).collect(), key=lambda r: (r.form, r.start)):
        assert r.form[r.start : r.stop] == r.morph and r.start == ends.get(r.form, 0)
        ends[r.form] = r.stop
    assert all(len(w) == n for w, n in ends.items()) and len(ends) == one.count()
