from __future__ import annotations

import random

import pytest

WORDS = {
    "en": "the of and river stone garden light window morning letter bread winter harbour table green quiet old young walk sing carry bring under over between house".split(),
    "de": "der und die fluss stein garten licht fenster morgen brief brot winter hafen tisch grün still alt jung gehen singen tragen bringen unter über zwischen haus".split(),
    "fr": "le et la rivière pierre jardin lumière fenêtre matin lettre pain hiver port table vert calme vieux jeune marcher chanter porter amener sous sur entre maison".split(),
}


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    """Invented sentences; words get endings, so that texts differ."""
    out = []
    for i in range(n):
        w = rng.choice(WORDS[lang]) + (rng.choice(["", "", "s", "en", "er", "ly"]) if rng.random() < 0.6 else "")
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture
def rng():
    return random.Random(7)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows of documents from texts, or from (doc_id, text, lang, source)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(*r, *("en", "src")[len(r) - 2 :]) for r in rows]
        return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)

    return make


@pytest.fixture
def odd(documents):
    """Rows that every operator must bear: nulls, blanks, marks alone, repeated and very long ones, with clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    df = documents([(1, None, None, None), (None, "a short text", "en", "s"), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, "!!! ...", None, "s"), (5, "the same row here", "en", "s"), (5, "the same row here", "en", "s"), (6, long, "en", "s"), (7, "日本語 ünïcödé \U0001f600", "fr", "t")])
    from pyspark.sql import functions as F

    for name in ("n", "tokens", "label", "__id", "a", "score", "group_id", "y", "word", "__h", "__kept", "h", "i", "key", "kept", "thash", "rid", "lang_n", "f_lang", "block"):
        df = df.withColumn(name, F.lit("x"))
    return df
