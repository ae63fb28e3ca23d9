"""Corpus statistics. All are partial aggregates over columns of the documents, never driver state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import segment as S
from ..functions.profiles import Profile


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded quotient, 0 over 0."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), digits)


def parts(text: str, profile: Profile) -> Column:
    """The sentences of a text without e-mail addresses."""
    return S.sentences(C.strip(F.regexp_replace(C.emails(F.col(text)), C.BLANKS, " ")), profile.abbreviations)


def _counted(docs: DataFrame, text: str, profile: Profile, *keys) -> DataFrame:
    total = lambda f: F.aggregate("p", F.lit(0).cast("long"), lambda n, s: n + f(s))
    return docs.select(*keys, F.col(text).alias("t"), parts(text, profile).alias("p")).select(*keys, F.length("t").cast("long").alias("chars_before"), F.size("p").cast("long").alias("sentences"), total(lambda s: F.size(S.words(s))).alias("words"), total(lambda s: F.length(s)).alias("chars_after"))


def by_document(docs: DataFrame, key: str, text: str, profile: Profile = Profile()) -> DataFrame:
    """Sentences, words and characters of each row."""
    return _counted(docs, text, profile, key).select(key, "sentences", "words", "chars_before", "chars_after")


def by_language(docs: DataFrame, text: str, lang: str, profile: Profile = Profile()) -> DataFrame:
    return _counted(docs, text, profile, lang).groupBy(lang).agg(F.sum("sentences").alias("sentences"), F.sum("chars_after").alias("chars"), F.sum("words").alias("words"))


def manifest(docs: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Documents and sentences of each source and language; the id lists themselves are left to ``file_lists``."""
    n = docs.select("source", "lang", "doc_id", F.size(parts("text", profile)).cast("long").alias("n"))
    return n.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n").alias("sentences"), ratio(F.sum("n"), F.count("*")).alias("per_document"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def file_lists(results: DataFrame, lang: str = "lang", path: str = "path") -> DataFrame:
    """Each language's output paths in order, and their number."""
    return results.groupBy(lang).agg(F.array_sort(F.collect_list(path)).alias("files"), F.count(path).alias("n"))


def run_report(results: DataFrame) -> DataFrame:
    """One row of counters and ratios over processed files (``success``, ``stage``, ``chars_before``, ``chars_after``, ``sentences``, ``words``)."""
    n, good = F.count("*"), F.sum(F.col("success").cast("long"))
    return results.agg(n.alias("files"), good.alias("done"), (n - good).alias("failed"), F.sum("sentences").alias("sentences"), F.sum("words").alias("words"), ratio(good * 100, n).alias("success_pct"), ratio((F.sum("chars_before") - F.sum("chars_after")) * 100, F.sum("chars_before")).alias("reduction_pct"), ratio(F.sum("sentences"), good).alias("per_file"), ratio(F.sum("words"), F.sum("sentences")).alias("words_per_sentence"))


def errors_by_stage(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success")).groupBy("stage").agg(F.count("*").alias("n"))


def coverage(tokens: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """Counts over tokens (``type``, ``oov``, ``analysed``); ``oov_rate`` over words alone, ``oov_all`` over every token. ``weight``: a row stands for so many tokens."""
    one = F.col(weight) if weight else F.lit(1)
    n = lambda c: F.sum(F.when(c, one).otherwise(0))
    every = F.coalesce(F.sum(one), F.lit(0)) if weight else F.count("*")
    word = ~F.col("type").isin("punct", "special")
    oov = F.col("oov")
    return tokens.groupBy(*keys).agg(every.alias("tokens"), n(word).alias("words"), n(word & oov).alias("oov"), n(F.col("analysed")).alias("analysed"), n(F.col("type") == "punct").alias("punct"), n(F.col("type") == "special").alias("special"), ratio(n(word & oov), n(word), 4).alias("oov_rate"), ratio(n(oov | (F.col("type") == "punct")), every, 4).alias("oov_all"), ratio(n(F.col("analysed")), every, 4).alias("tagging_rate"))


def confidence(levels: Column) -> Column:
    """Mean of HIGH 3, MEDIUM 2, LOW 1 in an array, as a level again."""
    value = lambda x: F.when(x == "HIGH", 3.0).when(x == "MEDIUM", 2.0).when(x == "LOW", 1.0)
    known = F.filter(F.transform(levels, value), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) == 0, "NONE").when(mean >= 2.5, "HIGH").when(mean >= 1.5, "MEDIUM").otherwise("LOW")


def mode_first(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group, of equal ones the one that comes first by ``order``."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("o"))).alias("mode"), F.count("*").alias("distinct"))
