"""Queries of sentence and token operators and of corpus statistics."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import segment as S
from ..operators import stats as T
from . import clean as K
from .registry import query, quoted, table

Q = quoted
BEFORE, AFTER = ("re", "th", "un", "on"), ("nd", "tion", "ing", "st", "s")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[ \\t\\r\\n]+'), lambda w: w <> '')"


def pieces(s: str) -> str:
    cases = []
    for m in S.MARKS:
        parts = f"string_split({s}, {Q(m)})"
        marked = f"list_transform({parts}, lambda p, i: {K.strip(f'CASE WHEN i < len({parts}) THEN p || {Q(m)} ELSE p END')})"
        cases.append(f"WHEN contains({s}, {Q(m)}) THEN list_filter({marked}, lambda p: p <> '')")
    return f"CASE {' '.join(cases)} ELSE [{s}] END"


def sentences(x: str, p=K.ALL) -> str:
    cut = f"string_split(regexp_replace({K.protect(x, p)}, '([.!?:;])', '\\1' || chr(1), 'g'), chr(1))"
    whole = f"list_filter(list_transform({cut}, lambda s: {K.strip(K.restore('s'))}), lambda s: length(s) >= {S.LEAST})"
    return f"flatten(list_transform({whole}, lambda s: CASE WHEN length(s) > {S.MOST} THEN {pieces('s')} ELSE [s] END))"


def app_sentences(x: str) -> str:
    clean = lambda parts: f"list_filter(list_transform({parts}, lambda s: {K.strip('s')}), lambda s: s <> '')"
    blocks = clean(f"string_split({K.sub(x, chr(10) + '[ \t]*' + chr(10), chr(1))}, chr(1))")
    marks = clean(f"string_split(regexp_replace({x}, '([.!?。])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1))")
    return f"CASE WHEN len({blocks}) > 1 THEN {blocks} ELSE {marks} END"


def exploded(parts: str, on: str = "documents", key: str = "doc_id", name: str = "sentence") -> str:
    return f"SELECT {key}, unnest(range(1, len(p) + 1))::INT AS n, unnest(p) AS {name} FROM (SELECT {key}, {parts} AS p FROM {on})"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(exploded(sentences("text")))
def sent_split_fallback(spark, sf_dir):
    return S.exploded(documents(spark, sf_dir), S.sentences(F.col("text"), K.ALL.abbreviations))


@query(exploded(app_sentences("text")))
def sent_split_app(spark, sf_dir):
    return S.exploded(documents(spark, sf_dir), S.app_sentences(F.col("text")))


@query(exploded(pieces("text")))
def sent_long_split(spark, sf_dir):
    """Whole texts cut as overlong sentences are."""
    return S.exploded(documents(spark, sf_dir), S.pieces(F.col("text")))


@query(f"SELECT doc_id, len(w)::BIGINT AS tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {words('text')} AS w FROM documents)")
def tokenize_ws(spark, sf_dir):
    w = S.words(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


_PUNCT = f"flatten(list_transform({words('text')}, lambda w: CASE WHEN regexp_matches(w, {Q(S.PROTECTED)}) THEN [w] ELSE regexp_extract_all(w, {Q(f'[{S.PUNCT}]|[^{S.PUNCT}]+')}) END))"


@query(f"SELECT doc_id, len(w)::BIGINT AS tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_PUNCT} AS w FROM documents)")
def tokenize_punct(spark, sf_dir):
    w = S.punct_tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("SELECT conv_id, turn, i AS n, start, stop, form FROM (SELECT conv_id, turn, unnest(range(1, len(f) + 1))::INT AS i, unnest(f) AS form, unnest(list_transform(range(1, len(g) + 1), lambda k: (list_sum(list_transform(g[1:k], lambda x: length(x))) - length(f[k]))::INT)) AS start, unnest(list_transform(range(1, len(g) + 1), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x)))::INT)) AS stop FROM (SELECT conv_id, turn, regexp_extract_all(text, '[ \\t\\r\\n]*[^ \\t\\r\\n]+') AS g, list_transform(regexp_extract_all(text, '[ \\t\\r\\n]*[^ \\t\\r\\n]+'), lambda x: regexp_replace(x, '^[ \\t\\r\\n]+', '')) AS f FROM conversations))")
def tokenize_offsets(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.posexplode(S.offsets(F.col("text"))).alias("n", "t")).select("conv_id", "turn", (F.col("n") + 1).alias("n"), "t.start", "t.stop", "t.form")


def tokens(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "lang", F.explode(S.punct_tokens(F.col("text"))).alias("form"))


_TOKENS = f"(SELECT doc_id, lang, unnest({_PUNCT}) AS form FROM documents)"
_TYPE = f"CASE WHEN regexp_matches(form, {Q(f'^[{S.PUNCT}]+$')}) THEN 'punct' WHEN regexp_matches(form, {Q(S.NUMBER)}) OR regexp_matches(form, {Q(S.ROMAN)}) THEN 'number' ELSE 'word' END"


@query(f"SELECT lang, {_TYPE} AS type, count(*) AS n FROM {_TOKENS} GROUP BY ALL")
def token_types(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("lang", S.token_type(F.col("form")).alias("type")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, sum(CASE WHEN len(list_filter(range(2, length(form) // 2 + 1), lambda k: substr(form, 1, k) = substr(form, k + 1, k))) > 0 THEN 1 ELSE 0 END)::BIGINT AS doubled, sum(CASE WHEN regexp_matches(form, {Q(S.STRICT_ROMAN)}) THEN 1 ELSE 0 END)::BIGINT AS roman, sum(CASE WHEN length(form) >= 4 AND regexp_matches(form, '^\\p{{Latin}}+$') AND NOT regexp_matches(lower(form), '[áéíóúàèìòùâêîôû]') THEN 1 ELSE 0 END)::BIGINT AS switched FROM {_TOKENS} GROUP BY lang")
def token_flags(spark, sf_dir):
    """Doubled beginnings, Roman numbers in capitals, likely words of another language."""
    w, n = F.col("form"), lambda c: F.sum(F.when(c, 1).otherwise(0))
    return tokens(spark, sf_dir).groupBy("lang").agg(n(S.doubled(w)).alias("doubled"), n(w.rlike(S.STRICT_ROMAN)).alias("roman"), n(S.code_switch(w)).alias("switched"))


def _clitics() -> str:
    longest = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
    pro = f"regexp_extract(form, {Q(rf'^({longest(BEFORE)})(.+)$')}, 1)"
    post = f"regexp_extract(rest, {Q(rf'^(.+?)({longest(AFTER)})$')}, 2)"
    return f"SELECT proclitic, enclitic, count(*) AS n, sum(length(rest) - length(enclitic))::BIGINT AS host_chars FROM (SELECT *, {post} AS enclitic FROM (SELECT {pro} AS proclitic, substr(form, length({pro}) + 1) AS rest FROM (SELECT lower(form) AS form FROM {_TOKENS} WHERE regexp_matches(form, '^[\\p{{L}}]+$')))) GROUP BY ALL"


@query(_clitics())
def clitic_split(spark, sf_dir):
    t = tokens(spark, sf_dir).filter(F.col("form").rlike(r"^[\p{L}]+$")).select(S.clitics(F.lower("form"), BEFORE, AFTER).alias("c")).select("c.*")
    return t.groupBy("proclitic", "enclitic").agg(F.count("*").alias("n"), F.sum(F.length("host")).alias("host_chars"))


_SPECIAL = {"email": C.EMAIL, "amount": r"[0-9]+[.,][0-9]+", "number": r"[0-9]+"}


@query(f"SELECT doc_id, len(s)::BIGINT AS spans, md5(array_to_string(s, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, {Q('|'.join(f'({p})' for p in _SPECIAL.values()))}) AS s FROM documents)")
def special_spans(spark, sf_dir):
    """E-mails, amounts and numbers without overlap."""
    s = documents(spark, sf_dir).select("doc_id", "text", S.special_spans(_SPECIAL)("text").alias("s"))
    found = F.transform("s", lambda x: F.substring(F.col("text"), x["start"] + 1, x["stop"] - x["start"]))
    return s.select("doc_id", F.size("s").cast("long").alias("spans"), F.md5(F.array_join(found, " ")).alias("digest"))


@query(f"SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, {words('text')} AS w FROM documents)) WHERE regexp_matches(w, {Q('^(' + '|'.join(f'({p})' for p in _SPECIAL.values()) + ')$')}) GROUP BY doc_id")
def special_tokens(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", S.special_words(_SPECIAL)("text").alias("t")).filter("size(t) > 0")
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.transform("t", lambda x: x["form"]), " ")).alias("digest"))


_CLEAN = K.strip(K.sub(K.emails("text"), r"[ \t]+", " "))
_PARTS = sentences(_CLEAN)


@query(f"SELECT lang, sum(len(p))::BIGINT AS sentences, sum(list_sum(list_transform(p, lambda s: length(s))))::BIGINT AS chars, sum(list_sum(list_transform(p, lambda s: len({words('s')}))))::BIGINT AS words FROM (SELECT lang, {_PARTS} AS p FROM documents) GROUP BY lang")
def lang_stats(spark, sf_dir):
    """Clean, split into sentences, count: nothing but three sums for each language goes through the exchange."""
    return T.by_language(documents(spark, sf_dir), "text", "lang", K.ALL)


@query(f"SELECT doc_id, len(p)::BIGINT AS sentences, coalesce(list_sum(list_transform(p, lambda s: len({words('s')}))), 0)::BIGINT AS words, length(text)::BIGINT AS chars_before, coalesce(list_sum(list_transform(p, lambda s: length(s))), 0)::BIGINT AS chars_after FROM (SELECT doc_id, text, {_PARTS} AS p FROM documents)")
def doc_stats(spark, sf_dir):
    return T.by_document(documents(spark, sf_dir), "doc_id", "text", K.ALL)


@query(f"SELECT source, lang, count(*) AS documents, sum(len(p))::BIGINT AS sentences, round(CASE WHEN sum(len(p)) > 0 THEN sum(len(p)) * 1.0 / count(*) ELSE 0 END, 2)::DOUBLE AS per_document, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, source, lang, {_PARTS} AS p FROM documents) GROUP BY source, lang")
def manifest_by_source(spark, sf_dir):
    return T.manifest(documents(spark, sf_dir), K.ALL)


@query(f"SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY CUBE (lang, source)")
def corpus_cube(spark, sf_dir):
    """Extension: totals over every grouping of language and source."""
    d = documents(spark, sf_dir).filter("lang is not null and source is not null")
    c = d.cube("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return c.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "documents", "chars")


_FIXES = {"tbe": "the", "rn": "m", "th": "þ"}
_FIXED = "nfc_normalize(text)"
for _k in sorted(_FIXES, key=lambda k: (-len(k), k)):
    _FIXED = f"replace({_FIXED}, {Q(_k)}, {Q(_FIXES[_k])})"


@query(f"SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (SELECT doc_id, {_FIXED} AS t FROM documents)")
def token_normalise(spark, sf_dir):
    """What comes before tokens: NFC, literal corrections, noise."""
    t = S.normalised(F.col("text"), _FIXES)
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


@query("SELECT doc_id, len(w)::BIGINT AS tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[\\s,]+'), lambda w: w <> '') AS w FROM documents)")
def tokenize_boundary(spark, sf_dir):
    """Tokens between a grammar's own boundaries."""
    w = S.boundary_tokens(F.col("text"), r"[\s,]+")
    return documents(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT doc_id, concat_ws('-', 'doc', doc_id::VARCHAR, lpad(n::VARCHAR, 6, '0')) AS sent_id, md5(sentence) AS digest FROM ({exploded(app_sentences('text'))})")
def sentence_ids(spark, sf_dir):
    s = S.sentence_ids(S.exploded(documents(spark, sf_dir), S.app_sentences(F.col("text"))), "doc", ["doc_id", "n"])
    return s.select("doc_id", "sent_id", F.md5("sentence").alias("digest"))


@query(f"SELECT doc_id, CASE WHEN len(w) = 0 THEN 'NONE' WHEN m >= 2.5 THEN 'HIGH' WHEN m >= 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT doc_id, w, list_avg(list_transform(w, lambda x: CASE WHEN length(x) > 8 THEN 3 WHEN length(x) > 4 THEN 2 ELSE 1 END)) AS m FROM (SELECT doc_id, {words('text')} AS w FROM documents WHERE text IS NOT NULL))")
def confidence_levels(spark, sf_dir):
    """Mean level of a document's words, long ones being sure."""
    w = F.transform(S.words(F.col("text")), lambda x: F.when(F.length(x) > 8, "HIGH").when(F.length(x) > 4, "MEDIUM").otherwise("LOW"))
    return documents(spark, sf_dir).filter("text is not null").select("doc_id", T.confidence(w).alias("level"))
