"""Queries of the cleaning steps, and each step once more as a DuckDB expression.

DuckDB's patterns know no lookaround and no back reference; its expressions get by with fences around
words and with a second pass where two matches share a boundary.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.profiles import OWN, Profile, profiles, universal
from .registry import query, quoted, table

Q, W, FENCE = quoted, r"[\p{L}\p{N}_]", "chr(1)"
ALL = universal()


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {Q(pattern)}, {Q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, C.STRIP, "")


def punctuation(x: str, p: Profile = ALL) -> str:
    return reduce(lambda s, kv: f"replace({s}, {Q(kv[0])}, {Q(kv[1])})", p.punctuation, x)


def hyphenation(x: str) -> str:
    return sub(sub(x, C.HYPHEN, r"\1\2"), rf"({W}+)-[ \t\r\n]+({W}+)([ \t\r\n]|$)", r"\1\2\3")


def unwrap(x: str) -> str:
    two = f"replace({x}, chr(10) || chr(10), {FENCE} || {FENCE})"
    return f"replace(replace(replace({two}, {FENCE} || chr(10), {FENCE} || {FENCE}), chr(10), ' '), {FENCE}, chr(10))"


def protect(x: str, p: Profile = ALL) -> str:
    for a in sorted(p.abbreviations, key=len, reverse=True):
        for _ in range(2):
            x = sub(x, rf"(^|[^\p{{L}}\p{{N}}_])(?i:{re.escape(a)})\.", rf"\1{a}{C.DOT}")
    return x


def restore(x: str) -> str:
    return f"replace({x}, {Q(C.DOT)}, '.')"


def urls(x: str) -> str:
    return sub(sub(x, C.URL, ""), C.WWW, "")


def emails(x: str) -> str:
    return sub(x, C.EMAIL, "")


def verses(x: str) -> str:
    return strip(sub(sub(sub(x, C.VERSE, ""), r"[ \t\r\n]*[;,]+[ \t\r\n]*", " "), r"[ \t\r\n]+", " "))


def without_lines(x: str, pattern: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT regexp_matches(l, {Q(pattern)})), chr(10))"


def headings(x: str, p: Profile = ALL) -> str:
    return without_lines(x, C.heading(p.chapter_words))


def strip_lines(x: str, p: Profile = ALL) -> str:
    return without_lines(x, r"^[ \t\r]*(" + "|".join(f"({s})" for s in p.strip_patterns) + ")")


def consonants(x: str) -> str:
    for _ in range(2):
        x = sub(x, r"(?i)(^|[^\p{L}\p{N}_])[bcdfghjklmnpqrstvwxz]{5}[^aeiouy \t\r\n]*($|[^\p{L}\p{N}_])", r"\1\2")
    return x


def singles(x: str, p: Profile = ALL) -> str:
    valid = ", ".join(Q(v) for v in p.single_chars)
    return f"array_to_string(list_filter(string_split_regex({x}, '[ \\t\\r\\n]+'), lambda w: w <> '' AND (length(w) <> 1 OR lower(w) IN ({valid}))), ' ')"


def ocr(x: str, p: Profile = ALL) -> str:
    x = f"{FENCE} || regexp_replace({x}, '([^\\p{{L}}\\p{{N}}_])', {FENCE} || '\\1' || {FENCE}, 'g') || {FENCE}"
    for k, v in p.ocr:
        x = f"replace({x}, {FENCE} || {Q(k)} || {FENCE}, {FENCE} || {Q(v)} || {FENCE})"
    return f"replace({x}, {FENCE}, '')"


def whitespace(x: str) -> str:
    return strip(sub(sub(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {Q(pattern)}))"


def chain(x: str, p: Profile = ALL) -> str:
    x = f"nfc_normalize({x})"
    for step in (lambda s: punctuation(s, p), hyphenation, unwrap, lambda s: protect(s, p), urls, emails, lambda s: headings(s, p), lambda s: strip_lines(s, p), lambda s: ocr(s, p), consonants, lambda s: singles(s, p), restore, whitespace):
        x = step(x)
    return x


STEPS = {
    "clean_unicode": (C.unicode, lambda x: f"nfc_normalize({x})", None),
    "clean_punctuation": (lambda c: C.punctuation(c, ALL.punctuation), punctuation, None),
    "clean_hyphenation": (C.hyphenation, hyphenation, (C.count_hyphens, lambda x: count(x, C.HYPHEN))),
    "clean_unwrap_lines": (C.unwrap, unwrap, None),
    "clean_abbreviations": (lambda c: C.protect(c, ALL.abbreviations), protect, None),
    "clean_urls": (C.urls, urls, (C.count_urls, lambda x: f"{count(x, C.URL)} + {count(sub(x, C.URL, ''), C.WWW)}")),
    "clean_emails": (C.emails, emails, (C.count_emails, lambda x: count(x, C.EMAIL))),
    "clean_verse_refs": (C.verses, verses, (lambda c: F.regexp_count(c, F.lit(C.VERSE)), lambda x: count(x, C.VERSE))),
    "clean_headings": (lambda c: C.headings(c, ALL.chapter_words), headings, None),
    "clean_strip_lines": (lambda c: C.strip_lines(c, ALL.strip_patterns), strip_lines, None),
    "clean_ocr": (lambda c: C.ocr(c, ALL.ocr), ocr, None),
    "clean_consonants": (C.consonants, consonants, None),
    "clean_single_chars": (lambda c: C.singles(c, ALL.single_chars), singles, None),
    "clean_whitespace": (C.whitespace, whitespace, None),
    "clean_full_chain": (lambda c: C.chain(c, ALL), chain, None),
}
#: Steps that find little in the documents are taken of the pages' source as well.
ON_PAGES = ("clean_urls", "clean_hyphenation", "clean_punctuation", "clean_emails")


def _add(name: str, on: str, key: str, text: str, steps: tuple) -> None:
    column, sql, counted = steps

    def run(spark, sf_dir):
        more = [counted[0](F.col(text)).cast("long").alias("n")] if counted else []
        out = column(F.col(text))
        return table(spark, sf_dir, on).select(key, F.md5(out).alias("digest"), F.length(out).cast("long").alias("chars"), *more)

    more = f", ({counted[1](text)})::BIGINT AS n" if counted else ""
    query(f"SELECT {key}, md5(t) AS digest, length(t)::BIGINT AS chars{', n' if counted else ''} FROM (SELECT {key}, {sql(text)} AS t{more} FROM {on})", name)(run)


for _name, _steps in STEPS.items():
    _add(_name, "documents", "doc_id", "text", _steps)
for _name in ON_PAGES:
    _add(f"{_name}_pages", "pages", "page_id", "html", STEPS[_name])


def _per_language() -> str:
    cases = " ".join(f"WHEN {Q(iso)} THEN {strip(headings(punctuation('text', p), p))}" for iso, p in profiles().items())
    return f"SELECT doc_id, md5(CASE lang {cases} ELSE text END) AS digest FROM documents"


@query(_per_language())
def clean_by_profile(spark, sf_dir):
    """Each document by its own language's profile."""
    out = F.col("text")
    for iso, p in profiles().items():
        out = F.when(F.col("lang") == iso, C.strip(C.headings(C.punctuation(F.col("text"), p.punctuation), p.chapter_words))).otherwise(out)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"))


@query(
    f"SELECT lang, sum({count('text', C.EMAIL)})::BIGINT AS emails, sum({count('text', C.URL)} + {count(sub('text', C.URL, ''), C.WWW)})::BIGINT AS urls, sum({count('text', C.HYPHEN)})::BIGINT AS hyphens FROM documents GROUP BY lang"
)
def clean_counters(spark, sf_dir):
    """What the counting steps would remove, by language."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(C.count_emails(t)).alias("emails"), F.sum(C.count_urls(t)).alias("urls"), F.sum(C.count_hyphens(t)).alias("hyphens"))


def _detect() -> str:
    values = ", ".join(f"({i}, {Q(iso)}, {Q(k)})" for i, (iso, x) in enumerate(OWN.items()) for k in x["keywords"])
    return f"SELECT page_id, coalesce(min_by(iso, o), 'und') AS lang FROM pages LEFT JOIN (VALUES {values}) k(o, iso, word) ON contains(lower(url), word) GROUP BY page_id"


@query(_detect())
def lang_detect_path(spark, sf_dir):
    """First profile that has a keyword in the path, else ``und``; one expression, no join."""
    url = F.lower("url")
    found = [F.when(F.greatest(*(F.contains(url, F.lit(k)) for k in x["keywords"])), iso) for iso, x in OWN.items()]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*found, F.lit("und")).alias("lang"))


