"""Cleaning steps as columns: each takes a string column and gives the cleaned one.

All but Unicode normalisation are built-in expressions, so a chain of them stays in one generated stage.
``count_*`` give what a step would remove, and have to be taken of the step's own input. Null stays null.
"""

from __future__ import annotations

import re
from functools import reduce
from unicodedata import is_normalized as normalized
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .profiles import Profile, Toggles, valid_patterns

WORD = r"[\p{L}\p{N}_]"
EDGE, EDGE_AFTER = rf"(?<!{WORD})", rf"(?!{WORD})"
URL, WWW = r"https?://[^ \t\r\n]+", r"www\.[^ \t\r\n]+"
EMAIL = r"[%+._a-zA-Z0-9-]+@[.a-zA-Z0-9-]+[.][a-zA-Z]{2,}"
HYPHEN = rf"({WORD}+)-[ \t\r]*\n[ \t\r\n]*({WORD}+)"
HYPHEN_SPACE = rf"({WORD}+)-[ \t\r\n]+({WORD}+)(?=[ \t\r\n]|$)"
#: The same matches, sought from a character that is rare: a pattern that begins with a look behind or a run of letters is tried at every letter.
#: ``\G``: a word that ended a match can't begin the next one.
HYPHEN_AT = rf"-(?<={WORD}-)(?<!\G-)[ \t\r]*\n[ \t\r\n]*({WORD}+)"
HYPHEN_SPACE_AT = rf"-(?<={WORD}-)(?<!\G-)[ \t\r\n]+({WORD}+)(?=[ \t\r\n]|$)"
EMAIL_AT = r"(?:(?<![%+._a-zA-Z0-9-])|\G)[%+._a-zA-Z0-9-]++@[.a-zA-Z0-9-]+[.][a-zA-Z]{2,}"
VERSE = r"([0-9]{1,2} ?)?[#a-zA-Z]{1,20}[.]? ?[0-9]{1,3}:[0-9]{1,3}([,-][0-9]{1,3})*"
DOT = "<DOT>"
#: Blanks that aren't a single space already.
BLANKS = r"[ \t]{2,}|\t"
STRIP = r"^[ \t\r\n]+|[ \t\r\n]+$"


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` worked out once: below a function with a lambda Spark works out each mention of it anew."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """Without ``STRIP``; it needs no pattern."""
    return F.btrim(c, F.lit(" \t\r\n"))


#: Bytes of text that become Python objects at once.
SLICE = 1 << 20


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """First and last place of slices of ``texts`` that hold ``most`` bytes and one text at most."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())))
    cuts = [0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(texts)]
    return [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]


def in_slices(part, texts: pa.Array) -> pa.Array:
    """``part`` of ``texts`` slice by slice, so that Python never holds more than ``SLICE`` bytes of them and one text as objects, however large the batch."""
    found = [part(texts.slice(a, z - a)) for a, z in slices(texts, SLICE)]
    return pa.concat_arrays(found) if found else part(texts)


def _normal(form: str):
    """Arrow's own normalisation doesn't compose, so Python's is used; text that is normal already is only looked at."""

    def part(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        if all(t is None or normalized(form, t) for t in own):
            return texts.cast(pa.string())
        return pa.array([t if t is None else normalize(form, t) for t in own], pa.string())

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(part, texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, StringType())


_nfc, _nfkd = _normal("NFC"), _normal("NFKD")


def unicode(c: Column, compatibility: bool = False) -> Column:
    """NFC, or NFKD."""
    return (_nfkd if compatibility else _nfc)(c)


def punctuation(c: Column, pairs=Profile().punctuation) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


def hyphenation(c: Column) -> Column:
    """Words cut at a line's end are joined; so are those with a blank after the hyphen, if one follows the word."""
    return F.regexp_replace(F.regexp_replace(c, HYPHEN_AT, "$1"), HYPHEN_SPACE_AT, "$1")


def count_hyphens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HYPHEN_AT))


def unwrap(c: Column) -> Column:
    """A lone line end is a space."""
    return F.regexp_replace(c, r"\n(?<!\n\n)(?!\n)", " ")


def protect(c: Column, abbreviations=Profile().abbreviations) -> Column:
    """The full stop of an abbreviation is set aside; the spelling becomes the listed one."""
    longest = sorted(abbreviations, key=len, reverse=True)
    if not longest:
        return c
    each = lambda x: reduce(lambda x, a: F.regexp_replace(x, rf"(?i){EDGE}{re.escape(a)}\.", a + DOT), longest, x)
    if any("." in a for a in longest):
        any_of = f"{EDGE}({'|'.join(map(re.escape, longest))})\\."
        found, by = any_of, f"$1{DOT}"
    else:  # each full stop stands alone, so that it is looked for and what is before it looked at
        any_of = f"\\.(?<={EDGE}(?:{'|'.join(map(re.escape, longest))})\\.)"
        found, by = any_of, DOT
    # one pass where all are spelled as listed; the rare text with another spelling takes a pass for each
    return once(F.regexp_replace(c, found, by), lambda plain: F.when(plain.rlike(f"(?i){any_of}"), each(plain)).otherwise(plain))


def restore(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit("."))


def urls(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, URL, ""), WWW, "")


def count_urls(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL)) + F.regexp_count(F.regexp_replace(c, URL, ""), F.lit(WWW))


def emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL_AT, "")


def count_emails(c: Column) -> Column:
    return F.regexp_count(c, F.lit(EMAIL_AT))


def verses(c: Column, pattern: str = VERSE) -> Column:
    """References go; then each run of commas and semicolons, and each run of white space, is one space."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, pattern, ""), r"[ \t\r\n]*[;,]+[ \t\r\n]*", " "), r"[ \t\r\n]+", " "))


def heading(words) -> str:
    """Pattern of a heading line."""
    return rf"(?i)^[ \t\r]*({'|'.join(re.escape(w) for w in words) or 'Chapter'})[ \t]+([IVXLCDM]+|[0-9]+)[ \t\r]*$"


def without_lines(c: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda line: ~line.rlike(pattern)), "\n")


def count_lines(c: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda line: line.rlike(pattern)))


def headings(c: Column, words=Profile().chapter_words) -> Column:
    return without_lines(c, heading(words))


def strip_lines(c: Column, patterns=Profile().strip_patterns) -> Column:
    """Lines that match a pattern at their first character other than blanks go; a faulty pattern turns all off."""
    good = valid_patterns(tuple(patterns))
    return without_lines(c, r"^[ \t\r]*(" + "|".join(f"({p})" for p in good) + ")") if good else c


def consonants(c: Column) -> Column:
    """Words of at least five letters a to z, and no vowel up to the next blank, go."""
    return F.regexp_replace(c, rf"(?i)[bcdfghjklmnpqrstvwxz]{{5}}(?<!{WORD}[a-z]{{5}})[^aeiouy \t\r\n]*{EDGE_AFTER}", "")


def singles(c: Column, valid=Profile().single_chars) -> Column:
    """Words of one character go, unless listed; all white space, line ends too, is then one space."""
    allowed = F.array(*(F.lit(v) for v in valid))
    parts = F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: (w != "") & ((F.length(w) != 1) | F.array_contains(allowed, F.lower(w))))
    return F.array_join(parts, " ")


def count_singles(c: Column, valid=Profile().single_chars) -> Column:
    allowed = F.array(*(F.lit(v) for v in valid))
    return F.size(F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: (F.length(w) == 1) & ~F.array_contains(allowed, F.lower(w))))


def ocr(c: Column, pairs=Profile().ocr) -> Column:
    """Whole words, one pair after the other."""
    return reduce(lambda x, kv: F.regexp_replace(x, rf"{re.escape(kv[0])}(?<!{WORD}{re.escape(kv[0])}){EDGE_AFTER}", kv[1].replace("\\", "\\\\").replace("$", "\\$")), pairs, c)


def whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, BLANKS, " "), r"\n{3,}", "\n\n"))


def chain(c: Column, profile: Profile = Profile(), on: Toggles = Toggles()) -> Column:
    """All steps that are switched on, in their fixed order."""
    steps = [
        (on.unicode, unicode), (on.punctuation, lambda x: punctuation(x, profile.punctuation)), (on.hyphenation, hyphenation), (on.unwrap, unwrap), (on.abbreviations, lambda x: protect(x, profile.abbreviations)),
        (on.urls, urls), (on.emails, emails), (on.verses, verses), (on.headings, lambda x: headings(x, profile.chapter_words)), (on.strip, lambda x: strip_lines(x, profile.strip_patterns)),
        (on.ocr, lambda x: ocr(x, profile.ocr)), (on.consonants, consonants), (on.singles, lambda x: singles(x, profile.single_chars)), (on.abbreviations, restore), (on.whitespace, whitespace),
    ]
    return reduce(lambda x, step: step[1](x) if step[0] else x, steps, c)


def counters(c: Column, profile: Profile = Profile()) -> dict[str, Column]:
    """What the steps up to each counting one leave, counted: URLs, e-mails, hyphens, headings."""
    x = punctuation(c, profile.punctuation)
    hyphens = count_hyphens(x)
    x = protect(unwrap(hyphenation(x)), profile.abbreviations)
    n_urls, x = count_urls(x), urls(x)
    n_emails, x = count_emails(x), emails(x)
    return {"hyphens": hyphens, "urls": n_urls, "emails": n_emails, "headings": count_lines(x, heading(profile.chapter_words))}
