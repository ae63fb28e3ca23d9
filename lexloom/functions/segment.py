"""Sentences and tokens as columns (arrays), to be exploded by the caller."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .cleaning import DOT, in_slices, once, protect, slices, strip, unicode
from .profiles import Profile

CUT, LEAST, MOST = "\u0001", 3, 1000
CHUNK = re.compile(r"[^ \t\r\n]+")
#: Where an overlong sentence is cut: the first of these that it holds.
MARKS = (";", ":", ", ", " - ", " – ", " — ")
PUNCT = r"\p{P}\p{S}"
PROTECTED = rf"^(https?://.+|www\..+|[0-9]+([.,][0-9]+)+|\p{{Lu}}\p{{Ll}}+\.|\p{{Lu}}{{2,}}\.?)$"
#: A token: a chunk between blanks that ``PROTECTED`` takes as a whole, else a mark, else what is between marks and blanks.
BLANK = r" \t\r\n"
TOKEN = rf"(?<![^{BLANK}])(?:https?://[^{BLANK}]+|www\.[^{BLANK}]+|[0-9]+(?:[.,][0-9]+)+|\p{{Lu}}\p{{Ll}}+\.|\p{{Lu}}{{2,}}\.?)(?![^{BLANK}])|[{PUNCT}]|[^{PUNCT}{BLANK}]+"
#: Letters of Roman numbers in any case, as the usual annotation has it; ``STRICT_ROMAN`` takes capitals only.
NUMBER, ROMAN, STRICT_ROMAN = r"^[0-9][0-9,.’]*$", r"(?i)^[ivxlcdm]+$", r"^[IVXLCDM]+$"


def sentences(c: Column, abbreviations=Profile().abbreviations, least: int = LEAST, most: int = MOST) -> Column:
    """Sentences end after ``. ! ? : ;``; an abbreviation's full stop ends none; short ones go, long ones are cut."""
    cut = F.split(F.regexp_replace(protect(c, abbreviations), r"([.!?:;])", f"$1{CUT}"), CUT)
    whole = F.transform(cut, lambda s: strip(F.replace(s, F.lit(DOT), F.lit("."))))
    kept = F.filter(whole, lambda s: F.length(s) >= least)
    return F.flatten(F.transform(kept, lambda s: F.when(F.length(s) > most, pieces(s)).otherwise(F.array(s))))


def pieces(s: Column) -> Column:
    """A sentence cut at the first of ``MARKS`` that it holds, the mark kept by all but the last piece."""
    out = F.array(s)
    for m in reversed(MARKS):
        parts = F.split(s, re.escape(m))
        marked = F.transform(parts, lambda p, i: strip(F.when(i < F.size(parts) - 1, F.concat(p, F.lit(m))).otherwise(p)))  # noqa: B023
        out = F.when(F.contains(s, F.lit(m)), F.filter(marked, lambda p: p != "")).otherwise(out)
    return out


def app_sentences(c: Column) -> Column:
    """Blocks between blank lines if there is more than one, else after ``. ! ?`` and white space."""
    clean = lambda parts: F.filter(F.transform(parts, strip), lambda s: s != "")
    blocks = clean(F.split(c, r"\n[ \t]*\n"))
    return once(blocks, lambda b: F.when(F.size(b) > 1, b).otherwise(clean(F.split(c, r"(?<=[.!?。])[ \t\r\n]+"))))


def normalised(c: Column, corrections: dict[str, str] | None = None, noise: str = "\u00ad\u200b\u200c\u200d\ufeff") -> Column:
    """What comes before tokens: NFC, literal corrections, the longest first, and characters of no meaning dropped."""
    out = unicode(c)
    for k in sorted(corrections or {}, key=lambda k: (-len(k), k)):
        out = F.replace(out, F.lit(k), F.lit(corrections[k]))
    return F.translate(out, noise, "") if noise else out


def boundary_tokens(c: Column, boundary: str = r"\s+") -> Column:
    """Tokens between the boundaries of a grammar (``g_tokenization.boundary``); punctuation stays where it is."""
    return F.filter(F.split(c, boundary), lambda w: w != "")


def sentence_ids(sentences: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Sentences that aren't blank with ``sent_id``: the prefix, the keys of ``order`` but for the last, and a number of six digits from 1 by the last one.

    Numbers count within the keys, never over the whole table, so that no task sees more than one document.
    """
    keys, last = order[:-1], order[-1]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(last))
    return sentences.filter(F.trim("sentence") != "").withColumn("sent_id", F.concat_ws("-", F.lit(prefix), *(F.col(k).cast("string") for k in keys), F.lpad(n.cast("string"), 6, "0")))


def words(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, r"[ \t\r\n]+"), lambda w: w != "")


#: By byte, whether it is one of ``BLANK``; in UTF-8 those bytes occur in no other character.
_BLANKS = np.isin(np.arange(256), [*b" \t\r\n"])


def _chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """White-space tokens of all rows (none is null), and the row of each. Works on the bytes, so that no token becomes a Python object."""
    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    rows = at - at[0]
    kept = ~_BLANKS[data]
    first = kept.copy()
    first[1:] &= ~kept[:-1]
    heads = rows[:-1][rows[:-1] < len(data)]
    first[heads] = kept[heads]  # a row's first token doesn't go on from the row before
    starts = np.flatnonzero(first)
    own = data[kept]
    offsets = np.append(np.flatnonzero(first[kept]), len(own)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(own)), np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.searchsorted(starts, rows)))


#: Bytes of text that are cut into chunks at once, and of counted chunks that a task holds before it gives them on.
PART, HELD = 2 << 20, 16 << 20


def _counted_part(b: pa.RecordBatch, names: list[str]) -> pa.Table:
    *keys, texts = b.columns
    chunks, rows = _chunks(texts)
    own, codes = names[:-1], [k.dictionary_encode() for k in keys]
    found = pa.table([*(c.indices.take(pa.array(rows)) for c in codes), chunks], names=own).group_by(own, use_threads=False).aggregate([([], "count_all")])
    return pa.table([*(pa.chunked_array([c.dictionary]).take(found[k]) for c, k in zip(codes, own)), found["chunk"], found["count_all"]], names=names)


def _counted_chunks(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    *own, n = names
    merged = lambda held: pa.concat_tables(held).group_by(own, use_threads=False).aggregate([(n, "sum")]).rename_columns(names)
    held: list[pa.Table] = []
    for b in batches:
        for a, z in slices(b.columns[-1], PART):
            held.append(_counted_part(b.slice(a, z - a), names))
            if sum(t.nbytes for t in held) > HELD:
                held = [merged(held)]
                if held[0].nbytes > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from merged(held).to_batches()


def chunk_counts(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, chunk, n``: white-space tokens, counted by the keys within a task, which holds ``HELD`` bytes of them; the same one comes again from others.

    A text's tokens are those of its chunks, so what depends on a token alone is worked out for few rows. No exchange.
    """
    own = docs.filter(F.col(text).isNotNull()).select(*keys, text)
    schema = StructType([*(own.schema[k] for k in keys), StructField("chunk", StringType()), StructField("n", LongType())])
    names = schema.names
    return own.mapInArrow(lambda it: _counted_chunks(it, names), schema)


def _structs(rows: list[list[tuple] | None], **kinds: pa.DataType) -> pa.Array:
    """A list of tuples, or null, for each row as an array of structs."""
    sizes = np.cumsum([0, *(len(x or ()) for x in rows)]).astype(np.int32)
    columns = [*zip(*(x for r in rows if r for x in r))] or [()] * len(kinds)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], fields=[pa.field(k, t) for k, t in kinds.items()])
    return pa.ListArray.from_arrays(pa.array(sizes, mask=np.array([*(r is None for r in rows), False], bool)), values)


def _offsets(texts: pa.Array) -> pa.Array:
    rows = [None if t is None else [(*m.span(), m[0]) for m in CHUNK.finditer(t)] for t in texts.to_pylist()]
    return _structs(rows, start=pa.int32(), stop=pa.int32(), form=pa.string())


@F.arrow_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("form", StringType())])))
def offsets(texts: pa.Array) -> pa.Array:
    """White-space tokens with half-open character offsets."""
    return in_slices(_offsets, texts)


def punct_tokens(c: Column) -> Column:
    """Words apart from punctuation: a protected chunk is whole, else each mark is a token. One pass over the text."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_type(w: Column, strict: bool = False) -> Column:
    return F.when(w.rlike(rf"^[{PUNCT}]+$"), "punct").when(w.rlike(NUMBER) | w.rlike(STRICT_ROMAN if strict else ROMAN), "number").otherwise("word")


def doubled(w: Column) -> Column:
    """Does the word begin with two equal parts of two letters or more?"""
    return w.rlike(r"^(..+)\1")


def code_switch(w: Column, tones: str = "áéíóúàèìòùâêîôû") -> Column:
    """Latin letters alone, at least four, and no tone mark: likely a word of another language."""
    return (F.length(w) >= 4) & w.rlike(r"^\p{IsLatin}+$") & ~F.lower(w).rlike(f"[{tones}]")


def clitics(w: Column, before, after) -> Column:
    """``(proclitic, host, enclitic)``: at most one of each, the longest first; the host isn't empty."""
    longest = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=lambda x: (-len(x), x)))
    pro = F.regexp_extract(w, rf"^({longest(before)})(.+)$", 1) if before else F.lit("")
    rest = F.substring(w, F.length(pro) + 1, F.length(w))
    post = F.regexp_extract(rest, rf"^(.+?)({longest(after)})$", 2) if after else F.lit("")
    return F.struct(pro.alias("proclitic"), F.substring(rest, F.lit(1), F.length(rest) - F.length(post)).alias("host"), post.alias("enclitic"))


def special_spans(patterns: dict[str, str]):
    """A function from a text column to ``array<struct<start,stop,kind>>``: matches of several patterns without overlap.

    All matches are sorted by start, then the longest first, then by the order of the patterns; each is kept
    if it begins where the one kept before it has ended.
    """
    find = _finder(patterns)

    def part(texts: pa.Array) -> pa.Array:
        return _structs([None if t is None else find(t) for t in texts.to_pylist()], start=pa.int32(), stop=pa.int32(), kind=pa.string())

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(part, texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("kind", StringType())])))


def _finder(patterns: dict[str, str]):
    compiled = [(k, re.compile(p)) for k, p in patterns.items()]

    def find(text: str) -> list[tuple[int, int, str]]:
        found = sorted((m.start(), -m.end(), i) for i, (_, p) in enumerate(compiled) for m in p.finditer(text) if m.end() > m.start())
        kept, end = [], 0
        for start, stop, i in found:
            if start >= end:
                kept.append((start, -stop, compiled[i][0]))
                end = -stop
        return kept

    return find


def special_words(patterns: dict[str, str]):
    """A function from a text column to ``array<struct<form,kind>>``: ``special_tokens`` in one step, by a look at the ends of each span."""
    find, blank = _finder(patterns), " \t\r\n"

    def whole(t: str) -> list[tuple[str, str]]:
        return [(t[a:z], k) for a, z, k in find(t) if (not a or t[a - 1] in blank) and (z == len(t) or t[z] in blank) and CHUNK.fullmatch(t, a, z)]

    def part(texts: pa.Array) -> pa.Array:
        return _structs([None if t is None else whole(t) for t in texts.to_pylist()], form=pa.string(), kind=pa.string())

    def run(texts: pa.Array) -> pa.Array:
        return in_slices(part, texts)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ArrayType(StructType([StructField("form", StringType()), StructField("kind", StringType())])))


def special_tokens(spans: Column, tokens: Column) -> Column:
    """White-space tokens (``offsets``) that are one special span from end to end, with its kind; both as columns
    of a table, as Spark doesn't take a Python function inside a lambda."""
    kind = lambda t: F.filter(spans, lambda s: (s["start"] == t["start"]) & (s["stop"] == t["stop"]))
    return F.filter(F.transform(tokens, lambda t: F.struct(t["form"].alias("form"), F.when(F.size(kind(t)) > 0, kind(t)[0]["kind"]).alias("kind"))), lambda x: x["kind"].isNotNull())


def exploded(docs: DataFrame, parts: Column, keys=("doc_id",), name: str = "sentence") -> DataFrame:
    """One row for each part, with its place from 1."""
    found = docs.select(*keys, parts.alias("__parts"))
    return found.select(*keys, F.posexplode("__parts").alias("n", name)).withColumn("n", F.col("n") + 1)
