"""Language identification with hyperdimensional profiles.

Each character has a random vector of ``DIMENSION`` signs, drawn from its code point. A character
n-gram binds its characters' vectors, each rotated by its place, into their elementwise product. A
document is the bundle (sum) of its n-grams' vectors, a language prototype the bundle of a bounded
sample of its labelled documents. Documents are compared with prototypes by cosine.

Texts are read in lower case; each run of characters other than letters is one space. A document's language
is the one of greatest cosine (of equal ones the first by name). It is ``und`` if the text has no
letter or the cosine is under ``MIN_COSINE * sqrt(n / (n + HALF))`` for n n-grams: a short text
holds less of a profile, so less is asked of it.

The labelled sample is bounded: about ``PER_LANGUAGE`` documents of each language, chosen by a hash
of text, whatever the size of the table; a text that is repeated, a million times even, is in it once. A language's sample is bundled in one
task, so the driver gets one vector of each language from one query. Everything else covers all text of all rows.

Defined results: null or letterless texts are ``und`` with cosine 0; rows with a null ``lang`` train
nothing; without any labelled row every text is ``und``; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, written
from .common import column, kind, need, sub_batches

DIMENSION, GRAM, PER_LANGUAGE, MIN_COSINE, HALF = 1024, 3, 1000, 0.25, 200
SUB, PARTS = 1 << 20, 16


class Vectors:
    """Rotated character vectors, drawn once for each code point."""

    def __init__(self, dimension: int = DIMENSION, gram: int = GRAM):
        self.dimension, self.gram, self.of = dimension, gram, {}

    def char(self, point: int) -> np.ndarray:
        if point not in self.of:
            if len(self.of) >= 4096:
                self.of.clear()
            v = np.random.default_rng([77, point]).integers(0, 2, self.dimension, dtype=np.int8) * 2 - 1
            self.of[point] = np.stack([np.roll(v, k) for k in range(self.gram)]).astype(np.int8)
        return self.of[point]

    def grams(self, points: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as rows of code points."""
        own, inverse = np.unique(points, return_inverse=True)
        chars = np.stack([self.char(int(p)) for p in own])
        inverse = inverse.reshape(points.shape)
        out = chars[inverse[:, 0], self.gram - 1]
        for k in range(1, self.gram):
            out = out * chars[inverse[:, k], self.gram - 1 - k]
        return out


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in lower case, words set apart by one space, and row offsets."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    plain = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_trim(plain, " "), pa.scalar(" "), "")
    n = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum(n)))


def counted(texts: pa.Array, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (rows of code points), and the counts of each in each text, as (text, n-gram) pairs and numbers."""
    points, offsets = letters(texts)
    rows, k = len(offsets) - 1, len(points) - gram + 1
    if k <= 0:
        return np.empty((0, gram), np.uint32), np.empty((0, 2), np.int64), np.empty(0, np.int64)
    own = np.flatnonzero(np.bincount(points, minlength=1)) if len(points) and points.max() < 1 << 21 else np.unique(points)
    code = np.searchsorted(own, points)
    whole = np.zeros(k, np.int64)
    for i in range(gram):
        whole = whole * len(own) + code[i : k + i]
    row = np.repeat(np.arange(rows), np.diff(offsets))[:k]
    # not across texts, and not the lone space of a text without letters
    inside = (np.arange(k) + gram <= offsets[1:][row]) & (np.diff(offsets)[row] > 2)
    whole, row = whole[inside], row[inside]
    if len(own) ** gram <= 1 << 22:
        used = np.flatnonzero(np.bincount(whole, minlength=1))
        column_of = np.zeros(len(own) ** gram, np.int64)
        column_of[used] = np.arange(len(used))
        place = column_of[whole]
    else:
        used, place = np.unique(whole, return_inverse=True)
    if rows * max(1, len(used)) <= 1 << 24:
        flat = np.bincount(row * len(used) + place, minlength=1)
        key = np.flatnonzero(flat)
        number = flat[key]
    else:
        key, number = np.unique(row * max(1, len(used)) + place, return_counts=True)
    pairs = np.stack([key // max(1, len(used)), key % max(1, len(used))], 1)
    grams = np.stack([own[(used // len(own) ** (gram - 1 - i)) % len(own)] for i in range(gram)], 1)
    return grams, pairs, number


def bundles(texts: pa.Array, vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text, and its number of n-grams."""
    grams, pairs, number = counted(texts, vectors.gram)
    out, n = np.zeros((len(texts), vectors.dimension), np.float32), np.zeros(len(texts), np.int64)
    np.add.at(n, pairs[:, 0], number)
    for a in range(0, len(grams), 4096):  # columns at once, so that a text of many scripts stays small
        v = vectors.grams(grams[a : a + 4096]).astype(np.float32)
        of = (pairs[:, 1] >= a) & (pairs[:, 1] < a + len(v))
        for r in range(0, len(texts), 1024):
            ok = of & (pairs[:, 0] >= r) & (pairs[:, 0] < r + 1024)
            if ok.any():
                counts = np.zeros((min(1024, len(texts) - r), len(v)), np.float32)
                counts[pairs[ok, 0] - r, pairs[ok, 1] - a] = number[ok]
                out[r : r + len(counts)] += counts @ v
    return out, n


def cosines(bundled: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return unit(bundled) @ unit(prototypes).T


def _train(batches: Iterable[pa.RecordBatch], dimension: int, gram: int) -> Iterator[pa.RecordBatch]:
    vectors, sums = Vectors(dimension, gram), {}
    for b in sub_batches(batches, limit=SUB):
        bundled, _ = bundles(column(b, "text"), vectors)
        for i, lang in enumerate(column(b, "lang").to_pylist()):
            sums[lang] = sums.get(lang, 0) + bundled[i].astype(np.float64)
    if sums:
        yield pa.record_batch([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE, dimension: int = DIMENSION, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Prototype of each language in ``docs`` (``text``, ``lang``), from a bounded sample of each."""
    rows = need(docs, "text", "lang").filter("lang is not null and text is not null")
    unit = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 11) / F.lit(float(1 << 53))
    share = written(rows.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share")), "shares")
    some = rows.join(share, "lang").filter(unit < F.col("share")).select("text", "lang").distinct().repartition(PARTS, "lang")
    got = some.mapInArrow(lambda it: _train(it, dimension, gram), "lang string, v array<double>").toArrow()
    return {k: np.array(v) for k, v in sorted(zip(got["lang"].to_pylist(), got["v"].to_pylist()))}


def _score(batches: Iterable[pa.RecordBatch], names: list[str], protos: np.ndarray, settings: tuple) -> Iterator[pa.RecordBatch]:
    dimension, gram, min_cosine, half, text = settings
    vectors = Vectors(dimension, gram)
    for b in sub_batches(batches, text, SUB):
        bundled, n = bundles(column(b, text), vectors)
        if names:
            c = cosines(bundled, protos)
            best = c.argmax(1)
            top = c[np.arange(len(c)), best].astype(np.float64)
            rest = np.where(np.arange(c.shape[1]) == best[:, None], -1, c).max(1).astype(np.float64)
        else:
            best, top, rest = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n))
        known = (n > 0) & (top >= min_cosine * np.sqrt(n / (n + half))) if names else np.zeros(len(n), bool)
        found = pa.array([names[i] if k else "und" for i, k in zip(best, known)], pa.string())
        rest_of = [b.column(i) for i, c_ in enumerate(b.schema.names) if c_ != text]
        extra = [found, pa.array(np.where(n > 0, top, 0)), pa.array(np.where(n > 0, top - rest, 0))]
        yield pa.record_batch([*rest_of, *extra], names=[*(c_ for c_ in b.schema.names if c_ != text), "language", "cosine", "margin"])


def _sent(docs: DataFrame, protos: dict[str, np.ndarray]):
    """Names and prototypes for all tasks: a few kB for each language."""
    return ship(docs.sparkSession).sparkContext.broadcast((list(protos), np.array(list(protos.values()), np.float32)))


def identify(docs: DataFrame, protos: dict[str, np.ndarray], dimension: int = DIMENSION, gram: int = GRAM, min_cosine: float = MIN_COSINE, half: float = HALF) -> DataFrame:
    """``doc_id, language, cosine, margin`` for every row of ``docs`` (``doc_id``, ``text``)."""
    sent = _sent(docs, protos)
    settings = (dimension, gram, min_cosine, half, "text")
    return need(docs, "doc_id", "text").mapInArrow(lambda it: _score(it, *sent.value, settings), f"doc_id {kind(docs, 'doc_id')}, language string, cosine double, margin double")


def _filter(batches: Iterable[pa.RecordBatch], names: list[str], protos: np.ndarray, settings: tuple, at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            own = b.rename_columns([str(i) for i in range(b.num_columns)])
            one = pa.record_batch([own.column(at)], names=["text"])
            found = pa.concat_arrays([column(x, "language") for x in _score([one], names, protos, settings)])
            yield b.filter(pc.not_equal(found, "und"))


def known(docs: DataFrame, protos: dict[str, np.ndarray], **settings) -> DataFrame:
    """Rows of ``docs`` whose language is found, all columns as they came; one pass, no join."""
    sent = _sent(docs, protos)
    s = (settings.get("dimension", DIMENSION), settings.get("gram", GRAM), settings.get("min_cosine", MIN_COSINE), settings.get("half", HALF), "text")
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _filter(it, *sent.value, s, at), docs.schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, prototypes(docs))
