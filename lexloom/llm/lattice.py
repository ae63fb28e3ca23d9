"""Language-model scores: probability of a text over all its subword segmentations.

A white-space word, with the word-start mark before it, is a lattice of vocabulary pieces. Its
probability is the sum over all segmentations of the product of the pieces' probabilities; a forward
recursion in log space gives it without listing them. A document's log probability is the sum over
its words, since no piece crosses a word boundary. A character outside the vocabulary is spelled in
byte pieces, so no text has probability 0.

Pieces come from an existing vocabulary file (a path parameter). A unigram file has log
probabilities, which are used as they are. A merge-ranked file has only ranks; its pieces then get
unigram log probabilities from the corpus: all words of all documents are counted, each
distinct word is segmented once by the existing tokenizer, and piece counts are smoothed by ``DELTA``.
The tokenizer itself is never trained. The driver reads the file and sends its bytes to the tasks; words are normalised as the file asks, for
counting and for scoring alike.

Defined results: a null text has null scores; a text without words has log probability 0 and null
``bits_per_char``. Repeated rows score alike and each counts in the corpus. An empty corpus gives all
pieces one probability. Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import M1, column, kind, mix, need, segment_sum, sub_batches, words

VOCABULARY, DELTA, MARK, WIDE = "/opt/tokenizers/piece_bpe_32k.model", 0.5, "▁", 48


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(2)
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


@lru_cache(2)
def plain(model: bytes) -> bool:
    """Does the file leave words as they are, but for the mark before them?"""
    probe = "ﬁ①Ａe\u0301Éß"
    return processor(model).normalize(probe) == MARK + probe


def normalised(model: bytes, distinct: pa.Array) -> list[str]:
    """Words with the mark before them, in the file's normal form."""
    if plain(model):
        return pc.binary_join_element_wise(MARK, distinct, "").to_pylist()
    return processor(model).normalize(distinct.to_pylist())


def pieces(model: bytes) -> tuple[dict[str, int], dict[int, int], np.ndarray]:
    """Ids of ordinary pieces, of bytes, and the file's scores."""
    p = processor(model)
    ids = [i for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    ordinary = {p.id_to_piece(i): i for i in ids if not p.is_byte(i)}
    return ordinary, {int(p.id_to_piece(i)[3:5], 16): i for i in ids if p.is_byte(i)}, np.array([p.get_score(i) for i in range(p.vocab_size())])


def ranked(model: bytes) -> bool:
    """Are the file's scores merge ranks, not log probabilities?"""
    ordinary, _, scores = pieces(model)
    own = scores[list(ordinary.values())]
    return bool((own == np.round(own)).all())


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches, limit=12 << 20):
        codes, _, distinct = words(column(b, "text"))
        n = np.bincount(codes, minlength=len(distinct))
        used = pa.array(n > 0)
        yield pa.record_batch([distinct.filter(used), pa.array(n).filter(used)], names=["word", "n"])


def _count_pieces(batches: Iterable[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    p = processor(model)
    total = np.zeros(p.vocab_size(), np.int64)
    for b in batches:
        if b.num_rows:
            n = column(b, "n").to_numpy()
            for a in range(0, b.num_rows, 20_000):
                lists = p.encode(column(b, "word").slice(a, 20_000).to_pylist(), num_threads=1)
                flat = np.fromiter((x for ids in lists for x in ids), np.int64)
                total += np.bincount(flat, np.repeat(n[a : a + len(lists)], [len(x) for x in lists]), len(total)).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents; counted in each sub-batch and task before the exchange."""
    ship(docs.sparkSession)
    return need(docs, "text").filter("text is not null").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_scores(docs: DataFrame, model: bytes, delta: float = DELTA) -> np.ndarray:
    """Log probability of each piece by id, from all of ``docs``. The driver gets one row per piece."""
    ordinary, of_byte, _ = pieces(model)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counts = np.zeros(processor(model).vocab_size())
    for r in word_counts(docs).mapInArrow(lambda it: _count_pieces(it, sent.value), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[r.piece] = r.n
    out, used = np.full(len(counts), -inf), [*ordinary.values(), *of_byte.values()]
    out[used] = np.log(counts[used] + delta) - np.log(counts[used].sum() + delta * len(used))
    return out


class Lattice:
    """Marginal log probabilities of words under piece scores."""

    def __init__(self, ordinary: dict[str, int], of_byte: dict[int, int], scores: np.ndarray):
        self.score = {p: float(scores[i]) for p, i in ordinary.items()}
        self.bytes = [float(scores[of_byte[b]]) if b in of_byte else -100.0 for b in range(256)]
        self.longest = max(map(len, self.score), default=1)
        long = [p for p in self.score if len(p) > 1]
        key = np.array([self._hash(np.array([[ord(c) for c in p]], np.uint64))[0] for p in long], np.uint64)
        order = np.argsort(key)
        self.key, self.value = key[order], np.array([self.score[p] for p in long])[order]
        if len(np.unique(key)) != len(key):
            raise ValueError("piece hashes collide")
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.key >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Of each row of code points, from the last to the first: h = h * M1 + c + 1."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1] - 1, -1, -1):
            h = h * M1 + codes[:, k] + np.uint64(1)
        return mix(h)

    def char(self, c: str) -> float:
        s = self.score.get(c)
        return s if s is not None else sum(self.bytes[x] for x in c.encode("utf-8", "surrogatepass"))

    def one(self, word: str) -> float:
        """The recursion for one word of any length."""
        get, longest, a = self.score.get, self.longest, [0.0]
        for j in range(1, len(word) + 1):
            t = a[j - 1] + self.char(word[j - 1])
            for i in range(j - 2, max(-1, j - longest - 1), -1):
                s = get(word[i:j])
                if s is not None:
                    x = a[i] + s
                    t = max(t, x) + log1p(exp(-abs(t - x)))
            a.append(t)
        return a[-1]

    def many(self, distinct: list[str]) -> np.ndarray:
        """The recursion for many words at once, those of one length together."""
        out, n = np.zeros(len(distinct)), np.fromiter(map(len, distinct), np.int64, len(distinct))
        for length in np.unique(n):
            rows = np.flatnonzero(n == length)
            if length > WIDE:
                out[rows] = [self.one(distinct[i]) for i in rows]
                continue
            for a in range(0, len(rows), 16384):
                part = rows[a : a + 16384]
                text = "".join(distinct[i] for i in part)
                out[part] = self._forward(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length).T)
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        """``codes``: code points by place and word."""
        own, at = np.unique(codes, return_inverse=True)
        single = np.array([self.char(chr(c)) for c in own])[at].reshape(codes.shape)
        wide = codes.astype(np.uint64) + np.uint64(1)
        alpha = [np.zeros(codes.shape[1])]
        for j in range(1, len(codes) + 1):
            top, h = alpha[j - 1] + single[j - 1], wide[j - 1]
            for k in range(2, min(j, self.longest) + 1):
                h = h * M1 + wide[j - k]
                m = mix(h)
                hit = np.flatnonzero(self.bloom[(m >> np.uint64(42)).astype(np.int64)])
                if len(hit):
                    p = np.minimum(np.searchsorted(self.key, m[hit]), len(self.key) - 1)
                    ok = self.key[p] == m[hit]
                    hit, p = hit[ok], p[ok]
                    top[hit] = np.logaddexp(top[hit], alpha[j - k][hit] + self.value[p])
            alpha.append(top)
        return alpha[-1]


def _score(batches: Iterable[pa.RecordBatch], lattice: Lattice, model: bytes) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches):
        text = column(b, "text")
        null = text.is_null().to_numpy(zero_copy_only=False)
        codes, offsets, distinct = words(text)
        marked = normalised(model, distinct)
        logs = segment_sum(lattice.many(marked)[codes], offsets)
        chars = segment_sum(np.fromiter(map(len, marked), np.int64, len(marked))[codes], offsets)
        with np.errstate(invalid="ignore", divide="ignore"):
            bits = -logs / (chars * log(2))
        yield pa.record_batch([column(b, "doc_id"), pa.array(np.diff(offsets), mask=null), pa.array(logs, mask=null), pa.array(bits, mask=null | (chars == 0))], names=["doc_id", "n_words", "log_prob", "bits_per_char"])


def score(docs: DataFrame, path: str = VOCABULARY, scores: np.ndarray | None = None, delta: float = DELTA) -> DataFrame:
    """``doc_id, n_words, log_prob, bits_per_char`` of every row of ``docs`` (``doc_id``, ``text``)."""
    spark = ship(docs.sparkSession)
    model = model_bytes(path)
    ordinary, of_byte, own = pieces(model)
    if scores is None:
        scores = corpus_scores(docs, model, delta) if ranked(model) else own
    sent = spark.sparkContext.broadcast((Lattice(ordinary, of_byte, scores), model))  # as large as the vocabulary
    return need(docs, "doc_id", "text").mapInArrow(lambda it: _score(it, *sent.value), f"doc_id {kind(docs, 'doc_id')}, n_words long, log_prob double, bits_per_char double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
