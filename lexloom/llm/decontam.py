"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A benchmark item of m words is compared with the windows of m words of every document. A window
and an item have 256-bit SimHash fingerprints of their weighted word shingles. Fingerprints are cut
into ``BLOCKS`` blocks with a table each, by size of the item; two fingerprints within ``RADIUS`` bits are within
``RADIUS / BLOCKS`` bits in one block at least, so what the tables give holds all of them. Blocks are wide, for narrow ones
that have to agree in every bit select nothing at such a radius: a table is scanned, and of pairs that have nothing to do with each other
one in 1,500 is left. Each candidate is verified by the exact weighted Jaccard similarity of the
shingle multisets, a shingle weighing as many as its letters.

A window can only reach similarity t if shingles that occur in the benchmark make up the share t of
its weight; windows that fail this bound are left out before fingerprinting, which loses nothing.

The benchmark is fixed, not corpus-sized. It is sent to the tasks in chunks of ``CHUNK_BYTES`` of
text; a larger one takes several passes over the documents, so what a task holds is bounded.

Defined results: a null or empty text, and an item without words, match nothing; a document shorter
than an item has one window, its whole text; an item shorter than a shingle is one shingle. Rows of
one ``doc_id`` are reported as one, and so are items of one ``item_id``, by the most similar of their texts. Of an item's windows in a document the most similar is reported, of
equal ones the first. Null ids are kept as nulls; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship, written
from .common import M1, column, drop_codes, hashes, kind, mix, need, sub_batches, words

SHINGLE, WORDS, BLOCKS, RADIUS, THRESHOLD, CHUNK_BYTES = 3, 4, 2, 88, 0.5, 8 << 20
#: Shingles whose signs are summed at once, and pairs of fingerprints that are compared at once.
REGION, PAIRS = 1 << 13, 1 << 20
_BITS = np.arange(64, dtype=np.uint64)
_SALT = mix(np.arange(1, WORDS + 1, dtype=np.uint64))


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word weights (letters) and row offsets."""
    codes, offsets, distinct = words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "")
    length = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, offsets, plain = drop_codes(codes, offsets, plain, length > 0)
    return hashes(plain)[codes], length[codes], offsets


def shingled(h: np.ndarray, w: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of the run of ``n`` words from each word; runs that cross a row are for the caller to skip."""
    k = len(h) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s, v = h[:k].copy(), w[:k].copy()
    for i in range(1, n):
        s = s * M1 + h[i : k + i]
        v += w[i : k + i]
    return mix(s), v


def one_shingle(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row shorter than a shingle is one shingle."""
    return mix(np.array([sum(int(x) * (i * 2 + 3) for i, x in enumerate(h)) & (1 << 64) - 1], np.uint64)), np.array([w.sum()])


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash in words of 64 bits, from signed sums by bit, one row each."""
    return ((sums > 0).astype(np.uint64).reshape(len(sums), WORDS, 64) << _BITS).sum(2, dtype=np.uint64)


def signed(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    bits = (mix(s[:, None] ^ _SALT)[:, :, None] >> _BITS) & np.uint64(1)
    return np.where(bits.reshape(len(s), -1), w[:, None], -w[:, None])


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length - start, length)


class Index:
    """Fingerprints and shingles of a chunk of the benchmark, in flat arrays."""

    def __init__(self, ids: list, texts: list, radius: int = RADIUS, shingle: int = SHINGLE):
        h, w, offsets = weighted(pa.array(texts, pa.string()))
        self.radius, self.shingle, self.ids, self.size, prints, own = radius, shingle, [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            if a == b:
                continue
            own.append(shingled(h[a:b], w[a:b], shingle) if b - a >= shingle else one_shingle(h[a:b], w[a:b]))
            self.ids.append(ids[i])
            self.size.append(int(b - a))
            prints.append(fingerprint(signed(*own[-1]).sum(0, keepdims=True))[0])
        n = len(self.ids)
        self.prints, self.size = np.array(prints, np.uint64).reshape(n, WORDS), np.array(self.size, np.int64)
        every = np.concatenate([s for s, _ in own]) if own else np.empty(0, np.uint64)
        item = np.repeat(np.arange(n), [len(s) for s, _ in own])
        self.shingles, first, place = np.unique(every, return_index=True, return_inverse=True)
        self.weight = (np.concatenate([v for _, v in own]) if own else np.empty(0, np.int64))[first]
        # bags: (item, shingle) in order, with counts; posts: the same by shingle
        k = max(1, len(self.shingles))
        pairs, self.count = np.unique(item * k + place, return_counts=True)
        self.bag, of = pairs % k, pairs // k
        self.bags = np.searchsorted(of, np.arange(n + 1))
        self.total = np.bincount(of, self.count * self.weight[self.bag], minlength=n).astype(np.int64)
        order = np.argsort(self.bag, kind="stable")
        self.posts, self.post_offsets = of[order], np.searchsorted(self.bag[order], np.arange(len(self.shingles) + 1))
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.shingles >> np.uint64(42)).astype(np.int64)] = True
        self.of_size = {int(m): np.flatnonzero(self.size == m) for m in np.unique(self.size)}
        self.compared = 0  # candidates whose whole fingerprints were compared

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``s`` that hold a shingle of the benchmark, and which."""
        at = np.flatnonzero(self.bloom[(s >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.shingles):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
        ok = self.shingles[k] == s[at]
        return at[ok], k[ok]

    def near(self, prints: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window, item of ``m`` words) whose fingerprints are within the radius."""
        items = self.of_size.get(int(m))
        if items is None or not len(prints):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        table, out = np.ascontiguousarray(self.prints[items].T), []
        step, wide = max(1, PAIRS // len(items)), WORDS // BLOCKS
        for a in range(0, len(prints), step):
            q = np.ascontiguousarray(prints[a : a + step].T)
            close = np.zeros((q.shape[1], len(items)), bool)
            for k in range(0, WORDS, wide):
                apart = np.bitwise_count(q[k][:, None] ^ table[k])
                for j in range(k + 1, k + wide):
                    apart = apart + np.bitwise_count(q[j][:, None] ^ table[j])
                close |= apart <= self.radius // BLOCKS
            i, j = np.nonzero(close)
            self.compared += len(i)
            whole = np.bitwise_count(q[:, i] ^ table[:, j]).sum(0, dtype=np.int64) <= self.radius
            out.append((i[whole] + a, items[j[whole]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def similarity(self, item: int, which: np.ndarray, total: int) -> float:
        """Exact weighted Jaccard of an item and a window: its shingles of the benchmark, and its whole weight."""
        a, b = self.bags[item], self.bags[item + 1]
        own, n = np.unique(which, return_counts=True)
        at = np.minimum(np.searchsorted(self.bag[a:b], own), b - a - 1) + a
        ok = self.bag[at] == own
        both = int((np.minimum(n[ok], self.count[at[ok]]) * self.weight[own[ok]]).sum())
        return both / (total + int(self.total[item]) - both)


def matches(texts: pa.Array, index: Index, threshold: float) -> list[tuple[int, int, float, int]]:
    """(row, item, similarity, first word of the window) of the best window of each pair that reaches the threshold."""
    if not index.ids:
        return []
    n = index.shingle
    h, w, offsets = weighted(texts)
    s, v = shingled(h, w, n)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start, end = offsets[:-1][row_of], offsets[1:][row_of]
    inside = np.arange(len(s)) + n <= end[: len(s)]
    at, which = index.find(s)
    ok = inside[at]
    at, which = at[ok], which[ok]
    best: dict[tuple[int, int], tuple[float, int]] = {}

    def note(row: int, item: int, x: float, first: int) -> None:
        if x >= threshold and ((row, item) not in best or (-x, first) < (-best[row, item][0], best[row, item][1])):
            best[row, item] = (x, first)

    if len(at):
        known = np.full(len(s), -1, np.int64)
        known[at] = which
        held = np.where(known >= 0, v, 0)
        v = np.where(inside, v, 0)
        run_held, run_all = np.concatenate(([0], np.cumsum(held))), np.concatenate(([0], np.cumsum(v)))
        # every window, as long as one of its items, that covers a shingle of that item
        counts = index.post_offsets[which + 1] - index.post_offsets[which]
        item = index.posts[runs(index.post_offsets[which], counts)]
        key = np.unique(np.stack([index.size[item], np.repeat(at, counts)]), axis=1)
        for m in np.unique(key[0]):
            p = key[1][key[0] == m]
            size = np.minimum(m, end[p] - start[p])
            first, last = np.maximum(p + n - m, start[p]), np.minimum(p, end[p] - size)
            at_w = np.unique(runs(first, np.maximum(last - first + 1, 0)))
            stop = at_w + np.minimum(m, end[at_w] - start[at_w]) - n + 1
            ok = run_held[stop] - run_held[at_w] >= threshold * (run_all[stop] - run_all[at_w]) - 1e-9
            at_w, stop = at_w[ok], stop[ok]
            i = 0
            far = np.flatnonzero(np.diff(at_w, append=1 << 62) > m)  # windows beyond are summed apart
            while i < len(at_w):
                j = min(max(i + 1, int(np.searchsorted(at_w, at_w[i] + REGION))), int(far[np.searchsorted(far, i)]) + 1)
                a, b = at_w[i], stop[j - 1]
                sums = np.concatenate((np.zeros((1, WORDS * 64), np.int64), np.cumsum(signed(s[a:b], v[a:b]), 0)))
                prints = fingerprint(sums[stop[i:j] - a] - sums[at_w[i:j] - a])
                for k, it in zip(*index.near(prints, int(m))):
                    f, l = at_w[i + k], stop[i + k]
                    r = int(row_of[f])
                    own = known[f:l]
                    note(r, int(it), index.similarity(int(it), own[own >= 0], int(run_all[l] - run_all[f])), int(f - offsets[r]))
                i = j
    for r in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < n)):
        a, b = offsets[r], offsets[r + 1]
        s1, v1 = one_shingle(h[a:b], w[a:b])
        _, which = index.find(s1)
        if len(which):  # else nothing is shared
            for m in index.of_size:
                for _, it in zip(*index.near(fingerprint(signed(s1, v1)), m)):
                    note(int(r), int(it), index.similarity(int(it), which, int(v1[0])), 0)
    return sorted((r, it, x, f) for (r, it), (x, f) in best.items())


def _scan(batches: Iterable[pa.RecordBatch], index: Index, threshold: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches):
        got = matches(column(b, "text"), index, threshold)
        if got:
            r, it, x, f = zip(*got)
            keys = [c for c in b.schema.names if c != "text"]
            yield pa.record_batch([*(column(b, c).take(pa.array(r)) for c in keys), pa.array([index.ids[i] for i in it], id_type), pa.array(x, pa.float64()), pa.array(f, pa.int64())], names=[*keys, "item_id", "similarity", "first_word"])


def chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[tuple[list, list]]:
    """The benchmark's (id, text) lists, in chunks of bounded text."""
    ids, texts, held = [], [], 0
    for row in need(benchmark, "item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if ids and held + len(row.text) > chunk_bytes:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += len(row.text)
    yield ids, texts


def _scanned(rows: DataFrame, benchmark: DataFrame, threshold: float, radius: int, shingle: int, chunk_bytes: int) -> DataFrame:
    """The other columns of ``rows`` with ``item_id, similarity, first_word``, for each row and item of a chunk."""
    spark, out = ship(rows.sparkSession), None
    schema = ", ".join([f"{c} {kind}" for c, kind in rows.dtypes if c != "text"] + [f"item_id {kind(benchmark, 'item_id')}, similarity double, first_word long"])
    rows, id_type = rows.filter("text is not null"), to_arrow_type(benchmark.schema["item_id"].dataType)
    for ids, texts in chunks(benchmark, chunk_bytes):
        index = spark.sparkContext.broadcast(Index(ids, texts, radius, shingle))
        part = rows.mapInArrow(lambda it, index=index: _scan(it, index.value, threshold, id_type), schema)
        out = part if out is None else out.union(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, shingle: int = SHINGLE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: the best window of each pair that reaches ``threshold``."""
    out = _scanned(need(docs, "doc_id", "text"), benchmark, threshold, radius, shingle, chunk_bytes)
    best = F.max_by(F.col("first_word"), F.struct("similarity", -F.col("first_word"))).alias("first_word")
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), best)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those in which a benchmark item was found.

    Rows are told apart by ``doc_id`` and a hash of the text, so that a clean row stays if another one of
    its ``doc_id``, or of none, is contaminated. The list of found rows is short beside the corpus; Catalyst
    broadcasts it if it is small.
    """
    rows = need(docs, "doc_id", "text").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), "text")
    found = written(_scanned(rows, benchmark, THRESHOLD, RADIUS, SHINGLE, CHUNK_BYTES).select("__id", "__h").distinct(), "leaks")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__h"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
