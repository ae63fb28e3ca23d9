"""Byte-level BPE encoding and decoding with a two-tier lookup.

Text is cut into pre-tokens by the vocabulary's pattern. A pre-token that is a vocabulary entry as a
whole is resolved by a minimal perfect hash (first tier, for all distinct pre-tokens of a sub-batch at once).
Any other is merged by a heap over linked bytes (second tier), least rank first, leftmost of equal
ranks; results are kept in a bounded memo of two generations. Ids are the ranks of the vocabulary file.

The vocabulary is a file of base64 tokens and ranks whose path is a parameter; nothing is trained.
Its tables are of fixed size and sent to the tasks once. No shuffle: a document is encoded where it is read.

Defined results: a null text has null tokens, an empty one an empty list. Decoding a null list
gives null, an id outside the vocabulary decodes to nothing, bytes that aren't UTF-8 to U+FFFD.
Repeated rows are encoded alike; no row depends on another.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import M1, column, kind, mix, need, ragged_take, sub_batches

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in each of the memo's two generations; a full young one becomes the old one.
MEMO = 250_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def hash_of(keys: Iterable[bytes], n: int) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(k) for k in keys), np.uint64, n)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit key hashes: buckets displaced until all slots differ.

    As many slots as keys. Buckets of one key take the slots left over, stored as they are.
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("key hashes collide")
        self.buckets = max(1, n // 4)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        size = np.bincount(bucket, minlength=self.buckets)
        self.shift, self.slot_key, self.slot_value = np.zeros(self.buckets, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        for m in range(int(size.max(initial=0)), 1, -1):  # the largest buckets first, all of a size at once
            own = np.flatnonzero(size[bucket] == m)
            own, d = own[np.argsort(bucket[own], kind="stable")].reshape(-1, m), 0
            while len(own):
                d += 1
                slots = self._slot(keys[own], d)
                ok = ~taken[slots].any(1)
                first = np.full(n, len(own))
                np.minimum.at(first, slots[ok], np.flatnonzero(ok)[:, None])
                ok &= (first[slots] == np.arange(len(own))[:, None]).all(1)  # a slot goes to the first bucket that wants it
                ok &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                put, at = own[ok], slots[ok]
                taken[at] = True
                self.shift[bucket[put[:, 0]]] = d
                self.slot_key[at], self.slot_value[at] = keys[put], put
                own = own[~ok]
        one = np.flatnonzero(size[bucket] == 1)
        free = np.flatnonzero(~taken)
        self.shift[bucket[one]], self.slot_key[free], self.slot_value[free] = -free - 1, keys[one], one

    def _slot(self, keys: np.ndarray, d) -> np.ndarray:
        return (mix(keys + np.atleast_1d(d).astype(np.uint64) * M1) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for one that isn't there."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1)
        d = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(keys, np.maximum(d, 0)))
        return np.where(self.slot_key[slot] == keys, self.slot_value[slot], -1)


class Vocabulary:
    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.pattern = pattern
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        self.table = PerfectHash(hash_of(tokens, len(tokens)))
        self.rank_of = np.fromiter(self.ranks.values(), np.int32, len(tokens))
        by_rank: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            by_rank[r] = t
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in by_rank]))).astype(np.int64)
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.memo: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "old": {}, "_pattern": None}

    def split(self):
        if self.__dict__.get("_pattern") is None:
            self._pattern = regex.compile(self.pattern)
        return self._pattern.findall

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token: a heap of neighbour pairs over linked pieces, each known by its first byte's place."""
        get, n = self.ranks.get, len(token)
        bits = n.bit_length() + 1
        mask, after, before = (1 << bits) - 1, list(range(1, n + 2)), list(range(-1, n))
        # a pair is one number: rank, first byte's place, end
        heap = [(r << bits | i) << bits | i + 2 for i, r in enumerate(map(self.pairs.__getitem__, map(int.__add__, map((256).__mul__, token), token[1:]))) if r >= 0]
        heapify(heap)
        while heap:
            x = heappop(heap)
            end, i = x & mask, x >> bits & mask
            j = after[i]
            if not j or j >= n or after[j] != end:
                continue  # one of its parts has changed
            after[i], after[j] = end, 0
            if end < n:
                before[end] = i
                stop = after[end]
                r = get(token[i:stop])
                if r is not None:
                    heappush(heap, (r << bits | i) << bits | stop)
            p = before[i]
            if p >= 0:
                r = get(token[p:end])
                if r is not None:
                    heappush(heap, (r << bits | p) << bits | end)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            out.append(ranks[token[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and row offsets."""
        split = self.split()
        parts = [split(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        tokens = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        codes, distinct = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary.to_pylist()
        number = self.table.find(hash_of((t.encode() for t in distinct), len(distinct)))
        lists, memo = [], self.memo
        for t, k in zip(distinct, number.tolist()):
            if k >= 0:
                lists.append((self.rank_of[k],))
                continue
            ids = memo.get(t)
            if ids is None:
                ids = self.old.get(t)
                if ids is None:
                    ids = self.merge(t.encode())
                if len(memo) >= MEMO:
                    self.old, memo = memo, {}
                    self.memo = memo
                memo[t] = ids
            lists.append(ids)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum()))
        ids, each = ragged_take(flat, np.concatenate(([0], np.cumsum(lengths))), codes)
        ends = np.concatenate(([0], np.cumsum(each)))
        return ids, ends[np.concatenate(([0], np.cumsum(counts)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        ok = (ids >= 0) & (ids < len(self.offsets) - 1)
        if not ok.all():
            offsets = np.concatenate(([0], np.cumsum(ok)))[offsets]
            ids = ids[ok]
        flat, each = ragged_take(self.bytes, self.offsets, ids)
        ends = np.concatenate(([0], np.cumsum(each)))[offsets].tolist()
        raw = flat.tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _encode(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches, limit=2 << 20):
        text = column(b, "text")
        null = text.is_null().to_numpy(zero_copy_only=False)
        texts = text.fill_null("").to_pylist()
        ids, offsets = vocabulary.encode(texts)
        same = [x == t.encode() for x, t in zip(vocabulary.decode(ids, offsets), texts)]
        at = pa.array(offsets.astype(np.int32), mask=np.append(null, False))  # a null offset makes the row null
        yield pa.record_batch([column(b, "doc_id"), pa.ListArray.from_arrays(at, pa.array(ids)), pa.array(np.diff(offsets), mask=null), pa.array(same, mask=null)], names=["doc_id", "tokens", "n_tokens", "round_trip"])


def _decode(batches: Iterable[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            lists = column(b, "tokens")
            null = lists.is_null().to_numpy(zero_copy_only=False)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = vocabulary.decode(flat, np.concatenate(([0], np.cumsum(lengths))))
            yield pa.record_batch([column(b, "doc_id"), pa.array([None if z else t.decode("utf-8", "replace") for t, z in zip(texts, null)], pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens, n_tokens, round_trip`` of every row of ``docs`` (``doc_id``, ``text``).

    ``round_trip`` tells whether the decoded tokens are the text's bytes again.
    """
    v = ship(docs.sparkSession).sparkContext.broadcast(Vocabulary(path, pattern))
    return need(docs, "doc_id", "text").mapInArrow(lambda it: _encode(it, v.value), f"doc_id {kind(docs, 'doc_id')}, tokens array<int>, n_tokens long, round_trip boolean")


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of every row of ``rows`` (``doc_id``, ``tokens``)."""
    v = ship(rows.sparkSession).sparkContext.broadcast(Vocabulary(path))
    return need(rows, "doc_id", "tokens").select("doc_id", F.col("tokens").cast("array<int>")).mapInArrow(lambda it: _decode(it, v.value), "doc_id long, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
