"""Shared parts: bounded sub-batches of text, words as integer codes, hashes, ragged arrays.

Python sees text as Arrow batches. Splitting, lower-casing and dictionary encoding run in Arrow's
C++; Python code only touches the distinct words of a sub-batch, and numpy does the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text handled at once, in bytes; one longer document makes a sub-batch of its own.
SUB_BYTES = 4 << 20
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, by exact name, so that any other column can't clash with ours.

    A column that is missing is an error that names it.
    """
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"columns missing: {', '.join(gone)}")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def kind(df: DataFrame, name: str) -> str:
    """Type of a column; ids pass through as they are, of any type."""
    return next(t for c, t in df.dtypes if c == name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def sub_batches(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SUB_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each; no row is cut or lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """White-space words of each text: codes of all words in order, row offsets, and the distinct words."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    encoded = lists.flatten().dictionary_encode()
    codes, distinct = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    return drop_codes(codes, offsets, distinct, pc.not_equal(distinct, "").to_numpy(zero_copy_only=False))


def drop_codes(codes: np.ndarray, offsets: np.ndarray, distinct: pa.Array, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Leave out the words whose distinct form isn't kept; codes stay as they were."""
    if keep.all():
        return codes, offsets, distinct
    kept = keep[codes]
    return codes[kept], np.concatenate(([0], np.cumsum(kept)))[offsets], distinct


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, in lower case with all but letters and digits removed, and as 64-bit hashes."""
    codes, offsets, distinct = words(texts)
    plain = pc.replace_substring_regex(pc.utf8_lower(distinct), r"[^\p{L}\p{N}]+", "")
    codes, offsets, plain = drop_codes(codes, offsets, plain, pc.not_equal(plain, "").to_numpy(zero_copy_only=False))
    return hashes(plain)[codes], offsets, codes


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x, seed) for x in distinct.to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words from its start; the last ``n - 1`` places hold no whole run."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * M1 + h[k : len(h) - n + 1 + k]
    return mix(out)


def starts_inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each start of a run of ``n``: does the run stay within its row?"""
    row_end = np.repeat(offsets[1:], np.diff(offsets))[: max(0, total - n + 1)]
    return np.arange(len(row_end)) + n <= row_end


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values, 0 for an empty row."""
    out = np.zeros(len(offsets) - 1, np.float64)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values.astype(np.float64, copy=False), offsets[:-1][full])
    return out


def ragged_take(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The listed rows of a ragged array one after another, and their lengths."""
    lengths = offsets[1:][rows] - offsets[:-1][rows]
    total = int(lengths.sum())
    if not total:
        return flat[:0], lengths
    ends = np.cumsum(lengths)
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[:-1][rows] - (ends - lengths), lengths)
    return flat[at], lengths
