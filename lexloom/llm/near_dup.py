"""Near-duplicate groups by MinHash and an LSH forest.

Every document's word shingles give a MinHash signature of ``VALUES`` values. The forest holds several orders of
the signature's values; rows whose longest common prefix in an order reaches the depth of their region are candidates for
each other. The depth adapts to the region. All rows begin at depth 2 in 16 orders. A region of at most
``REGION`` rows has all its pairs compared. A larger one compares every row with its first row, and those that
fail with all rows of the region, in blocks of signatures, which finds the same groups as all pairs would. Where
that takes more than ``WORK`` comparisons, the region's rows go deeper, in more orders the deeper they go
(``LEVELS``), so that little is lost: a pair of similarity 0.6 shares a region of depth 4 with a
probability of 0.9999. The last level compares whatever is left. Candidates are verified by the share of equal
signature values, and connected pairs form groups.

Sizes of regions come from partial counts, never from a window over a region; work of a large region is spread by
blocks, the star of a large group by adaptive joins.

Defined results: a text without any word (null, empty, punctuation) is no copy of anything, a
group of its own. Rows repeated with one ``doc_id`` are copies; one row of each group is kept, the
one with the least ``doc_id`` (nulls last). ``group_id`` is the least ``doc_id`` of the group, null
if all are null. A text of fewer than ``SHINGLE`` words has one shingle, the whole text. Node ids
are 64-bit hashes of the signature; two of 10^10 documents meet by chance a few times in all. ``doc_id`` may be
of any type that can be ordered; extra columns of any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_dir, remove, ship, written
from .common import M1, column, fresh, hashes, kind, mix, need, plain_words, shingles, starts_inside, sub_batches

VALUES, REGION, SHINGLE, THRESHOLD = 128, 32, 3, 0.55
#: Depth and number of orders of each level, and the comparisons of one region beyond which its rows go to the next.
LEVELS, WORK = ((2, 16), (4, 64), (8, 128), (16, 128)), 1 << 26
#: Signatures of a large region that are compared at once, and those of one side in a tile.
BLOCK, TILE = 4096, 256
_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)


def orders(depth: int, number: int) -> np.ndarray:
    """First values of each order. Sixteen orders go on as they are from level to level, the others are drawn by level."""
    rng = np.random.default_rng([depth, number])
    own = np.arange(VALUES).reshape(16, -1)[:, :depth] if depth <= VALUES // 16 else np.empty((0, depth), int)
    more = np.concatenate([rng.permutation(VALUES).reshape(-1, depth) for _ in range(number * depth // VALUES + 1)])
    return np.concatenate([own, more])[:number]


def signatures(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signature of each text as 128 16-bit values, and its number of shingles (0: no signature)."""
    h, offsets, _ = plain_words(texts)
    n = np.diff(offsets)
    inside = starts_inside(offsets, shingle, len(h))
    s = shingles(h, shingle)[inside]
    count = np.maximum(n - shingle + 1, 0)
    short = np.flatnonzero((n > 0) & (n < shingle))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.reduce(h[offsets[i] : offsets[i + 1]] * np.arange(1, n[i] * 2, 2, dtype=np.uint64), keepdims=True))[0] for i in short], np.uint64)
        s = np.insert(s, np.concatenate(([0], np.cumsum(count)))[short], whole)
        count[short] = 1
    sig = np.zeros((len(n), VALUES), np.uint16)
    full = np.flatnonzero(count)
    if len(full):
        at = np.concatenate(([0], np.cumsum(count)))[full]
        s32 = (s >> np.uint64(32)).astype(np.uint32)
        for k in range(VALUES):
            least = np.minimum.reduceat((s32 ^ _XOR[k]) * _MUL[k], at)
            sig[full, k] = (least * np.uint32(2654435769)) >> np.uint32(16)
    return sig, count


def _sign(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches):
        sig, count = signatures(column(b, "text"), shingle)
        raw = sig.view(f"V{VALUES * 2}").ravel()
        value = pa.array([x.tobytes() if c else None for x, c in zip(raw, count)], pa.binary())
        nid = hashes(value.fill_null(b"")).view(np.int64)
        yield pa.record_batch([column(b, "doc_id"), column(b, "thash"), column(b, "rid"), pa.array(nid, mask=count == 0), value], names=["doc_id", "thash", "rid", "nid", "sig"])


def _verify(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(column(b, c).to_pylist()), np.uint16).reshape(-1, VALUES) for c in ("sa", "sb"))
            ok = pa.array((x == y).sum(1) >= least)
            yield pa.record_batch([column(b, "a").filter(ok), column(b, "b").filter(ok)], names=["a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    a = nodes.select(F.col("nid").alias("a"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("nid").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(lambda it: _verify(it, int(np.ceil(threshold * VALUES))), "a long, b long")


def _pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _keys(batches: Iterable[pa.RecordBatch], depth: int, number: int) -> Iterator[pa.RecordBatch]:
    of = orders(depth, number)
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(column(b, "sig").to_pylist()), np.uint16).reshape(-1, VALUES).astype(np.uint64)
            key = np.tile(mix(np.arange(1, number + 1, dtype=np.uint64)), (len(sig), 1))
            for k in range(depth):
                key = mix(key * M1 + sig[:, of[:, k]])
            flat = pa.array(key.view(np.int64).ravel())
            yield pa.record_batch([column(b, "nid"), pa.ListArray.from_arrays(np.arange(len(sig) + 1, dtype=np.int32) * number, flat)], names=["nid", "keys"])


def regions(nodes: DataFrame, depth: int, number: int) -> DataFrame:
    """``key, nid, n, head`` of the rows of regions of two rows and more: size and first row of the region."""
    rows = written(nodes.select("nid", "sig").mapInArrow(lambda it: _keys(it, depth, number), "nid long, keys array<long>"), "keys")
    rows = rows.select("nid", F.explode("keys").alias("key"))
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("head")).filter("n > 1"), "sizes")
    return written(rows.join(sizes, "key"), "regions")


def alike(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the signatures of ``x`` and ``y`` that have ``least`` values or more in common."""
    yt, found = np.ascontiguousarray(y.T), []
    for i in range(0, len(x), TILE):
        xt = np.ascontiguousarray(x[i : i + TILE].T)
        same = np.zeros((xt.shape[1], len(y)), np.uint8)
        for a, b in zip(xt, yt):
            same += a[:, None] == b
        p, q = np.nonzero(same >= least)
        found.append((p + i, q))
    return tuple(np.concatenate(k) for k in zip(*found))


def _blocks(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            x, y, sx, sy = (column(batch, c)[k].values for c in ("x", "y", "sx", "sy"))
            sx, sy = (np.frombuffer(b"".join(s.to_pylist()), np.uint16).reshape(-1, VALUES) for s in (sx, sy))
            p, q = alike(sx, sy, least)
            x, y = x.to_numpy()[p], y.to_numpy()[q]
            own = x != y
            yield pa.record_batch([pa.array(np.minimum(x, y)[own]), pa.array(np.maximum(x, y)[own])], names=["a", "b"])


def _blocked(rows: DataFrame, nodes: DataFrame, name: str, size: str) -> DataFrame:
    """Rows ``(key, nid)`` with their signatures, about ``BLOCK`` of a region's ``size`` to a list."""
    rows = rows.withColumn("of", F.pmod(F.xxhash64("nid", F.lit(name)), F.ceil(F.col(size) / BLOCK)))
    pair = F.collect_list(F.struct("nid", "sig"))
    return rows.join(nodes, "nid").groupBy("key", F.col("of").alias(f"i{name}")).agg(pair.alias("p")).select("key", f"i{name}", F.col("p.nid").alias(name), F.col("p.sig").alias(f"s{name}"))


def against_all(failed: DataFrame, members: DataFrame, settled: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs of each failed row with all rows of its region, for the regions ``settled``; work is spread by pairs of blocks."""
    x = written(_blocked(failed.join(settled, "key"), nodes, "x", "f"), "failed")
    y = written(_blocked(members.join(settled.select("key"), "key"), nodes, "y", "n"), "members")
    both = x.select("key", "ix").join(y.select("key", "iy"), "key")
    both = both.join(x, ["key", "ix"]).join(y, ["key", "iy"]).select("x", "sx", "y", "sy")
    return written(both.mapInArrow(lambda it: _blocks(it, int(np.ceil(threshold * VALUES))), "a long, b long").distinct(), "edges")


def similar(nodes: DataFrame, threshold: float = THRESHOLD, work: int = WORK) -> DataFrame:
    """Verified pairs ``(a, b)`` of nodes (``nid, sig``) that connect all similar ones of each region."""
    out, at = None, nodes
    for level, (depth, number) in enumerate(LEVELS):
        found = regions(at, depth, number)
        small, large = found.filter(f"n <= {REGION}"), found.filter(f"n > {REGION} and nid <> head")
        ids = small.groupBy("key").agg(F.collect_list("nid").alias("ids"))
        pairs = ids.select(F.posexplode("ids").alias("i", "x"), "ids").select("x", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("y")).select(*_pair(F.col("x"), F.col("y")))
        pairs = pairs.union(large.select(*_pair(F.col("nid"), F.col("head")))).distinct()
        edges = written(_verified(pairs, nodes, threshold), "edges")
        out = edges if out is None else out.union(edges)
        failed = written(large.select("key", "nid", "n", *_pair(F.col("nid"), F.col("head"))).join(edges, ["a", "b"], "left_anti").select("key", "nid", "n"), "apart")
        sizes = written(failed.groupBy("key").agg(F.count("*").alias("f"), F.first("n").alias("n")), "left")
        if sizes.isEmpty():
            break
        last = level == len(LEVELS) - 1
        deeper = F.lit(False) if last else F.col("f").cast("double") * F.col("n") > work
        out = out.union(against_all(failed.drop("n"), found.select("key", "nid", "n"), sizes.filter(~deeper).select("key", "f"), nodes, threshold))
        crowded = sizes.filter(deeper).select("key")
        if last or crowded.isEmpty():
            break
        at = written(nodes.join(found.join(crowded, "key").select("nid").distinct(), "nid"), "deeper")
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label (least node) of each node of an edge table ``(a, b)``: alternating large and small stars.

    Rounds grow with the logarithm of the longest chain; each one's table is written and the one
    before it removed, so lineage and disk stay bounded. ``rounds`` only stops a fault from looping.
    """
    spark, before, path = edges.sparkSession, None, None

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        m = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        if large:
            return both.filter("v > u").join(m, "u").select(*_pair(F.col("v"), F.col("m"))).filter("a <> b").distinct()
        own = m.select(*_pair(F.col("u"), F.col("m")))
        return both.join(m, "u").select(*_pair(F.col("v"), F.col("m"))).union(own).filter("a <> b").distinct()

    for _ in range(rounds):
        old, path = path, new_dir(spark, "stars")
        star(star(edges, True), False).write.parquet(path)
        edges = spark.read.schema("a long, b long").parquet(path)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if old:
            remove(old)
        if now == before:
            return edges.groupBy(F.col("b").alias("nid")).agg(F.min("a").alias("label"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, thash, group_id, group_size, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    ``thash`` is Spark's ``xxhash64(text)``, which tells rows of one ``doc_id`` apart.
    """
    ship(docs.sparkSession)
    rows = need(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("thash"), F.monotonically_increasing_id().alias("rid"), "text")
    signed = written(rows.mapInArrow(lambda it: _sign(it, shingle), f"doc_id {kind(docs, 'doc_id')}, thash long, rid long, nid long, sig binary"), "signed")
    some = signed.filter("nid is not null")
    nodes = written(some.groupBy("nid").agg(F.first("sig").alias("sig")), "nodes")
    labels = components(written(similar(nodes, threshold), "pairs"))
    named = written(some.drop("sig").join(labels, "nid", "left").select("doc_id", "thash", "rid", F.coalesce("label", "nid").alias("label")), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash", "rid"))
    groups = named.groupBy("label").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"), first.alias("first"))
    single, several = groups.filter("group_size = 1"), written(groups.filter("group_size > 1"), "groups")
    named = named.join(several, "label").select("doc_id", "thash", "group_id", "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"))
    alone = single.select("first.doc_id", "first.thash").union(signed.filter("nid is null").select("doc_id", "thash"))
    return named.union(alone.select("doc_id", "thash", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with one row of each near-duplicate group; columns as they came.

    The kept keys are joined to the documents. Only where identical rows repeat do these few rows
    take a de-duplication of their own.
    """
    own = docs.columns
    key = fresh(docs, "h")
    groups = written(near_duplicates(docs, threshold).select(F.col("doc_id").alias("i"), F.col("thash").alias("h"), "kept"), "kept")
    keys = written(groups.groupBy("i", "h").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).filter("kept").select("i", "h", "n"), "keys")

    def of(some: DataFrame) -> DataFrame:
        same = docs["doc_id"].eqNullSafe(some["i"]) & (F.xxhash64(docs["text"]) == some["h"])
        return docs.join(some.select("i", "h"), same, "left_semi")

    out, repeated = of(keys.filter("n = 1")), keys.filter("n > 1")
    if repeated.isEmpty():
        return out
    twice = of(repeated).withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key])
    return out.union(twice.select(*(F.col(f"`{c}`") for c in own)))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("thash")
