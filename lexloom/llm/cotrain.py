"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees the words: hashed word frequencies and shares of symbols, digits, capitals,
distinct, most frequent and doubled words. The metadata view sees what is known of a page beside its words: language,
source, stated length and layout in lines. Each view has a logistic regression. In every round each
scores all unlabelled documents, and those that it is most sure of go to the *other* view's training rows, a
class no faster than its share among the labelled ones, and each language and source by its own share. Both are calibrated on held-out labelled rows
(Platt). Their combination, which scores all documents, is fitted on held-out rows that the views' calibration hasn't seen.

The rows that are fitted are bounded: at most ``LABELLED`` labelled documents, those first by a hash of ``doc_id``, at most ``COPIES``
times as many distinct rows of them, and
``POOL`` labelled by the views, beside ``LEAST`` a round of each class, language and source. Features of all
rows are written once and every round scores them all; the scores of sure rows alone go through an exchange.
Scoring covers every row and the whole text, in one pass without an exchange.

Defined results: a null text or one without a word has score 0 and isn't kept; null metadata is a value of its own;
a document whose labels disagree takes the majority, of equal numbers the lower; without labels of both
kinds nothing is fitted, scores are null and all rows with a word are kept. Repeated rows score alike and are fitted once. Rows without a ``doc_id``
have no label; ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_dir, remove, ship
from .common import column, hashes, kind, need, segment_sum, sub_batches, words

LABELLED, COPIES, POOL, LEAST, ROUNDS, SURE, KEEP, BUCKETS = 8000, 2, 8000, 2, 4, 0.95, 0.3, 256
META = ("lang", "source", "n_chars")
LANGS, SOURCES, LENGTHS = 16, 64, 16


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text by its words, and its number of words."""
    codes, offsets, distinct = words(texts)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    length = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.float64)
    of = lambda pattern: length - pc.utf8_length(pc.replace_substring_regex(distinct, pattern, "")).to_numpy(zero_copy_only=False)
    symbols, digits, capitals = of(r"[^\p{L}\p{N}]+"), of(r"\p{N}+"), of(r"\p{Lu}+")
    chars = segment_sum(length[codes], offsets)
    share = [segment_sum(x[codes], offsets) / (chars + 40) for x in (symbols, digits, capitals)]
    key, count = np.unique(row * max(1, len(distinct)) + codes, return_counts=True)
    own = np.bincount(key // max(1, len(distinct)), minlength=len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, key // max(1, len(distinct)), count)
    twice = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=len(n)) if len(codes) > 1 else np.zeros(len(n))
    ragged = pc.match_substring_regex(distinct, r"[\p{L}\p{N}][^\p{L}\p{N}\s]{2,}$|^[^\p{L}\p{N}]+$").to_numpy(zero_copy_only=False)
    shape = [*share, (chars + 100) / (n + 20), np.log(own + 1) / np.log(n + 2), most / (n + 10), twice / (n + 10), segment_sum(ragged[codes].astype(np.float64), offsets) / (n + 10)]
    bucket = (hashes(distinct) % np.uint64(BUCKETS)).astype(np.int64)
    bag = np.bincount(row * BUCKETS + bucket[codes], minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    return np.column_stack([np.ones(len(n)), *shape, *(x**2 for x in shape), np.sqrt(bag / (n[:, None] + 10))]).astype(np.float32), n


def one_hot(values: list, buckets: int) -> np.ndarray:
    return np.eye(buckets + 1)[bucket_of(values, buckets)]


def bucket_of(values: list, buckets: int) -> np.ndarray:
    """Hashed, null in a bucket of its own."""
    return np.array([buckets if v is None else xxhash.xxh64_intdigest(str(v)) % buckets for v in values], int)


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    """Features of each row beside its words."""
    text = pc.fill_null(column(batch, "text"), "")
    lines = pc.add(pc.count_substring(text, "\n"), 1).to_numpy(zero_copy_only=False).astype(np.float64)
    blank = pc.count_substring_regex(text, r"\n[ \t]*\n").to_numpy(zero_copy_only=False)
    stated = np.array([-1 if v is None else v for v in column(batch, "n_chars").to_pylist()], np.float64)
    log = np.log1p(np.maximum(stated, 0))
    per_line = np.log1p(np.maximum(stated, 0) / lines)
    length = np.eye(LENGTHS + 1)[np.where(stated < 0, LENGTHS, np.minimum(log * 1.4, LENGTHS - 1)).astype(int)]
    return np.column_stack([np.ones(len(lines)), log, log**2, np.log(lines), np.log(lines) ** 2, per_line, per_line**2, log * per_line, blank / lines, length, one_hot(column(batch, "lang").to_pylist(), LANGS), one_hot(column(batch, "source").to_pylist(), SOURCES)]).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 12, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; column 0 is the constant and isn't shrunk."""
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    b = np.zeros(x.shape[1]) if start is None else start.copy()
    loss = lambda b, z: float((w * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2)
    z = x @ b
    now = loss(b, z)
    for _ in range(steps):
        p = sigmoid(z)
        g = x.T @ (w * (p - y)) + penalty * b
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-4 and (new := loss(b - size * step, z1 := x @ (b - size * step))) > now:
            size /= 2
        if size <= 1e-4:
            break
        b, z, gain, now = b - size * step, z1, now - new, new
        if gain < 1e-6 * len(y):
            break
    return b


class View:
    """A logistic regression over scaled columns and its Platt calibration."""

    def __init__(self, sums: np.ndarray):
        """From the number of rows and the sums and sums of squares of their columns, in a row."""
        n, (total, square) = sums[0], sums[1:].reshape(2, -1)
        self.mean = total / n
        self.scale = np.maximum(np.sqrt(np.maximum(square / n - self.mean**2, 0)), 1e-3)
        self.mean[0], self.scale[0] = 0, 1
        self.b, self.platt = np.zeros(len(total)), np.array([0.0, 1.0])

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> None:
        """From the weights of the round before, which are near."""
        self.b = logistic((x - self.mean) / self.scale, y, w, start=self.b)
        self.platt = np.array([0.0, 1.0])
        self.platt = calibrate(self.logit(held_x)[:, None], held_y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.platt[0] + self.platt[1] * (((x - self.mean) / self.scale) @ self.b)


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and slopes; targets are drawn in a little (Platt), so that separable rows stay finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    return logistic(np.column_stack([np.ones(len(z)), np.clip(z, -20, 20)]), t, np.ones(len(y)), 1e-3, 40)


class Model:
    def __init__(self, text: View, meta: View, combine: np.ndarray):
        self.text, self.meta, self.combine = text, meta, combine

    def scores(self, tx: np.ndarray, mx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.clip(self.text.logit(tx), -20, 20), np.clip(self.meta.logit(mx), -20, 20)
        return sigmoid(a), sigmoid(b), sigmoid(self.combine[0] + self.combine[1] * a + self.combine[2] * b)


def sums(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])


def exchange(views: tuple, y: np.ndarray, held: tuple, hy: np.ndarray, fit: list[View], choose: Callable, rounds: int) -> Model:
    """Fit on the labelled rows of ``views`` and, round by round, on what each view gives the other.

    ``choose(fit, given)`` yields ``k, key, label, x``: a row that view ``k`` labels, with its features in the other view;
    ``given[k]`` holds what view ``k`` got so far, by key.
    """
    given, whole = ({}, {}), range(len(hy))
    one, two = whole[::2], whole[1::2]  # for the views' calibration and for that of their combination
    if any(len(np.unique(hy[part])) < 2 for part in (one, two)):
        one = two = whole
    for r in range(rounds + 1):
        for k, x in enumerate(views):
            more = [given[k][i] for i in sorted(given[k])]
            rows = np.concatenate([x, np.array([f for _, f in more], x.dtype).reshape(-1, x.shape[1])])
            labels = np.concatenate([y, [label for label, _ in more]]).astype(float)
            fit[k].fit(rows, labels, np.concatenate([np.ones(len(y)), np.full(len(more), 0.5)]), held[k][one], hy[one])
        if r < rounds:
            for k, key, label, f in list(choose(fit, given)):
                given[1 - k][key] = label, f
    z = np.column_stack([np.clip(v.logit(x[two]), -20, 20) for v, x in zip(fit, held)])
    return Model(*fit, calibrate(z, hy[two]))


def co_train(tx: np.ndarray, mx: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """In memory. ``y``: 1, 0, or -1 for the pool; ``held``: labelled rows for calibration alone."""
    train, pool = np.flatnonzero((y >= 0) & ~held), np.flatnonzero(y < 0)
    views, share = (tx, mx), y[train].mean()

    def choose(fit: list[View], given: tuple) -> Iterator[tuple]:
        for k, x in enumerate(views if len(pool) else ()):
            p = sigmoid(fit[k].logit(x[pool]))
            most = max(2, len(pool) // (2 * rounds))
            for label, q, part in ((1, p, share), (0, 1 - p, 1 - share)):
                new = [i for i in np.argsort(-q, kind="stable") if q[i] >= sure and pool[i] not in given[1 - k]]
                yield from ((k, int(pool[i]), label, views[1 - k][pool[i]]) for i in new[: max(1, round(most * part))])

    return exchange(tuple(x[train] for x in views), y[train], tuple(x[held] for x in views), y[held].astype(float), [View(sums(x[~held])) for x in views], choose, rounds)


def _arrays(batch: pa.RecordBatch | pa.Table, names: tuple = ("tx", "mx")) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch[c].to_pylist()), np.float32).reshape(batch.num_rows, -1) for c in names]


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each view; one record a task."""
    total = None
    for b in batches:
        if b.num_rows:
            new = [sums(x) for x in _arrays(b)]
            total = new if total is None else [a + c for a, c in zip(total, new)]
    if total:
        yield pa.record_batch([pa.array([x.tobytes()]) for x in total], names=["tx", "mx"])


def _sure(batches: Iterable[pa.RecordBatch], fit: list[View], given: list[np.ndarray], sure: float) -> Iterator[pa.RecordBatch]:
    """Rows that a view is sure of and hasn't yet given to the other."""
    for b in batches:
        if not b.num_rows:
            continue
        key, stratum = (column(b, c).to_numpy() for c in ("key", "stratum"))
        for k, x in enumerate(_arrays(b)):
            p = sigmoid(fit[k].logit(x))
            new = ~np.isin(key, given[1 - k])
            for label, q in ((1, p), (0, 1 - p)):
                at = np.flatnonzero((q >= sure) & new)
                yield pa.record_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(stratum[at]), pa.array(key[at]), pa.array(q[at])], names=["view", "label", "stratum", "key", "q"])


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sub_batches(batches):
        tx, n = text_view(column(b, "text"))
        mx = meta_view(b)
        stratum = bucket_of(column(b, "lang").to_pylist(), LANGS) * (SOURCES + 1) + bucket_of(column(b, "source").to_pylist(), SOURCES)
        tx, mx = ([v.tobytes() for v in x] for x in (tx, mx))
        key = np.array([hash_key(*k) for k in zip(column(b, "doc_id").to_pylist(), tx, mx)], np.uint64).view(np.int64)
        made = pa.record_batch([pa.array(key), pa.array(stratum.astype(np.int32)), column(b, "y"), pa.array(tx, pa.binary()), pa.array(mx, pa.binary())], names=["key", "stratum", "y", "tx", "mx"])
        yield made.filter(pa.array(n > 0))


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """The model from a bounded sample of the labels and all unlabelled rows; None if the labels don't hold both kinds."""
    spark = ship(docs.sparkSession)
    given = need(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("y"))
    # ``labelled`` rows at most, so this side of the join may be sent to all tasks
    some = given.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(labelled)
    rows = need(docs, "doc_id", "text", *META).join(F.broadcast(some), "doc_id", "left")
    schema, path = "key long, stratum int, y int, tx binary, mx binary", new_dir(spark, "features")
    rows.select("doc_id", "text", *META, "y").mapInArrow(_features, schema).write.parquet(path)
    try:
        return _fitted(spark.read.schema(schema).parquet(path), labelled * COPIES, pool, rounds, sure)
    finally:
        remove(path)


def _fitted(features: DataFrame, most: int, pool: int, rounds: int, sure: float) -> Model | None:
    # a ``doc_id`` may have any number of rows: no more than ``most`` of them come here
    got = features.filter("y is not null").dropDuplicates(["key"]).orderBy(F.xxhash64("key")).limit(most).toArrow()
    order = np.argsort(got["key"].to_numpy().view(np.uint64), kind="stable")
    y = got["y"].to_numpy()[order]
    held = np.arange(len(y)) % 10 < 3
    if any(len(np.unique(y[part])) < 2 for part in (held, ~held)):
        return None
    views = [x[order] for x in _arrays(got)]
    rest = features.filter("y is null")
    size = {r.stratum: r.n for r in rest.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    n, parts = sum(size.values()), rest.select("tx", "mx").mapInArrow(_sums, "tx binary, mx binary").toArrow()
    total = [sum((np.frombuffer(x, np.float64) for x in sorted(parts[c].to_pylist())), sums(v[~held])) for c, v in zip(("tx", "mx"), views)]
    share, most = y[~held].mean(), max(2, min(n, pool) // (2 * rounds)) if rounds else 0
    quota = [(s, label, max(LEAST, round(most * part * k / n))) for s, k in size.items() for label, part in ((1, float(share)), (0, 1 - float(share)))]
    spark = features.sparkSession

    def choose(fit: list[View], given: tuple) -> Iterator[tuple]:
        if not n:
            return
        sent = spark.sparkContext.broadcast((fit, [np.array(list(g), np.int64) for g in given]))
        found = rest.select("key", "stratum", "tx", "mx").mapInArrow(lambda it: _sure(it, *sent.value, sure), "view int, label int, stratum int, key long, q double")
        # copies have one key and one rank
        best = F.dense_rank().over(Window.partitionBy("view", "label", "stratum").orderBy(F.desc("q"), "key"))
        ranked = found.withColumn("rank", best).filter(f"rank <= {max(q for *_, q in quota)}")
        few = ranked.join(F.broadcast(spark.createDataFrame(quota, "stratum int, label int, quota int")), ["stratum", "label"]).filter("rank <= quota")
        few = few.select("view", "label", "key").distinct()
        other = F.when(F.col("view") == 0, F.col("mx")).otherwise(F.col("tx")).alias("x")
        new = rest.join(F.broadcast(few), "key").select("view", "label", "key", other).dropDuplicates(["view", "key"]).toArrow()
        for k, label, key, x in zip(*(new[c].to_pylist() for c in ("view", "label", "key", "x"))):
            yield k, key, label, np.frombuffer(x, np.float32)

    return exchange(tuple(v[~held] for v in views), y[~held], tuple(v[held] for v in views), y[held].astype(float), [View(t) for t in total], choose, rounds)


def hash_key(doc_id: object, tx: bytes, mx: bytes) -> int:
    """An order of the rows that doesn't depend on how they were read."""
    return xxhash.xxh64_intdigest(tx + mx, xxhash.xxh64_intdigest(repr(doc_id)))


def _score(batches: Iterable[pa.RecordBatch], model: Model | None, keep: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple, np.ndarray]]:
    """Sub-batch, rows with words, scores and decisions."""
    for b in sub_batches(batches):
        tx, n = text_view(column(b, "text"))
        if model is None:
            yield b, n > 0, (None, None, None), n > 0
        else:
            s = model.scores(tx, meta_view(b))
            s = tuple(np.where(n > 0, x, 0) for x in s)
            yield b, n > 0, s, (n > 0) & (s[2] >= keep)


def _table(batches: Iterable[pa.RecordBatch], model: Model | None, keep: float) -> Iterator[pa.RecordBatch]:
    for b, _, s, ok in _score(batches, model, keep):
        yield pa.record_batch([column(b, "doc_id"), *(pa.nulls(b.num_rows, pa.float64()) if x is None else pa.array(x.astype(np.float64)) for x in s), pa.array(ok)], names=["doc_id", "text_score", "meta_score", "score", "keep"])


def _filter(batches: Iterable[pa.RecordBatch], model: Model | None, keep: float, at: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            own = pa.record_batch([b.column(i) for i in at], names=["text", *META])
            yield b.filter(pa.array(np.concatenate([ok for *_, ok in _score([own], model, keep)])))


def scored(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``doc_id, text_score, meta_score, score, keep`` of every row of ``docs``."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    return need(docs, "doc_id", "text", *META).mapInArrow(lambda it: _table(it, sent.value, keep), f"doc_id {kind(docs, 'doc_id')}, text_score double, meta_score double, score double, keep boolean")


def kept(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, all columns as they came; one pass, no join."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    need(docs, "text", *META)
    at = [docs.columns.index(c) for c in ("text", *META)]
    return docs.mapInArrow(lambda it: _filter(it, sent.value, keep, at), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
