"""Near-duplicates and benchmark passages, against comparison of all with all."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import decontam, near_dup
from lexloom.llm.common import plain_words

from .conftest import prose


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"new{rng.randrange(999)}" if rng.random() < share else w for w in text.split())


def shingle_set(text: str, n: int = near_dup.SHINGLE) -> set:
    w = ["".join(c for c in x.lower() if c.isalnum()) for x in text.split()]
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(40, 200)) for _ in range(120)]
    for i in range(60):
        texts.append(edited(rng, texts[i], 0.03 if i % 2 else 0.08))
    return texts + [texts[0]] * 70  # a region too large for any depth


def test_recall_against_all_pairs(spark, documents, corpus):
    sets = [shingle_set(t) for t in corpus]
    want = {(i, j) for i in range(len(corpus)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(documents(corpus)).collect()}
    found = {p for p in want if got[p[0]] == got[p[1]]}
    assert len(found) >= 0.9 * len(want) > 0
    apart = {(i, j) for i in range(120) for j in range(i)}
    assert not any(got[i] == got[j] for i, j in apart)


def test_one_of_each_group_stays(spark, documents, corpus):
    docs = documents(corpus)
    rows = near_dup.near_duplicates(docs).collect()
    kept = {r.doc_id for r in near_dup.one_of_each(docs).collect()}
    assert kept == {r.doc_id for r in rows if r.kept} and len({r.group_id for r in rows}) == len(kept)
    assert all(r.group_id == r.doc_id for r in rows if r.kept)


def test_groups_of_odd_rows(spark, odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == 9
    assert [(r.group_id, r.group_size) for r in rows if r.doc_id == 5] == [(5, 2), (5, 2)]
    assert sorted(r.kept for r in rows if r.doc_id == 5) == [False, True]
    assert all(r.kept and r.group_size == 1 for r in rows if r.doc_id != 5)
    out = near_dup.one_of_each(odd)
    assert out.columns == odd.columns and out.count() == 8
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0 and near_dup.one_of_each(odd.limit(0)).count() == 0


def test_components_by_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.nid: r.label for r in near_dup.components(spark.createDataFrame([(min(e), max(e)) for e in edges if e[0] != e[1]], "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("work", [near_dup.WORK, 20_000])
def test_crowded_regions_lose_no_pair(spark, work):
    """Half of all values are common to the corpus, so that regions are large; with little work allowed for one, rows go deeper."""
    rng, n = np.random.default_rng(2), 1500
    sig = rng.integers(0, 1 << 16, (n, near_dup.VALUES), dtype=np.uint16)
    common = rng.integers(0, 1 << 16, near_dup.VALUES, dtype=np.uint16)
    sig = np.where(rng.random(sig.shape) < 0.5, common, sig)
    for i in range(150):  # pairs of 0.55 to 0.7
        keep = rng.random(near_dup.VALUES) < 0.2 + 0.35 * i / 150
        sig[i + 150] = np.where(keep, sig[i], np.where(sig[i] == common, common, sig[i + 150]))
    least = int(np.ceil(near_dup.THRESHOLD * near_dup.VALUES))
    same = np.zeros((n, n), int)
    for k in range(near_dup.VALUES):
        same += sig[:, k, None] == sig[:, k]
    near = {(i, j) for i, j in zip(*np.nonzero(same >= least)) if i < j}
    label = {r.nid: r.label for r in near_dup.components(near_dup.similar(nodes_of(spark, sig), work=work)).collect()}
    found = {(i, j) for i, j in near if label.get(i, i) == label.get(j, j)}
    assert len(near) > 100 and len(found) >= 0.98 * len(near)
    assert not any(i in label for i in range(300, n)) and not set(label.values()) & set(range(300, n))


def nodes_of(spark, sig):
    return spark.createDataFrame(pa.table({"nid": np.arange(len(sig)), "sig": pa.array([x.tobytes() for x in sig], pa.binary())}))


def test_hot_prefix_of_rows_unlike_each_other(spark, monkeypatch):
    """50,000 rows share the first two values; half of them are copies of the first row, a few of the others have a copy of their own."""
    rng, n = np.random.default_rng(3), 50_000
    sig = rng.integers(0, 1 << 16, (n, near_dup.VALUES), dtype=np.uint16)
    sig[: n // 2] = np.where(rng.random((n // 2, near_dup.VALUES)) < 0.85, sig[0], sig[: n // 2])
    for i in range(n - 100, n):
        sig[i] = np.where(rng.random(near_dup.VALUES) < 0.7, sig[i - 200], sig[i])
    sig[:, :2] = sig[0, :2]
    work = []

    def counted(failed, members, settled, *rest, real=near_dup.against_all):
        sizes = members.groupBy("key").count()
        work.append(settled.join(sizes, "key").selectExpr("coalesce(sum(f * count), 0)").first()[0])
        return real(failed, members, settled, *rest)

    monkeypatch.setattr(near_dup, "against_all", counted)
    label = {r.nid: r.label for r in near_dup.components(near_dup.similar(nodes_of(spark, sig))).collect()}
    assert sum(work) < 1 << 27
    assert sum(label.get(i) == 0 for i in range(1, n // 2)) >= 0.999 * (n // 2 - 1)
    assert sum(label.get(i) == i - 200 for i in range(n - 100, n)) >= 99 and len(label) <= n // 2 + 200


def test_identical_rows_and_any_names(spark, documents):
    """Extra columns may be called as the operator's own; ids may be strings."""
    from pyspark.sql import functions as F

    docs = documents([(1, "the same row here")] * 3 + [(2, "another text of its own")])
    for name in ("__h", "h", "H_", "__id", "kept"):
        docs = docs.withColumn(name, F.lit("a long value of the user's own"))
    docs = docs.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id"))
    out = near_dup.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == ["id-1", "id-2"]
    assert {r.h for r in out.collect()} == {"a long value of the user's own"}
    assert sorted((r.group_id, r.kept) for r in near_dup.near_duplicates(docs).collect()) == [("id-1", False), ("id-1", False), ("id-1", True), ("id-2", True)]


def test_signature_estimates_similarity():
    rng = random.Random(1)
    a = prose(rng, 400)
    b = edited(rng, a, 0.05)
    sig, _ = near_dup.signatures(pa.array([a, b]))
    x, y = shingle_set(a), shingle_set(b)
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.12


# benchmark


def grams(text: str, n: int) -> Counter:
    w = ["".join(c for c in x.lower() if c.isalnum()) for x in text.split()]
    w = [x for x in w if x]
    if len(w) < n:
        return Counter({tuple(w): 1}) if w else Counter()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def alike(a: Counter, b: Counter) -> float:
    size = lambda g: sum(map(len, g))
    both = sum(min(k, b[g]) * size(g) for g, k in a.items())
    return both / (sum(k * size(g) for g, k in a.items()) + sum(k * size(g) for g, k in b.items()) - both)


def brute(docs: list[str], items: list[str], threshold: float, n: int = 3) -> dict:
    """Exact similarity of every item-sized window of every document with every item."""
    out = {}
    for d, text in enumerate(docs):
        w = [x for x in text.split() if any(c.isalnum() for c in x)]
        for k, item in enumerate(items):
            bag = grams(item, n)
            m = sum(any(c.isalnum() for c in x) for x in item.split())
            best = max((alike(grams(" ".join(w[i : i + m]), n), bag) for i in range(max(1, len(w) - m + 1))), default=0) if bag and w else 0
            if best >= threshold:
                out[d, k] = best
    return out


def test_every_window_is_found(spark, documents):
    rng = random.Random(11)
    items = [prose(rng, rng.randrange(15, 45)) for _ in range(12)] + ["two words", "", None]
    docs = [prose(rng, 120) for _ in range(30)]
    for i in range(20):
        w = docs[i].split()
        w[30:30] = edited(rng, items[i % 12], (0, 0.03, 0.06)[i % 3]).split()
        docs[i] = " ".join(w)
    docs += ["two words", "two  Words!"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(documents(docs), bench).collect()}
    want = brute(docs, [x or "" for x in items], decontam.THRESHOLD)
    assert set(got) <= set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    far = {k for k in want if k not in got}
    assert len(far) <= 0.02 * len(want), (far, len(want))
    parts = decontam.contaminated(documents(docs), bench, chunk_bytes=300)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == set(got)


@pytest.mark.parametrize("radius", [12, 88, 120])
def test_hamming_blocks_find_all_within_the_radius(radius):
    rng = np.random.default_rng(2)
    index = decontam.Index(list(range(40)), [prose(random.Random(i), 20 + i % 2) for i in range(40)], radius, 3)
    query = index.prints.copy()
    for row, k in zip(query, rng.integers(0, radius * 2, 40)):
        for b in rng.choice(256, int(k), replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    apart = np.bitwise_count(query[:, None] ^ index.prints).sum(2, dtype=int)
    want = {(i, j) for i in range(40) for j in range(40) if index.size[j] == 20 and apart[i, j] <= radius}
    assert {(int(a), int(b)) for a, b in zip(*index.near(query, 20))} == want and want
    assert not len(index.near(query, 999)[0]) and not len(index.near(query[:0], 20)[0])


def test_the_index_selects():
    """At 20,000 items, hardly any window is compared with an item that it has nothing to do with."""
    rng = random.Random(21)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(rng.randrange(20, 40))) for _ in range(20_000)]
    index = decontam.Index(list(range(len(texts))), texts)
    other = decontam.Index(list(range(300)), [" ".join(f"w{rng.randrange(50_000)}" for _ in range(25)) for _ in range(300)])
    found = index.near(other.prints, 25)
    assert not len(found[0]) and index.compared < 0.01 * 300 * len(index.of_size[25])
    assert index.similarity(7, index.bag[index.bags[7] : index.bags[8]].repeat(index.count[index.bags[7] : index.bags[8]]), int(index.total[7])) == 1


def test_clean_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "the same row here"), (2, None), (None, "word5 word6 word7 word8 word9")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(5, 1), (6, None)}
    out = decontam.clean(odd, bench)
    assert out.columns == odd.columns and out.count() == 6
    assert decontam.clean(odd, bench.limit(0)).count() == 9 and decontam.clean(odd.limit(0), bench).count() == 0


def test_clean_keeps_clean_rows_of_shared_and_null_ids(spark, documents):
    bench = spark.createDataFrame([(1, "the same row here")], "item_id long, text string")
    leak, fine = "the same row here", "quite another text of its own"
    docs = documents([(None, leak), (None, fine), (7, leak), (7, fine), (8, leak), (9, None)])
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(docs, bench).collect()) == [(0, fine), (7, fine), (9, "")]


def test_plain_words():
    h, offsets, _ = plain_words(pa.array(["A, b.", None, "a"]))
    assert offsets.tolist() == [0, 2, 2, 3] and h[0] == h[2]
