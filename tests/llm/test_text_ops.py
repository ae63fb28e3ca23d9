"""Lattice scores, byte-level BPE, language profiles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import bpe, langid, lattice

from .conftest import WORDS, prose


def brute(word: str, lat: lattice.Lattice) -> float:
    """Sum over every segmentation, listed one by one."""

    def all_of(rest: str):
        if not rest:
            yield 0.0
        for k in range(1, len(rest) + 1):
            s = lat.score.get(rest[:k]) if k > 1 or rest[:1] in lat.score else lat.char(rest[:1])
            if s is not None:
                for x in all_of(rest[k:]):
                    yield s + x

    xs = list(all_of(word))
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


@pytest.fixture(scope="module")
def small():
    pieces = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "ba", "▁a", "aba", "▁ab"])}
    scores = np.log(np.linspace(1, 2, len(pieces) + 256) / 500)
    return lattice.Lattice(pieces, {b: len(pieces) + b for b in range(256)}, scores)


@pytest.mark.parametrize("word", ["▁", "▁a", "▁abab", "▁abba", "▁aébc", "▁bbbbaba"])
def test_lattice_is_the_sum_over_segmentations(small, word):
    assert small.one(word) == pytest.approx(brute(word, small), abs=1e-9)
    assert small.many([word, "▁ab", word])[0] == pytest.approx(small.one(word), abs=1e-9)


def test_lattice_of_long_words_agrees(small):
    w = "▁" + "ab" * 200
    assert small.many([w])[0] == pytest.approx(small.one(w), abs=1e-6)


def test_score_counts_the_whole_corpus(spark, documents):
    docs = documents(["river river stone", "stone", None, ""])
    got = {r.doc_id: r for r in lattice.score(docs).collect()}
    model = lattice.model_bytes(lattice.VOCABULARY)
    ordinary, of_byte, _ = lattice.pieces(model)
    p = lattice.processor(model)
    counts = np.zeros(p.vocab_size())
    for w in "river river stone stone".split():
        for i in p.encode(w):
            counts[i] += 1
    scores, used = np.full(len(counts), -np.inf), [*ordinary.values(), *of_byte.values()]
    scores[used] = np.log(counts[used] + 0.5) - np.log(counts[used].sum() + 0.5 * len(used))
    lat = lattice.Lattice(ordinary, of_byte, scores)
    assert got[0].log_prob == pytest.approx(2 * lat.one("▁river") + lat.one("▁stone"), abs=1e-6)
    assert got[2].log_prob is None and got[2].n_words is None
    assert (got[3].log_prob, got[3].n_words, got[3].bits_per_char) == (0.0, 0, None)


def unigram_file(pieces: dict[str, float]) -> bytes:
    """A model file with log probabilities, written field by field: pieces, then the kind of model, then its normal form."""
    import struct

    field = lambda n, body: bytes([n << 3 | 2]) + (bytes([len(body)]) if len(body) < 128 else bytes([len(body) & 127 | 128, len(body) >> 7])) + body
    piece = lambda t, score, sort: field(1, field(1, t.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, sort]))
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(t, s, 1) for t, s in pieces.items())
    return out + field(2, bytes([0x18, 1, 0x20, len(pieces) + 3])) + field(3, field(1, b"identity"))


def test_scores_of_a_unigram_file(spark, documents, tmp_path):
    """Log probabilities of a file are used as they are."""
    own = {"▁": -2.5, "a": -1.25, "b": -1.5, "ab": -1.75, "▁a": -0.75, "aba": -3.125, "é": -4.5}
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_file(own))
    model = lattice.model_bytes(str(path))
    assert not lattice.ranked(model) and lattice.pieces(model)[0].keys() == own.keys() and lattice.plain(model)
    lat = lattice.Lattice(*lattice.pieces(model))
    got = {r.doc_id: r.log_prob for r in lattice.score(documents(["abab aé", "ba", "zé"]), str(path)).collect()}
    assert got[0] == pytest.approx(brute("▁abab", lat) + brute("▁aé", lat), abs=1e-6)
    assert got[1] == pytest.approx(brute("▁ba", lat), abs=1e-6) and got[2] < -90


def test_score_bears_odd_rows(odd):
    rows = lattice.score(odd).collect()
    assert len(rows) == 9 and len({(r.doc_id, r.log_prob) for r in rows if r.doc_id == 5}) == 1
    assert lattice.score(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


def plain_bpe(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [bytes([b]) for b in token]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=40) | st.text(alphabet="aAbetion ", min_size=1, max_size=40).map(str.encode))
def test_merge_is_plain_bpe(vocabulary, token):
    assert vocabulary.merge(token) == plain_bpe(token, vocabulary.ranks)


@pytest.fixture(scope="module")
def other(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_round_trip_and_another_tokenizer(vocabulary, other, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    ids, offsets = vocabulary.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [other.encode_ordinary(t) for t in texts]
    assert vocabulary.decode(ids, offsets) == [t.encode() for t in texts]


def test_memo_keeps_results_over_its_generations(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    v = bpe.Vocabulary()
    texts = [f"qzx{i % 7}vv wq{i % 5}zz" for i in range(60)]
    first = [v.encode([t])[0].tolist() for t in texts]
    fresh = bpe.Vocabulary()
    assert first == [fresh.encode([t])[0].tolist() for t in texts] and len(v.memo) <= 3


def test_perfect_hash(vocabulary):
    t = vocabulary.table
    assert sorted(t.slot_value.tolist()) == list(range(t.n))
    tokens = list(vocabulary.ranks)
    assert (t.find(bpe.hash_of(tokens, len(tokens))) == np.arange(t.n)).all()
    assert t.find(bpe.hash_of([b"no such token, surely"], 1))[0] == -1
    assert bpe.PerfectHash(np.empty(0, np.uint64)).find(np.array([1], np.uint64))[0] == -1


def test_bpe_tables(spark, odd):
    rows = bpe.encode(odd)
    got = rows.collect()
    assert len(got) == 9 and all(r.round_trip for r in got if r.tokens is not None)
    assert [r.tokens for r in got if r.doc_id == 1] == [None] and [r.tokens for r in got if r.doc_id == 2] == [[]]
    back = {r.doc_id: r.text for r in bpe.decode(rows).collect()}
    assert back == {r.doc_id: r.text for r in odd.select("doc_id", "text").collect()}
    assert bpe.encode(odd.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [36, None, 10**8, -5]), (2, None)], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(bad).collect()} == {1: "E", 2: None}


def test_language_bundles_are_sums_of_bound_letters():
    v = langid.Vectors(64, 3)
    got, n = langid.bundles(pa.array(["Ab c", None, "!?"]), v)
    text = " ab c "
    want = sum(np.roll(v.char(ord(a))[0], 2).astype(int) * np.roll(v.char(ord(b))[0], 1) * v.char(ord(c))[0] for a, b, c in zip(text, text[1:], text[2:]))
    assert (got[0] == want).all() and n.tolist() == [4, 0, 0] and not got[1:].any()


def brute_language(text: str, protos: dict[str, np.ndarray]) -> tuple[str, float]:
    """Bundle by a sum over all places of a text, then the best cosine that is large enough."""
    v = langid.Vectors(len(next(iter(protos.values()))), langid.GRAM)
    plain = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text or "").split()) + " "
    grams = [plain[i : i + 3] for i in range(len(plain) - 2)] if plain.strip() else []
    if not grams:
        return "und", 0.0
    one = lambda g: np.prod([v.char(ord(c))[2 - k].astype(int) for k, c in enumerate(g)], 0)
    sums = sum(one(g) for g in grams).astype(float)
    cos = {k: float(sums @ p / np.linalg.norm(sums) / np.linalg.norm(p)) for k, p in protos.items()}
    best = max(sorted(cos), key=lambda k: round(cos[k], 6))
    return best if cos[best] >= langid.MIN_COSINE * np.sqrt(len(grams) / (len(grams) + langid.HALF)) else "und", cos[best]


def test_decisions_against_brute_force(spark, documents, rng):
    train = documents([(i, prose(rng, 60, la), la, "s") for la in WORDS for i in range(30)])
    protos = langid.prototypes(train, dimension=256)
    protos["zz"] = protos["en"] * 2.0  # of equal cosines the first by name
    texts = [prose(rng, n, la) for la in WORDS for n in (1, 2, 5, 40)] + ["", "!!", "xqzk wvvw jjq", "a", "Ünïcödé", None]
    for r in langid.identify(documents(texts), protos, dimension=256).collect():
        want, cosine = brute_language(texts[r.doc_id], protos)
        assert r.language == want and r.cosine == pytest.approx(cosine, abs=1e-4) and r.language != "zz"


def test_prototypes_take_the_same_jobs_for_any_partitions(spark, documents, rng):
    """A text repeated often is in the sample once, and no job is run for each partition."""
    rows = [(i, prose(rng, 30, la), la, "s") for la in WORDS for i in range(40)]
    docs, found, jobs = documents(rows + [(9, rows[0][1], "en", "s")] * 3000), [], []
    for parts in (3, 60):
        spark.sparkContext.setJobGroup(f"protos{parts}", "")
        found.append(langid.prototypes(docs.repartition(parts), per_language=200))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"protos{parts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 12
    assert all(np.allclose(found[0][k], found[1][k]) for k in WORDS)
    many = langid.prototypes(spark.createDataFrame([(prose(rng, 5), f"x{i}") for i in range(2000)], "text string, lang string"), dimension=64)
    assert len(many) == 2000


def test_languages_of_held_out_texts(spark, documents, rng):
    train = documents([(i, prose(rng, 80, la), la, "s") for i, la in enumerate(list(WORDS) * 30)])
    protos = langid.prototypes(train)
    test = documents([(i, prose(rng, 30, la), la, "s") for i, la in enumerate(list(WORDS) * 20)])
    got = langid.identify(test, protos).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in got) >= 0.95 * len(got)


def test_languages_of_odd_rows(spark, odd, documents):
    protos = langid.prototypes(documents([(1, "the river and the stone", "en", "s"), (2, None, "fr", "s"), (3, "le et la", None, "s")]))
    assert list(protos) == ["en"]
    got = langid.identify(odd, protos).collect()
    assert len(got) == 9 and {r.language for r in got if r.doc_id in (1, 2, 3, 4)} == {"und"}
    kept = langid.known(odd, protos)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    n = sum(r.language != "und" for r in got)
    assert kept.count() == n
    assert {r.language for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.prototypes(odd.limit(0)) == {} and langid.identify(odd.limit(0), protos).count() == 0
