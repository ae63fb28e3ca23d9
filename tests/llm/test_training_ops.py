"""Licences, chat repair, WARC, quality classifier, quality rules, and the pipeline."""

from __future__ import annotations

import functools
import gzip
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import chat, cotrain, licenses, quality_rules, warc

from .conftest import prose

# licences


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return licenses.trained([prose(rng, 40) for _ in range(200)])


def test_licences_held_out(model):
    rng = np.random.default_rng(99)
    other = random.Random(8)
    lines = [prose(other, 30) for _ in range(100)]
    right = total = 0
    for family, notices in licenses.FAMILIES.items():
        texts = licenses.variants(notices, lines, rng, 5)
        got = {i: f for i, f, *_ in model.scan(pa.array(texts))}
        right += sum(got.get(i) == family for i in range(len(texts)))
        total += len(texts)
    assert right >= 0.93 * total, (right, total)
    assert not model.scan(pa.array(lines))
    assert {f for _, f, *_ in model.scan(pa.array(licenses.OTHERS[1]))} <= {"unknown"}


WRAPPED = {
    "mit": "MIT License\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction, including the\nrights to use, copy, modify, merge, publish and distribute it.\n\nThe above copyright notice and this permission notice shall be\nincluded in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY\nOF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL\nTHE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.\n",
    "bsd": "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following\nconditions are met:\n\n1. Redistributions of source code must retain the above\n   copyright notice.\n\n2. Redistributions in binary form must reproduce the above\n   copyright notice in the documentation.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS\nAND CONTRIBUTORS AS IS.\n",
    "apache": "# Copyright 2020 Jane Doe\n#\n# Licensed under the Apache License, Version 2.0;\n# you may not use this file except in\n# compliance with the License. You may obtain a copy at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing,\n# software is distributed AS IS.\n# See the License for the specific language governing\n# permissions and limitations under the License.\n",
    "gpl": "// This program is free software: you can redistribute it and/or\n// modify it under the terms of the GNU General Public License\n// as published by the Free Software Foundation.\n//\n// This program is distributed in the hope that it will be useful,\n// but WITHOUT ANY WARRANTY. See the\n// GNU General Public License for more details.\n//\n// You should have received a copy of the GNU General Public License\n// along with this program.\n",
}


def findings(model, text: str) -> list:
    lists = licenses.paragraphs(pa.array([text]))
    return licenses.merged([(0, *x) for x in model.scan(lists.flatten())])


@pytest.mark.parametrize("family", sorted(WRAPPED))
def test_a_wrapped_licence_is_one_finding(model, family):
    for text in (WRAPPED[family], WRAPPED[family].replace("\n", "\r\n")):
        got = findings(model, text)
        assert [(x[3], x[6]) for x in got] == [(family, True)] and got[0][4] >= model.least


def test_words_of_licences_are_no_licence(model):
    for text in ("The MIT campus is in Cambridge.", "MIT", "GPL", "Apache", "License", "A copy of the Apache story is in the public library.", "the terms of use"):
        assert findings(model, text) == []


def test_notice_in_a_very_long_line(model):
    rng = random.Random(31)
    for at in (0, 77, 9_950, 20_000):
        words = prose(rng, 20_000).split()
        words[at:at] = "Licensed under the Apache License, Version 2.0.".split()
        got = findings(model, " ".join(words))
        assert [(x[3], x[6]) for x in got] == [("apache", True)]
    assert findings(model, prose(rng, 20_000)) == []


@functools.cache
def one(gram: str) -> int:
    return int(licenses.shingles(licenses.plain_words(pa.array([gram]))[0], len(gram.split()))[0])


def brute_scan(model, text: str) -> list:
    """Every window of every paragraph by dense scores and sets of n-grams."""
    weight = {int(k): w for k, w in zip(model.keys, model.weights)}
    marks = re.compile(r"^[ \t]*(?:/\*+|//+|#+|\*+/?|;+|--+|%+|<!--)[ \t]*", re.M)
    parts = re.split(r"(?<=[.!?:;])[ \t\r]*\n(?:[ \t\r]*\n)*|\n(?:[ \t\r]*\n)+", marks.sub("", text))
    keys_of = lambda t: set(licenses.grams(pa.array([t]))[0].tolist())
    out = []
    for at, part in enumerate(parts):
        plain = [x for x in ("".join(c for c in w.lower() if c.isalnum()) for w in part.split()) if x]
        n = max(1, -(-(len(plain) - licenses.STRIDE) // licenses.STRIDE))
        for w in range(n):
            a = w * licenses.STRIDE
            first = plain[a : a + licenses.WINDOW]
            reach = {one(" ".join(plain[a + i : a + i + k])) for k in range(1, 4) for i in range(len(first)) if a + i + k <= len(plain)}
            if not reach & weight.keys():
                continue
            z = (model.bias + sum((weight[x] for x in reach if x in weight), np.zeros(len(model.bias)))) / model.temperature
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            if p.argmax() == licenses.NONE:
                continue
            own, best = keys_of(" ".join(first)), int(p[: licenses.UNKNOWN].argmax())
            share = max(len(own & t) / max(min(len(own), len(t)), min(licenses.LEAST, len(t))) for t in model.templates[licenses.CLASSES[best]])
            other = p[licenses.UNKNOWN] / (p[licenses.UNKNOWN] + p[licenses.NONE])
            if p[best] >= model.least and share >= licenses.CONFIRM:
                out.append((at, licenses.CLASSES[best], p[best], share, True))
            elif other >= 0.5:
                out.append((at, "unknown", other, share, False))
    return out


def test_scan_agrees_with_brute_force(model):
    rng = random.Random(17)
    texts = [*itertools.chain(*licenses.FAMILIES.values()), *licenses.OTHERS[1], *WRAPPED.values(), "", "the terms of use", "MIT MIT MIT", " ".join([prose(rng, 180), licenses.FAMILIES["bsd"][0], prose(rng, 90)]), "MIT " + prose(rng, 99) + " License"]
    for t in texts:
        got, want = model.scan(licenses.paragraphs(pa.array([t])).flatten()), brute_scan(model, t)
        assert [(a, f, ok) for a, f, *_, ok in got] == [(a, f, ok) for a, f, *_, ok in want]
        assert np.allclose([x[2:4] for x in got], [x[2:4] for x in want]) or not got


def test_licences_of_odd_rows(spark, odd, model, documents):
    assert licenses.found(odd, model).count() == 0 and licenses.found(odd.limit(0), model).count() == 0
    text = "First line\n\nReleased under the MIT License.\n" + "and more of it " * 5000 + "\n\nOne more.\n\nOne more.\nAll rights reserved."
    rows = licenses.found(documents([(1, text), (1, text), (None, "MIT License")]), model).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.paragraphs, r.family, r.confirmed) for r in rows) == sorted([(0, 0, 1, "mit", True), *[(1, 1, 1, "mit", True), (1, 5, 1, "proprietary", True)] * 2])
    assert licenses.ordinary_lines(odd.limit(0)) == []


def test_ordinary_sample_is_bounded(spark, documents, rng):
    """Copies of one text count once, and a place in a long line is as likely as any other."""
    docs = documents(["the same text again"] * 500 + [prose(rng, 300).replace(".", "") for _ in range(100)])
    got = licenses.ordinary_lines(docs, 40)
    assert 0 < len(got) <= 40 and max(len(x.split()) for x in got) <= licenses.WINDOW and got.count("the same text again") <= 1


# chat


def cheapest(roles: tuple[int, ...], most: int) -> int:
    """Least cost over all legal sequences and all ways to put the turns into them."""
    legal = [(s, n) for s in (0, 1) for n in range(1, most + 1)]
    best = 10**9
    for system, pairs in legal:
        shape = [0] * system + [1, 2] * pairs
        for places in itertools.combinations_with_replacement(range(len(shape)), len(roles)):
            cost = sum(chat.RELABEL * (shape[p] != r) for p, r in zip(places, roles))
            cost += chat.MERGE * sum(a == b for a, b in zip(places, places[1:])) + chat.INSERT * (len(shape) - len(set(places)))
            best = min(best, cost)
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from([-1, 0, 1, 2]), min_size=1, max_size=5).map(tuple))
def test_repair_is_cheapest_and_legal(roles):
    cost, sequence = chat.repair(roles)
    assert cost == cheapest(roles, len(roles) + 1)
    out = [r for r, _ in sequence]
    assert out in ([0] * s + [1, 2] * ((len(out) - s) // 2) for s in (0, 1)) and len(out) > 1
    assert [i for _, own in sequence for i in own] == list(range(len(roles)))


def test_formatted(spark):
    schema = "conv_id long, turn long, role string, text string, cost string"
    rows = [(1, 2, "GPT", "b", "x"), (1, 1, "human", "a <|end|>", "x"), (2, 1, None, None, "x"), (None, None, "user", "q", "x"), (3, 1, "user", "a", "x"), (3, 1, "user", "a", "x"), (3, 2, "assistant", "long " * 50_000, "x")]
    got = {r.conv_id: r for r in chat.formatted(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].rendered == "<|user|>\na < |end|><|end|>\n<|assistant|>\nb<|end|>\n" and got[1].cost == 0
    assert (got[2].relabelled, got[2].inserted, got[2].turns_out) == (1, 1, 2)
    assert got[None].rendered.startswith("<|user|>\nq") and got[None].inserted == 1
    assert (got[3].merged, got[3].turns_in, got[3].turns_out) == (1, 3, 2) and got[3].rendered.count("long ") == 50_000
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0


# WARC


@pytest.fixture
def archive(tmp_path):
    rows = []
    for i in range(6):
        body = f"HTTP/1.1 {200 if i % 3 else 404} OK\r\nContent-Type: text/html; charset={'latin-1' if i == 1 else 'utf-8'}\r\n\r\n".encode() + (b"caf\xe9" if i == 1 else b"<p>x</p>" * i)
        rows.append({"record_type": "response" if i % 2 else "request", "target_uri": f"http://h{i}/", "content_type": "application/http", "headers": [("X-N", str(i))], "payload": body})
    rows.append({"record_type": "warcinfo", "payload": b"software: x"})
    rows.append({"record_type": None, "target_uri": "urn:x", "payload": None})
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record, rows)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record(r)) for r in rows))
    (tmp_path / "_skip.warc").write_bytes(b"junk")
    (tmp_path / "empty.warc").write_bytes(b"")
    return str(tmp_path), rows


def test_read_and_pushdown(spark, archive):
    path, rows = archive
    got = warc.read_warc(spark, path)
    assert got.count() == 2 * len(rows)
    ok = warc.read_warc(spark, path, where="record_type = 'response' and http_status = 200 and target_uri like 'http://h%'").select("target_uri", "text", "headers")
    plan = ok._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", "")
    assert sorted((r.target_uri, r.text, r.headers["x-n"]) for r in ok.collect()) == sorted([("http://h1/", "café", "1"), ("http://h5/", "<p>x</p>" * 5, "5")] * 2)
    assert got.filter("record_type = 'resource'").select("content_length", "http_status", "text", "content_type").collect() == [(0, None, "", None)] * 2
    assert got.filter("content_type is null").count() == 4 and got.filter("record_type in ('warcinfo', 'x') or http_status = 404").count() == 6
    two = got.filter("http_status = 404").select("target_uri").distinct().join(got.filter("record_type = 'request'").select("target_uri").distinct(), "target_uri")
    assert two.count() == 1 and got.count() == 2 * len(rows)
    for where in ("not (record_type = 'request')", "content_length > 11 and content_type is not null", "record_type <=> null", "record_type not in ('request')", "target_uri >= 'http://h3/'", "record_id like '%1%' or http_status = 200"):
        assert warc.read_warc(spark, path, where=where).count() == got.filter(where).count()
    assert warc.read_warc(spark, path, **{"header.X-N": "3"}).count() == 2
    assert warc.read_warc(spark, path, partition_bytes="1").rdd.getNumPartitions() == 3


def test_unwanted_blocks_are_not_decoded(archive, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    path, rows = archive

    class Schema:
        names = ["record_type", "text"]

    r = warc.PushingReader(Schema, {"path": path})
    assert list(r.pushFilters([EqualTo(("record_type",), "warcinfo")])) == []
    taken = []
    monkeypatch.setattr(warc.Bytes, "take", lambda self, n, real=warc.Bytes.take: (taken.append(n), real(self, n))[1])
    out = [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
    assert out == [{"record_type": "warcinfo", "text": "software: x"}] * 2 and taken == [11, 11]


def test_damaged_files(spark, tmp_path):
    whole = warc.record({"record_type": "resource", "payload": b"x" * 100})
    (tmp_path / "a.warc").write_bytes(whole + whole[:-60])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole)[:-20])
    assert warc.read_warc(spark, str(tmp_path), mode="permissive").count() == 2
    with pytest.raises(Exception, match="Damaged"):
        warc.read_warc(spark, str(tmp_path)).count()


def test_lengths_that_lie(spark, tmp_path):
    """A negative length would lead back to the record's own head."""
    whole = warc.record({"record_type": "resource", "payload": b"x" * 10})
    for i, length in enumerate((b"-54", b"1e3", b"", b"9" * 30)):
        (tmp_path / f"{i}.warc").write_bytes(whole + b"WARC/1.1\r\nContent-Length: " + length + b"\r\n\r\nabc\r\n\r\n")
    assert warc.read_warc(spark, str(tmp_path), mode="permissive").count() == 4
    with pytest.raises(Exception, match="Damaged"):
        warc.read_warc(spark, str(tmp_path / "0.warc")).count()


def test_status_is_tested_before_the_body(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    class Schema:
        names = ["target_uri", "text", "http_headers"]

    head = b"HTTP/1.1 %d X\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n"
    rows = [{"record_type": "response", "content_type": "application/http", "target_uri": str(c), "payload": head % c + b"y" * 50_000} for c in (404, 200, 500)]
    (tmp_path / "a.warc").write_bytes(b"".join(map(warc.record, rows)))
    r = warc.PushingReader(Schema, {"path": str(tmp_path)})
    assert list(r.pushFilters([EqualTo(("http_status",), 200)])) == []
    taken = []
    monkeypatch.setattr(warc.Bytes, "take", lambda self, n, real=warc.Bytes.take: (taken.append(n), real(self, n))[1])
    out = [row for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]
    assert [(o["target_uri"], len(o["text"]), dict(o["http_headers"])["set-cookie"]) for o in out] == [("200", 50_000, "b")]
    assert sorted(taken)[-2:] == [len(head % 200), 50_000]


def test_write_and_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (None, None, None), (2, "http://b\r\nX: y", "z" * 3_000_000), (2, "http://b", "")], "page_id long, url string, html string")
    path = warc.write_warc(warc.page_records(pages), str(tmp_path / "w"))
    got = warc.read_warc(spark, path).filter("record_type = 'response'").select(F.col("headers")["x-page-id"].alias("id"), "target_uri", F.length("text").alias("n"), "http_status")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([("1", "http://a", 8, 200), (None, None, 0, 200), ("2", "http://b X: y", 3_000_000, 200), ("2", "http://b", 0, 200)], "id string, target_uri string, n int, http_status int").collect()))
    warc.page_records(pages.limit(1)).write.format("warc").mode("overwrite").save(path)
    assert warc.read_warc(spark, path).count() == 2
    warc.write_warc(warc.page_records(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("body", "head", "want"), [(b"4\r\nab c\r\n0\r\n\r\n", {"transfer-encoding": "chunked"}, "ab c"), (gzip.compress(b"x"), {"content-encoding": "gzip"}, "x"), (b"x", {"content-encoding": "gzip"}, "x"), (b"\xff", {}, "�"), (b"a", {"content-type": "text/html; charset=nonsense"}, "a"), (b"\x0b\x02", {"content-encoding": "br"}, None), (warc.zstandard.compress(b"zz"), {"content-encoding": "zstd"}, "zz"), (gzip.compress(gzip.compress(b"x")), {"content-encoding": "gzip, gzip"}, "x")])
def test_bodies(body, head, want):
    assert warc.decoded(body, head) == want


# quality


def junk(rng: random.Random, n: int) -> str:
    kind = rng.randrange(3)
    w = prose(rng, n).split()
    return " ".join(x + rng.choice(["###", "$$$", "%%%"]) for x in w) if kind == 0 else " ".join(w[:3] * (n // 3)) if kind == 1 else " | ".join(w)


def labelled(spark, documents, rng, n=400):
    rows = [(i, junk(rng, rng.randrange(30, 120)) if i % 6 == 0 else prose(rng, rng.randrange(20, 160)), "en", f"s{i % 5 if i % 6 else 9}") for i in range(n)]
    return documents(rows), spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(n) if i % 2 == 0 or i % 3], "doc_id long, quality int, toxic int")


def test_co_training_held_out(spark, documents, rng):
    docs, labels = labelled(spark, documents, rng)
    model = cotrain.fitted(docs, labels)
    new, truth = labelled(spark, documents, random.Random(77))
    got = {r.doc_id: r for r in cotrain.scored(new, model).collect()}
    good, bad = [r for i, r in got.items() if i % 6], [r for i, r in got.items() if i % 6 == 0]
    assert sum(r.keep for r in good) >= 0.98 * len(good) and sum(not r.keep for r in bad) >= 0.9 * len(bad)
    assert {r.doc_id for r in cotrain.kept(new, model).collect()} == {i for i, r in got.items() if r.keep}
    again = cotrain.fitted(docs.repartition(3), labels.repartition(2))
    assert np.allclose(again.text.b, model.text.b) and np.allclose(again.combine, model.combine)


def test_rare_source_gets_pseudo_labels(spark, documents, rng):
    """Unlabelled rows are candidates however few of all rows may be chosen."""
    rows = [(i, junk(rng, 60) if i % 6 == 0 else prose(rng, 60), "en", "rare" if i in (1200, 1410) else f"s{i % 5}") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(400)], "doc_id long, quality int")
    model = cotrain.fitted(documents(rows), labels, pool=20)
    at = int(np.flatnonzero(cotrain.one_hot(["rare"], cotrain.SOURCES)[0])[0]) - cotrain.SOURCES - 1
    assert model.meta.b[at] < 0


def test_rounds_against_plain_selection(spark, documents, rng):
    """The rounds over a written table give the model that sorting all sure rows by hand gives."""
    docs, labels = labelled(spark, documents, rng, 300)
    docs = docs.union(docs.limit(20))  # copies
    y = {r.doc_id: r.quality for r in labels.filter("doc_id < 120").collect()}
    model = cotrain.fitted(docs, labels.filter("doc_id < 120"), pool=60, rounds=3, sure=0.8)
    table = docs.toPandas()
    batch = pa.RecordBatch.from_pydict({c: table[c].tolist() for c in ("doc_id", "text", *cotrain.META)} | {"y": pa.array([y.get(i) for i in table.doc_id], pa.int32())})
    rows = sorted({r["key"]: r for b in cotrain._features([batch]) for r in b.to_pylist()}.values(), key=lambda r: r["key"] % (1 << 64))
    every = [r for b in cotrain._features([batch]) for r in b.to_pylist() if r["y"] is None]
    x = {k: np.array([np.frombuffer(r[k], np.float32) for r in rows]) for k in ("tx", "mx")}
    label = np.array([-1 if r["y"] is None else r["y"] for r in rows])
    own = np.flatnonzero(label >= 0)
    held, train = own[np.arange(len(own)) % 10 < 3], own[np.arange(len(own)) % 10 >= 3]
    rest = {k: np.array([np.frombuffer(r[k], np.float32) for r in every]) for k in x}
    fit = [cotrain.View(cotrain.sums(rest[k]) + cotrain.sums(x[k][train])) for k in ("tx", "mx")]
    share, most = label[train].mean(), max(2, min(len(every), 60) // 6)

    def choose(fit, given):
        for k, (a, b) in enumerate((("tx", "mx"), ("mx", "tx"))):
            p = cotrain.sigmoid(fit[k].logit(rest[a]))
            for stratum in {r["stratum"] for r in every}:
                n = sum(r["stratum"] == stratum for r in every)
                for kind, q, part in ((1, p, share), (0, 1 - p, 1 - share)):
                    sure = sorted({(-q[i], r["key"]) for i, r in enumerate(every) if r["stratum"] == stratum and q[i] >= 0.8 and r["key"] not in given[1 - k]})
                    for _, key in sure[: max(cotrain.LEAST, round(most * part * n / len(every)))]:
                        yield k, key, kind, next(rest[b][i] for i, r in enumerate(every) if r["key"] == key)

    want = cotrain.exchange((x["tx"][train], x["mx"][train]), label[train], (x["tx"][held], x["mx"][held]), label[held].astype(float), fit, choose, 3)
    assert np.allclose(model.text.b, want.text.b, atol=1e-3) and np.allclose(model.meta.b, want.meta.b, atol=1e-3) and np.allclose(model.combine, want.combine, atol=1e-2)


def test_labelled_sample_is_bounded(spark, documents, rng, monkeypatch):
    """A labelled ``doc_id`` of many rows, and many rows without one, bring no more rows to the driver than stated."""
    docs, labels = labelled(spark, documents, rng, 120)
    many = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 2).cast("long").alias("doc_id"), F.concat(F.lit("river stone garden "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source"), F.lit(20).cast("long").alias("n_chars"))
    seen = []
    monkeypatch.setattr(cotrain, "_arrays", lambda t, *a, real=cotrain._arrays: (seen.append(t.num_rows), real(t, *a))[1])
    model = cotrain.fitted(docs.unionByName(many), labels, labelled=100)
    assert model is not None and 100 < max(seen) <= 200


def test_each_view_learns_from_the_other():
    """Few labels, and a pool on which each view is sure of other rows."""
    rng = np.random.default_rng(0)
    y = (rng.random(900) < 0.5).astype(int)
    one = np.column_stack([np.ones(900), (2 * y - 1) * np.where(rng.random(900) < 0.6, 2, 0) + rng.normal(0, 0.4, 900)])
    two = np.column_stack([np.ones(900), (2 * y - 1) * np.where(rng.random(900) < 0.6, 2, 0) + rng.normal(0, 0.4, 900)])
    given_y = np.where(np.arange(900) < 120, y, -1)
    held = (given_y >= 0) & (np.arange(900) % 3 == 0)
    m = cotrain.co_train(one, two, given_y, held)
    a, b, both = m.scores(one, two)
    right = lambda p: ((p > 0.5) == y)[120:].mean()
    assert right(both) >= max(right(a), right(b)) - 0.01 and right(both) > 0.85
    ece = abs(both[120:].mean() - y[120:].mean())
    assert ece < 0.08


def test_quality_of_odd_rows(spark, odd, documents, rng):
    docs, labels = labelled(spark, documents, rng, 120)
    model = cotrain.fitted(docs, labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (5, 0, 0), (5, 1, 0)], labels.schema)))
    got = cotrain.scored(odd, model).collect()
    assert len(got) == 9 and all(not r.keep and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    out = cotrain.kept(odd, model)
    assert out.columns == odd.columns and out.count() == sum(r.keep for r in got)
    assert cotrain.scored(odd.limit(0), model).count() == 0
    assert cotrain.fitted(docs, labels.filter("quality = 1")) is None and cotrain.fitted(docs.limit(0), labels) is None and cotrain.fitted(docs, labels.limit(0)) is None
    assert cotrain.kept(odd, None).count() == 6


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 4))])
    y = (rng.random(300) < cotrain.sigmoid(x @ [0.3, 1, -1, 0.5, 0])).astype(float)
    b = cotrain.logistic(x, y, np.ones(300), 1.0, 30)
    g = x.T @ (cotrain.sigmoid(x @ b) - y) + np.array([1e-6, 1, 1, 1, 1]) * b
    assert np.abs(g).max() < 0.05


# quality rules


def brute_rules(rows: list, pull: float) -> set:
    """Exact quartiles by group, drawn toward the language's and all, then the fences."""
    rows = [r for r in rows if r.n_words]

    def quartile(group: list, k: str, p: float) -> float:
        xs = sorted(x[k] for x in group)
        return xs[max(0, -(-int(p * 100 * len(xs)) // 100) - 1)]

    def drawn(r, k: str, p: float) -> float:
        groups = [rows, [x for x in rows if x.lang == r.lang], [x for x in rows if (x.lang, x.source) == (r.lang, r.source)]]
        out = quartile(rows, k, p)
        for g in groups[1:]:
            out = (len(g) * quartile(g, k, p) + pull * out) / (len(g) + pull)
        return out

    keep = set()
    for r in rows:
        ok = True
        for k, spread in quality_rules.SPREAD.items():
            lo, hi = drawn(r, k, 0.25), drawn(r, k, 0.75)
            wide = quality_rules.FENCE * max(hi - lo, spread)
            ok &= lo - wide <= r[k] <= hi + wide
        if ok:
            keep.add(r.doc_id)
    return keep


def test_rules_against_exact_quartiles(spark, documents, rng):
    rows = [(i, junk(rng, 60) if i % 11 == 0 else prose(rng, rng.randrange(5, 90)), ("en", "de", None)[i % 3], f"s{i % 7 // 3}") for i in range(330)]
    docs = documents(rows)
    measured = quality_rules.measured(docs)
    want = brute_rules(measured.collect(), 60)
    got = {r.doc_id for r in quality_rules.passing(docs, pull=60).collect()}
    assert got == want
    assert len([i for i in got if i % 11]) >= 0.97 * 300 and len([i for i in got if i % 11 == 0]) <= 6


def test_short_repetitive_texts_are_judged(spark, documents, rng):
    rows = [(i, prose(rng, rng.randrange(3, 90))) for i in range(300)] + [(1000, "again " * 19), (1001, "again " * 8), (1002, "hi"), (1003, "good morning all")]
    got = {r.doc_id for r in quality_rules.passing(documents(rows)).collect()}
    assert not {1000, 1001} & got and {1002, 1003} <= got and len(got) >= 295


def test_sketches_merge(spark):
    """A language's quartiles come from its sources' sketches, as from all its rows at once."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 40).alias("source"), F.lit(9).alias("n_words"), *((F.xxhash64("id") % 1000 / 1000.0).alias(k) for k in quality_rules.SPREAD))
    own, of_lang, of_all = quality_rules.quartiles(df)
    exact = df.selectExpr("percentile(symbols, 0.75)").first()[0]
    assert own.count() == 40 and of_lang.count() == 1 and of_all.first().n == 3000
    assert abs(of_lang.first().symbols_75 - exact) < 0.02 and abs(of_all.first().symbols_75 - exact) < 0.02
    limits = quality_rules.fences(df)
    plan = limits._jdf.queryExecution().executedPlan().toString()
    assert limits.count() == 40 and "CartesianProduct" not in plan


@pytest.mark.parametrize("sketch", [200, quality_rules.SKETCH])
def test_approximate_quartiles(spark, sketch):
    """Ten times and more rows than a sketch holds: ranks err by little."""
    n = 20_000
    df = spark.range(2 * n).repartition(7).select(F.when(F.col("id") < n, "a").otherwise("b").alias("lang"), F.lit("s").alias("source"), *(F.exp(F.randn(k) * 0.5).alias(c) for k, c in enumerate(quality_rules.SPREAD)))
    df.cache()
    values = {r["lang"]: r for r in df.groupBy("lang").agg(*(F.sort_array(F.collect_list(c)).alias(c) for c in quality_rules.SPREAD)).collect()}
    for r in quality_rules.quartiles(df, sketch)[0].collect():
        for c in quality_rules.SPREAD:
            for q in (25, 75):
                assert abs(np.searchsorted(values[r["lang"]][c], r[f"{c}_{q}"]) / n - q / 100) < (0.03 if sketch < 1000 else 0.01)
    df.unpersist()


def test_rules_of_odd_rows(spark, odd):
    got = quality_rules.passing(odd).collect()
    assert not {r.doc_id for r in got} & {1, 2, 3} and len([r for r in got if r.doc_id == 5]) == 2
    assert quality_rules.passing(odd.limit(0)).count() == 0
    assert quality_rules.passing(odd.filter("doc_id in (1, 2)")).count() == 0


# pipeline


def test_pipeline(spark, documents, rng, tmp_path):
    import corpus_pipeline

    rows = [(i, junk(rng, 80) if i % 8 == 0 else prose(rng, rng.randrange(30, 120)), "en", "s") for i in range(240)]
    item = prose(rng, 40)
    rows += [(1000, rows[1][1], "en", "s"), (1001, rows[1][1], "en", "s"), (1002, prose(rng, 50) + " " + item + " " + prose(rng, 50), "en", "s"), (1003, None, None, None), (1004, "§§§ 12345 $$$", "en", "s"), (5, rows[5][1], "en", "s")]
    docs = documents(rows).withColumn("extra", F.lit("kept"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        seen[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "tokens":
            assert at.columns == docs.columns
    clean = {i for i in range(240) if i % 8}
    assert len(seen["quality"] & clean) >= 0.97 * len(clean) and len(seen["quality"] & {i for i in range(240) if i % 8 == 0}) <= 4 and 1003 not in seen["quality"]
    assert seen["language"] == seen["quality"] - {1004}
    assert not {1000, 1001} & seen["near_duplicates"] and {1, 1002} <= seen["near_duplicates"]
    assert seen["decontamination"] == seen["near_duplicates"] - {1002} == seen["tokens"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == seen["tokens"] and len(out) == len(seen["tokens"]) and all(r.round_trip for r in out)
