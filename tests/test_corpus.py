"""The corpus builder, damaged files, and readers of several formats."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexloom.functions.profiles import Profile, Toggles, profiles, synced
from lexloom.sources import corpus, files, sinks


def docx(*paragraphs: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:body></w:document>")
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    for name, text in {"en/a.txt": "Chapter 1\n\nDr. Smith went home. He wrote to a@b.org.\nSee http://x.y now.", "de/sub/b.md": "# Der Hund\nlief weg. Usw. ging es gut.", "c.srt": "1\n00:00:01,000 --> 00:00:02,000\n<i>Hello there.</i>\n", "en/empty.txt": "   \n", "x.pdf": "%PDF", "skip.bin": "no"}.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text, encoding="utf-8")
    (at / "en" / "d.docx").write_bytes(docx("First paragraph here.", "Second one."))
    (at / "en" / "bad.docx").write_bytes(docx("x" * 500)[:-30])
    return at


def test_build(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    report = corpus.build(spark, str(folder), target).first()
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{target}/results").collect()}
    assert (report.files, report.done, report.failed) == (7, 4, 3) and report.n_emails == 1 and report.n_urls == 1 and report.n_headings == 1
    assert {k: (r.lang, r.success, r.stage) for k, r in rows.items()} == {"a.txt": ("en", True, None), "b.md": ("de", True, None), "c.srt": ("und", True, None), "empty.txt": ("en", False, "clean"), "x.pdf": ("und", False, "extract"), "d.docx": ("en", True, None), "bad.docx": ("en", False, "extract")}
    assert rows["a.txt"].sentences == ["Dr. Smith went home.", "He wrote to See now."]  # the full stop left alone goes with the single characters
    at = tmp_path / "out"
    assert (at / "txt/de/de/sub/b_md.txt").read_text().count("\n") == len(rows["b.md"].sentences)
    one = json.loads((at / "json/en/en/d_docx.json").read_text())
    assert one["statistics"]["sentence_count"] == 2 and one["sentences"] == ["First paragraph here.", "Second one."]
    assert (at / "cleaned/en/en/d_docx.cleaned.txt").read_text() == rows["d.docx"].cleaned
    manifest = spark.read.json(f"{target}/manifest")
    assert manifest.count() == 12 and {r.lang for r in manifest.collect()} == {"en", "de", "und"}
    with pytest.raises(ValueError, match="unknown formats"):
        corpus.outputs(spark.read.parquet(f"{target}/results"), str(folder), target, ("pdf",))
    assert corpus.build(spark, str(folder), target).first().done == 4  # again, in the same place


def test_language_of_profiles(spark):
    df = spark.createDataFrame([("/x/FR/a",), ("/x/none/a",), ("/german/b",)], "path string")
    assert [r.l for r in df.select(corpus.detected(F.col("path"), profiles()).alias("l")).collect()] == ["fr", "und", "de"]
    known = {"aa": Profile(iso="aa", abbreviations=("X",)), "bb": Profile(iso="bb", abbreviations=("X",)), "cc": Profile(iso="cc")}
    rows = spark.createDataFrame([("aa",), ("bb",), ("cc",), (None,)], "lang string")
    assert [r.n for r in rows.select(corpus.by_language(F.col("lang"), known, Profile(), lambda p: F.lit(len(p.abbreviations))).alias("n")).collect()] == [1, 1, 8, 8]


def test_no_archive_ends_the_job(spark, tmp_path):
    rng, whole = random.Random(5), docx(*(f"paragraph {i} {'word ' * 40}" for i in range(50)))
    locked = bytearray(whole)
    for mark in (b"PK\x03\x04", b"PK\x01\x02"):  # the flag of an encrypted entry
        locked[whole.index(mark) + (6 if mark == b"PK\x03\x04" else 8)] |= 1
    for i in range(40):
        bad = bytearray(whole)
        bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        (tmp_path / f"{i}.docx").write_bytes(bad)
    (tmp_path / "locked.docx").write_bytes(locked)
    (tmp_path / "method.docx").write_bytes(whole.replace(b"\x08\x00", b"\x63\x00"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert len(rows) == 42 and all((r.text is None) != (r.error is None) for r in rows.values())
    assert rows["locked.docx"].error.startswith("RuntimeError") and rows["method.docx"].error


def test_epub_in_reading_order():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("z", "a", "m"):
            z.writestr(f"OEBPS/{name}.xhtml", f"<html><body>{name}</body></html>")
        z.writestr("OEBPS/content.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="i1" href="z.xhtml"/><item id="i2" href="a.xhtml"/></manifest><spine><itemref idref="i1"/><itemref idref="i2"/></spine></package>')
    assert files.unpacked(out.getvalue(), "epub") == "z\na\nm"


def test_sentences_of_any_reader(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("One.\n\nTwo.\n")
    (tmp_path / "sub" / "b.jsonl").write_text('{"_type": "corpus_header"}\n{"id": "x", "text": "Three."}\nbroken\n')
    (tmp_path / "c.json").write_text('{"language_iso": "en", "sentences": ["Four.", {"sent_id": "s", "text": "Five."}]}')
    (tmp_path / "d.md").write_text("not read")
    got = {r.sent_id: r.text for r in files.sentences_of(spark, str(tmp_path)).collect()}
    assert got == {"a-000001": "One.", "a-000003": "Two.", "x": "Three.", "c-000001": "Four.", "s": "Five."}
    assert files.sentences_of(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(ValueError, match="no .txt"):
        files.sentences_of(spark, str(tmp_path / "d.md"))


def test_conllu_with_any_line_ends(spark, tmp_path):
    block = "# sent_id = s{0}\n1\ta\ta\tX\t_\t_\t_\t_\t_\t_\n2\tb\tb\tX\t_\t_\t_\t_\t_\t_\n"
    text = block.format(1) + "\n" + block.format(2)
    (tmp_path / "a.conllu").write_bytes(text.encode())
    (tmp_path / "b.conllu").write_bytes(text.replace("\n", "\r\n").encode())
    for name in ("a", "b"):
        got = files.conllu(spark, str(tmp_path / f"{name}.conllu")).collect()
        assert sorted((r.sent_id, r.pos, r.form, r.misc) for r in got) == [("s1", 1, "a", None), ("s1", 2, "b", None), ("s2", 1, "a", None), ("s2", 2, "b", None)]


def test_csv_and_reports(spark, tmp_path):
    df = spark.createDataFrame([('name,n\n"A, b",3\n\nx,1.5',), (None,), ("",)], "t string")
    assert [r.c for r in df.select(files.csv_text(F.col("t")).alias("c")).collect()] == ["name n\nA, b\nx", None, ""]
    sinks.write_report(df.selectExpr("count(*) as n"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().n == 3


def test_settings_of_a_file():
    assert synced(Toggles(), 3, 1000, {"remove_urls": False, "min_sentence_length": 5}) == (Toggles(urls=False), 5, 1000)
    chosen = Toggles(emails=False)
    assert synced(chosen, 2, 1000, {"remove_urls": False, "min_sentence_length": 5, "max_sentence_length": 9}) == (chosen, 2, 1000)
    assert synced(Toggles(), 3, 1000, {"preserve_bible_text": False})[0].verses
