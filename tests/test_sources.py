from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from lexloom.sources import files as S
from lexloom.sources import sinks
from lexloom.streaming import incremental


def test_formats(spark, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (d / "b.HTML").write_text("<p>Hi &amp; <b>you</b><script>no()</script></p>")
    (d / "c.md").write_text("# T\n*x*")
    (d / "d.srt").write_text("1\n0:00:05,000 --> 0:00:06,000\n<i>Hello</i>\n\n2\n00:00:03,000 --> 00:00:04,000\n\n")
    (d / "e.csv").write_text('name,n\n"A, b",1\n')
    with zipfile.ZipFile(d / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    with zipfile.ZipFile(d / "g.epub", "w") as z:
        z.writestr("x.xhtml", "<p>page<style>s</style></p>")
    (d / "h.docx").write_bytes(b"broken")
    (d / "i.pdf").write_bytes(b"%PDF")
    (d / "j.bin").write_bytes(b"")
    (d / "k.txt").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.read_files(spark, str(tmp_path / "in")).collect()}
    assert {k: v.text for k, v in got.items()} == {"a.txt": "café", "b.HTML": "Hi & you", "c.md": "T\nx", "d.srt": "Hello", "e.csv": "name n\nA, b", "f.docx": "one\ntwo", "g.epub": "page", "h.docx": None, "i.pdf": None}
    assert got["h.docx"].error.startswith("BadZipFile") and got["i.pdf"].error == "unsupported: pdf"
    assert S.csv_columns(spark, str(d / "e.csv")).first().text == "A, b"


def test_sentence_readers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one\n\n two \n")
    (tmp_path / "o.json").write_text(json.dumps({"lang_iso": "xx", "sentences": [{"id": "i1", "text": "a"}, "plain", {"text": " "}]}))
    (tmp_path / "r.json").write_text(json.dumps([{"sent_id": "q", "text": "b"}]))
    (tmp_path / "l.jsonl").write_text('# c\n{"_type": "corpus_header"}\n\nbroken{\n{"sent_id": "z", "text": "d", "lang_iso": "yy"}\n')
    assert [(r.sent_id, r.text) for r in S.sentences_txt(spark, str(tmp_path / "s.txt")).collect()] == [("s-000001", "one"), ("s-000003", "two")]
    assert [(r.sent_id, r.lang, r.text) for r in S.sentences_json(spark, str(tmp_path / "o.json")).collect()] == [("i1", "xx", "a"), ("o-000002", "xx", "plain")]
    assert [r.sent_id for r in S.sentences_json(spark, str(tmp_path / "r.json")).collect()] == ["q"]
    assert [(r.sent_id, r.lang) for r in S.sentences_jsonl(spark, str(tmp_path / "l.jsonl")).collect()] == [("z", "yy")]
    x = spark.createDataFrame([("und",), (None,), ("en",)], "l string").select(S.language(F.col("l"), "fr").alias("x"))
    assert [r.x for r in x.collect()] == ["fr", "fr", "en"]


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, 1, "Hi", "Hi", 0), (1, 2, "|", "x", 3)], "sent int, pos int, form string, original string, start int")
    blocks = spark.createDataFrame([("# sent_id = 1\n1\tHi\thi\tX\t_\t_\t_\t_\t_\t_\n",)], "block string")
    sinks.write_both(t, blocks, ["sent"], str(tmp_path / "o"))
    row = json.loads(spark.read.text(str(tmp_path / "o/jsonl")).first().value)
    assert row["n_tokens"] == 2 and [x["form"] for x in row["tokens"]] == ["Hi", "|"]
    back = S.conllu(spark, str(tmp_path / "o/conllu")).first()
    assert (back.sent_id, back.pos, back.form, back.xpos) == ("1", 1, "Hi", None)
    assert "start" not in sinks.jsonl_rows(t, ["sent"], slim=True).first().value
    s = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, text string")
    sinks.write_sentences(s, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).count() == 2
    sinks.write_json(spark.createDataFrame([(1, "en", ["a b", "c"])], "doc_id int, lang string, sentences array<string>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().words_per_sentence == 1.5
    left = sinks.remaining(spark.createDataFrame([("a",), ("b",)], "sent_id string"), spark.createDataFrame([("a",)], "sent_id string"))
    assert [r.sent_id for r in left.collect()] == ["b"]


def test_incremental_run_writes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("One here. Two here.")
    args = [spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")]
    incremental.run(*args).awaitTermination()
    incremental.run(*args).awaitTermination()
    assert spark.read.parquet(args[2]).count() == 2
    (tmp_path / "in/b.txt").write_text("Three here.")
    incremental.run(*args).awaitTermination()
    assert sorted(r.sentence for r in spark.read.parquet(args[2]).collect()) == ["One here.", "Three here.", "Two here."]


def test_yaml_and_manifests(spark, tmp_path):
    from lexloom.functions import profiles
    from lexloom.operators import grammar as G

    f = tmp_path / "c.yaml"
    f.write_text("global:\n  chapter_words: [Book]\n  punctuation_map: {'«': '<'}\n  ocr_corrections: {rn: m}\nlanguages:\n  zz:\n    valid_single_chars: [no, 'q']\n    ocr_corrections: {rn: n}\n")
    own, every = profiles.load(str(f))
    assert own["zz"].single_chars[-2:] == ("False", "q") and dict(own["zz"].ocr)["rn"] == "n" and own["zz"].punctuation == (("«", "<"),) and "Book" in every.chapter_words and own["zz"].keywords[:2] == ("/zz/", "zz")
    f.write_text("verbs: [{root: -bon-, gloss: see, verified: true}, lim]\nnouns: [{stem: -ntu, noun_class: NC1, plural_class: NC2}]\nclosed_class: [{form: a, category: conj}]\n")
    rows = G.lexicon(str(f), "xx")
    assert rows[0] == ("xx", "verb", "bon", "see", None, None, True) and rows[2][4:6] == ("NC1", "NC2") and rows[3][1] == "conj"
    assert spark.createDataFrame(rows, G.LEXICON).count() == 4
    f.write_text("- {word: a, gloss: b}\n- c\n")
    assert G.word_bank(str(f)) == [("a", "b"), ("c", None)]
    assert G.settings_problems({"language": "x y", "path": "/no/such", "version": "a", "locale": "EN"}) == ["language", "path", "version", "locale"] and G.settings_problems({"language": "xx"}) == []
    assert G.report("lexa", G.LEXEME)["noun_class"] == 10 and "NC1a: no prefix" in G.report("lexa", G.LEXEME)["odd"]
    assert "LEXICON Tense\n+PRES:ea Object ;" in G.transducer_source(G.LEXEME, ["bon"])
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"languages": {"en": {"files": ["a"]}, "fr": ["b"]}}))
    assert sinks.read_manifest(str(m)) == {"en": ["a"], "fr": ["b"]}
    b = sinks.annotated_conllu(spark.createDataFrame([(1, "X\n")], "sent int, block string"), spark.createDataFrame([(1, None, "en", "a\nb")], "sent int, source string, lang string, text string"), ["sent"])
    assert b.first().block == "# source = _\n# lang = en\n# text = a b\nX\n"
