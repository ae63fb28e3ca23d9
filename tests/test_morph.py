from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import annotate as A
from lexloom.operators import grammar as G
from lexloom.operators import morph as M
from lexloom.operators import tagging as T


def forms(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "form string")


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], list(cells)).select(column.alias("x")).first()[0]


def test_affixes(spark):
    got = forms(spark, "reread", "re", "x", None).select(M.prefix(F.col("form"), ("re", "rer")).alias("p")).collect()
    assert [r.p for r in got] == ["rer", "", "", None]


def test_lexicon_probe(spark):
    nouns, verbs = spark.createDataFrame([("sun",)], "root string"), spark.createDataFrame([("run",), ("sun",)], "root string")
    got = {r.form: (r.category, r.lemma, r.cut) for r in M.lexicon_probe(forms(spark, "sun", "runs", "running", "zz", None), nouns, verbs).collect()}
    assert got["sun"] == ("noun", "sun", 0) and got["runs"] == ("verb", "run", 1) and got["running"] == (None, None, -1) and got[None] == (None, None, -1)


def test_verb_parse_scores(spark):
    t = M.VerbTables(G.LEXEME, G.VERB_ROOTS)
    score, slots = t.parse("theaate")[0]
    assert score == 0.80 and {k: v[0] for k, v in slots.items()} == {"SM": "th", "TAM": "ea", "ROOT": "at", "FV": "e"}
    assert t.parse("xe")[0][0] == 0.20
    df = M.verb_parses(forms(spark, "theaate", "", None), t)
    best = df.filter("hyp = 1").first()
    assert (best.sm_class, best.tam_id, best.gloss) == ("NC1", "PRES", "throw") and df.count() <= 5
    for r in M.spans(df).collect():
        assert r.form[r.start : r.stop] == r.morph


def test_every_parse_spells_the_word():
    t, p = M.VerbTables(G.LEXEME, G.VERB_ROOTS), M.SlotParser(G.LEXEME)
    for w in ("unthhatie", "anouoning", "coore", "reeauentoring", "a"):
        assert all("".join(s[k][0] for k in M.SLOTS if k in s) == w for _, s in t.parse(w))
        assert all(seg.replace("-", "") == w for _, seg, _ in p.analyse(w))


def test_slot_parser(spark):
    p = M.SlotParser(G.LEXEME, special={"etc": "ADV"})
    assert p.analyse("ETC") == [(1.0, "etc", "ADV")]
    p.add_constraint("long root", lambda s: len(s["ROOT"][0]) > 50)
    assert p.verbal("theaate") == [] and p.analyse("theaate") == p.nominal("theaate") == [(0.5, "th-eaate", "NC1-ROOT")]
    assert p.analyse("xyz") == [(0.0, "xyz", "UNKNOWN")]
    got = M.app_analyses(forms(spark, "theaate"), M.SlotParser(G.LEXEME))
    assert "th-ea-at-e" in {r.segmentation for r in got.collect()} and M.interlinear(got).first().text.count("\n") == 1
    M.register_functions(spark, M.SlotParser(G.LEXEME))
    assert "th-ea-at-e" in spark.sql("select analyse_word('theaate') x").first().x


def test_noun_analyses(spark):
    classes = spark.createDataFrame([("NC1", 0, "th"), ("NC3", 1, "t"), ("NC9", 2, "")], "nc string, nc_order int, prefix string")
    stems = spark.createDataFrame([("ing", "NC1", True)], "root string, nc string, verified boolean")
    got = M.noun_analyses(forms(spark, "thing", "th", "zoo"), classes, stems).orderBy("rank").collect()
    assert [(r.nc, r.score) for r in got if r.form == "thing"] == [("NC1", 0.95), ("NC3", 0.2), ("NC9", 0.05)]
    assert [(r.nc, r.score) for r in got if r.form == "th"] == [("NC3", 0.15), ("NC9", 0.05)] and [r.nc for r in got if r.form == "zoo"] == ["NC9"]
    some = M.noun_analyses(forms(spark, "ing", "othing", "zoo"), classes.filter("prefix <> ''"), stems, augments=("o",)).collect()
    assert sorted((r.form, r.nc, r.prefix, r.stem, r.score) for r in some) == [("ing", "NC1", "", "ing", 0.30), ("othing", "NC1", "th", "ing", 0.95), ("othing", "NC3", "t", "hing", 0.2)]
    tables = M.NounTables({"noun_classes": {"NC1": {"prefix": "th-"}, "NC3": {"prefix": ["t-"]}}}, {"ing": ("x", "NC1", True)}, ("o",))
    assert [(x[0], x[3]) for x in tables.analyse("othing")] == [("NC1", 0.95), ("NC3", 0.2)] and tables.analyse("ing") == [("NC1", "", "ing", 0.30, True)]


def test_every_form_and_nested_tense_counts():
    data = {"noun_classes": {"NC1": {"prefix": ["mu-", "mw-"], "allomorphs": ["m-"]}, "NC9": {"prefix": "∅"}}, "concords": {"subject_concords": {"NC1": ["u", "a"], "notes": "x"}, "object_concords": {"NC1": "mu"}}, "tam": {"PST": {"REC": {"form": "a"}, "REM": {"forms": ["aka", "ka"]}}, "PRS": {"form": "la"}}, "extensions": {"APPL": {"form": "-il-", "allomorphs": ["-el-"]}}, "slots": {}}
    t = G.annotation_tables(data)
    assert t["classes"] == [("NC1", ["mu", "mw", "m"]), ("NC9", [""])] and t["subjects"] == [("NC1", ["u", "a"])]
    assert t["tam"] == [("PST.REC", ["a"]), ("PST.REM", ["aka", "ka"]), ("PRS", ["la"])] and t["extensions"] == [("APPL", ["il", "el"])]
    v = M.VerbTables(data, {"bon": ("see", True)}, negation=("ta",), final_vowels=(("a", "IND"),))
    assert {k: x[0] for k, x in v.parse("taakabonela")[0][1].items()} == {"NEG": "ta", "SM": "a", "TAM": "ka", "ROOT": "bon", "EXT": "el", "FV": "a"}
    assert v.best("ulabona")[0] == v.parse("ulabona")[0][0] and T.features_of("PST.HOD") == {"Tense": "Past"}


def test_slot_search_is_exhaustive():
    """With many prefixes to one slot, the best hypothesis isn't lost for its place in the search."""
    many = {f"K{i}": "b" * i for i in range(1, 30)}
    data = {"noun_classes": {"NC1": {"prefix": "x"}}, "concords": {"subject_concords": many, "object_concords": many}, "tam": {k: {"form": f} for k, f in many.items()}, "extensions": {}, "slots": {n: {"position": i, "allowed_content_types": [t], "obligatory": n != "OM"} for i, (n, t) in enumerate((("SM", "concords.subject_concords"), ("TAM", "tam"), ("OM", "concords.object_concords"), ("ROOT", "verb_root"), ("FV", "final_vowel")))}}
    p, word = M.SlotParser(data, final_vowels=(("a", "IND"),)), "b" * 20 + "roota"
    best = 0.0
    for i in range(21):
        for j in range(21 - i):
            for k in range(21 - i - j):
                slots = {s: ("b" * n, "") for s, n in (("SM", i), ("TAM", j), ("OM", k)) if n} | {"ROOT": ("b" * (20 - i - j - k) + "root", ""), "FV": ("a", "")}
                best = max(best, p.score(word, slots, [s for s in p.order if s in slots]))
    assert p.analyse(word)[0][0] == best


def test_noun_analyses(spark):
    classes = spark.createDataFrame([("NC1", 0, "th"), ("NC3", 1, "t"), ("NC9", 2, "")], "nc string, nc_order int, prefix string")
    stems = spark.createDataFrame([("ing", "NC1", True)], "root string, nc string, verified boolean")
    got = M.noun_analyses(forms(spark, "thing", "th", "zoo"), classes, stems).orderBy("rank").collect()
    assert [(r.nc, r.score) for r in got if r.form == "thing"] == [("NC1", 0.95), ("NC3", 0.2), ("NC9", 0.05)]
    assert [(r.nc, r.score) for r in got if r.form == "th"] == [("NC3", 0.15), ("NC9", 0.05)] and [r.nc for r in got if r.form == "zoo"] == ["NC9"]
    some = M.noun_analyses(forms(spark, "ing", "othing", "zoo"), classes.filter("prefix <> ''"), stems, augments=("o",)).collect()
    assert sorted((r.form, r.nc, r.prefix, r.stem, r.score) for r in some) == [("ing", "NC1", "", "ing", 0.30), ("othing", "NC1", "th", "ing", 0.95), ("othing", "NC3", "t", "hing", 0.2)]
    tables = M.NounTables({"noun_classes": {"NC1": {"prefix": "th-"}, "NC3": {"prefix": ["t-"]}}}, {"ing": ("x", "NC1", True)}, ("o",))
    assert [(x[0], x[3]) for x in tables.analyse("othing")] == [("NC1", 0.95), ("NC3", 0.2)] and tables.analyse("ing") == [("NC1", "", "ing", 0.30, True)]


def test_every_form_and_nested_tense_counts():
    data = {"noun_classes": {"NC1": {"prefix": ["mu-", "mw-"], "allomorphs": ["m-"]}, "NC9": {"prefix": "∅"}}, "concords": {"subject_concords": {"NC1": ["u", "a"], "notes": "x"}, "object_concords": {"NC1": "mu"}}, "tam": {"PST": {"REC": {"form": "a"}, "REM": {"forms": ["aka", "ka"]}}, "PRS": {"form": "la"}}, "extensions": {"APPL": {"form": "-il-", "allomorphs": ["-el-"]}}, "slots": {}}
    t = G.annotation_tables(data)
    assert t["classes"] == [("NC1", ["mu", "mw", "m"]), ("NC9", [""])] and t["subjects"] == [("NC1", ["u", "a"])]
    assert t["tam"] == [("PST.REC", ["a"]), ("PST.REM", ["aka", "ka"]), ("PRS", ["la"])] and t["extensions"] == [("APPL", ["il", "el"])]
    v = M.VerbTables(data, {"bon": ("see", True)}, negation=("ta",), final_vowels=(("a", "IND"),))
    assert {k: x[0] for k, x in v.parse("taakabonela")[0][1].items()} == {"NEG": "ta", "SM": "a", "TAM": "ka", "ROOT": "bon", "EXT": "el", "FV": "a"}
    assert v.best("ulabona")[0] == v.parse("ulabona")[0][0] and T.features_of("PST.HOD") == {"Tense": "Past"}


def test_slot_search_is_exhaustive():
    """With many prefixes to one slot, the best hypothesis isn't lost for its place in the search."""
    many = {f"K{i}": "b" * i for i in range(1, 30)}
    data = {"noun_classes": {"NC1": {"prefix": "x"}}, "concords": {"subject_concords": many, "object_concords": many}, "tam": {k: {"form": f} for k, f in many.items()}, "extensions": {}, "slots": {n: {"position": i, "allowed_content_types": [t], "obligatory": n != "OM"} for i, (n, t) in enumerate((("SM", "concords.subject_concords"), ("TAM", "tam"), ("OM", "concords.object_concords"), ("ROOT", "verb_root"), ("FV", "final_vowel")))}}
    p, word = M.SlotParser(data, final_vowels=(("a", "IND"),)), "b" * 30 + "roota"
    every = [(i, j, k) for i in range(30) for j in range(30) for k in range(30) if i + j + k <= 30]
    best = max((p.score(word, {"ROOT": ("b" * (30 - i - j - k) + "root", ""), "FV": ("a", ""), **{s: ("b" * n, "") for s, n in zip(("SM", "TAM", "OM"), (i, j, k)) if n}}, ["SM", "TAM", "OM", "ROOT", "FV"][0:0] or [s for s, n in zip(("SM", "TAM", "OM", "ROOT", "FV"), (i, j, k, 1, 1)) if n]) for i, j, k in every[:: 37]))
    assert p.analyse(word)[0][0] >= best


def test_phonology(spark):
    assert value(spark, M.forward(F.col("x")), x="ci|a|lya|a") == "calya"
    assert value(spark, M.forward(F.col("x"), M.TWO_LEVEL), x="bon|i|a") == "bonea"
    assert value(spark, M.trace(F.col("x")), x="ba|ona") == [1]
    assert value(spark, M.join_parts([F.col("a"), F.col("b"), F.col("c")]), a="mu", b="ana", c="inga") == "mwanenga"
    assert value(spark, M.elided(F.col("a"), F.col("b")), a="kala", b="oko") == "kal"
    assert value(spark, M.extension_form(F.col("e"), F.col("r")), e="APPL", r="bon") == "el"


def test_conjugated(spark):
    cells = spark.createDataFrame([("ndi", "la", "bona", None, "a", "i", "aff"), ("ndi", "la", "bona", "APPL", "a", "i", "neg")], "sm string, marker string, root string, ext string, fv string, neg_fv string, polarity string")
    assert [r.surface for r in M.conjugated(cells).collect()] == ["ndilabona", "tandiboneli"]


def test_small_functions(spark):
    assert value(spark, M.tam_gloss(F.col("a"), F.col("b"), F.col("c")), a="present", b="perfective", c="indicative") == "PRS.PFV"
    x = value(spark, M.fst_tags(F.col("t")), t="bona+V+SM1+PRES+FV<0.5>")
    assert x.lemma == "bona" and x.kinds == ["category", "subject_concord", "tam", "final_vowel"] and not x.failed
    r = M.fst_lookup(spark.createDataFrame([("a\ta+N\t2.0",), ("a\ta+V\t1.0",), ("b\tb+?",)], "line string")).collect()
    assert {(i.surface, i.rank): i.analysis for i in r}["a", 1] == "a+V" and [i.parsed.failed for i in r if i.surface == "b"] == [True]
    assert spark.sql("select date'2024-03-05' d").select(M.word_of_day(F.col("d"), 7).alias("x")).first().x == 20240305 % 7
    q = M.quiz(spark.createDataFrame([(f"w{i}", f"g{i}") for i in range(6)], "word string, gloss string"))
    assert all(x.answer in x.options and len(set(x.options)) == 4 for x in q.collect()) and q.collect() == q.collect()


def analysed(spark, rows):
    """Tokens with given values of the analysis."""
    names = [c.split()[0] for c in M.ANALYSIS.split(", ")]
    return spark.createDataFrame([(s, p, f, t, *((x or {}).get(k) for k in names)) for s, p, f, t, x in rows], "sent int, pos int, form string, type string, " + M.ANALYSIS)


def noun(nc, score=0.2, known=False, stem="x"):
    return {"nc": nc, "nc_score": score, "known": known, "stem": stem, "nc_prefix": "p"}


def verb(score=0.8, **own):
    return {"score": score, "root": "at", "known": True, **own}


def test_tagging(spark):
    t = T.tagged(analysed(spark, [
        (1, 1, "thha", "word", noun("NC1", 0.95, True, "ha")), (1, 2, "theaated", "word", verb(sm="th", sm_class="NC1", tam="ea", tam_id="PRES", ext="ed", ext_id="PASS", fv="e", fv_id="IND")), (1, 3, ".", "punct", None), (1, 4, "12", "number", None),
        (1, 5, "the", "word", None), (1, 6, "paha", "word", noun("NC16")), (1, 7, "zzz", "word", None), (1, 8, "paat", "word", verb(0.28, sm_class="NC16")), (1, 9, "hoat", "word", verb(0.3, sm_class="NC15", fv_id="IND")),
        (1, 10, "unna", "word", verb(0.3, neg="un", sm_class="1PL", fv_id="PERF")), (1, 11, "bon", "code_switch", None), (1, 12, "weak", "word", verb(0.1, sm_class="NC3")), (1, 13, "and", "word", noun("NC2")), (1, 14, "€", "special", None),
    ]))
    got = {r.pos: r for r in t.collect()}
    assert [got[i].upos for i in range(1, 15)] == ["NOUN", "VERB", "PUNCT", "NUM", "DET", "NOUN", "X", "ADP", "VERB", "VERB", "X", "VERB", "NOUN", "SYM"]
    assert [got[i].flag for i in (1, 2, 3, 5, 7, 12)] == ["class", "parsed", "special", "closed", "untagged", "weak"]
    assert got[2].feats == "Aspect=Imp|Mood=Ind|Number=Sing|Person=3|SlotScore=0.80|Tense=Pres|VerbForm=Fin|Voice=Pass" and got[2].lemma == "at" and got[2].xpos == "VERB.FIN.PRES.3SG.PASS"
    assert got[1].feats == "NounClass=Bantu1|Number=Sing" and got[1].xpos == "NOUN.NC1.SING" and got[1].lemma == "ha" and got[6].lemma == "paha"
    assert got[9].feats == "SlotScore=0.30|VerbForm=Inf|Voice=Act" and got[8].xpos == "ADP.LOC.NC16" and got[11].xpos == "X.CS"
    assert got[10].feats == "Aspect=Perf|Mood=Ind|Number=Plur|Person=1|Polarity=Neg|SlotScore=0.30|VerbForm=Fin|Voice=Act"
    assert {r.pos: r.agrees for r in T.last_noun(t, "sent").collect()}[2] is True
    assert [value(spark, f(F.col("x")), x="NC12") for f in (T.number_of, T.number_by_suffix)] == ["Sing", "Plur"]


def test_links(spark):
    t = T.tagged(analysed(spark, [
        (1, 1, "a", "word", noun("NC1")), (1, 2, "b", "word", verb(sm_class="NC1", om_class="NC3", neg="un")), (1, 3, "c", "word", noun("NC1", 0.9, True)), (1, 4, "d", "word", noun("NC3")), (1, 5, "e", "word", verb(sm_class="NC7", om_class="NC3")),
        (2, 1, "f", "word", noun("NC7")), (2, 2, "g", "word", verb(sm_class="NC3")),
    ])).withColumn("upos", F.when(F.col("form") == "c", "DET").otherwise(F.col("upos")))
    linked = T.linked(t, ["sent"])
    rows = sorted((x.sent, x.kind, x.nc, x.gov_pos, x.noun_pos, x.dist, x.score) for x in T.link_rows(linked, ["sent"]).collect())
    # of two equally near nouns the one in the lexicon; an object after the verb before a nearer one before it; a sentence's end ends the search
    assert rows == [(1, "mod", "NC1", 3, 1, 2, 0.46), (1, "obj", "NC3", 2, 4, 2, 0.477), (1, "obj", "NC3", 5, 4, 1, 0.518), (1, "subj", "NC1", 2, 3, 1, 0.652)]
    got = {(r.sent, r.pos): r.l.split("\t") for r in T.with_links(linked, ["sent"]).select("sent", "pos", T.conllu_line().alias("l")).collect()}
    assert all(len(x) == 10 for x in got.values()) and got[1, 4][8] == "2:obj|5:obj" and got[1, 3][8] == "2:nsubj"
    assert {"AgreeNC=NC3", "AgreeObj=4", "AgreeSubj=3", "ChainScore=0.565"} <= {*got[1, 2][9].split("|")} and {"AgreeVerbObj=5", "AgreeNC=NC3"} <= {*got[1, 4][9].split("|")}
    assert got[2, 2][8] == "_"


def test_one_pass_annotation_gives_the_same(spark):
    """Whole sentences in one pass against tokens that are analysed, tagged and linked step by step."""
    rng = random.Random(3)
    part = [f for k in ("subjects", "objects", "tam", "extensions", "classes") for _, fs in G.annotation_tables(G.LEXEME)[k] for f in fs] + [*G.VERB_ROOTS, *G.NOUN_STEMS, "e", "a", "ing", "un"]
    nouns = [p + s for _, ps in G.annotation_tables(G.LEXEME)["classes"] for p in ps for s in G.NOUN_STEMS]
    verbs = [s + t + r + "e" for _, ss in G.annotation_tables(G.LEXEME)["subjects"] for s in ss for t in ("", "ea", "ou") for r in ("at", "on")]
    word = lambda: rng.choice([rng.choice(nouns), rng.choice(verbs), "".join(rng.choice(part) for _ in range(rng.randrange(1, 5)))])
    rows = [(i, [rng.choice([word(), word(), word(), "the", ".", "12", "XIV", "Ünd", "a|b", "€", ""]) for _ in range(rng.randrange(0, 14))]) for i in range(800)] + [(900, None)]
    sents = spark.createDataFrame(rows, "sent int, forms array<string>")
    v, n = M.VerbTables(G.LEXEME, G.VERB_ROOTS), M.NounTables(G.LEXEME, G.NOUN_STEMS)
    own = A.Annotator(v, n)
    flat = A.tokens(sents, own)
    again = T.tagged(M.analysed_tokens(flat.select("sent", "pos", "form", "type"), v, n)).select(flat.columns)
    key = lambda df: sorted(map(repr, df.collect()))
    assert flat.count() == sum(len(x or ()) for _, x in rows) and key(flat) == key(again)
    linked = T.linked(again, ["sent"])
    links = A.links(sents, own)
    assert links.count() > 50 and key(links) == key(T.link_rows(linked, ["sent"]).select(links.columns))
    lines = T.with_links(linked, ["sent"]).groupBy("sent").agg(F.array_sort(F.collect_list(F.struct("pos", T.conllu_line().alias("line")))).alias("l")).select("sent", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("lines"))
    assert key(A.conllu(sents, own)) == key(lines)
    with pytest.raises(ValueError, match="already there"):
        A.tokens(sents.withColumn("upos", F.lit(1)), own)


def test_unions_and_overlaps(spark):
    a = spark.createDataFrame([("w", "a-b", 0.5), ("w", "ab", 0.2)], "form string, segmentation string, score double")
    b = spark.createDataFrame([("w", "a-b", 0.7)], "form string, segmentation string, score double")
    assert [(r.segmentation, r.score, r.rank) for r in M.hypothesis_union(a, b).orderBy("rank").collect()] == [("a-b", 0.7, 1), ("ab", 0.2, 2)]
    s = spark.createDataFrame([(1, 0, 3), (1, 3, 5)], "k int, start int, stop int")
    assert M.overlapping(s, s, ["k"]).count() == 2


def test_failures_and_totals(spark):
    """A form that can't be analysed is a row that says so."""

    class Broken(M.NounTables):
        def analyse(self, form):
            if form == "boom":
                raise ZeroDivisionError("x")
            return super().analyse(form)

    own = A.Annotator(M.VerbTables(G.LEXEME, G.VERB_ROOTS), Broken(G.LEXEME, G.NOUN_STEMS))
    e = own("boom")
    assert e.tags[:2] == ("X", "failed") and e.misc == ("AnnotationFailed=ZeroDivisionError",) and own("boom") is e
    tokens = spark.createDataFrame([(1, "a", "word", "parsed"), (1, ".", "punct", "special"), (2, "boom", "word", "failed"), (None, "A", "word", "parsed")], "sent int, form string, type string, flag string")
    parses = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.5), ("b", 1, 0.3)], "form string, hyp int, score double")
    assert A.totals(tokens.fillna(0), ["sent"], parses).first().asDict() == {"sentences": 3, "tokens": 4, "words": 3, "ambiguous": 2, "failed": 1}
    assert A.totals(tokens.limit(0), ["sent"]).first().tokens == 0


def test_phonology_of_a_grammar(spark):
    data = {"phonology": {"sandhi_rules": [{"id": "SND.1", "pattern": r"t\|i", "replacement": "si"}, {"id": "bad", "pattern": "("}, "u_glide_formation", "SND.2", "nasal_assimilation"], "vowel_harmony_rules": ["height_harmony"], "nasal_prefixes": ["n-", "iŋ-"]}}
    rules = M.phonology_rules(data)
    assert [r[0] for r in rules[:8]] == ["SND.1", "u_glide_formation", "u_glide_formation", "nasal_assimilation", "height_harmony:E", "height_harmony:O", "nasal:iŋ", "nasal:n"] and len(rules) == 8 + len(M.RULES)
    own = [r[1:] for r in rules]
    assert [value(spark, M.forward(F.col("x"), own), x=x) for x in ("mu|ana", "kat|ile", "bek|a", "n|dima")] == ["mwana", "kasile", "beke", "ndima"]
    assert M.phonology_rules({})[0][0] == "common:1"


def test_morpheme_key(spark):
    cells = spark.createDataFrame([("ndi", "", "bona", "APPL", "a", "i", "aff"), ("ndi", "la", "bona", None, "a", "i", "neg")], "sm string, marker string, root string, ext string, fv string, neg_fv string, polarity string")
    got = [[(s.label, s.value) for s in r.slots] for r in M.morpheme_key(cells).collect()]
    assert got == [[("subject", "ndi-"), ("tense", "∅"), ("root", "-bona-"), ("extension", "-el-"), ("final vowel", "-a")], [("negation", "ta-"), ("subject", "ndi-"), ("root", "-bona-"), ("final vowel", "-i")]]
    assert [(s.label, s.value) for s in M.morpheme_key(cells, "sa", infix=True).collect()[1].slots][:2] == [("subject", "ndi-"), ("negation", "-sa-")]
