from __future__ import annotations

import pytest

from lexloom.operators import grammar as G
from lexloom.operators import paradigm as P


@pytest.fixture(scope="module")
def tables(spark):
    return {k: v.cache() for k, v in G.tables(spark, G.GRAMMARS).items()}


def test_layouts_agree():
    own = G.LEXEME
    production = {"metadata": own["metadata"], "noun_class_system": {"noun_classes": own["noun_classes"]}, "concord_system": {"concords": own["concords"]}, "verb_system": {"verbal_system_components": {"tam": own["tam"], "derivational_extensions": own["extensions"]}, "verb_slots": own["slots"]}}
    for other in ({"lexa": own}, production):
        a, b = G.rows("x", own), G.rows("x", other)
        assert all(a[t] == b[t] for t in ("g_noun_class", "g_concord", "g_tam", "g_extension", "g_slot"))


def test_problems():
    assert [p for p in G.problems(G.LEXEME) if p[0] == "error"] == []
    bad = G.LEXEME | {"metadata": {"language": "x", "grammar_version": "one", "min_loader_version": "3.0", "max_loader_version": "2.0"}, "odd": 1}
    found = {(p, s) for s, p, _ in G.problems(bad)}
    assert ("metadata.iso_code", "error") in found and ("odd", "warning") in found and ("metadata", "error") in found
    with pytest.raises(G.GrammarError):
        G.load(bad)
    with pytest.raises(G.UnresolvedFlags):
        G.load(G.SISTER, strict=True)
    with pytest.raises(G.UnknownLanguage):
        G.load(G.LEXEME, lang="other")
    assert G.load(G.SISTER) is G.SISTER
    assert G.semver("1") == (1, 0, 0) and G.in_range("1.2", "1.0", "2") and not G.in_range("0.9", "1.0", None)


def test_small_helpers(tmp_path):
    assert G.without_keys({"a": 1, "b": {"a": 2, "c": [{"a": 3}]}}, {"a"}) == {"b": {"c": [{}]}}
    assert sorted(["NC10", "NC1a", "NC1", "x"], key=G.natural) == ["NC1", "NC1a", "NC10", "x"]
    assert G.stripped("li- VERIFY: unsure") == "li-" and G.flags({"a": ["b VERIFY: c"]}) == [("a.0", "b", "c")]
    assert G.content("concords.subject_concords") == "subject_concord"
    f = tmp_path / "g.yaml"
    f.write_text("- 1\n")
    with pytest.raises(G.GrammarError):
        G.read(str(f))
    assert G.schema_differences({"metadata": {"language": "x"}})["missing"]


def test_concords_and_crosstab(tables):
    cells = {(r.lang, r.nc, r.concord_type): (r.form, r.is_fallback) for r in P.all_concords(tables).collect()}
    assert cells["lexa", "NC1a", "subject_concord"] == ("th", True) and cells["lexa", "NC7", "adjective_concord"] == ("coe", False)
    assert cells["lexa", "NC15", "object_concord"] == (None, False)
    wide = P.crosstab(tables, ["subject_concord", "object_concord"])
    assert wide.count() == 19 and wide.columns == ["lang", "nc", "subject_concord", "object_concord"]


def test_rendering(tables):
    t = P.noun_paradigm(tables, "NC7")
    assert P.rendered(t, "csv").startswith("lang,concord_type,form\n") and "| lexa |" in P.rendered(t, "markdown")
    assert "<td>co</td>" in P.rendered(t, "html") and "lexa  " in P.rendered(t, "text")
    with pytest.raises(ValueError):
        P.rendered(t, "pdf")


def test_compare(tables, spark):
    d = {(r.entity, r.id, r.field): r.status for r in P.diff(tables, "lexa", "lexb").collect()}
    assert d["noun_class", "NC1", "prefix"] == "different" and d["noun_class", "NC5", "prefix"] == "b_only" and d["tam", "FUT", "form"] == "a_only"
    c = {(r.entity, r.id, r.field): r for r in P.compared(tables, ["lexa", "lexb"]).collect()}
    assert c["noun_class", "NC1", "prefix"].mode == "th" and c["noun_class", "NC1", "prefix"].divergent == "lexb"
    assert c["noun_class", "NC5", "prefix"].uniform and c["noun_class", "NC5", "prefix"].divergent == "lexa"


def test_violations_of_a_good_case(tables, spark):
    from lexloom.plans.grammar import CASE_SCHEMA, CASES

    got = P.violations(spark.createDataFrame(CASES, CASE_SCHEMA), tables, "lexa", P.GRAMMAR_RULES).collect()
    rules = {r.rule for r in got}
    assert not [r for r in got if r.case_id == 1]
    assert len(rules) == 16, sorted(rules)
    assert P.violations(spark.createDataFrame([], CASE_SCHEMA), tables, "lexa", P.GRAMMAR_RULES).count() == 0
    assert P.slot_coverage(spark.createDataFrame(CASES, CASE_SCHEMA)).filter("slot_id = 'SM'").first().cases == 5


def test_ud(tables, spark):
    m = spark.createDataFrame([(1, 1, "Voice", "Appl"), (1, 2, "Voice", "Pass"), (1, 3, "Tense", "Pres"), (1, 4, "Tense", "Past")], "token int, pos int, feature string, value string")
    assert P.ud_tokens(m).first().feats == "Tense=Pres|Voice=Pass"
    from pyspark.sql import functions as F

    v = spark.createDataFrame([("PASS",), ("x causative y",), ("zzz",)], "e string").select(P.ud_voice(F.col("e")).alias("v"))
    assert [r.v for r in v.collect()] == ["Pass", "Caus", "Act"]
    tam = spark.createDataFrame([("A", 1, "PRS"), ("B", 0, "PRS")], "tam_id string, ord int, gloss string")
    got = {r.gloss: r.tam_id for r in P.tam_by_gloss(spark.createDataFrame([("PRS",), ("A",), ("?",)], "gloss string"), tam).collect()}
    assert got == {"PRS": "B", "A": "A", "?": None}


def test_lookups_that_raise():
    assert G.noun_class(G.LEXEME, "NC1")["prefix"] == "th" and G.concords(G.LEXEME, "object_concord")["NC2"] == "ti"
    with pytest.raises(G.NotFound, match="no class NC99; known: NC1,"):
        G.noun_class(G.LEXEME, "NC99")
    with pytest.raises(G.GrammarError, match="no concord type x"):
        G.concords(G.LEXEME, "x")


def test_registry(tmp_path):
    import yaml

    for name in ("lexa", "lexb"):
        (tmp_path / f"{name}.yaml").write_text(yaml.safe_dump(G.stripped(G.GRAMMARS[name]), allow_unicode=True))
    r = G.Registry({n: str(tmp_path / f"{n}.yaml") for n in ("lexa", "lexb")}, {"lexa": ("A",)})
    made = []
    classes = lambda g: (made.append(1), len(G.canonical(g)["noun_classes"]))[1]
    assert r.languages() == ["lexa", "lexb"] and r.get(" a ", "classes", classes) == r.get("lexa", "classes", classes) == len(G.LEXEME["noun_classes"]) and len(made) == 1
    r.forget("a")
    assert r.get("lexa", "classes", classes) and len(made) == 2 and r.get("lexa") is r.get("LEXA")
    with pytest.raises(G.UnknownLanguage):
        r.get("lexz")


def test_overlay():
    other = {"verb_system": {"verbal_system_components": {"tam": {"PAST": {"forms": ["-ka-", "x"]}, "NEW": {"forms": ["y"]}}, "negation_pre": {"present": {"forms": ["ta-"]}}, "negation_infix": {"negative": {"forms": "-sa-"}}}}}
    got = G.overlaid(G.LEXEME, other)
    assert G.rows("", got)["g_tam"][1][3] == "ka" and "NEW" not in got["tam"] and (got["negation"], got["negation_infix"]) == ("ta", "sa")
    assert G.rows("", G.LEXEME)["g_tam"][1][3] == "ou" and "negation" not in G.LEXEME


def test_extension_order(spark):
    from lexloom.operators import paradigm as P

    t = G.tables(spark, {"lexa": G.LEXEME})
    cases = spark.createDataFrame([(1, ["APPL", "PASS"]), (2, ["PASS", "APPL"]), (3, ["CAUS", "RECP"]), (4, ["XX"]), (5, [])], "case_id int, ids array<string>")
    got = {(r.case_id, r.rule) for r in P.extension_order(cases, t, "lexa", G.LEXEME["extension_rules"]).collect()}
    assert got == {(2, "EXT_ZONE_ORDER"), (2, "EXT_PASS_NOT_FINAL"), (3, "EXT_INCOMPATIBLE"), (4, "INVALID_EXTENSION")}
