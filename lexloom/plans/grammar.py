"""Queries over grammar tables: forms, concords, comparison, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grammar as G
from ..operators import morph as M
from ..operators import paradigm as P
from .registry import query, quoted

Q = quoted
ROWS = {lang: G.rows(lang, data) for lang, data in G.GRAMMARS.items()}
EAV = [r for lang in ROWS for r in G.eav(lang, ROWS[lang])]


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]" + ("::VARCHAR[]" if not v else "")
    return str(v) if isinstance(v, (bool, int, float)) else Q(str(v))


def values(table: str) -> str:
    """A grammar table as a SQL source."""
    rows = EAV if table == "g_eav" else [r for g in ROWS.values() for r in g[table]]
    names = "lang, entity, id, field, value" if table == "g_eav" else ", ".join(c.split()[0] for c in G.TABLES[table].split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def tables(spark):
    return G.tables(spark, G.GRAMMARS)


TYPES = ["subject_concord", "object_concord", "possessive_concord", "adjective_concord"]
_CELLS = f"""(SELECT n.lang, n.nc, t.concord_type, coalesce(o.form, b.form) AS form, (o.form IS NULL AND b.form IS NOT NULL) AS is_fallback
    FROM {values('g_noun_class')} n JOIN (SELECT DISTINCT lang, concord_type FROM {values('g_concord')}) t USING (lang)
    LEFT JOIN {values('g_concord')} o ON o.lang = n.lang AND o.concord_type = t.concord_type AND o.key = n.nc
    LEFT JOIN {values('g_concord')} b ON b.lang = n.lang AND b.concord_type = t.concord_type AND b.key = CASE WHEN regexp_matches(n.nc, '^NC[0-9]+[a-z]$') THEN regexp_extract(n.nc, '^(NC[0-9]+)', 1) END)"""


@query(f"SELECT * FROM {_CELLS}")
def concord_fallback(spark, sf_dir):
    return P.all_concords(tables(spark))


@query(f"SELECT lang, nc, {', '.join(f'max(CASE WHEN concord_type = {Q(t)} THEN form END) AS {t}' for t in TYPES)} FROM {_CELLS} GROUP BY lang, nc")
def concord_crosstab(spark, sf_dir):
    return P.crosstab(tables(spark), TYPES)


@query(f"SELECT lang, concord_type, form FROM {values('g_concord')} WHERE key = 'NC7'")
def noun_paradigm(spark, sf_dir):
    return P.noun_paradigm(tables(spark), "NC7")


@query(f"SELECT lang, nc, prefix, CASE WHEN n = '' THEN 9999 ELSE n::INT END AS number, sg_of, pl_of FROM (SELECT *, regexp_extract(nc, '^NC([0-9]+)', 1) AS n FROM {values('g_noun_class')}) WHERE active")
def active_classes(spark, sf_dir):
    t = G.active_classes(tables(spark))
    return t.select("lang", "nc", "prefix", G.natural_order(F.col("nc"))[0].alias("number"), "sg_of", "pl_of")


@query(f"SELECT lang, path, value, note FROM {values('g_verify')} WHERE NOT resolved AND starts_with(path, 'noun')")
def verify_flags(spark, sf_dir):
    return G.verify_flags(tables(spark), "noun").select("lang", "path", "value", "note")


@query(f"SELECT lang, grade, list_sum([1 FOR x IN [min_v, max_v] IF x IS NOT NULL])::INT AS bounds FROM (SELECT lang, min_v, max_v, CASE WHEN list_transform(string_split(min_v, '.'), lambda x: x::INT) <= [1, 0, 0] AND list_transform(string_split(max_v, '.'), lambda x: x::INT) >= [1, 0, 0] THEN 'ok' ELSE 'out' END AS grade FROM {values('g_metadata')})")
def version_range(spark, sf_dir):
    part = lambda c: F.transform(F.split(c, r"\."), lambda x: x.cast("int"))
    now = F.array(*(F.lit(x) for x in G.VERSION))
    ok = (part("min_v") <= now) & (part("max_v") >= now)
    return tables(spark)["g_metadata"].select("lang", F.when(ok, "ok").otherwise("out").alias("grade"), F.size(F.array_compact(F.array("min_v", "max_v"))).alias("bounds"))


@query(f"SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.id, b.id) AS id, coalesce(a.field, b.field) AS field, a.value AS a, b.value AS b, CASE WHEN b.lang IS NULL THEN 'a_only' WHEN a.lang IS NULL THEN 'b_only' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'same' ELSE 'different' END AS status FROM (SELECT * FROM {values('g_eav')} WHERE lang = 'lexa') a FULL JOIN (SELECT * FROM {values('g_eav')} WHERE lang = 'lexb') b ON a.entity = b.entity AND a.id = b.id AND a.field = b.field")
def grammar_diff(spark, sf_dir):
    return P.diff(tables(spark), "lexa", "lexb")


@query(f"WITH d AS (SELECT a.entity AS ea, b.entity AS eb, a.value AS a, b.value AS b FROM (SELECT * FROM {values('g_eav')} WHERE lang = 'lexa') a FULL JOIN (SELECT * FROM {values('g_eav')} WHERE lang = 'lexb') b ON a.entity = b.entity AND a.id = b.id AND a.field = b.field) SELECT CASE WHEN eb IS NULL THEN 'a_only' WHEN ea IS NULL THEN 'b_only' WHEN a IS NOT DISTINCT FROM b THEN 'same' ELSE 'different' END AS status, count(*) AS n FROM d GROUP BY 1")
def grammar_diff_counts(spark, sf_dir):
    return P.diff(tables(spark), "lexa", "lexb").groupBy("status").agg(F.count("*").alias("n"))


def _inventory() -> str:
    one = lambda k: f"SELECT {Q(k)} AS kind, array_to_string(list_sort(list_filter(a.{k}, lambda x: NOT list_contains(b.{k}, x))), ' ') AS a_only, array_to_string(list_sort(list_filter(b.{k}, lambda x: NOT list_contains(a.{k}, x))), ' ') AS b_only FROM (SELECT * FROM {values('g_phonology')} WHERE lang = 'lexa') a, (SELECT * FROM {values('g_phonology')} WHERE lang = 'lexb') b"
    return " UNION ALL ".join(map(one, ("vowels", "consonants", "nasal_prefixes")))


@query(_inventory())
def phonology_diff(spark, sf_dir):
    return P.inventory_diff(tables(spark), "lexa", "lexb")


_FACTS = f"(SELECT *, CASE lang WHEN 'lexa' THEN 0 ELSE 1 END AS o FROM {values('g_eav')})"


@query(
    f"WITH v AS (SELECT entity, id, field, value, count(*) AS n, min(o) AS o, list(lang) AS w FROM {_FACTS} WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT entity, id, field, arg_max(struct_pack(v := value, w := w), n * 10 - o) AS m, count(*) <= 1 AS uniform FROM v GROUP BY ALL) SELECT entity, id, field, m.v AS mode, uniform, array_to_string(list_sort(list_filter(['lexa', 'lexb'], lambda x: NOT list_contains(m.w, x))), ' ') AS divergent FROM m"
)
def feature_compare(spark, sf_dir):
    return P.compared(tables(spark), ["lexa", "lexb"])


_PATHS = ["nc.NC1.prefix", "tam.PAST.form", "concords.subject_concord.NC7", "slot.SM.position", "nc.NC99.prefix", "nonsense"]


@query(
    f"WITH p AS (SELECT path, string_split(path, '.') AS s FROM (VALUES {', '.join(f'({Q(p)})' for p in _PATHS)}) v(path)), a AS (SELECT path, CASE s[1] WHEN 'nc' THEN 'noun_class' WHEN 'concords' THEN 'concord' ELSE s[1] END AS entity, s[2] AS id, s[3] AS field, len(s) = 3 AS good FROM p) SELECT l.lang, a.path, e.value, CASE WHEN NOT good THEN 'error' WHEN e.lang IS NOT NULL THEN 'found' ELSE 'missing' END AS state FROM a CROSS JOIN (SELECT lang FROM {values('g_metadata')}) l LEFT JOIN {values('g_eav')} e ON e.lang = l.lang AND e.entity = a.entity AND e.id = a.id AND e.field = a.field"
)
def feature_paths(spark, sf_dir):
    return P.resolve_paths(spark.createDataFrame([(p,) for p in _PATHS], "path string"), tables(spark))


@query(f"SELECT lang, nc, 'Bantu' || regexp_extract(nc, '^NC([0-9]+)', 1) AS feature, CASE WHEN sg_of IS NOT NULL THEN 'Sing' WHEN pl_of IS NOT NULL THEN 'Plur' END AS number FROM {values('g_noun_class')}")
def ud_noun_classes(spark, sf_dir):
    return P.ud_classes(tables(spark))


@query(f"SELECT lang, tam_id, concat_ws('|', CASE aspect WHEN 'imperfective' THEN 'Aspect=Imp' WHEN 'perfective' THEN 'Aspect=Perf' END, CASE mood WHEN 'indicative' THEN 'Mood=Ind' WHEN 'subjunctive' THEN 'Mood=Sub' END, CASE tense WHEN 'present' THEN 'Tense=Pres' WHEN 'past' THEN 'Tense=Past' WHEN 'future' THEN 'Tense=Fut' END) AS feats FROM {values('g_tam')}")
def ud_tam(spark, sf_dir):
    return P.ud_tam(tables(spark))


@query(f"SELECT DISTINCT c.lang, c.key, CASE WHEN regexp_matches(c.key, '^[123]') THEN c.key[1] WHEN starts_with(c.key, 'NC') THEN '3' END AS person, CASE WHEN c.key LIKE '%SG' THEN 'Sing' WHEN c.key LIKE '%PL' THEN 'Plur' WHEN n.sg_of IS NOT NULL THEN 'Sing' WHEN n.pl_of IS NOT NULL THEN 'Plur' END AS number, 'Bantu' || regexp_extract(n.nc, '^NC([0-9]+)', 1) AS feature FROM {values('g_concord')} c LEFT JOIN {values('g_noun_class')} n ON n.lang = c.lang AND n.nc = c.key")
def ud_concord_keys(spark, sf_dir):
    return P.ud_concords(tables(spark))


_ROOT = "bona"


def _join(a: str, b: str) -> str:
    x, y = f"right({a}, 1)", f"left({b}, 1)"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN {a} || {b} WHEN {x} = 'u' AND {y} IN ('a','e','i','o','u') THEN left({a}, length({a}) - 1) || 'w' || {b} WHEN {x} = 'i' AND {y} IN ('a','e','i','o','u') THEN left({a}, length({a}) - 1) || 'y' || {b} WHEN {x} || {y} = 'ai' THEN left({a}, length({a}) - 1) || 'e' || substr({b}, 2) WHEN {x} || {y} = 'au' THEN left({a}, length({a}) - 1) || 'o' || substr({b}, 2) WHEN {x} || {y} IN ('aa', 'ae', 'ao') THEN left({a}, length({a}) - 1) || {b} ELSE {a} || {b} END)"


@query(
    f"""WITH c AS (SELECT s.lang, s.key AS subject, t.tam_id, p AS polarity, CASE WHEN p = 'neg' THEN 'ta' ELSE '' END AS p0, s.form AS p1, CASE WHEN p = 'neg' THEN '' ELSE t.form END AS p2, 'bon' AS p3, CASE WHEN p = 'neg' THEN 'i' WHEN t.mood = 'subjunctive' THEN 'e' ELSE 'a' END AS p4
    FROM {values('g_concord')} s JOIN {values('g_tam')} t USING (lang), (VALUES ('aff'), ('neg')) v(p) WHERE s.concord_type = 'subject_concord'),
    j1 AS (SELECT *, {_join('p0', 'p1')} AS j FROM c), j2 AS (SELECT * EXCLUDE j, {_join('j', 'p2')} AS j FROM j1), j3 AS (SELECT * EXCLUDE j, {_join('j', 'p3')} AS j FROM j2)
    SELECT lang, subject, tam_id, polarity, {_join('j', 'p4')} AS surface FROM j3"""
)
def verb_paradigm(spark, sf_dir):
    return P.verb_paradigm(tables(spark), _ROOT)


@query(
    f"""WITH c AS (SELECT s.lang, s.key AS subject, t.tam_id, concat_ws('|', s.form, nullif(t.form, ''), 'bona', CASE WHEN t.mood = 'subjunctive' THEN 'e' ELSE 'a' END) AS underlying FROM {values('g_concord')} s JOIN {values('g_tam')} t USING (lang) WHERE s.concord_type = 'subject_concord')
    SELECT lang, subject, tam_id, underlying, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(underlying, '([aeiou])\\|([aeiou])', '\\2', 'g'), 'i\\|([aeiou])', 'y\\1', 'g'), 'u\\|([aeiou])', 'w\\1', 'g'), 'a\\|([aeiou])', '\\1', 'g'), '[nŋ]\\|b', 'mb', 'g'), '[nŋ]\\|d', 'nd', 'g'), '[nŋ]\\|g', 'ŋg', 'g'), '|', '') AS surface FROM c"""
)
def generate_forms(spark, sf_dir):
    cells = P.verb_cells(tables(spark), _ROOT).filter("polarity = 'aff'")
    return P.generated(cells).select("lang", "subject", "tam_id", "underlying", "surface")


@query(f"SELECT lang, tam_id, concat_ws('.', CASE tense WHEN 'present' THEN 'PRS' WHEN 'past' THEN 'PST' WHEN 'future' THEN 'FUT' END, CASE aspect WHEN 'imperfective' THEN 'IPFV' WHEN 'perfective' THEN 'PFV' END, CASE mood WHEN 'subjunctive' THEN 'SBJV' END) AS gloss FROM {values('g_tam')}")
def tam_glosses(spark, sf_dir):
    return tables(spark)["g_tam"].select("lang", "tam_id", M.tam_gloss(F.col("tense"), F.col("aspect"), F.col("mood")).alias("gloss"))


#: Assignments with one fault or more each; case 1 is good.
CASES = [
    (1, 1, "SM", "subject_concord", "th", "NC1", "NC1"), (1, 2, "ROOT", "verb_root", "bon", "see", None), (1, 3, "FV", "final_vowel", "a", "IND", None),
    (2, 1, "ROOT", "verb_root", "bon", "see", None), (2, 2, "SM", "subject_concord", "zz", "NC1", "NC1"), (2, 3, "XX", "verb_root", "q", "q", None),
    (3, 1, "SM", "subject_concord", "th", "NC1", "NC1"), (3, 2, "SM", "subject_concord", "an", "NC2", "NC2"), (3, 3, "OM", "object_concord", "qq", "NC1", "NC1"), (3, 4, "ROOT", "tam", "bon", "see", None), (3, 5, "FV", "final_vowel", "a", "IND", None),
    (4, 1, "SM", "subject_concord", "th", "NC1", "NC1"), (4, 2, "ROOT", "verb_root", "bon", "see", None), (4, 3, "EXT", "extension", "ed", "PASS", None), (4, 4, "EXT", "extension", "in", "RECP", None), (4, 5, "EXT", "extension", "st", "CAUS", None), (4, 6, "EXT", "extension", "or", "APPL", None), (4, 7, "FV", "final_vowel", "a", "IND", None),
    (5, 1, "NEG", "negation", "un", "NEG", None), (5, 2, "NEG", "negation", "in", "NEG", None), (5, 3, "SM", "subject_concord", "an", "NC2", "NC2"), (5, 4, "ROOT", "verb_root", "bon", "see", None), (5, 5, "EXT", "extension", "xx", "NONE", None), (5, 6, "EXT", "extension", "st", "CAUS", None), (5, 7, "EXT", "extension", "or", "APPL", None), (5, 8, "FV", "final_vowel", "a", "IND", None),
]
CASE_SCHEMA = "case_id int, idx int, slot_id string, content_type string, form string, gloss string, nc string"


def _violations() -> str:
    a = f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in CASES)}) v(case_id, idx, slot_id, content_type, form, gloss, nc))"
    slots, ext = f"(SELECT slot_id, position, obligatory, types FROM {values('g_slot')} WHERE lang = 'lexa')", f"(SELECT ext_id AS gloss, zone, ord FROM {values('g_extension')} WHERE lang = 'lexa')"
    rank = "CASE gloss " + " ".join(f"WHEN {Q(x)} THEN {i}" for i, x in enumerate(P.GRAMMAR_RULES["order"])) + " END"
    forms = lambda kind: f"SELECT form FROM {values('g_concord')} WHERE lang = 'lexa' AND starts_with(concord_type, {Q(kind)})"
    pick = lambda rule, source, where="true": f"SELECT case_id, {Q(rule)} AS rule, slot_id, form FROM {source} WHERE {where}"
    return f"""WITH a AS (SELECT a.*, s.position, s.types FROM {a} a LEFT JOIN {slots} s USING (slot_id)),
    o AS (SELECT *, lag(position) OVER (PARTITION BY case_id ORDER BY idx) AS before, row_number() OVER (PARTITION BY case_id, slot_id ORDER BY idx) AS k FROM a),
    e AS (SELECT a.*, x.zone, {rank.replace('gloss', 'a.gloss')} AS rank FROM a LEFT JOIN {ext} x USING (gloss) WHERE content_type = 'extension'),
    f AS (SELECT *, last_value(zone IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS zone_before, lag(rank) OVER (PARTITION BY case_id, zone ORDER BY idx) AS rank_before, count(*) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY idx DESC) AS last FROM e),
    g AS (SELECT case_id, count(*) AS n FROM a WHERE content_type = 'negation' GROUP BY 1)
    SELECT c.case_id, 'OBLIG_SLOT_MISSING' AS rule, s.slot_id, NULL AS form FROM (SELECT DISTINCT case_id FROM a) c, {slots} s WHERE s.obligatory AND NOT EXISTS (SELECT 1 FROM a WHERE a.case_id = c.case_id AND a.slot_id = s.slot_id AND a.form <> '')
    UNION ALL {pick('SLOT_DUPLICATE', 'o', "k > 1 AND content_type <> 'extension'")} UNION ALL {pick('UNKNOWN_SLOT', 'a', 'position IS NULL')} UNION ALL {pick('CONTENT_TYPE_MISMATCH', 'a', 'position IS NOT NULL AND NOT list_contains(types, content_type)')}
    UNION ALL {pick('SLOT_OUT_OF_ORDER', 'o', 'position < before')} UNION ALL {pick('INVALID_SUBJECT_CONCORD', 'a', f"content_type = 'subject_concord' AND form NOT IN ({forms('subject_concord')})")} UNION ALL {pick('INVALID_OBJECT_CONCORD', 'a', f"content_type = 'object_concord' AND form NOT IN ({forms('object_concord')})")}
    UNION ALL {pick('INVALID_EXTENSION', 'f', 'zone IS NULL')} UNION ALL {pick('EXT_MAX_EXCEEDED', 'f', 'n > 3 AND last = 1')} UNION ALL {pick('EXT_TYPICAL_MAX_EXCEEDED', 'f', 'n > 2 AND n <= 3 AND last = 1')} UNION ALL {pick('EXT_ZONE_ORDER', 'f', 'zone < zone_before')} UNION ALL {pick('EXT_INTRA_ZONE_ORDER', 'f', 'rank < rank_before')}
    UNION ALL SELECT e.case_id, 'EXT_INCOMPATIBLE' AS rule, e.slot_id, e.form FROM e JOIN e x ON x.case_id = e.case_id AND e.gloss = 'CAUS' AND x.gloss = 'RECP' UNION ALL {pick('EXT_PASS_NOT_FINAL', 'f', "gloss = 'PASS' AND last > 1")}
    UNION ALL SELECT case_id, 'NEG_EXCLUSIVE' AS rule, NULL AS slot_id, NULL AS form FROM g WHERE n > 1
    UNION ALL SELECT e.case_id, 'RECIP_REQUIRES_PLURAL' AS rule, e.slot_id, e.form FROM e JOIN a ON a.case_id = e.case_id AND a.content_type = 'subject_concord' WHERE e.gloss = 'RECP' AND NOT (a.nc LIKE '%PL' OR a.nc IN ('NC2', 'NC4', 'NC6', 'NC8', 'NC10', 'NC13'))"""


@query(_violations())
def slot_validate(spark, sf_dir):
    return P.violations(spark.createDataFrame(CASES, CASE_SCHEMA), tables(spark), "lexa", P.GRAMMAR_RULES)
