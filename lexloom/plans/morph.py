"""Queries of word analysis, tagging and agreement over the documents' tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..operators import annotate as A
from ..operators import grammar as G
from ..operators import morph as M
from ..operators import stats
from ..operators import tagging as T
from .grammar import lit
from .registry import query, quoted, table
from .segment import words

Q = quoted
_OWN = G.annotation_tables(G.LEXEME)
CLASSES = [(nc, i, p) for i, (nc, ps) in enumerate(_OWN["classes"]) for p in ps]
STEMS = [(root, nc, ok) for root, (_, nc, ok) in G.NOUN_STEMS.items()]
VERBS = [(root, gloss, ok) for root, (gloss, ok) in G.VERB_ROOTS.items()]
PREFIXES, SUFFIXES = [p for *_, p in CLASSES if p], [f for f, _ in G.FINAL_VOWELS]


def tables() -> tuple[M.VerbTables, M.NounTables]:
    """The library's own compact grammar and lexicon."""
    return M.VerbTables(G.LEXEME, G.VERB_ROOTS), M.NounTables(G.LEXEME, G.NOUN_STEMS)


def tokens(spark, sf_dir, *keys: str) -> DataFrame:
    """Words, in lower case: whatever is neither punctuation nor a number. A row stands for ``n`` of them; a word comes more than once."""
    chunks = S.chunk_counts(table(spark, sf_dir, "documents"), "text", *keys)
    w = chunks.select(*keys, F.explode(S.punct_tokens(F.col("chunk"))).alias("form"), "n")
    return w.filter(S.token_type(F.col("form"), strict=True) == "word").withColumn("form", F.lower("form"))


def forms(spark, sf_dir) -> DataFrame:
    """Every distinct word."""
    return tokens(spark, sf_dir).select("form").distinct()


_PUNCT = f"flatten(list_transform({words('text')}, lambda w: CASE WHEN regexp_matches(w, {Q(S.PROTECTED)}) THEN [w] ELSE regexp_extract_all(w, {Q(f'[{S.PUNCT}]|[^{S.PUNCT}]+')}) END))"
_TYPE = f"CASE WHEN regexp_matches(form, {Q(f'^[{S.PUNCT}]+$')}) THEN 'punct' WHEN regexp_matches(form, {Q(S.NUMBER)}) OR regexp_matches(form, {Q(S.STRICT_ROMAN)}) THEN 'number' ELSE 'word' END"
_TOKENS = f"(SELECT doc_id, lang, lower(form) AS form FROM (SELECT doc_id, lang, unnest({_PUNCT}) AS form FROM documents) WHERE {_TYPE} = 'word')"


def rows_sql(rows, names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names}))"


def _alt(forms) -> str:
    return M.longest_first(forms)


def pre(x: str, forms) -> str:
    return f"regexp_extract({x}, {Q(f'^({_alt(forms)})(.+)$')}, 1)"


def suf(x: str, forms) -> str:
    return f"regexp_extract({x}, {Q(f'^(.+?)({_alt(forms)})$')}, 2)"


_PRE, _SUF = pre("form", PREFIXES), suf("form", SUFFIXES)


@query(f"SELECT {_PRE} AS prefix, count(*) AS n FROM {_TOKENS} GROUP BY 1")
def prefix_longest(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy(M.prefix(F.col("form"), PREFIXES).alias("prefix")).agg(F.sum("n").alias("n"))


@query(f"SELECT {_SUF} AS suffix, count(*) AS n FROM {_TOKENS} GROUP BY 1")
def suffix_longest(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy(M.suffix(F.col("form"), SUFFIXES).alias("suffix")).agg(F.sum("n").alias("n"))


def lexicon(spark):
    return spark.createDataFrame(STEMS, "root string, nc string, verified boolean"), spark.createDataFrame(VERBS, "root string, gloss string, verified boolean")


_FORMS = f"(SELECT DISTINCT form FROM {_TOKENS})"
_PROBE = f"""(SELECT form, CASE WHEN n.root IS NOT NULL THEN 'noun' WHEN coalesce(v0.root, v1.root, v2.root, v3.root) IS NOT NULL THEN 'verb' END AS category, coalesce(n.root, v0.root, v1.root, v2.root, v3.root) AS lemma,
    CASE WHEN n.root IS NOT NULL THEN 0 WHEN v0.root IS NOT NULL THEN 0 WHEN v1.root IS NOT NULL THEN 1 WHEN v2.root IS NOT NULL THEN 2 WHEN v3.root IS NOT NULL THEN 3 ELSE -1 END AS cut FROM {_FORMS} f
    LEFT JOIN {rows_sql(STEMS, 'root, nc, verified')} n ON n.root = form LEFT JOIN {rows_sql(VERBS, 'root, gloss, verified')} v0 ON v0.root = form
    {' '.join(f"LEFT JOIN {rows_sql(VERBS, 'root, gloss, verified')} v{k} ON v{k}.root = left(form, length(form) - {k}) AND length(form) > {k}" for k in (1, 2, 3))})"""


@query(f"SELECT * FROM {_PROBE}")
def lexicon_probe(spark, sf_dir):
    return M.lexicon_probe(forms(spark, sf_dir), *lexicon(spark))


@query(f"SELECT lang, count(*) AS tokens, sum(CASE WHEN category IS NULL THEN 1 ELSE 0 END)::BIGINT AS oov, round(avg(CASE WHEN category IS NULL THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS oov_rate FROM {_TOKENS} JOIN {_PROBE} USING (form) GROUP BY lang")
def oov_rate(spark, sf_dir):
    """Forms are looked up where they were counted; only sums by language go through an exchange."""
    found = M.lexicon_probe(tokens(spark, sf_dir, "lang"), *lexicon(spark))
    n, oov = F.sum("n"), F.sum(F.when(F.col("category").isNull(), F.col("n")).otherwise(0))
    return found.groupBy("lang").agg(n.alias("tokens"), oov.alias("oov"), stats.ratio(oov, n, 4).alias("oov_rate"))


_STEMS, _CLASSES = rows_sql(STEMS, "root, nc, verified"), rows_sql(CLASSES, "nc, nc_order, prefix")
_NOUNS = f"""(SELECT form, rank, nc, prefix, stem, score, known FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, cand, length(prefix) DESC, nc_order)::INT AS rank FROM (
    SELECT form, cand, c.nc, c.nc_order, c.prefix, substr(word, length(c.prefix) + 1) AS stem, s.root IS NOT NULL AS known, round(CASE WHEN s.root IS NOT NULL THEN 0.50 ELSE 0 END + CASE WHEN s.nc = c.nc THEN 0.20 ELSE 0 END + CASE WHEN s.verified THEN 0.05 ELSE 0 END + CASE WHEN c.prefix <> '' THEN 0.15 ELSE 0 END + CASE WHEN length(word) - length(c.prefix) >= 2 THEN 0.05 ELSE 0 END, 2)::DOUBLE AS score
    FROM (SELECT form, 0 AS cand, form AS word FROM {{forms}} UNION ALL SELECT form, 1, substr(form, length(aug) + 1) FROM (SELECT form, {pre('form', G.AUGMENTS)} AS aug FROM {{forms}}) WHERE aug <> '') JOIN {_CLASSES} c ON starts_with(word, c.prefix) AND length(word) > length(c.prefix) LEFT JOIN {_STEMS} s ON s.root = substr(word, length(c.prefix) + 1))) WHERE rank <= 3)"""


@query(f"SELECT * EXCLUDE known FROM {_NOUNS.format(forms=_FORMS)}")
def noun_analysis_top3(spark, sf_dir):
    classes = spark.createDataFrame(CLASSES, "nc string, nc_order int, prefix string")
    return M.noun_analyses(forms(spark, sf_dir), classes, lexicon(spark)[0])


def _keyed(kind: str) -> list[tuple[str, str]]:
    """``(form, key)``, the longest first, as the parse tries them."""
    return sorted(((f, k) for k, fs in _OWN[kind] for f in fs), key=lambda x: -len(x[0]))


def _case(x: str, pairs) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {Q(k)} THEN {Q(v)}" for k, v in pairs) + " END"


def _first(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return list({f: (f, k) for f, k in reversed(pairs)}.values())


def verb_sql(forms: str) -> str:
    """The branches of the verb parse as a chain of unions: each slot filled by its longest form, or left empty; then scores and ranks.

    ``o1 .. o6`` keep the order in which the parse comes upon a hypothesis, which decides among equal scores.
    """
    sm = rows_sql([(f, k, i) for i, (k, fs) in enumerate(_OWN["subjects"]) for f in fs[:1]], "sm, sm_class, o2")
    tam = rows_sql([(f, k, i) for i, (f, k) in enumerate(_keyed("tam"))], "tam, tam_id, o3")
    om, ext, fv, neg = _keyed("objects"), _keyed("extensions"), list(G.FINAL_VOWELS), G.NEGATION
    cut = lambda x, f: f"substr({x}, length({f}) + 1)"
    ends = lambda x, f: f"left({x}, length({x}) - length({f}))"
    score = "round(" + " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {M.WEIGHTS[w]} ELSE 0 END" for c, w in (("neg", "NEG"), ("sm", "SM"), ("tam", "TAM"), ("om", "OM"), ("ext", "EXT"), ("fv", "FV"))) + f" + {M.WEIGHTS['whole']} + CASE WHEN v.root IS NOT NULL THEN {M.WEIGHTS['lexicon']} + CASE WHEN v.verified THEN {M.WEIGHTS['verified']} ELSE 0 END ELSE 0 END, 4)::DOUBLE"
    order = "score DESC, o1, o2, o3, o4, o5, o6"
    return f"""(WITH s0 AS (SELECT form, NULL AS neg, form AS r0, 0 AS o1 FROM {forms} WHERE form <> '' UNION ALL SELECT form, n, {cut('form', 'n')}, 1 FROM (SELECT form, {pre('form', neg)} AS n FROM {forms}) WHERE n <> ''),
    s1 AS (SELECT s0.*, sm, sm_class, coalesce(o2, 99) AS o2, CASE WHEN sm IS NULL THEN r0 ELSE {cut('r0', 'sm')} END AS r1 FROM s0 LEFT JOIN {sm} k ON starts_with(r0, sm) AND length(r0) > length(sm)),
    s2 AS (SELECT s1.*, tam, tam_id, o3, {cut('r1', 'tam')} AS r2 FROM s1 JOIN {tam} k ON s1.sm IS NOT NULL AND k.tam = {pre('r1', [f for f, _ in _keyed('tam')])} UNION ALL SELECT s1.*, NULL, NULL, 99, r1 FROM s1),
    s3 AS (SELECT s2.*, {_case('om', _first(om))} AS om_class, 0 AS o4, {cut('r2', 'om')} AS r3 FROM (SELECT *, {pre('r2', [f for f, _ in om])} AS om FROM s2 WHERE sm IS NOT NULL) s2 WHERE om <> '' UNION ALL SELECT s2.*, NULL, NULL, 1, r2 FROM s2),
    s4 AS (SELECT s3.*, {_case('fv', _first(fv))} AS fv_id, 0 AS o5, {ends('r3', 'fv')} AS r4 FROM (SELECT *, {suf('r3', [f for f, _ in fv])} AS fv FROM s3) s3 WHERE fv <> '' UNION ALL SELECT s3.*, NULL, NULL, 1, r3 FROM s3),
    s5 AS (SELECT s4.*, {_case('ext', _first(ext))} AS ext_id, 0 AS o6, {ends('r4', 'ext')} AS root FROM (SELECT *, {suf('r4', [f for f, _ in ext])} AS ext FROM s4) s4 WHERE ext <> '' UNION ALL SELECT s4.*, NULL, NULL, 1, r4 FROM s4),
    scored AS (SELECT s5.*, coalesce(v.gloss, '') AS gloss, v.root IS NOT NULL AS known, {score} AS score FROM s5 LEFT JOIN {rows_sql(VERBS, 'root, gloss, verified')} v ON v.root = s5.root),
    best AS (SELECT *, row_number() OVER (PARTITION BY form, neg, sm, tam, om, root, ext, fv ORDER BY {order}) AS k FROM scored)
    SELECT *, row_number() OVER (PARTITION BY form ORDER BY {order})::INT AS hyp FROM best WHERE k = 1)"""


_VERBS = verb_sql(_FORMS)
_VERB_COLUMNS = ", ".join(c.split()[0] for c in M.VERB_SCHEMA.split(", "))


@query(f"SELECT {_VERB_COLUMNS} FROM {_VERBS} WHERE hyp <= {M.TOP}")
def verb_parse_topk(spark, sf_dir):
    """Best hypotheses of every distinct form."""
    return M.verb_parses(forms(spark, sf_dir), tables()[0])


_PARTS = ", ".join(f"{{'i': {i}, 'slot': {Q(x)}, 'morph': {x.lower()}}}" for i, x in enumerate(M.SLOTS))


@query(f"SELECT form, hyp, slot, morph, (stop - length(morph))::INT AS start, stop FROM (SELECT form, hyp, p.slot AS slot, p.morph AS morph, (sum(length(p.morph)) OVER (PARTITION BY form ORDER BY p.i))::INT AS stop FROM (SELECT form, hyp, unnest([{_PARTS}]) AS p FROM {_VERBS} WHERE hyp = 1) WHERE length(p.morph) > 0)")
def verb_morpheme_spans(spark, sf_dir):
    return M.spans(M.verb_parses(forms(spark, sf_dir), tables()[0], top=1))


@query()
def app_analyze(spark, sf_dir):
    """Verbal and nominal hypotheses of every distinct form, by an exhaustive search over the slots."""
    return M.app_analyses(forms(spark, sf_dir), M.SlotParser(G.LEXEME))


# annotation: one pass over sentences, no exchange


def sentences(spark, sf_dir) -> DataFrame:
    """Every sentence with its tokens."""
    s = S.exploded(table(spark, sf_dir, "documents"), S.app_sentences(F.col("text"))).withColumnRenamed("n", "sent")
    return s.select("doc_id", "sent", S.punct_tokens(F.col("sentence")).alias("forms"))


def tagged(spark, sf_dir, columns: list[str] | None = None) -> DataFrame:
    return A.tokens(sentences(spark, sf_dir), A.Annotator(*tables()), columns=columns)


def _sentences() -> str:
    from .segment import app_sentences

    return f"(SELECT doc_id, sent, unnest(range(1, len(w) + 1))::INT AS pos, unnest(w) AS form FROM (SELECT doc_id, sent, {_PUNCT.replace('text', 's')} AS w FROM (SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS sent, unnest(p) AS s FROM (SELECT doc_id, {app_sentences('text')} AS p FROM documents))))"


def _feature(x: str, keys, table_: dict[str, str], name: str) -> str:
    pairs = [(k, T.features_of(k, table_)[name]) for k in keys if name in T.features_of(k, table_)]
    return _case(x, pairs) if pairs else "NULL"


def _tagged_sql() -> str:
    """Common tables ``t`` (tokens, tagged) for the queries below."""
    ids, fvs = list(G.LEXEME["tam"]), [k for _, k in G.FINAL_VOWELS]
    tam, fv = lambda k: _feature("tam_id", ids, T.TAM_FEATS, k), lambda k: _feature("fv_id", fvs, T.FV_FEATS, k)
    plural = "|".join(T.PLURAL)
    pairs = lambda m: "concat_ws('|', " + ", ".join(f"{Q(k + '=')} || {x}" for k, x in sorted(m.items())) + ")"
    parsed = {
        "VerbForm": "vf", "Tense": tam("Tense"), "Aspect": f"coalesce({fv('Aspect')}, {tam('Aspect')})", "Mood": f"CASE WHEN vf IS NULL OR vf <> 'Inf' THEN coalesce({tam('Mood')}, {fv('Mood')}, CASE WHEN vf = 'Fin' THEN 'Ind' END) END",
        "Number": f"CASE WHEN vf IS NULL OR vf <> 'Inf' THEN CASE WHEN person <> '' THEN CASE WHEN sm_class LIKE '%PL' THEN 'Plur' ELSE 'Sing' END WHEN sc IS NOT NULL THEN CASE WHEN regexp_matches(sc, {Q(f'({plural})$')}) THEN 'Plur' ELSE 'Sing' END END END",
        "Person": "CASE WHEN vf IS NULL OR vf <> 'Inf' THEN CASE WHEN person <> '' THEN person WHEN sc IS NOT NULL THEN '3' END END", "Polarity": f"coalesce(CASE WHEN neg IS NOT NULL THEN 'Neg' END, {fv('Polarity')})",
        "Voice": f"coalesce({_case('ext_id', T.VOICE.items())}, CASE WHEN upos = 'VERB' THEN 'Act' END)", "SlotScore": "printf('%.2f', score)",
    }
    noun = {"NounClass": "'Bantu' || regexp_extract(nc, '^NC(.+)', 1)", "Number": f"CASE WHEN regexp_extract(nc, '^NC([0-9]+)', 1) IN ({', '.join(map(Q, T.PLURAL))}) THEN 'Plur' ELSE 'Sing' END"}
    f = lambda k: f"nullif(regexp_extract(feats, '(?:^|[|]){k}=([^|]+)', 1), '')"
    locative = ", ".join(map(Q, G.LOCATIVE))
    return f"""t0 AS (SELECT *, {_TYPE} AS type, lower(form) AS low FROM {_sentences()}), forms AS (SELECT DISTINCT low AS form FROM t0 WHERE type = 'word'),
    v AS (SELECT * FROM {verb_sql('forms')} WHERE hyp = 1 AND score >= {M.ACCEPT_VERB}), n AS (SELECT * FROM {_NOUNS.format(forms='forms')} WHERE rank = 1 AND score >= {M.ACCEPT_NOUN} AND form NOT IN (SELECT form FROM v)),
    t1 AS (SELECT t0.*, v.score, v.neg, v.sm, v.sm_class, v.tam, v.tam_id, v.om, v.om_class, v.root, v.ext, v.ext_id, v.fv, v.fv_id, n.nc, n.stem, n.score AS nc_score, coalesce(v.known, n.known) AS known, CASE WHEN v.sm_class LIKE 'NC%' THEN v.sm_class END AS sc, regexp_extract(v.sm_class, '^([123])(SG|PL)', 1) AS person, {_case('low', G.CLOSED.items())} AS listed FROM t0 LEFT JOIN v ON type = 'word' AND v.form = low LEFT JOIN n ON type = 'word' AND n.form = low),
    t2 AS (SELECT *, CASE type WHEN 'punct' THEN 'PUNCT' WHEN 'number' THEN 'NUM' ELSE coalesce(CASE WHEN score IS NOT NULL THEN CASE WHEN sc IN ({locative}) AND coalesce(tam_id, '') = '' THEN 'ADP' WHEN sc = 'NC15' OR root <> '' THEN 'VERB' END WHEN nc IS NOT NULL THEN 'NOUN' END, listed, 'X') END AS upos, CASE WHEN type <> 'word' THEN 'special' WHEN score IS NOT NULL THEN 'parsed' WHEN nc IS NOT NULL THEN 'class' WHEN listed IS NOT NULL THEN 'closed' ELSE 'untagged' END AS flag FROM t1),
    t3 AS (SELECT *, CASE WHEN upos <> 'VERB' THEN NULL WHEN sc = 'NC15' THEN 'Inf' ELSE 'Fin' END AS vf FROM t2),
    t4 AS (SELECT *, CASE WHEN score IS NOT NULL THEN {pairs(parsed)} WHEN upos = 'NOUN' AND nc IS NOT NULL THEN {pairs(noun)} WHEN type = 'number' THEN 'NumType=Card' ELSE '' END AS feats FROM t3),
    t AS (SELECT *, CASE upos WHEN 'VERB' THEN concat_ws('.', 'VERB', upper(coalesce({f('VerbForm')}, 'Fin')), upper({f('Tense')}), {f('Person')} || CASE {f('Number')} WHEN 'Plur' THEN 'PL' ELSE 'SG' END, upper(CASE WHEN {f('Voice')} <> 'Act' THEN {f('Voice')} END)) WHEN 'NOUN' THEN concat_ws('.', 'NOUN', nc, upper({f('Number')})) WHEN 'ADP' THEN 'ADP' || coalesce('.LOC.' || CASE WHEN flag = 'parsed' THEN sc END, '') ELSE upos END AS xpos,
        coalesce(CASE WHEN flag = 'parsed' THEN nullif(root, '') END, CASE WHEN flag = 'class' AND known THEN stem END, low) AS lemma,
        CASE WHEN type <> 'punct' AND nc NOT IN ({locative}) THEN nc END AS seen, round((CASE upos WHEN 'NOUN' THEN 0.50 WHEN 'X' THEN 0.20 ELSE 0.15 END + CASE WHEN known THEN 0.30 WHEN flag = 'class' THEN 0.15 ELSE 0.10 END) * CASE WHEN neg IS NOT NULL AND om_class IS NOT NULL THEN 0.30 ELSE 1 END, 3)::DOUBLE AS conf, coalesce(known, false) AS lex FROM t4)"""


_WITH = _tagged_sql()


@query(f"WITH {_WITH} SELECT upos, flag, count(*) AS n, count(nc) AS classes, count(sm_class) AS subjects, count(om_class) AS objects, count(tam_id) AS tenses FROM t GROUP BY upos, flag")
def tag_upos(spark, sf_dir):
    t = A.counts(sentences(spark, sf_dir), A.Annotator(*tables()), ["upos", "flag", "nc", "sm_class", "om_class", "tam_id"])
    some = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0))
    return t.groupBy("upos", "flag").agg(F.sum("n").alias("n"), some("nc").alias("classes"), some("sm_class").alias("subjects"), some("om_class").alias("objects"), some("tam_id").alias("tenses"))


@query(f"WITH {_WITH} SELECT doc_id, sent, pos, form, lemma, upos, xpos, feats, flag FROM t")
def tag_tokens(spark, sf_dir):
    """Tags, features and lemmas of every token."""
    return tagged(spark, sf_dir, ["pos", "form", "lemma", "upos", "xpos", "feats", "flag"])


@query(f"WITH {_WITH} SELECT last_nc, sm_class = last_nc AS agrees, count(*) AS n FROM (SELECT *, last_value(CASE WHEN upos = 'NOUN' THEN nc END IGNORE NULLS) OVER (PARTITION BY doc_id, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_nc FROM t) WHERE upos = 'VERB' GROUP BY ALL")
def agree_asof(spark, sf_dir):
    """A verb agrees with the last noun before it."""
    t = A.last_nouns(sentences(spark, sf_dir).select("forms"), A.Annotator(*tables()))
    return t.groupBy("last_nc", "agrees").agg(F.count("*").alias("n"))


def _links(gov: str, kind: str, window: int, after: bool, bonus: float, lexicon: bool = True) -> str:
    order = ("CASE WHEN n.pos > g.pos THEN 0 ELSE 1 END, " if after else "") + "abs(g.pos - n.pos), " + ("n.lex DESC, " if lexicon else "") + "n.conf DESC, n.pos"
    return f"""SELECT doc_id, sent, {Q(kind)} AS kind, nc, gov_pos, noun_pos, dist, least(round(conf * 0.40::DOUBLE + CASE WHEN lex THEN 0.15::DOUBLE ELSE 0::DOUBLE END + greatest(0::DOUBLE, 1 - dist::DOUBLE / {window + 1}) * 0.25::DOUBLE + {bonus}::DOUBLE, 3), 1)::DOUBLE AS score FROM (SELECT g.doc_id, g.sent, g.nc, g.pos AS gov_pos, n.pos AS noun_pos, abs(g.pos - n.pos)::INT AS dist, n.conf, n.lex, row_number() OVER (PARTITION BY g.doc_id, g.sent, g.pos ORDER BY {order}) AS k
    FROM ({gov}) g JOIN t n ON n.doc_id = g.doc_id AND n.sent = g.sent AND n.seen = g.nc AND n.pos <> g.pos AND abs(g.pos - n.pos) <= {window}) WHERE k = 1"""


_LINKS = " UNION ALL ".join(
    [
        _links("SELECT doc_id, sent, pos, sc AS nc FROM t WHERE upos = 'VERB' AND sc IS NOT NULL", "subj", T.SUBJECT_WINDOW, False, 0.10),
        _links("SELECT doc_id, sent, pos, om_class AS nc FROM t WHERE upos = 'VERB' AND om_class LIKE 'NC%'", "obj", T.OBJECT_WINDOW, True, 0.05),
        _links(f"SELECT doc_id, sent, pos, seen AS nc FROM t WHERE upos IN ({', '.join(map(Q, T.MODIFIERS))}) AND seen IS NOT NULL", "mod", T.MODIFIER_WINDOW, False, 0.05, False),
    ]
)


@query(f"WITH {_WITH}, l AS ({_LINKS}) SELECT * FROM l WHERE score >= {T.LEAST}")
def agree_nearest(spark, sf_dir):
    """Subject, object and modifier links by the nearest noun of the class, with their scores."""
    return A.links(sentences(spark, sf_dir), A.Annotator(*tables()))


def _conllu_sql() -> str:
    dash = lambda x: f"coalesce(nullif({x}, ''), '_')"
    morphs = "nullif(concat_ws(',', " + ", ".join(f"'{k}=' || nullif({c}, '')" for k, c in (("NEG", "neg"), ("SM", "sm"), ("TAM", "tam"), ("OM", "om"), ("ROOT", "root"), ("EXT", "ext"), ("FV", "fv"))) + "), '')"
    misc = ["'AgreeNC=' || agree_nc", "'AgreeObj=' || obj_at", "'AgreeSubj=' || subj_at", "'AgreeAdj=' || mod_at", "'AgreeVerb=' || verb_at", "'AgreeVerbObj=' || verbobj_at", "'NounClass=' || nc", "'NCScore=' || printf('%.3f', nc_score)", "'Score=' || printf('%.3f', score)", f"'Morphemes=' || {morphs}", "'ChainScore=' || CASE WHEN total IS NOT NULL THEN printf('%.3f', least(1, floor((round(total * 1000) + 1) / 2) / 1000)) END"]
    return f"""WITH {_WITH}, l AS (SELECT * FROM ({_LINKS}) WHERE score >= {T.LEAST}),
    g AS (SELECT doc_id, sent, gov_pos AS pos, sum(score) AS total, max(CASE kind WHEN 'subj' THEN noun_pos END)::VARCHAR AS subj_at, max(CASE kind WHEN 'obj' THEN noun_pos END)::VARCHAR AS obj_at, max(CASE kind WHEN 'mod' THEN noun_pos END)::VARCHAR AS mod_at, max(CASE kind WHEN 'subj' THEN nc END) AS subj_nc, max(CASE kind WHEN 'obj' THEN nc END) AS obj_nc, max(CASE kind WHEN 'mod' THEN nc END) AS mod_nc FROM l GROUP BY ALL),
    e AS (SELECT doc_id, sent, noun_pos AS pos, any_value(nc) AS noun_nc, max(CASE kind WHEN 'subj' THEN gov_pos END)::VARCHAR AS verb_at, max(CASE kind WHEN 'obj' THEN gov_pos END)::VARCHAR AS verbobj_at, string_agg(CASE kind WHEN 'subj' THEN gov_pos || ':nsubj' WHEN 'obj' THEN gov_pos || ':obj' END, '|' ORDER BY kind DESC, gov_pos) AS deps FROM l GROUP BY doc_id, sent, noun_pos),
    w AS (SELECT t.*, g.* EXCLUDE (doc_id, sent, pos), e.* EXCLUDE (doc_id, sent, pos), coalesce(noun_nc, mod_nc, obj_nc, subj_nc) AS agree_nc FROM t LEFT JOIN g USING (doc_id, sent, pos) LEFT JOIN e USING (doc_id, sent, pos)),
    lines AS (SELECT doc_id, sent, pos, concat_ws(chr(9), pos::VARCHAR, replace(replace(form, '|', '\\p'), chr(9), ' '), {dash('lemma')}, {dash('upos')}, {dash('xpos')}, {dash('feats')}, '_', '_', {dash('deps')}, {dash("array_to_string(list_sort(list_filter([" + ", ".join(misc) + "], lambda x: x IS NOT NULL)), '|')")}) AS line FROM w)
    SELECT doc_id, sent, '# sent_id = ' || doc_id || '-' || sent || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) AS block FROM lines GROUP BY doc_id, sent"""


@query(_conllu_sql())
def conllu_lines(spark, sf_dir):
    """CoNLL-U of every sentence, enhanced dependencies included."""
    t = A.conllu(sentences(spark, sf_dir), A.Annotator(*tables()))
    return t.select("doc_id", "sent", F.concat(F.lit("# sent_id = "), F.col("doc_id"), F.lit("-"), F.col("sent"), F.lit("\n"), F.col("lines"), F.lit("\n")).alias("block"))


@query(
    f"WITH {_WITH} SELECT doc_id, count(*) AS tokens, count(CASE WHEN type NOT IN ('punct', 'special') THEN 1 END) AS words, count(CASE WHEN type NOT IN ('punct', 'special') AND NOT lex THEN 1 END) AS oov, count(CASE WHEN flag IN ('parsed', 'class') THEN 1 END) AS analysed, count(CASE WHEN type = 'punct' THEN 1 END) AS punct, 0::BIGINT AS special, round(CASE WHEN words > 0 THEN oov / words ELSE 0 END, 4)::DOUBLE AS oov_rate, round(count(CASE WHEN NOT lex THEN 1 END) / tokens, 4)::DOUBLE AS oov_all, round(analysed / tokens, 4)::DOUBLE AS tagging_rate FROM t GROUP BY doc_id"
)
def annotation_coverage(spark, sf_dir):
    """Counts and rates over each document's annotated tokens."""
    t = A.counts(sentences(spark, sf_dir), A.Annotator(*tables()), ["type", "known", "flag"], ("doc_id",))
    t = t.select("doc_id", "type", (~F.coalesce("known", F.lit(False))).alias("oov"), F.col("flag").isin("parsed", "class").alias("analysed"), "n")
    return stats.coverage(t, "doc_id", weight="n")


@query(f"WITH {_WITH}, p AS (SELECT form, score, max(score) OVER (PARTITION BY form) AS top FROM {verb_sql('forms')} WHERE hyp <= {M.TOP}), k AS (SELECT form FROM p WHERE score = top GROUP BY form HAVING count(*) > 1) SELECT count(DISTINCT (doc_id, sent)) AS sentences, count(*) AS tokens, count(CASE WHEN type = 'word' THEN 1 END) AS words, count(CASE WHEN type = 'word' AND low IN (SELECT form FROM k) THEN 1 END) AS ambiguous, 0::BIGINT AS failed FROM t")
def annotation_totals(spark, sf_dir):
    """Totals of an annotation run; a word is ambiguous if its best verb parses tie."""
    return A.run_totals(sentences(spark, sf_dir), A.Annotator(*tables()), "doc_id", "sent")


@query(f"SELECT form, segmentation, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY score DESC, segmentation)::INT AS rank FROM (SELECT form, segmentation, max(score) AS score FROM (SELECT form, concat_ws('-', neg, sm, tam, om, root, ext, fv) AS segmentation, score FROM {_VERBS} WHERE hyp <= {M.TOP} UNION ALL SELECT form, concat_ws('-', nullif(prefix, ''), stem), score FROM {_NOUNS.format(forms=_FORMS)}) GROUP BY ALL)) WHERE rank <= {M.TOP}")
def hypothesis_union(spark, sf_dir):
    """Verb and noun hypotheses of each form as one ranked list, a segmentation once."""
    verbs = verb_parse_topk(spark, sf_dir).select("form", F.concat_ws("-", "neg", "sm", "tam", "om", "root", "ext", "fv").alias("segmentation"), "score")
    nouns = noun_analysis_top3(spark, sf_dir).select("form", F.concat_ws("-", F.nullif("prefix", F.lit("")), "stem").alias("segmentation"), "score")
    return M.hypothesis_union(verbs, nouns)


@query(f"SELECT doc_id, CASE {' '.join(f'WHEN lower(trim(lang)) = {Q(a)} THEN {Q(x)}' for a, x in G.aliases({'english': ('en', 'eng'), 'german': ('de', 'deu'), 'french': ('fr',)}).items())} END AS language FROM documents")
def resolve_language(spark, sf_dir):
    """Language of an alias."""
    names = {"english": ("en", "eng"), "german": ("de", "deu"), "french": ("fr",)}
    return table(spark, sf_dir, "documents").select("doc_id", G.resolve_language(F.col("lang"), names).alias("language"))


@query("SELECT event_id, (year(ts) * 10000 + month(ts) * 100 + day(ts)) % 7 AS place FROM events")
def word_of_day(spark, sf_dir):
    """Place of a day's word in a list of seven."""
    return table(spark, sf_dir, "events").select("event_id", M.word_of_day(F.col("ts"), 7).cast("long").alias("place"))


@query("SELECT doc_id, 'w' || doc_id AS surface, 1 AS rank, 'root' || n_chars AS lemma, 'category subject_concord tam extension final_vowel' AS kinds, n_chars::DOUBLE AS weight, false AS failed FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL UNION ALL SELECT doc_id, 'w' || doc_id, 2, 'w' || doc_id, 'other', NULL, true FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL")
def fst_lookup(spark, sf_dir):
    """Output of a transducer, as it would come from a run, parsed and ranked."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null and n_chars is not null")
    tab, word = F.lit("\t"), F.concat(F.lit("w"), F.col("doc_id"))
    lines = d.select(F.explode(F.array(F.concat(word, tab, F.lit("root"), F.col("n_chars"), F.lit("+V+SM1+PRES+APPL+FV"), tab, F.col("n_chars")), F.concat(word, tab, word, F.lit("+?")))).alias("line"))
    r = M.fst_lookup(lines)
    return r.select(F.substring("surface", 2, 20).cast("long").alias("doc_id"), "surface", "rank", F.col("parsed.lemma").alias("lemma"), F.array_join("parsed.kinds", " ").alias("kinds"), "weight", F.col("parsed.failed").alias("failed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark, sf_dir):
    """Documents that aren't done yet, ``labels`` standing for what is."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.lang, l.quality, count(DISTINCT d.doc_id) AS documents FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def labels_by_lang(spark, sf_dir):
    """Extension: labelled documents by language."""
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang", "quality").agg(F.count_distinct("doc_id").alias("documents"))
