"""Universal Dependencies tags and agreement links over analysed tokens.

Tokens are rows of ``sent.., pos, form, type`` with the columns of ``morph.ANALYSIS`` (a verb parse or a noun class); see
``morph.analysed_tokens``. Tags depend on a token alone and are expressions. Agreement looks at neighbours of one sentence, within
eight tokens: two windows of ``lag`` and ``lead`` over one exchange by sentence, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grammar as G
from .morph import ACCEPT_VERB, lookup, table_of

SUBJECT_WINDOW, OBJECT_WINDOW, MODIFIER_WINDOW, LEAST = 8, 5, 4, 0.25
PLURAL = tuple("2 4 6 8 10 13".split())
#: Universal features of a tense: by its whole id, by the part before its full stop, else by every gloss that it holds.
TAM_FEATS = {"PRES": "Tense=Pres|Aspect=Imp", "PAST": "Tense=Past|Aspect=Perf", "FUT": "Tense=Fut", "SUBJ": "Mood=Sub", "PERF": "Aspect=Perf", "HAB": "Aspect=Hab", "IMP": "Mood=Imp", "COND": "Mood=Cnd", "PROG": "Aspect=Prog", "REM": "Tense=Past", "REC": "Tense=Past", "HOD": "Tense=Past", "NARR": "Tense=Past"}
FV_FEATS = {"IND": "Mood=Ind", "SUBJ": "Mood=Sub", "PERF": "Aspect=Perf", "PROG": "Aspect=Prog", "IMP": "Mood=Imp", "NEG": "Polarity=Neg"}
VOICE = table_of("PASS=Pass CAUS=Cau APPL=Appl RECP=Rcp REFL=Rfl")
MODIFIERS = ("ADJ", "DET", "NUM", "PRON")


def features_of(key: str, table: dict[str, str] = TAM_FEATS) -> dict[str, str]:
    """Features of a tense or final vowel by its id."""
    own = table.get(key) or table.get(key.split(".")[0])
    found = [own] if own else [v for k, v in table.items() if k in key.upper()]
    return {k: v for x in found for k, v in (y.split("=") for y in x.split("|"))}


def _feature(c: Column, keys, table: dict[str, str], name: str) -> Column:
    """One feature of an id column; null where it has none."""
    pairs = {k: features_of(k, table)[name] for k in keys if name in features_of(k, table)}
    return lookup(c, pairs) if pairs else F.lit(None).cast("string")


def subject_class() -> Column:
    return F.when(F.col("sm_class").startswith("NC"), F.col("sm_class"))


def upos(closed: dict[str, str]) -> tuple[Column, Column, Column]:
    """UPOS, VerbForm and flag of a token row.

    A parse of ``ACCEPT_VERB`` counts first: a locative subject without tense is ADP, one of NC15 an infinitive, a root is a finite
    verb. Then a noun class is NOUN, then a weak parse counts. Closed-class words are looked up where nothing else is found.
    """
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    nc, parsed = subject_class(), F.col("score").isNotNull()
    by_parse = F.when(nc.isin(*G.LOCATIVE) & ~has("tam_id"), "ADP").when(nc == "NC15", "VERB").when(has("root"), "VERB")
    found = F.when(F.col("type") == "punct", "PUNCT").when(F.col("type") == "number", "NUM").when(F.col("type") == "special", "SYM").when(F.col("type") == "code_switch", "X")
    strong, weak = parsed & (F.col("score") >= ACCEPT_VERB), parsed & (F.col("score") > 0.05)
    word = F.when(strong, F.coalesce(by_parse, F.lit("X"))).when(F.col("nc").isNotNull(), "NOUN").when(weak, by_parse)
    listed = lookup(F.lower("form"), closed)
    pos = F.coalesce(found, F.when(F.coalesce(word, F.lit("X")) != "X", word), listed, F.lit("X"))
    flag = F.when(found.isNotNull(), "special").when(strong, "parsed").when(F.col("nc").isNotNull(), "class").when(weak & by_parse.isNotNull(), "weak").when(listed.isNotNull(), "closed").otherwise("untagged")
    form = F.when(pos != "VERB", None).when(nc == "NC15", "Inf").otherwise("Fin")
    return pos, form, flag


def number_of(nc: Column) -> Column:
    """By an explicit list of plural classes: 12, 14, 16 and 18 are singular."""
    n = F.regexp_extract(nc, r"^NC(\d+)", 1)
    return F.when(n == "", None).when(n.isin(*PLURAL), "Plur").otherwise("Sing")


def number_by_suffix(nc: Column) -> Column:
    """The looser rule that other tools use: any class whose name ends like a plural one."""
    return F.when(nc.rlike(f"({'|'.join(PLURAL)})$"), "Plur").when(nc.startswith("NC"), "Sing")


def feats(tam_ids, fv_ids) -> Column:
    """FEATS as sorted ``k=v`` pairs of a row with ``upos`` and ``__form``: a parse's features, else a noun's by its class."""
    parsed, inf, verb = F.col("score").isNotNull() & F.col("flag").isin("parsed", "weak"), F.coalesce(F.col("__form") == "Inf", F.lit(False)), F.col("upos") == "VERB"
    tam = lambda k: _feature(F.col("tam_id"), tam_ids, TAM_FEATS, k)
    fv = lambda k: _feature(F.col("fv_id"), fv_ids, FV_FEATS, k)
    person, nc = F.regexp_extract("sm_class", r"^([123])(SG|PL)", 1), subject_class()
    number = F.when(person != "", F.when(F.col("sm_class").endswith("PL"), "Plur").otherwise("Sing")).when(nc.isNotNull(), number_by_suffix(nc))
    own = {
        "VerbForm": F.col("__form"), "Tense": tam("Tense"), "Aspect": F.coalesce(fv("Aspect"), tam("Aspect")), "Mood": F.when(~inf, F.coalesce(tam("Mood"), fv("Mood"), F.when(F.col("__form") == "Fin", "Ind"))), "Number": F.when(~inf, number),
        "Person": F.when(~inf, F.when(person != "", person).when(nc.isNotNull(), "3")), "Polarity": F.coalesce(F.when(F.col("neg").isNotNull(), "Neg"), fv("Polarity")), "Voice": F.coalesce(lookup(F.col("ext_id"), VOICE), F.when(verb, "Act")), "SlotScore": F.format_number("score", 2),
    }
    noun = {"NounClass": F.concat(F.lit("Bantu"), F.regexp_extract("nc", r"^NC(.+)", 1)), "Number": number_of(F.col("nc"))}
    pairs = lambda m: F.array_join(F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), c) for k, c in sorted(m.items())))), "|")
    return F.when(parsed, pairs(own)).when((F.col("upos") == "NOUN") & F.col("nc").isNotNull(), pairs(noun)).when(F.col("type") == "number", "NumType=Card").otherwise("")


def xpos() -> Column:
    """UPOS and what tells most of it, joined by full stops, from the row's FEATS."""
    f = lambda k: F.nullif(F.regexp_extract("feats", rf"(?:^|\|){k}=([^|]+)", 1), F.lit(""))
    verb = F.concat_ws(".", F.lit("VERB"), F.upper(F.coalesce(f("VerbForm"), F.lit("Fin"))), F.upper(f("Tense")), F.concat(f("Person"), F.when(f("Number") == "Plur", "PL").otherwise("SG")), F.upper(F.when(f("Voice") != "Act", f("Voice"))))
    noun = F.concat_ws(".", F.lit("NOUN"), "nc", F.upper(f("Number")))
    place = F.concat(F.lit("ADP"), F.coalesce(F.concat(F.lit(".LOC."), F.when(F.col("flag").isin("parsed", "weak"), subject_class())), F.lit("")))
    return F.when(F.col("type") == "code_switch", "X.CS").when(F.col("upos") == "VERB", verb).when(F.col("upos") == "NOUN", noun).when(F.col("upos") == "ADP", place).otherwise(F.col("upos"))


def tagged(tokens: DataFrame, closed: dict[str, str] = G.CLOSED, tam_ids=tuple(G.LEXEME["tam"]), fv_ids=tuple(k for _, k in G.FINAL_VOWELS)) -> DataFrame:
    """Analysed tokens with ``upos, flag, feats, xpos, lemma``."""
    pos, form, flag = upos(closed)
    out = tokens.withColumns({"upos": pos, "__form": form, "flag": flag})
    out = out.withColumn("feats", feats(tam_ids, fv_ids))
    lemma = F.coalesce(F.when(F.col("flag").isin("parsed", "weak"), F.nullif("root", F.lit(""))), F.when((F.col("flag") == "class") & F.col("known"), F.col("stem")), F.lower("form"))
    return out.withColumns({"xpos": xpos(), "lemma": lemma}).drop("__form")


def last_noun(tokens: DataFrame, *sent: str) -> DataFrame:
    """``agrees``: a verb's class is that of the last noun before it in the sentence; null without one."""
    before = Window.partitionBy(*sent).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    noun = F.last(F.when(F.col("upos") == "NOUN", F.col("nc")), ignorenulls=True).over(before)
    return tokens.withColumn("last_nc", noun).withColumn("agrees", F.when(F.col("upos") == "VERB", F.col("last_nc") == F.col("sm_class")))


def sighting() -> Column:
    """Class of a token that is or may be a noun, apart from locatives: of its analysis, else of its FEATS or XPOS."""
    other = F.concat(F.lit("NC"), F.nullif(F.regexp_extract("feats", r"(?:^|\|)NounClass=Bantu([^|]+)", 1), F.lit("")))
    nc = F.coalesce("nc", other, F.when(F.col("upos") == "NOUN", F.nullif(F.regexp_extract("xpos", r"\.(NC[^.]+)", 1), F.lit(""))))
    return F.when(~F.col("type").isin("punct", "special") & ~nc.isin(*G.LOCATIVE), nc)


def noun_confidence() -> Column:
    """Of a sighting: by UPOS and by the source of its class, less where the word has a negation and an object marker."""
    base = F.when(F.col("upos") == "NOUN", 0.50).when(F.col("upos") == "X", 0.20).otherwise(0.15) + F.when(F.col("known"), 0.30).when(F.col("flag") == "class", 0.15).otherwise(0.10)
    return F.round(F.when(F.col("neg").isNotNull() & F.col("om_class").isNotNull(), base * 0.30).otherwise(base), 3)


def chain_score(confidence: Column, lexicon: Column, distance: Column, window: int, subject: bool) -> Column:
    near = F.greatest(F.lit(0.0), 1 - distance / (window + 1))
    return F.least(F.round(confidence * 0.40 + F.when(lexicon, 0.15).otherwise(0.0) + near * 0.25 + (0.10 if subject else 0.05), 3), F.lit(1.0))


def _nearest(window: int, nc: Column, sides: str = "both", lexicon: bool = True) -> Column:
    """``(off, conf, lex)`` of the nearest sighting of class ``nc``; of two equally near ones that of the lexicon, then the surer one, then the one before."""
    found = []
    for d in range(1, window + 1):
        left, right = F.col(f"__l{d}"), F.col(f"__r{d}")
        one = lambda s, off: F.struct(F.lit(off).alias("off"), s["conf"].alias("conf"), s["lex"].alias("lex"))
        ok_l, ok_r = F.coalesce(left["nc"] == nc, F.lit(False)), F.coalesce(right["nc"] == nc, F.lit(False))
        surer = right["conf"] > left["conf"]
        if lexicon:
            surer = (right["lex"] & ~left["lex"]) | ((right["lex"] == left["lex"]) & surer)
        if sides == "both":
            found.append(F.when(ok_r & (~ok_l | surer), one(right, d)).when(ok_l, one(left, -d)))
        else:
            found.append(F.when(ok_r, one(right, d)) if sides == "after" else F.when(ok_l, one(left, -d)))
    return F.coalesce(*found)


def linked(tokens: DataFrame, sent: list[str], least: float = LEAST) -> DataFrame:
    """Tagged tokens with ``subj, obj, mod``: the noun that a verb's subject or object marker, or a modifier's class, agrees with.

    Each is ``struct<off, score>`` or null: how many tokens further the noun is, and how sure the link. ``pos`` counts the tokens of a sentence one
    by one. One exchange by sentence.
    """
    w = Window.partitionBy(*sent).orderBy("pos")
    nc = sighting()
    seen = F.when(nc.isNotNull(), F.struct(nc.alias("nc"), noun_confidence().alias("conf"), F.coalesce("known", F.lit(False)).alias("lex")))
    near = tokens.withColumn("__s", seen)
    reach = max(SUBJECT_WINDOW, OBJECT_WINDOW, MODIFIER_WINDOW)
    near = near.withColumns({f"__{side}{d}": f("__s", d).over(w) for d in range(1, reach + 1) for side, f in (("l", F.lag), ("r", F.lead))})
    verb, mod = F.col("upos").isin("VERB", "AUX"), F.col("upos").isin(*MODIFIERS)
    om, sm = F.when(F.col("om_class").startswith("NC"), F.col("om_class")), subject_class()
    found = {
        "subj": (F.when(verb & sm.isNotNull(), _nearest(SUBJECT_WINDOW, sm)), SUBJECT_WINDOW), "obj": (F.when(verb & om.isNotNull(), F.coalesce(_nearest(OBJECT_WINDOW, om, "after"), _nearest(OBJECT_WINDOW, om, "before"))), OBJECT_WINDOW),
        "mod": (F.when(mod & nc.isNotNull(), _nearest(MODIFIER_WINDOW, nc, lexicon=False)), MODIFIER_WINDOW),
    }
    near = near.withColumns({f"__{k}": c for k, (c, _) in found.items()})
    for k, (_, window) in found.items():
        x = F.col(f"__{k}")
        score = chain_score(x["conf"], x["lex"], F.abs(x["off"]), window, k == "subj")
        near = near.withColumn(k, F.when(x.isNotNull() & (score >= least), F.struct(x["off"].alias("off"), score.alias("score"))))
    return near.select(*tokens.columns, *found)


def link_rows(linked_tokens: DataFrame, sent: list[str]) -> DataFrame:
    """``sent.., kind, nc, gov_pos, noun_pos, dist, score`` of the links of ``linked``."""
    one = lambda k, nc: F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), nc.alias("nc"), F.col("pos").alias("gov_pos"), (F.col("pos") + F.col(k)["off"]).alias("noun_pos"), F.abs(F.col(k)["off"]).alias("dist"), F.col(k)["score"].alias("score")))
    return linked_tokens.select(*sent, F.inline(F.array_compact(F.array(one("subj", F.col("sm_class")), one("obj", F.col("om_class")), one("mod", sighting())))))


def resolved(tokens: DataFrame, sent: list[str]) -> DataFrame:
    """All links of tagged tokens: subjects, objects and modifiers."""
    return link_rows(linked(tokens, sent), sent)


def with_links(linked_tokens: DataFrame, sent: list[str]) -> DataFrame:
    """What links say of both ends: ``deps`` (enhanced dependencies), ``agree`` (``key=value`` pairs), ``link_score``; no exchange beyond that of ``linked``.

    ``link_score`` of a verb or modifier is half the sum of its links' scores, at most 1. A word of unknown part of speech that a link takes for a noun is one.
    """
    w = Window.partitionBy(*sent).orderBy("pos")
    reach = {"subj": SUBJECT_WINDOW, "obj": OBJECT_WINDOW, "mod": MODIFIER_WINDOW}
    at = lambda off: (F.col("pos") + off).cast("string")
    # tokens whose link leads here, the first in the sentence first
    asked = {f"__{k}{d}": (F.lag(k, d) if d > 0 else F.lead(k, -d)).over(w) for k, r in reach.items() for d in range(r, -r - 1, -1) if d}
    out = linked_tokens.withColumns(asked)
    gov = {k: F.array_compact(F.array(*(F.when(F.col(f"__{k}{d}")["off"] == d, F.lit(-d)) for d in range(r, -r - 1, -1) if d))) for k, r in reach.items()}
    out = out.withColumns({f"__{k}": c for k, c in gov.items()})
    deps = F.concat(F.transform("__subj", lambda o: F.concat(at(o), F.lit(":nsubj"))), F.transform("__obj", lambda o: F.concat(at(o), F.lit(":obj"))))
    last = lambda k: F.when(F.size(f"__{k}") > 0, at(F.element_at(f"__{k}", -1)))
    is_noun = F.size("__subj") + F.size("__obj") + F.size("__mod") > 0
    nc = F.when(is_noun, sighting()).when(F.col("mod").isNotNull(), sighting()).when(F.col("obj").isNotNull(), F.col("om_class")).when(F.col("subj").isNotNull(), F.col("sm_class"))
    role = F.when((F.col("upos") == "DET") & F.col("xpos").contains("DEM"), "AgreeDem").when((F.col("upos") == "PRON") & F.col("xpos").contains("POSS"), "AgreePoss").otherwise("AgreeAdj")
    pair = lambda k, v: F.concat(k if isinstance(k, Column) else F.lit(k), F.lit("="), v)
    agree = F.array_compact(F.array(pair("AgreeNC", nc), pair("AgreeObj", at(F.col("obj")["off"])), pair("AgreeSubj", at(F.col("subj")["off"])), pair(role, at(F.col("mod")["off"])), pair("AgreeVerb", last("subj")), pair("AgreeVerbObj", last("obj"))))
    scores = [F.col(k)["score"] for k in reach]
    # in thousandths, so that halves are rounded alike everywhere
    total = F.least(F.lit(1.0), F.floor((F.round(sum((F.coalesce(x, F.lit(0.0)) for x in scores), F.lit(0.0)) * 1000) + 1) / 2) / 1000)
    out = out.withColumns({"deps": F.array_join(deps, "|"), "agree": agree, "link_score": F.when(F.coalesce(*scores).isNotNull(), total), "upos": F.when((F.col("upos") == "X") & is_noun, "NOUN").otherwise(F.col("upos"))})
    return out.select(*linked_tokens.columns, "deps", "agree", "link_score")


def conllu_line() -> Column:
    """Ten tab-separated columns of a token as ``with_links`` gives it; FEATS and MISC are sorted."""
    dash = lambda c: F.when(c.isNull() | (c == ""), "_").otherwise(c)
    pair = lambda k, c: F.concat(F.lit(f"{k}="), c)
    morphs = F.array_join(F.array_compact(F.array(*(F.when(F.length(c) > 0, pair(k, F.col(c))) for k, c in (("NEG", "neg"), ("SM", "sm"), ("TAM", "tam"), ("OM", "om"), ("ROOT", "root"), ("EXT", "ext"), ("FV", "fv"))))), ",")
    own = [pair("NounClass", F.col("nc")), pair("NCScore", F.format_number("nc_score", 3)), pair("Score", F.format_number("score", 3)), pair("Morphemes", F.nullif(morphs, F.lit(""))), pair("ChainScore", F.format_number("link_score", 3)), pair("CodeSwitch", F.when(F.col("type") == "code_switch", "und"))]
    misc = F.array_join(F.array_sort(F.concat("agree", F.array_compact(F.array(*own)))), "|")
    escaped = F.replace(F.replace(F.col("form"), F.lit("|"), F.lit("\\p")), F.lit("\t"), F.lit(" "))
    return F.concat_ws("\t", F.col("pos").cast("string"), escaped, dash(F.col("lemma")), dash(F.col("upos")), dash(F.col("xpos")), dash(F.col("feats")), F.lit("_"), F.lit("_"), dash(F.col("deps")), dash(misc))
