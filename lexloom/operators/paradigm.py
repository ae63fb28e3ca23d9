"""Tables of forms, comparison of grammars, and checks of slot assignments, over grammar tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grammar as G
from .morph import RULES, conjugated, forward, lookup, table_of

BASE = r"^(NC\d+)[a-z]$"


def all_concords(t: dict[str, DataFrame]) -> DataFrame:
    """``lang, nc, concord_type, form, is_fallback``: own form, else that of the base class (NC1a: NC1), else null."""
    types = t["g_concord"].select("lang", "concord_type").distinct()
    own = t["g_concord"].select("lang", "concord_type", F.col("key").alias("nc"), "form")
    base = t["g_concord"].select("lang", "concord_type", F.col("key").alias("base"), F.col("form").alias("base_form"))
    cells = t["g_noun_class"].select("lang", "nc").join(types, "lang").withColumn("base", F.when(F.col("nc").rlike(BASE), F.regexp_extract("nc", BASE, 1)))
    out = cells.join(own, ["lang", "concord_type", "nc"], "left").join(base, ["lang", "concord_type", "base"], "left")
    return out.select("lang", "nc", "concord_type", F.coalesce("form", "base_form").alias("form"), (F.col("form").isNull() & F.col("base_form").isNotNull()).alias("is_fallback"))


def crosstab(t: dict[str, DataFrame], types: list[str]) -> DataFrame:
    """Classes by concord types; the columns are given, so no pass over the data finds them."""
    return all_concords(t).groupBy("lang", "nc").pivot("concord_type", types).agg(F.first("form"))


def resolve_type(c: Column, types: list[str]) -> Column:
    """First type, in order, that holds the given part of a name."""
    return F.coalesce(*(F.when(F.contains(F.lit(x), F.lower(c)), x) for x in types), F.lit(None).cast("string"))


def noun_paradigm(t: dict[str, DataFrame], nc: str) -> DataFrame:
    """Concord forms of one class, without fallback."""
    return t["g_concord"].filter(F.col("key") == nc).select("lang", "concord_type", "form")


def verb_cells(t: dict[str, DataFrame], root: str) -> DataFrame:
    """Every subject, tense and polarity of a root."""
    sm = t["g_concord"].filter("concord_type = 'subject_concord'").select("lang", F.col("key").alias("subject"), F.col("form").alias("sm"))
    tam = t["g_tam"].select("lang", "tam_id", F.col("form").alias("marker"), "mood")
    cells = sm.join(tam, "lang").withColumn("polarity", F.explode(F.array(F.lit("aff"), F.lit("neg"))))
    return cells.select("*", F.lit(root).alias("root"), F.lit(None).cast("string").alias("ext"), F.when(F.col("mood") == "subjunctive", "e").otherwise("a").alias("fv"), F.lit("i").alias("neg_fv"))


def verb_paradigm(t: dict[str, DataFrame], root: str) -> DataFrame:
    return conjugated(verb_cells(t, root)).select("lang", "subject", "tam_id", "polarity", "surface")


def generated(cells: DataFrame, rules=RULES) -> DataFrame:
    """``underlying`` and ``surface`` of cells by the app's phonology (parts joined by ``|``, then the rules); an unknown part is an ``error``."""
    parts = F.concat_ws("|", *(F.when(F.col(c) != "", F.col(c)) for c in ("sm", "marker", "root", "ext", "fv")))
    return cells.withColumn("underlying", parts).withColumn("surface", forward(parts, rules)).withColumn("error", F.when(F.col("sm").isNull(), "no subject").when(F.col("marker").isNull(), "no tense"))


# rendering (tables of a grammar's size)


def cells(table: DataFrame) -> tuple[list[str], list[list[str]]]:
    return table.columns, [["" if v is None else str(v) for v in row] for row in table.orderBy(*table.columns[:2]).collect()]


def to_markdown(table: DataFrame, width: int | None = None) -> str:
    head, body = cells(table)
    cut = [h if width is None or len(h) <= width else h[: width - 1] + "…" for h in head]
    line = lambda x: "| " + " | ".join(v.replace("|", "\\|") for v in x) + " |"
    return "\n".join([line(cut), line(["---"] * len(head)), *map(line, body)]) + "\n"


def to_csv(table: DataFrame) -> str:
    import csv
    import io

    out = io.StringIO()
    head, body = cells(table)
    csv.writer(out, lineterminator="\n").writerows([head, *body])
    return out.getvalue()


def to_html(table: DataFrame) -> str:
    from html import escape

    head, body = cells(table)
    row = lambda x, tag: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in x) + "</tr>"
    return "<table>" + row(head, "th") + "".join(row(x, "td") for x in body) + "</table>\n"


def to_text(table: DataFrame) -> str:
    head, body = cells(table)
    wide = [max(len(r[i]) for r in [head, *body]) for i in range(len(head))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in [head, *body]) + "\n"


def rendered(table: DataFrame, kind: str) -> str:
    made = {"markdown": to_markdown, "csv": to_csv, "html": to_html, "text": to_text}
    if kind not in made:
        raise ValueError(f"unknown format: {kind}")
    return made[kind](table)


# comparison


def diff(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """``entity, id, field, a, b, status`` of two languages: same, different, a_only, b_only."""
    side = lambda lang, v: t["g_eav"].filter(F.col("lang") == lang).select("entity", "id", "field", F.col("value").alias(v), F.lit(True).alias(f"in_{v}"))
    both = side(a, "a").join(side(b, "b"), ["entity", "id", "field"], "full_outer")
    status = F.when(F.col("in_b").isNull(), "a_only").when(F.col("in_a").isNull(), "b_only").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("different")
    return both.select("entity", "id", "field", "a", "b", status.alias("status"))


def inventory_diff(t: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Sounds that only one of two languages has."""
    p = t["g_phonology"]
    x, y = (p.filter(F.col("lang") == lang).select(*(F.col(k).alias(f"{k}_{v}") for k in ("vowels", "consonants", "nasal_prefixes"))) for lang, v in ((a, "a"), (b, "b")))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), text(F.array_except(f"{k}_a", f"{k}_b")).alias("a_only"), text(F.array_except(f"{k}_b", f"{k}_a")).alias("b_only")) for k in ("vowels", "consonants", "nasal_prefixes")))
    return x.crossJoin(y).select(F.inline(kinds))


def compared(t: dict[str, DataFrame], langs: list[str]) -> DataFrame:
    """Each fact over several languages: its most frequent value (of equal ones that of the language named first), whether all that
    have it agree, and which diverge. A language that lacks a fact diverges, but doesn't end the agreement of the others."""
    order = lookup(F.col("lang"), {x: str(i) for i, x in enumerate(langs)}).cast("int")
    facts = t["g_eav"].filter(F.col("lang").isin(langs)).select("entity", "id", "field", "lang", "value", order.alias("o"))
    keys = ["entity", "id", "field"]
    value = facts.filter("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("o").alias("o"), F.collect_set("lang").alias("with"))
    top = value.groupBy(*keys).agg(F.max_by(F.struct("value", "with"), F.struct("n", -F.col("o"))).alias("m"), (F.count("*") <= 1).alias("uniform"))
    diverge = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, langs)), "m.with")), " ")
    return top.select(*keys, F.col("m.value").alias("mode"), "uniform", diverge.alias("divergent"))


def resolve_paths(paths: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """``path`` (``entity.id.field``) looked up in every language: ``lang, path, value, state``."""
    p = F.split("path", r"\.")
    entity = F.coalesce(lookup(p[0], {"nc": "noun_class", "noun_classes": "noun_class", "concords": "concord", "extensions": "extension", "slots": "slot"}), p[0])
    asked = paths.select("path", entity.alias("entity"), F.try_element_at(p, F.lit(2)).alias("id"), F.try_element_at(p, F.lit(3)).alias("field"), (F.size(p) == 3).alias("good"))
    langs = t["g_metadata"].select("lang")
    out = asked.crossJoin(langs).join(t["g_eav"].withColumn("hit", F.lit(True)), ["lang", "entity", "id", "field"], "left")
    return out.select("lang", "path", "value", F.when(~F.col("good"), "error").when(F.col("hit"), "found").otherwise("missing").alias("state"))


# mapping to Universal Dependencies


def ud_classes(t: dict[str, DataFrame]) -> DataFrame:
    """``lang, nc, feature, number``: a class with a plural is singular, one with a singular plural."""
    n = t["g_noun_class"]
    return n.select("lang", "nc", F.concat(F.lit("Bantu"), F.regexp_extract("nc", r"^NC(\d+)", 1)).alias("feature"), F.when(F.col("sg_of").isNotNull(), "Sing").when(F.col("pl_of").isNotNull(), "Plur").alias("number"))


def ud_tam(t: dict[str, DataFrame]) -> DataFrame:
    tense = lookup(F.col("tense"), table_of("present=Pres past=Past future=Fut"))
    aspect = lookup(F.col("aspect"), table_of("imperfective=Imp perfective=Perf perfect=Perf habitual=Hab progressive=Prog"))
    mood = lookup(F.col("mood"), table_of("indicative=Ind subjunctive=Sub imperative=Imp conditional=Cnd"))
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(k + "="), v)) for k, v in (("Aspect", aspect), ("Mood", mood), ("Tense", tense))]
    return t["g_tam"].select("lang", "tam_id", F.concat_ws("|", *pairs).alias("feats"))


def ud_concords(t: dict[str, DataFrame]) -> DataFrame:
    """Person, number and class of a concord's key."""
    person = F.regexp_extract("key", r"^([123])", 1)
    number = F.when(F.col("key").rlike("SG$"), "Sing").when(F.col("key").rlike("PL$"), "Plur")
    keys = t["g_concord"].select("lang", "key").distinct()
    joined = keys.join(ud_classes(t).withColumnRenamed("nc", "key"), ["lang", "key"], "left")
    return joined.select("lang", "key", F.when(person != "", person).otherwise(F.when(F.col("key").startswith("NC"), "3")).alias("person"), F.coalesce(number, joined["number"]).alias("number"), "feature")


def ud_voice(c: Column) -> Column:
    """Voice of an extension by its id, else by a word of its meaning."""
    by_id = lookup(F.upper(c), table_of("PASS=Pass CAUS=Caus APPL=Appl RECP=Rcp REFL=Rfl"))
    return F.coalesce(by_id, *(F.when(F.lower(c).contains(k), v) for k, v in table_of("passiv=Pass causativ=Caus applicativ=Appl reciproc=Rcp reflexiv=Rfl").items()), F.lit("Act"))


def ud_tokens(morphs: DataFrame) -> DataFrame:
    """Features of tokens from morphemes (``token, pos, feature, value``): the first wins, but Voice by rank."""
    rank = lookup(F.col("value"), {v: str(i) for i, v in enumerate("Pass Caus Appl Rcp Rfl Act".split())}).cast("int")
    order = F.struct(F.when(F.col("feature") == "Voice", F.coalesce(rank, F.lit(9))).otherwise(0), "pos", "value")
    first = morphs.groupBy("token", "feature").agg(F.min_by("value", order).alias("value"))
    return first.groupBy("token").agg(F.array_join(F.array_sort(F.collect_list(F.concat("feature", F.lit("="), "value"))), "|").alias("feats"))


def tam_by_gloss(glosses: DataFrame, tam: DataFrame) -> DataFrame:
    """``gloss, tam_id``: an id itself, else the first marker with this gloss. ``tam``: ``tam_id, ord, gloss``."""
    exact = glosses.join(tam.select(F.col("tam_id").alias("exact")), F.col("gloss") == F.col("exact"), "left")
    first = tam.groupBy("gloss").agg(F.min_by("tam_id", "ord").alias("first"))
    return exact.join(first, "gloss", "left").select("gloss", F.coalesce("exact", "first").alias("tam_id"))


# checks of slot assignments


def violations(a: DataFrame, t: dict[str, DataFrame], lang: str, rules: dict) -> DataFrame:
    """``case_id, rule, slot_id, form``: every broken rule of the assignments.

    ``a``: ``case_id, idx, slot_id, content_type, form, gloss, nc``; ``rules``: ``order, incompatible, max, typical``.
    One query for each rule over a table that is read once for all of them if the caller keeps it.
    """
    slots = t["g_slot"].filter(F.col("lang") == lang).select("slot_id", "position", "obligatory", "types")
    a = a.join(F.broadcast(slots), "slot_id", "left")
    cases, case = a.select("case_id").distinct(), Window.partitionBy("case_id").orderBy("idx")
    out = lambda df, rule: df.select("case_id", F.lit(rule).alias("rule"), "slot_id", "form")
    known = lambda kind: F.broadcast(t["g_concord"].filter((F.col("lang") == lang) & F.col("concord_type").startswith(kind)).select(F.col("form")).distinct())
    needed = cases.crossJoin(F.broadcast(slots.filter("obligatory").select("slot_id"))).join(a.filter("form <> ''").select("case_id", "slot_id").distinct(), ["case_id", "slot_id"], "left_anti").withColumn("form", F.lit(None).cast("string"))
    twice = a.withColumn("n", F.row_number().over(Window.partitionBy("case_id", "slot_id").orderBy("idx"))).filter("n > 1 and content_type <> 'extension'")
    ext = a.filter("content_type = 'extension'")
    dim = t["g_extension"].filter(F.col("lang") == lang).select(F.col("ext_id").alias("gloss"), "zone", "ord")
    e = ext.join(F.broadcast(dim), "gloss", "left").withColumn("rank", lookup(F.col("gloss"), {x: str(i) for i, x in enumerate(rules.get("order", ()))}).cast("int"))
    z = e.withColumn("zone_before", F.last("zone", ignorenulls=True).over(case.rowsBetween(Window.unboundedPreceding, -1)))
    r = e.withColumn("rank_before", F.lag("rank").over(Window.partitionBy("case_id", "zone").orderBy("idx")))
    n = e.withColumn("n", F.count("*").over(Window.partitionBy("case_id"))).withColumn("last", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("idx"))))
    pairs = rules.get("incompatible", ())
    other = e.select("case_id", F.col("gloss").alias("other")).distinct()
    bad = reduce(lambda x, y: x | y, ((F.col("gloss") == p) & (F.col("other") == q) for p, q in (sorted(x) for x in pairs)), F.lit(False))
    forms = lambda kind: a.filter(F.col("content_type") == kind).join(known(kind), "form", "left_anti")
    negs = a.filter("content_type = 'negation'").select("case_id", "slot_id", "form").withColumn("k", F.count("*").over(Window.partitionBy("case_id")))
    plural = a.filter("content_type = 'subject_concord'").select("case_id", F.col("nc").alias("subject"))
    reciprocal = e.filter("gloss = 'RECP'").join(plural, "case_id").filter(~(F.col("subject").endswith("PL") | F.col("subject").isin(*(f"NC{k}" for k in (2, 4, 6, 8, 10, 13)))))
    found = [
        out(needed, "OBLIG_SLOT_MISSING"), out(twice, "SLOT_DUPLICATE"), out(a.filter("position is null"), "UNKNOWN_SLOT"), out(a.filter("position is not null and not array_contains(types, content_type)"), "CONTENT_TYPE_MISMATCH"),
        out(a.withColumn("before", F.lag("position").over(case)).filter("position < before"), "SLOT_OUT_OF_ORDER"), out(forms("subject_concord"), "INVALID_SUBJECT_CONCORD"), out(forms("object_concord"), "INVALID_OBJECT_CONCORD"),
        out(e.filter("zone is null"), "INVALID_EXTENSION"), out(n.filter((F.col("n") > rules.get("max", 3)) & (F.col("last") == 1)), "EXT_MAX_EXCEEDED"), out(n.filter((F.col("n") > rules.get("typical", 2)) & (F.col("n") <= rules.get("max", 3)) & (F.col("last") == 1)), "EXT_TYPICAL_MAX_EXCEEDED"),
        out(z.filter("zone < zone_before"), "EXT_ZONE_ORDER"), out(r.filter("rank < rank_before"), "EXT_INTRA_ZONE_ORDER"), out(e.join(other, "case_id").filter(bad).dropDuplicates(["case_id", "gloss", "other"]), "EXT_INCOMPATIBLE"),
        out(n.filter("gloss = 'PASS' and last > 1"), "EXT_PASS_NOT_FINAL"), out(negs.filter("k > 1").dropDuplicates(["case_id"]).withColumn("slot_id", F.lit(None).cast("string")).withColumn("form", F.lit(None).cast("string")), "NEG_EXCLUSIVE"), out(reciprocal, "RECIP_REQUIRES_PLURAL"),
    ]
    return reduce(DataFrame.unionByName, found)


def extension_order(cases: DataFrame, t: dict[str, DataFrame], lang: str, rules: dict) -> DataFrame:
    """Broken rules of bare lists of extensions (``case_id, ids``): unknown ids, order, number, pairs that don't go together."""
    a = cases.select("case_id", F.posexplode("ids").alias("idx", "gloss")).select("case_id", "idx", F.lit("EXT").alias("slot_id"), F.lit("extension").alias("content_type"), F.col("gloss").alias("form"), "gloss", F.lit(None).cast("string").alias("nc"))
    return violations(a, t, lang, rules).filter("rule like 'EXT%' or rule = 'INVALID_EXTENSION'")


def slot_coverage(a: DataFrame) -> DataFrame:
    return a.groupBy("slot_id").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


GRAMMAR_RULES = G.LEXEME["extension_rules"]
