"""Grammars: three layouts read into one, checked, and given as small dimension tables.

Everything here is of a grammar's size and happens on the driver.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "g_metadata": "lang string, iso string, guthrie string, version string, min_v string, max_v string, verify_count int",
    "g_noun_class": "lang string, nc string, nc_order int, prefix string, allomorphs array<string>, domain string, active boolean, sg_of string, pl_of string",
    "g_concord": "lang string, concord_type string, key string, key_order int, form string",
    "g_tam": "lang string, tam_id string, ord int, form string, tense string, aspect string, mood string",
    "g_extension": "lang string, ext_id string, ord int, form string, allomorphs array<string>, zone string, sem string",
    "g_slot": "lang string, slot_id string, position int, obligatory boolean, types array<string>",
    "g_pattern": "lang string, pattern_id string, name string, input string, output string, operation string, target_nc string",
    "g_phonology": "lang string, vowels array<string>, consonants array<string>, nasal_prefixes array<string>, tone_system string, sandhi array<string>, harmony array<string>",
    "g_tokenization": "lang string, boundary string, clitics array<string>, strip array<string>, special map<string,string>, spelling map<string,string>",
    "g_verify": "lang string, path string, value string, note string, source string, resolved boolean",
}
REQUIRED = {"metadata": ("language", "iso_code", "grammar_version"), "noun_classes": (), "concords": (), "tam": (), "extensions": (), "slots": ()}
KNOWN = {*REQUIRED, "phonology", "tokenization", "patterns", "verify"}
VERSION = (1, 0, 0)
FLAG = re.compile(r"\s*VERIFY:.*$", re.S)


class GrammarError(ValueError):
    """A grammar that can't be read."""


class UnknownLanguage(GrammarError):
    pass


class UnresolvedFlags(GrammarError):
    pass


class NotFound(GrammarError, KeyError):
    """No such entry; the message names those that there are."""

    __str__ = GrammarError.__str__


def semver(text: str) -> tuple[int, int, int]:
    """Three numbers, padded with zeros."""
    if not re.fullmatch(r"\d+(\.\d+){0,2}", str(text)):
        raise GrammarError(f"no version: {text}")
    return tuple(([*map(int, str(text).split(".")), 0, 0])[:3])


def in_range(version: str, least: str | None, most: str | None) -> bool:
    return (least is None or semver(least) <= semver(version)) and (most is None or semver(version) <= semver(most))


def natural(key: str) -> tuple[int, str]:
    """Order of class ids: by number, then by what follows; others last."""
    m = re.match(r"NC(\d+)(.*)$", key)
    return (int(m[1]), m[2]) if m else (9999, key)


def stripped(value):
    """Without a note from ``VERIFY:`` on, at any depth."""
    if isinstance(value, str):
        return FLAG.sub("", value)
    if isinstance(value, dict):
        return {k: stripped(v) for k, v in value.items()}
    return [stripped(v) for v in value] if isinstance(value, list) else value


def flags(value, path: str = "") -> list[tuple[str, str, str]]:
    """(path, value, note) of each text with an open question."""
    if isinstance(value, str) and "VERIFY:" in value:
        left, _, note = value.partition("VERIFY:")
        return [(path, left.strip(), note.strip())]
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    return [x for k, v in items for x in flags(v, ".".join(filter(None, (path, str(k)))))]


def without_keys(value, names: set[str]):
    """Named keys dropped at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(v, names) for k, v in value.items() if k not in names}
    return [without_keys(v, names) for v in value] if isinstance(value, list) else value


def read(path: str) -> dict:
    """A YAML mapping."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise GrammarError(f"{path} is no mapping")
    return data


def _first(x: dict, *keys, default=None):
    return next((x[k] for k in keys if x.get(k) is not None), default)


def _form(x) -> str:
    """A form as text: the first of several, without hyphens."""
    if isinstance(x, dict):
        x = _first(x, "form", "forms", "prefix", "marker", "canonical_form", default="")
    if isinstance(x, (list, tuple)):
        x = x[0] if x else ""
    return str(x or "").strip("-∅").replace("-", "")


def forms(x) -> list[str]:
    """Every form of an entry, its allomorphs too, without hyphens; markers of an empty form don't count."""
    if isinstance(x, dict):
        own = _first(x, "form", "forms", "prefix", "marker", "canonical_form", default=[])
        x = [*(own if isinstance(own, (list, tuple)) else [own]), *(x.get("allomorphs") or [])]
    elif not isinstance(x, (list, tuple)):
        x = [x]
    return list(dict.fromkeys(f for f in (_form(y) for y in x) if f))


def _items(x) -> list[tuple[str, dict]]:
    """A mapping or a list of entries with ids as pairs."""
    if isinstance(x, dict):
        return [(str(k), v if isinstance(v, dict) else {"form": v}) for k, v in x.items() if k not in ("notes", "note")]
    return [(str(_first(v, "id", "name")), v) for v in x or []]


SECTIONS = KNOWN | {"verb_system", "noun_class_system", "concord_system", "tam_markers", "verb_extensions", "verb_slots", "derivational_patterns", "extension_rules", "negation", "negation_infix"}


def unwrapped(data: dict) -> dict:
    """What is under a grammar's only key, unless that key names a section itself."""
    return next((v for k, v in data.items() if len(data) == 1 and isinstance(v, dict) and k not in SECTIONS), data)


def canonical(data: dict) -> dict:
    """Wrapped, production and canonical layouts as one."""
    inner = unwrapped(data)
    verbs = inner.get("verb_system") or {}
    parts = verbs.get("verbal_system_components") or verbs
    nouns, concords = inner.get("noun_class_system") or {}, inner.get("concord_system") or {}
    out = {
        "metadata": {k: str(v) for k, v in (inner.get("metadata") or {}).items() if not isinstance(v, (dict, list))},
        "noun_classes": _items(_first(inner, "noun_classes", default=_first(nouns, "noun_classes", "classes", default={}))),
        "concords": {k: {n: _form(f) for n, f in _items(v if not isinstance(v, dict) else v.get("concords", v))} for k, v in _first(inner, "concords", default=_first(concords, "concords", default={})).items() if k not in ("notes", "note")},
        "concord_forms": {k: {n: forms(f) for n, f in _items(v if not isinstance(v, dict) else v.get("concords", v))} for k, v in stripped(_first(inner, "concords", default=_first(concords, "concords", default={}))).items() if k not in ("notes", "note")},
        "tam": _items(_first(inner, "tam", "tam_markers", default=_first(parts, "tam", "tam_markers", default={}))),
        "extensions": _items(_first(inner, "extensions", "verb_extensions", default=_first(parts, "derivational_extensions", "extensions", default={}))),
        "slots": _items(_first(inner, "slots", "verb_slots", default=_first(verbs, "verb_slots", "slots", default={}))),
        "patterns": _items(_first(inner, "patterns", "derivational_patterns", default={})),
        "phonology": inner.get("phonology") or {},
        "tokenization": inner.get("tokenization") or {},
        "extension_rules": _first(inner, "extension_rules", default={}),
    }
    out["metadata"]["verify_count"] = len(flags(inner))
    out["open"] = flags(inner)
    return out | {k: stripped(v) for k, v in out.items() if k not in ("open", "noun_classes", "tam", "extensions", "slots", "patterns")} | {k: [(n, stripped(v)) for n, v in out[k]] for k in ("noun_classes", "tam", "extensions", "slots", "patterns")}


def problems(data: dict, strict: bool = False, version: tuple[int, int, int] = VERSION) -> list[tuple[str, str, str]]:
    """(severity, path, what is wrong), empty for a good grammar. ``strict`` makes open questions errors."""
    inner = unwrapped(data)
    g, out = canonical(data), []
    for k in REQUIRED["metadata"]:
        if not g["metadata"].get(k):
            out.append(("error", f"metadata.{k}", "missing"))
    for k in ("noun_classes", "concords", "slots"):
        if not g[k]:
            out.append(("error", k, "missing"))
    production = {"noun_class_system", "concord_system", "verb_system", "extension_rules", "verb_slots", "tam_markers", "verb_extensions", "derivational_patterns"}
    out += [("warning", k, "not known") for k in inner if k not in KNOWN | production]
    own = g["metadata"].get("grammar_version")
    try:
        if own:
            semver(own)
        low, high = g["metadata"].get("min_loader_version"), g["metadata"].get("max_loader_version")
        if low and high and semver(low) > semver(high):
            out.append(("error", "metadata.min_loader_version", "above the greatest"))
        if not in_range(".".join(map(str, version)), low, high):
            out.append(("error", "metadata", "made for another version"))
    except GrammarError as error:
        out.append(("error", "metadata", str(error)))
    classes = {n for n, _ in g["noun_classes"]}
    for n, v in g["noun_classes"]:
        for k in ("singular_counterpart", "plural_counterpart"):
            if v.get(k) and v[k] not in classes:
                out.append(("error", f"noun_classes.{n}.{k}", f"no class {v[k]}"))
    for n, v in g["extensions"]:
        if v.get("zone") not in (None, *"Z1 Z2 Z3 Z4".split()):
            out.append(("error", f"extensions.{n}.zone", f"no zone {v['zone']}"))
    places = [int(v.get("position", 0)) for _, v in g["slots"]]
    if len(set(places)) < len(places):
        out.append(("error", "slots", "two at one place"))
    out += [("error" if strict else "info", p, note or "to be verified") for p, _, note in g["open"]]
    return out


def rows(lang: str, data: dict) -> dict[str, list[tuple]]:
    """A grammar as rows of every table in ``TABLES``."""
    g = canonical(data)
    m, p, t = g["metadata"], g["phonology"], g["tokenization"]
    texts = lambda x: [str(v) for v in (x or [])]
    names = lambda x: [str(v.get("id", v) if isinstance(v, dict) else v) for v in (x or [])]
    return {
        "g_metadata": [(lang, m.get("iso_code"), m.get("guthrie"), m.get("grammar_version"), m.get("min_loader_version"), m.get("max_loader_version"), int(m["verify_count"]))],
        "g_noun_class": [(lang, n, i, _form(v.get("prefix", v)), [_form(a) for a in texts(v.get("allomorphs"))], v.get("semantic_domain"), bool(v.get("active", True)), v.get("plural_counterpart"), None if v.get("plural_counterpart") else v.get("singular_counterpart")) for i, (n, v) in enumerate(sorted(g["noun_classes"], key=lambda x: natural(x[0])))],
        "g_concord": [(lang, kind, n, i, f) for kind, entries in g["concords"].items() for i, (n, f) in enumerate(entries.items())],
        "g_tam": [(lang, n, i, _form(v), v.get("tense", "none"), v.get("aspect", "none"), v.get("mood", "indicative")) for i, (n, v) in enumerate(g["tam"])],
        "g_extension": [(lang, n, i, _form(v), [_form(a) for a in texts(v.get("allomorphs"))], v.get("zone"), v.get("semantic_value")) for i, (n, v) in enumerate(g["extensions"])],
        "g_slot": [(lang, n, int(v.get("position", i + 1)), bool(v.get("obligatory", False)), [content(c) for c in texts(v.get("allowed_content_types"))]) for i, (n, v) in enumerate(g["slots"])],
        "g_pattern": [(lang, n, v.get("name"), v.get("input_category"), v.get("output_category"), v.get("operation"), v.get("target_noun_class")) for n, v in g["patterns"]],
        "g_phonology": [(lang, texts(p.get("vowels")), texts(p.get("consonants")), [_form(x) for x in texts(p.get("nasal_prefixes"))], str(_first(p, "tone_system", "tones", default="none")), names(p.get("sandhi_rules")), names(p.get("vowel_harmony_rules")))],
        "g_tokenization": [(lang, t.get("word_boundary_pattern", r"\s+"), texts(t.get("clitic_boundaries")), texts(t.get("strip_patterns")), dict(t.get("special_cases") or {}), dict(t.get("orthographic_normalization") or {}))],
        "g_verify": [(lang, path, value, note, None, False) for path, value, note in g["open"]],
    }


def annotation_tables(data: dict) -> dict[str, list[tuple[str, list[str]]]]:
    """For annotation, every form and allomorph by key: subjects, objects, tenses (nested ones as ``KEY.SUB``), extensions and classes."""
    g = canonical(data)
    tam = []
    for n, v in g["tam"]:
        own = forms(v)
        tam += [(n, own)] if own else [(f"{n}.{k}", forms(w)) for k, w in v.items() if isinstance(w, dict) and forms(w)]
    concords = lambda kind: [(n, f) for k, entries in g["concord_forms"].items() if k.startswith(kind) for n, f in entries.items()]
    classes = [(n, forms(v) or [""]) for n, v in sorted(g["noun_classes"], key=lambda x: natural(x[0]))]
    return {"subjects": concords("subject_concord"), "objects": concords("object_concord"), "tam": tam, "extensions": [(n, forms(v)) for n, v in g["extensions"]], "classes": classes}


def content(kind: str) -> str:
    """Content type of a slot: the last part of a dotted name, concords in the singular."""
    last = kind.split(".")[-1]
    return last[:-1] if last.endswith("concords") else last


def tables(spark: SparkSession, grammars: dict[str, dict]) -> dict[str, DataFrame]:
    every = {lang: rows(lang, data) for lang, data in grammars.items()}
    return {t: spark.createDataFrame([r for g in every.values() for r in g[t]], ddl) for t, ddl in TABLES.items()} | {"g_eav": spark.createDataFrame([r for lang in grammars for r in eav(lang, every[lang])], "lang string, entity string, id string, field string, value string")}


def eav(lang: str, own: dict[str, list[tuple]]) -> list[tuple]:
    """Every fact as (lang, entity, id, field, value)."""
    fact = lambda e, i, **x: [(lang, e, i, k, None if v is None else str(v)) for k, v in x.items()]
    out = []
    for _, n, _, prefix, _, domain, active, sg, pl in own["g_noun_class"]:
        out += fact("noun_class", n, prefix=prefix, domain=domain, active=active, plural=sg, singular=pl)
    for _, kind, key, _, form in own["g_concord"]:
        out += fact("concord", kind, **{key: form})
    for _, n, _, form, tense, aspect, mood in own["g_tam"]:
        out += fact("tam", n, mood=mood, aspect=aspect, tense=tense, form=form)
    for _, n, _, form, _, zone, sem in own["g_extension"]:
        out += fact("extension", n, form=form, zone=zone, sem=sem)
    for _, n, position, obligatory, _ in own["g_slot"]:
        out += fact("slot", n, position=position, obligatory=obligatory)
    return out


def noun_class(data: dict, nc: str) -> dict:
    """One class as a mapping of the columns of ``g_noun_class``; an unknown one raises."""
    names = [c.split()[0] for c in TABLES["g_noun_class"].split(", ")]
    every = {r[1]: dict(zip(names, r)) for r in rows("", data)["g_noun_class"]}
    if nc not in every:
        raise NotFound(f"no class {nc}; known: {', '.join(every)}")
    return every[nc]


def concords(data: dict, kind: str) -> dict[str, str]:
    """Forms of one concord type by key; an unknown type raises."""
    every: dict[str, dict[str, str]] = {}
    for _, k, key, _, form in rows("", data)["g_concord"]:
        every.setdefault(k, {})[key] = form
    if kind not in every:
        raise NotFound(f"no concord type {kind}; known: {', '.join(every)}")
    return every[kind]


def overlaid(data: dict, other: dict) -> dict:
    """``data`` with what ``other`` says anew about the forms of its tenses and about negation; neither is changed.

    A tense of ``other`` counts only where ``data`` has it; its first form replaces the marker. ``negation`` and ``negation_infix`` are added as
    the first forms given under ``negation_pre.present`` and ``negation_infix.negative``.
    """
    inner = unwrapped(other)
    parts = (inner.get("verb_system") or {}).get("verbal_system_components") or inner.get("verb_system") or inner
    own = {n: dict(v) for n, v in canonical(data)["tam"]}
    for n, v in _items(_first(parts, "tam", "tam_markers", default={})):
        if n in own and forms(v):
            own[n]["form"] = forms(v)[0]
    out = {**data, "tam": own}
    for key, path in (("negation", ("negation_pre", "present")), ("negation_infix", ("negation_infix", "negative"))):
        found = forms((parts.get(path[0]) or {}).get(path[1]) or {})
        if found:
            out[key] = found[0]
    return out


class Registry:
    """Grammars by language, read when first asked for; whatever is made of one is kept by (language, name)."""

    def __init__(self, paths: dict[str, str], names: dict[str, tuple[str, ...]] | None = None):
        self.paths, self.alias = dict(paths), aliases({**{k: () for k in paths}, **(names or {})})
        self._made: dict[tuple[str, str], object] = {}

    def languages(self) -> list[str]:
        return sorted(self.paths)

    def resolve(self, name: str) -> str:
        lang = self.alias.get(name.strip().lower())
        if lang not in self.paths:
            raise UnknownLanguage(f"no grammar of {name}; known: {', '.join(self.languages())}")
        return lang

    def get(self, name: str, what: str = "grammar", make=None):
        """The grammar itself, or ``make(grammar)``, made once."""
        lang = self.resolve(name)
        if (lang, what) not in self._made:
            self._made[lang, what] = load(self.paths[lang]) if what == "grammar" else make(self.get(lang))
        return self._made[lang, what]

    def forget(self, name: str | None = None) -> None:
        gone = [k for k in self._made if name is None or k[0] == self.resolve(name)]
        for k in gone:
            del self._made[k]


def load(source: str | dict, strict: bool = False, lang: str | None = None) -> dict:
    """A checked grammar from a path or a mapping; errors raise."""
    data = read(source) if isinstance(source, str) else source
    found = [x for x in problems(data, strict) if x[0] == "error"]
    if found:
        kind = UnresolvedFlags if strict and all("VERIFY" not in x[2] and x[1] in {p for p, *_ in canonical(data)["open"]} for x in found) else GrammarError
        raise kind("; ".join(f"{p}: {w}" for _, p, w in found))
    if lang and canonical(data)["metadata"].get("language", "").lower() != lang.lower():
        raise UnknownLanguage(f"the grammar isn't of {lang}")
    return data


def verify_flags(tables_: dict[str, DataFrame], prefix: str = "") -> DataFrame:
    """Open questions under a path."""
    return tables_["g_verify"].filter(~F.col("resolved") & F.col("path").startswith(prefix))


def natural_order(c) -> tuple:
    """Sort columns of class ids."""
    n = F.regexp_extract(c, r"^NC(\d+)", 1)
    return F.when(n == "", 9999).otherwise(n.cast("int")), F.when(n == "", c).otherwise(F.regexp_extract(c, r"^NC\d+(.*)$", 1))


def active_classes(tables_: dict[str, DataFrame]) -> DataFrame:
    return tables_["g_noun_class"].filter("active").orderBy("lang", *natural_order(F.col("nc")))


def aliases(names: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Lower-case alias to language."""
    return {a.strip().lower(): lang for lang, xs in names.items() for a in (lang, *xs)}


def resolve_language(c, names: dict[str, tuple[str, ...]]):
    """Language of an alias column, null if unknown."""
    return F.create_map(*(F.lit(x) for kv in aliases(names).items() for x in kv))[F.lower(F.trim(c))]


def schema_differences(data: dict) -> dict[str, list[str]]:
    """Missing and unknown sections."""
    g = canonical(data)
    return {"missing": sorted(k for k in REQUIRED if not g.get(k)), "unknown": sorted(p for s, p, w in problems(data) if w == "not known" and s == "warning")}


def report(lang: str, data: dict) -> dict[str, int | list[str]]:
    """Numbers of entries, and what is odd in a grammar's structure."""
    r = rows(lang, data)
    forms = [f for _, _, _, f, *_ in r["g_tam"] if f]
    odd = [f"{n}: no prefix" for _, n, _, p, *_ in r["g_noun_class"] if not p] + [f"{kind}.{k}: no form" for _, kind, k, _, f in r["g_concord"] if not f] + [f"tense form {f} twice" for f in sorted({f for f in forms if forms.count(f) > 1})]
    return {t.removeprefix("g_"): len(x) for t, x in r.items()} | {"odd": odd}


def settings_problems(settings: dict) -> list[str]:
    """What is wrong in a language's settings: ``language`` (letters and underscores), ``path``, ``version``, ``locale``."""
    out = []
    if not re.fullmatch(r"[a-z][a-z0-9_]*", str(settings.get("language", ""))):
        out.append("language")
    if settings.get("path") and not Path(settings["path"]).is_file():
        out.append("path")
    if settings.get("version") and not re.fullmatch(r"\d+(\.\d+){0,2}", str(settings["version"])):
        out.append("version")
    if settings.get("locale") and not re.fullmatch(r"[a-z]{2,3}([_-][A-Z]{2})?", str(settings["locale"])):
        out.append("locale")
    return out


def lexicon(path: str, lang: str) -> list[tuple]:
    """``(lang, cat, root, gloss, nc, pl_nc, verified)`` rows of a YAML lexicon with ``verbs``, ``nouns`` and ``closed_class``."""
    data = read(path)
    entry = lambda x: x if isinstance(x, dict) else {"root": str(x)}
    out = []
    for section, cat in (("verbs", "verb"), ("nouns", "noun"), ("closed_class", "closed")):
        for x in map(entry, data.get(section) or []):
            out.append((lang, x.get("category", cat) if cat == "closed" else cat, _form(_first(x, "root", "stem", "form", default="")), x.get("gloss"), x.get("noun_class"), x.get("plural_class"), bool(x.get("verified", False))))
    return out


LEXICON = "lang string, cat string, root string, gloss string, nc string, pl_nc string, verified boolean"


def word_bank(path: str) -> list[tuple]:
    """``(word, gloss)`` pairs of a YAML list."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    return [(str(_first(x, "word", "form")), x.get("gloss")) if isinstance(x, dict) else (str(x), None) for x in data]


def transducer_source(data: dict, roots: list[str]) -> str:
    """Continuation classes of a verb in the usual lexicon notation, slot by slot."""
    r = rows("", data)
    part = lambda name, forms, after, skip=True: "\n".join([f"LEXICON {name}", *(f"+{k}:{f} {after} ;" for f, k in forms), *([f"{after} ;"] if skip else [])])
    concords = lambda kind: [(f, k) for _, c, k, _, f in r["g_concord"] if c.startswith(kind)]
    return "\n\n".join(["LEXICON Root\nSubject ;", part("Subject", concords("subject"), "Tense", False), part("Tense", [(x[3], x[1]) for x in r["g_tam"] if x[3]], "Object"), part("Object", concords("object"), "Stem"), part("Stem", [(x, x) for x in roots], "Extension", False), part("Extension", [(x[3], x[1]) for x in r["g_extension"]], "Final"), part("Final", FINAL_VOWELS, "#", False)]) + "\n"


#: A compact grammar of our own whose affixes occur in the driver's invented prose, and a sister language that differs a little.
LEXEME = {
    "metadata": {"language": "lexa", "iso_code": "xla", "guthrie": "X10", "grammar_version": "1.0", "min_loader_version": "0.9", "max_loader_version": "2.0.0"},
    "noun_classes": {
        "NC1": {"prefix": "th-", "plural_counterpart": "NC2", "semantic_domain": "human"}, "NC2": {"prefix": "an-", "singular_counterpart": "NC1", "semantic_domain": "human"}, "NC1a": {"prefix": "", "plural_counterpart": "NC2"},
        "NC3": {"prefix": "re-", "plural_counterpart": "NC4"}, "NC4": {"prefix": "er-", "singular_counterpart": "NC3"}, "NC7": {"prefix": "co-", "plural_counterpart": "NC8"}, "NC8": {"prefix": "en-", "singular_counterpart": "NC7"},
        "NC15": {"prefix": "ho-"}, "NC16": {"prefix": "pa-", "semantic_domain": "locative"}, "NC18": {"active": False, "prefix": "mu-", "semantic_domain": "locative"},
    },
    "concords": {
        "subject_concord": {"1SG": "n", "2SG": "u", "NC1": "th", "NC2": "an", "NC3": "re", "NC4": "er", "NC7": "co", "NC8": "en", "NC16": "pa"},
        "object_concord": {"NC1": "ha", "NC2": "ti", "NC3": "wh", "NC7": "ci"},
        "possessive_concord": {"NC1": "tha", "NC2": "ana", "NC3": "rea", "NC4": "era", "NC7": "coa", "NC8": "ena"},
        "adjective_concord": {"NC1": "the", "NC2": "ane", "NC7": ["coe", "ce"]},
    },
    "tam": {"PRES": {"form": "ea", "tense": "present", "aspect": "imperfective"}, "PAST": {"form": "ou", "tense": "past", "aspect": "perfective"}, "FUT": {"form": "eau", "tense": "future"}, "SUBJ": {"form": "", "mood": "subjunctive"}},
    "extensions": {"APPL": {"form": "-or-", "allomorphs": ["er"], "zone": "Z1", "semantic_value": "applicative"}, "CAUS": {"form": "-st-", "zone": "Z1", "semantic_value": "causative"}, "RECP": {"form": "-in-", "zone": "Z2", "semantic_value": "reciprocal"}, "PASS": {"form": "-ed-", "zone": "Z3", "semantic_value": "passive"}},
    "slots": {
        "NEG": {"position": 1, "allowed_content_types": ["negation"]}, "SM": {"position": 2, "obligatory": True, "allowed_content_types": ["concords.subject_concords"]}, "TAM": {"position": 3, "allowed_content_types": ["tam"]}, "OM": {"position": 4, "allowed_content_types": ["concords.object_concords"]},
        "ROOT": {"position": 5, "obligatory": True, "allowed_content_types": ["verb_root"]}, "EXT": {"position": 6, "allowed_content_types": ["extension"]}, "FV": {"position": 7, "obligatory": True, "allowed_content_types": ["final_vowel"]},
    },
    "phonology": {"vowels": list("aeiou"), "consonants": ["b", "c", "d", "h", "n", "r", "t"], "nasal_prefixes": ["n-"], "tone_system": "none", "sandhi_rules": ["SND.1"], "vowel_harmony_rules": ["VH.1"]},
    "tokenization": {"word_boundary_pattern": r"\s+", "special_cases": {"etc": "etc"}, "orthographic_normalization": {"’": "'"}},
    "extension_rules": {"order": ["APPL", "CAUS", "RECP", "PASS"], "incompatible": [["CAUS", "RECP"]], "max": 3, "typical": 2},
}
SISTER = LEXEME | {
    "metadata": {"language": "lexb", "iso_code": "xlb", "guthrie": "X11", "grammar_version": "1.2.0", "min_loader_version": "1.0.0", "max_loader_version": "1.0.0"},
    "noun_classes": {k: v for k, v in LEXEME["noun_classes"].items() if k not in ("NC16", "NC18")} | {"NC1": {"prefix": "thi-", "plural_counterpart": "NC2", "semantic_domain": "human"}, "NC5": {"prefix": "li-  VERIFY: heard in one village only"}},
    "concords": {"subject_concord": LEXEME["concords"]["subject_concord"] | {"NC1": "thi", "NC5": "li"}, "object_concord": {"NC1": "ha", "NC5": "li"}, "possessive_concord": {"NC1": "thia", "NC2": "ana"}},
    "tam": {"PRES": {"form": "ea", "tense": "present", "aspect": "imperfective"}, "PAST": {"form": "ci", "tense": "past", "aspect": "perfective"}},
    "phonology": {"vowels": list("aeiouö"), "consonants": ["b", "c", "d", "n", "r", "t"], "nasal_prefixes": ["n-", "m-"], "tone_system": "high-low"},
}
GRAMMARS = {"lexa": LEXEME, "lexb": SISTER}
AUGMENTS = ("o", "e")
NEGATION, FINAL_VOWELS, LOCATIVE = ("un", "in"), (("e", "IND"), ("ing", "PROG"), ("nd", "PERF"), ("a", "IND"), ("i", "NEG")), ("NC16", "NC17", "NC18")
VERB_ROOTS = {"at": ("throw", True), "on": ("go", True), "ti": ("say", False), "ble": ("can", True), "re": ("see", False), "or": ("pray", True), "ent": ("enter", True), "th": ("be", False)}
NOUN_STEMS = {"tion": ("act", "NC3", True), "ea": ("water", "NC1", True), "or": ("word", "NC4", False), "es": ("village", "NC8", True), "ed": ("day", "NC2", True), "ha": ("child", "NC1", True)}
CLOSED = {"the": "DET", "and": "CCONJ", "of": "ADP", "to": "PART", "a": "DET", "in": "ADP", "is": "AUX", "it": "PRON", "that": "SCONJ", "der": "DET", "die": "DET", "und": "CCONJ", "le": "DET", "la": "DET", "de": "ADP", "et": "CCONJ", "que": "SCONJ", "el": "DET", "y": "CCONJ"}
