"""Word structure: affix matches, noun and verb analyses, and forms made from features.

An analysis depends on a word's form alone. ``analysed_tokens`` makes it once for each distinct form of an Arrow batch, with
a memo in each worker, and so needs no exchange; the other operators take a table of distinct forms. Affix matches are built-in
expressions: one alternation, the longest first. Only the searches with branches (verb parse, slot parser) are Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import reduce
from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship
from . import grammar as G

TOP, ACCEPT_VERB, ACCEPT_NOUN, TOP_NOUN = 5, 0.20, 0.15, 3
WEIGHTS = {"lexicon": 0.40, "verified": 0.02, "FV": 0.15, "TAM": 0.10, "SM": 0.08, "OM": 0.05, "EXT": 0.05, "NEG": 0.03, "whole": 0.05}
SLOTS = ("NEG", "SM", "TAM", "OM", "ROOT", "EXT", "FV")


def longest_first(forms: Iterable[str]) -> str:
    return "|".join(re.escape(x) for x in sorted({f for f in forms if f}, key=lambda x: (-len(x), x)))


def prefix(c: Column, forms: Iterable[str]) -> Column:
    """The longest of ``forms`` that ``c`` begins with and goes on after; empty if there is none."""
    return F.regexp_extract(c, f"^({longest_first(forms)})(.+)$", 1)


def suffix(c: Column, forms: Iterable[str]) -> Column:
    return F.regexp_extract(c, f"^(.+?)({longest_first(forms)})$", 2)


def table_of(words: str) -> dict[str, str]:
    """A mapping written as ``key=value`` words."""
    return dict(w.split("=") for w in words.split())


def lookup(c: Column, pairs: dict[str, str]) -> Column:
    """Value of a small mapping; null if the key isn't there."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), c)


def distinct_forms(tokens: DataFrame, form: str = "form") -> DataFrame:
    return tokens.select(F.lower(form).alias(form)).distinct()


def joined_back(tokens: DataFrame, analysed: DataFrame, form: str = "form") -> DataFrame:
    """Each token with its form's analysis."""
    return tokens.join(analysed.withColumnRenamed(form, "__form"), F.lower(tokens[form]) == F.col("__form"), "left").drop("__form")


#: A lexicon of more rows isn't sent to every task.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """Sent to every task if it has at most ``SMALL`` rows; a larger one is joined as Catalyst sees fit."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def lexicon_probe(forms: DataFrame, nouns: DataFrame, verbs: DataFrame) -> DataFrame:
    """``forms`` with ``category, lemma, cut``: an exact noun, else an exact verb, else a verb after 1 to 3 last letters are cut; ``cut`` is -1 if nothing is found.

    ``nouns`` and ``verbs`` have a ``root``; a left join for each key, without an exchange of ``forms`` if they are ``small``. Other columns of ``forms`` stay.
    """
    out = forms.join(small(nouns.select(F.col("root").alias("noun")).distinct()), F.col("form") == F.col("noun"), "left")
    own = small(verbs.select("root").distinct())
    keys = [F.col("form"), *(F.when(F.length("form") > k, F.substring("form", F.lit(1), F.length("form") - k)) for k in (1, 2, 3))]
    for k, key in enumerate(keys):
        out = out.join(own.select(F.col("root").alias(f"verb{k}")), key == F.col(f"verb{k}"), "left")
    verb = F.coalesce(*(F.col(f"verb{k}") for k in range(4)))
    cut = F.coalesce(*(F.when(F.col(f"verb{k}").isNotNull(), F.lit(k)) for k in range(4)))
    noun = F.col("noun").isNotNull()
    return out.select(*forms.columns, F.when(noun, "noun").when(verb.isNotNull(), "verb").alias("category"), F.coalesce("noun", verb).alias("lemma"), F.when(noun, 0).otherwise(F.coalesce(cut, F.lit(-1))).alias("cut"))


def noun_analyses(forms: DataFrame, classes: DataFrame, stems: DataFrame, augments: Iterable[str] = G.AUGMENTS, top: int = TOP_NOUN) -> DataFrame:
    """``form, rank, nc, prefix, stem, score``: the best classes by prefix and lexicon, at most ``top`` each.

    A form is tried as it is and without its longest augment, with every class whose prefix it begins with. Score: stem known .50, of
    this class .20, verified .05, a prefix that isn't empty .15, a stem of two letters .05. A form that fits no class but is a known stem itself has
    .30. Equal scores: the form as it is first, then the longest prefix, then the order of the classes. ``classes``: ``nc, nc_order, prefix``; ``stems``:
    ``root, nc, verified``.
    """
    dim = small(classes.select("nc", "nc_order", "prefix"))
    augment = prefix(F.col("form"), augments) if augments else F.lit("")
    tried = forms.select("form", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("cand"), F.col("form").alias("word")), F.when(augment != "", F.struct(F.lit(1).alias("cand"), F.substring("form", F.length(augment) + 1, F.length("form")).alias("word")))))).alias("c")).select("form", "c.*")
    hit = tried.join(dim, F.startswith(F.col("word"), F.col("prefix")) & (F.length("word") > F.length("prefix")))
    hit = hit.withColumn("stem", F.substring("word", F.length("prefix") + 1, F.length("word")))
    s = small(stems.select(F.col("root").alias("stem"), F.col("nc").alias("stem_nc"), "verified"))
    hit = hit.join(s, "stem", "left")
    known = F.col("stem_nc").isNotNull()
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    score = part(known, 0.50) + part(F.col("stem_nc") == F.col("nc"), 0.20) + part(known & F.col("verified"), 0.05) + part(F.length("prefix") > 0, 0.15) + part(F.length("stem") >= 2, 0.05)
    hit = hit.select("form", "cand", "nc", "nc_order", "prefix", "stem", F.round(score, 2).alias("score"))
    if "" not in {r.prefix for r in classes.filter("prefix = ''").limit(1).collect()}:  # else every form fits a class
        bare = forms.select("form").join(hit.select("form").distinct(), "form", "left_anti").join(s, F.col("form") == F.col("stem"))
        hit = hit.union(bare.select("form", F.lit(0), F.col("stem_nc"), F.lit(0), F.lit(""), "stem", F.lit(0.30)))
    order = Window.partitionBy("form").orderBy(F.desc("score"), "cand", F.desc(F.length("prefix")), "nc_order")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("form", "rank", "nc", "prefix", "stem", "score")


class NounTables:
    """A grammar's class prefixes and a lexicon of stems, for ``analysed_tokens``; the rules are those of ``noun_analyses``."""

    def __init__(self, data: dict, stems: dict[str, tuple[str, str, bool]], augments: Iterable[str] = G.AUGMENTS):
        self.prefixes = sorted(((p, nc) for nc, ps in G.annotation_tables(data)["classes"] for p in ps), key=lambda x: -len(x[0]))
        self.stems, self.augments = stems, sorted(augments, key=len, reverse=True)
        self.by_length = [(n, {p: [nc for q, nc in self.prefixes if q == p] for p, _ in self.prefixes if len(p) == n}) for n in sorted({len(p) for p, _ in self.prefixes}, reverse=True)]

    def analyse(self, form: str) -> list[tuple[str, str, str, float, bool]]:
        """(class, prefix, stem, score, known), best first."""
        words = [form, *[form[len(a) :] for a in self.augments if form.startswith(a) and len(form) > len(a)][:1]]
        out = []
        for word in words:
            for n, of in self.by_length:
                p = word[:n]
                if p in of and len(word) > n:
                    stem = word[n:]
                    known = self.stems.get(stem)
                    for nc in of[p]:
                        score = (0.50 + 0.20 * (known[1] == nc) + 0.05 * known[2] if known else 0) + 0.15 * bool(p) + 0.05 * (len(stem) >= 2)
                        out.append((nc, p, stem, round(score, 2), known is not None))
        if not out and form in self.stems:
            out = [(self.stems[form][1], "", form, 0.30, True)]
        return sorted(out, key=lambda x: -x[3])[:TOP_NOUN] if len(out) > 1 else out


class VerbTables:
    """A grammar's affixes for the verb parse, the longest first, in the grammar's order among equals."""

    def __init__(self, data: dict, roots: dict[str, tuple[str, bool]], negation=G.NEGATION, final_vowels=G.FINAL_VOWELS):
        t = G.annotation_tables(data)
        by = lambda xs: sorted(((f, k) for k, fs in xs for f in fs if f), key=lambda x: -len(x[0]))
        self.sm = t["subjects"]
        self.om, self.tam, self.ext = by(t["objects"]), by(t["tam"]), by(t["extensions"])
        self.neg, self.fv = by((("NEG", negation),)), by((k, [f]) for f, k in final_vowels)
        self.roots = roots
        # a first look with all forms at once spares most of the loops
        self._some = {k: tuple(f for f, _ in getattr(self, k)) for k in ("om", "tam", "ext", "neg", "fv")} | {"sm": tuple(f for _, fs in self.sm for f in fs)}

    def _starts(self, kind: str, rest: str) -> tuple[str, str] | None:
        """The longest form of a kind that ``rest`` begins with and goes on after."""
        if rest.startswith(self._some[kind]):
            for x in getattr(self, kind):
                if rest.startswith(x[0]) and len(rest) > len(x[0]):
                    return x
        return None

    def _ends(self, kind: str, rest: str) -> tuple[str, str] | None:
        if rest.endswith(self._some[kind]):
            for x in getattr(self, kind):
                if rest.endswith(x[0]) and len(rest) > len(x[0]):
                    return x
        return None

    def hypotheses(self, form: str) -> list[tuple]:
        """``(score, NEG, SM, TAM, OM, root, EXT, FV)`` of every branch, each slot as (form, key) or None, in the order of the search."""
        out: list[tuple] = []
        w, neg = WEIGHTS, self._starts("neg", form)
        for n, rest in [(None, form)] + ([(neg, form[len(neg[0]) :])] if neg else []):
            base = w["whole"] + (w["NEG"] if n else 0)
            hits = []
            if rest.startswith(self._some["sm"]):
                for k, fs in self.sm:  # one form for each class
                    for f in fs:
                        if rest.startswith(f) and len(rest) > len(f):
                            hits.append((f, k))
                            break
            if not hits:
                self._stem(base, (n, None, None, None), rest, out)
            for sm in hits:
                after = rest[len(sm[0]) :]
                tam = self._starts("tam", after)
                tams = [x for x in self.tam if x[0] == tam[0]][:2] if tam else []
                for t in [*tams, None]:
                    left = after[len(t[0]) :] if t else after
                    score = base + w["SM"] + (w["TAM"] if t else 0)
                    om = self._starts("om", left)
                    if om:
                        self._stem(score + w["OM"], (n, sm, t, om), left[len(om[0]) :], out)
                    self._stem(score, (n, sm, t, None), left, out)
        return out

    def _stem(self, score: float, before: tuple, rest: str, out: list) -> None:
        fv = self._ends("fv", rest)
        for f in (fv, None) if fv else (None,):
            left = rest[: -len(f[0])] if f else rest
            now = score + (WEIGHTS["FV"] if f else 0)
            ext = self._ends("ext", left)
            for e in (ext, None) if ext else (None,):
                root = left[: -len(e[0])] if e else left
                known = self.roots.get(root)
                x = now + (WEIGHTS["EXT"] if e else 0) + (WEIGHTS["lexicon"] + WEIGHTS["verified"] * known[1] if known else 0)
                out.append((min(round(x, 4), 1.0), *before, root, e, f))

    def best(self, form: str) -> tuple | None:
        """The first of the best hypotheses."""
        return max(self.hypotheses(form), key=lambda x: x[0], default=None)

    def tied(self, form: str) -> bool:
        """Are there two segmentations of the best score?"""
        all_ = self.hypotheses(form) if form else []
        top = max((x[0] for x in all_), default=0)
        return len(all_) > 1 and len({(*(s and s[0] for s in x[1:5]), x[5], *(s and s[0] for s in x[6:])) for x in all_ if x[0] == top}) > 1

    def parse(self, form: str, top: int = TOP) -> list[tuple[float, dict[str, tuple[str, str]]]]:
        """Hypotheses as (score, slot -> (form, gloss)), best first, at most ``top``, one for each segmentation."""
        best: dict[tuple, tuple[float, int, tuple]] = {}
        found = self.hypotheses(form)
        if top == 1 and found:
            found = [max(found, key=lambda x: x[0])]
        for i, (score, neg, sm, tam, om, root, ext, fv) in enumerate(found):
            slots = (neg, sm, tam, om, (root, self.roots[root][0] if root in self.roots else ""), ext, fv)
            key = tuple(x and x[0] for x in slots)
            if key not in best or score > best[key][0]:
                best[key] = (score, i, slots)
        ranked = sorted(best.values(), key=lambda x: (-x[0], x[1]))[:top]
        return [(score, {k: x for k, x in zip(SLOTS, slots) if x}) for score, _, slots in ranked]


VERB_SCHEMA = "form string, hyp int, score double, neg string, sm string, sm_class string, tam string, tam_id string, om string, om_class string, root string, gloss string, ext string, ext_id string, fv string, fv_id string"


def _verbs(batches: Iterable[pa.RecordBatch], t: VerbTables, top: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in VERB_SCHEMA.split(", ")]
    for b in batches:
        out = []
        for form in b.column(0).to_pylist():
            for i, (score, s) in enumerate(t.parse(form, top) if form else ()):
                get = lambda k, s=s: s.get(k, (None, None))
                out.append((form, i + 1, score, get("NEG")[0], *get("SM"), *get("TAM"), *get("OM"), *get("ROOT"), *get("EXT"), *get("FV")))
        if out:
            kinds = [pa.string(), pa.int32(), pa.float64(), *[pa.string()] * 13]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def verb_parses(forms: DataFrame, tables: VerbTables, top: int = TOP) -> DataFrame:
    """The ``top`` best hypotheses of each form (a one-column table ``form``); those of rank 1 under ``ACCEPT_VERB`` aren't verbs."""
    ship(forms.sparkSession)
    return forms.select("form").mapInArrow(lambda it: _verbs(it, tables, top), VERB_SCHEMA)


ANALYSIS = "score double, neg string, sm string, sm_class string, tam string, tam_id string, om string, om_class string, root string, gloss string, ext string, ext_id string, fv string, fv_id string, nc string, nc_prefix string, stem string, nc_score double, known boolean"
_NOTHING = (None,) * 19


def analysis(form: str, verbs: VerbTables, nouns: NounTables) -> tuple:
    """Values of ``ANALYSIS``: the best verb parse if it reaches ``ACCEPT_VERB``, else the best noun analysis if it reaches ``ACCEPT_NOUN``."""
    best = verbs.best(form) if form else None
    if best and best[0] >= ACCEPT_VERB:
        score, neg, sm, tam, om, root, ext, fv = best
        known, no = verbs.roots.get(root), (None, None)
        return (score, neg and neg[0], *(sm or no), *(tam or no), *(om or no), root, known[0] if known else "", *(ext or no), *(fv or no), None, None, None, None, known is not None)
    noun = nouns.analyse(form)
    if noun and noun[0][3] >= ACCEPT_NOUN:
        nc, p, stem, score, known = noun[0]
        return (*_NOTHING[:14], nc, p, stem, score, known)
    return _NOTHING


def _analysed(batches: Iterable[pa.RecordBatch], verbs: VerbTables, nouns: NounTables, at: tuple[int, int], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in ANALYSIS.split(", ")]
    kinds = [{"double": pa.float64(), "boolean": pa.bool_()}.get(c.split()[1], pa.string()) for c in ANALYSIS.split(", ")]
    new: dict[str, tuple] = {}
    old: dict[str, tuple] = {}
    for b in batches:
        word = pc.if_else(pc.equal(b.column(at[1]), "word"), pc.utf8_lower(b.column(at[0])), pa.scalar(None, pa.string()))
        codes = word.dictionary_encode()
        rows = []
        for form in codes.dictionary.to_pylist():
            got = new.get(form)
            if got is None:
                got = old.get(form) or analysis(normalize("NFC", form), verbs, nouns)
                if len(new) >= most:
                    new, old = {}, new
                new[form] = got
            rows.append(got)
        own = [pa.array(c, k).take(codes.indices) for c, k in zip(zip(*rows), kinds)] if rows else [pa.nulls(b.num_rows, k) for k in kinds]
        yield pa.record_batch([*b.columns, *own], names=[*b.schema.names, *names])


def analysed_tokens(tokens: DataFrame, verbs: VerbTables, nouns: NounTables) -> DataFrame:
    """Tokens (``form``, ``type``, any others) with the columns of ``ANALYSIS``; those whose type isn't ``word`` have nulls. One pass, no exchange."""
    ship(tokens.sparkSession)
    clash = {c.split()[0] for c in ANALYSIS.split(", ")} & {*tokens.columns}
    if clash:
        raise ValueError(f"columns already there: {', '.join(sorted(clash))}")
    at = tokens.columns.index("form"), tokens.columns.index("type")
    return tokens.mapInArrow(lambda it: _analysed(it, verbs, nouns, at), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema] + [ANALYSIS]))


def spans(parse: DataFrame) -> DataFrame:
    """Each morpheme of each hypothesis with half-open offsets: ``form, hyp, slot, morph, start, stop``. A row's own columns have all that is needed, so there is no exchange."""
    morphs = [F.col(s.lower()) for s in SLOTS]
    size = [F.coalesce(F.length(m), F.lit(0)) for m in morphs]
    stops = [reduce(lambda a, b: a + b, size[: i + 1]) for i in range(len(SLOTS))]
    parts = F.array(*(F.when(n > 0, F.struct(F.lit(s).alias("slot"), m.alias("morph"), (stop - n).alias("start"), stop.alias("stop"))) for s, m, n, stop in zip(SLOTS, morphs, size, stops)))
    return parse.select("form", "hyp", F.inline(F.array_compact(parts)))


# phonology

V = "[aeiou]"
#: Boundary rules in order, on parts joined by ``|``. That the first one takes nearly every pair of vowels, so that glides are left for what
#: a grammar's own rules put before these, is kept on purpose: it is the order of the tool whose results these are to match.
RULES = ((rf"({V})\|({V})", "$2"), (rf"i\|({V})", "y$1"), (rf"u\|({V})", "w$1"), (rf"a\|({V})", "$1"), (r"[nŋ]\|b", "mb"), (r"[nŋ]\|d", "nd"), (r"[nŋ]\|g", "ŋg"))
#: Two-level rules of a fuller description: harmony, alternation, glides, coalescence, nasals, elision.
TWO_LEVEL = ((r"([eo][^aeiou|]*)\|i", "$1|e"), (r"l\|([iu])", "d|$1"), (r"k\|([ie])", "c|$1"), (rf"i\|({V})", "y$1"), (rf"u\|({V})", "w$1"), (r"a\|i", "e"), (r"a\|u", "o"), (r"n\|([pb])", "m$1"), (r"n\|([fsvzh])", "$1"), (rf"n\|({V})", "n$1"))


def phonology_rules(data: dict) -> list[tuple[str, str, str]]:
    """``(id, pattern, replacement)`` in the order of their use: rules spelled out, rules known by their names, harmony, nasals, then ``RULES``.

    A rule is spelled out as a mapping with ``pattern`` and ``replacement`` (or ``target``); one that isn't a regular expression doesn't count.
    """
    g = G.canonical(data)["phonology"]
    out: list[tuple[str, str, str]] = []
    for r in g.get("sandhi_rules") or []:
        own = r if isinstance(r, dict) else {"id": str(r)}
        name = str(own.get("id", own.get("name", "rule")))
        if own.get("pattern") is not None:
            try:
                re.compile(own["pattern"])
            except re.error:
                continue
            out.append((name, own["pattern"], re.sub(r"\\(\d)", r"$\1", str(own.get("replacement", own.get("target", ""))))))
            continue
        low = name.lower()
        known = {"coalescence": [(rf"({V})\|({V})", "$2")], "glide": [(rf"i\|({V})", "y$1"), (rf"u\|({V})", "w$1")], "elision": [(rf"{V}\|({V})", "$1")]}
        for key, rules in known.items():
            if key in low:
                out += [(name, *x) for x in rules]
                break
        else:
            if "nasal" in low and "assim" in low:
                out.append((name, r"([nŋmɲ])\|([bdg])", "$1$2"))
    for name in (str(r.get("id", r) if isinstance(r, dict) else r) for r in g.get("vowel_harmony_rules") or []):
        if any(k in name.lower() for k in ("atr", "height", "harmony")):
            out += [(f"{name}:{v.upper()}", rf"{v}([^aeiou|]*)\|a", f"{v}$1{v}") for v in "eo"]
    nasals = sorted({f for x in g.get("nasal_prefixes") or [] for f in G.forms(x)}, key=lambda x: (-len(x), x))
    out += [(f"nasal:{n}", rf"{re.escape(n)}\|([bdg])", f"{n}$1") for n in nasals]
    return out + [(f"common:{i + 1}", *r) for i, r in enumerate(RULES)]


def forward(c: Column, rules=RULES) -> Column:
    """Surface form of parts joined by ``|``: each rule once in its order, then the marks go."""
    return F.replace(reduce(lambda x, r: F.regexp_replace(x, *r), rules, c), F.lit("|"), F.lit(""))


def trace(c: Column, rules=RULES) -> Column:
    """The rules that changed something, by number from 1."""
    out, x = [], c
    for i, r in enumerate(rules):
        y = F.regexp_replace(x, *r)
        out.append(F.when(y != x, F.lit(i + 1)))
        x = y
    return F.array_compact(F.array(*out))


def elided(c: Column, following: Column) -> Column:
    """A last ``a`` goes before a vowel of the next word."""
    return F.when(following.rlike(f"^{V}"), F.regexp_replace(c, "a$", "")).otherwise(c)


def join_two(left: Column, right: Column) -> Column:
    """Glide, else coalescence, else plain joining."""
    a, b = F.substring(left, -1, 1), F.substring(right, 1, 1)
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    rest = F.substring(right, F.lit(2), F.length(right))
    vowel = b.rlike(V)
    pair = F.concat(a, b)
    merged = F.when(pair == "ai", "e").when(pair == "au", "o").when(pair.isin("aa", "ae", "ao"), b)
    return F.when((left == "") | (right == ""), F.concat(left, right)).when((a == "u") & vowel, F.concat(cut(left), F.lit("w"), right)).when((a == "i") & vowel, F.concat(cut(left), F.lit("y"), right)).when(merged.isNotNull(), F.concat(cut(left), merged, rest)).otherwise(F.concat(left, right))


def join_parts(parts: list[Column]) -> Column:
    """A fold inside one expression, as nesting would repeat each part in every rule."""
    return F.aggregate(F.array(*parts), F.lit(""), join_two)


def extension_form(ext: Column, root: Column) -> Column:
    """Suffix with harmony: after a root whose last vowel is e or o, i is e."""
    mid = F.regexp_extract(root, r"([aeiou])[^aeiou]*$", 1).isin("e", "o")
    base = F.when(ext == "APPL", F.when(mid, "el").otherwise("il")).when(ext == "CAUS", F.when(mid, "esy").otherwise("isy")).when(ext == "PASS", "w").when(ext == "STAT", F.when(mid, "ek").otherwise("ik")).when(ext == "RECP", "an").when(ext == "REV", F.when(mid, "olol").otherwise("ulul")).when(ext == "INTENS", F.when(mid, "esesy").otherwise("isisy")).when(ext == "REFL", "li")
    return F.coalesce(base, F.lower(ext), F.lit(""))


def conjugated(cells: DataFrame, before_vowel: dict[str, str] | None = None, negative: str = "ta", infix: bool = False) -> DataFrame:
    """``surface`` of cells (``sm, marker, root, ext, fv, neg_fv, polarity``).

    Order: negation, subject, (infix), tense if affirmative, stem, extension, final vowel. A root's last a goes
    before a vowel; a subject marker takes its form before vowels where it has one.
    """
    no = F.col("polarity") == "neg"
    fv = F.when(no, F.coalesce("neg_fv", "fv")).otherwise(F.col("fv"))
    stem = F.when(fv.rlike(f"^{V}"), F.regexp_replace("root", "a$", "")).otherwise(F.col("root"))
    marker = F.when(no, F.lit("")).otherwise(F.coalesce("marker", F.lit("")))
    middle = F.when(no & F.lit(infix), F.lit(negative)).otherwise(marker)
    after = F.when(middle != "", middle).otherwise(stem)
    sm = F.when(after.rlike(f"^{V}"), F.coalesce(lookup(F.col("sm"), before_vowel), "sm")).otherwise(F.col("sm")) if before_vowel else F.col("sm")
    first = F.when(no & F.lit(not infix), F.lit(negative)).otherwise(F.lit(""))
    return cells.withColumn("surface", join_parts([first, sm, middle, stem, extension_form(F.col("ext"), F.regexp_replace("root", "a$", "")), fv]))


def morpheme_key(cells: DataFrame, negative: str = "ta", infix: bool = False) -> DataFrame:
    """``surface`` and ``slots``, an array of ``label, value`` in the order of the word, of cells as ``conjugated`` takes them."""
    slot = lambda label, value, some=None: F.when(F.lit(True) if some is None else some, F.struct(F.lit(label).alias("label"), value.alias("value")))
    no, dash = F.col("polarity") == "neg", F.lit("-")
    fv = F.when(no, F.coalesce("neg_fv", "fv")).otherwise(F.col("fv"))
    marker = F.when(F.coalesce("marker", F.lit("")) == "", F.lit("∅")).otherwise(F.col("marker"))
    slots = [
        slot("negation", F.concat(F.lit(negative), dash), no & F.lit(not infix)), slot("subject", F.concat("sm", dash)), slot("negation", F.lit(f"-{negative}-"), no & F.lit(infix)), slot("tense", marker, ~no),
        slot("root", F.concat(dash, "root", dash)), slot("extension", F.concat(dash, extension_form(F.col("ext"), F.regexp_replace("root", "a$", "")), dash), F.col("ext").isNotNull()), slot("final vowel", F.concat(dash, fv)),
    ]
    return conjugated(cells, negative=negative, infix=infix).withColumn("slots", F.array_compact(F.array(*slots)))


# slot parser


class SlotParser:
    """Segmentations of a word over a grammar's slots: those before the root from the left, those after it from the right.

    The search is exhaustive; the ``beam`` best hypotheses are given back. ``constraints``: named predicates of the slots found; a hypothesis must pass all of them.
    """

    def __init__(self, data: dict, final_vowels=G.FINAL_VOWELS, special: dict[str, str] | None = None, beam: int = 5):
        r = G.rows("", data)
        slots = sorted(r["g_slot"], key=lambda x: x[2])
        root = next(i for i, s in enumerate(slots) if "verb_root" in s[4])
        concord = lambda kind: [(f, k) for _, c, k, _, f in r["g_concord"] if c.rstrip("s") == kind and f]
        of = {"subject_concord": concord("subject_concord"), "object_concord": concord("object_concord"), "tam": [(x[3], x[1]) for x in r["g_tam"] if x[3]], "extension": [(f, x[1]) for x in r["g_extension"] for f in (x[3], *x[4]) if f], "final_vowel": list(final_vowels), "negation": [(n, "NEG") for n in G.NEGATION]}
        forms = lambda s: sorted({x for kind in s[4] for x in of.get(kind, ())}, key=lambda x: (-len(x[0]), x))
        self.before, self.after = [(s[1], forms(s)) for s in slots[:root]], [(s[1], forms(s)) for s in reversed(slots[root + 1 :])]
        self._some = {name: tuple(f for f, _ in own) for name, own in self.before + self.after}  # a first look with all forms at once
        self.obligatory = {s[1] for s in slots if s[3]}
        self.order, self.beam, self.root = [s[1] for s in slots], beam, slots[root][1]
        self.special = special or {}
        self.prefixes = [(p, nc) for nc, ps in G.annotation_tables(data)["classes"] for p in ps if p]
        self.spelling = G.rows("", data)["g_tokenization"][0][5]
        self.constraints: dict = {"root": lambda s: bool(s[self.root][0])}

    def add_constraint(self, name: str, predicate) -> None:
        self.constraints[name] = predicate

    def normalise(self, word: str) -> str:
        return reduce(lambda x, kv: x.replace(*kv), self.spelling.items(), word.lower())

    def analyse(self, word: str) -> list[tuple[float, str, str]]:
        """(score, segmentation, glosses) of the verbal and the nominal hypotheses, one for each segmentation, best first."""
        word = self.normalise(word)
        if word in self.special:
            return [(1.0, word, self.special[word])]
        return self._best([*self._slots(word), *self._classes(word)]) or [(0.0, word, "UNKNOWN")]

    def verbal(self, word: str) -> list[tuple[float, str, str]]:
        """Hypotheses over the verb's slots alone."""
        return self._best(self._slots(self.normalise(word)))

    def nominal(self, word: str) -> list[tuple[float, str, str]]:
        """Class prefix and stem, half sure as nothing else speaks for them."""
        return self._best(self._classes(self.normalise(word)))

    def _best(self, hypotheses: list[tuple[float, str, str]]) -> list[tuple[float, str, str]]:
        best: dict[str, tuple[float, str]] = {}
        for score, text, gloss in hypotheses:
            if text not in best or score > best[text][0]:
                best[text] = (score, gloss)
        return sorted(((x, t, g) for t, (x, g) in best.items()), key=lambda x: (-x[0], x[1]))[: self.beam]

    def _classes(self, word: str) -> list[tuple[float, str, str]]:
        return [(0.5, f"{p}-{word[len(p) :]}", f"{nc}-ROOT") for p, nc in self.prefixes if word.startswith(p) and len(word) > len(p)]

    def _slots(self, word: str) -> list[tuple[float, str, str]]:
        found = [({}, word)]
        for name, forms in self.before:
            found = self._step(found, name, forms, self._some[name], str.startswith, lambda rest, f: rest[len(f) :])
        for name, forms in self.after:
            found = self._step(found, name, forms, self._some[name], str.endswith, lambda rest, f: rest[: len(rest) - len(f)])
        out = []
        for slots, rest in found:
            slots = {**slots, self.root: (rest, "ROOT")}
            if all(p(slots) for p in self.constraints.values()):
                own = [s for s in self.order if s in slots]
                out.append((self.score(word, slots, own), "-".join(slots[s][0] for s in own), "-".join(slots[s][1] for s in own)))
        return out

    @staticmethod
    def _step(found, name, forms, some, fits, rest_of):
        out = []
        for slots, rest in found:
            out.append((slots, rest))
            if fits(rest, some):
                out += [({**slots, name: x}, rest_of(rest, x[0])) for x in forms if fits(rest, x[0]) and len(rest) > len(x[0])]
        return out

    def score(self, word: str, slots: dict, own: list[str]) -> float:
        root = slots[self.root][0]
        spelt = "".join(slots[s][0] for s in own)
        covered = min(len(spelt) / max(1, len(word)), 1.0)
        alike = 1.0 if spelt == word else SequenceMatcher(None, word, spelt).ratio()  # equal ones, as the search finds them, needn't be matched
        return round(covered * 0.40 + len(self.obligatory & {*own}) / max(1, len(self.obligatory)) * 0.20 + (0.10 if root else 0) + min(len(root) / 4, 1) * 0.10 + alike * 0.20, 4)


def _app(batches: Iterable[pa.RecordBatch], parser: SlotParser) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [(form, i + 1, *x) for form in b.column(0).to_pylist() if form for i, x in enumerate(parser.analyse(form))]
        if out:
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["form", "rank", "score", "segmentation", "gloss"])


def app_analyses(forms: DataFrame, parser: SlotParser) -> DataFrame:
    """``form, rank, score, segmentation, gloss`` of each distinct form."""
    ship(forms.sparkSession)
    return forms.select("form").mapInArrow(lambda it: _app(it, parser), "form string, rank int, score double, segmentation string, gloss string")


def hypothesis_union(verbal: DataFrame, nominal: DataFrame, top: int = TOP) -> DataFrame:
    """Analyses of both kinds (``form, segmentation, score``), one for each segmentation, the best first."""
    both = verbal.select("form", "segmentation", "score").unionByName(nominal.select("form", "segmentation", "score")).groupBy("form", "segmentation").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("score"), "segmentation"))).filter(F.col("rank") <= top)


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of half-open spans (``start, stop``) of one key that overlap; the spans of ``b`` as ``b_start, b_stop``."""
    other = b.select(*keys, F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    return a.join(other, keys).filter((F.col("start") < F.col("b_stop")) & (F.col("b_start") < F.col("stop")))


def interlinear(analyses: DataFrame) -> DataFrame:
    return analyses.select("form", "rank", F.concat_ws("\n", "segmentation", "gloss").alias("text"))


def register_functions(spark, parser: SlotParser) -> None:
    """``analyse_word(text)`` as a SQL function: JSON of the ranked analyses."""
    import json

    @F.arrow_udf(StringType())
    def analyse_word(words: pa.Array) -> pa.Array:
        return pa.array([None if w is None else json.dumps(parser.analyse(w)) for w in words.to_pylist()], pa.string())

    spark.udf.register("analyse_word", analyse_word)


def tam_gloss(tense: Column, aspect: Column, mood: Column) -> Column:
    """Abbreviations joined by full stops; what is none or indicative isn't written."""
    short = {"present": "PRS", "past": "PST", "future": "FUT", "perfective": "PFV", "imperfective": "IPFV", "perfect": "PRF", "subjunctive": "SBJV", "imperative": "IMP", "conditional": "COND"}
    one = lambda c: F.when(c.isNull() | c.isin("none", "indicative"), None).otherwise(F.coalesce(lookup(c, short), F.upper(c)))
    return F.concat_ws(".", one(tense), one(aspect), one(mood))


def fst_tags(c: Column) -> Column:
    """Tags of a transducer's line ``lemma+TAG+TAG<weight>``: lemma, tags and their kinds."""
    plain = F.regexp_replace(F.regexp_replace(c, r"<[0-9.]+>$|\t.*$", ""), r"@[^@]*@", "")
    parts = F.split(plain, r"\+")
    kind = lambda t: F.when(t.rlike(r"^SM|^SC"), "subject_concord").when(t.rlike(r"^OM|^OC"), "object_concord").when(t.rlike(r"^NC\d"), "noun_class").when(t.rlike(r"^(PRES|PAST|FUT|PERF|HAB|SUBJ|COND|IMP)"), "tam").when(t.rlike(r"^(APPL|CAUS|PASS|RECP|STAT|REV|INTENS|REFL)"), "extension").when(t == "NEG", "negation").when(t == "FV", "final_vowel").when(t.rlike(r"^(Sg|Pl)$"), "number").when(t.rlike(r"^[123]$"), "person").when(t.rlike(r"^(N|V|ADJ|ADV|PRON|NUM|CONJ|INTERJ|IDEO)$"), "category").otherwise("other")
    tags = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.struct(parts[0].alias("lemma"), tags.alias("tags"), F.transform(tags, kind).alias("kinds"), c.endswith("+?").alias("failed"))


def fst_lookup(lines: DataFrame) -> DataFrame:
    """Captured lookup output (``line``: ``surface\tanalysis\tweight``) as ranked rows; failures have no tags."""
    p = F.split("line", "\t")
    rows = lines.filter(F.col("line") != "").select(p[0].alias("surface"), p[1].alias("analysis"), F.try_element_at(p, F.lit(3)).cast("double").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("surface").orderBy(F.col("weight").asc_nulls_last(), "analysis"))
    return rows.withColumn("rank", rank).withColumn("parsed", fst_tags(F.col("analysis")))


def word_of_day(day: Column, n: int) -> Column:
    """Place in a list of ``n`` words for a date."""
    return F.pmod(F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day), F.lit(n))


def quiz(words: DataFrame, seed: int = 0, wrong: int = 3) -> DataFrame:
    """``word, answer, options``: the gloss and ``wrong`` others in a seeded order. ``words``: a word bank (small) of ``word, gloss``."""
    other = words.select(F.col("gloss").alias("other"))
    pairs = words.join(F.broadcast(other), F.col("gloss") != F.col("other")).distinct()
    n = F.row_number().over(Window.partitionBy("word").orderBy(F.xxhash64("word", "other", F.lit(seed)), "other"))
    picked = pairs.withColumn("n", n).filter(F.col("n") <= wrong).groupBy("word", "gloss").agg(F.collect_list("other").alias("others"))
    order = lambda o: F.transform(F.array_sort(F.transform(o, lambda x: F.struct(F.xxhash64(F.col("word"), x, F.lit(seed + 1)).alias("h"), x.alias("x")))), lambda s: s["x"])
    return picked.select("word", F.col("gloss").alias("answer"), order(F.concat("others", F.array("gloss"))).alias("options"))
