"""Annotation of whole sentences in one pass: analysis, tags, agreement links, CoNLL-U.

A row is a sentence: its keys and ``forms``, the array of its tokens. Whatever depends on a form alone (type, analysis, tags, the constant
part of a CoNLL-U line) is worked out once for each distinct form, with a memo in each worker; agreement compares whole batches of
tokens with their neighbours in numpy. So a corpus is annotated without any exchange. ``morph.analysed_tokens``,
``tagging.tagged`` and ``tagging.linked`` do the same for tables of tokens made elsewhere, and give the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from copy import copy
from typing import NamedTuple
from unicodedata import category, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..functions.segment import NUMBER, ROMAN, STRICT_ROMAN
from ..session import ship
from . import grammar as G
from . import tagging as T
from .morph import ACCEPT_VERB, ANALYSIS, NounTables, VerbTables, analysis

FIELDS = [c.split()[0] for c in ANALYSIS.split(", ")]
#: Forms that a worker remembers, twice; few enough for all workers of an executor to have them full on any corpus.
MEMO = 60_000
NOTHING = (None,) * len(FIELDS)
SPECIAL = {"punct": "PUNCT", "number": "NUM", "special": "SYM", "code_switch": "X"}
TAGS = ("upos", "flag", "feats", "xpos", "lemma")


class Entry(NamedTuple):
    """What is known of a form."""

    type: str
    values: tuple  # of ANALYSIS
    tags: tuple  # of TAGS
    subject: str | None  # class that a verb's subject marker asks for
    object: str | None
    modifier: str | None
    seen: str | None  # class as which the form is, or may be, a noun
    confidence: float
    lexicon: bool
    line: str  # CoNLL-U from FORM to DEPREL
    misc: tuple


class Annotator:
    """Rules of ``tagging`` for one form at a time."""

    def __init__(self, verbs: VerbTables, nouns: NounTables, closed: dict[str, str] = G.CLOSED, strict_roman: bool = True, special: Callable[[str], bool] | None = None, switched: Callable[[str], bool] | None = None):
        self.verbs, self.nouns, self.closed, self.special, self.switched = verbs, nouns, closed, special, switched
        self.number = re.compile(f"{NUMBER}|{STRICT_ROMAN}") if strict_roman else re.compile(f"{NUMBER}|{ROMAN.removeprefix('(?i)')}", re.I)
        self.new: dict[str, Entry] = {}
        self.old: dict[str, Entry] = {}
        self.ties: dict[str, bool] = {}
        #: Without ``whole`` an entry has no features, lemma, detailed tag or line.
        self.whole = True

    def __getstate__(self):
        return self.__dict__ | {"new": {}, "old": {}, "ties": {}}

    def short(self) -> Annotator:
        """The same rules for what needs UPOS, flag and analysis alone."""
        out = copy(self)
        out.whole, out.new, out.old = False, {}, {}
        return out

    def type_of(self, form: str) -> str:
        if not form[:1].isalpha():
            if form and all(category(c)[0] in "PS" for c in form):
                return "punct"
        if self.number.match(form):
            return "number"
        if self.special and self.special(form):
            return "special"
        return "code_switch" if self.switched and self.switched(form) else "word"

    def __call__(self, form: str) -> Entry:
        got = self.new.get(form)
        if got is None:
            got = self.old.get(form) or self.safe(form)
            if len(self.new) >= MEMO:
                self.new, self.old = {}, self.new
            self.new[form] = got
        return got

    def tied(self, form: str) -> bool:
        """Do the best verb parses of a form tie?"""
        got = self.ties.get(form)
        if got is None:
            if len(self.ties) >= 2 * MEMO:
                self.ties = {}
            got = self.ties[form] = self.verbs.tied(form.lower())
        return got

    def safe(self, form: str) -> Entry:
        """A form whose analysis fails is an X that says so; it doesn't end the job."""
        try:
            return self.entry(form)
        except Exception as error:
            e = self.bare(form, form.lower(), "word")
            return e._replace(tags=("X", "failed", "", "X", form.lower()), line="\t".join([form.replace("|", "\\p").replace("\t", " "), "_", "X", "_", "_", "_", "_"]), misc=(f"AnnotationFailed={type(error).__name__}",))

    def entry(self, form: str) -> Entry:
        kind, low = self.type_of(form), form.lower()
        values = analysis(low if low.isascii() else normalize("NFC", low), self.verbs, self.nouns) if kind == "word" else NOTHING
        if values == NOTHING:
            return self.bare(form, low, kind)
        score, neg, _, sm, _, tam, _, om, root, *_, nc, _, stem, _, known = values
        sc = sm if sm and sm.startswith("NC") else None
        if score is not None and score >= ACCEPT_VERB:
            upos, flag = "ADP" if sc in G.LOCATIVE and not tam else "VERB" if sc == "NC15" or root else self.closed.get(low) or "X", "parsed"
        else:
            upos, flag = "NOUN", "class"
        seen = nc if nc not in G.LOCATIVE else None
        sure = ({"NOUN": 0.50, "X": 0.20}.get(upos, 0.15) + (0.30 if known else 0.15 if flag == "class" else 0.10)) * (0.30 if neg is not None and om is not None else 1)
        verb = upos in ("VERB", "AUX")
        tags, line, misc = (upos, flag, None, None, None), "", ()
        if self.whole:
            v = dict(zip(FIELDS, values))
            feats = self.features(v, upos, flag, sc)
            lemma = root if flag == "parsed" and root else stem if flag == "class" and known else low
            xpos = self.detail(v, upos, flag, sc, feats)
            text = "|".join(f"{k}={x}" for k, x in sorted(feats.items()))
            tags, misc = (upos, flag, text, xpos, lemma), self.misc(v)
            line = "\t".join([form.replace("|", "\\p").replace("\t", " "), *(x or "_" for x in (lemma, upos, xpos, text)), "_", "_"])
        return Entry(kind, values, tags, sc if verb else None, om if verb and om and om.startswith("NC") else None, seen if upos in T.MODIFIERS else None, seen, round(sure, 3), bool(known), line, misc)

    def bare(self, form: str, low: str, kind: str) -> Entry:
        """A token without an analysis: closed-class words, and what isn't a word."""
        listed = self.closed.get(low) if kind == "word" else None
        upos = SPECIAL.get(kind) or listed or "X"
        flag = "special" if kind != "word" else "closed" if listed else "untagged"
        feats, xpos = "NumType=Card" if kind == "number" else "", "X.CS" if kind == "code_switch" else upos
        line = "\t".join([form.replace("|", "\\p").replace("\t", " "), low or "_", upos, xpos, feats or "_", "_", "_"])
        return Entry(kind, NOTHING, (upos, flag, feats, xpos, low), None, None, None, None, 0.0, False, line, ("CodeSwitch=und",) if kind == "code_switch" else ())

    def features(self, v: dict, upos: str, flag: str, sc: str | None) -> dict[str, str]:
        if flag != "parsed":
            number = re.match(r"NC(\d+)", v["nc"])
            plain = {"NounClass": f"Bantu{v['nc'].removeprefix('NC')}", "Number": number and ("Plur" if number[1] in T.PLURAL else "Sing")}
            return {k: x for k, x in plain.items() if x}
        form = None if upos != "VERB" else "Inf" if sc == "NC15" else "Fin"
        tam, fv = T.features_of(v["tam_id"]) if v["tam_id"] else {}, T.features_of(v["fv_id"], T.FV_FEATS) if v["fv_id"] else {}
        person = re.match(r"([123])(SG|PL)", v["sm_class"] or "")
        out = {"VerbForm": form, "Tense": tam.get("Tense"), "Aspect": fv.get("Aspect", tam.get("Aspect")), "Polarity": "Neg" if v["neg"] is not None else fv.get("Polarity"), "Voice": T.VOICE.get(v["ext_id"], "Act" if upos == "VERB" else None), "SlotScore": f"{v['score']:.2f}"}
        if form != "Inf":
            out["Mood"] = tam.get("Mood", fv.get("Mood", "Ind" if form == "Fin" else None))
            out["Person"] = person[1] if person else "3" if sc else None
            out["Number"] = ("Plur" if v["sm_class"].endswith("PL") else "Sing") if person else ("Plur" if sc.endswith(T.PLURAL) else "Sing") if sc else None
        return {k: x for k, x in out.items() if x}

    @staticmethod
    def detail(v: dict, upos: str, flag: str, sc: str | None, f: dict[str, str]) -> str:
        if upos == "VERB":
            who = f["Person"] + ("PL" if f.get("Number") == "Plur" else "SG") if "Person" in f else None
            parts = [f.get("VerbForm", "Fin").upper(), f.get("Tense", "").upper(), who, f["Voice"].upper() if f.get("Voice", "Act") != "Act" else None]
        elif upos == "NOUN":
            parts = [v["nc"], f.get("Number", "").upper()]
        else:
            parts = ["LOC", sc] if upos == "ADP" and flag == "parsed" and sc else []
        return ".".join([upos, *(p for p in parts if p)])

    @staticmethod
    def misc(v: dict) -> tuple[str, ...]:
        morphs = ",".join(f"{k}={v[c]}" for k, c in (("NEG", "neg"), ("SM", "sm"), ("TAM", "tam"), ("OM", "om"), ("ROOT", "root"), ("EXT", "ext"), ("FV", "fv")) if v[c])
        out = {"NounClass": v["nc"], "NCScore": None if v["nc_score"] is None else f"{v['nc_score']:.3f}", "Score": None if v["score"] is None else f"{v['score']:.3f}", "Morphemes": morphs}
        return tuple(f"{k}={x}" for k, x in out.items() if x)


class Links(NamedTuple):
    """Links of one kind: places of the governors among all tokens of a batch, how many tokens further the nouns are, scores."""

    kind: str
    at: np.ndarray
    off: np.ndarray
    score: np.ndarray


class Sentences:
    """Tokens of a batch of sentences one after another, by distinct form."""

    def __init__(self, forms: pa.ListArray, annotator: Annotator):
        lists = forms.fill_null([]) if forms.null_count else forms
        flat = lists.flatten().dictionary_encode()
        self.codes = flat.indices.to_numpy(zero_copy_only=False)
        self.lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.sent = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pos = np.arange(len(self.codes)) - self.starts[self.sent] + 1
        self.forms, self.annotator = flat.dictionary, annotator
        self.entries = [annotator(f or "") for f in flat.dictionary.to_pylist()]

    def column(self, values: list, kind: pa.DataType) -> pa.Array:
        """One value of each distinct form, for every token."""
        return pa.array(values, kind).take(pa.array(self.codes))

    def links(self, least: float = T.LEAST) -> list[Links]:
        names = {nc: i for i, nc in enumerate(sorted({x for e in self.entries for x in (e.subject, e.object, e.modifier, e.seen) if x}))}
        of = lambda get: np.array([names.get(get(e), -1) for e in self.entries], np.int32)[self.codes] if len(self.codes) else np.empty(0, np.int32)
        seen, conf, lex = of(lambda e: e.seen), np.array([e.confidence for e in self.entries])[self.codes], np.array([e.lexicon for e in self.entries], bool)[self.codes]
        subject = self._nearest(of(lambda e: e.subject), seen, conf, lex, [(T.SUBJECT_WINDOW, True, True)])
        object_ = self._nearest(of(lambda e: e.object), seen, conf, lex, [(T.OBJECT_WINDOW, False, True), (T.OBJECT_WINDOW, True, False)])
        modifier = self._nearest(of(lambda e: e.modifier), seen, conf, np.zeros(len(lex), bool), [(T.MODIFIER_WINDOW, True, True)])
        out = []
        for kind, window, (at, off) in (("subj", T.SUBJECT_WINDOW, subject), ("obj", T.OBJECT_WINDOW, object_), ("mod", T.MODIFIER_WINDOW, modifier)):
            noun = at + off
            score = np.minimum(np.round(conf[noun] * 0.40 + np.where(lex[noun], 0.15, 0.0) + np.maximum(0.0, 1 - np.abs(off) / (window + 1)) * 0.25 + (0.10 if kind == "subj" else 0.05), 3), 1.0)
            ok = score >= least
            out.append(Links(kind, at[ok], off[ok], score[ok]))
        return out

    def _nearest(self, asked: np.ndarray, seen: np.ndarray, conf: np.ndarray, lex: np.ndarray, searches: list[tuple[int, bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest noun of the class that a token asks for, before or after it; of equally near ones that of the lexicon, the surer one, the one before."""
        left, found = np.flatnonzero(asked >= 0), []
        n = len(asked)
        for window, before, after in searches:
            for d in range(1, window + 1):
                b, a = np.maximum(left - d, 0), np.minimum(left + d, n - 1)
                ok = lambda x: (x != left) & (np.abs(x - left) == d) & (self.sent[x] == self.sent[left]) & (seen[x] == asked[left])  # noqa: B023, E731
                ok_b, ok_a = ok(b) & before, ok(a) & after
                surer = (lex[a] & ~lex[b]) | ((lex[a] == lex[b]) & (conf[a] > conf[b]))
                off = np.where(ok_a & (~ok_b | surer), d, np.where(ok_b, -d, 0))
                found.append((left[off != 0], off[off != 0]))
                left = left[off == 0]
        at, off = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at)
        return at[order], off[order]

    def blocks(self) -> list[str]:
        """CoNLL-U lines of each sentence."""
        lines = [e.line for e in self.entries]
        plain = [f"\t_\t{'|'.join(sorted(e.misc)) or '_'}" for e in self.entries]
        codes = self.codes.tolist()
        own = [f"{p}\t{lines[c]}{plain[c]}" for p, c in zip(self.pos.tolist(), codes)]
        notes: dict[int, list] = {}
        for kind, at, off, score in self.links():
            for i, o, x in zip(at.tolist(), off.tolist(), score.tolist()):
                notes.setdefault(i, []).append((kind, "to", o, x))
                notes.setdefault(i + o, []).append((kind, "from", -o, x))
        for i, own_notes in notes.items():
            own[i] = self._linked_line(i, self.entries[codes[i]], own_notes)
        stops = (self.starts + self.lengths).tolist()
        return ["\n".join(own[a:b]) for a, b in zip(self.starts.tolist(), stops)]

    def _linked_line(self, i: int, e: Entry, notes: list) -> str:
        pos = int(self.pos[i])
        upos, _, _, xpos, _ = e.tags
        to, come = {k: o for k, side, o, _ in notes if side == "to"}, [(k, o) for k, side, o, _ in notes if side == "from"]
        nc = e.seen if come or "mod" in to else e.object if "obj" in to else e.subject
        role = "AgreeDem" if upos == "DET" and "DEM" in xpos else "AgreePoss" if upos == "PRON" and "POSS" in xpos else "AgreeAdj"
        agree = [f"AgreeNC={nc}", *(f"{name}={pos + to[k]}" for k, name in (("obj", "AgreeObj"), ("subj", "AgreeSubj"), ("mod", role)) if k in to)]
        agree += [f"{name}={pos + max(o for k2, o in come if k2 == k)}" for k, name in (("subj", "AgreeVerb"), ("obj", "AgreeVerbObj")) if any(k2 == k for k2, _ in come)]
        if to:
            half = sum(x for _, side, _, x in notes if side == "to")
            agree.append(f"ChainScore={min(1.0, (round(half * 1000) + 1) // 2 / 1000):.3f}")
        deps = "|".join(f"{pos + o}:{name}" for k, name in (("subj", "nsubj"), ("obj", "obj")) for k2, o in sorted(come) if k2 == k)
        line = e.line
        if upos == "X" and come:
            parts = line.split("\t")
            parts[2] = "NOUN"
            line = "\t".join(parts)
        return f"{pos}\t{line}\t{deps or '_'}\t{'|'.join(sorted([*agree, *e.misc]))}"


def _arrow(name: str) -> pa.DataType:
    return {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}.get(name, pa.string())


def _groups(b: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each run of rows with equal keys, and each row's run."""
    new = np.zeros(b.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = b.column(b.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _run(sentences: DataFrame, annotator: Annotator, make: Callable, fields: list[tuple[str, pa.DataType]], forms: str, by: list[str] | None = None) -> DataFrame:
    """``make(sentences)`` gives the row of each output row and its columns; the keys, or those of ``by``, are repeated."""
    spark = ship(sentences.sparkSession)
    keys = [c for c in sentences.columns if c != forms] if by is None else by
    sentences = sentences.select(*keys, forms)
    clash = {n for n, _ in fields} & {*keys}
    if clash:
        raise ValueError(f"columns already there: {', '.join(sorted(clash))}")
    schema = sentences.select(*keys).schema
    for n, t in fields:
        schema = schema.add(n, from_arrow_type(t))
    kinds, sent = [to_arrow_type(f.dataType) for f in schema], spark.sparkContext.broadcast(annotator)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            if b.num_rows:
                s = Sentences(b.column(b.schema.get_field_index(forms)), own)
                s.first, s.group = _groups(b, keys)
                rows, columns = make(s)
                taken = [b.column(b.schema.get_field_index(k)).take(pa.array(rows)) for k in keys]
                yield pa.record_batch([*(c.cast(t) if c.type != t else c for c, t in zip([*taken, *columns], kinds))], names=schema.names)

    return sentences.mapInArrow(run, schema)


_TOKEN = [("pos", pa.int32()), ("form", pa.string()), ("type", pa.string()), *((c.split()[0], _arrow(c.split()[1])) for c in ANALYSIS.split(", ")), *((t, pa.string()) for t in TAGS)]


def _tokens(s: Sentences, names: list[str]):
    return s.sent, [_column(s, n) for n in names]


def _values(s: Sentences, name: str) -> list:
    """A column of ``_TOKEN`` that depends on the form alone, for each distinct form."""
    if name == "type":
        return [x.type for x in s.entries]
    part, i = (1, FIELDS.index(name)) if name in FIELDS else (2, TAGS.index(name))
    return [x[part][i] for x in s.entries]


def _column(s: Sentences, name: str) -> pa.Array:
    if name == "pos":
        return pa.array(s.pos, pa.int32())
    return s.forms.take(pa.array(s.codes)) if name == "form" else s.column(_values(s, name), dict(_TOKEN)[name])


def _fit(annotator: Annotator, names: list[str]) -> Annotator:
    return annotator if {"feats", "xpos", "lemma"} & {*names} else annotator.short()


def tokens(sentences: DataFrame, annotator: Annotator, forms: str = "forms", columns: list[str] | None = None) -> DataFrame:
    """A row for each token: the sentence's keys, ``pos, form, type``, the columns of ``ANALYSIS`` and ``upos, flag, feats, xpos, lemma``, or ``columns`` of them.

    Spark can't tell a Python step which columns are used, so that those of no use are better not asked for.
    """
    names = columns or [n for n, _ in _TOKEN]
    return _run(sentences, _fit(annotator, names), lambda s: _tokens(s, names), [(n, t) for n, t in _TOKEN if n in names] if columns is None else [(n, dict(_TOKEN)[n]) for n in names], forms)


def counts(sentences: DataFrame, annotator: Annotator, columns: list[str], by: tuple[str, ...] = (), forms: str = "forms") -> DataFrame:
    """``n`` tokens of each combination of ``columns`` (of ``tokens``, but ``pos`` and ``form``) and the keys ``by``.

    Counted within each batch: a combination has a row for each batch that has it, to be summed.
    """

    def make(s: Sentences):
        kinds: dict[tuple, int] = {}
        of = np.array([kinds.setdefault(x, len(kinds)) for x in zip(*(_values(s, c) for c in columns))], np.int64)
        at = s.group[s.sent] * max(len(kinds), 1) + (of[s.codes] if len(s.codes) else 0)
        found, n = np.unique(at, return_counts=True)
        some, rows = list(kinds), found // max(len(kinds), 1)
        own = pa.array(found % max(len(kinds), 1))
        return s.first[rows], [*(pa.array([k[i] for k in some], dict(_TOKEN)[c]).take(own) for i, c in enumerate(columns)), pa.array(n, pa.int64())]

    return _run(sentences, _fit(annotator, columns), make, [*((c, dict(_TOKEN)[c]) for c in columns), ("n", pa.int64())], forms, list(by))


def sentence_totals(sentences: DataFrame, annotator: Annotator, forms: str = "forms") -> DataFrame:
    """``tokens, words, ambiguous, failed`` of each sentence that has a token; a word is ambiguous if its best verb parses tie."""

    def make(s: Sentences):
        tie = s.annotator.tied
        word = np.array([e.type == "word" for e in s.entries], bool)
        tied = np.array([w and tie(f or "") for w, f in zip(word.tolist(), s.forms.to_pylist())], bool)
        failed = np.array([e.tags[1] == "failed" for e in s.entries], bool)
        some = np.flatnonzero(s.lengths)
        total = lambda x: pa.array(np.bincount(s.sent, x[s.codes], len(s.lengths))[some].astype(np.int64)) if len(s.codes) else pa.array([], pa.int64())
        return some, [pa.array(s.lengths[some]), *map(total, (word, tied, failed))]

    return _run(sentences, annotator.short(), make, [(c, pa.int64()) for c in ("tokens", "words", "ambiguous", "failed")], forms)


def run_totals(sentences: DataFrame, annotator: Annotator, doc: str, sent: str, forms: str = "forms") -> DataFrame:
    """``totals`` in one pass over sentences that are numbered from 1 within each ``doc``: only the documents' own totals go through an exchange."""
    own = sentence_totals(sentences, annotator, forms)
    docs = own.groupBy(doc).agg(F.max(sent).cast("long").alias("sentences"), *(F.sum(c).alias(c) for c in ("tokens", "words", "ambiguous", "failed")))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in ("sentences", "tokens") else F.sum(c)
    return docs.agg(*(zero(c).alias(c) for c in ("sentences", "tokens", "words", "ambiguous", "failed")))


def last_nouns(sentences: DataFrame, annotator: Annotator, forms: str = "forms") -> DataFrame:
    """``pos, sm_class, last_nc, agrees`` of each verb, as ``tagging.last_noun`` has them: a verb agrees with the last noun before it in its sentence."""

    def make(s: Sentences):
        upos, nc = _values(s, "upos"), _values(s, "nc")
        noun, verb = (np.array(x, bool)[s.codes] if len(s.codes) else np.empty(0, bool) for x in ([u == "NOUN" and c is not None for u, c in zip(upos, nc)], [u == "VERB" for u in upos]))
        last = np.maximum.accumulate(np.where(noun, np.arange(len(noun)), -1)) if len(noun) else np.empty(0, np.int64)
        at = np.flatnonzero(verb)
        before = np.where(at > 0, last[at - 1], -1)
        ok = before >= s.starts[s.sent[at]]
        own = pa.array(nc, pa.string()).take(pa.array(s.codes[np.where(ok, before, 0)], mask=~ok))
        mine = pa.array(_values(s, "sm_class"), pa.string()).take(pa.array(s.codes[at]))
        return s.sent[at], [pa.array(s.pos[at], pa.int32()), mine, own, pc.equal(own, mine)]

    return _run(sentences, annotator.short(), make, [("pos", pa.int32()), ("sm_class", pa.string()), ("last_nc", pa.string()), ("agrees", pa.bool_())], forms)


def totals(tokens: DataFrame, sent: list[str], parses: DataFrame | None = None) -> DataFrame:
    """One row: ``sentences, tokens, words, ambiguous, failed`` of annotated tokens.

    ``ambiguous``: words with two or more best hypotheses of one score among ``parses`` (``form, hyp, score``), if given.
    """
    word, n = F.col("type") == "word", lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    several = F.lit(False)
    if parses is not None:
        best = parses.groupBy("form").agg(F.max("score").alias("top"), F.collect_list("score").alias("scores"))
        tied = best.filter(F.size(F.filter("scores", lambda x: x == F.col("top"))) > 1).select(F.col("form").alias("__form"), F.lit(True).alias("__tied"))
        tokens = tokens.join(tied, F.lower("form") == F.col("__form"), "left")
        several = F.coalesce("__tied", F.lit(False))
    key = F.struct(*sent)
    return tokens.agg(F.count_distinct(key).alias("sentences"), F.count("*").alias("tokens"), n(word)("words"), n(word & several)("ambiguous"), n(F.col("flag") == "failed")("failed"))


def _links(s: Sentences):
    found = s.links()
    at, off, score = (np.concatenate([x[i] for x in found]) for i in (1, 2, 3))
    kind = np.repeat([x.kind for x in found], [len(x.at) for x in found])
    nc = s.column([x.seen for x in s.entries], pa.string()).take(pa.array(at + off))
    numbers = (pa.array(x, pa.int32()) for x in (s.pos[at], s.pos[at] + off, np.abs(off)))
    return s.sent[at], [pa.array(kind.tolist(), pa.string()), nc, *numbers, pa.array(score)]


def links(sentences: DataFrame, annotator: Annotator, forms: str = "forms") -> DataFrame:
    """``kind, nc, gov_pos, noun_pos, dist, score`` of each agreement link, beside the sentence's keys."""
    fields = [("kind", pa.string()), ("nc", pa.string()), *((c, pa.int32()) for c in ("gov_pos", "noun_pos", "dist")), ("score", pa.float64())]
    return _run(sentences, annotator.short(), _links, fields, forms)


def conllu(sentences: DataFrame, annotator: Annotator, forms: str = "forms") -> DataFrame:
    """``lines``, the CoNLL-U lines of each sentence that has a token, beside its keys."""

    def make(s: Sentences):
        some = np.flatnonzero(s.lengths)
        every = s.blocks()
        return some, [pa.array([every[i] for i in some], pa.string())]

    return _run(sentences, annotator, make, [("lines", pa.string())], forms)


def _json_tail(e: Entry, form: str, slim: bool) -> str:
    """What ``sinks.sentence_token`` has of a token but its number, as JSON; it depends on the form alone."""
    v = dict(zip(FIELDS, e.values))
    upos, flag, feats, xpos, lemma = e.tags
    morphs, at = [], 0
    for slot, key, gloss in (("NEG", "neg", None), ("SM", "sm", "sm_class"), ("TAM", "tam", "tam_id"), ("OM", "om", "om_class"), ("ROOT", "root", "gloss"), ("EXT", "ext", "ext_id"), ("FV", "fv", "fv_id")):
        n = len(v[key] or "")
        if n:
            morphs.append({"start": at, "end": at + n, "form": v[key], "label": slot, "gloss": v[gloss] if gloss else None, "slot": slot})
        at += n
    if v["nc"] is not None:
        n = len(v["nc_prefix"] or "")
        for a, z, own, label, gloss in ((0, n, v["nc_prefix"], "NC_PREFIX", v["nc"]), (n, n + len(v["stem"] or ""), v["stem"], "STEM", v["stem"])):
            if z > a:
                morphs.append({"start": a, "end": z, "form": own, "label": label, "gloss": gloss, "slot": None})
    known = bool(v["known"])
    root = v["root"] if v["root"] is not None else v["stem"]
    parses = [] if v["score"] is None else [{"score": round(v["score"], 4), "root": v["root"], "gloss": "-".join(v[c] for c in ("sm_class", "tam_id", "om_class", "gloss", "ext_id", "fv_id") if v[c] is not None), "flags": []}]
    matches = [{"root": root, "gloss": v["gloss"], "cat": "verb" if v["nc"] is None else "noun", "nc": v["nc"]}] if known else []
    pairs = dict((*x.split("=", 1), None)[:2] for x in feats.split("|")) if feats else {}
    out = {
        "form": form, **({} if slim else {"original_form": None}), "token_type": e.type, **({} if slim else {"char_start": None, "char_end": None}), "lemma": lemma, "upos": upos, "xpos": xpos, "feats": pairs, "head": None, "deprel": None, "noun_class": v["nc"], "is_oov": e.type == "word" and not known,
        "is_reduplicated": DOUBLED.match(form) is not None, "clitic_of": None, "flags": [flag], "morphemes": morphs, "slot_parses": parses, "lexicon_matches": matches, "misc": {},
    }
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    return "," + (re.sub(r"(?<!\\)((?:\\\\)*\\u)([0-9a-f]{4})", lambda m: m[1] + m[2].upper(), text) if "\\u" in text else text)[1:]


#: ``segment.doubled`` in Python, whose full stop stands for some line ends too.
DOUBLED = re.compile("([^\\n\\r\\u0085\\u2028\\u2029]{2,})\\1")


def json_lines(sentences: DataFrame, annotator: Annotator, forms: str = "forms", slim: bool = False) -> DataFrame:
    """``has_cs, total, oov, lexicon, analysed, punct, special, tokens`` beside the sentence's keys: what ``sinks.sentence_lines`` needs of a sentence, its tokens as JSON. No exchange."""

    def make(s: Sentences):
        of = lambda f: np.array([f(e) for e in s.entries], np.int64)
        some = np.flatnonzero(s.lengths)
        total = lambda f: np.bincount(s.sent, of(f)[s.codes], len(s.lengths))[some].astype(np.int64) if len(some) else np.empty(0, np.int64)
        tails = [_json_tail(e, f or "", slim) for e, f in zip(s.entries, s.forms.to_pylist())]
        own = [f'{{"token_id":{p}{tails[c]}' for p, c in zip(s.pos.tolist(), s.codes.tolist())]
        known = FIELDS.index("known")
        columns = [total(lambda e: e.type == "code_switch") > 0, s.lengths[some], total(lambda e: e.type == "word" and not e.values[known]), total(lambda e: bool(e.values[known])), total(lambda e: e.values[0] is not None), total(lambda e: e.type == "punct"), total(lambda e: e.type == "special")]
        return some, [*map(pa.array, columns), pa.array([f"[{','.join(own[a:z])}]" for a, z in zip(s.starts[some].tolist(), (s.starts + s.lengths)[some].tolist())], pa.string())]

    return _run(sentences, annotator, make, [("has_cs", pa.bool_()), *((c, pa.int64()) for c in ("total", "oov", "lexicon", "analysed", "punct", "special")), ("tokens", pa.string())], forms)
