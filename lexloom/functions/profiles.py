"""Cleaning profiles: what a language adds to the settings that all share."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

PUNCTUATION = (("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("…", "..."))


@dataclass(frozen=True)
class Profile:
    """Lists add up when profiles merge; ``ocr`` is overridden key by key; ``punctuation`` is global."""

    iso: str = "und"
    name: str = ""
    keywords: tuple[str, ...] = ()
    chapter_words: tuple[str, ...] = ("Chapter", "Part", "Section", "Appendix")
    abbreviations: tuple[str, ...] = ("Mr", "Mrs", "Dr", "Prof", "vs", "etc", "vol", "pp")
    single_chars: tuple[str, ...] = ("a", "i", "o", "y", "à", "é", "e")
    strip_patterns: tuple[str, ...] = (r"page +[0-9]+$", r"[-_=*]{3,}$")
    ocr: tuple[tuple[str, str], ...] = (("tbe", "the"), ("rn", "m"), ("l1", "li"))
    punctuation: tuple[tuple[str, str], ...] = PUNCTUATION


@dataclass(frozen=True)
class Toggles:
    unicode: bool = True
    punctuation: bool = True
    hyphenation: bool = True
    unwrap: bool = True
    abbreviations: bool = True
    urls: bool = True
    emails: bool = True
    verses: bool = False
    headings: bool = True
    strip: bool = True
    ocr: bool = True
    consonants: bool = True
    singles: bool = True
    whitespace: bool = True


#: Named sets of switches.
PRESETS = {
    "standard": Toggles(),
    "minimal": Toggles(hyphenation=False, unwrap=False, abbreviations=False, urls=False, emails=False, headings=False, strip=False, ocr=False, consonants=False, singles=False),
    "aggressive": Toggles(verses=True),
    "pristine": Toggles(**{k: False for k in Toggles.__dataclass_fields__}),
}

OWN = {
    "en": {"name": "English", "keywords": ("/en/", "english")},
    "fr": {"name": "French", "keywords": ("/fr/", "french"), "chapter_words": ("Chapitre", "Partie"), "abbreviations": ("Mme", "Mlle"), "single_chars": ("à", "ê", "y")},
    "de": {"name": "German", "keywords": ("/de/", "german"), "chapter_words": ("Kapitel", "Teil"), "abbreviations": ("Hr", "Fr", "bzw", "usw"), "single_chars": ("ä",)},
    "es": {"name": "Spanish", "keywords": ("/es/", "spanish"), "chapter_words": ("Capítulo", "Parte"), "abbreviations": ("Sr", "Sra", "Ud"), "single_chars": ("u", "ó")},
    "bem": {"name": "Bemba", "keywords": ("/bem/", "bemba"), "chapter_words": ("Icipandwa",), "single_chars": ("u",)},
    "toi": {"name": "Tonga", "keywords": ("/toi/", "tonga"), "chapter_words": ("Cibalo",), "single_chars": ("u",)},
}


def union(*lists) -> tuple:
    """All items once, in the order in which they come first."""
    return tuple(dict.fromkeys(x for one in lists for x in one))


def merged(base: Profile, own: dict) -> Profile:
    """``own`` added to ``base``."""
    text = {k: str(own[k]) for k in ("iso", "name") if k in own}
    lists = {k: union(getattr(base, k), map(str, own[k])) for k in ("chapter_words", "abbreviations", "single_chars", "strip_patterns") if k in own}
    ocr = {"ocr": tuple((dict(base.ocr) | {str(k): str(v) for k, v in dict(own["ocr"]).items()}).items())} if "ocr" in own else {}
    return replace(base, **text, keywords=tuple(own.get("keywords", ())), **lists, **ocr)


def profiles(own: dict[str, dict] = OWN, base: Profile = Profile()) -> dict[str, Profile]:
    """A profile for each language, in the order given."""
    return {iso: merged(base, {"iso": iso, **x}) for iso, x in own.items()}


def universal(own: dict[str, dict] = OWN, base: Profile = Profile()) -> Profile:
    """All languages' lists together; corrections stay the shared ones."""
    every = profiles(own, base).values()
    lists = {k: union(*(getattr(p, k) for p in every)) for k in ("chapter_words", "abbreviations", "single_chars", "strip_patterns")}
    return replace(base, iso="und", name="all", **lists)


def valid_patterns(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """All patterns, or none if one of them is no regular expression."""
    try:
        for p in patterns:
            re.compile(p)
    except re.error:
        return ()
    return patterns


def to_json(profile: Profile, toggles: Toggles) -> str:
    return json.dumps({"profile": asdict(profile), "toggles": asdict(toggles)}, sort_keys=True, ensure_ascii=False)


def from_json(text: str) -> tuple[Profile, Toggles]:
    """What ``to_json`` wrote."""
    x = json.loads(text)
    tuples = {k: tuple(tuple(y) if isinstance(y, list) else y for y in v) if isinstance(v, list) else v for k, v in x["profile"].items()}
    return Profile(**tuples), Toggles(**x["toggles"])


#: Settings of a file, by the switch that they turn.
SETTINGS = {"remove_urls": "urls", "remove_emails": "emails", "filter_single_chars": "singles", "fix_hyphenation": "hyphenation", "normalize_whitespace": "whitespace", "normalize_unicode": "unicode", "normalize_punctuation": "punctuation", "process_ocr_artifacts": "ocr", "protect_citations": "abbreviations"}


def synced(on: Toggles, least: int, most: int, settings: dict, default: tuple[int, int] = (3, 1000)) -> tuple[Toggles, int, int]:
    """Switches and sentence bounds with a file's global settings; what differs from the defaults was chosen, and stays."""
    if on == Toggles():
        on = replace(on, **{k: bool(settings[s]) for s, k in SETTINGS.items() if s in settings})
        if "preserve_bible_text" in settings:
            on = replace(on, verses=not settings["preserve_bible_text"])
    if (least, most) == default:
        least, most = int(settings.get("min_sentence_length", least)), int(settings.get("max_sentence_length", most))
    return on, least, most


@dataclass
class Found:
    """First value that isn't None among several paths of a nested mapping."""

    data: dict = field(default_factory=dict)

    def first(self, *paths: str):
        for path in paths:
            at = self.data
            for key in path.split("."):
                at = at.get(key) if isinstance(at, dict) else None
            if at is not None:
                return at
        return None


def load(path: str) -> tuple[dict[str, Profile], Profile]:
    """Profiles of a YAML file with ``global`` and ``languages`` sections, and the one of all languages."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = Found(yaml.safe_load(f) or {})
    shared, own = data.first("global", "defaults") or {}, data.first("languages", "profiles") or {}
    rename = {"book_abbreviations": "abbreviations", "valid_single_chars": "single_chars", "ocr_corrections": "ocr", "path_keywords": "keywords"}
    named = lambda x: {rename.get(k, k): v for k, v in (x or {}).items()}
    base = merged(Profile(), named(shared))
    if "punctuation_map" in shared:
        base = replace(base, punctuation=tuple((str(k), str(v)) for k, v in shared["punctuation_map"].items()))
    languages = {iso: named(x) | {"keywords": (f"/{iso}/", iso, *(named(x).get("keywords") or ()))} for iso, x in own.items()}
    return profiles(languages, base), universal(languages, base)
