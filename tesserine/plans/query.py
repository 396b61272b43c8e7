"""The query language: phrases, field filters, exclusion, wildcards, boosts, AND and OR."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tesserine.functions.text import is_compound_text, normalize_text, tokenize_text

#: Boolean words of each language, as and, or, not.
OPERATORS = {
    "en": (["and"], ["or"], ["not"]),
    "de": (["und"], ["oder"], ["nicht"]),
    "fr": (["et"], ["ou"], ["sauf"]),
    "es": (["y"], ["o"], ["no"]),
    "nl": (["en"], ["of"], ["niet"]),
    "it": (["e"], ["o"], ["non"]),
    "pt": (["e"], ["ou"], ["não", "nao"]),
    "sv": (["och"], ["eller"], ["inte"]),
    "da": (["og"], ["eller"], ["ikke"]),
    "no": (["og"], ["eller"], ["ikke", "ikkje"]),
    "ja": (["かつ"], ["または", "もしくは"], ["でない", "ではない"]),
    "ar": (["و"], ["أو", "او"], ["ليس", "لا"]),
}
FIELDS = ("title", "content")
_FIELD = re.compile(r"(?<!\S)(title|content):(\S+)", re.I)
_WORD = r"[^\W]+"


@dataclass
class ParsedQuery:
    """What a query asks for; the plan of a search is built from it."""

    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    not_terms: list[str] = field(default_factory=list)
    field_filters: dict[str, list[str]] = field(default_factory=dict)
    wildcards: list[str] = field(default_factory=list)
    boosts: dict[str, float] = field(default_factory=dict)
    operator: str = "AND"
    tokens: list[str] = field(default_factory=list)
    advanced: bool = False
    is_compound: bool = False
    compound_prefix: str = ""
    last_token_incomplete: bool = False

    @property
    def is_empty(self) -> bool:
        """Exclusions alone ask for nothing."""
        return not (self.terms or self.phrases or self.field_filters or self.wildcards)

    def searchable(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *(w for p in self.phrases for w in tokenize_text(p)), *self.wildcards]))

    def boost(self, term: str) -> float:
        return self.boosts.get(term, 1.0)


def _words(kind: int, languages: list[str]) -> str:
    words = dict.fromkeys(w for lang in languages for w in OPERATORS.get(lang, ([], [], []))[kind])
    return "|".join(map(re.escape, words))


def has_operators(query: str) -> bool:
    """Q1: whether the query needs the parser; the boolean words of every language count."""
    if any(c in query for c in '"*^') or _FIELD.search(query):
        return True
    every = "|".join(_words(k, list(OPERATORS)) for k in range(3))
    return re.search(rf"(?:^|\s)(?:{every})\s", query, re.I) is not None


def parse(query: str, language: str = "en") -> ParsedQuery:
    """Q2 to Q7, in this order; words of English and of ``language`` are operators."""
    own = list(dict.fromkeys(["en", language[:2].lower()]))
    out = ParsedQuery(advanced=has_operators(query))
    if not out.advanced:
        out.terms = out.tokens = tokenize_text(query)
        return out
    out.phrases = [p.strip() for p in re.findall(r'"([^"]+)"', query) if p.strip()]
    query = re.sub(r'"[^"]+"', "", query)
    for name, value in _FIELD.findall(query):
        values = [v.strip() for v in re.sub(r"\^[\d.]+$", "", value).split(",") if v.strip()]
        out.field_filters.setdefault(name.lower(), []).extend(values)
    query = _FIELD.sub(r"\2", query)
    exclude = re.compile(rf"(?:^|\s+)(?:{_words(2, own)})\s+(\S+)", re.I)
    out.not_terms = exclude.findall(query)
    query = exclude.sub("", query)
    wild = re.compile(rf"({_WORD})\*")
    out.wildcards = wild.findall(query)
    query = wild.sub("", query)
    boosted = re.compile(rf"({_WORD})\^([\d.]+)")
    for term, by in boosted.findall(query):
        try:
            if float(by) > 0:
                out.boosts[term] = float(by)
        except ValueError:
            continue
    query = boosted.sub(r"\1", query)
    for operator, kind in (("OR", 1), ("AND", 0)):
        word = re.compile(rf"\s+(?:{_words(kind, own)})\s+", re.I)
        if word.search(query):
            out.operator = operator
            query = word.sub(" ", query)
            break
    out.terms = out.tokens = tokenize_text(query)
    return out


def understand(query: str, language: str = "en", autocomplete: bool = False) -> ParsedQuery:
    """Q8: the parsed query with what autocomplete needs to know of it."""
    out = parse(query, language)
    text = query.strip()
    out.is_compound = is_compound_text(text)
    out.compound_prefix = (normalize_text(text) or "").strip()[:255] if out.is_compound else ""
    out.last_token_incomplete = autocomplete and bool(query) and not query[-1].isspace()
    return out
