"""Highlights and snippets. Matching is on normalised whole words; output is escaped HTML."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tesserine.functions.content import unescape
from tesserine.functions.text import normalize_text, tokenize_text

TAGS = ("mark", "em", "strong", "span", "b", "i", "u")
LEAD = {"early": 10, "balanced": 40, "deep": 90}
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


def class_tokens(value: str) -> str:
    """H6."""
    return " ".join(t for t in value.split() if re.fullmatch(r"[A-Za-z0-9_-]+", t))


def ranges(text: str, terms: list[str], query: list[str] | None = None) -> list[tuple[int, int]]:
    """Where terms stand, left to right, the longest of overlapping ones; a query token that begins a word covers only its own length."""
    words = [(m.start(), m.end(), normalize_text(m[0])) for m in _WORD.finditer(text)]
    wanted = [t for t in (tokenize_text(x) for x in terms) if t]
    found = []
    for i, (start, end, word) in enumerate(words):
        for t in wanted:
            if [w for _, _, w in words[i : i + len(t)]] == t:
                found.append((start, words[i + len(t) - 1][1]))
        for q in query or ():
            q = normalize_text(q)
            if q and word != q and word.startswith(q):
                found.append((start, start + len(q)))
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(found), key=lambda r: (r[0], -r[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def highlight_text(text: str | None, terms: list[str], query: list[str] | None = None, tag: str = "mark", css: str = "", strip: bool = True) -> str:
    """H1."""
    if not text:
        return ""
    if strip:
        text = unescape(re.sub(r"<[^>]*>", "", text))
    tag = tag if tag in TAGS else "mark"
    css = class_tokens(css)
    opened, at, out = f'<{tag} class="{css}">' if css else f"<{tag}>", 0, []
    for start, end in ranges(text, terms, query):
        out += [html.escape(text[at:start]), opened, html.escape(text[start:end]), f"</{tag}>"]
        at = end
    return "".join(out) + html.escape(text[at:])


def _window(text: str, start: int, length: int) -> tuple[int, int]:
    """A window moved to word boundaries."""
    start = max(0, start)
    if start and not text[start - 1].isspace():
        space = text.find(" ", start)
        start = space + 1 if 0 <= space < start + 30 else start
    end = min(len(text), start + length)
    if end < len(text):
        space = text.rfind(" ", start, end)
        end = space if space > start + length // 2 else end
    return start, end


def snippets_of(text: str | None, terms: list[str], length: int = 200, most: int = 3) -> list[str]:
    """H2: windows around matches that no earlier window covers."""
    out: list[str] = []
    covered = -1
    for start, end in ranges(text or "", terms):
        if len(out) >= most or start < covered:
            continue
        a, b = _window(text, start - (length - (end - start)) // 2, length)
        covered = b
        out.append(("..." if a else "") + text[a:b].strip() + ("..." if b < len(text) else ""))
    return out


def snippet_of(text: str | None, terms: list[str], mode: str = "balanced", length: int = 150) -> str | None:
    """H3: one window with a lead by mode; null without a match."""
    found = ranges(text or "", terms)
    if not found:
        return None
    a, b = _window(text, found[0][0] - LEAD.get(mode, 40), max(50, min(1000, length)))
    return ("..." if a else "") + text[a:b].strip() + ("..." if b < len(text) else "")


def best_snippet(fields: dict[str, str], body: str, terms: list[str], preferred: tuple[str, ...] = (), mode: str = "balanced", length: int = 150) -> str | None:
    """H4: the field with most matched terms, preferred ones first, then the earliest match; else the lead of the body or of the first prose field."""
    prose = {k: v for k, v in fields.items() if v and (k in preferred or len(v.split()) >= 4 or len(v) >= 40)}
    ranked = []
    for n, (name, text) in enumerate([*prose.items(), ("", body or "")]):
        hit = [r for r in (ranges(text, [t]) for t in terms) if r]
        if hit:
            ranked.append((-len(hit), name not in preferred, min(r[0][0] for r in hit), n, text))
    if ranked:
        return snippet_of(min(ranked)[4], sorted(terms, key=len, reverse=True), mode, length)
    lead = next((t for t in (body, *prose.values()) if t), None)
    return lead and lead[: _window(lead, 0, length)[1]] + ("..." if len(lead) > length else "")


def heading_snippets(body: str, headings: list[str], terms: list[str], every: bool = False, length: int = 150) -> list[tuple[str, str]]:
    """H5: the body cut at its headings in order; of each heading that has a term, or of all, a snippet or the lead."""
    places, at = [], 0
    for h in headings:
        m = re.search(rf"(?<!\w){re.escape(h)}(?!\w)", body[at:])
        if m:
            places.append((h, at + m.start(), at + m.end()))
            at += m.end()
    out = []
    for i, (h, _, end) in enumerate(places):
        part = body[end : places[i + 1][1] if i + 1 < len(places) else len(body)].strip()
        if every or ranges(h, terms):
            out.append((h, snippet_of(part, terms, length=length) or part[:length]))
    return out


def highlight(text: Column, terms: list[str], query: list[str] | None = None, tag: str = "mark", css: str = "") -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: highlight_text(t, terms, query, tag, css))

    return run(text)


def snippets(text: Column, terms: list[str], length: int = 200, most: int = 3) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippets_of(t, terms, length, most))

    return run(text)


def hit_snippet(text: Column, terms: list[str], mode: str = "balanced", length: int = 150) -> Column:
    """H3 for a column."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: snippet_of(t, terms, mode, length))

    return run(text)


def field_snippet(fields: dict[str, Column], body: Column, terms: list[str], preferred: tuple[str, ...] = (), mode: str = "balanced", length: int = 150) -> Column:
    """H4 for columns: the snippet of the field that suits best."""
    names = list(fields)

    @F.pandas_udf(StringType())
    def run(body: pd.Series, *values: pd.Series) -> pd.Series:
        rows = zip(body, *values, strict=True)
        return pd.Series([best_snippet(dict(zip(names, own, strict=True)), text or "", terms, preferred, mode, length) for text, *own in rows], dtype=object)

    return run(body, *fields.values())


_PART = StructType([StructField("title", StringType()), StructField("snippet", StringType())])


def heading_parts(body: Column, titles: Column, terms: list[str], every: bool = False, length: int = 150) -> Column:
    """H5 for columns: ``titles`` is the array of a body's headings."""

    @F.pandas_udf(ArrayType(_PART))
    def run(body: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([[{"title": h, "snippet": part} for h, part in heading_snippets(b or "", list(t) if t is not None else [], terms, every, length)] for b, t in zip(body, titles, strict=True)], dtype=object)

    return run(body, titles)
