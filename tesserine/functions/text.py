"""Text analysis: normalisation, tokens, stop words, n-grams, similarity and compounds."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from tesserine.functions.stopwords import FIXED

TOKEN = r"[\p{L}\p{N}]+"
NGRAM_SIZES = (2, 3)

#: Whole lists of eight languages, the commonest words of two; fuller lists and other languages are files, see stop_words().
STOP_WORDS = {
    "en": "a an the and but or nor for so yet about after as at before by from in into of off on onto out over to under up with i me my you your he him his she her it its we us our they them their this that these those is am are was were be been being have has had do does did will would can could should may might must not no".split(),
    "es": "el la los las un una unos unas de del y o pero en con sin por para que como es son se su sus lo al".split(),
} | FIXED

#: The hamza-less and tatweel-bearing spellings of Arabic are folded by compatibility forms; this one letter is dropped.
_TATWEEL = "ـ"
#: Marks that are letters' own in Japanese and stay.
_KEPT_MARKS = ("゙", "゚")


def normalize_text(text: str | None) -> str | None:
    """Compatibility composition, tatweel out, digits to ASCII, lower case, accents out."""
    if text is None or text.isascii():
        return text and text.lower() if text else text
    text = unicodedata.normalize("NFKC", text).replace(_TATWEEL, "")
    text = "".join(str(unicodedata.digit(c)) if unicodedata.category(c) == "Nd" else c for c in text).lower()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn" or c in _KEPT_MARKS)
    return unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def _normalized(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(normalize_text, na_action="ignore")


def normalize(text: Column) -> Column:
    """F1. One Arrow pass over ``unicodedata``; Spark has no Unicode normalisation of its own."""
    return _normalized(text)


def search_text(text: Column) -> Column:
    """normalised, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(normalize(text), r"\s+", " "))


def tokens(normalized: Column) -> Column:
    """F3 on text that is normalised already."""
    return F.regexp_extract_all(normalized, F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    return tokens(normalize(text))


def tokenize_text(text: str) -> list[str]:
    """F3 on the driver, for queries."""
    return re.findall(r"[^\W_]+", normalize_text(text) or "")


def token_counts(of: Column) -> Column:
    """map of token to frequency, from one sort: of equal tokens the distance between first and last place."""
    ordered = F.array_sort(of)
    starts = F.filter(F.transform(ordered, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: (x["i"] == 0) | (x["t"] != F.element_at(ordered, F.greatest(x["i"], F.lit(1)))))
    ends = F.concat(F.slice(F.transform(starts, lambda x: x["i"]), 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(ordered)))
    return F.map_from_entries(F.zip_with(starts, ends, lambda x, end: F.struct(x["t"].alias("token"), (end - x["i"]).alias("count"))))


def stop_words(language: str, folder: str | None = None, enabled: bool = True) -> list[str]:
    """The list of a language. Order: the folder's file of the exact code, built-in exact, the folder's of the two-letter code, built-in, none."""
    if not enabled:
        return []
    language = language.strip().lower().replace("_", "-")
    for code in dict.fromkeys((language, language[:2])):
        path = Path(folder, f"{code}.txt") if folder else None
        if path and path.exists():
            return [w for w in path.read_text(encoding="utf-8").split() if w]
        if code in STOP_WORDS:
            return STOP_WORDS[code]
    return []


def without_stop_words(of: Column, words: list[str]) -> Column:
    """keeps order; an empty list changes nothing."""
    return F.filter(of, lambda t: ~F.lower(t).isin(words)) if words else of


def ngrams(term: Column, sizes: tuple[int, ...] = NGRAM_SIZES) -> Column:
    """distinct character n-grams of the padded term, none of them blank."""
    padded = F.concat(F.lit(" "), term, F.lit(" "))

    def of(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(padded) - F.lit(n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, cut).otherwise(F.array().cast("array<string>"))

    grams = [of(n) for n in sizes]
    return F.array_distinct(F.filter(F.concat(*grams), lambda g: F.trim(g) != ""))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def adaptive_threshold(length: Column, base: float) -> Column:
    """F8: short terms pass more easily."""
    least = lambda low, part: F.greatest(F.lit(low), F.lit(base * part))
    return F.when(length <= 2, least(0.1, 0.4)).when(length == 3, least(0.15, 0.6)).when(length == 4, least(0.2, 0.8)).otherwise(F.lit(base))


def damerau(a: str, b: str) -> int:
    """edits with transpositions of neighbours, between which further edits may fall."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            same = a[i - 1] == b[j - 1]
            if same:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


@F.pandas_udf(IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(IntegerType())
def damerau_levenshtein_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """F9 over the bytes of UTF-8, as DuckDB counts."""
    raw = lambda x: x.encode("utf-8", "surrogatepass").decode("latin-1")
    return pd.Series([None if x is None or y is None else damerau(raw(x), raw(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def typo_budget(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 7 else 2


def within_budget(query: str, candidate: str) -> bool:
    """F11 on the driver: the candidate begins with the query, or is few edits away; a different first letter counts as one more."""
    if not query or not candidate:
        return False
    if candidate.startswith(query):
        return True
    return damerau(query, candidate) + (query[0] != candidate[0]) <= typo_budget(len(query))


def within_budget_column(query: Column, candidate: Column, distance: Callable[[Column, Column], Column] = damerau_levenshtein) -> Column:
    """F11, with ``distance`` counting the edits. The built-in distance rules out most pairs first: a transposition costs it two edits at most."""
    budget = F.when(F.length(query) <= 3, 0).when(F.length(query) <= 7, 1).otherwise(2)
    first = (F.substring(query, 1, 1) != F.substring(candidate, 1, 1)).cast("int")
    near = (F.levenshtein(query, candidate) <= 2 * budget) & (distance(query, candidate) + first <= budget)
    return (F.length(query) > 0) & (F.length(candidate) > 0) & (candidate.startswith(query) | near)


def cache_identity(query: Column) -> Column:
    """F10."""
    return F.lower(F.trim(F.regexp_replace(query, r"[\s\p{Z}]+", " ")))


def language_code(code: Column) -> Column:
    """null where it is no language code."""
    c = F.lower(F.replace(F.trim(code), F.lit("_"), F.lit("-")))
    return F.when(c.rlike(r"^[a-z]{2,3}(-[a-z0-9]{2,8}){0,2}$"), c)


def language_match(a: Column, b: Column) -> Column:
    """equal, or one is the other's generic two-letter code."""
    a, b = language_code(a), language_code(b)
    generic = ((F.length(a) == 2) & (F.substring(b, 1, 2) == a)) | ((F.length(b) == 2) & (F.substring(a, 1, 2) == b))
    return F.coalesce((a == b) | generic, F.lit(False))


def script_language(text: Column) -> Column:
    """F15."""
    return F.when(text.rlike(r"[؀-ۿݐ-ݿࢠ-ࣿ]"), F.lit("ar"))


COMPOUND = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)+"


def compounds(text: Column, longest: int = 255) -> Column:
    """F16: names such as ``redirect.twig``, as written."""
    return F.filter(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)), lambda c: F.length(c) <= longest)


def is_compound_text(query: str) -> bool:
    """F17 on the driver: ends in a name with a dot, which the last part may still lack; no dot first."""
    text = (normalize_text(query) or "").strip()
    return not text.startswith(".") and re.search(r"[^\W_]+\.[^\W_]*$", text) is not None and len(tokenize_text(text)) >= 2


def is_compound_query(query: Column) -> Column:
    """F17."""
    text = F.trim(normalize(query))
    return ~text.startswith(".") & text.rlike(r"[\p{L}\p{N}]+\.[\p{L}\p{N}]*$") & (F.size(tokens(text)) >= 2)


def intent(query: Column) -> Column:
    """question, product, navigational, else informational; the first that matches."""
    q = F.lower(F.trim(query))
    # The patterns of each intent.
    question = r"^(what|how|why|when|where|who|which|can|does|is|are|do|will|should)\b|\?$"
    product = r"\b(buy|price|cost|cheap|discount|sale|order|shop|store|deal|review|compare|best|top|vs|versus|shipping|delivery|return|warranty)\b|\$\d+"
    navigational = r"\b(login|signin|sign in|account|dashboard|contact|about|home|page)\b|\b(\.com|\.org|\.net|\.io)\b"
    return F.when(q.rlike(question), "question").when(q.rlike(product), "product").when(q.rlike(navigational), "navigational").otherwise("informational")


def source_kind(is_cp: Column, referrer: Column, host: Column) -> Column:
    """F19."""
    return F.when(is_cp, "cp").when(F.try_parse_url(referrer, F.lit("HOST")) == host, "frontend").otherwise("api")


def ip_hash(ip: Column, salt: str) -> Column:
    """F20."""
    return F.sha2(F.concat(ip, F.lit(salt)), 256)


def filter_expression(filters: dict, required: Column | None = None) -> Column:
    """lists are any-of, keys are and-ed, nulls skipped; with a required filter both must hold."""
    out = required if required is not None else F.lit(True)
    for key, value in filters.items():
        if value is None:
            continue
        values = [v for v in value if v is not None] if isinstance(value, (list, tuple, set)) else [value]
        if values:
            out = out & F.col(key).isin(values)
    return out
