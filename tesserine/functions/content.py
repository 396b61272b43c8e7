"""Content extraction: HTML and Markdown to text, headings and sections."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Tags that end a block.
_BLOCKS = r"(?i)<br\s*/?>|</(?:h[1-6]|p|div|li|td|th|blockquote|section|article|button)>"
_TAG = r"<[^>]*>"
LEVELS = (2, 3, 4)


_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescape(text: str) -> str:
    """Entities that end in a semicolon decoded, once; what only begins like one stays."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


@F.pandas_udf(StringType())
def decode_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(unescape, na_action="ignore")


def block_boundaries(text: Column) -> Column:
    return F.regexp_replace(text, _BLOCKS, " ")


def _finish(text: Column) -> Column:
    plain = F.regexp_replace(block_boundaries(text), _TAG, "")
    return F.trim(F.regexp_replace(decode_entities(plain), r"[\s ]+", " "))


def strip_html(text: Column) -> Column:
    """C2."""
    return _finish(text)


def strip_html_without_code(text: Column) -> Column:
    """C3."""
    return _finish(F.regexp_replace(text, r"(?is)<pre\b[^>]*>.*?</pre>", " "))


def clean_body(text: Column, keep_code: bool = False) -> Column:
    """C4: without scripts, styles and headings, and without code unless kept."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?is)<h([1-6])\b[^>]*>.*?</h\1>", " ")
    return _finish(out if keep_code else F.regexp_replace(out, r"(?is)<pre\b[^>]*>.*?</pre>", " "))


def clean_markdown_text(text: str, keep_code: bool = False) -> str:
    """Fences out or unwrapped, then inline code, rules, heading signs, paired emphasis to a fixpoint, list signs."""
    text = re.sub(r"(?ms)^\s*(```|~~~)[^\n]*\n(.*?)^\s*\1\s*$", (lambda m: m[2]) if keep_code else " ", text)
    text = re.sub(r"`([^`]*)`", r"\1", text)
    text = re.sub(r"(?m)^\s*([-*_])(?:\s*\1){2,}\s*$", " ", text)
    text = re.sub(r"(?m)^\s{0,3}#{1,6}\s+", "", text)
    before = None
    while before != text:
        before = text
        text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
        text = re.sub(r"(?<![\w*_])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*_])", r"\2", text)
    text = re.sub(r"(?m)^\s*(?:[-*+]|\d+\.)\s+", "", text)
    return re.sub(r"\s+", " ", text).strip()


@F.pandas_udf(StringType())
def clean_markdown(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(clean_markdown_text, na_action="ignore")


def kebab(text: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c) != "Mn")
    return re.sub(r"[^\w]+", "-", plain).strip("-")


def _plain(fragment: str) -> str:
    return re.sub(r"[\s\xa0]+", " ", unescape(re.sub(_TAG, "", re.sub(_BLOCKS, " ", fragment)))).strip()


_HTML_HEADING = re.compile(r"(?is)<h([1-6])\b([^>]*)>(.*?)</h\1>")
_MD_HEADING = re.compile(r"(?m)^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$")


def headings_of(text: str | None, levels: tuple[int, ...] = LEVELS) -> list[dict]:
    """Text, id, level and description of each heading of the levels; HTML where there is any, else Markdown."""
    if not text:
        return []
    out = []
    found = list(_HTML_HEADING.finditer(text))
    for i, m in enumerate(found):
        if int(m[1]) not in levels:
            continue
        title = _plain(m[3])
        if not title:
            continue
        after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
        first = re.search(r"(?is)<p\b[^>]*>(.*?)</p>", after)
        own = re.search(r"""(?i)\bid\s*=\s*["']([^"']+)["']""", m[2])
        out.append({"text": title, "id": own[1] if own else kebab(title), "level": int(m[1]), "description": _plain(first[1] if first else after)})
    if not found:
        marks = list(_MD_HEADING.finditer(text))
        for i, m in enumerate(marks):
            if len(m[1]) in levels:
                after = text[m.end() : marks[i + 1].start() if i + 1 < len(marks) else len(text)]
                lines = [x.strip() for x in after.splitlines() if x.strip()][:2]
                title = clean_markdown_text(m[2])
                out.append({"text": title, "id": kebab(title), "level": len(m[1]), "description": clean_markdown_text(" ".join(lines))})
    return out


_HEADING = StructType([StructField("text", StringType()), StructField("id", StringType()), StructField("level", IntegerType()), StructField("description", StringType())])
_SECTION = StructType([StructField("n", IntegerType()), StructField("anchor", StringType()), StructField("title", StringType()), StructField("body", StringType())])


def headings(text: Column, levels: tuple[int, ...] = LEVELS) -> Column:
    @F.pandas_udf(ArrayType(_HEADING))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: headings_of(t, levels))

    return run(text)


def normalize_levels(levels: list) -> tuple[int, ...]:
    """C7."""
    good = sorted({int(x) for x in levels or [] if str(x).strip().isdigit() and 1 <= int(x) <= 6})
    return tuple(good) or LEVELS


def sections_of(text: str | None, levels: tuple[int, ...] = LEVELS) -> list[dict]:
    """The part before the first heading (n = -1) where it has text, then one for each heading; anchors each once."""
    text = text or ""
    found = [m for m in _HTML_HEADING.finditer(text) if int(m[1]) in levels and _plain(m[3])]
    body = lambda part: _plain(re.sub(r"(?is)<(script|style|pre)\b[^>]*>.*?</\1>", " ", part))
    out = []
    intro = body(text[: found[0].start()] if found else text)
    if intro:
        out.append({"n": -1, "anchor": "", "title": "", "body": intro})
    used: dict[str, int] = {}
    for i, m in enumerate(found):
        title = _plain(m[3])
        own = re.search(r"""(?i)\bid\s*=\s*["']([^"']+)["']""", m[2])
        anchor = own[1] if own else kebab(title)
        used[anchor] = used.get(anchor, 0) + 1
        if used[anchor] > 1:
            anchor = f"{anchor}-{used[anchor]}"
        out.append({"n": i, "anchor": anchor, "title": title, "body": body(text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)])})
    return out


def split_sections(docs: DataFrame, text: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """One row for each section of a document; its key and url get the section."""

    @F.pandas_udf(ArrayType(_SECTION))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sections_of(t, levels))

    out = docs.withColumn("_s", F.explode(run(F.col(text))))
    key = F.when(F.col("_s.n") < 0, F.col("document_key")).otherwise(F.concat_ws("_", "document_key", "_s.anchor"))
    url = F.when(F.col("_s.n") < 0, F.col("url")).otherwise(F.concat_ws("#", "url", "_s.anchor"))
    rest = [c for c in docs.columns if c not in (text, "document_key", "url")]
    return out.select(*rest, key.alias("document_key"), url.alias("url"), F.col("_s.n").alias("section_index"), F.col("_s.title").alias("section_title"), F.col("_s.body").alias("content"))


def join_parts(*parts: Column) -> Column:
    """The parts that have text, by spaces."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), " ")


def excerpt(text: Column, length: int = 200) -> Column:
    plain = strip_html(text)
    return F.when(F.length(plain) > length, F.concat(F.substring(plain, 1, length), F.lit("..."))).otherwise(plain)


def ancestors(elements: DataFrame) -> DataFrame:
    """C11: ``elements(element_id, parent_id, title)`` with the titles of their ancestors from the root, and the level.

    Paths double in length each round, so depth costs its logarithm in joins. An element whose line of parents
    ends at none of ``elements``, or runs in a circle, has no row.
    """
    none = F.array().cast("array<string>")
    titles = elements.select(F.col("element_id").alias("at"), F.col("title").alias("_t"))
    up = elements.select("element_id", F.col("parent_id").alias("at")).join(titles, "at", "left").select("element_id", "at", F.when(F.col("_t").isNull(), none).otherwise(F.array("_t")).alias("path"))
    known, before = up, -1
    while True:
        known = known.persist()
        open_rows = known.where("at is not null").count()
        if open_rows == 0 or open_rows == before:
            break
        before = open_rows
        above = known.select(F.col("element_id").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        joined = known.join(above, "at", "left")
        known = joined.select("element_id", F.when(F.col("at").isNull(), F.lit(None)).otherwise(F.col("_at")).alias("at"), F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
    return known.where("at is null").select("element_id", F.col("path").alias("ancestors"), (F.size("path") + 1).alias("level"))


def with_variants(products: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with their variants' skus and prices, variants with their product's title."""
    grouped = variants.groupBy("product_id").agg(F.array_sort(F.collect_set("sku")).alias("skus"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
    return products.join(grouped, "product_id", "left"), variants.join(products.select("product_id", F.col("title").alias("product_title")), "product_id", "left")
