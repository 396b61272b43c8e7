"""What a hit or a document says of itself: identity, type, categories, availability, coverage, and its public form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
#: Columns of a hit that are not shown.
HIDDEN = ("id", "object_id", "element_type", "section", "section_handle", "group", "group_handle", "category", "content", "body", "description", "excerpt", "highlights", "section_body", "thumbnail")
#: The order in which those that are there are shown; others follow, the score and what matched come last.
ORDER = ("element_id", "site_id", "site", "language", "index", "backend_id", "title", "slug", "url", "date_created", "date_updated", "type", "source", "section_type", "section_id", "section_title", "section_level", "section_anchor", "section_url", "section_index", "ancestors", "level", "category_ids", "promoted", "position", "snippet", "headings", "fields")
LAST = ("score", "matched_in", "matched_terms", "matched_phrases")


def element_id(*candidates: Column) -> Column:
    """The first that is a number."""
    return F.coalesce(*[F.when(c.cast("string").rlike(_NUMBER), c.cast("string").try_cast("double").cast("long")) for c in candidates])


def backend_id(hit: DataFrame) -> Column:
    """The stored id; else an id that is no number; else made of element, site and section."""
    text = lambda c: F.col(c).cast("string") if c in hit.columns else F.lit(None).cast("string")
    own = F.coalesce(F.when(text("backend_id") != "", text("backend_id")), *[F.when((text(c) != "") & ~text(c).rlike(_NUMBER), text(c)) for c in ("id", "object_id")])
    element = element_id(*[F.col(c) for c in ("element_id", "id", "object_id") if c in hit.columns]).cast("string")
    made = F.concat(element, *[F.when(text(c).isNotNull() & (text(c) != ""), F.concat(F.lit("_"), text(c))).otherwise(F.lit("")) for c in ("site_id", "section_id")])
    return F.coalesce(own, made)


def identified(hits: DataFrame) -> DataFrame:
    """Hits with ``element_id`` and ``backend_id``."""
    names = [c for c in ("element_id", "id", "object_id") if c in hits.columns]
    return hits.withColumns({"backend_id": backend_id(hits), "element_id": element_id(*[F.col(c) for c in names])})


def safe_url(url: Column) -> Column:
    """An address, or nothing where its scheme is not one to follow."""
    return F.when(F.lower(F.regexp_replace(url, r"[\x00-\x20]", "")).rlike(r"^(javascript|data|vbscript|file):"), F.lit("")).otherwise(url)


def present(hits: DataFrame, url_required: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Identified, without hidden and internal columns, unsafe addresses emptied, in the fixed order."""
    out = identified(hits)
    if "url" in out.columns:
        out = out.withColumn("url", safe_url(F.col("url")))
        out = out.where(F.trim("url") != "") if url_required else out
    if "slug" in out.columns:
        out = out.withColumn("slug", F.when(F.trim("slug") != "", F.trim("slug")))
    keep = [c for c in out.columns if c not in HIDDEN and not c.startswith("_") and (fields is None or c in fields or c in ORDER or c in LAST)]
    return out.select(*[c for c in ORDER if c in keep], *[c for c in keep if c not in ORDER + LAST], *[c for c in LAST if c in keep])


def public_headings(headings: Column, url: Column) -> Column:
    """Of ``array<struct<text, id, level, ...>>`` title, id, level from 1 to 6, and the address with the id."""
    titled = F.filter(headings, lambda h: F.trim(h["text"]) != "")
    return F.transform(titled, lambda h: F.struct(F.trim(h["text"]).alias("title"), F.trim(h["id"]).alias("id"), F.least(F.lit(6), F.greatest(F.lit(1), F.coalesce(h["level"], F.lit(2)))).alias("level"), F.when(url.isNotNull() & (F.trim(h["id"]) != ""), F.concat(url, F.lit("#"), F.trim(h["id"]))).alias("url")))


def document_type(kind: Column) -> Column:
    """An element class in lower case with hyphens."""
    short = F.regexp_replace(F.trim(kind), r"^.*[\\/]", "")
    out = F.regexp_replace(F.lower(F.regexp_replace(short, r"(?<!^)([A-Z])", "-$1")), r"[^a-z0-9]+", "-")
    out = F.regexp_replace(out, r"^-+|-+$", "")
    return F.when(out == "", "element").otherwise(out)


def category_ids(relations: DataFrame) -> DataFrame:
    """Of ``relations(element_id, category_id)`` each element's categories, ascending."""
    return relations.where("category_id > 0").groupBy("element_id").agg(F.array_sort(F.collect_set("category_id")).alias("category_ids"))


def available(elements: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """M9: elements that are live; a variant needs a live product too."""
    live = elements.where("status in ('live', 'enabled', 'active')")
    if products is None:
        return live
    sold = products.where("status in ('live', 'enabled', 'active')").select(F.col("element_id").alias("product_id"))
    return live.where("type <> 'variant'").unionByName(live.where("type = 'variant'").join(sold, "product_id", "left_semi").select(live.columns))


def tracking(value: Column, longest: int, spaces: bool) -> Column:
    """Permitted characters of a tracking value, cut; null where nothing is left."""
    kept = F.substring(F.regexp_replace(value, r"[^a-zA-Z0-9 ._-]" if spaces else r"[^a-zA-Z0-9_-]", ""), 1, longest)
    return F.when(~kept.isin("", "0"), kept)


def uncovered(wanted: DataFrame, indices: DataFrame) -> DataFrame:
    """``wanted(type, site_id)`` that no enabled index without criteria covers; an index of no site covers all."""
    free = indices.where("enabled and not restricted").select("type", F.col("site_id").alias("_site"))
    return wanted.join(free, (wanted["type"] == free["type"]) & (F.col("_site").isNull() | (F.col("_site") == wanted["site_id"])), "left_anti")


def flattened(parts: DataFrame) -> DataFrame:
    """``parts(element_id, place, kind, handle, value)`` of searchable fields as one body and one content text for each element.

    Rich text and fields of a body's name go to the body, all else to the content; parts without text are left out.
    """
    from tesserine.functions.content import strip_html

    text = F.when(F.col("kind") == "rich", strip_html(F.col("value"))).otherwise(F.trim("value"))
    body = (F.col("kind") == "rich") | F.lower("handle").isin("body", "copy", "content", "maincontent", "articlebody")
    rows = parts.select("element_id", "place", body.alias("_body"), text.alias("_text")).where("_text <> ''")
    joined = lambda b: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_body") == b, F.struct("place", "_text")))), lambda x: x["_text"]), " ")
    return rows.groupBy("element_id").agg(joined(True).alias("body"), joined(False).alias("content"))


def projected(docs: DataFrame, stored: list[str], snippet: list[str] = ("title", "content")) -> DataFrame:
    """The columns that an index stores: keys, what it may return and what snippets are made of."""
    keep = {"site_id", "document_key", "element_id", *stored, *snippet}
    return docs.select(*[c for c in docs.columns if c in keep])


def rule_errors(rule: dict) -> list[str]:
    """M8: what is wrong with a query rule before it is kept."""
    out, action, value = [], rule.get("action_type"), rule.get("action_value") or {}
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) or isinstance(x, str) and re.match(_NUMBER, x) is not None
    if action == "synonym":
        terms = value.get("terms")
        if not isinstance(terms, list) or not terms:
            out.append("a synonym rule needs a term")
        elif len(terms) > 10:
            out.append("a synonym rule has ten terms at most")
    needs = {"boost_section": ("section_handle",), "boost_category": ("category_id", "category_handle"), "boost_element": ("element_id",)}.get(action)
    if needs:
        if not any(value.get(n) for n in needs):
            out.append(f"{action} needs {' or '.join(needs)}")
        if not number(value.get("multiplier")):
            out.append(f"{action} needs a number as multiplier")
    if action == "redirect":
        url = str(value.get("url") or "").strip()
        if not url and not (value.get("element_id") and value.get("element_type")):
            out.append("a redirect needs an address or an element")
        if url and not re.match(r"(?i)https?://|/(?!/)", url):
            out.append("an address begins with https://, http:// or /")
    pattern = str(rule.get("match_value") or "").strip()
    if rule.get("match_type") == "regex" and pattern:
        if len(pattern) > 500:
            out.append("a pattern has 500 characters at most")
        else:
            try:
                re.compile(pattern)
            except re.error as e:
                out.append(f"no valid pattern: {e}")
            if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)\s*[+*{]", pattern):
                out.append("a pattern repeats what repeats")
    return out
