"""Autocomplete: terms, completions in context, compounds and element titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import language_match, normalize_text, search_text, tokenize_text
from tesserine.operators.index import KEY, Index
from tesserine.operators.retrieval import Settings, resolve, with_tokens


def terms(index: Index, site_id: int | None = None, language: str | None = None, prefix: str | None = None, limit: int = 10) -> DataFrame:
    """A1: terms by summed frequency."""
    if language is None:
        rows = index.term_stats if site_id is None else index.term_stats.where(F.col("site_id") == site_id)
        rows = rows.select("term", F.col("total_tf").alias("tf"))
    else:
        rows = index.postings if site_id is None else index.postings.where(F.col("site_id") == site_id)
        rows = rows.join(index.doc_stats.where(language_match(F.col("language"), F.lit(language))).select(*KEY), KEY, "left_semi").select("term", "tf")
    if prefix:
        rows = rows.where(F.col("term").startswith(normalize_text(prefix)))
    return rows.groupBy("term").agg(F.sum("tf").alias("frequency")).orderBy(F.desc("frequency"), "term").limit(limit)


def completions(index: Index, query: str, site_id: int = 1, language: str | None = None, limit: int = 10, s: Settings = Settings()) -> DataFrame:
    """A2: completions of the last token among documents that the tokens before it allow; a token that resolves to nothing is skipped."""
    tokens = tokenize_text(query)
    if not tokens:
        return index.term_stats.where("false").select("term", F.lit(0).cast("long").alias("coverage"), F.lit(0).cast("long").alias("frequency"))
    own = index.postings.where(F.col("site_id") == site_id)
    for t in tokens[:-1]:
        found = [r.term for r in resolve(index, [t], site_id, s)]
        if found:
            own = own.join(with_tokens(index, found, site_id), KEY, "left_semi")
    if language is not None:
        own = own.join(index.doc_stats.where(language_match(F.col("language"), F.lit(language))).select(*KEY), KEY, "left_semi")
    found = list(dict.fromkeys(r.term for r in resolve(index, [tokens[-1]], site_id, s, prefix=True)))
    place = index.postings.sparkSession.createDataFrame([(t, i) for i, t in enumerate(found)] or [("", 0)], "term string, place int")
    counted = own.where(F.col("term").isin(found)).groupBy("term").agg(F.count("*").alias("coverage"), F.sum("tf").alias("frequency"))
    return counted.join(F.broadcast(place), "term").orderBy(F.desc("coverage"), F.desc("frequency"), "place").limit(limit).select("term", "coverage", "frequency")


def merge_sites(lists: DataFrame, limit: int = 10) -> DataFrame:
    """A3: ``lists(site_order, rank, term)``: first occurrence wins."""
    first = Window.partitionBy("term").orderBy("site_order", "rank")
    return lists.withColumn("_r", F.row_number().over(first)).where("_r = 1").orderBy("site_order", "rank").limit(limit).select("term")


def compounds(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """A4: compounds by summed frequency, shown as most often written."""
    own = index.compounds.where(F.col("suggestion").startswith(normalize_text(prefix)))
    each = own.groupBy("suggestion", "display").agg(F.sum("frequency").alias("n"))
    shown = each.groupBy("suggestion").agg(F.sum("n").alias("frequency"), F.min(F.struct((-F.col("n")).alias("n"), "display")).alias("d"))
    return shown.select("suggestion", F.col("d.display").alias("display"), "frequency").orderBy(F.desc("frequency"), "suggestion").limit(limit)


def elements(docs: DataFrame, prefix: str, site_id: int | None = None, kind: str | None = None, limit: int = 10) -> DataFrame:
    """A5: titles that begin with the prefix."""
    out = docs.withColumn("search_text", search_text(F.col("title"))).where(F.col("search_text").startswith((normalize_text(prefix) or "").strip()))
    out = out if site_id is None else out.where(F.col("site_id") == site_id)
    out = out if kind is None else out.where(F.col("type") == kind)
    return out.select("element_id", "title", "type").orderBy("title", "element_id").limit(limit)


def dedupe(results: DataFrame) -> DataFrame:
    """Of ``results(place, site_id, element_id, type, ...)`` merged from several indices the first of each site, element and type."""
    first = Window.partitionBy("site_id", "element_id", "type").orderBy("place")
    return results.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def suggest(index: Index, query: str, site_id: int = 1, limit: int = 10, minimum: int = 2) -> DataFrame:
    """Compounds for a query that is one, else completions; nothing below the minimum length."""
    from tesserine.plans.query import understand

    if len(query.strip()) < minimum:
        return index.term_stats.where("false").select(F.col("term").alias("suggestion"))
    known = understand(query, autocomplete=True)
    if known.is_compound:
        return compounds(index, known.compound_prefix, limit).select(F.col("display").alias("suggestion"))
    return completions(index, query, site_id, limit=limit).select(F.col("term").alias("suggestion"))
