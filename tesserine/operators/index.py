"""The inverted index: a handful of tables built by one job and read by every search.

``postings`` holds a row for each site, term and document with frequency and title flag; the
other tables are small beside it. On disk they are partitioned by site and sorted by term, so a
search reads the row groups of its terms. Deletions and updates replace documents by
anti-join and union; statistics are recomputed aggregates, so nothing can drift or go below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import TOKEN, compounds, ngrams, normalize, tokens, without_stop_words

TABLES = ("documents", "postings", "doc_stats", "term_stats", "corpus_stats", "term_ngrams", "compounds")
KEY = ["site_id", "document_key"]


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    term_ngrams: DataFrame
    compounds: DataFrame

    def persist(self) -> Index:
        return Index(**{t: getattr(self, t).persist() for t in TABLES})

    def unpersist(self) -> None:
        for t in TABLES:
            getattr(self, t).unpersist()

    def write(self, path: str) -> None:
        for t in TABLES:
            df = getattr(self, t)
            if t in ("postings", "term_ngrams"):
                df = df.repartition("site_id", "term").sortWithinPartitions("site_id", "term")
            df.write.mode("overwrite").partitionBy("site_id").parquet(f"{path}/{t}")


def load(spark: SparkSession, path: str) -> Index:
    return Index(**{t: spark.read.parquet(f"{path}/{t}") for t in TABLES})


def analysed(docs: DataFrame, stop: list[str]) -> DataFrame:
    """``docs`` with ``title_tokens`` and ``all_tokens``: title and content, normalised once, without stop words."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    out = docs.select(*docs.columns, normalize(text).alias("_text"), normalize(F.coalesce("title", F.lit(""))).alias("_title"))
    return out.withColumn("title_tokens", F.array_distinct(without_stop_words(tokens(F.col("_title")), stop))).withColumn("all_tokens", without_stop_words(tokens(F.col("_text")), stop)).drop("_text", "_title")


def build(docs: DataFrame, stop: list[str]) -> Index:
    """An index of ``docs(site_id, document_key, element_id, title, content, language, type, ...)``. Null title or content is empty."""
    full = analysed(docs, stop)
    exploded = full.select(*KEY, "title_tokens", F.explode("all_tokens").alias("term"))
    postings = exploded.select(*KEY, "term", F.array_contains("title_tokens", F.col("term")).alias("is_title")).groupBy(*KEY, "term").agg(F.count("*").cast("int").alias("tf"), F.max("is_title").alias("is_title"))
    doc_stats = full.select(*KEY, F.size("all_tokens").alias("doc_len"), "language")
    term_stats, corpus = statistics(postings, doc_stats)
    grams = term_grams(term_stats)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    found = docs.select(*KEY, F.explode(compounds(text)).alias("display")).groupBy(*KEY, "display").agg(F.count("*").alias("frequency"))
    found = found.withColumn("suggestion", normalize(F.col("display")))
    return Index(docs, postings, doc_stats, term_stats, corpus, grams, found)


def upsert(index: Index, docs: DataFrame, stop: list[str]) -> Index:
    """The index with ``docs`` in place of the documents of the same keys: only these are analysed, what else there is of documents, postings and compounds stays.

    Term and corpus statistics are sums over the new postings and lengths; n-grams are made of new terms alone.
    """
    new = build(docs, stop)
    kept = lambda df: df.join(docs.select(*KEY), KEY, "left_anti")
    both = {t: kept(getattr(index, t)).unionByName(getattr(new, t), allowMissingColumns=True) for t in ("documents", "postings", "doc_stats", "compounds")}
    term_stats, corpus_stats = statistics(both["postings"], both["doc_stats"])
    fresh = term_stats.select("site_id", "term").join(index.term_ngrams.select("site_id", "term").distinct(), ["site_id", "term"], "left_anti")
    still = index.term_ngrams.join(term_stats.select("site_id", "term"), ["site_id", "term"], "left_semi")
    return Index(**both, term_stats=term_stats, corpus_stats=corpus_stats, term_ngrams=still.unionByName(term_grams(fresh)))


def statistics(postings: DataFrame, doc_stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Term and corpus statistics."""
    terms = postings.groupBy("site_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))
    return terms, doc_stats.groupBy("site_id").agg(F.count("*").alias("n_docs"), F.greatest(F.sum("doc_len"), F.lit(1)).alias("total_len"))


def term_grams(terms: DataFrame) -> DataFrame:
    """``site_id, term, ngram_count, ngram``."""
    return terms.select("site_id", "term", ngrams(F.col("term")).alias("g")).select("site_id", "term", F.size("g").alias("ngram_count"), F.explode("g").alias("ngram"))


def delete_elements(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents without all sections of the elements in ``gone(site_id, element_id)``; elements that are not there change nothing."""
    return docs.join(gone.select("site_id", "element_id").distinct(), ["site_id", "element_id"], "left_anti")


def delete_orphan_sections(docs: DataFrame, site_id: int, element_id: int, keep: list[str]) -> DataFrame:
    """Documents without those of the element whose key is not kept."""
    orphan = (F.col("site_id") == site_id) & (F.col("element_id") == element_id) & ~F.col("document_key").isin(keep)
    return docs.where(~orphan)


def clear_site(docs: DataFrame, site_id: int) -> DataFrame:
    return docs.where(F.col("site_id") != site_id)


def clear(docs: DataFrame, index_handle: str | None = None, site_id: int | None = None) -> DataFrame:
    """K7: documents without those of an index, of a site, or of both together; without either, none stays."""
    gone = F.lit(True)
    if index_handle is not None:
        gone = gone & (F.col("index_handle") == index_handle)
    if site_id is not None:
        gone = gone & (F.col("site_id") == site_id)
    return docs.where(~gone)


def browse(index: Index, site_id: int | None = None, language: str | None = None, types: list[str] | None = None) -> DataFrame:
    """All documents of the index, by site and key; ``toLocalIterator`` walks through them."""
    out = index.documents if site_id is None else index.documents.where(F.col("site_id") == site_id)
    out = out if language is None else out.where(F.col("language") == language)
    return (out if types is None else out.where(F.col("type").isin(types))).orderBy(*KEY)


def document_exists(index: Index, asked: DataFrame) -> DataFrame:
    """``asked(site_id, element_id)`` with ``found``."""
    there = index.documents.select("site_id", "element_id").distinct().withColumn("found", F.lit(True))
    return asked.join(there, ["site_id", "element_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def list_indices(parts: dict[str, DataFrame]) -> DataFrame:
    """Handles and document counts."""
    out = None
    for handle, docs in parts.items():
        one = docs.agg(F.count("*").alias("entries")).select(F.lit(handle).alias("index_handle"), "entries")
        out = one if out is None else out.unionByName(one)
    return out


def orphan_ngrams(index: Index) -> DataFrame:
    """N-grams of terms without postings; an index built here has none."""
    return index.term_ngrams.join(index.postings.select("site_id", "term").distinct(), ["site_id", "term"], "left_anti")


def orphan_storage(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Handles in storage that no index is configured for."""
    return stored.select("index_handle").distinct().join(configured.select("index_handle"), "index_handle", "left_anti")


def best_documents(docs: DataFrame, elements: list[int] | None = None) -> DataFrame:
    """One document for each element: by site, then intro before sections, then key."""
    from pyspark.sql import Window

    rank = F.when(F.col("section_index").isNull(), -1).otherwise(F.col("section_index")) if "section_index" in docs.columns else F.lit(-1)
    order = Window.partitionBy("element_id").orderBy("site_id", rank, "document_key")
    some = docs.where(F.col("element_id").isin(elements)) if elements is not None else docs
    return some.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def prefix_terms(index: Index, prefix: str, site_id: int) -> DataFrame:
    return index.term_stats.where((F.col("site_id") == site_id) & F.col("term").startswith(prefix)).select("term")


def counts(index: Index) -> DataFrame:
    """Rows of documents, terms and compounds."""
    one = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
    return one(index.documents, "documents").union(one(index.term_stats, "terms")).union(one(index.compounds, "compounds"))


def expected_counts(docs: DataFrame, index: Index) -> DataFrame:
    """Documents a site should have and has."""
    want = docs.groupBy("site_id").agg(F.count("*").alias("expected"))
    return want.join(index.doc_stats.groupBy("site_id").agg(F.count("*").alias("indexed")), "site_id", "full").select("site_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("indexed", F.lit(0)).alias("indexed"))


__all__ = ["KEY", "TABLES", "TOKEN", "Index", "build", "load"]
