"""Term resolution, boolean retrieval and BM25 ranking as one lazy plan for a query.

A query is parsed on the driver; its few resolved terms go into the plan as literals, so the
posting scan is a pushed-down ``term IN (...)`` and everything after works on matching
postings only. Ties: score descending, then document key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import adaptive_threshold, damerau_levenshtein, damerau_levenshtein_bytes, jaccard, language_match, ngrams, normalize_text, tokenize_text, within_budget, within_budget_column
from tesserine.operators.index import KEY, Index
from tesserine.plans.query import ParsedQuery, parse


@dataclass(frozen=True)
class Settings:
    """The defaults."""

    k1: float = 1.5
    b: float = 0.75
    title_boost: float = 5.0
    exact_boost: float = 3.0
    phrase_boost: float = 4.0
    fuzzy_threshold: float = 0.25
    fuzzy_cap: int = 100
    fuzzy_cap_with_exact: int = 3
    fuzzy_weight: float = 0.4
    fuzzy_min_length: int = 3
    fuzzy: bool = True


@dataclass(frozen=True)
class Resolved:
    position: int
    term: str
    match: str
    weight: float


def ngram_candidates(index: Index, terms: DataFrame, site_id: int, base: float, cap: int) -> DataFrame:
    """``query, term, similarity`` of terms alike by n-gram Jaccard, at most ``cap`` a query; one equi-join on n-grams."""
    grams = terms.select("query", F.length("query").alias("length"), ngrams(F.col("query")).alias("g")).select("query", "length", F.size("g").alias("n"), F.explode("g").alias("ngram"))
    own = index.term_ngrams.where(F.col("site_id") == site_id)
    common = own.join(F.broadcast(grams), "ngram").groupBy("query", "length", "n", "term", "ngram_count").agg(F.count("*").alias("common"))
    alike = common.withColumn("similarity", F.col("common") / (F.col("n") + F.col("ngram_count") - F.col("common"))).where(F.col("similarity") >= adaptive_threshold(F.col("length"), base))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "term")
    return alike.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).select("query", "term", "similarity")


def resolve(index: Index, tokens: list[str], site_id: int, s: Settings = Settings(), prefix: bool = False, limit: int = 100) -> list[Resolved]:
    """R1 for each token position. The candidates of the query's few tokens, each list capped, come to the driver."""
    spark = index.postings.sparkSession
    out: list[Resolved] = []
    if not tokens:
        return out
    distinct = list(dict.fromkeys(tokens))
    stats = index.term_stats.where(F.col("site_id") == site_id)
    exact = {r[0] for r in stats.where(F.col("term").isin(distinct)).select("term").collect()}
    fuzzy: dict[str, list] = {}
    if s.fuzzy:
        asked = spark.createDataFrame([(t,) for t in distinct], "query string")
        for q, t, sim in ngram_candidates(index, asked, site_id, s.fuzzy_threshold, s.fuzzy_cap + 1).collect():
            fuzzy.setdefault(q, []).append((t, sim))
    for position, token in enumerate(tokens):
        seen = set()
        if token in exact:
            out.append(Resolved(position, token, "exact", 1.0))
            seen.add(token)
        if prefix:
            found = stats.where(F.col("term").startswith(token)).orderBy(F.desc("total_tf"), "term").limit(2 * limit).select("term").collect()
            for (t,) in [r for r in found if r[0] not in seen][:limit]:
                out.append(Resolved(position, t, "prefix", 1.0))
                seen.add(t)
        cap = s.fuzzy_cap_with_exact if token in exact else s.fuzzy_cap
        # The cap comes before the typo filter, so good candidates behind it are lost on purpose.
        added = 0  # one more candidate than the cap, which the token itself may take
        for t, sim in sorted(fuzzy.get(token, []), key=lambda c: (-c[1], c[0]))[: cap + 1]:
            if added < cap and t != token and t not in seen and len(t) >= s.fuzzy_min_length and within_budget(token, t):
                out.append(Resolved(position, t, "fuzzy", sim * s.fuzzy_weight))
                seen.add(t)
                added += 1
    return out


def bm25(tf: Column, df: Column, length: Column, n: Column, average: Column, s: Settings) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    score = idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length / average))
    return F.when((n > 0) & (df > 0) & (average > 0), score).otherwise(0.0)


def term_scores(index: Index, resolved: list[Resolved], site_id: int, s: Settings = Settings()) -> DataFrame:
    """``site_id, document_key, score, positions``: summed weighted BM25, and how many token positions each document covers."""
    spark = index.postings.sparkSession
    rows = spark.createDataFrame([(r.position, r.term, r.match, r.weight) for r in resolved] or [(0, "", "", 0.0)], "position int, term string, match string, weight double")
    terms = list({r.term for r in resolved})
    hits = index.postings.where((F.col("site_id") == site_id) & F.col("term").isin(terms))
    hits = hits.join(F.broadcast(rows), "term")  # as many rows as the query resolves to
    stats = index.term_stats.where((F.col("site_id") == site_id) & F.col("term").isin(terms)).select("term", "df")
    hits = hits.join(F.broadcast(stats), "term")  # a row a term
    hits = hits.join(index.doc_stats.select(*KEY, "doc_len"), KEY, "left").join(F.broadcast(index.corpus_stats.where(F.col("site_id") == site_id)), "site_id")
    one = bm25(F.col("tf"), F.col("df"), F.coalesce("doc_len", F.lit(1)), F.col("n_docs"), F.col("total_len") / F.col("n_docs"), s)
    title = F.when(F.col("is_title") & (F.col("match") == "exact"), s.title_boost).otherwise(1.0)
    weighted = hits.select(*KEY, "position", (one * F.col("weight") * title).alias("part"))
    return weighted.groupBy(*KEY).agg(F.sum("part").alias("score"), F.countDistinct("position").alias("positions"))


def all_of(scores: DataFrame, n: int, relax: bool = False) -> DataFrame:
    """Documents that cover every position; with ``relax`` all documents where none does, more than one position given."""
    if not relax or n < 2:
        return scores.where(F.col("positions") == n).withColumn("relaxed", F.lit(False))
    most = scores.agg(F.max("positions").alias("most"))  # one row
    return scores.join(F.broadcast(most)).where((F.col("positions") == n) | (F.col("most") < n)).withColumn("relaxed", F.col("most") < n).drop("most")


def with_tokens(index: Index, tokens: list[str], site_id: int, title: bool | None = None) -> DataFrame:
    """Keys of documents that have any of the tokens: in the title, outside it, or anywhere."""
    out = index.postings.where((F.col("site_id") == site_id) & F.col("term").isin(tokens))
    if title is not None:
        out = out.where(F.col("is_title") == title)
    return out.select(*KEY).distinct()


def phrase_scores(index: Index, phrase: str, site_id: int, s: Settings, stop: list[str] | None = None) -> DataFrame:
    """Documents with every indexed word of the phrase whose text has it as it stands (lower case, single spaces; no accent folding, may begin within a word)."""
    words = [w for w in tokenize_text(phrase) if w not in (stop or [])]
    found = all_of(term_scores(index, resolve(index, words, site_id, s), site_id, s), len(words))
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "title", "content")), r"\s+", " ")
    kept = found.join(index.documents.select(*KEY, text.alias("_text")), KEY).where(F.instr("_text", " ".join(phrase.lower().split())) > 0)
    return kept.select(*KEY, (F.col("score") * s.phrase_boost).alias("score"))


def wildcard_scores(index: Index, prefix: str, site_id: int, s: Settings) -> DataFrame:
    """Any term that begins with the prefix, summed; expansion stays a join however many terms there are."""
    prefix = normalize_text(prefix) or ""
    stats = index.term_stats.where((F.col("site_id") == site_id) & F.col("term").startswith(prefix)).select("site_id", "term", "df")
    hits = index.postings.where((F.col("site_id") == site_id) & F.col("term").startswith(prefix)).join(stats, ["site_id", "term"])
    hits = hits.join(index.doc_stats.select(*KEY, "doc_len"), KEY, "left").join(F.broadcast(index.corpus_stats), "site_id")
    one = bm25(F.col("tf"), F.col("df"), F.coalesce("doc_len", F.lit(1)), F.col("n_docs"), F.col("total_len") / F.col("n_docs"), s)
    return hits.groupBy(*KEY).agg(F.sum(one * F.when(F.col("is_title"), s.title_boost).otherwise(1.0)).alias("score"))


def exact_sequence(index: Index, scores: DataFrame, tokens: list[str], stop: list[str], s: Settings) -> DataFrame:
    """Scores times the exact boost where the title or the content tokens hold the query tokens in a row."""
    from tesserine.functions.text import tokenize, without_stop_words

    if len(tokens) < 2:
        return scores
    joined = lambda c: F.concat(F.lit(" "), F.array_join(without_stop_words(tokenize(F.coalesce(c, F.lit(""))), stop), " "), F.lit(" "))
    docs = scores.join(index.documents.select(*KEY, "title", "content"), KEY, "left")
    want = f" {' '.join(tokens)} "
    both = (F.instr(joined(F.col("title")), want) > 0) | (F.instr(joined(F.col("content")), want) > 0)
    return docs.withColumn("score", F.col("score") * F.when(both, s.exact_boost).otherwise(1.0)).drop("title", "content")


def search(index: Index, query: str | ParsedQuery, site_id: int = 1, language: str | None = None, limit: int = 20, offset: int = 0, stop: list[str] | None = None, s: Settings = Settings(), types: list[str] | None = None) -> DataFrame:
    """``site_id, document_key, score`` of a page, best first. limit 0: all, in no order, for whoever merges and sorts them."""
    return page(scores(index, query, site_id, language, stop, s, types), limit, offset)


def search_sites(index: Index, query: str | ParsedQuery, site_ids: list[int], language: str | None = None, limit: int = 20, offset: int = 0, stop: list[str] | None = None, s: Settings = Settings(), types: list[str] | None = None) -> DataFrame:
    """The page of several sites together; statistics are each site's own, a document counts once for each site."""
    out = None
    for site_id in dict.fromkeys(site_ids):
        own = scores(index, query, site_id, language, stop, s, types)
        out = own if out is None else out.unionByName(own)
    return page(out if out is not None else scores(index, "", 0), limit, offset)


def scores(index: Index, query: str | ParsedQuery, site_id: int = 1, language: str | None = None, stop: list[str] | None = None, s: Settings = Settings(), types: list[str] | None = None) -> DataFrame:
    """``site_id, document_key, score`` of every hit in a site."""
    parsed = query if isinstance(query, ParsedQuery) else parse(query, language or "en")
    stop = stop or []
    tokens = [t for t in parsed.tokens if t not in stop]
    empty = index.doc_stats.select(*KEY, F.lit(0.0).alias("score")).where("false")
    if parsed.is_empty:
        return empty
    parts = []
    if tokens:
        found = term_scores(index, resolve(index, tokens, site_id, s), site_id, s)
        if not parsed.advanced:
            found = exact_sequence(index, all_of(found, len(tokens), relax=True), tokens, stop, s)
        elif parsed.operator == "AND":
            found = all_of(found, len(tokens))
        parts.append(found.select(*KEY, "score"))
    if parsed.phrases:
        every = [phrase_scores(index, p, site_id, s, stop) for p in parsed.phrases]
        parts.append(_summed(every))
    if parsed.wildcards:
        parts.append(_summed([wildcard_scores(index, w, site_id, s) for w in parsed.wildcards]))
    if not parts:
        return empty
    out = parts[0]
    for more in parts[1:]:
        if parsed.operator == "AND":
            out = out.join(more.withColumnRenamed("score", "_s"), KEY).select(*KEY, (F.col("score") + F.col("_s")).alias("score"))
        else:
            out = _summed([out, more])
    for name, values in parsed.field_filters.items():
        wanted = [normalize_text(v) or "" for v in values]
        out = out.join(with_tokens(index, wanted, site_id, name == "title"), KEY, "left_semi")
    if parsed.not_terms:
        out = out.join(with_tokens(index, [t for n in parsed.not_terms for t in tokenize_text(n)], site_id), KEY, "left_anti")
    for term, factor in parsed.boosts.items():
        has = with_tokens(index, [r.term for r in resolve(index, tokenize_text(term), site_id, s)], site_id).withColumn("_b", F.lit(factor))
        out = out.join(has, KEY, "left").select(*KEY, (F.col("score") * F.coalesce("_b", F.lit(1.0))).alias("score"))
    if language is not None and "language" in index.doc_stats.columns:
        out = out.join(index.doc_stats.where(language_match(F.col("language"), F.lit(language))).select(*KEY), KEY, "left_semi")
    if types:
        out = out.join(index.documents.where(F.lower("type").isin([t.lower() for t in types])).select(*KEY), KEY, "left_semi")
    return out.select(*KEY, "score")


def _summed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*KEY).agg(F.sum("score").alias("score"))


def page(scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Score rounded to six places before the sort, so that a plan's order of addition decides no tie."""
    out = scores.withColumn("score", F.round("score", 6))
    if not limit and not offset:
        return out
    out = out.orderBy(F.desc("score"), "document_key", *(["site_id"] if "site_id" in scores.columns else []))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def matched_fields(index: Index, hits: DataFrame, terms: list[str]) -> DataFrame:
    """Matched terms of each hit, in the title and outside it."""
    own = index.postings.where(F.col("term").isin(terms)).join(hits.select(*KEY), KEY, "left_semi")
    return own.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(F.col("is_title"), F.col("term")))).alias("title_terms"), F.array_sort(F.collect_list(F.when(~F.col("is_title"), F.col("term")))).alias("content_terms"))


def live_comparison(hits: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """Hits beside the current source rows: missing, changed or same."""
    now = docs.select(*KEY, *[F.col(f).alias(f"live_{f}") for f in fields], F.lit(True).alias("_there"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"live_{f}"))
    out = hits.join(now, KEY, "left")
    return out.withColumn("state", F.when(F.col("_there").isNull(), "missing").when(same, "same").otherwise("changed")).drop("_there")


def batch_bm25(index: Index, queries: DataFrame, k: int = 10, s: Settings = Settings()) -> DataFrame:
    """Many exact OR queries ``queries(query_id, site_id, term)`` in one job: the k best documents of each."""
    df = queries.join(index.term_stats, ["site_id", "term"]).select("query_id", "site_id", "term", "df")
    hits = index.postings.join(df, ["site_id", "term"]).join(index.doc_stats.select(*KEY, "doc_len"), KEY).join(F.broadcast(index.corpus_stats), "site_id")
    one = bm25(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("n_docs"), F.col("total_len") / F.col("n_docs"), s)
    scored = hits.groupBy("query_id", *KEY).agg(F.round(F.sum(one * F.when(F.col("is_title"), s.title_boost).otherwise(1.0)), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def typo_candidates(pairs: DataFrame, in_bytes: bool = False) -> DataFrame:
    """``pairs(query, term)`` within the typo budget; edits are letters, or bytes of UTF-8 if asked for."""
    return pairs.where(within_budget_column(F.col("query"), F.col("term"), damerau_levenshtein_bytes if in_bytes else damerau_levenshtein))


def similar(pairs: DataFrame, base: float = 0.25) -> DataFrame:
    """``pairs(query, term)`` with the n-gram similarity and whether it reaches the threshold of the query's length."""
    alike = jaccard(ngrams(F.col("query")), ngrams(F.col("term")))
    return pairs.withColumn("similarity", alike).withColumn("similar", F.col("similarity") >= adaptive_threshold(F.length("query"), base))
