"""Registered queries of storage, identity, metadata and sync upkeep, and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import content, text
from tesserine.operators import index as I
from tesserine.operators import metadata as M
from tesserine.operators import pipeline as P
from tesserine.operators import retrieval as R
from tesserine.operators import suggest as S
from tesserine.plans.searches import _PLAIN, INDEX_SQL, STOP, A, B, index
from tesserine.sources.tables import DOCS_SQL, documents, read
from tesserine.streaming import sync

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str, ctes: str = "") -> None:
    QUERIES[name], SQL[name] = run, f"WITH {ctes} {sql}" if ctes else sql


# -- several sites: the French and German documents once more on site 2 ------------------------
def _sites(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    more = docs.where("language in ('fr', 'de')").withColumn("site_id", F.lit(2)).withColumn("document_key", F.concat(F.col("element_id").cast("string"), F.lit("_2")))
    return docs.unionByName(more)


_SITES_SQL = INDEX_SQL.replace("docs AS (", "one AS (", 1).replace(", full_docs AS (", """, docs AS (
  SELECT * FROM one UNION ALL SELECT 2, element_id::VARCHAR || '_2', element_id, title, content, language, type, section_handle FROM one WHERE language IN ('fr', 'de')
), full_docs AS (""", 1).replace("SELECT p.document_key,", "SELECT site_id, p.document_key,", 1)
_add("site_set_search", lambda s, d: R.search_sites(I.build(_sites(s, d), STOP), f"{A} OR {B}", [1, 2], stop=STOP, s=_PLAIN, limit=50),
     f"SELECT site_id, document_key, round(sum(base * CASE WHEN is_title THEN 5.0 ELSE 1.0 END), 6) AS score FROM scored WHERE term IN ('{A}', '{B}') GROUP BY ALL ORDER BY score DESC, document_key, site_id LIMIT 50", _SITES_SQL)

# -- an upsert of every document that holds a term, under a new title ----------------------------
_NEW = "CASE WHEN element_id IN (SELECT element_id FROM one WHERE language = 'es') THEN 'renewed ' || title ELSE title END"
_UPSERT_SQL = INDEX_SQL.replace("docs AS (", "one AS (", 1).replace(", full_docs AS (", f""", docs AS (
  SELECT site_id, document_key, element_id, {_NEW} AS title, content, language, type, section_handle FROM one
), full_docs AS (""", 1)


def _upserted(s: SparkSession, d: str) -> I.Index:
    new = documents(s, d).where("language = 'es'").withColumn("title", F.concat(F.lit("renewed "), F.col("title")))
    return I.upsert(index(s, d), new, STOP)


_add("upsert_postings", lambda s, d: _upserted(s, d).postings.select("document_key", "term", "tf", "is_title"), "SELECT document_key, term, tf, is_title FROM postings", _UPSERT_SQL)
_add("upsert_statistics", lambda s, d: _upserted(s, d).term_stats, "SELECT * FROM term_stats", _UPSERT_SQL)
_add("upsert_ngrams", lambda s, d: _upserted(s, d).term_ngrams.groupBy("term").agg(F.count("*").alias("n")), """SELECT term, count(*) AS n FROM (SELECT term, unnest(list_distinct(list_filter([substr(' ' || term || ' ', i, 2) FOR i IN range(1, length(term) + 2)] || [substr(' ' || term || ' ', i, 3) FOR i IN range(1, length(term) + 1)], lambda g: trim(g) <> ''))) AS g FROM term_stats) GROUP BY term""", _UPSERT_SQL)

# -- index upkeep -------------------------------------------------------------------------
_add("browse", lambda s, d: I.browse(index(s, d), 1, "fr").select("document_key", "title"), "SELECT document_key, title FROM docs WHERE language = 'fr'", DOCS_SQL)
_add("document_exists", lambda s, d: I.document_exists(index(s, d), read(s, d, "labels").select(F.lit(1).alias("site_id"), (F.col("doc_id") * 2).alias("element_id"))).groupBy("found").agg(F.count("*").alias("n")), "SELECT found, count(*) AS n FROM (SELECT doc_id * 2 IN (SELECT doc_id FROM documents) AS found FROM labels) GROUP BY found")
_add("list_indices", lambda s, d: I.list_indices({t: read(s, d, t) for t in ("documents", "benchmark", "conversations")}), " UNION ALL ".join(f"SELECT '{t}' AS index_handle, count(*) AS entries FROM {t}" for t in ("documents", "benchmark", "conversations")))
_add("clear_index_site", lambda s, d: I.clear(_sites(s, d).withColumn("index_handle", F.col("language")), "fr", 2).select("document_key"), "SELECT document_key FROM docs UNION ALL SELECT element_id::VARCHAR || '_2' FROM docs WHERE language = 'de'", DOCS_SQL)
_add("orphan_sections", lambda s, d: I.delete_orphan_sections(read(s, d, "conversations").select(F.lit(1).alias("site_id"), F.col("conv_id").alias("element_id"), F.concat_ws("_", "conv_id", "turn").alias("document_key")), 1, 3, ["3_0", "3_1"]).groupBy("element_id").agg(F.count("*").alias("n")), "SELECT conv_id AS element_id, count(*) AS n FROM conversations WHERE conv_id <> 3 OR turn IN (0, 1) GROUP BY 1")
_add("orphan_storage", lambda s, d: I.orphan_storage(read(s, d, "documents").select(F.col("source").alias("index_handle")), read(s, d, "documents").where("n_chars > 20000").select(F.col("source").alias("index_handle"))), "SELECT DISTINCT source AS index_handle FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars > 20000)")
_add("stale_ngrams", lambda s, d: _stale(s, d), f"SELECT term, count(*) AS n FROM (SELECT term, unnest(g) AS g FROM (SELECT term, list_distinct(list_filter([substr(' ' || term || ' ', i, 2) FOR i IN range(1, length(term) + 2)] || [substr(' ' || term || ' ', i, 3) FOR i IN range(1, length(term) + 1)], lambda g: trim(g) <> '')) AS g FROM term_stats) WHERE term NOT IN (SELECT t FROM full_docs, unnest(all_tokens) u(t) WHERE language <> 'fr')) GROUP BY term", INDEX_SQL)


def _stale(s: SparkSession, d: str) -> DataFrame:
    """N-grams that are left over once the French documents' postings are gone."""
    from dataclasses import replace

    whole = index(s, d)
    kept = whole.postings.join(whole.doc_stats.where("language <> 'fr'").select(*I.KEY), I.KEY, "left_semi")
    return I.orphan_ngrams(replace(whole, postings=kept)).groupBy("term").agg(F.count("*").alias("n"))


# -- text -------------------------------------------------------------------------------
_add("token_counts", lambda s, d: documents(s, d).select("document_key", text.tokenize(F.col("title")).alias("tokens")).select("document_key", F.explode(text.token_counts(F.col("tokens"))).alias("token", "count")), "SELECT document_key, t AS token, count(*)::INT AS count FROM docs, unnest(regexp_extract_all(strip_accents(lower(title)), '[\\p{L}\\p{N}]+')) u(t) GROUP BY ALL", DOCS_SQL)
_add("compound_queries", lambda s, d: documents(s, d).select("document_key", text.is_compound_query(F.concat(F.substring("title", 1, 20), F.when(F.length("title") % 2 == 0, ".tw").otherwise("."))).alias("is_compound")),
     "SELECT document_key, regexp_matches(q, '[\\p{L}\\p{N}]+\\.[\\p{L}\\p{N}]*$') AND NOT starts_with(q, '.') AND len(regexp_extract_all(q, '[\\p{L}\\p{N}]+')) >= 2 AS is_compound FROM (SELECT document_key, trim(strip_accents(lower(substr(title, 1, 20) || CASE WHEN length(title) % 2 = 0 THEN '.tw' ELSE '.' END))) AS q FROM docs)", DOCS_SQL)
_add("cache_identities", lambda s, d: documents(s, d).select("document_key", text.cache_identity(F.col("title")).alias("identity")), "SELECT document_key, lower(trim(regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g'))) AS identity FROM docs", DOCS_SQL)
_add("script_languages", lambda s, d: s.createDataFrame([("بحث",), ("search",), ("",)], "t string").select("t", text.script_language(F.col("t")).alias("language")), "SELECT * FROM (VALUES ('بحث', 'ar'), ('search', NULL), ('', NULL)) v(t, language)")
_add("source_kinds", lambda s, d: read(s, d, "pages").select("page_id", text.source_kind(F.col("page_id") % 5 == 0, F.col("url"), F.lit("example.org")).alias("kind")), "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'cp' WHEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) = 'example.org' THEN 'frontend' ELSE 'api' END AS kind FROM pages")
_add("ip_hashes", lambda s, d: read(s, d, "events").select("event_id", text.ip_hash(F.col("user_id").cast("string"), "salt").alias("hash")), "SELECT event_id, sha256(user_id::VARCHAR || 'salt') AS hash FROM events")
_add("tracking_values", lambda s, d: documents(s, d).select("document_key", M.tracking(F.col("title"), 20, True).alias("version"), M.tracking(F.col("title"), 50, False).alias("source")), "SELECT document_key, nullif(nullif(substr(regexp_replace(title, '[^a-zA-Z0-9 ._-]', '', 'g'), 1, 20), ''), '0') AS version, nullif(nullif(substr(regexp_replace(title, '[^a-zA-Z0-9_-]', '', 'g'), 1, 50), ''), '0') AS source FROM docs", DOCS_SQL)
_add("element_suggestions_accents", lambda s, d: S.elements(documents(s, d), "é"), "SELECT element_id, title, type FROM docs WHERE starts_with(trim(regexp_replace(strip_accents(lower(title)), '\\s+', ' ', 'g')), 'e') ORDER BY title, element_id LIMIT 10", DOCS_SQL)
_add("flattened_fields", lambda s, d: M.flattened(documents(s, d).select("element_id", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), F.lit(h).alias("handle"), v.alias("value")) for i, k, h, v in ((0, "plain", "title", F.col("title")), (1, "plain", "Copy", F.substring("content", 1, 200)), (2, "plain", "source", F.col("section_handle")))])).alias("p")).select("element_id", "p.*")),
     "SELECT element_id, trim(substr(content, 1, 200), ' ') AS body, concat_ws(' ', nullif(trim(title, ' '), ''), section_handle) AS content FROM docs WHERE title IS NOT NULL", DOCS_SQL)
_add("document_types", lambda s, d: s.createDataFrame([("app\\elements\\Entry",), ("DigitalProduct",), ("My_Kind",), ("--",)], "kind string").select("kind", M.document_type(F.col("kind")).alias("type")), "SELECT * FROM (VALUES ('app\\elements\\Entry', 'entry'), ('DigitalProduct', 'digital-product'), ('My_Kind', 'my-kind'), ('--', 'element')) v(kind, type)")

# -- hits -------------------------------------------------------------------------------


def _raw_hits(s: SparkSession, d: str) -> DataFrame:
    """Hits as several backends return them: some by number, some by document key."""
    docs = documents(s, d)
    return docs.select(F.when(F.col("language") == "en", F.col("element_id").cast("string")).when(F.col("language") == "fr", F.col("document_key")).alias("id"), F.when(F.col("language") != "en", F.col("element_id").cast("string")).alias("object_id"), "site_id", "title", F.when(F.col("language") == "de", "javascript:x").otherwise(F.concat(F.lit("/d/"), F.col("element_id").cast("string"))).alias("url"), F.col("content").alias("body"), "type", F.lit("x").alias("_rule"), F.lit(1.5).alias("score"))


_add("hit_identities", lambda s, d: M.identified(_raw_hits(s, d)).select("element_id", "backend_id"), "SELECT element_id, CASE WHEN language = 'fr' THEN document_key ELSE element_id::VARCHAR || '_1' END AS backend_id FROM docs", DOCS_SQL)
_add("presented_hits", lambda s, d: M.present(_raw_hits(s, d)), "SELECT element_id, 1 AS site_id, CASE WHEN language = 'fr' THEN document_key ELSE element_id::VARCHAR || '_1' END AS backend_id, title, CASE WHEN language = 'de' THEN '' ELSE '/d/' || element_id::VARCHAR END AS url, type, 1.5::DOUBLE AS score FROM docs", DOCS_SQL)
_add("presented_with_url", lambda s, d: M.present(_raw_hits(s, d), url_required=True).select("element_id"), "SELECT element_id FROM docs WHERE language <> 'de'", DOCS_SQL)
_add("result_dedupe", lambda s, d: S.dedupe(documents(s, d).select("site_id", (F.col("element_id") % 50).alias("element_id"), "type", F.col("element_id").alias("place"))), "SELECT 1 AS site_id, element_id % 50 AS element_id, 'entry' AS type, min(element_id) AS place FROM docs GROUP BY ALL", DOCS_SQL)
_add("merged_site_suggestions", lambda s, d: S.merge_sites(read(s, d, "documents").select((F.col("doc_id") % 3).alias("site_order"), F.col("doc_id").alias("rank"), F.col("source").alias("term")), 8), "SELECT term FROM (SELECT source AS term, doc_id % 3 AS o, doc_id AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3, doc_id) AS n FROM documents) WHERE n = 1 ORDER BY o, r LIMIT 8")
_add("live_comparison", lambda s, d: R.live_comparison(documents(s, d).select(*I.KEY, "title"), documents(s, d).where("language <> 'es'").withColumn("title", F.when(F.col("language") == "fr", F.upper("section_handle")).otherwise(F.col("title"))), ["title"]).select("document_key", "state"), "SELECT document_key, CASE WHEN language = 'es' THEN 'missing' WHEN language = 'fr' AND title <> upper(section_handle) THEN 'changed' ELSE 'same' END AS state FROM docs", DOCS_SQL)
_add("duplicate_promotions", lambda s, d: P.duplicate_promotions(documents(s, d).select("element_id", F.upper("section_handle").alias("query")), documents(s, d).where("language = 'fr'").select("element_id", F.col("section_handle").alias("query"))).select("element_id"), "SELECT element_id FROM docs WHERE language = 'fr'", DOCS_SQL)
_add("stored_projection", lambda s, d: M.projected(documents(s, d), ["language"]), "SELECT site_id, document_key, element_id, title, content, language FROM docs", DOCS_SQL)
_add("type_filter_mixed", lambda s, d: P.type_filter(_typed(s, d), ["asset", "product"]).select("document_key"), "SELECT document_key FROM docs WHERE language IN ('fr', 'de')", DOCS_SQL)
_typed = lambda s, d: documents(s, d).withColumn("type", F.when(F.col("language") == "fr", "asset").when(F.col("language") == "de", "product").otherwise("entry"))

# -- elements ----------------------------------------------------------------------------
_tree = lambda s, d: read(s, d, "documents").select(F.col("doc_id").alias("element_id"), F.when(F.col("doc_id") > 0, F.expr("doc_id div 2")).alias("parent_id"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"))
_add("ancestors", lambda s, d: content.ancestors(_tree(s, d)).select("element_id", F.array_join("ancestors", "/").alias("path"), "level"), """SELECT element_id, path, level FROM up WHERE above IS NULL""", "RECURSIVE tree AS (SELECT doc_id AS element_id, CASE WHEN doc_id > 0 THEN doc_id // 2 END AS parent_id, 't' || doc_id::VARCHAR AS title FROM documents), up AS (SELECT element_id, parent_id AS above, '' AS path, 1 AS level FROM tree UNION ALL SELECT u.element_id, t.parent_id, CASE WHEN u.path = '' THEN t.title ELSE t.title || '/' || u.path END, u.level + 1 FROM up u JOIN tree t ON t.element_id = u.above)")
_add("product_variants", lambda s, d: content.with_variants(read(s, d, "orders").select(F.col("o_orderkey").alias("product_id"), F.col("o_orderstatus").alias("title")), read(s, d, "lineitem").select(F.col("l_orderkey").alias("product_id"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").alias("price")))[0].select("product_id", "title", F.array_join("skus", ",").alias("skus"), "min_price", "max_price"), "SELECT o_orderkey AS product_id, o_orderstatus AS title, skus, min_price, max_price FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS skus, min(l_quantity) AS min_price, max(l_quantity) AS max_price FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
_add("category_ids", lambda s, d: M.category_ids(read(s, d, "lineitem").select(F.col("l_orderkey").alias("element_id"), (F.col("l_partkey") % 20).alias("category_id"))).select("element_id", F.array_join(F.transform("category_ids", lambda x: x.cast("string")), ",").alias("ids")), "SELECT l_orderkey AS element_id, string_agg(DISTINCT (l_partkey % 20), ',' ORDER BY (l_partkey % 20)) AS ids FROM lineitem WHERE l_partkey % 20 > 0 GROUP BY 1")
_elements = lambda s, d: documents(s, d).select("element_id", F.when(F.col("language") == "fr", "variant").otherwise("entry").alias("type"), F.when(F.col("section_handle") == "src1", "disabled").otherwise("live").alias("status"), (F.col("element_id") + 1).alias("product_id"))
_add("available_elements", lambda s, d: M.available(_elements(s, d), _elements(s, d)).select("element_id"), "SELECT element_id FROM docs WHERE section_handle <> 'src1' AND (language <> 'fr' OR element_id + 1 IN (SELECT element_id FROM docs WHERE section_handle <> 'src1'))", DOCS_SQL)
_add("uncovered_types", lambda s, d: M.uncovered(documents(s, d).select(F.col("language").alias("type"), "site_id").distinct(), s.createDataFrame([("fr", None, True, False), ("de", 1, True, True), ("es", 2, True, False), ("en", 1, True, False)], "type string, site_id int, enabled boolean, restricted boolean")), "SELECT DISTINCT language AS type, 1 AS site_id FROM docs WHERE language IN ('de', 'es')", DOCS_SQL)

# -- sync -------------------------------------------------------------------------------
_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _rows(s: SparkSession, d: str) -> DataFrame:
    """A buffer from the events: status, attempts and claims by the event's number."""
    e = read(s, d, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "failed", "processing", "abandoned"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.lit("documents").alias("index_handle"), F.col("event_id").alias("element_id"), F.lit(1).alias("site_id"), F.when(F.col("event_id") % 9 == 0, "delete").otherwise("upsert").alias("op"), status.alias("status"), (F.col("event_id") % 7).cast("int").alias("attempt_count"), F.col("ts").alias("queued_at"), F.when(F.col("event_id") % 3 == 0, F.expr("ts + interval 1 day")).alias("next_attempt_at"), F.col("ts").alias("claimed_at"), F.when(F.col("event_id") % 4 == 2, "mine").alias("claim_token"), F.when(F.col("event_id") % 5 == 0, F.expr("ts + interval 1 hour")).alias("dirty_at"), F.col("event_type").alias("last_error"))


_ROWS = "rows AS (SELECT 'documents' AS index_handle, event_id AS element_id, 1 AS site_id, CASE WHEN event_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op, ['pending', 'failed', 'processing', 'abandoned'][1 + event_id % 4] AS status, (event_id % 7)::INT AS attempt_count, ts AS queued_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS next_attempt_at, ts AS claimed_at, CASE WHEN event_id % 4 = 2 THEN 'mine' END AS claim_token, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 HOUR END AS dirty_at, event_type AS last_error FROM events)"
_add("due_changes", lambda s, d: sync.due(_rows(s, d), F.expr(_NOW)).select("element_id"), f"SELECT element_id FROM rows WHERE status IN ('pending', 'failed') AND (next_attempt_at IS NULL OR next_attempt_at <= {_NOW}) OR status = 'processing' AND claimed_at < {_NOW} - INTERVAL 3600 SECOND", _ROWS)
_add("purged_changes", lambda s, d: sync.purge(_rows(s, d), F.expr(_NOW)).select("element_id"), f"SELECT element_id FROM rows WHERE NOT (status = 'abandoned' AND queued_at < {_NOW} - INTERVAL 3600 SECOND)", _ROWS)
_add("failed_changes", lambda s, d: sync.after_failure(_rows(s, d).where("attempt_count > 0"), F.expr(_NOW)).select("element_id", "status", F.col("next_attempt_at").cast("string").alias("next_attempt_at")), f"SELECT element_id, CASE WHEN attempt_count >= 5 THEN 'abandoned' ELSE 'failed' END AS status, CASE WHEN attempt_count < 5 THEN strftime({_NOW} + to_seconds(least(300, 5 * 2 ** (attempt_count - 1))::INT), '%Y-%m-%d %H:%M:%S') END AS next_attempt_at FROM rows WHERE attempt_count > 0", _ROWS)
_add("succeeded_changes", lambda s, d: sync.succeeded(_rows(s, d), list(range(0, 2000, 2)), "mine").select("element_id", "status", "attempt_count", F.unix_micros(F.col("queued_at").cast("timestamp")).alias("queued_at")), "SELECT element_id, CASE WHEN mine THEN 'pending' ELSE status END AS status, CASE WHEN mine THEN 0 ELSE attempt_count END AS attempt_count, epoch_us(CASE WHEN mine THEN dirty_at ELSE queued_at END) AS queued_at FROM (SELECT *, coalesce(claim_token = 'mine', false) AND element_id % 2 = 0 AND element_id < 2000 AS mine FROM rows) WHERE NOT mine OR dirty_at IS NOT NULL", _ROWS)
_add("status_changes", lambda s, d: sync.status_changes(_rows(s, d).withColumn("post_date", F.col("queued_at")).withColumn("expiry_date", F.col("next_attempt_at")), F.expr("TIMESTAMP '2024-01-10 00:00:00'"), F.expr(_NOW)).select("element_id", "op"), f"SELECT element_id, CASE WHEN went THEN 'delete' ELSE 'upsert' END AS op FROM (SELECT element_id, queued_at > TIMESTAMP '2024-01-10' AND queued_at <= {_NOW} AS came, coalesce(next_attempt_at > TIMESTAMP '2024-01-10' AND next_attempt_at <= {_NOW}, false) AS went FROM rows) WHERE came OR went", _ROWS)
_add("retried_changes", lambda s, d: sync.retry(_rows(s, d), list(range(500))).groupBy("status", "attempt_count").agg(F.count("*").alias("n")), "SELECT CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempt_count END AS attempt_count, count(*) AS n FROM (SELECT *, element_id < 500 AND status IN ('failed', 'abandoned') AS again FROM rows) GROUP BY 1, 2", _ROWS)
_add("buffer_search", lambda s, d: sync.buffer_search(_rows(s, d), status="failed", text="click", limit=40).select("element_id"), "SELECT element_id FROM rows WHERE status = 'failed' AND (contains(last_error, 'click') OR contains(element_id::VARCHAR, 'click')) ORDER BY queued_at, index_handle, element_id, site_id LIMIT 40", _ROWS)
_add("enriched_events", lambda s, d: sync.enrich(read(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("ip")), read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_nationkey").alias("country"))).select("event_id", "country"), "SELECT event_id, c_nationkey AS country FROM events LEFT JOIN customer ON c_custkey = user_id")
