"""Registered queries of the public side, of tracking and of the change buffer's management, and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import highlight
from tesserine.operators import interface as E
from tesserine.operators import retrieval as R
from tesserine.plans.searches import _PARTS_SQL, _PLAIN, _W, INDEX_SQL, STOP, A, _plain_sql, _without_sql, index
from tesserine.plans.upkeep import _NOW, _ROWS, _rows
from tesserine.sources.tables import DOCS_SQL, documents, read
from tesserine.streaming import sync

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str, ctes: str = "") -> None:
    QUERIES[name], SQL[name] = run, f"WITH {ctes} {sql}" if ctes else sql


# -- what an index takes -----------------------------------------------------------------------
def _elements(s: SparkSession, d: str) -> DataFrame:
    """Documents as elements: German ones are products, short ones have no address, Spanish ones of the web are drafts."""
    docs = documents(s, d)
    kind = F.when(F.col("language") == "de", "product").otherwise("entry")
    url = F.when(F.length("content") > 300, F.concat(F.lit("/d/"), F.col("element_id").cast("string")))
    return docs.withColumns({"type": kind, "url": url, "is_draft": (F.col("language") == "es") & (F.col("section_handle") == "src0")})


_ELEMENTS_SQL = DOCS_SQL.replace("docs AS (", "one AS (", 1) + """, elements AS (
  SELECT * REPLACE (CASE WHEN language = 'de' THEN 'product' ELSE 'entry' END AS type), CASE WHEN length(content) > 300 THEN '/d/' || element_id::VARCHAR END AS url, coalesce(language = 'es' AND section_handle = 'src0', false) AS is_draft FROM one
)"""
_SOURCES = [
    E.Source("entries", "entry", (1,), criteria={"section_handle": ["src0", "src1", "src2"]}, skip_without_url=True),
    E.Source("products", "product", criteria=lambda rows: rows.where(F.length("title") > 20)),
    E.Source("elsewhere", "entry", (2,)),
    E.Source("off", "entry", enabled=False),
]
_add("index_sources", lambda s, d: _tagged(_elements(s, d)), "SELECT 'entries' AS index_handle, element_id FROM elements WHERE type = 'entry' AND NOT is_draft AND section_handle IN ('src0', 'src1', 'src2') AND url IS NOT NULL UNION ALL SELECT 'products', element_id FROM elements WHERE type = 'product' AND NOT is_draft AND length(title) > 20", _ELEMENTS_SQL)


def _tagged(elements: DataFrame) -> DataFrame:
    out = None
    for of in _SOURCES:
        own = E.source_rows(elements, of).select(F.lit(of.handle).alias("index_handle"), "element_id")
        out = own if out is None else out.unionByName(own)
    return out


_LANGUAGES = [E.Source(code, criteria={"language": [code]}) for code in ("en", "fr", "de", "es")]


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    out = None
    for handle, built in E.rebuild(documents(s, d), _LANGUAGES, STOP).items():
        own = built.corpus_stats.select(F.lit(handle).alias("index_handle"), "site_id", "n_docs", "total_len")
        out = own if out is None else out.unionByName(own)
    return out


_add("rebuilt_indices", _rebuilt, "SELECT language AS index_handle, site_id, count(*) AS n_docs, greatest(sum(doc_len), 1)::BIGINT AS total_len FROM doc_stats WHERE language IN ('en', 'fr', 'de', 'es') GROUP BY ALL", INDEX_SQL)


def _transformed(s: SparkSession, d: str) -> DataFrame:
    makers = E.Transformers(E.automatic)
    makers.register("product", lambda rows: rows.select(F.concat(F.lit("p"), F.col("element_id").cast("string")).alias("document_key"), F.upper("url").alias("content"), F.lit("").alias("excerpt")))
    pages = read(s, d, "pages").select(F.col("page_id").alias("element_id"), F.lit(1).alias("site_id"), F.when(F.col("url").contains(".org"), "product").otherwise("entry").alias("type"), "url", "html")
    return makers.apply(pages).select("document_key", "content", "excerpt")


_CLEAN = _plain_sql(_without_sql("html", "script", "style", *[f"h{i}" for i in range(1, 7)], "pre"))
_add("transformed_documents", _transformed, f"SELECT page_id::VARCHAR || '_1' AS document_key, {_CLEAN} AS content, (SELECT CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END FROM (SELECT {_plain_sql('html')} AS t)) AS excerpt FROM pages WHERE NOT contains(url, '.org') UNION ALL SELECT 'p' || page_id::VARCHAR, upper(url), '' FROM pages WHERE contains(url, '.org')")

# -- one call over several indices -----------------------------------------------------------------
_ROMANCE = "cion"


def _engine(s: SparkSession, d: str, **more) -> E.Engine:
    """English documents in one index, all others in another."""
    return E.Engine(E.rebuild(documents(s, d), [E.Source("english", criteria={"language": ["en"]}), E.Source("other", criteria=lambda rows: rows.where("language <> 'en'"))], STOP), STOP, _PLAIN, **more)


def _part(handle: str, where: str, terms: str = f"'{A}', '{_ROMANCE}'") -> str:
    ctes = INDEX_SQL.replace("docs AS (", "one AS (", 1).replace(", full_docs AS (", f", docs AS (SELECT * FROM one WHERE {where}), full_docs AS (", 1)
    return f"SELECT * FROM (WITH {ctes} SELECT '{handle}' AS index_handle, 1 AS site_id, document_key, round(sum(base * {_W}), 6) AS score FROM scored WHERE term IN ({terms}) GROUP BY document_key)"


_BOTH = f"({_part('english', chr(39).join(('language = ', 'en', '')))} UNION ALL {_part('other', chr(39).join(('language <> ', 'en', '')))})"
_ORDER = "ORDER BY score DESC, index_handle, document_key"
_add("public_search", lambda s, d: _engine(s, d).search(f"{A} OR {_ROMANCE}", "english, other,english", 30, 1), f"SELECT * FROM {_BOTH} {_ORDER} LIMIT 30 OFFSET 30")
_add("public_search_defaults", lambda s, d: _engine(s, d).search(f"{A} OR {_ROMANCE}"), f"SELECT * FROM {_BOTH} {_ORDER} LIMIT 20")
_add("public_search_with_key", lambda s, d: _engine(s, d).search(f"{A} OR {_ROMANCE}", limit=500, key=E.Key(("other", "gone"), most_hits=7)), f"SELECT * FROM {_BOTH} WHERE index_handle = 'other' {_ORDER} LIMIT 7")
_add("public_search_hooks", lambda s, d: _engine(s, d, before=[lambda r: r | {"query": A}], after=[lambda hits: hits.withColumn("score", F.round(F.col("score") * 2, 6)), lambda hits: hits.where("score > 1")]).search("anything", limit=50),
     f"SELECT * REPLACE (round(score * 2, 6) AS score) FROM ({_part('english', chr(39).join(('language = ', 'en', '')), repr(A))} UNION ALL {_part('other', chr(39).join(('language <> ', 'en', '')), repr(A))}) WHERE round(score * 2, 6) > 1 ORDER BY score DESC, index_handle, document_key LIMIT 50")
_add("public_results", lambda s, d: E.Engine({"all": index(s, d), "english": _engine(s, d).indices["english"]}, STOP).results("th", "english,all", 15), """SELECT element_id, title, type FROM (
  SELECT *, row_number() OVER (PARTITION BY element_id, type ORDER BY place, r) AS n FROM (
    SELECT element_id, title, type, 0 AS place, row_number() OVER (ORDER BY title, element_id) AS r FROM docs WHERE language = 'en' AND starts_with(lower(title), 'th')
    UNION ALL SELECT element_id, title, type, 1, row_number() OVER (ORDER BY title, element_id) FROM docs WHERE starts_with(lower(title), 'th')
  ) WHERE r <= 15) WHERE n = 1""", DOCS_SQL)

_covering = lambda s: s.createDataFrame([("entry", None, True, False)], "type string, site_id int, enabled boolean, restricted boolean")
_native = lambda s, d, kind: E.native_search(index(s, d), A, s.createDataFrame([(kind, 1)], "type string, site_id int"), _covering(s), lambda q: documents(s, d).where(F.lower("title").contains(q)).select(F.concat_ws("-", F.col("element_id").cast("string"), F.lit("1")).alias("element_key"), F.lit(1.0).alias("score")), STOP, _PLAIN)
_add("native_search", lambda s, d: _native(s, d, "entry"), f"SELECT replace(document_key, '_', '-') AS element_key, round(sum(base * {_W}), 6) AS score FROM scored WHERE term = '{A}' GROUP BY document_key", INDEX_SQL)
_add("native_search_fallback", lambda s, d: _native(s, d, "product"), f"SELECT element_id::VARCHAR || '-1' AS element_key, 1.0::DOUBLE AS score FROM docs WHERE contains(lower(title), '{A}')", DOCS_SQL)
_add("usages", lambda s, d: E.usages(read(s, d, "orders").join(read(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").cast("string").alias("name")).agg(F.collect_set(F.col("l_returnflag")).alias("references")), "R"),
     "SELECT DISTINCT o_orderstatus AS kind, o_orderkey::VARCHAR AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")

# -- requests and tracking --------------------------------------------------------------------------
_add("accepted_requests", lambda s, d: E.accepted(read(s, d, "events").select((F.col("user_id") % 4).alias("key"), "ts", F.col("event_id").alias("id")), 1).select("key", "id"), "SELECT key, id FROM (SELECT user_id % 4 AS key, event_id AS id, row_number() OVER (PARTITION BY user_id % 4, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1")
_HANDLES = ["", "A", "A, B", "X,A", "X", "A,B,C,D,E,F"]
_TRIGGERS = ["click", "scroll", "idle"]
_pick = lambda column, values: F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _requests(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(
        F.col("event_id").alias("id"), _pick("event_id", ["red", " ", "0", "x" * 300, "blue shoes"]).alias("q"), _pick("user_id", _HANDLES).alias("index_handles"), (F.col("user_id") * 20 - 100).cast("int").alias("results_count"),
        _pick("event_id", _TRIGGERS).alias("trigger"), _pick("user_id", ["mobile nav!", "", "app"]).alias("source"), _pick("event_id", ["1", "false", "perhaps", "no"]).alias("cached"), F.when(F.col("value") < 60, F.col("value").cast("string")).otherwise("soon").alias("took"),
    )


_add("tracked_searches", lambda s, d: E.tracked_searches(_requests(s, d), ["A", "B"]), f"""SELECT id, substr(q, 1, 256) AS query, unnest(CASE WHEN h = '' THEN ['all'] WHEN h = 'A, B' THEN ['A', 'B'] ELSE ['A'] END) AS index_handle, greatest(0, least(1000, user_id * 20 - 100))::INT AS results_count,
  CASE WHEN trigger = 'scroll' THEN 'unknown' ELSE trigger END AS trigger, ['mobilenav', 'frontend-widget', 'app'][1 + user_id % 3] AS source, CASE WHEN cached = '1' THEN 0.0::DOUBLE WHEN cached IN ('false', 'no') AND value < 60 THEN value END AS execution_time, CASE WHEN h = 'A, B' THEN 'r' || id::VARCHAR END AS session_id
  FROM (SELECT event_id AS id, user_id, value, ['red', ' ', '0', repeat('x', 300), 'blue shoes'][1 + event_id % 5] AS q, {_list(_HANDLES)}[1 + user_id % 6] AS h, {_list(_TRIGGERS)}[1 + event_id % 3] AS trigger, ['1', 'false', 'perhaps', 'no'][1 + event_id % 4] AS cached FROM events)
  WHERE trim(q) NOT IN ('', '0') AND h IN ('', 'A', 'A, B', 'X,A')""")
_add("tracked_clicks", lambda s, d: E.tracked_clicks(read(s, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "x").otherwise((F.col("user_id") - 5).cast("string")).alias("element_id"), F.col("event_type").alias("query"), _pick("user_id", ["A", "Z"]).alias("index_handle"), (F.col("event_id") - 20).cast("string").alias("position")), ["A"]),
     "SELECT event_id AS id, user_id - 5 AS element_id, event_type AS query, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE '' END AS index_handle, CASE WHEN event_id BETWEEN 20 AND 1020 THEN event_id - 20 END AS position FROM events WHERE event_id % 7 <> 0 AND user_id > 5")
_IPS = ["10.0.0.", "172.20.1.", "8.8.8.", "192.168.0.", "172.40.1.", "300.1.1."]
_ip = lambda c: F.concat(_pick(c, _IPS), (F.col(c) % 200).cast("string"))
_add("located_events", lambda s, d: E.located(read(s, d, "events").select("event_id", _ip("user_id").alias("ip")), read(s, d, "customer").groupBy(_ip("c_custkey").alias("ip")).agg(F.min("c_nationkey").cast("string").alias("country"), F.min("c_name").alias("city")), {"country": "XX", "city": "home"}),
     f"SELECT event_id, ip, CASE WHEN user_id % 6 IN (2, 4) THEN country ELSE 'XX' END AS country, CASE WHEN user_id % 6 IN (2, 4) THEN city ELSE 'home' END AS city FROM (SELECT *, {_list(_IPS)}[1 + user_id % 6] || (user_id % 200)::VARCHAR AS ip FROM events) LEFT JOIN (SELECT {_list(_IPS)}[1 + c_custkey % 6] || (c_custkey % 200)::VARCHAR AS ip, min(c_nationkey)::VARCHAR AS country, min(c_name) AS city FROM customer GROUP BY 1) USING (ip)")
_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 Edg/120.0", "desktop", "Edge", "Windows", None),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1", "mobile", "Safari", "iOS", None),
    ("Mozilla/5.0 (Linux; Android 13; SM-X900) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0 Safari/537.36", "tablet", "Chrome", "Android", None),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0", "desktop", "Firefox", "Linux", None),
    ("Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "desktop", None, None, "Googlebot"),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36 OPR/105.0", "desktop", "Opera", "macOS", None),
]
_q = lambda v: "NULL" if v is None else f"'{v}'"
_add("device_details", lambda s, d: read(s, d, "events").select(E.device(_pick("user_id", [a[0] for a in _AGENTS])).alias("v")).select("v.*").groupBy("device_type", "browser", "os_name", "is_robot", "bot_name").agg(F.count("*").alias("n")),
     f"SELECT device_type, browser, os_name, bot_name IS NOT NULL AS is_robot, bot_name, count(*) AS n FROM events JOIN (VALUES {', '.join(f'({i}, {_q(a[1])}, {_q(a[2])}, {_q(a[3])}, {_q(a[4])})' for i, a in enumerate(_AGENTS))}) v(i, device_type, browser, os_name, bot_name) ON user_id % 6 = i GROUP BY ALL")

# -- likeness of pairs ------------------------------------------------------------------------------
_grams = lambda c: f"list_distinct(list_filter([substr(' ' || {c} || ' ', i, 2) FOR i IN range(1, length({c}) + 2)] || [substr(' ' || {c} || ' ', i, 3) FOR i IN range(1, length({c}) + 1)], lambda g: trim(g) <> ''))"
_add("similar_pairs", lambda s, d: R.similar(read(s, d, "part").select(F.substring("p_name", 1, 4).alias("query"), F.element_at(F.split("p_name", " "), 1).alias("term")).distinct()).select("query", "term", F.round("similarity", 6).alias("similarity"), "similar"),
     f"SELECT query, term, round(similarity, 6) AS similarity, similarity >= CASE WHEN length(query) <= 2 THEN 0.1 WHEN length(query) = 3 THEN 0.15 WHEN length(query) = 4 THEN 0.2 ELSE 0.25 END AS similar FROM (SELECT query, term, len(list_intersect({_grams('query')}, {_grams('term')}))::DOUBLE / len(list_distinct({_grams('query')} || {_grams('term')})) AS similarity FROM (SELECT DISTINCT substr(p_name, 1, 4) AS query, string_split(p_name, ' ')[1] AS term FROM part))")

# -- upkeep of the change buffer -----------------------------------------------------------------------
_add("removed_changes", lambda s, d: sync.removed(_rows(s, d), list(range(3000)), F.expr(_NOW)).select("element_id"), f"SELECT element_id FROM rows WHERE element_id >= 3000 OR status = 'processing' AND NOT claimed_at < {_NOW} - INTERVAL 3600 SECOND", _ROWS)
_add("purged_status", lambda s, d: sync.purge_status(_rows(s, d), "failed").groupBy("status").agg(F.count("*").alias("n")), "SELECT status, count(*) AS n FROM rows WHERE status <> 'failed' GROUP BY status", _ROWS)
_add("stuck_changes", lambda s, d: sync.buffer_search(_rows(s, d), sort="attempt_count", descending=True, limit=60, stuck_at=F.expr(_NOW)).select("element_id", "attempt_count"), f"SELECT element_id, attempt_count FROM rows WHERE status IN ('pending', 'failed') AND next_attempt_at <= {_NOW} OR status = 'processing' AND claimed_at < {_NOW} - INTERVAL 3600 SECOND ORDER BY attempt_count DESC, index_handle, element_id, site_id LIMIT 60", _ROWS)
_add("changes_by_id", lambda s, d: sync.buffer_search(_rows(s, d), text="17").select("element_id"), "SELECT element_id FROM rows WHERE contains(last_error, '17') OR element_id = 17 ORDER BY queued_at LIMIT 50", _ROWS)
_add("retried_claims", lambda s, d: sync.retry(_rows(s, d), list(range(500)), F.expr(_NOW)).select("element_id", "claim_token", F.unix_micros(F.col("next_attempt_at").cast("timestamp")).alias("due"), F.unix_micros(F.col("claimed_at").cast("timestamp")).alias("claimed"), "last_error"), f"SELECT element_id, CASE WHEN NOT again THEN claim_token END AS claim_token, epoch_us(CASE WHEN again THEN {_NOW} ELSE next_attempt_at END) AS due, epoch_us(CASE WHEN NOT again THEN claimed_at END) AS claimed, CASE WHEN NOT again THEN last_error END AS last_error FROM (SELECT *, element_id < 500 AND status IN ('failed', 'abandoned') AS again FROM rows)", _ROWS)
_add("touched_indices", lambda s, d: E.touched(_rows(s, d).select(F.col("status").alias("handle"), F.col("next_attempt_at").alias("last_indexed")), "failed", F.expr(_NOW)).select("handle", F.unix_micros(F.col("last_indexed").cast("timestamp")).alias("at")), f"SELECT status AS handle, epoch_us(CASE WHEN status = 'failed' AND (next_attempt_at IS NULL OR next_attempt_at < {_NOW} - INTERVAL 60 SECOND) THEN {_NOW} ELSE next_attempt_at END) AS at FROM rows", _ROWS)

# -- snippets -------------------------------------------------------------------------------------------
_SNIPPET_SQL = DOCS_SQL + f""", found AS (
  SELECT document_key, content AS t, length(content) AS n, length(regexp_extract(strip_accents(lower(content)), '(?s)^((?:.*?[^\\p{{L}}\\p{{N}}])??){A}(?:[^\\p{{L}}\\p{{N}}]|$)', 1)) AS p
  FROM docs WHERE regexp_matches(strip_accents(lower(content)), '(?:^|[^\\p{{L}}\\p{{N}}]){A}(?:[^\\p{{L}}\\p{{N}}]|$)')
), led AS (
  SELECT *, greatest(0, p - 40) AS a, instr(substr(t, greatest(0, p - 40) + 1, 30), ' ') AS gap FROM found
), begun AS (
  SELECT *, CASE WHEN a > 0 AND NOT regexp_matches(substr(t, a, 1), '\\s') AND gap > 0 THEN a + gap ELSE a END AS b FROM led
), cut AS (
  SELECT *, least(n, b + 150) AS e, instr(reverse(substr(t, b + 1, 150)), ' ') AS back FROM begun
), ended AS (
  SELECT *, CASE WHEN e < n AND back > 0 AND e - back > b + 75 THEN e - back ELSE e END AS z FROM cut
)"""
_add("hit_snippets", lambda s, d: documents(s, d).select("document_key", highlight.hit_snippet(F.col("content"), [A]).alias("snippet")).where("snippet is not null"), "SELECT document_key, CASE WHEN b > 0 THEN '...' ELSE '' END || trim(substr(t, b + 1, z - b), ' ' || chr(10) || chr(9)) || CASE WHEN z < n THEN '...' ELSE '' END AS snippet FROM ended", _SNIPPET_SQL)
_WORD = "[^\\p{L}\\p{N}]"
_ESCAPED = "regexp_replace(coalesce(title, ''), '<[^>]*>', '', 'g')"
for _sign, _entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
    _ESCAPED = f"replace({_ESCAPED}, '{_sign}', '{_entity}')"
# A sign after each separator lets two words that share one be found both.
_add("title_highlights", lambda s, d: documents(s, d).select("document_key", highlight.highlight(F.col("title"), [A], css="hit <b> x-1").alias("title")),
     f"SELECT document_key, replace(regexp_replace(regexp_replace({_ESCAPED}, '({_WORD})', '\\1' || chr(1), 'g'), '(^|{_WORD})(t[iíìîï][oóòôö][nñ])({_WORD}|$)', '\\1<mark class=\"hit x-1\">\\2</mark>\\3', 'gi'), chr(1), '') AS title FROM docs", DOCS_SQL)
# Windows of 200 characters around the first match and around each next one that no earlier window covers.
_SNIPPETS_SQL = DOCS_SQL + f""", parts AS (
  SELECT document_key, content AS t, length(content) AS n, unnest(string_split(strip_accents(lower(content)), '{A}')) AS part, generate_subscripts(string_split(strip_accents(lower(content)), '{A}'), 1) AS k FROM docs WHERE contains(strip_accents(lower(content)), '{A}')
), placed AS (
  SELECT *, sum(length(part)) OVER w + {len(A)} * (k - 1) AS p, lead(part) OVER w AS next, max(k) OVER (PARTITION BY document_key) AS last FROM parts WINDOW w AS (PARTITION BY document_key ORDER BY k)
), found AS (
  SELECT document_key, t, n, p::BIGINT AS p FROM placed WHERE k < last AND CASE WHEN part = '' THEN k = 1 ELSE regexp_matches(right(part, 1), '{_WORD}') END AND CASE WHEN next = '' THEN k + 1 = last ELSE regexp_matches(left(next, 1), '{_WORD}') END
), led AS (
  SELECT *, greatest(0, p - {(200 - len(A)) // 2}) AS a FROM found
), begun AS (
  SELECT *, CASE WHEN a > 0 AND NOT regexp_matches(substr(t, a, 1), '\\s') AND instr(substr(t, a + 1, 30), ' ') > 0 THEN a + instr(substr(t, a + 1, 30), ' ') ELSE a END AS b FROM led
), cut AS (
  SELECT *, least(n, b + 200) AS e, instr(reverse(substr(t, b + 1, 200)), ' ') AS back FROM begun
), ended AS (
  SELECT *, CASE WHEN e < n AND back > 0 AND e - back > b + 100 THEN e - back ELSE e END AS z FROM cut
), one AS (
  SELECT document_key, min(p) AS p, arg_min(z, p) AS z FROM ended GROUP BY document_key
), two AS (
  SELECT document_key, min(x.p) AS p, arg_min(x.z, x.p) AS z FROM ended x JOIN one y USING (document_key) WHERE x.p >= y.z GROUP BY document_key
), three AS (
  SELECT document_key, min(x.p) AS p FROM ended x JOIN two y USING (document_key) WHERE x.p >= y.z GROUP BY document_key
), chosen AS (
  SELECT document_key, p FROM one UNION ALL SELECT document_key, p FROM two UNION ALL SELECT document_key, p FROM three
)"""
_add("content_snippets", lambda s, d: documents(s, d).select("document_key", highlight.snippets(F.col("content"), [A]).alias("s")).where("size(s) > 0").select("document_key", F.array_join("s", " | ").alias("snippets")),
     "SELECT document_key, string_agg(CASE WHEN b > 0 THEN '...' ELSE '' END || trim(substr(t, b + 1, z - b), ' ' || chr(10) || chr(9)) || CASE WHEN z < n THEN '...' ELSE '' END, ' | ' ORDER BY p) AS snippets FROM ended JOIN chosen USING (document_key, p) GROUP BY document_key", _SNIPPETS_SQL)
_add("heading_snippets", lambda s, d: _heading_snippets(s, d), f"SELECT page_id, title, CASE WHEN length(t) > 150 THEN substr(t, 1, 150) ELSE t END AS snippet FROM (SELECT page_id, title, ltrim(substr(body, length(title) + 2)) AS t FROM (SELECT page_id, title, title || ' ' || {_plain_sql(_without_sql('after', 'script', 'style', 'pre'))} AS body FROM named))", _PARTS_SQL)


def _heading_snippets(s: SparkSession, d: str) -> DataFrame:
    """Of every page the heading and what stands under it."""
    from tesserine.functions import content

    pages = content.split_sections(read(s, d, "pages").select("page_id", F.col("page_id").cast("string").alias("document_key"), "url", "html"), "html", (1,)).where("section_index = 0")
    body = F.concat_ws(" ", "section_title", "content")
    return pages.select("page_id", F.explode(highlight.heading_parts(body, F.array("section_title"), ["_"], True)).alias("h")).select("page_id", "h.title", "h.snippet")
