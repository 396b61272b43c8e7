"""Registered analytics queries and the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions.text import stop_words
from tesserine.operators import analytics as A
from tesserine.sources.tables import LOG_SQL, PROMOTIONS_SQL, RULES_SQL, promotion_log, rule_log, search_log

QUERIES: dict = {}
SQL: dict[str, str] = {}
_ACT = "coalesce(session_id, id::VARCHAR)"
_OUT = "max(is_hit::INT) AS hit, max(was_redirected::INT) AS redirected, max(promotions_shown) AS promoted"
_ZERO = "hit = 0 AND redirected = 0 AND promoted = 0"
WEEK, BEFORE, END = "2024-01-24 00:00:00", "2024-01-17 00:00:00", "2024-01-31 00:00:00"


def _add(name: str, run, sql: str, log: str = LOG_SQL) -> None:
    # Dates leave as text, so that both engines' results have one type.
    QUERIES[name] = (lambda spark, sf_dir: run(spark, sf_dir).withColumn("date", F.col("date").cast("string"))) if " AS date" in sql else run
    SQL[name] = f"WITH {log} {sql}"


def _on_log(f):
    return lambda spark, sf_dir: f(search_log(spark, sf_dir))


_add("top_searches", _on_log(A.top_searches), f"""SELECT query, site_id, count(*) AS count, sum(results)::BIGINT AS results, max(last) AS last_searched FROM (
  SELECT query, site_id, {_ACT} AS action, sum(results_count) AS results, max(date_created) AS last FROM log GROUP BY ALL) GROUP BY query, site_id ORDER BY count DESC, query, site_id LIMIT 10""")
_add("recent_searches", _on_log(A.recent_searches), "SELECT id, query, results_count, date_created FROM log ORDER BY date_created DESC, id DESC LIMIT 10")
_add("recent_without_results", _on_log(lambda log: A.recent_searches(log, 25, False)), "SELECT id, query, results_count, date_created FROM log WHERE NOT (is_hit OR was_redirected OR promotions_shown > 0) ORDER BY date_created DESC, id DESC LIMIT 25")
_add("search_row_count", _on_log(lambda log: A.row_count(log, True)), "SELECT count(*) AS rows FROM log WHERE is_hit OR was_redirected OR promotions_shown > 0")
_add("query_length_distribution", _on_log(A.query_lengths), f"""SELECT b.bucket, coalesce(n, 0)::BIGINT AS count FROM (VALUES ('1 word'), ('2-3 words'), ('4+ words')) b(bucket) LEFT JOIN (
  SELECT bucket, count(*) AS n FROM (SELECT DISTINCT CASE WHEN query NOT LIKE '% %' THEN '1 word' WHEN query NOT LIKE '% % % %' THEN '2-3 words' ELSE '4+ words' END AS bucket, {_ACT} AS action FROM log) GROUP BY bucket) c USING (bucket)""")
_add("word_cloud", _on_log(lambda log: A.word_cloud(log, stop_words("en"))), f"""SELECT word, sum(count)::BIGINT AS count FROM (SELECT unnest(string_split(lower(query), ' ')) AS word, count FROM (
  SELECT query, count(*) AS count FROM (SELECT DISTINCT query, {_ACT} AS action FROM log) GROUP BY query ORDER BY count DESC, query LIMIT 500)) WHERE word <> '' AND word NOT IN ({', '.join(repr(w) for w in stop_words('en'))}) GROUP BY word ORDER BY count DESC, word LIMIT 50""")
_add("zero_result_queries", _on_log(A.zero_result_queries), f"SELECT query, count(*) AS count FROM (SELECT query, {_ACT} AS action, {_OUT} FROM log GROUP BY ALL) WHERE {_ZERO} GROUP BY query ORDER BY count DESC, query LIMIT 30")
_add("zero_result_clusters", _on_log(A.zero_result_clusters), "SELECT * FROM (SELECT unnest(found, recursive := true) FROM (SELECT found FROM walk ORDER BY i DESC LIMIT 1)) ORDER BY count DESC, representative LIMIT 10")
SQL["zero_result_clusters"] = SQL["zero_result_clusters"].replace("SELECT * FROM (SELECT unnest(", f""", zero AS (
  SELECT query, count(*) AS count FROM (SELECT query, {_ACT} AS action, {_OUT} FROM log GROUP BY ALL) WHERE {_ZERO} GROUP BY query ORDER BY count DESC, query LIMIT 30
), ordered AS (
  SELECT query, count, row_number() OVER (ORDER BY count DESC, query) AS i FROM zero
), walk AS (
  SELECT 0::BIGINT AS i, []::STRUCT(representative VARCHAR, count BIGINT, queries BIGINT)[] AS found
  UNION ALL
  SELECT i, CASE WHEN home = 0 THEN list_append(found, {{'representative': query, 'count': count, 'queries': 1::BIGINT}}) ELSE list_transform(found, lambda c, j: CASE WHEN j = home THEN {{'representative': c.representative, 'count': c.count + count, 'queries': c.queries + 1}} ELSE c END) END
  FROM (SELECT o.i, o.query, o.count, w.found, coalesce(list_position(list_transform(w.found, lambda c: contains(c.representative, o.query) OR contains(o.query, c.representative) OR levenshtein(c.representative, o.query) <= 2), true), 0) AS home FROM walk w JOIN ordered o ON o.i = w.i + 1)
) SELECT * FROM (SELECT unnest(""", 1).replace("WITH ", "WITH RECURSIVE ", 1)
for _dim in ("intent", "source"):
    _add(f"{_dim}_breakdown", _on_log(lambda log, d=_dim: A.breakdown(log, d, share=True)), f"""SELECT {_dim}, count, round(count * 100.0 / sum(count) OVER (), 1) AS percentage FROM (
  SELECT {_dim}, count(*) AS count FROM (SELECT DISTINCT {_dim}, {_ACT} AS action FROM log WHERE {_dim} IS NOT NULL) GROUP BY {_dim})""")
for _dim, _n in (("device_type", None), ("browser", 10), ("os_name", None)):
    _add(f"{_dim}_breakdown", _on_log(lambda log, d=_dim, n=_n: A.breakdown(log, d, n)), f"SELECT {_dim}, count(*) AS count FROM (SELECT DISTINCT {_dim}, {_ACT} AS action FROM log WHERE {_dim} IS NOT NULL) GROUP BY {_dim} ORDER BY count DESC, {_dim} LIMIT {_n or 1000000}")
for _dim in ("country", "city"):
    _add(f"{_dim}_breakdown", _on_log(lambda log, d=_dim: A.geo(log, d, 5)), f"""SELECT {_dim}, count, round(count * 100.0 / sum(count) OVER (), 1) AS percentage FROM (
  SELECT {_dim}, count(*) AS count FROM (SELECT DISTINCT {_dim}, {_ACT} AS action FROM log WHERE {_dim} IS NOT NULL AND {_dim} <> '') GROUP BY {_dim} ORDER BY count DESC, {_dim} LIMIT 5)""")
_add("api_key_breakdown", _on_log(A.api_keys), f"""SELECT api_key_prefix, api_key_type, count, round(count * 100.0 / sum(count) OVER (), 1) AS percentage FROM (
  SELECT api_key_prefix, api_key_type, count(*) AS count FROM (SELECT DISTINCT api_key_prefix, api_key_type, {_ACT} AS action FROM log WHERE api_key_id IS NOT NULL) GROUP BY ALL)""")
_add("trending_queries", _on_log(lambda log: A.trending(log, WEEK, END, BEFORE)), f"""SELECT *, round(count * (1 + change_percent / 100), 4) AS score FROM (
  SELECT query, c.n AS count, coalesce(p.n, 0)::BIGINT AS previous, CASE WHEN coalesce(p.n, 0) = 0 THEN 'new' WHEN c.n > p.n THEN 'up' WHEN c.n < p.n THEN 'down' ELSE 'same' END AS trend, CASE WHEN coalesce(p.n, 0) = 0 THEN 100.0 ELSE round(abs(c.n - p.n) * 100.0 / p.n, 1) END AS change_percent
  FROM (SELECT query, count(DISTINCT {_ACT}) AS n FROM log WHERE date_created >= '{WEEK}' AND date_created < '{END}' GROUP BY query) c
  LEFT JOIN (SELECT query, count(DISTINCT {_ACT}) AS n FROM log WHERE date_created >= '{BEFORE}' AND date_created < '{WEEK}' GROUP BY query) p USING (query)) ORDER BY score DESC, query LIMIT 10""")
_add("unique_queries", _on_log(lambda log: A.unique_queries(A.in_range(log, WEEK, END))), f"SELECT count(DISTINCT query) AS queries FROM log WHERE date_created >= '{WEEK}' AND date_created < '{END}'")
_add("bot_stats", _on_log(A.bot_stats), f"""SELECT total, bots, systems, greatest(0, total - bots - systems) AS humans, round(bots * 100.0 / total, 1) AS bot_percentage FROM (
  SELECT count(*) AS total, sum(bot)::BIGINT AS bots, sum(sys)::BIGINT AS systems FROM (SELECT {_ACT} AS action, max(is_robot::INT) AS bot, max((traffic_type = 'system')::INT) AS sys FROM log GROUP BY 1))""")
_add("top_bots", _on_log(A.top_bots), "SELECT bot_name, count(*) AS count FROM log WHERE is_robot AND bot_name IS NOT NULL GROUP BY bot_name ORDER BY count DESC, bot_name LIMIT 10")
_add("peak_hours", _on_log(A.peak_hours), f"""SELECT hour, count, row_number() OVER (ORDER BY count DESC, hour) = 1 AS is_peak FROM (SELECT h::INT AS hour, coalesce(n, 0)::BIGINT AS count FROM range(24) r(h) LEFT JOIN (
  SELECT hour, count(*) AS n FROM (SELECT DISTINCT hour(date_created) AS hour, {_ACT} AS action FROM log) GROUP BY hour) c ON c.hour = r.h)""")
_add("performance_by_day", _on_log(A.performance_by_day), "SELECT date_created::DATE::VARCHAR AS date, round(avg(execution_time), 4) AS avg_time, min(execution_time) AS min_time, max(execution_time) AS max_time, count(*) AS searches FROM log WHERE execution_time IS NOT NULL GROUP BY 1")
_add("cache_stats", _on_log(A.cache_stats), "SELECT total, hits, total - hits AS misses, round(hits * 100.0 / total, 1) AS hit_rate FROM (SELECT count(*) AS total, count(*) FILTER (execution_time = 0) AS hits FROM log WHERE execution_time IS NOT NULL)")
_add("top_performing_queries", _on_log(lambda log: A.query_performance(log, True)), "SELECT query, round(avg(execution_time), 4) AS avg_time, count(*) AS searches FROM log WHERE execution_time > 0 AND results_count > 0 GROUP BY query HAVING count(*) >= 3 ORDER BY avg_time, query LIMIT 10")
_add("worst_performing_queries", _on_log(lambda log: A.query_performance(log, False)), "SELECT query, round(avg(execution_time), 4) AS avg_time, count(*) AS searches FROM log WHERE execution_time > 0 GROUP BY query HAVING count(*) >= 3 ORDER BY avg_time DESC, query LIMIT 10")
_add("average_time", _on_log(A.average_time), "SELECT round(avg(execution_time), 4) AS avg_time FROM log WHERE source = 'frontend'")
_add("search_summary", _on_log(A.summary), f"""SELECT searches, zero_results, (SELECT count(DISTINCT ip) FROM log) AS visitors, round(zero_results * 100.0 / searches, 1) AS zero_rate FROM (
  SELECT count(*) AS searches, count(*) FILTER ({_ZERO}) AS zero_results FROM (SELECT {_ACT} AS action, {_OUT} FROM log GROUP BY 1))""")
_add("daily_chart", _on_log(lambda log: A.daily_chart(log, WEEK, "2024-02-03 00:00:00")), f"""SELECT d::DATE::VARCHAR AS date, coalesce(total, 0)::BIGINT AS total, coalesce(with_results, 0)::BIGINT AS with_results, coalesce(zero_results, 0)::BIGINT AS zero_results FROM range(DATE '2024-01-24', DATE '2024-02-03', INTERVAL 1 DAY) r(d) LEFT JOIN (
  SELECT date, count(*) AS total, count(*) FILTER (NOT ({_ZERO})) AS with_results, count(*) FILTER ({_ZERO}) AS zero_results FROM (SELECT date_created::DATE::VARCHAR AS date, {_ACT} AS action, {_OUT} FROM log WHERE date_created >= '{WEEK}' AND date_created < '2024-02-03' GROUP BY 1, 2) GROUP BY date) c ON c.date = r.d::DATE::VARCHAR""")
_add("popular_queries", _on_log(A.popular_queries), "SELECT normalized_query, site_id, min(query) AS query, count(*) AS count FROM log GROUP BY normalized_query, site_id ORDER BY count DESC, normalized_query, site_id LIMIT 50")
_add("warm_prefixes", _on_log(lambda log: A.warm_prefixes(A.popular_queries(log))), "SELECT DISTINCT substr(query, 1, n) AS prefix FROM (SELECT min(query) AS query FROM log GROUP BY normalized_query, site_id ORDER BY count(*) DESC, normalized_query, site_id LIMIT 50), (VALUES (2), (3), (4), (5)) v(n) WHERE length(substr(query, 1, n)) >= 2")
_add("index_usage", _on_log(lambda log: A.usage_counts(log, "index_handle")), "SELECT index_handle, count(*) AS count FROM log GROUP BY index_handle")
_add("export_rows", _on_log(lambda log: A.export(log.select("id", "date_created", "query", "index_handle", "results_count", "source"), 5000)), "SELECT id, date_created, query, index_handle, results_count, source, (SELECT count(*) FROM log) > 5000 AS truncated FROM log ORDER BY date_created DESC, id DESC LIMIT 5000")
_add("export_log", _on_log(A.export), f"SELECT *, (SELECT count(*) FROM log) > {A.CAP} AS truncated FROM log ORDER BY date_created DESC, id DESC LIMIT {A.CAP}")
_add("retention", _on_log(lambda log: A.without(log, before=WEEK).select("id", "query")), f"SELECT id, query FROM log WHERE date_created >= '{WEEK}'")

_rules = lambda f: lambda spark, sf_dir: f(rule_log(search_log(spark, sf_dir)))
_shown = lambda f: lambda spark, sf_dir: f(promotion_log(search_log(spark, sf_dir)))
_add("top_rules", _rules(A.top_rules), "SELECT rule_id, rule_name, count(*) AS count, round(avg(results_count), 4) AS avg_results FROM rules GROUP BY ALL ORDER BY count DESC, rule_id LIMIT 10", RULES_SQL)
_add("rules_by_action", _rules(A.rules_by_action), "SELECT action_type, count(*) AS count, count(DISTINCT rule_id) AS rules FROM rules GROUP BY action_type", RULES_SQL)
_add("rule_queries", _rules(A.rule_queries), "SELECT query, count(*) AS count, count(DISTINCT rule_id) AS rules FROM rules GROUP BY query ORDER BY count DESC, query LIMIT 10", RULES_SQL)
_add("rule_totals", _rules(lambda r: A.rule_detail(r, 3)["totals"]), "SELECT count(*) AS count, count(DISTINCT query) AS queries, round(avg(results_count), 4) AS avg_results FROM rules WHERE rule_id = 3", RULES_SQL)
_add("rule_top_queries", _rules(lambda r: A.rule_detail(r, 3)["top_queries"]), "SELECT query, count(*) AS count FROM rules WHERE rule_id = 3 GROUP BY query ORDER BY count DESC, query LIMIT 10", RULES_SQL)
_add("rule_daily", _rules(lambda r: A.rule_detail(r, 3)["daily"]), "SELECT date_created::DATE::VARCHAR AS date, count(*) AS count FROM rules WHERE rule_id = 3 GROUP BY 1", RULES_SQL)
_add("rule_recent", _rules(lambda r: A.rule_detail(r, 3)["recent"]), "SELECT id, query, date_created FROM rules WHERE rule_id = 3 ORDER BY date_created DESC, id DESC LIMIT 20", RULES_SQL)
_add("top_promotions", _shown(A.top_promotions), "SELECT promotion_id, count(*) AS impressions, count(DISTINCT query) AS queries FROM promotions GROUP BY promotion_id ORDER BY impressions DESC, promotion_id LIMIT 10", PROMOTIONS_SQL)
_add("promotions_by_position", _shown(A.promotions_by_position), "SELECT position, count(*) AS impressions, count(DISTINCT promotion_id) AS promotions FROM promotions GROUP BY position", PROMOTIONS_SQL)
_add("promotion_queries", _shown(A.promotion_queries), "SELECT query, count(*) AS impressions, count(DISTINCT promotion_id) AS promotions FROM promotions GROUP BY query ORDER BY impressions DESC, query LIMIT 10", PROMOTIONS_SQL)
_add("promotion_totals", _shown(lambda p: A.promotion_detail(p, 2)["totals"]), "SELECT count(*) AS impressions, count(DISTINCT query) AS queries, round(avg(position), 4) AS avg_position FROM promotions WHERE promotion_id = 2", PROMOTIONS_SQL)
_add("promotion_daily", _shown(lambda p: A.promotion_detail(p, 2)["daily"]), "SELECT date_created::DATE::VARCHAR AS date, count(*) AS impressions FROM promotions WHERE promotion_id = 2 GROUP BY 1", PROMOTIONS_SQL)
_add("intent_classes", lambda spark, sf_dir: _intents(spark, sf_dir), """SELECT intent, count(*) AS count FROM (SELECT CASE WHEN regexp_matches(q, '^(what|how|why|when|where|who|which|can|does|is|are|do|will|should)\\b|\\?$') THEN 'question' WHEN regexp_matches(q, '\\b(buy|price|cost|cheap|discount|sale|order|shop|store|deal|review|compare|best|top|vs|versus|shipping|delivery|return|warranty)\\b|\\$[0-9]+') THEN 'product'
  WHEN regexp_matches(q, '\\b(login|signin|sign in|account|dashboard|contact|about|home|page)\\b|\\b(\\.com|\\.org|\\.net|\\.io)\\b') THEN 'navigational' ELSE 'informational' END AS intent FROM (SELECT lower(trim(query)) AS q FROM log)) GROUP BY intent""")


def _intents(spark, sf_dir):
    from tesserine.functions.text import intent

    return search_log(spark, sf_dir).groupBy(intent(F.col("query")).alias("intent")).agg(F.count("*").alias("count"))
