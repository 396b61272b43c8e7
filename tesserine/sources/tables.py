"""Engine inputs from star-schema tables: documents with titles, pages, and a search log.

The rules are fixed; ``LOG_SQL`` and ``DOCS_SQL`` say the same in DuckDB's SQL, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The end of every relative date range.
NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site_id, document_key, element_id, title, content, language, type, section_handle`` of table documents."""
    title = F.array_join(F.slice(F.split(F.element_at(F.split("text", "\n", -1), 1), " ", -1), 1, 8), " ")
    docs = read(spark, sf_dir, "documents").withColumn("title", title)
    return docs.select(
        F.lit(1).alias("site_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("document_key"), F.col("doc_id").alias("element_id"), "title",
        F.expr("substring(text, length(title) + 1)").alias("content"), F.col("lang").alias("language"), F.lit("entry").alias("type"), F.col("source").alias("section_handle"),
    )


DOCS_SQL = """docs AS (
  SELECT 1 AS site_id, doc_id::VARCHAR || '_1' AS document_key, doc_id AS element_id, title, substr(text, length(title) + 1) AS content, lang AS language, 'entry' AS type, source AS section_handle
  FROM (SELECT *, array_to_string(string_split(string_split(text, chr(10))[1], ' ')[1:8], ' ') AS title FROM documents)
)"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each search: see LOG_SQL for the same in SQL."""
    e = read(spark, sf_dir, "events")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("a", F.expr("event_id div 3"))
    word = F.concat_ws(" ", F.slice(F.array(*map(F.lit, "red blue green large small".split())), 1, (F.col("a") % 5 + 1).cast("int")), (F.col("a") % 7).cast("string"))
    pick = lambda column, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("date_created"), F.when(F.col("k") % 10 == 0, 0.0).otherwise(F.col("value")).alias("execution_time"), word.alias("query"), F.lower(word).alias("normalized_query"),
        F.when(F.col("a") % 2 == 0, F.concat(F.lit("s"), F.col("a").cast("string"))).alias("session_id"), pick("event_id", "A", "B", "C").alias("index_handle"), (F.col("k") % 5).alias("results_count"), (F.col("k") % 5 > 0).alias("is_hit"), (F.col("k") == 7).alias("was_redirected"),
        F.when(F.col("k") == 11, 1).otherwise(0).alias("promotions_shown"), pick("a", "frontend", "api", "cp").alias("source"), pick("user_id", "desktop", "mobile", "tablet").alias("device_type"), pick("user_id", "Chrome", "Firefox", "Safari", "Edge", "Opera").alias("browser"), pick("user_id", "Windows", "macOS", "Linux", "Android").alias("os_name"),
        F.col("user_id").cast("string").alias("ip"), F.lit(1).alias("site_id"), (F.col("k") == 13).alias("is_robot"), F.when(F.col("k") == 17, "system").when(F.col("k") == 13, "bot").otherwise("human").alias("traffic_type"), F.when(F.col("k") == 13, pick("user_id", "GoogleBot", "BingBot", "Crawler")).alias("bot_name"),
        F.when(F.col("a") % 3 == 1, (F.col("user_id") % 4)).alias("api_key_id"), F.when(F.col("a") % 3 == 1, F.concat(F.lit("key"), (F.col("user_id") % 4).cast("string"))).alias("api_key_prefix"), F.when(F.col("a") % 3 == 1, F.when(F.col("user_id") % 2 == 0, "public").otherwise("secret")).alias("api_key_type"),
        pick("user_id", None, "DE", "FR", "ES", "US", "SE", "IT").alias("country"), F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("city"), (F.col("user_id") % 13).cast("string"))).alias("city"), pick("a", "question", "product", "navigational", "informational").alias("intent"), "k",
    )


LOG_SQL = """e AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id // 3 AS a FROM events
), log AS (
  SELECT event_id AS id, ts AS date_created, CASE WHEN k % 10 = 0 THEN 0.0 ELSE value END AS execution_time, array_to_string(['red','blue','green','large','small'][1:1 + a % 5], ' ') || ' ' || (a % 7)::VARCHAR AS query, lower(array_to_string(['red','blue','green','large','small'][1:1 + a % 5], ' ') || ' ' || (a % 7)::VARCHAR) AS normalized_query,
    CASE WHEN a % 2 = 0 THEN 's' || a::VARCHAR END AS session_id, ['A','B','C'][1 + event_id % 3] AS index_handle, k % 5 AS results_count, k % 5 > 0 AS is_hit, k = 7 AS was_redirected, CASE WHEN k = 11 THEN 1 ELSE 0 END AS promotions_shown, ['frontend','api','cp'][1 + a % 3] AS source,
    ['desktop','mobile','tablet'][1 + user_id % 3] AS device_type, ['Chrome','Firefox','Safari','Edge','Opera'][1 + user_id % 5] AS browser, ['Windows','macOS','Linux','Android'][1 + user_id % 4] AS os_name, user_id::VARCHAR AS ip, 1 AS site_id, k = 13 AS is_robot, CASE WHEN k = 17 THEN 'system' WHEN k = 13 THEN 'bot' ELSE 'human' END AS traffic_type,
    CASE WHEN k = 13 THEN ['GoogleBot','BingBot','Crawler'][1 + user_id % 3] END AS bot_name, CASE WHEN a % 3 = 1 THEN user_id % 4 END AS api_key_id, CASE WHEN a % 3 = 1 THEN 'key' || (user_id % 4)::VARCHAR END AS api_key_prefix, CASE WHEN a % 3 = 1 THEN CASE WHEN user_id % 2 = 0 THEN 'public' ELSE 'secret' END END AS api_key_type,
    [NULL,'DE','FR','ES','US','SE','IT'][1 + user_id % 7] AS country, CASE WHEN user_id % 7 <> 0 THEN 'city' || (user_id % 13)::VARCHAR END AS city, ['question','product','navigational','informational'][1 + a % 4] AS intent, k
  FROM e
)"""


def rule_log(log: DataFrame) -> DataFrame:
    """``rule_id, rule_name, action_type, query, results_count, date_created``: searches that triggered a rule."""
    action = F.element_at(F.array(*[F.lit(x) for x in ("synonym", "boost", "redirect")]), (F.col("k") % 3 + 1).cast("int"))
    return log.where("k % 4 = 0").select((F.col("k") % 9).alias("rule_id"), F.concat(F.lit("rule "), (F.col("k") % 9).cast("string")).alias("rule_name"), action.alias("action_type"), "query", "results_count", "date_created", "id")


RULES_SQL = LOG_SQL + """, rules AS (
  SELECT k % 9 AS rule_id, 'rule ' || (k % 9)::VARCHAR AS rule_name, ['synonym','boost','redirect'][1 + k % 3] AS action_type, query, results_count, date_created, id FROM log WHERE k % 4 = 0
)"""


def promotion_log(log: DataFrame) -> DataFrame:
    """``promotion_id, element_id, position, query, date_created``: promotions shown."""
    return log.where("k % 6 = 1").select((F.col("k") % 5).alias("promotion_id"), (F.col("k") % 11).alias("element_id"), (F.col("k") % 3 + 1).alias("position"), "query", "date_created", "id")


PROMOTIONS_SQL = LOG_SQL + """, promotions AS (
  SELECT k % 5 AS promotion_id, k % 11 AS element_id, k % 3 + 1 AS position, query, date_created, id FROM log WHERE k % 6 = 1
)"""
