"""Reports over a search log. An action is one search of a user, whatever rows it fans out to.

Every report takes the log as a DataFrame, reduces it to actions with one partially
aggregated shuffle on (dimension, action), and returns a lazy DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def action() -> Column:
    """A search's session, or the row itself where it has none."""
    return F.coalesce("session_id", F.col("id").cast("string"))


def in_range(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Half-open range of the date; pushed down to the scan."""
    out = log
    if start:
        out = out.where(F.col("date_created") >= F.lit(start).cast(log.schema["date_created"].dataType))
    if end:
        out = out.where(F.col("date_created") < F.lit(end).cast(log.schema["date_created"].dataType))
    return out


def local_date(zone: str | None = None) -> Column:
    return F.to_date(F.col("date_created") if not zone else F.from_utc_timestamp("date_created", zone))


def actions(log: DataFrame, *dims: str | Column, **aggregates: Column) -> DataFrame:
    """One row for each combination of dims and action."""
    named = [F.count("*").alias("rows")] if not aggregates else [v.alias(k) for k, v in aggregates.items()]
    return log.groupBy(*dims, action().alias("action")).agg(*named)


def _outcomes() -> dict[str, Column]:
    return {"hit": F.max(F.col("is_hit").cast("int")), "redirected": F.max(F.col("was_redirected").cast("int")), "promoted": F.max("promotions_shown")}


def _zero() -> Column:
    return (F.col("hit") == 0) & (F.col("redirected") == 0) & (F.col("promoted") == 0)


def _share(df: DataFrame, count: str = "count") -> DataFrame:
    """With the percentage of the total; the total is one small aggregated row a group, never the log."""
    return df.withColumn("percentage", F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()), 1))


def top_searches(log: DataFrame, n: int = 10) -> DataFrame:
    each = actions(log, "query", "site_id", results=F.sum("results_count"), last=F.max("date_created"))
    out = each.groupBy("query", "site_id").agg(F.count("*").alias("count"), F.sum("results").alias("results"), F.max("last").alias("last_searched"))
    return out.orderBy(F.desc("count"), "query", "site_id").limit(n)


def recent_searches(log: DataFrame, n: int = 10, has_results: bool | None = None) -> DataFrame:
    out = log if has_results is None else log.where(_success() if has_results else ~_success())
    return out.select("id", "query", "results_count", "date_created").orderBy(F.desc("date_created"), F.desc("id")).limit(n)


def _success() -> Column:
    return F.col("is_hit") | F.col("was_redirected") | (F.col("promotions_shown") > 0)


def row_count(log: DataFrame, has_results: bool | None = None) -> DataFrame:
    return (log if has_results is None else log.where(_success() if has_results else ~_success())).agg(F.count("*").alias("rows"))


def query_lengths(log: DataFrame) -> DataFrame:
    bucket = F.when(~F.col("query").contains(" "), "1 word").when(~F.col("query").like("% % % %"), "2-3 words").otherwise("4+ words")
    counted = actions(log.withColumn("bucket", bucket), "bucket").groupBy("bucket").agg(F.count("*").alias("count"))
    every = log.sparkSession.createDataFrame([("1 word",), ("2-3 words",), ("4+ words",)], "bucket string")
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def word_cloud(log: DataFrame, stop: list[str], n: int = 50, queries: int = 500) -> DataFrame:
    top = actions(log, "query").groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(queries)
    words = top.select(F.explode(F.split(F.lower("query"), " ")).alias("word"), "count").where(F.col("word") != "")
    words = words.where(~F.col("word").isin(stop)) if stop else words
    return words.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(n)


def zero_result_queries(log: DataFrame, n: int = 30) -> DataFrame:
    zero = actions(log, "query", **_outcomes()).where(_zero())
    return zero.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(n)


def zero_result_clusters(log: DataFrame, n: int = 10) -> DataFrame:
    """Greedy clusters of the 3n commonest queries without outcome: a query joins the first cluster whose representative contains it, is contained, or is within two byte edits."""
    import pandas as pd

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["count", "query"], ascending=[False, True])
        found: list[list] = []
        for query, count in zip(rows["query"], rows["count"], strict=True):
            home = next((c for c in found if query in c[0] or c[0] in query or _byte_edits(query, c[0]) <= 2), None)
            if home is None:
                found.append([query, int(count), 1])
            else:
                home[1] += int(count)
                home[2] += 1
        found.sort(key=lambda c: (-c[1], c[0]))
        return pd.DataFrame(found[:n], columns=["representative", "count", "queries"])

    return zero_result_queries(log, 3 * n).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda rows: cluster(rows), "representative string, count long, queries long")


def _byte_edits(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != q))
    return row[-1]


def breakdown(log: DataFrame, dim: str, n: int | None = None, share: bool = False) -> DataFrame:
    """Actions by a dimension, nulls left out: intent, device, browser, system, source."""
    out = actions(log.where(F.col(dim).isNotNull()), dim).groupBy(dim).agg(F.count("*").alias("count"))
    if n:
        out = out.orderBy(F.desc("count"), dim).limit(n)
    return _share(out) if share else out


def geo(log: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """Countries or cities: shares of the total of the first n."""
    return _share(actions(log.where(F.col(dim).isNotNull() & (F.col(dim) != "")), dim).groupBy(dim).agg(F.count("*").alias("count")).orderBy(F.desc("count"), dim).limit(n))


def api_keys(log: DataFrame) -> DataFrame:
    used = log.where("api_key_id is not null")
    return _share(actions(used, "api_key_prefix", "api_key_type").groupBy("api_key_prefix", "api_key_type").agg(F.count("*").alias("count")))


def trending(log: DataFrame, start: str, end: str, before: str, n: int = 10) -> DataFrame:
    """Queries of [start, end) against [before, start); a falling query ranks by the size of its change too."""
    counted = lambda a, b, name: actions(in_range(log, a, b), "query").groupBy("query").agg(F.count("*").alias(name))
    both = counted(start, end, "count").join(counted(before, start, "previous"), "query", "left").withColumn("previous", F.coalesce("previous", F.lit(0)).cast("long"))
    change = F.when(F.col("previous") == 0, 100.0).otherwise(F.round(F.abs(F.col("count") - F.col("previous")) * 100.0 / F.col("previous"), 1))
    trend = F.when(F.col("previous") == 0, "new").when(F.col("count") > F.col("previous"), "up").when(F.col("count") < F.col("previous"), "down").otherwise("same")
    out = both.withColumn("trend", trend).withColumn("change_percent", change).withColumn("score", F.round(F.col("count") * (1 + F.col("change_percent") / 100), 4))
    return out.orderBy(F.desc("score"), "query").limit(n)


def unique_queries(log: DataFrame) -> DataFrame:
    return log.agg(F.countDistinct("query").alias("queries"))


def bot_stats(log: DataFrame) -> DataFrame:
    each = actions(log, bot=F.max(F.col("is_robot").cast("int")), system=F.max((F.col("traffic_type") == "system").cast("int")))
    total = each.agg(F.count("*").alias("total"), F.coalesce(F.sum("bot"), F.lit(0)).alias("bots"), F.coalesce(F.sum("system"), F.lit(0)).alias("systems"))
    out = total.withColumn("humans", F.greatest(F.lit(0), F.col("total") - F.col("bots") - F.col("systems")))
    return out.withColumn("bot_percentage", F.when(F.col("total") > 0, F.round(F.col("bots") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def top_bots(log: DataFrame, n: int = 10) -> DataFrame:
    return log.where("is_robot and bot_name is not null").groupBy("bot_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "bot_name").limit(n)


def peak_hours(log: DataFrame, zone: str | None = None) -> DataFrame:
    at = F.hour(F.col("date_created") if not zone else F.from_utc_timestamp("date_created", zone))
    counted = actions(log, at.alias("hour")).groupBy("hour").agg(F.count("*").alias("count"))
    every = log.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    out = every.join(counted, "hour", "left").select("hour", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
    first = F.row_number().over(Window.orderBy(F.desc("count"), "hour"))  # 24 rows
    return out.withColumn("is_peak", first == 1)


def performance_by_day(log: DataFrame, zone: str | None = None) -> DataFrame:
    day = log.where("execution_time is not null").groupBy(local_date(zone).alias("date"))
    return day.agg(F.round(F.avg("execution_time"), 4).alias("avg_time"), F.min("execution_time").alias("min_time"), F.max("execution_time").alias("max_time"), F.count("*").alias("searches"))


def cache_stats(log: DataFrame) -> DataFrame:
    """A logged time of zero is a cache hit."""
    out = log.where("execution_time is not null").agg(F.count("*").alias("total"), F.count_if(F.col("execution_time") == 0).alias("hits"))
    return out.withColumn("misses", F.col("total") - F.col("hits")).withColumn("hit_rate", F.when(F.col("total") > 0, F.round(F.col("hits") * 100.0 / F.col("total"), 1)).otherwise(0.0))


def query_performance(log: DataFrame, fastest: bool, n: int = 10) -> DataFrame:
    timed = log.where("execution_time > 0" + (" and results_count > 0" if fastest else ""))
    out = timed.groupBy("query").agg(F.round(F.avg("execution_time"), 4).alias("avg_time"), F.count("*").alias("searches")).where("searches >= 3")
    return out.orderBy(F.asc("avg_time") if fastest else F.desc("avg_time"), "query").limit(n)


def average_time(log: DataFrame) -> DataFrame:
    return log.where("source = 'frontend'").agg(F.round(F.avg("execution_time"), 4).alias("avg_time"))


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.groupBy("rule_id", "rule_name").agg(F.count("*").alias("count"), F.round(F.avg("results_count"), 4).alias("avg_results")).orderBy(F.desc("count"), "rule_id").limit(n)


def rules_by_action(rules: DataFrame) -> DataFrame:
    return rules.groupBy("action_type").agg(F.count("*").alias("count"), F.countDistinct("rule_id").alias("rules"))


def rule_queries(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.groupBy("query").agg(F.count("*").alias("count"), F.countDistinct("rule_id").alias("rules")).orderBy(F.desc("count"), "query").limit(n)


def rule_detail(rules: DataFrame, rule_id: int) -> dict[str, DataFrame]:
    own = rules.where(F.col("rule_id") == rule_id)
    return {
        "totals": own.agg(F.count("*").alias("count"), F.countDistinct("query").alias("queries"), F.round(F.avg("results_count"), 4).alias("avg_results")),
        "top_queries": own.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(10),
        "daily": own.groupBy(local_date().alias("date")).agg(F.count("*").alias("count")),
        "recent": own.select("id", "query", "date_created").orderBy(F.desc("date_created"), F.desc("id")).limit(20),
    }


def top_promotions(shown: DataFrame, n: int = 10) -> DataFrame:
    return shown.groupBy("promotion_id").agg(F.count("*").alias("impressions"), F.countDistinct("query").alias("queries")).orderBy(F.desc("impressions"), "promotion_id").limit(n)


def promotions_by_position(shown: DataFrame) -> DataFrame:
    return shown.groupBy("position").agg(F.count("*").alias("impressions"), F.countDistinct("promotion_id").alias("promotions"))


def promotion_queries(shown: DataFrame, n: int = 10) -> DataFrame:
    return shown.groupBy("query").agg(F.count("*").alias("impressions"), F.countDistinct("promotion_id").alias("promotions")).orderBy(F.desc("impressions"), "query").limit(n)


def promotion_detail(shown: DataFrame, promotion_id: int) -> dict[str, DataFrame]:
    own = shown.where(F.col("promotion_id") == promotion_id)
    return {
        "totals": own.agg(F.count("*").alias("impressions"), F.countDistinct("query").alias("queries"), F.round(F.avg("position"), 4).alias("avg_position")),
        "top_queries": own.groupBy("query").agg(F.count("*").alias("impressions")).orderBy(F.desc("impressions"), "query").limit(10),
        "daily": own.groupBy(local_date().alias("date")).agg(F.count("*").alias("impressions")),
        "recent": own.select("id", "query", "date_created").orderBy(F.desc("date_created"), F.desc("id")).limit(20),
    }


def summary(log: DataFrame) -> DataFrame:
    each = actions(log, **_outcomes()).agg(F.count("*").alias("searches"), F.count_if(_zero()).alias("zero_results"))
    visitors = log.agg(F.countDistinct("ip").alias("visitors"))
    out = each.join(visitors)  # one row each
    return out.withColumn("zero_rate", F.when(F.col("searches") > 0, F.round(F.col("zero_results") * 100.0 / F.col("searches"), 1)).otherwise(0.0))


def daily_chart(log: DataFrame, start: str, end: str, zone: str | None = None) -> DataFrame:
    """One row for each day of [start, end), zero-filled."""
    each = actions(in_range(log, start, end), local_date(zone).alias("date"), **_outcomes())
    counted = each.groupBy("date").agg(F.count("*").alias("total"), F.count_if(~_zero()).alias("with_results"), F.count_if(_zero()).alias("zero_results"))
    days = log.sparkSession.range(1).select(F.explode(F.expr(f"sequence(date '{start[:10]}', date '{end[:10]}' - interval 1 day, interval 1 day)")).alias("date"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return days.join(counted, "date", "left").select("date", zero("total"), zero("with_results"), zero("zero_results"))


def popular_queries(log: DataFrame, n: int = 50) -> DataFrame:
    """What a cache is warmed with."""
    return log.groupBy("normalized_query", "site_id").agg(F.min("query").alias("query"), F.count("*").alias("count")).orderBy(F.desc("count"), "normalized_query", "site_id").limit(n)


def warm_prefixes(popular: DataFrame) -> DataFrame:
    """Each popular query and its prefixes of 2 to 5 characters."""
    cuts = F.transform(F.sequence(F.lit(2), F.lit(5)), lambda n: F.substring(F.col("query"), F.lit(1), n))
    return popular.select(F.explode(F.array_distinct(F.filter(cuts, lambda p: F.length(p) >= 2))).alias("prefix")).distinct()


def usage_counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("count"))


#: Columns of an export, newest first, of at most CAP rows.
CAP = 100_000


def export(log: DataFrame, cap: int = CAP) -> DataFrame:
    """The newest ``cap`` rows with a flag that says whether there were more."""
    newest = log.orderBy(F.desc("date_created"), F.desc("id")).limit(cap + 1)
    rank = F.row_number().over(Window.orderBy(F.desc("date_created"), F.desc("id")))
    more = F.count("*").over(Window.partitionBy()) > cap
    return newest.select("*", rank.alias("_rank"), more.alias("truncated")).where(F.col("_rank") <= cap).drop("_rank")


def append(rows: DataFrame, path: str) -> None:
    """Adds searches to the log at ``path``, a folder for each day, so that reports and retention read and drop whole days."""
    rows.withColumn("day", F.to_date("date_created")).write.mode("append").partitionBy("day").parquet(path)


def write_export(log: DataFrame, path: str, kind: str = "csv", cap: int = CAP) -> None:
    """The export as CSV rows with a heading, or as JSON with what belongs to the visitor nested."""
    out = export(log, cap)
    if kind == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
        return
    visitor = [c for c in ("ip", "country", "city", "device_type", "browser", "os_name") if c in out.columns]
    rest = [c for c in out.columns if c not in visitor]
    out.select(*rest, F.struct(*visitor).alias("visitor")).write.mode("overwrite").json(path)


def without(log: DataFrame, ids: list[int] | None = None, site_id: int | None = None, before: str | None = None) -> DataFrame:
    """What stays after a deletion by id, of a site, or of rows older than a date; none of these keeps all."""
    gone = F.lit(False)
    if ids is not None:
        gone = gone | F.col("id").isin(ids)
    if site_id is not None:
        gone = gone | (F.col("site_id") == site_id)
    if before is not None:
        gone = gone | (F.col("date_created") < F.lit(before).cast(log.schema["date_created"].dataType))
    return log.where(~gone)
