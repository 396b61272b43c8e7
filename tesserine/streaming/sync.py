"""Keeping an index current from a stream of changes.

The offset log of a stream replaces claims and tokens: a micro-batch is what has been claimed,
and a failed batch is replayed as it was. What stays of the buffer's logic is the coalescing of changes, the retry schedule and
the decision whether a change is an upsert or a delete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The defaults.
FLUSH_SECONDS, MAX_DELAY, MAX_ATTEMPTS, MAX_AGE = 5, 300, 5, 3600
KEY = ["index_handle", "element_id", "site_id"]


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """Of each key the last operation; the first queueing time stays. ``changes(..., op, seq, queued_at)``; ties of seq go to the delete."""
    last = F.max(F.struct("seq", F.when(F.col("op") == "delete", 1).otherwise(0).alias("is_delete"), "op"))
    return changes.groupBy(*KEY).agg(last.alias("l"), F.min("queued_at").alias("queued_at"), F.count("*").alias("changes")).select(*KEY, F.col("l.op").alias("op"), F.col("l.seq").alias("seq"), "queued_at", "changes")


def delay_seconds(attempt: Column, flush: int = FLUSH_SECONDS) -> Column:
    """T4: doubled with each attempt, up to five minutes."""
    return F.least(F.lit(MAX_DELAY), flush * F.pow(F.lit(2), F.least(attempt, F.lit(20)) - 1)).cast("long")


def after_failure(rows: DataFrame, now: Column, flush: int = FLUSH_SECONDS, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Rows (attempt_count counts the failed one) with status and the time of the next attempt."""
    gone = F.col("attempt_count") >= most
    return rows.withColumn("status", F.when(gone, "abandoned").otherwise("failed")).withColumn("next_attempt_at", F.when(~gone, now + F.make_dt_interval(secs=delay_seconds(F.col("attempt_count"), flush))))


def due(rows: DataFrame, now: Column, stale_after: int = MAX_AGE) -> DataFrame:
    """What may be worked on: pending or failed and due, or in work for too long."""
    waiting = F.col("status").isin("pending", "failed") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now))
    stuck = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(stale_after)))
    return rows.where(waiting | stuck).orderBy("queued_at", *KEY)


def succeeded(rows: DataFrame, ids: list[int], token: str) -> DataFrame:
    """Without the rows done under a claim; those that changed meanwhile wait again, from that change on."""
    mine = F.coalesce(F.col("element_id").isin(ids) & (F.col("claim_token") == token), F.lit(False))
    again = mine & F.col("dirty_at").isNotNull()
    out = rows.where(~mine | again)
    return out.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "attempt_count": F.when(again, 0).otherwise(F.col("attempt_count")), "queued_at": F.when(again, F.col("dirty_at")).otherwise(F.col("queued_at")), "claim_token": F.when(~again, F.col("claim_token")), "dirty_at": F.when(~again, F.col("dirty_at"))})


def purge(rows: DataFrame, now: Column, max_age: int = MAX_AGE) -> DataFrame:
    """T5: without abandoned rows that are too old."""
    return rows.where(~((F.col("status") == "abandoned") & (F.col("queued_at") < now - F.make_dt_interval(secs=F.lit(max_age)))))


def decide(changes: DataFrame, source: DataFrame, live: Column | None = None) -> DataFrame:
    """An upsert whose element is missing, not live or out of criteria becomes a delete."""
    there = source.where(live) if live is not None else source
    known = there.select("element_id", "site_id").distinct().withColumn("_there", F.lit(True))
    out = changes.join(known, ["element_id", "site_id"], "left")
    return out.withColumn("op", F.when((F.col("op") == "upsert") & F.col("_there").isNotNull(), "upsert").otherwise("delete")).drop("_there")


def apply_changes(docs: DataFrame, changes: DataFrame, source: DataFrame) -> DataFrame:
    """Documents after coalesced, decided changes: upserts replace, deletes remove all sections of an element."""
    touched = changes.select("element_id", "site_id")
    upserts = source.join(changes.where("op = 'upsert'").select("element_id", "site_id"), ["element_id", "site_id"], "left_semi")
    return docs.join(touched, ["element_id", "site_id"], "left_anti").unionByName(upserts, allowMissingColumns=True)


def status_changes(rows: DataFrame, since: Column, now: Column) -> DataFrame:
    """Rows that went live or expired in (since, now]."""
    came = (F.col("post_date") > since) & (F.col("post_date") <= now)
    went = (F.col("expiry_date") > since) & (F.col("expiry_date") <= now)
    return rows.where(came | went).select(*KEY, F.when(went, "delete").otherwise("upsert").alias("op"))


def rate_limited(requests: DataFrame, per_minute: int) -> DataFrame:
    """Windows of a minute in which a key asked more often than it may."""
    counted = requests.groupBy("key", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > per_minute).select("key", F.col("w.start").alias("minute"), "requests")


def enrich(rows: DataFrame, geo: DataFrame) -> DataFrame:
    """With the location of the address where it is known."""
    return rows.join(geo, "ip", "left")


def run(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "5 seconds") -> StreamingQuery:
    """Feeds coalesced micro-batches of the stream ``changes`` to ``apply``; until what is there is done, or for good."""

    def batch(df: DataFrame, number: int) -> None:
        apply(coalesce_changes(df), number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def buffer_stats(rows: DataFrame) -> DataFrame:
    """G27."""
    return rows.groupBy("status").agg(F.count("*").alias("count"), F.min("queued_at").alias("oldest"))


#: The columns a listing may be sorted by.
SORTS = ("queued_at", "attempt_count", "status", "next_attempt_at", "index_handle", "op")


def buffer_search(rows: DataFrame, status: str | None = None, index_handle: str | None = None, op: str | None = None, site_id: int | None = None, text: str | None = None, sort: str = "queued_at", descending: bool = False, limit: int = 50, stuck_at: Column | None = None) -> DataFrame:
    """By equality filters, by text in the error or a whole id, and by being overdue at a time; sorted by a permitted column."""
    out = rows
    for name, value in (("status", status), ("index_handle", index_handle), ("op", op), ("site_id", site_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if text:
        same = F.col("last_error").contains(text)
        out = out.where(same | (F.col("element_id") == int(text)) if text.isascii() and text.isdigit() else same)
    if stuck_at is not None:
        out = out.where(overdue(stuck_at))
    if sort not in SORTS:
        sort, descending = "queued_at", False
    return out.orderBy(F.desc(sort) if descending else F.asc(sort), *KEY).limit(limit)


def overdue(now: Column, stale_after: int = MAX_AGE) -> Column:
    """Whether a row should have been tried by now, or has been in work for too long."""
    return (F.col("status").isin("pending", "failed") & (F.col("next_attempt_at") <= now)) | ((F.col("status") == "processing") & (F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(stale_after))))


def retry(rows: DataFrame, ids: list[int], now: Column | None = None) -> DataFrame:
    """M6: failed and abandoned rows back to pending, due at once, without claim and error."""
    again = F.col("element_id").isin(ids) & F.col("status").isin("failed", "abandoned")
    cleared = {c: F.when(~again, F.col(c)) for c in ("claimed_at", "claim_token", "last_error") if c in rows.columns}
    if "next_attempt_at" in rows.columns:
        cleared["next_attempt_at"] = F.when(again, now if now is not None else F.current_timestamp()).otherwise(F.col("next_attempt_at"))
    return rows.withColumns({"attempt_count": F.when(again, 0).otherwise(F.col("attempt_count")), "status": F.when(again, "pending").otherwise(F.col("status")), **cleared})


def removed(rows: DataFrame, ids: list[int], now: Column, stale_after: int = MAX_AGE) -> DataFrame:
    """M6: without the rows of these ids, but for those that are in work and not overdue."""
    working = (F.col("status") == "processing") & ~F.coalesce(F.col("claimed_at") < now - F.make_dt_interval(secs=F.lit(stale_after)), F.lit(False))
    return rows.where(~F.col("element_id").isin(ids) | working)


def purge_status(rows: DataFrame, status: str) -> DataFrame:
    """M6: without the rows of a status."""
    if status not in ("pending", "processing", "failed", "abandoned"):
        raise ValueError(f"no such status: {status}")
    return rows.where(F.col("status") != status)
