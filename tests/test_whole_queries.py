"""Queries that cover all rows, terms or changes, against their SQL."""

import duckdb

from tesserine.plans import reports, searches

DATA = "/root/testdata/sf0.001"


def both(spark, queries, sql, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(sql[name]).df()
    got = queries[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    order = [c for c in ("id", "query_id", "rank", "document_key") if c in want]
    return got[want.columns].sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True)


def test_export_has_all_columns(spark):
    got, want = both(spark, reports.QUERIES, reports.SQL, "export_log")
    assert len(got) == len(want) > 0 and len(got.columns) > 20
    for c in ("id", "query", "source", "truncated", "browser", "is_hit"):
        assert got[c].tolist() == want[c].tolist()


def test_batch_asks_all_terms(spark):
    got, want = both(spark, searches.QUERIES, searches.SQL, "batch_bm25_all")
    assert len(got) == len(want) > 0
    assert got["query_id"].tolist() == want["query_id"].tolist()
    assert (got["score"] - want["score"]).abs().max() < 1e-5


def test_all_changes_are_applied(spark):
    got, want = both(spark, searches.QUERIES, searches.SQL, "apply_all_changes")
    assert got["document_key"].tolist() == want["document_key"].tolist() and len(got) > 0
