import duckdb

from tesserine.functions import text as T
from tesserine.operators import retrieval as R
from tesserine.plans import searches


def test_typo_candidates_count_as_their_sql(spark):
    pairs = [("oaun", "oauß"), ("oaun", "oaan"), ("oaun", "oaune"), ("enleau", "enleæu"), ("enleau", "enlaeu"), ("maßstabe", "masstabe"), ("maßstabe", "maßstab"), ("tiom", "ßiom"), ("tool", "tool🙂x")]
    df = spark.createDataFrame(pairs, "query string, term string")
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT * FROM (VALUES " + ", ".join(map(str, pairs)) + ") v(query, term)")
    for in_bytes, budget in ((True, searches._BUDGET), (False, searches._LETTER_BUDGET)):
        want = set(con.execute(f"SELECT query, term FROM p WHERE {budget}").fetchall())
        assert {tuple(r) for r in R.typo_candidates(df, in_bytes=in_bytes).collect()} == want
        assert (("oaun", "oauß") in want) != in_bytes
    assert {p for p in pairs if T.within_budget(*p)} == {tuple(r) for r in R.typo_candidates(df).collect()}


def test_queries_count_as_their_sql():
    assert "typo_budget" in searches.QUERIES and "translate(" not in searches.SQL["typo_budget"]
    assert "translate(" in searches.SQL["typo_budget_letters"]
