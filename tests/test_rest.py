import datetime as dt

from pyspark.sql import functions as F

from tesserine.functions import content as C
from tesserine.functions import highlight as H
from tesserine.operators import analytics as A
from tesserine.streaming import sync


def test_clean_html(spark):
    df = spark.createDataFrame([("<h2>T</h2><p>One</p><p>Two &amp; three</p><pre>code</pre><script>x</script>",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(C.clean_body(F.col("h"))).collect()] == ["One Two & three", None, ""]
    assert df.select(C.strip_html(F.col("h"))).first()[0] == "T One Two & three codex"


def test_markdown():
    assert C.clean_markdown_text("# Title\n\n- **bold** _it_ `x`\n```\ncode\n```\n---\nend") == "Title bold it x end"
    assert [h["text"] for h in C.headings_of("## One\ntext\n### Two\nmore")] == ["One", "Two"]


def test_headings_and_sections(spark):
    text = "<p>Intro</p><h2 id='a'>First</h2><p>Body one</p><h2>Same</h2><p>x</p><h2>Same</h2><p>y</p>"
    found = C.headings_of(text)
    assert [(h["text"], h["id"], h["description"]) for h in found][:2] == [("First", "a", "Body one"), ("Same", "same", "x")]
    assert [(s["n"], s["anchor"], s["body"]) for s in C.sections_of(text)] == [(-1, "", "Intro"), (0, "a", "Body one"), (1, "same", "x"), (2, "same-2", "y")]
    docs = spark.createDataFrame([("1_1", "/u", text)], "document_key string, url string, html string")
    assert [r.document_key for r in C.split_sections(docs, "html").collect()] == ["1_1", "1_1_a", "1_1_same", "1_1_same-2"]


def test_highlight():
    assert H.highlight_text("The café & bar", ["cafe"]) == "The <mark>café</mark> &amp; bar"
    assert H.highlight_text("Toolbar tools", [], ["tool"]) == "<mark>Tool</mark>bar <mark>tool</mark>s"
    assert H.ranges("red blue red", ["red blue", "red"]) == [(0, 8), (9, 12)]
    long = "word " * 100 + "needle " + "tail " * 100
    (one,) = H.snippets_of(long, ["needle"])
    assert "needle" in one and one.startswith("...") and one.endswith("...") and len(one) <= 210
    assert H.snippet_of("nothing here", ["x"]) is None and "needle" in H.snippet_of(long, ["needle"], "early")
    assert H.class_tokens('a "b" c-d') == "a c-d"


def log(spark):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(1, None, "q", 0, False, False, 0, at, 1), *((i, "s1", "q", 0, False, False, 0, at, 1) for i in (2, 3, 4)), (5, None, "ok go", 2, True, False, 0, at, 1)]
    return spark.createDataFrame(rows, "id long, session_id string, query string, results_count int, is_hit boolean, was_redirected boolean, promotions_shown int, date_created timestamp_ntz, site_id int")


def test_actions_count_once(spark):
    top = {r.query: r["count"] for r in A.top_searches(log(spark)).collect()}
    assert top == {"q": 2, "ok go": 1}
    assert {r.query: r["count"] for r in A.zero_result_queries(log(spark)).collect()} == {"q": 2}
    assert {r.bucket: r["count"] for r in A.query_lengths(log(spark)).collect()} == {"1 word": 2, "2-3 words": 1, "4+ words": 0}
    chart = A.daily_chart(log(spark), "2023-12-31 00:00:00", "2024-01-03 00:00:00").orderBy("date").collect()
    assert [(r.total, r.with_results) for r in chart] == [(0, 0), (3, 1), (0, 0)]
    assert [tuple(r) for r in A.zero_result_clusters(log(spark)).collect()] == [("q", 2, 1)]


def test_sync(spark):
    rows = [("i", 1, 1, "upsert", 1, 10), ("i", 1, 1, "delete", 2, 11), ("i", 2, 1, "delete", 1, 10), ("i", 2, 1, "upsert", 2, 12)]
    changes = spark.createDataFrame(rows, "index_handle string, element_id long, site_id int, op string, seq long, queued_at long")
    assert {r.element_id: (r.op, r.queued_at) for r in sync.coalesce_changes(changes).collect()} == {1: ("delete", 10), 2: ("upsert", 10)}
    delays = spark.range(1, 9).select(sync.delay_seconds(F.col("id")).alias("d")).collect()
    assert [r.d for r in delays] == [5, 10, 20, 40, 80, 160, 300, 300]
    source = spark.createDataFrame([(2, 1, "2_1")], "element_id long, site_id int, document_key string")
    decided = sync.decide(sync.coalesce_changes(changes), source)
    docs = spark.createDataFrame([(1, 1, "1_1"), (3, 1, "3_1")], "element_id long, site_id int, document_key string")
    assert {r.document_key for r in sync.apply_changes(docs, decided, source).collect()} == {"2_1", "3_1"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("i", 1, 1, "upsert", 1, 10), ("i", 1, 1, "delete", 2, 11)]
    schema = "index_handle string, element_id long, site_id int, op string, seq long, queued_at long"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = sync.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r.op for r in df.collect()), str(tmp_path / "c"))
    query.awaitTermination(60)
    assert seen == ["delete"]


def test_entry_module():
    import __spark_entry__ as e

    assert len(e.queries()) > 90 and set(e.oracle_sql()) <= set(e.queries())
