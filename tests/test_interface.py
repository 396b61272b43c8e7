"""The public side: its queries against their SQL, and what no query reaches."""

import glob

import duckdb
import pandas as pd
import pytest

from tesserine.functions import highlight
from tesserine.functions.content import unescape
from tesserine.functions.text import stop_words
from tesserine.operators import interface as E
from tesserine.plans import interface, reports, searches
from tesserine.streaming import sync

DATA = "/root/testdata/sf0.001"
CHECKED = [(m, q) for m in (interface,) for q in sorted(m.QUERIES)] + [(reports, "zero_result_clusters")] + [(searches, q) for q in ("html_clean", "headings", "sections_exploded", "excerpts", "fuzzy_bm25", "fuzzy_bm25_or", "resolved_terms")]


def plain(df):
    text = lambda v: "" if pd.isna(v) else str(round(v, 5) if isinstance(v, float) else v).removesuffix(".0")
    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize(("module", "name"), CHECKED, ids=[q for _, q in CHECKED])
def test_query_equals_sql(spark, module, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(module.SQL[name]).df()
    got = module.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    assert plain(got) == plain(want)


def test_expressions():
    for text, whole in (('a = "1"', True), ("(a) AND (b)", True), ("(a", False), (")a(", False), ('a = ")"', True), ('a = "x', False), (r'a = "\")"', True), ('a = "x\\', False), ("", True)):
        assert E.is_balanced(text) == whole, text
    assert E.with_required(" a = 1 ", "site = 2") == "(a = 1) AND site = 2"
    assert E.with_required("(a", "site = 2", "&&") == E.with_required(None, "site = 2") == E.with_required("  ", "site = 2") == "site = 2"


def test_key_scope():
    every, some = E.Key(), E.Key(("a", "b"), most_hits=5)
    assert every.scope([], False, ["a", "c"]) == ([], False) and every.limit(90) == 90
    assert some.scope([], False, ["a", "c"]) == (["a"], True) and some.scope(["b"], True, ["b"]) == (["b"], True) and some.limit(90) == 5 and some.limit(3) == 3
    with pytest.raises(E.Refused):
        some.scope(["c"], True, ["a", "c"])
    with pytest.raises(E.Refused):
        E.Key(enabled=False).scope([], False, [])


@pytest.fixture(scope="module")
def engine(spark):
    docs = spark.createDataFrame([(1, f"{i}_1", i, t, c, "en", k) for i, t, c, k in ((1, "Toolbar", "toolbar options", "entry"), (2, "Toolkit", "toolkit tips toolbar", "entry"), (3, "Other", "nothing here", "asset"))], "site_id int, document_key string, element_id int, title string, content string, language string, type string")
    return E.Engine(E.rebuild(docs, [E.Source("a", criteria=lambda r: r.where("element_id < 3")), E.Source("b"), E.Source("c", enabled=False)], []))


def test_engine_defaults(engine):
    assert set(engine.indices) == {"a", "b"}
    keys = lambda df: [(r.index_handle, r.document_key) for r in df.collect()]
    assert {h for h, _ in keys(engine.search("toolbar"))} == {"a", "b"}
    assert {h for h, _ in keys(engine.search("toolbar", "b,c"))} == {"b"}
    for query, handles in ((" ", ""), ("x" * 257, ""), ("toolbar", "c"), ("toolbar", "a,b,c,d,e,f")):
        assert keys(engine.search(query, handles)) == [], (query, handles)
    assert len(keys(engine.search("toolbar", limit=1))) == 1 and keys(engine.search("toolbar", page=5)) == []
    assert {k for _, k in keys(engine.search("nothing", types="asset, product"))} == {"3_1"} and keys(engine.search("toolbar", types="asset")) == []
    with pytest.raises(E.Refused):
        engine.search("toolbar", "b", key=E.Key(("a",)))


def test_engine_completions(engine):
    assert [r.suggestion for r in engine.completions("tool").collect()] == list(dict.fromkeys(r.suggestion for r in engine.completions("tool").collect()))
    assert {r.suggestion for r in engine.completions("tool").collect()} >= {"toolbar", "toolkit"}
    assert engine.completions("").count() == engine.completions("tool", "c").count() == 0
    assert [r.element_id for r in engine.results("tool", "b,a").collect()] == [1, 2] and engine.results("tool", key=E.Key(("a",), most_hits=1)).count() == 1


def test_hooks_may_answer(engine):
    answer = engine.search("toolbar", "a")
    short = E.Engine(engine.indices, before=[lambda r: answer])
    assert short.search("anything").collect() == answer.collect()


def test_source_rows(spark):
    rows = spark.createDataFrame([(1, "entry", 1, "/a", None, False), (2, "entry", 1, None, False, False), (3, "entry", 2, "/c", True, False), (4, "asset", 1, None, None, None), (5, "entry", 3, "/e", None, True)], "element_id int, type string, site_id int, url string, is_draft boolean, is_revision boolean")
    ids = lambda of: sorted(r.element_id for r in E.source_rows(rows, of).collect())
    assert ids(E.Source("x")) == [1, 2, 4] and ids(E.Source("x", skip_without_url=True)) == [1, 4] and ids(E.Source("x", "entry", (1, 3), skip_without_url=True)) == [1]
    assert ids(E.Source("x", enabled=False)) == [] and ids(E.Source("x", criteria={"url": ["/a"], "type": []})) == [1]
    assert E.Source("x").applies_to(9) and E.Source("x", site_ids=(1,)).applies_to(1) and not E.Source("x", site_ids=(1,)).applies_to(2)


def test_addresses(spark):
    rows = spark.createDataFrame([(x,) for x in ("10.1.2.3", "8.8.8.8", "::1", "fe80::1", "2001:db8::5", "nonsense", "256.1.1.1", "172.32.0.1", None)], "ip string")
    geo = spark.createDataFrame([("8.8.8.8", "US"), ("2001:db8::5", "DE"), ("10.1.2.3", "no")], "ip string, country string")
    got = {r.ip: r.country for r in E.located(rows, geo, {"country": "home"}).collect()}
    assert got == {"10.1.2.3": "home", "8.8.8.8": "US", "::1": "home", "fe80::1": "home", "2001:db8::5": "DE", "nonsense": "home", "256.1.1.1": "home", "172.32.0.1": None, None: None}


def test_snippet_columns_equal_the_scalar_form(spark):
    body = "Lead words here. " * 20 + "The tool is described in this part of the text. " + "More words follow. " * 20
    rows = spark.createDataFrame([(1, body, "a summary that names the tool twice, tool", ["The tool"]), (2, None, None, None), (3, "no match", "none", [])], "id int, body string, summary string, titles array<string>")
    got = {r.id: r for r in rows.select("id", highlight.hit_snippet(E.F.col("body"), ["tool"], "early", 80).alias("h"), highlight.field_snippet({"summary": E.F.col("summary")}, E.F.col("body"), ["tool"]).alias("f"), highlight.heading_parts(E.F.col("body"), E.F.col("titles"), ["tool"]).alias("p")).collect()}
    assert got[1].h == highlight.snippet_of(body, ["tool"], "early", 80) and got[1].f == highlight.best_snippet({"summary": "a summary that names the tool twice, tool"}, body, ["tool"])
    assert [tuple(p) for p in got[1].p] == highlight.heading_snippets(body, ["The tool"], ["tool"])
    assert got[2].h is None and got[2].f is None and got[2].p == [] and got[3].h is None and got[3].p == []


def test_stop_words_are_lists():
    for code, n in (("ar", 110), ("ja", 115), ("fr", 197)):
        assert len(stop_words(code)) == n and len(set(stop_words(code))) == n, code


def test_entities_end_in_a_semicolon():
    assert unescape("a &amp; b &amp c &notit; &not; &#65; &#x42; &amp;lt; &nosuch; &") == "a & b &amp c &notit; ¬ A B &lt; &nosuch; &"


def test_purge_knows_its_states():
    with pytest.raises(ValueError):
        sync.purge_status(None, "done")
