"""Upkeep queries against their SQL, and what no query reaches."""

import glob

import duckdb
import pytest

from tesserine.functions import text
from tesserine.operators import analytics as A
from tesserine.operators import index as I
from tesserine.operators import metadata as M
from tesserine.operators import pipeline as P
from tesserine.operators import retrieval as R
from tesserine.plans import upkeep
from tesserine.plans.query import understand

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(upkeep.QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(upkeep.SQL[name]).df()
    got = upkeep.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    assert plain(got) == plain(want)


def plain(df):
    text = lambda v: "" if v is None or v != v else str(round(v, 5) if isinstance(v, float) else v).removesuffix(".0")
    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_compound_queries():
    for q, is_one in (("redirect.twig", True), ("install redirect.tw", True), ("redirect.", False), (".twig", False), ("my redirect.", True), ("plain words", False)):
        assert understand(q).is_compound == is_one, q
    assert understand("Été.Twig").compound_prefix == "ete.twig"


def test_rule_validation():
    good = {"action_type": "synonym", "match_type": "exact", "match_value": "a", "action_value": {"terms": ["b"]}}
    assert M.rule_errors(good) == []
    assert M.rule_errors(good | {"action_value": {"terms": ["x"] * 11}}) and M.rule_errors(good | {"action_value": {}})
    assert M.rule_errors(good | {"match_type": "regex", "match_value": "(a+)+"}) and M.rule_errors(good | {"match_type": "regex", "match_value": "("}) and M.rule_errors(good | {"match_type": "regex", "match_value": "a" * 501})
    assert M.rule_errors({"action_type": "boost_element", "action_value": {"element_id": 1, "multiplier": "2.5"}}) == []
    assert M.rule_errors({"action_type": "boost_section", "action_value": {"multiplier": "x"}}) and len(M.rule_errors({"action_type": "boost_section", "action_value": {}})) == 2
    assert M.rule_errors({"action_type": "redirect", "action_value": {"url": "javascript:x"}}) and M.rule_errors({"action_type": "redirect", "action_value": {"url": "//host"}}) and M.rule_errors({"action_type": "redirect", "action_value": {"url": "/x"}}) == []


def test_fuzzy_cap(spark):
    docs = spark.createDataFrame([(1, f"{i}_1", i, f"tiomen{i:03d}x", "", "en", "entry") for i in range(150)], "site_id int, document_key string, element_id int, title string, content string, language string, type string")
    index = I.build(docs, [])
    assert len(R.resolve(index, ["tiomen000"], 1)) <= 100
    assert [r.match for r in R.resolve(index, ["tiomen000x"], 1)].count("fuzzy") <= 3


def test_log_is_appended_and_exported(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{i} 10:00:00", f"q{i}", "1.2.3.4", "DE") for i in range(1, 5)], "id int, date_created string, query string, ip string, country string").withColumn("date_created", I.F.to_timestamp("date_created"))
    A.append(rows.where("id < 3"), str(tmp_path / "log"))
    A.append(rows.where("id >= 3"), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and log.select("day").distinct().count() == 4
    A.write_export(log.drop("day"), str(tmp_path / "csv"), "csv", 3)
    assert {r.query for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"q2", "q3", "q4"}
    A.write_export(log.drop("day"), str(tmp_path / "json"), "json", 3)
    assert {r.visitor.country for r in spark.read.json(str(tmp_path / "json")).collect()} == {"DE"}


def test_headings_are_public(spark):
    df = spark.sql("select array(struct('One' as text, 'a' as id, 9 as level), struct(' ' as text, '' as id, 2 as level)) as h, '/u' as url")
    assert df.select(M.public_headings(I.F.col("h"), I.F.col("url")).alias("h")).first().h == [("One", "a", 6, "/u#a")]


def test_deep_hierarchy(spark):
    from tesserine.functions.content import ancestors

    rows = [(i, i - 1 if i else None, f"t{i}") for i in range(100)] + [(200, 201, "circle"), (201, 200, "circle")]
    got = {r.element_id: r.level for r in ancestors(spark.createDataFrame(rows, "element_id int, parent_id int, title string")).collect()}
    assert got == {i: i + 1 for i in range(100)}


def test_settings_without_a_query():
    assert P.requested_indices("a, b,,a,c", ["a", "c"]) == ["a", "c"] and P.limits(None) == 20 and P.limits(500) == 200 and P.limits(0, True) == 10
    allows = P.retrievable_fields(["*", "-secret"], ["title", "secret"])
    assert allows("title") and not allows("secret") and not allows("body")
    assert len(text.stop_words("de")) == 162 and text.stop_words("xx") == [] and text.stop_words("fr-CA") == text.stop_words("fr")
