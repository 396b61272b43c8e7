import math

import pytest

from tesserine.operators import index as I
from tesserine.operators import pipeline as P
from tesserine.operators import retrieval as R
from tesserine.operators import suggest as S

DOCS = [
    (1, "Alpha beta gamma", "alpha beta gamma"),
    (2, "Alpha gamma beta", "alpha gamma beta"),
    (3, "Beta alpha gamma", "beta alpha gamma"),
    (4, "Alpha beta title", "other words"),
    (5, "Testing tools", "testing tools guide"),
    (6, "Toolbar", "toolbar customization options uses my.file"),
    (7, "Toolkit", None),
    (8, None, "tool reference template"),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, f"{i}_1", i, t, c, "en" if i != 4 else "de", "entry" if i % 2 else "page") for i, t, c in DOCS]
    docs = spark.createDataFrame(rows, "site_id int, document_key string, element_id long, title string, content string, language string, type string")
    return I.build(docs, []).persist()


def keys(df):
    return [r.document_key for r in df.collect()]


def test_bm25_by_hand(index):
    rows = {r.document_key: r.score for r in R.search(index, "tool OR zzz", s=R.Settings(fuzzy=False)).collect()}
    n, total = 8, sum(len(f"{t or ''} {c or ''}".replace(".", " ").split()) for _, t, c in DOCS)
    want = math.log(1 + (n - 1 + 0.5) / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (total / n)))
    assert rows == {"8_1": pytest.approx(want, abs=1e-6)}


def test_exact_sequence_boost(index):
    s = R.Settings(fuzzy=False)
    with_boost = {r.document_key: r.score for r in R.search(index, "alpha beta", s=s).collect()}
    plain = {r.document_key: r.score for r in R.search(index, "alpha AND beta", s=s).collect()}
    assert {k for k in plain if with_boost[k] > 2 * plain[k]} == {"1_1", "4_1"} and set(plain) == {"1_1", "2_1", "3_1", "4_1"}


def test_boolean_and_fields(index):
    s = R.Settings(fuzzy=False)
    assert set(keys(R.search(index, "alpha NOT title", s=s))) == {"1_1", "2_1", "3_1"}
    assert keys(R.search(index, "title:Tools", s=s)) == ["5_1"]
    assert keys(R.search(index, "content:guide", s=s)) == ["5_1"]
    assert set(keys(R.search(index, "tool*", s=s))) == {"5_1", "6_1", "7_1", "8_1"}
    assert keys(R.search(index, '"alpha gamma"', s=s)) and set(keys(R.search(index, '"alpha gamma"', s=s))) == {"2_1", "3_1"}
    assert keys(R.search(index, '"no such" alpha', s=s)) == [] and keys(R.search(index, "NOT alpha", s=s)) == []
    assert keys(R.search(index, "alpha OR beta", s=s, language="de")) == ["4_1"] and set(keys(R.search(index, "alpha OR beta", s=s, types=["PAGE"]))) == {"2_1", "4_1"}
    assert set(keys(R.search(index, "alpha qqqq", s=s))) == {"1_1", "2_1", "3_1", "4_1"}  # relaxed
    assert keys(R.search(index, "alpha AND qqqq", s=s)) == []


def test_query_boost_multiplies_documents(index):
    s = R.Settings(fuzzy=False)
    plain = {r.document_key: r.score for r in R.search(index, "tools OR alpha", s=s).collect()}
    more = {r.document_key: r.score for r in R.search(index, "tools^2 OR alpha", s=s).collect()}
    assert more["5_1"] == pytest.approx(2 * plain["5_1"], abs=2e-6) and more["1_1"] == plain["1_1"]


def test_fuzzy_resolution(index):
    found = R.resolve(index, ["tols"], 1)
    assert [(r.term, r.match) for r in found][:1] == [("tools", "fuzzy")] and found[0].weight < 0.4
    exact = R.resolve(index, ["tools"], 1)
    assert exact[0].term == "tools" and exact[0].weight == 1.0
    assert R.resolve(index, [], 1) == []


def test_maintenance(spark, index):
    gone = spark.createDataFrame([(1, 5), (1, 99)], "site_id int, element_id long")
    assert index.documents.count() - I.delete_elements(index.documents, gone).count() == 1
    assert I.orphan_ngrams(index).count() == 0 and I.clear_site(index.documents, 1).count() == 0
    new = spark.createDataFrame([(1, "5_1", 5, "Fresh", "fresh words", "en", "entry")], index.documents.schema)
    changed = I.upsert(index, new, [])
    assert changed.documents.count() == 8 and keys(R.search(changed, "fresh", s=R.Settings(fuzzy=False))) == ["5_1"]


def test_write_and_load(spark, index, tmp_path):
    index.write(str(tmp_path))
    again = I.load(spark, str(tmp_path))
    assert set(keys(R.search(again, "alpha OR tools", s=R.Settings(fuzzy=False)))) == set(keys(R.search(index, "alpha OR tools", s=R.Settings(fuzzy=False))))


def test_suggestions(index):
    assert [r.term for r in S.terms(index, prefix="tool").collect()][0] in {"tools", "toolbar"}
    assert [r.term for r in S.completions(index, "alpha ga", s=R.Settings(fuzzy=False)).collect()] == ["gamma"]
    assert [r.suggestion for r in S.suggest(index, "my.fi").collect()] == ["my.file"] and S.suggest(index, "a").count() == 0


def test_rules():
    assert P.matches("Red Shoes", "contains", "blue, shoes") and P.matches("abc", "prefix", "ab") and not P.matches("abc", "exact", "ab")
    assert P.matches("sku-12", "regex", r"^SKU-\d+$") and not P.matches("x", "regex", "(") and not P.matches("x", "regex", "x" * 501)
    rules = [{"rule_id": 1, "action_type": "redirect", "match_type": "exact", "match_value": "home", "priority": 1, "action_value": {"url": "javascript:x"}}, {"rule_id": 2, "action_type": "redirect", "match_type": "exact", "match_value": "home", "priority": 0, "action_value": {"url": "/start"}}]
    assert P.redirect("home", rules) == "/start" and P.redirect("x", rules) is None
    syn = [{"rule_id": 1, "action_type": "synonym", "match_type": "exact", "match_value": "tv", "action_value": {"terms": [f"t{i}" for i in range(20)]}}]
    assert len(P.expand_synonyms("tv", syn)) == 10


def test_promotions_and_boosts(spark):
    hits = spark.createDataFrame([(i, 10.0 - i) for i in range(1, 6)], "element_id long, score double")
    placed = P.promote(hits, spark.createDataFrame([(9, 1), (3, 3)], "element_id long, position int")).orderBy("rank").collect()
    assert [(r["rank"], r.element_id) for r in placed] == [(1, 9), (2, 1), (3, 3), (4, 2), (5, 4), (6, 5)] and placed[0].score is None
    assert P.promote(hits.where("false"), spark.createDataFrame([(9, 1)], "element_id long, position int")).count() == 0
    cats = spark.createDataFrame([(1, "s", [1, 2], 2.0)], "element_id long, section_handle string, category_ids array<int>, score double")
    assert P.rule_boosts(cats, {1: 2.0}, {"s": 3.0}, [(2, 5.0), (1, 7.0)]).first().score == 60.0
