import random

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.plans.query import has_operators, parse, understand


def test_normalize():
    assert T.normalize_text("ÉCOLE Straße") == "ecole straße"
    assert T.normalize_text("ﬁ ١٢٣ كـتاب") == "fi 123 كتاب"
    assert T.normalize_text("が") == "が" and T.normalize_text(None) is None and T.normalize_text("") == ""


def test_tokens(spark):
    df = spark.createDataFrame([("Crème-brûlée, v2.0!", ["a"]), (None, None), ("", None)], "t string, x array<string>")
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [["creme", "brulee", "v2", "0"], None, []]
    assert T.tokenize_text("Crème-brûlée_x") == ["creme", "brulee", "x"]


def test_ngrams_and_jaccard(spark):
    df = spark.createDataFrame([("tool", "tools")], "a string, b string")
    row = df.select(T.ngrams(F.col("a")).alias("g"), T.jaccard(T.ngrams(F.col("a")), T.ngrams(F.col("b"))).alias("j")).first()
    assert row.g == [" t", "to", "oo", "ol", "l ", " to", "too", "ool", "ol "] and abs(row.j - 7 / 13) < 1e-12


def test_damerau():
    assert T.damerau("ca", "abc") == 2 and T.damerau("", "ab") == 2 and T.damerau("abcd", "acbd") == 1
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(2))
        assert T.damerau(a, b) == T.damerau(b, a) and abs(len(a) - len(b)) <= T.damerau(a, b) <= max(len(a), len(b))


def test_typo_budget(spark):
    cases = [("cat", "cats", True), ("cat", "bat", False), ("tool", "toll", True), ("tool", "fool", False), ("template", "tmeplaet", True), ("", "a", False)]
    assert [T.within_budget(q, c) for q, c, _ in cases] == [w for _, _, w in cases]
    df = spark.createDataFrame(cases, "q string, c string, w boolean")
    assert df.where(T.within_budget_column(F.col("q"), F.col("c")) != F.col("w")).count() == 0


def test_language_and_scripts(spark):
    df = spark.createDataFrame([("en_GB", "en", "نص"), ("de", "fr", "x"), ("??", "en", "")], "a string, b string, t string")
    rows = df.select(T.language_code(F.col("a")), T.language_match(F.col("a"), F.col("b")), T.script_language(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [("en-gb", True, "ar"), ("de", False, None), (None, False, None)]


def test_intent_and_compounds(spark):
    df = spark.createDataFrame([("how to search",), ("buy shoes",), ("login page",), ("red shoes",)], "q string")
    assert [r[0] for r in df.select(T.intent(F.col("q"))).collect()] == ["question", "product", "navigational", "informational"]
    df = spark.createDataFrame([("Use MyFile.Twig and redirect.twig.",)], "t string")
    assert df.select(T.compounds(F.col("t"))).first()[0] == ["MyFile.Twig", "redirect.twig"]


def test_parser():
    q = parse('"exact words" title:a,b^2 red^2.5 blue* NOT green')
    assert q.phrases == ["exact words"] and q.field_filters == {"title": ["a", "b"]} and q.not_terms == ["green"] and q.wildcards == ["blue"] and q.boosts["red"] == 2.5
    assert parse("a OR b").operator == "OR" and parse("a und b", "de").operator == "AND" and parse("a und b", "de").terms == ["a", "b"]
    assert parse("NOT spam").is_empty and not parse("x NOT spam").is_empty
    assert has_operators("pasta e fagioli") and parse("pasta e fagioli").terms == ["pasta", "e", "fagioli"]
    assert not has_operators("plain words") and understand("my.fi", autocomplete=True).is_compound


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, k string")
    assert df.where(T.filter_expression({"k": ["a", "b", None], "n": None})).count() == 2
    assert df.where(T.filter_expression({"k": "a"}, F.col("n") > 1)).count() == 0
