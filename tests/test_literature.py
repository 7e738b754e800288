"""Titles, quotes, sections, names and rounds."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lodestone.operators import literature as L


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_titles(spark):
    a = spark.createDataFrame([(1, "Effects of Zinc on Sleep"), (2, "Entirely other words"), (3, None), (4, "Zinc and sleep quality")], "k long, title string")
    b = spark.createDataFrame([(1, 10, "Effects of zinc on sleep."), (1, 11, "Effect of zinc on the sleep"), (2, 12, "Something else"), (3, 13, None), (4, 15, "zinc and sleeps quality"), (4, 14, "zinc and sleeps quality")], "k long, o long, found string")
    got = {r.k: (r.match, round(r.ratio, 6)) for r in L.answer_titles(a, b, ["k"], "title", "o", "found").collect()}
    assert got == {1: (10, 1.0), 4: (14, round(SequenceMatcher(None, "zinc and sleep quality", "zinc and sleeps quality").ratio(), 6))}
    t = "A randomised trial of iron in young adults"
    assert one(spark, L.title_like(F.col("q"), F.lit(t)), q="a randomised trial of iron in young") is True
    assert one(spark, L.title_like(F.col("q"), F.lit(t)), q="young adults") is False
    assert one(spark, L.title_like(F.col("q"), F.lit(None).cast("string")), q="one two three four five six") is False


def test_quotes_and_sections(spark):
    quotes = spark.createDataFrame([([("direct_result", "It reduced pain"), ("method", "It reduced pain"), ("direct_result", "We asked")],)], "q array<struct<role:string,text:string>>")
    assert quotes.select(L.result_quotes(F.col("q"), "reduced|increased")).first()[0] == 1
    sections = spark.createDataFrame([([("a", "12345678"), ("b", ""), ("c", "1234567890"), ("d", "x")],)], "s array<struct<name:string,text:string>>")
    got = sections.select(L.section_budget(F.col("s"), 18)).first()[0]
    assert [(r.name, r.text) for r in got] == [("a", "12345678"), ("c", "123456")]


def test_names_and_urls(spark):
    assert one(spark, L.search_name(F.col("n"), ["powder"], ["organic"]), n="Organic  Beet Powder") == "beet"
    assert one(spark, L.search_name(F.col("n"), ["powder"], ["organic"]), n="Powder") == "powder"
    url = L.public_url(F.col("d"), F.lit("7"), F.lit("http://x"))
    assert one(spark, url, d="10.1/a") == "https://doi.org/10.1/a" and one(spark, url, d=" ") == "https://pubmed.ncbi.nlm.nih.gov/7/"


def test_sets_and_rounds(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    a, b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in L.key_sets(a, b, "k").collect()} == {(1, "left"), (2, "both"), (3, "right")}
    pages = [[1, 2], [2, 3], [3], [1], [9]]
    page = lambda k: spark.createDataFrame([(x,) for x in pages[k]], "k int")
    found, why, news = L.expand_rounds(page, "k", 10, 5)
    assert why == "no_new_rows" and news == [2, 1, 0, 0] and found.count() == 3
    assert L.expand_rounds(page, "k", 3, 5)[1:] == ("target_met", [2, 1])
    assert L.expand_rounds(page, "k", 10, 2)[1] == "max_rounds"
