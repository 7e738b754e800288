"""Screening, retrieval, validation and assembly: rules, nulls, ties and empty tables."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.operators import assembly as A, evidence as E


def test_screening(spark):
    rows = spark.createDataFrame([(1, "x", True, "ab", "s"), (2, "reject", True, " ", "s"), (3, None, True, None, None), (4, "x", None, "", "")], "k int, relevance_class string, accepted boolean, abstract string, summary string")
    said = {c: F.col(c) for c in ("relevance_class", "accepted")}
    got = {r.k: (r.ok, r.c.label, r.c.text) for r in rows.select("k", E.accepts(said).alias("ok"), E.context(F.col("abstract"), F.col("summary")).alias("c")).collect()}
    assert got == {1: (True, "abstract", "ab"), 2: (False, "page_summary", "s"), 3: (True, "missing_context", None), 4: (False, "missing_context", None)}


def test_verdicts(spark):
    schema = "k int, answer string, entity string, g int, s int, statement string, scope string, l array<string>"
    rows = [
        (1, "supported", "exact_or_alias", 2, 1, " says ", "adults", ["a"]), (2, "supported", "different_species", 1, 1, "says", "adults", None), (3, "supported_with_limitations", "exact_or_alias", 1, 0, "says", "", []),
        (4, "supported", "exact_or_alias", 0, 0, "says", "adults", None), (5, "unsupported", None, None, None, None, None, None), (6, None, "exact_or_alias", 1, 1, "says", "adults", None),
    ]
    columns = [F.col(c) for c in ("answer", "entity", "g", "s", "statement", "scope", "l")]
    got = {r.k: r.v for r in spark.createDataFrame(rows, schema).select("k", E.verdict(*columns).alias("v")).collect()}
    assert got[1] == (True, "supported", "says", "adults", ["a"])
    assert got[2][:2] == (False, "unsupported") and got[2].limitations == [E.LIMITATIONS["entity"]]
    assert got[3][:2] == (False, "quote_not_found") and got[3].scope == E.NO_SCOPE and got[3].limitations == [E.LIMITATIONS["scope"], E.LIMITATIONS["substantive"]]
    assert got[4].limitations == [E.LIMITATIONS["grounded"]]
    assert got[5] == (False, "unsupported", E.NO_STATEMENT, E.NO_SCOPE, [])
    assert got[6].accepted is False and got[6].verdict is None


def test_retrieval(spark):
    attempts = spark.createDataFrame([(1, 1, "paywalled"), (1, 2, "found"), (1, 3, "found"), (2, 1, "odd"), (2, 2, "retrieval_error"), (3, 1, None)], "k int, tier int, status string")
    got = {r.k: (r.status, r.tier, r.n_attempts) for r in E.outcomes(attempts, "k", ["tier"]).collect()}
    assert got == {1: ("found", 2, 3), 2: ("retrieval_error", 2, 2), 3: (None, 1, 1)}
    assert E.outcomes(attempts.limit(0), "k", ["tier"]).count() == 0
    places = spark.createDataFrame([(1, "b", 1, "submittedVersion", True, 0), (1, "a", 1, "publishedVersion", False, 1), (1, "b", 0, None, None, 5), (1, " ", 0, None, True, 0)], "k int, url string, tier int, version string, is_pdf boolean, idx int")
    assert [(r.rank, r.url) for r in E.locations(places, "k").orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    tasks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    records = spark.createDataFrame([(1, "found", "Buy ACCESS now"), (2, "found", "text"), (3, "paywalled", None)], "k int, status string, text string")
    for retry, third in ((False, "keep"), (True, "retry")):
        assert {r.k: r.action for r in E.resumed(tasks, records, "k", "status", "text", "buy access", retry).collect()} == {1: "reclassify", 2: "keep", 3: third, 4: "fetch"}
    queue = spark.createDataFrame([(1, "awaiting_file"), (2, "awaiting_file"), (3, "awaiting_file"), (4, "done")], "k int, status string")
    files = spark.createDataFrame([(1, True), (1, False), (2, False)], "k int, readable boolean")
    assert {r.k: r.outcome for r in E.supplied(queue, files, "k").collect()} == {1: "ingested", 2: "failed", 3: "paywalled", 4: "unchanged"}
    assert [r[0] for r in spark.createDataFrame([(401,), (403,), (500,), (None,)], "s int").select(E.http_failure(F.col("s"))).collect()] == ["paywalled", "blocked", "retrieval_error", "retrieval_error"]


def test_spans():
    assert E.without_span("An Ef-\n fect  of Zinc. Body of the eﬀect of zinc here", "effect of zinc") == "An  . Body of the   here"
    assert E.without_span(None, "x") is None and E.without_span("", "x") == "" and E.without_span("abc", None) == "abc" and E.without_span("abc", " ") == "abc"
    assert E.without_span("low-dose iron", "lowdose") == "low-dose iron"


@settings(max_examples=200, deadline=None)
@given(st.text("ab -\n", max_size=30), st.text("ab ", min_size=1, max_size=4))
def test_spans_against_plain_replacement(text, span):
    got, wanted = E.without_span(text, span), " ".join(span.split())
    plain = " ".join(re.sub(r"(?<=[ab])-\s+(?=[ab])", "", got or "").split())
    assert not wanted or wanted not in plain
    left = iter(text)
    assert all(c in left for c in got if c != " ")


def test_text_rules(spark):
    rows = spark.createDataFrame([("Zinc CURES all common colds.", "No caution needed", "claim"), (None, "avoid it", None)], "t string, s string, c string")
    claims = F.array(F.lit("zinc cures all common"), F.lit("short"), F.lit(None))
    got = rows.select(E.mentions(F.col("t"), claims), E.cautionary(F.col("s"), "(?i)no caution", "(?i)avoid|caution"), E.statement(F.col("c"), [F.lit(""), F.lit(" d ")])).collect()
    assert [tuple(r) for r in got] == [(True, False, "claim; d"), (False, True, "d")]


def test_assembly(spark):
    rows = spark.createDataFrame([("g", "reuse", 1, "a", "x"), ("g", "direct", 3, "b", "y"), ("g", "direct", 2, "c", "x"), (" ", "direct", 4, "d", "x"), (None, "direct", 5, "e", "x"), ("g", "skip", 0, "f", "z")], "g string, kind string, o int, name string, rel string")
    assert [tuple(r) for r in A.rollup(rows, "g", "kind", "o", ["name"], "rel", "direct", "reuse").collect()] == [("g", 2, 1, "c", ["x", "y"])]
    taxa = spark.createDataFrame([("a", 1, "A", "2024", ""), ("b", 2, "B", "", "2025"), ("c", 3, "C", None, None)], "slug string, o int, label string, created string, updated string")
    got = {r.slug: tuple(r)[1:] for r in A.canonical_rows(taxa, "slug", F.when(F.col("slug") == "b", "a").otherwise(F.col("slug")), "o", ["label"], "created", "updated").collect()}
    assert got == {"a": ("A", "2024", "2025", 2), "c": ("C", None, None, 1)}
    votes = spark.createDataFrame([(1, "x", 0.5, 2), (1, "y", 0.5, 1), (1, "z", None, 0), (2, "w", None, 0)], "k int, v string, s double, o int")
    assert {r.k: r.v for r in A.most_confident(votes, "k", "v", "s", "o").collect()} == {1: "y", 2: "w"}
    expected, answers = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (9, "x")], "k int, v string")
    assert {r.k: (r.v, r.is_fallback) for r in A.completed(expected, answers, "k", "v", F.lit("none")).collect()} == {1: ("a", False), 2: (None, False), 3: ("none", True)}
    new = spark.createDataFrame([(1, "Zinc"), (2, " zinc"), (3, "Iron"), (4, None), (5, " ")], "o int, name string")
    assert [r.o for r in A.identities(new.where("o = 3"), new, "name", "o").collect()] == [1]
    empty = spark.createDataFrame([], "a array<string>, b array<string>")
    assert tuple(A.bucket_totals(empty, ["a", "b"]).first()) == (0, 0, 0, 0)
    folded = spark.createDataFrame([(["a", "a", "b", "c"], ["c", "d", "e"], None)], "a array<string>, b array<string>, c array<string>")
    assert folded.select(A.limited_fold(F.col("a"), [F.col("b"), F.col("c")], 2)).first()[0] == [["a", "b"], ["d"], []]


def test_profiles(spark):
    rows = spark.createDataFrame([(1, '{"k": 5, "na": "0", "x": 3, "zn": "abc"}'), (2, None), (3, "no json"), (4, '{"zn": "NaN", "k": 1e3}')], "id int, j string")
    aliases = spark.createDataFrame([("k", "Potassium", "mg"), ("na", "Sodium", "mg"), ("zn", "Zinc", "mg")], "source_key string, name string, unit string")
    references = spark.createDataFrame([("ZINC", 10.0)], "name string, reference double")
    assert sorted(tuple(r) for r in A.profiles(rows, "id", "j", aliases, references).collect()) == [(1, "k", "Potassium", 5.0, "mg", None), (4, "k", "Potassium", 1000.0, "mg", None)]
