"""Operators, sources, sinks and streams on small tables with known answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dedupe, documents, folds, joins, rules
from lodestone.sources import connectors, files, sinks
from lodestone.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


def test_text_functions(spark):
    c = F.col("x")
    assert one(spark, T.collapse(c), x=" a  b\u0085c\n") == "a b c"
    assert one(spark, T.dehyphenate(c), x="nutri- tion x - y co-op") == "nutrition x - y coop"
    assert one(spark, T.expand_ligatures(c), x="ﬁne ﬄ") == "fine ffl"
    assert one(spark, T.slugify(c, "_", "none"), x="--") == "none"
    assert one(spark, T.slugify(c), x="Vitamin B-12 (oral)") == "vitamin-b-12-oral"
    assert one(spark, T.normalize_doi(c), x="https://doi.org/10.1/AbC ") == "10.1/abc"
    assert one(spark, T.year_of(c), x="published 2019-05") == 2019
    assert one(spark, T.truncate_words(c, 12), x="alpha beta gamma") == "alpha..."
    assert one(spark, T.truncate_words(c, 40), x="alpha  beta") == "alpha beta"
    assert one(spark, T.uuid5(str(uuid.NAMESPACE_URL), c), x="name|é") == str(uuid.uuid5(uuid.NAMESPACE_URL, "name|é"))
    assert one(spark, T.parse_number(c), x="x1") is None and one(spark, T.parse_number(c), x=" 1.5 ") == 1.5
    assert one(spark, T.first_number(c), x="about -2.5 mg") == -2.5
    assert one(spark, T.format_amount(c), x=2.0) == "2" and one(spark, T.format_amount(c), x=2.50) == "2.5"
    assert one(spark, T.strip_negative_clauses(c), x='a AND NOT ("b" OR c) d NOT "e f"') == "a d"
    assert one(spark, T.json_strings(c), x="") == [] and one(spark, T.json_strings(c), x="plain") == ["plain"] and one(spark, T.json_strings(c), x='["a","b"]') == ["a", "b"]
    assert one(spark, T.contains_word(c, ["ring"]), x="a ring b") and not one(spark, T.contains_word(c, ["ring"]), x="string")
    assert one(spark, T.clamp(c, 0.35, 0.95), x=2.0) == 0.95


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "a", "", "x"), (2, "a", "p", "y"), (3, "b", None, "z")], "ord int, k string, v string, w string")
    got = {r.key: r for r in dedupe.coalescing(df, F.col("k"), "ord", ["v", "w"]).collect()}
    assert (got["a"].ord, got["a"].v, got["a"].w, got["a"].n_rows) == (1, "p", "x", 2) and got["b"].v is None
    assert [tuple(r) for r in dedupe.first_wins(df, ["k"], ["ord"]).orderBy("k").collect()] == [(1, "a", "", "x"), (3, "b", None, "z")]
    assert dedupe.first_wins(df, ["k"], ["ord"], last=True).orderBy("k").first().ord == 2
    assert [r.ord for r in dedupe.conflicts(df, "k", ["ord"], ["v"]).collect()] == [2]
    with pytest.raises(ValueError, match="duplicate_rows:a"):
        dedupe.require_unique(df, "k", "rows")


def test_joins(spark):
    q = spark.createDataFrame([(1, "one two three four five six"), (2, "ﬁne de- tail"), (3, "absent words here now then too"), (4, "")], "qid long, q string")
    b = spark.createDataFrame([(10, "x one two three four five six y"), (11, "one two  three four five\nsix"), (12, "a fine detail"), (13, None)], "bid long, b string")
    got = {tuple(r) for r in joins.grounded(q, b, "qid", "q", "bid", "b").collect()}
    assert got == {(10, 1, "exact"), (11, 1, "whitespace"), (12, 2, "normalized")}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("m", "b"), ("m", "n"), (None, "q"), ("q", " "), ("self", "self")], "alias string, target string")
    assert {tuple(r) for r in joins.closure(pairs).collect()} == {("a", "c", 2, "resolved"), ("b", "c", 1, "resolved"), ("m", "c", 2, "ambiguous"), *((k, None, None, "cycle") for k in ("x", "y", "z", "self"))}
    base = spark.createDataFrame([(1, "n"), (2, "m")], "k int, v string")
    over = spark.createDataFrame([(1, ""), (2, "o")], "k int, v string")
    assert {tuple(r) for r in joins.overlay(base, "k", [over], ["v"]).collect()} == {(1, "n"), (2, "o")}


def test_folds(spark):
    df = spark.createDataFrame([([["a", "b", "c"], ["c", "a", "d"], ["d", "e", "f"]],)], "b array<array<string>>")
    assert df.select(folds.quota_fold(F.col("b"), 2)).first()[0] == [["a", "b"], ["c", "d"], ["e", "f"]]
    rows = spark.createDataFrame([(1, 1, "aaa"), (1, 2, "bbb"), (1, 3, "c"), (1, 4, None)], "g int, o int, t string")
    assert [r.o for r in folds.budget_prefix(rows, "g", "o", "t", 7).orderBy("o").collect()] == [1, 2]
    rounds = spark.createDataFrame([(1, 3), (2, 3), (3, 2), (4, 5)], "r int, total int")
    assert [(r.new, r.zero_rounds) for r in folds.deltas(rounds, "r", "total").orderBy("r").collect()] == [(3, 0), (0, 1), (0, 2), (3, 0)]
    before = spark.createDataFrame([("s", 4)], "k string, attempt int")
    assert [r.attempt for r in folds.attempts(spark.createDataFrame([("s", 1), ("s", 2)], "k string, o int"), "k", ["o"], before).orderBy("o").collect()] == [5, 6]
    text = spark.createDataFrame([("aaaaa foo bar bb", ["foo", "bar"])], "t string, w array<string>")
    best = text.select(folds.best_chunk(F.col("t"), F.col("w"), 10, 5).alias("c")).first().c
    assert best.score == 2 and "foo" in best.chunk and "bar" in best.chunk


def test_documents(spark):
    page = "<html><head><meta name='description' content='About it'></head><nav>menu menu menu menu menu</nav><p>A long visible sentence &amp; more.</p><script>x()</script><p>short</p></html>"
    assert documents.visible(page) == "About it A long visible sentence & more."
    assert documents.visible(None) is None and documents.visible("") is None
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(documents.from_inverted_index(F.col("m"))).first()[0] == "a b a"
    assert one(spark, documents.cut_at_heading(F.col("x"), "References", 5), x="long text\nReferences\n1") == "long text"
    assert one(spark, documents.cut_at_heading(F.col("x"), "References", 5), x="no heading") == "no heading"


def test_rules(spark):
    df = spark.createDataFrame([(5.0, "g", "mg"), (5.0, "kcal", "mg")], "a double, u string, t string")
    assert [r[0] for r in df.select(rules.converted(F.col("a"), F.col("u"), F.col("t"))).collect()] == [5000.0, 5.0]
    assert one(spark, rules.accepted(F.col("r"), F.lit(False), F.lit(None), F.lit("human")), r="oral") is True
    assert one(spark, rules.accepted(F.col("r"), F.lit(None), F.lit("natural"), F.lit("animal")), r="oral") is False
    assert one(spark, rules.dose_band(F.col("x"), F.lit(10.0)), x=0.5).band == "trace"


def test_files(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes('﻿id,name\r\n1,"two\nlines"\r\n2,\r\n'.encode())
    got = files.read_csv_numbered(spark, str(p)).collect()
    assert [(r.id, r.name, r._csv_row_number) for r in got] == [("1", "two\nlines", 2), ("2", "", 3)]
    assert files.read_csv(spark, str(p), limit=1).count() == 1
    with pytest.raises(ValueError, match="columns_missing:age"):
        files.read_csv(spark, str(p), ["id", "age"])
    d = tmp_path / "d.json"
    d.write_text('{"decisions": [{"id": "a", "v": "1"}, {"v": "2"}, {"id": "a", "v": "3"}]}')
    assert [(r.id, r["values"]["v"]) for r in files.read_decisions(spark, str(d), "id").collect()] == [("a", "3")]
    d.write_text('[{"id": "b", "v": "1"}]')
    assert [(r.id, r["values"]["v"]) for r in files.read_decisions(spark, str(d), "id").collect()] == [("b", "1")]
    with pytest.raises(PermissionError):
        files.confined("/root/x", "../y")
    x = spark.createDataFrame([("<a>one <b>two</b></a>",), ("<a>",), (None,)], "x string")
    assert [r[0] for r in x.select(files.xml_text(F.col("x"))).collect()] == ["one two", None, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", [1, 2]), (1, None, [])], "id int, name string, l array<int>")
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "name", "l"], ["id"])
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c")).orderBy("id").collect()] == [("1", "", "[]"), ("2", "b", "[1,2]")]
    sinks.write_bundle(str(tmp_path / "bundle"), {"rows": df})
    assert sinks.manifest(spark, str(tmp_path / "bundle"))["tables"] == {"rows": 2}
    nested = spark.createDataFrame([(1, [("x", [1, 2])])], "id int, c array<struct<n:string,l:array<int>>>")
    assert tuple(sinks.flat(nested, "c").first()) == (1, "x", "1;2")


def test_connectors(spark):
    rows = [
        ("openalex", 0, 0, 200, '{"results":[{"doi":"https://doi.org/10.1/A","display_name":"T","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0]}}]}'),
        ("crossref", 0, 0, 200, '{"message":{"items":[{"DOI":"10.2/B","title":["U"],"issued":{"date-parts":[[2019,1]]}}]}}'),
        ("europe_pmc", 1, 0, 403, ""),
    ]
    answers = spark.createDataFrame(rows, "source string, query int, page int, status int, payload string")
    got = {(r.source, r.doi, r.title, r.year, r.abstract) for r in connectors.all_citations(answers, 4, 2).collect()}
    assert got == {("openalex", "10.1/a", "T", 2020, "a b"), ("crossref", "10.2/b", "U", 2019, None)}
    assert [r.code for r in connectors.failures(answers).collect()] == ["blocked"]


def test_state_stream(spark, tmp_path):
    src = tmp_path / "src"
    schema = "id int, ts int, status string"
    for k, rows in enumerate([[(1, 1, "queued"), (2, 1, "queued")], [(1, 2, "done")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        events.run_state(stream, str(tmp_path / "state"), "id", ["ts"]).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"state/v{k}")).count() == 2
    assert {(r.id, r.status) for r in spark.read.parquet(str(tmp_path / "state/v1")).collect()} == {(1, "done"), (2, "queued")}


def test_places(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate([("a", 5), ("a", 1), (None, 3), ("b", 2), ("a", 5), ("a", 12), (None, 30), ("a", 30)])]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = {r.i: r.place for r in folds.places(df, ["k"], ["t", "i"], F.floor(F.col("t") / 10)).collect()}
    want = {r[2]: 1 + sum(o[0] == r[0] and (o[1], o[2]) < (r[1], r[2]) for o in rows) for r in rows}
    assert got == want
    assert sorted(r.place for r in folds.places(df, [], ["t", "i"], F.floor(F.col("t") / 10)).collect()) == list(range(1, 9))
    assert folds.places(df.limit(0), ["k"], ["t"], F.col("t")).count() == 0


def test_renamed_without_an_end(spark):
    names = ["a", "a_generated", "b", "b_generated", "b_generated_3", "c", "d", "d_generated_1", "d_generated_2"] + [f"a_generated_{k}" for k in range(2, 81)]
    taken = spark.createDataFrame([(n,) for n in names], "slug string")
    new = spark.createDataFrame([(n, k) for k, n in enumerate(["a", "b", "c", "d", "e", "a_generated"])], "slug string, k long")
    got = {r.slug: r.new_slug for r in joins.renamed(new, "slug", taken, "k").collect()}
    assert got == {"a": "a_generated_81", "b": "b_generated_2", "c": "c_generated", "d": "d_generated", "a_generated": "a_generated_generated"}
