"""Published bundles, reports, table functions, completeness, and files that runs leave."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone import stages
from lodestone.functions import tables
from lodestone.operators import claims, evidence, exports, folds, joins
from lodestone.sources import connectors, datasource, files, sinks


def frame(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("none"))


def test_bundle_is_published_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    assert sinks.manifest(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_bundle(spark, folder, "a")
    out = sinks.write_bundle(folder, {"a": frame(spark, 3), "b": frame(spark, 0)}, notes={"NOTE.md": "é\n"})
    assert sinks.manifest(spark, folder)["tables"] == {"a": 3, "b": 0} and open(out["a"] + "/../NOTE.md").read() == "é\n"
    old = sinks.read_bundle(spark, folder, "a")

    broken = spark.range(2).select(F.raise_error(F.lit("on purpose")).alias("x"))
    with pytest.raises(Exception, match="on purpose"):
        sinks.write_bundle(folder, {"a": frame(spark, 9), "b": broken})
    assert sinks.manifest(spark, folder)["tables"] == {"a": 3, "b": 0} and sinks.read_bundle(spark, folder, "a").count() == 3

    sinks.write_bundle(folder, {"a": frame(spark, 5)})
    assert sinks.manifest(spark, folder)["tables"] == {"a": 5} and old.count() == 3  # a reader that has begun
    assert [r.name for r in sinks.read_bundle(spark, folder, "a").orderBy("id").limit(2).collect()] == ["n0", "n1"]
    sinks.write_bundle(folder, {"a": frame(spark, 6)})
    assert [os.path.basename(v) for v in sinks.versions(spark, folder)] == ["v000000000001", "v000000000002"]
    os.makedirs(f"{folder}/v000000000003")  # a version without a manifest is not there yet, and its number is taken
    assert sinks.manifest(spark, folder)["tables"] == {"a": 6}
    sinks.write_bundle(folder, {"a": frame(spark, 7)}, keep=1)
    assert [os.path.basename(v) for v in sinks.versions(spark, folder)] == ["v000000000004"]


def test_export_bundle(spark, tmp_path):
    names = "seq int, bioactive_type string, bioactive_id string, bioactive_name string, citation_id string, proposed_claim_id string, statement string, support_level string, effect_slug string, effect_label string, effect_description string, description string, tags array<string>, review_notes string, exposure_category string, dose_or_exposure array<string>, concentration_notes string"
    claim = lambda i, name, slug, citation: (i, "nutrient", name.lower(), name, citation, f"p{i}", f"Statement {i}", "human_rct", slug, slug.title(), "d", "short", ["t"], None, "unclear", ["1 mg"], None)
    rows = spark.createDataFrame([claim(1, "Zinc", "sleep", "c1"), claim(2, "Zinc", "sleep", "c1"), claim(3, "Iron", "mood", "c2"), claim(4, "iron", "calm", "c1"), claim(5, "Tin", "x", "c1")], names)
    citations = spark.createDataFrame([("c1", "Title, \"quoted\"", "u", "10.1/x", None, 2001)], "id string, title string, url string, doi string, pmid string, year int")
    lookup = spark.createDataFrame([(1, "e1", "nutrient", "tin", "x", " Known "), (2, "e2", "nutrient", "zn", "sleep", "Slept")], "lookup_seq int, id string, bioactive_type string, bioactive_id string, effect_slug string, effect_label string")
    out = exports.health_evidence(rows, citations, lookup, "2024")
    out["new_entities"] = exports.new_entities(rows, spark.createDataFrame([(" zinc ",)], "bioactive_name string"), "2024")
    paths = exports.write_export(str(tmp_path / "x"), out)
    told = sinks.manifest(spark, str(tmp_path / "x"))
    assert told["tables"] == {"evidence": 2, "new_effects": 1, "exposure": 2, "rejected": 3, "new_entities": 2, "evidence_lines": 2}
    evidence = spark.read.csv(paths["evidence"], header=True, escape='"', multiLine=True)
    assert evidence.columns == exports.EVIDENCE and {(r.bioactive_id, r.effect_slug, r.effect_label) for r in evidence.collect()} == {("zinc", "sleep", "Slept"), ("iron", "calm", "Calm")}
    assert json.loads(evidence.first().sources)[0]["title"] == 'Title, "quoted"'
    assert {(r.bioactive_name, r.resolution_note[:9]) for r in spark.read.csv(paths["new_entities"], header=True).collect()} == {("Iron", "Generated"), ("Tin", "Generated")}
    note = open(told["folder"].removeprefix("file:") + "/IMPORT.md").read()
    assert note.index("`new_effects`") < note.index("`evidence`") < note.index("For review only") < note.index("`rejected`")


def test_public_report(spark, tmp_path):
    validated = spark.createDataFrame([("p2", "c1", "supported", "human_rct", None, []), ("p1", "c9", "supported_with_limitations", "odd_kind", "Said so.", ["small", "short"])], "proposed_claim_id string, citation_id string, verdict string, support_level string, validated_statement string, limitations array<string>")
    proposed = spark.createDataFrame([("p1", "sleep", "s", "positive", " ", None, "supplement_level", "rct", "st1"), ("p2", "Calm | ease", "c", "negative", "adults", "1 mg", "unclear", "rct", "st\n2")], "id string, proposed_effect_label string, proposed_effect_slug string, direction string, population string, dose_or_exposure string, exposure_category string, study_type string, statement string")
    sources = spark.createDataFrame([("c1", "A title", "10.1/x", None, "https://x")], "id string, title string, doi string, pmid string, url string")
    rows = exports.public_report(validated, proposed, sources)
    got = [r.asDict() for r in rows.orderBy("place").collect()]
    assert [(r["place"], r["claim_id"], r["evidence"], r["status"], r["oral_exposure"], r["population"], r["source_title"]) for r in got] == [(1, "p2", "Human RCT", "Supported", "1 mg", "adults", "A title"), (2, "p1", "Odd Kind", "Supported with limitations", "supplement level", "Not reported", "c9")]
    assert json.loads(got[1]["limitations"]) == ["small", "short"]
    paths = exports.write_report(str(tmp_path / "r"), "Zinc", rows, {"validated_claims": 2, "held_claims": 0})
    assert [r.line for r in spark.read.json(paths["table"]).orderBy("place").collect()][0] == "| Calm \\| ease | Negative | adults | 1 mg | Human RCT | st 2 | Supported | A title |"
    text = open(sinks.manifest(spark, str(tmp_path / "r"))["folder"].removeprefix("file:") + "/REPORT.md").read()
    assert text.startswith("## Zinc Human-Health Evidence") and "- Validated claims: 2" in text and spark.read.csv(paths["claims_csv"], header=True, escape='"', multiLine=True).count() == 2


def test_table_functions(spark):
    tables.register(spark)
    rows = [("a", "x", "k", "b", 1.0), ("a", "x", "k", "b", 3.0), ("a", "x", "k", "c", None), ("a", "y", "k", "b", None), (None, "x", "k", "b", -1.0), ("a", " ", "k", "b", 9.0), ("a", None, "k", "b", 9.0), ("a", "x", "k", "b", None)]
    spark.createDataFrame(rows, "who string, tag string, tag_type string, source_bucket string, score double").repartition(3).createOrReplaceTempView("tags_in")
    got = sorted((tuple(r) for r in spark.sql("SELECT * FROM max_tags(TABLE(tags_in), 'who')").collect()), key=str)
    want = spark.table("tags_in").where("trim(tag) <> ''").groupBy("who", "tag", "tag_type", "source_bucket").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and len(got) == 4
    with pytest.raises(Exception, match="lacks nobody"):
        spark.sql("SELECT * FROM max_tags(TABLE(tags_in), 'nobody')")
    got = spark.sql("SELECT * FROM sections('intro\nMethods:\nm1\nm2\n RESULTS \nr', 'methods|results')").collect()
    assert [tuple(r) for r in got] == [(0, None, "intro"), (1, "methods", "m1\nm2"), (2, "results", "r")]
    texts = spark.createDataFrame([(1, "Results\nr"), (2, None)], "id int, t string")
    texts.createOrReplaceTempView("texts_in")
    assert [tuple(r) for r in spark.sql("SELECT id, s.* FROM texts_in, LATERAL sections(t, 'results') s").collect()] == [(1, 0, "results", "r")]


def test_completeness(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, name string")
    answers = spark.createDataFrame([(1, 2, "late"), (1, 1, "first"), (9, 1, "extra"), (None, 1, "null")], "k int, seq int, v string")
    with pytest.raises(ValueError, match="incomplete_answers:extra:9,missing:2"):
        joins.completed(expected, answers, ["k"], ["v"], ["seq"])
    rows, report = joins.completed(expected, answers, ["k"], ["v"], ["seq"], {"v": F.concat(F.lit("no "), F.col("name"))})
    assert {tuple(r) for r in rows.collect()} == {(1, "a", "first", False), (2, "b", "no b", True), (None, "c", "null", False)}
    assert {tuple(r) for r in report.collect()} == {(2, "missing", 0), (9, "extra", 1)}
    strict, none = joins.completed(expected.where("k = 1"), answers.where("k = 1"), ["k"], ["v"], ["seq"])
    assert strict.first().v == "first" and none.count() == 0


def test_coverage_index(spark):
    rows = spark.createDataFrame([(1, "[broken"), (2, '{"a": 1}'), (3, None), (4, '["Zinc ", 5, null, "", true]'), (5, '[" zinc", "Iron", ["x"]]'), (6, '"text"')], "seq int, names string")
    got = {r.key: (r.seq, r.place) for r in joins.coverage_index(rows, "names", ["seq"], ["seq"]).collect()}
    assert got == {"zinc": (4, 0), "5": (4, 1), "true": (4, 4), "iron": (5, 1), '["x"]': (5, 2)}


def test_reroute_with_empty_slugs(spark):
    kind = "array<struct<effect_slug:string,effect_label:string,summary:string,evidence_level:string,score:double,supporting_nutrients:array<string>>>"
    good = lambda slug, level="", score=None: (slug, "Soluble fiber for satiety", "", level, score, ["fiber"])
    rows = [(1, [good("")], None, [], [good("", "Moderate"), good(None, "strong"), good("a", "", 0.9), good("a"), ("b", "plain", "", "", None, ["fiber"])]), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, f"id int, strong_evidence {kind}, medium_evidence {kind}, low_evidence {kind}, {claims.NEGATIVE} {kind}")
    out, log = claims.reroute(df, ["id"])
    got = {r.id: r for r in out.collect()}
    assert [len(got[1][b]) for b in (*claims.REGULAR, claims.NEGATIVE)] == [2, 1, 0, 3] and [len(got[2][b]) for b in (*claims.REGULAR, claims.NEGATIVE)] == [0, 0, 0, 0]
    assert [(r.place, r.effect_slug, r.moved_to) for r in log.collect()] == [(0, "", "medium_evidence"), (1, "a", "strong_evidence")]


def test_files_of_runs(spark, tmp_path):
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in files.read_jsonl(spark, str(lines), "a int").collect()) == [1, 2]
    (tmp_path / "names.jsonl").write_text('{"n": " b"}\n{"n": "a"}\n\n{"n": "b"}\n{"n": " "}\n{"m": "x"}\n')
    assert [r.n for r in files.distinct_names(spark, str(tmp_path / "names.jsonl"), "n").collect()] == ["a", "b"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "array.json"), "a int").count() == 2
    for run, name in (("01_zinc", "audited.json"), ("02_zinc", "validated.json"), ("02_zinc", "audited.json"), ("01_iron_ore", "web_audited.json"), ("01_iron_ore", "validated.json"), ("plain", "validated.json")):
        (tmp_path / "runs" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / run / name).write_text("{}")
    found = files.list_files(spark, str(tmp_path / "runs"), "*.json")
    assert {tuple(r) for r in files.latest_runs(found).collect()} == {("zinc", "02_zinc"), ("iron_ore", "01_iron_ore")}
    assert {(r.parent, r.name) for r in files.preferred(found, ["web_audited.json", "audited.json", "validated.json"]).collect()} == {("01_zinc", "audited.json"), ("02_zinc", "audited.json"), ("01_iron_ore", "web_audited.json"), ("plain", "validated.json")}
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("body\nof one")
    manifest = spark.createDataFrame([("one.txt", "full_text_found"), ("two.txt", "full_text_found"), ("one.txt", "paywalled")], "file_name string, status string")
    assert sorted((r.file_name, r.status, r.body) for r in files.read_texts(spark, str(tmp_path / "texts"), manifest).collect() if r.body) == [("one.txt", "full_text_found", "body\nof one")]
    for folder, text in (("a", "in a"), ("b", "in b")):
        (tmp_path / "texts" / folder).mkdir()
        (tmp_path / "texts" / folder / "two +x.txt").write_text(text)
    paths = spark.createDataFrame([("b/two +x.txt", "full_text_found"), ("two +x.txt", "full_text_found"), ("c/two +x.txt", "full_text_found")], "file_name string, status string")
    assert {r.file_name: r.body for r in files.read_texts(spark, str(tmp_path / "texts"), paths).collect()} == {"b/two +x.txt": "in b", "two +x.txt": "in a", "c/two +x.txt": None}


def test_small_pieces(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.write_jsonl(frame(spark, 2), log, append=True)
    sinks.write_jsonl(frame(spark, 1), log, append=True)
    assert spark.read.json(log).count() == 3
    counts = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 5, "c": 0})], "x map<string,int>, y map<string,int>")
    assert counts.select(sinks.updated_counts(F.col("x"), F.col("y")).alias("z")).first().z == {"a": 1, "b": 5, "c": 0}
    rows = spark.createDataFrame([(1, None, "x"), (2, "own", " "), (3, "", None)], "id int, abstract string, pmid string")
    more = [spark.createDataFrame([(1, "first", None), (3, "", "9")], "id int, abstract string, pmid string"), spark.createDataFrame([(1, "second", "7"), (3, "third", "8")], "id int, abstract string, pmid string")]
    got = {r.id: (r.abstract, r.pmid) for r in connectors.enriched(rows, "id", more, ["abstract", "pmid"]).collect()}
    assert got[1] == ("first", "x") and got[2][0] == "own" and got[3] == ("third", "9")
    order = claims.report_order(spark.createDataFrame([("b", 2), ("A", 3), ("a", 1)], "name string, k int"), "name", "k").collect()
    assert [tuple(r) for r in order] == [("a", 1), ("A", 3), ("b", 2)]
    placed = claims.numbered(spark.range(1000).repartition(7), ["id"], F.expr("id div 10")).collect()
    assert all(r.place == r.id + 1 for r in placed)


def record(folder, source, page, query, payload, kind="json"):
    path = folder / source / str(page)
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{query}.{kind}").write_bytes(payload if isinstance(payload, bytes) else json.dumps(payload).encode())


def test_recorded_answers(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "answers"
    works = lambda *titles: {"message": {"items": [{"title": [t]} for t in titles]}}
    for page in range(3):
        record(folder, "crossref", page, 0, works(f"a{page}", f"b{page}"))
        record(folder, "crossref", page, 1, works(f"c{page}"))
    record(folder, "europe_pmc", 0, 0, {"resultList": {"result": [{"title": "e"}]}})
    record(folder, "europe_pmc", 0, 1, b"", "429")
    record(folder, "pubmed_abstracts", 0, 0, b"<S/>", "xml")
    record(folder, "openalex", 0, 0, b"\xff\xfe broken")
    rows = spark.read.format("recorded_answers").option("path", str(folder)).load()
    assert rows.schema.simpleString() == "struct<source:string,query:int,page:int,status:int,payload:string>" and rows.rdd.getNumPartitions() == 6
    got = {(r.source, r.page, r.query): r.status for r in rows.collect()}
    assert got == {**{("crossref", p, q): 200 for p in range(3) for q in range(2)}, ("europe_pmc", 0, 0): 200, ("europe_pmc", 0, 1): 429, ("pubmed_abstracts", 0, 0): 200, ("openalex", 0, 0): datasource.UNREADABLE}
    run = connectors.candidate_run(rows, 4, 2, 100, 5)
    assert [r.title for r in run["candidates"].where("source = 'crossref'").collect()] == ["a0", "b0", "c0", "a1", "b1", "c1", "a2", "b2", "c2"]
    assert {(r.source, r.code) for r in run["failures"].collect()} == {("europe_pmc", "rate_limited"), ("openalex", "retrieval_error")}
    assert spark.read.format("recorded_answers").option("path", f"file://{folder}").option("sources", "crossref").option("pages", "2").load().count() == 4
    assert spark.read.format("recorded_answers").option("path", str(tmp_path / "nothing")).load().count() == 0

    def taken():
        stream = spark.readStream.format("recorded_answers").option("path", str(folder)).option("sources", "crossref").load()
        stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted({r.page for r in spark.read.schema(datasource.SCHEMA).json(str(tmp_path / "out")).collect()}), spark.read.schema(datasource.SCHEMA).json(str(tmp_path / "out")).count()

    assert taken() == ([0, 1, 2], 6)
    record(folder, "crossref", 3, 0, works("d"))
    record(folder, "crossref", 5, 0, works("after a gap"))
    assert taken() == ([0, 1, 2, 3], 7)


def test_short_quotes(spark):
    rng = random.Random(4)
    letters = "abcé 漢"
    bodies = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, ""), (62, "ﬁne de- tail ab")]
    quotes = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 4, 5]))) for _ in range(80)} | {"fine detail", "tail ab", " "})
    q, b = spark.createDataFrame(list(enumerate(quotes)), "qid int, q string"), spark.createDataFrame(bodies, "bid int, b string")
    got = {(r.bid, r.qid) for r in joins.grounded(q, b, "qid", "q", "bid", "b").collect()}
    plain = lambda t: re.sub(r"(?<=[^\W_])-\s*(?=[^\W_])", "", " ".join((t or "").replace("ﬁ", "fi").split()))
    assert got == {(i, k) for i, t in bodies if t is not None for k, w in enumerate(quotes) if w.strip() and plain(w) in plain(t)}
    assert joins.grounded(q.limit(0), b, "qid", "q", "bid", "b").count() == 0


def test_packet_reports(spark):
    rows = spark.createDataFrame([(1, "own text", "", '[{"tag": "t", "confidence": 0.4}, {"x": 1}]', "[]"), (2, "own", "bad", "[broken", "not a list"), (3, None, None, None, None)], "k int, positive string, negative string, positive_tags string, negative_tags string")
    made = [(1, 1, "beneficial", "First  one", "a", 0.5), (1, 2, "beneficial", None, "b", 0.9), (1, 3, "beneficial", "Second!", "a", 0.8), (1, 4, "beneficial", "x" * 60, "c", 0.1), (1, 5, "beneficial", "Short.", "c", 0.1), (1, 6, "mixed", "No side", "d", 0.1), (2, 1, "harmful", "Harm", "h", 0.7)]
    claims_ = spark.createDataFrame(made, "k int, seq int, direction string, sentence string, tag string, confidence double")
    out, rejected = evidence.packet_reports(rows, claims_, "k", most=30)
    got = {r.k: r for r in out.collect()}
    tags = lambda x: [(t.tag, t.confidence) for t in x]
    assert got[1].positive == "First one. Second!" and tags(got[1].positive_tags) == [("a", 0.8), ("b", 0.9), ("c", 0.1)] and got[1].negative == "" and got[1].negative_tags == []
    assert got[2].positive == "own" and got[2].positive_tags == [] and got[2].negative == "Harm." and tags(got[2].negative_tags) == [("h", 0.7)]
    assert got[3].positive == "" and got[3].positive_tags == [] and [(r.k, r.direction, r.type) for r in rejected.collect()] == [(1, "mixed", "unsupported_direction_for_report_side")]
    said = spark.createDataFrame([("S", "1 mg", None, "natural_food_level", "few"), ("S", " ", "", "unclear", None)], "s string, d string, p string, f string, c string").select(evidence.claim_sentence(*(F.col(c) for c in "sdpfc")).alias("x")).collect()
    assert [r.x for r in said] == ["S (dose/exposure: 1 mg; evidence form: natural food level; caveat: few).", "S"]


def test_more_stages(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{source}/{name}.parquet")
    put("pairs", [("a", "b"), ("b", "c")], "alias string, target string")
    put("payloads", [(1, '{"x": ["a", "b"], "link": "no"}'), (2, "{")], "source_id int, payload string")
    put("expected", [(1,), (2,)], "key int")
    put("answers", [(1, 1, "v"), (3, 1, "w")], "key int, seq int, value string")
    assert stages.respond(spark, {"tool": "aliases", "input": {"source": source, "target": target}}) == {"ok": True, "output": {"roots": 2}}
    assert stages.run_stage(spark, "read_payloads", source, target) == {"texts": 2}
    assert {r.text for r in stages.read_table(spark, target, "texts").collect()} == {"a b", None}
    strict = stages.respond(spark, {"tool": "complete", "input": {"source": source, "target": target}})
    assert not strict["ok"] and strict["error"]["message"] == "incomplete_answers:extra:3,missing:2"
    assert stages.run_stage(spark, "complete", source, target, fallback="none") == {"rows": 2, "report": 2}
    assert {"collect", "reroute", "report", "packet"} <= set(stages.respond(spark, {"tool": "list"})["output"])


def test_attempts_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("k"), F.col("id").alias("at"))
    before = spark.createDataFrame([("hot", 7)], "k string, attempt int")
    one = folds.attempts(rows, "k", ["at"], before)
    split = folds.attempts(rows.repartition(5), "k", ["at"], before, F.expr("at div 100"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, split.select(*one.columns).collect()))
