"""Papers, resolvers, connectors, exports, stages: known answers and round trips."""

import gzip
import io
import json
import tarfile
import zlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import Row, functions as F

from lodestone import stages
from lodestone.functions import text as T
from lodestone.operators import assembly, claims, documents, evidence, exports, nested, papers
from lodestone.sources import connectors, files, http, resolvers, sinks
from lodestone.streaming import events


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column).first()[0]


def test_amounts_follow_general_format(spark):
    values = [1234.5678, 0.0001, 0.00012345678, 0.00001, 1234567.5, 0.1 + 0.2, -2.5, 99999.96, 1e-7, 123456.7, -0.00002]
    want = [str(int(round(v, 6))) if round(v, 6).is_integer() else f"{round(v, 6):g}" for v in values]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.format_amount(F.col("v"))).collect()]
    assert got == want


def test_amounts_are_rounded_by_their_millionfold(spark):
    values = [67.35 * 0.00001, 12.45 * 0.00001, 204.45 * 0.00001, -67.35 * 0.00001, 1.5, 1e12 + 0.25]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(T.format_amount(F.col("v"))).collect()]
    assert got == ["0.000674", "0.000124", "0.002044", "-0.000674", "1.5", "1e+12"]


def test_names_and_references(spark):
    c = F.col("x")
    assert one(spark, T.name_key_folded(c), x="Crème_Brûlée  №2") == "creme brulee no2" and one(spark, T.name_key_folded(c, True), x="Æther É") == "ther e"
    assert one(spark, T.bare_key(c), x="B-12 (Oral)") == "b12oral" and one(spark, T.text_of_markup(c), x="<b>a &amp; b</b>&#233; c") == "a & b é c"
    assert T.utc_text(datetime(2024, 1, 2, 3, 4, 5, 600000, UTC)) == "2024-01-02T03:04:05.600000+00:00" and T.run_id(datetime(2024, 1, 2, tzinfo=UTC)) == "2024-01-02T00-00-00+00-00"
    assert len({r[0] for r in spark.range(20).select(T.random_uuid()).collect()}) == 20


def test_visible_text_keeps_page_order():
    page = "<p>First visible sentence here</p><meta property='og:description' content='In &amp; out'><svg><p>hidden picture of some words</p></svg><meta name=twitter:description content=Third><form><nav>hidden words in a menu</nav>still hidden words here</form><p>Last visible sentence here"
    assert documents.visible(page) == "First visible sentence here In & out Third Last visible sentence here"


def test_backfill_and_body(spark):
    rows = spark.createDataFrame([("a", None, "<p>A sentence of the page itself</p>"), (None, " ", "<p>A sentence of the page itself</p>"), (None, "s", "<p>x</p>"), (None, None, None)], "abstract string, page_summary string, page string")
    assert [r.page_summary for r in documents.backfilled(rows, "page").collect()] == [None, "A sentence of the page itself", "s", None]
    page = "<nav>menu</nav><p>ab</p><p>c</p><p>ab</p>"
    assert one(spark, documents.body_text(F.col("x")), x=page) == "ab ab"
    assert one(spark, documents.article_body(F.col("x"), ["methods"], ["denied"]), x=page) is None
    assert one(spark, documents.article_body(F.col("x"), ["methods", "results"], ["denied"]), x="<p>" + "methods results " * 200 + "</p>").startswith("methods results")


def test_spans_removed_in_one_pass():
    text = "Zinc helps. ZINC  helps. Body zi-\nnc helps and more. zinc help"
    assert evidence.without_span(text, "zinc helps.") == "Body zi-\nnc helps and more. zinc help"
    assert evidence.without_span("aab ab b", "ab") == "a" + " " * 4 + "b" and evidence.without_span("x abab y", "ab") == "x" + " " * 4 + "y"
    assert len(evidence.without_span("word " * 50_000, "nothing here")) == 250_000


def prose(n):
    return ("Participants consumed the supplement and outcomes were measured. " * (n // 60 + 1))[:n]


def test_resolver_order_and_distinct(spark):
    sources = spark.createDataFrame([(1, "https://doi.org/10.3390/nu12030456", "PMC99"), (2, None, None)], "source_id long, doi string, pmcid string")
    place = lambda **k: {"url_for_pdf": None, "url_for_landing_page": None, "version": None} | k
    answers = [
        (1, "unpaywall", json.dumps({"is_oa": True, "best_oa_location": place(url_for_pdf="https://r.org/a.pdf", version="acceptedVersion"), "oa_locations": [place(url_for_pdf="https://p.org/v.pdf", version="publishedVersion"), place(url="ftp://x")]})),
        (1, "openalex", json.dumps({"open_access": {"oa_url": "https://p.org/v.pdf", "oa_status": "gold"}, "primary_location": {"landing_page_url": "https://pmc.org/articles/PMC7", "pdf_url": "https://o.org/f.pdf"}})),
        (1, "crossref", json.dumps({"license": [{"URL": "https://l"}], "link": [{"URL": "https://api.elsevier.com/x"}, {"URL": "https://onlinelibrary.wiley.com/doi/full-xml/1"}]})),
        (2, "crossref", json.dumps({"link": [{"URL": "https://z.org"}]})), (1, "unpaywall", "{broken"),
    ]
    got = resolvers.resolved(sources, spark.createDataFrame(answers, "source_id long, service string, payload string")).orderBy("source_id", "rank").collect()
    base = "https://www.mdpi.com/2072-6643/12/3/456"
    assert [(r.url, r.method) for r in got] == [
        ("pmc:PMC99", "pmc_oa_xml"), (base, "publisher_page"), (f"{base}/xml", "mdpi_xml"), (f"{base}/pdf?download=1", "mdpi_pdf"), (f"{base}/pdf", "mdpi_pdf"), ("https://p.org/v.pdf", "unpaywall_pdf"), ("https://r.org/a.pdf", "unpaywall_pdf"),
        ("pmc:PMC7", "pmc_oa_xml"), ("https://o.org/f.pdf", "openalex_pdf"), ("https://onlinelibrary.wiley.com/doi/full-xml/1", "wiley_full_xml"),
    ]
    assert got[0].source_id == 1 and got[-1].license == "https://l"


def test_json_reach_and_flatten(spark):
    doc = json.dumps({"a": {"b": [1, {"c": "x  y"}]}, "coredata": {"hidden": ["no", {"n": "no"}]}, "t": ["one", " ", {"k:": 'q"uote: '}], "link": "no"})
    assert one(spark, resolvers.reached(F.col("x"), "$.a.b[1].c"), x=doc) == "x  y" and one(spark, resolvers.reached(F.col("x"), "$.z"), x=doc) is None and one(spark, resolvers.reached(F.col("x"), "$.a"), x="{") is None
    df = spark.createDataFrame([(1, doc), (2, "{"), (3, None), (4, '"alone"'), (5, "[]")], "id long, x string")
    assert {r.id: r.text for r in nested.json_text(df, "id", "x").collect()} == {1: 'x y one q"uote:', 2: None, 3: None, 4: "alone", 5: ""}


def test_connectors(spark):
    summary = {"result": {"uids": ["7", "8"], "7": {"title": "T7", "pubdate": "2019 May", "articleids": [{"idtype": "pii", "value": "p"}, {"idtype": "doi", "value": "10.1/A"}]}, "8": {"title": "", "pubdate": "x", "articleids": []}}}
    xml = "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Abstract><AbstractText>One <i>two</i></AbstractText><AbstractText>three</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>"
    web = {"data": [{"title": "W", "url": "https://w", "description": "d"}, {"title": "", "url": "https://n"}]}
    epmc = {"resultList": {"result": [{"id": "1", "doi": "10.1/e", "title": "E", "pubYear": "2001", "abstractText": "a"}]}}
    alex = {"results": [{"id": "o", "doi": None, "display_name": "O", "publication_year": 2000, "abstract_inverted_index": {"b": [1], "a": [0]}}]}
    s2 = {"data": [{"paperId": "p", "title": "S", "year": 1999, "abstract": None, "externalIds": {"DOI": "10.1/s"}}]}
    rows = [("pubmed", 0, 0, 200, json.dumps(summary)), ("pubmed_abstracts", 0, 0, 200, xml), ("firecrawl", 0, 0, 200, json.dumps(web)), ("europe_pmc", 0, 0, 200, json.dumps(epmc)), ("europe_pmc", 1, 0, 429, None), ("europe_pmc", 2, 0, 200, json.dumps(epmc)), ("openalex", 0, 0, 200, json.dumps(alex)), ("semantic_scholar", 0, 0, 200, json.dumps(s2)), ("firecrawl", 0, 1, 200, json.dumps(web))]
    answers = spark.createDataFrame(rows, "source string, query int, page int, status int, payload string")
    got = {(r.source, r.query, r.pos): r for r in connectors.candidate_page(answers, 0, 9, 3)[0].collect()}
    assert set(got) == {("pubmed", 0, 0), ("pubmed", 0, 1), ("firecrawl", 0, 0), ("europe_pmc", 0, 0), ("openalex", 0, 0), ("semantic_scholar", 0, 0)}
    first = got["pubmed", 0, 0]
    assert (first.doi, first.pmid, first.title, first.year, first.abstract) == ("10.1/a", "7", "T7", 2019, "One two three") and got["pubmed", 0, 1].title == "PubMed record 8" and got["openalex", 0, 0].abstract == "a b"
    kept, failed = connectors.candidate_page(answers, 0, 9, 3, "primary")
    assert {r.source for r in kept.collect()} == {"pubmed", "europe_pmc", "openalex"} and [(r.source, r.query, r.code) for r in failed.collect()] == [("europe_pmc", 1, "rate_limited")]
    few = kept.where("source = 'pubmed'")
    more = connectors.candidate_page(answers, 0, 9, 3, "fallback")[0]
    assert connectors.refilled(few, more, "title", 3).count() == 3 and connectors.refilled(few, more, "title", 2).count() == 2


def test_files(spark, tmp_path):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as archive:
        for name, text in (("p/longer.nxml", "<a>no</a>"), ("p/x.nxml", "<a>yes</a>"), ("x.txt", "t")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    stream = zlib.compress(rb"BT (Hello \(all\)) Tj T* [(wor) -20 (ld)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\nstream\n" + stream + b"\nendstream\nendobj"
    df = spark.createDataFrame([(raw.getvalue(), pdf), (b"junk", b"%PDF-1.4 nothing"), (gzip.compress(b"x"), b"no")], "t binary, p binary")
    got = df.select(files.archived_article(F.col("t")).alias("t"), files.pdf_text(F.col("p")).alias("p")).collect()
    assert [r.t for r in got] == ["<a>yes</a>", None, None]
    assert [(r.p.text, r.p.status) for r in got] == [("Hello (all) world", "pdf"), (None, "pdf_parse_failed"), (None, "pdf_parse_failed")]
    (tmp_path / "zinc.json").write_text(json.dumps({"nutrient": {"id": "n1", "name": "Zinc"}, "citations": [{"id": "c1", "title": "T"}]}))
    assert [(r.subject_id, r.id) for r in files.demo_corpus(spark, str(tmp_path), " zinc").collect()] == [("n1", "c1")]


def test_fetcher():
    clock, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 2))
        clock[0] += s

    def send(url):
        calls.append(url)
        return (429, {"Retry-After": "3"}, None) if len(calls) < 3 else (200, {}, b"ok")

    f = http.Fetcher(send, {"h": 0.5}, clock=lambda: clock[0], sleep=sleep)
    assert f.get("https://h/x") == (200, b"ok") and slept == [3.0, 3.0] and f.get("https://h/y") == (200, b"ok") and slept[-1] == 0.5
    bad = http.Fetcher(lambda u: (503, {}, None), {}, clock=lambda: clock[0], sleep=sleep)
    assert bad.get("https://h/x") == (503, None) and slept[-3:] == [1.0, 2.0, 4.0] and bad.get("https://h/z") == (0, None)
    assert http.delay(9, None) == 10.0 and http.delay(0, "Thu, 01 Jan 2024 01:00:05 +0100", datetime(2024, 1, 1, tzinfo=UTC).timestamp()) == 5.0 and http.delay(0, "Thu, 01 Jan 2024 00:00:05 GMT", datetime(2024, 1, 1, tzinfo=UTC).timestamp()) == 5.0 and http.delay(1, "junk") == 2.0


def test_final_export(spark, tmp_path):
    effect = "struct<effect_slug:string,effect_label:string,summary:string,evidence_level:string,score:double,supporting_nutrients:array<string>>"
    e = lambda slug, score, nutrients=("Zinc",): Row(slug, "Label  X", "s", "strong", score, list(nutrients))
    rows = [("2", "beta", "unknown", "c", "p", "n", [e("b", 0.5), e("b", 0.9)], [], [], [e("risk", None, ())], [], ["k"], "m", None), ("1", "Alpha", "unknown", "c", "p", "n", [], [], [], [], [], [], None, None), ("3", "x", "unknown", "c", " ", "n", [], [], [], [], [], [], None, None), ("4", "x", "unknown", "c", "p", "n", [], [], [], [e(" ", 1.0)], None, [], None, None)]
    merges = spark.createDataFrame(rows, "id string, name string, summary_source_type string, summary_confidence_status string, positive string, negative string, " + ", ".join(f"{b} array<{effect}>" for b in exports.BUCKETS) + ", caveats array<string>, model_provider string, model_name string")
    broken = {r.id: r.problem for r in exports.write_final(merges, str(tmp_path), "T").collect()}
    assert broken == {"3": "missing_final_positive_summary:3", "4": "final_main_json_bucket_not_list:4:supplement_level_only_effects"}
    read = lambda t: spark.read.csv(f"{tmp_path}/{t}", header=True, escape='"')
    assert read("main").columns == exports.MAIN and [r[1] for r in read("main").collect()] == ["Alpha", "beta"] and read("effects").columns == exports.EFFECTS and read("effects").count() == 3
    tags = {(r.tag, r.tag_type, r.source_bucket): r.score for r in read("tags").collect() if r.canonical_beverage_id == "2"}
    assert tags["b", "effect_slug", "strong_evidence"] == "0.9" and ("label x", "effect_label", "strong_evidence") in tags and ("has_cautionary_effects", "routing_flag", "negative_or_cautionary_effects") in tags and ("unknown", "source_type", "ingredient") in tags
    paths = exports.publish_final(merges, f"{tmp_path}/bundle", "T")
    assert sinks.manifest(spark, f"{tmp_path}/bundle")["tables"] == {"main": 2, "effects": 3, "tags": read("tags").count(), "rejected": 2} and spark.read.csv(paths["main"], header=True, escape='"').columns == exports.MAIN
    assert exports.checked(merges.unionAll(merges.where("id = '1'")))[1].where("problem = 'duplicate_canonical_beverage_id:1'").count() == 2


def test_documents_and_listings(spark, tmp_path):
    for value in ({"a": [1, None], "é": "x"}, []):
        sinks.write_document(spark, value, f"{tmp_path}/s.json")
        assert (tmp_path / "s.json").read_text() == json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    rows = spark.createDataFrame([("T", "1", ["a", "b"])], "claim string, id string, issues array<string>")
    assert sinks.listing(rows, "audit").first().block == "## T\n\n- Issues: a, b\n- Next step: none"


def test_migrated_thresholds(spark):
    old = spark.createDataFrame([("Zinc", "1.1", "mg", "40", "mg", "DV", "src", "reviewed"), ("Iron", "", "", "", "", "", "", ""), ("Ph", "1", "pH", "", "", "b", "s", ""), ("Salt", "9", "g", "5", "g", "x", "", "")], "canonical_bioactive_name string, meaningful_threshold_amount string, meaningful_threshold_unit string, supplement_threshold_amount string, supplement_threshold_unit string, threshold_basis string, source string, review_status string")
    reference = spark.createDataFrame([("Iron", "RDA", "18 mg", "book")], "canonical_bioactive_name string, reference_type string, threshold_notes string, source string")
    got = {r[0]: r for r in assembly.migrated_thresholds(old, reference).collect()}
    assert got["Zinc"].meaningful_threshold_basis == "Draft meaningful threshold from existing table; previous basis: DV" and got["Zinc"].supplement_review_status == "reviewed" and got["Zinc"].supplement_threshold_source == "src"
    assert got["Iron"].meaningful_threshold_basis == "No meaningful threshold set; reference context: RDA; 18 mg" and got["Iron"].meaningful_threshold_source == "book" and got["Iron"].supplement_review_status == "needs_supplement_dose_review"
    assert [got[n].meaningful_review_status for n in ("Zinc", "Iron", "Ph", "Salt")] == ["draft_meaningful_baseline", "needs_meaningful_review", "not_applicable", "needs_meaningful_review_non_monotonic"]


def test_stages_and_bridge(spark, tmp_path):
    spark.createDataFrame([(1, "a", "u"), (2, None, None)], "source_id long, abstract string, page_summary string").write.parquet(f"{tmp_path}/in/sources.parquet")
    spark.createDataFrame([(1, "resolved", 1, "found", "u", "body"), (1, "publisher_page", 1, "blocked", "v", None)], "source_id long, stage string, rank int, status string, url string, text string").write.json(f"{tmp_path}/in/attempts.jsonl")
    out = stages.respond(spark, {"tool": "retrieve", "input": {"source": f"{tmp_path}/in", "target": f"{tmp_path}/out"}})
    assert out == {"ok": True, "output": {"records": 2}}
    seen = stages.inspect_run(spark, f"{tmp_path}/out", ["records", "claims"])
    assert seen["tables"] == {"records": 2} and seen["missing"] == ["claims"] and seen["states"]["records"] == {"full_text_found": 1, "no_oa_location": 1} and seen["failures"] == {"records": {"no_oa_location": 1}}
    assert not stages.respond(spark, {"tool": "nothing", "input": {"source": "a", "target": "b"}})["ok"] and not stages.respond(spark, {"tool": "retrieve", "input": {"source": "a", "target": "b", "odd": 1}})["ok"]
    sink = io.StringIO()
    assert stages.bridge(spark, io.StringIO("[1]"), sink) == 2 and stages.bridge(spark, io.StringIO('{"tool": "list"}'), sink) == 0 and stages.bridge(spark, io.StringIO('{"tool": "zz"}'), sink) == 1
    assert "retrieve" in sink.getvalue()


def test_requests_pending(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    asked = stages.requests(rows, F.col("id"), stages.prompt("Do.", ["one"], "{}", {"Name": F.col("name")}))
    assert {r.prompt.splitlines()[-1] for r in asked.collect()} == {"Name: x", "Name: unknown"}
    answers = spark.createDataFrame([("1", 0, '{"a": 1}'), ("2", 0, "{")], "key string, attempt int, answer string")
    done, failed = stages.answered(asked, answers, "a int", ["a"])
    assert [r.key for r in done.collect()] == ["1"] and [(r.key, r.attempt) for r in stages.pending(asked, failed, 5).collect()] == [("2", 1)]


def test_claim_helpers(spark):
    both, twice = claims.disjoint_union(spark.range(3), spark.range(2, 4), "id")
    assert both.count() == 5 and [r.id for r in twice.collect()] == [2]
    first, rest = claims.limited(spark.range(10), ["id"], 4)
    assert first.count() == 4 and first.select(rest).first()[0] == 6
    claim = F.struct(F.lit("by mouth").alias("oral_exposure"), F.lit("human").alias("evidence_type"), F.col("x").alias("statement"))
    accept = claims.ingredient_accepted(claim, ["statement"])
    assert one(spark, accept, x="helps people") and not one(spark, accept, x="in rats") and not one(spark, accept, x="at 5 µg/ml")
    back = claims.to_ingredient_claim(claims.to_general_claim(spark.createDataFrame([("1", "n", "c", "s", "sl", "l", "e", "d", "p", "mouth", "1 g", "whole_food")], "id string, ingredient_name string, citation_id string, statement string, proposed_effect_slug string, proposed_effect_label string, effect string, claim_direction string, population string, oral_exposure string, dose_or_serving string, exposure_category string").selectExpr("*", "'' AS ingredient_form", "'' AS food_matrix", "'' AS concentration_notes"))).first()
    assert (back.exposure_category, back.dose_or_serving, back.claim_direction) == ("whole_food", "1 g", "d")


@pytest.mark.parametrize("cell, spec, value, problem", [
    ("Human RCT!", {"kind": "enum", "choices": ["human", "animal"], "prefix": True}, "human", None), ("x", {"kind": "enum", "choices": ["human"]}, "x", "not_a_choice"), (None, {"kind": "text"}, "", None), ("abc", {"kind": "text", "most": 2}, "abc", "too_long"),
    ("1.5", {"kind": "number", "high": 1}, 1.5, "out_of_bounds"), ("z", {"kind": "number"}, None, "not_a_number"), ("a", {"kind": "list"}, ["a"], None), ('["a","b"]', {"kind": "list"}, ["a", "b"], None), (None, {"kind": "list"}, [], None),
])
def test_coercion(spark, cell, spec, value, problem):
    v, p = claims.coerced(F.col("x"), **spec)
    got = spark.createDataFrame([(cell,)], "x string").select(v.alias("v"), p.alias("p")).first()
    assert (got.v, got.p) == (value, problem)


def test_stream_gives_every_window(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 6))
    batch = events.windowed_counts(spark.read.parquet(path)).collect()
    assert sorted(map(key, events.windowed_counts_of_files(spark, path).collect())) == sorted(map(key, batch))
