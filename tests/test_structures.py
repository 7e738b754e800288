"""Nested documents, bodies of papers on their headings, item states, aliases, pages of collectors and published bundles."""

import datetime
import json
import random


from pyspark.sql import functions as F

from lodestone.operators import joins, nested, papers
from lodestone.sources import connectors
from lodestone.streaming import items


def flat(value, skipped=("coredata", "link")):
    if isinstance(value, str):
        return [" ".join(value.split())] if value.strip() else []
    if isinstance(value, list):
        return [x for v in value for x in flat(v)]
    if isinstance(value, dict):
        return [x for k, v in value.items() if k not in skipped for x in flat(v)]
    return []


def test_json_strings_against_a_walk(spark):
    rng = random.Random(9)
    pieces = ["a", " b  c ", "", 'q"x', "\\", "\\\\n", "é\n", "{[,:]}", "coredata", '","', "漢 字", "\x01"]

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice([*pieces, 1.5, None, True, "".join(rng.choice(pieces) for _ in range(rng.randrange(5)))])
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["coredata", "link", "x", "y", 'k"', "z\\", ":"]): value(depth - 1) for _ in range(rng.randrange(4))}

    docs = [value(6) for _ in range(300)]
    deep = "x"
    for k in range(60):
        deep = {"coredata": deep} if k == 20 else [deep, f"level {k}"] if k % 2 else {"in": deep, "after": f"level {k}"}
    docs += [deep, ["long " * 20_000, "\\" * 50_000, {"link": {"a": [["w" * 200_000]]}, "n": '"' * 30_000}], [str(k) for k in range(20_000)]]
    rows = spark.createDataFrame([(i, json.dumps(d, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)) for i, d in enumerate(docs)], "id long, payload string").repartition(3)
    got = {r.id: r.text for r in nested.json_text(rows, "id", "payload").collect()}
    for i, d in enumerate(docs):
        assert got[i] == " ".join(flat(d)), i
    assert nested.json_text(rows.limit(0), "id", "payload").count() == 0




def prose(n):
    return ("Participants consumed the supplement and outcomes were measured. " * (n // 60 + 1))[:n]


def sanitized(spark, text, title=None, abstract=None):
    return papers.sanitized(spark.createDataFrame([(1, title, abstract, text)], "source_id long, title string, abstract string, text string")).first()


def test_sanitized_papers(spark):
    body = prose(1200)
    rows = [
        (1, "The Title", "An abstract of it.", f"The Title An abstract\nof it. {body}\nReferences\nSmith"),
        (2, "The Title", None, f"THE TITLE journal Introduction {body}"), (3, None, None, "too short to be quoted"), (4, None, None, None),
        (5, None, None, f"head I N T R O D U C T I O N {prose(900)}\n2. References\nSmith J, x"),
        (6, None, None, f"T Abstract some words. Introduction {prose(900)}\nConclusions\nend of it"),
        (7, None, None, f"{'plain head words ' * 25} Methods {prose(1000)} Results {prose(900)} Discussion {prose(600)}"),
        (8, None, None, prose(4100)),
        (9, None, None, f"Title 1. Zinc in the diet of adults We looked at it. {prose(700)} References Smith AB, and so on"),
        (10, None, None, f"This is a preview of subscription content. Abstract a Introduction b {'word ' * 30}"),
        (11, None, None, f"{'plain head words ' * 25} Results {prose(700)}\nConclusion {prose(600)}"),
        (12, None, None, f"{'x ' * 200} Methods Results Discussion References {'y ' * 300}"),
    ]
    got = {r.source_id: r for r in papers.sanitized(spark.createDataFrame(rows, "source_id long, title string, abstract string, text string").repartition(3)).collect()}
    assert {i: r.stage for i, r in got.items()} == {1: "abstract_removed", 2: "introduction", 3: "failed", 4: "failed", 5: "introduction", 6: "introduction", 7: "structure", 8: "failed", 9: "introduction", 10: "failed", 11: "sections", 12: "failed"}
    assert got[1].text == body.strip() and got[2].text == f"Introduction {body}".strip() and got[3].preview == "too short to be quoted" and got[4].preview is None
    assert got[5].text == f"I N T R O D U C T I O N {prose(900)}".strip() and got[6].text == f"Introduction {prose(900)}".strip()
    assert got[7].text.startswith("Methods Part") and got[7].text.endswith(prose(600).strip()) and got[9].text == f"1. Zinc in the diet of adults We looked at it. {prose(700)}".strip()
    assert got[11].text.startswith("Results") and got[8].preview.endswith("...") and len(got[8].preview) <= 4000
    assert papers.sanitized(spark.createDataFrame(rows[:1], "source_id long, title string, abstract string, text string").limit(0)).count() == 0


def test_papers_of_nothing_but_headings(spark):
    """Ten thousand headings in a megabyte: linear, and the first start that results and a discussion follow."""
    text = "".join(f"Participants {k} were seen and then some more of them took part in the trial as well. " for k in range(10_000)) + "Results good. " + "Discussion long. " * 200
    got = sanitized(spark, text)
    assert got.stage == "structure" and len(text) > 850_000 and got.text == text[text.index("Participants 4 ") :].strip()
    lines = "Methods\nsome\n" * 20_000
    context = papers.extraction_contexts(spark.createDataFrame([(1, lines)], "source_id long, text string")).first()
    assert context.strategy == "section_priority" and context.truncated and set(context.sections) == {"methods"} and 44_990 <= len(context.text) <= 45_000


def test_extraction_contexts(spark):
    text = "Intro words\n\nIntroduction\nwhy\n\n2. Methods\n" + "m" * 60 + "\nResults\n" + "r" * 60 + "\nDiscussion\nso what\nReferences\nSmith"

    def context(x, most=45_000):
        return papers.extraction_contexts(spark.createDataFrame([(1, x)], "source_id long, text string"), most=most).first()

    whole = context(text)
    assert whole.strategy == "complete_body_without_abstract_or_references" and not whole.truncated and whole.text.endswith("so what")
    some = context(text, 120)
    assert some.strategy == "section_priority" and some.sections == ["methods", "results"] and some.truncated
    methods, results = "2. Methods\n" + "m" * 60, "Results\n" + "r" * 60
    assert some.text == f"{methods}\n\n{results[: 120 - len(methods) - 2]}"
    assert context("Introduction\nwhy\nMethods\n" + "m" * 200, 100).sections == ["methods"]
    assert context("no headings at all in this text", 20).strategy == "body_prefix_fallback"
    assert context("Abstract in short. Introduction and more").text == "Introduction and more"
    inline = context("Start. Methods Search terms were set. Authors' conclusions In short, " + "z" * 60, 50)
    assert inline.sections == ["methods", "conclusions"] and inline.text.startswith("Methods Search terms were set.\n\nAuthors' ")


# Sessions


def replayed(events, patience, retries):
    """The changes of events in order of time, each item by itself; no watermark."""
    out, held = [], {}
    for item, ts, number, event in sorted(events, key=lambda e: (e[1], e[2])):
        status, since, attempts = held.get(item, ("", None, 0))
        if status == "running" and ts > since + patience:
            out.append((item, None, "time_out", "running", "failed", "timed_out"))
            status = "failed"
        after = items.TRANSITIONS.get((status, event))
        if after is None or event == "retry" and attempts >= retries:
            out.append((item, number, event, status, status, "illegal" if after is None else "retries_spent"))
        else:
            out.append((item, number, event, status, after, "taken"))
            status, since, attempts = after, ts, attempts + (event == "retry")
        held[item] = status, since, attempts
    return out


def test_session_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    steps = ["queue", "start", "complete", "fail", "cancel", "accept", "reject", "hold", "retry", "nonsense"]
    events = [(f"i{rng.randrange(12)}", start + datetime.timedelta(minutes=rng.randrange(20_000)), k, rng.choice(steps)) for k in range(1500)]
    events.sort(key=lambda e: (e[1], e[2]))
    schema = "item string, ts timestamp, event_id long, event string"
    patience = datetime.timedelta(hours=8)

    def session(parts, name):
        folder = str(tmp_path / name)
        for k, (a, b) in enumerate(zip(parts, parts[1:])):
            spark.createDataFrame(events[a:b], schema).coalesce(1).write.parquet(f"{folder}/in/part={k}")
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
            items.run_session(stream, folder, patience=patience, retries=2).awaitTermination()
        return items.log_of(spark, folder)

    one, three = session([0, 1500], "one"), session([0, 400, 1100, 1500], "three")
    assert sorted(map(tuple, items.states(one).collect())) == sorted(map(tuple, items.states(three).collect()))
    want = replayed(events, patience, 2)
    told = [(r.item, r.event_id, r.event, r.before, r.after, r.outcome) for r in three.where("outcome <> 'timed_out' OR event_id IS NOT NULL").collect()]
    assert sorted(told) == sorted(w for w in want if w[5] != "timed_out") and {w[5] for w in want} == {"taken", "illegal", "retries_spent", "timed_out"}
    late = spark.createDataFrame([("i1", start, 9999, "queue")], schema)  # before the watermark: the stream's own filter drops it
    late.coalesce(1).write.parquet(f"{tmp_path}/three/in/part=9")
    items.run_session(spark.readStream.schema(schema).parquet(f"{tmp_path}/three/in/*"), f"{tmp_path}/three", patience=patience, retries=2).awaitTermination()
    assert items.log_of(spark, f"{tmp_path}/three").count() == three.count()


def test_events_of_one_batch_that_come_too_late(spark, tmp_path):
    schema = "item string, ts timestamp, event_id long, event string"
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    for k, rows in enumerate([[("a", at(60), 1, "queue"), ("a", at(90), 2, "start")], [("a", at(70), 3, "cancel"), ("b", at(95), 4, "queue")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        items.run_session(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), str(tmp_path), late="1 hour").awaitTermination()
    got = {(r.item, r.event_id): r.outcome for r in items.log_of(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): "taken", ("a", 2): "taken", ("a", 3): "late", ("b", 4): "taken"}


# Aliases and pages


def test_closure_of_long_chains(spark):
    rng = random.Random(5)
    n = 60_000
    names = list(range(n))
    rng.shuffle(names)
    pairs = [(f"a{names[k]}", f"a{names[k + 1]}") for k in range(n - 1) if k % 20_000 != 19_999]  # three chains
    pairs += [("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("into", "r1")]
    got = {r.alias: r for r in joins.closure(spark.createDataFrame(pairs, "alias string, target string")).collect()}
    assert len(got) == len(pairs)
    for k in range(0, n - 1, 997):
        if k % 20_000 != 19_999:
            end = (k // 20_000 + 1) * 20_000 - 1
            assert (got[f"a{names[k]}"].root, got[f"a{names[k]}"].steps) == (f"a{names[end]}", end - k)
    assert {k for k, r in got.items() if r.status == "cycle"} == {"r0", "r1", "r2", "into"}
    assert joins.closure(spark.createDataFrame([], "alias string, target string")).count() == 0


def test_run_over_pages(spark):
    def page(source, query, number, titles, status=200):
        body = {"crossref": {"message": {"items": [{"title": [t]} for t in titles]}}, "europe_pmc": {"resultList": {"result": [{"title": t} for t in titles]}}, "semantic_scholar": {"data": [{"title": t} for t in titles]}}[source]
        return source, query, number, status, json.dumps(body) if status == 200 else None

    rows = [
        page("europe_pmc", 0, 0, ["a", "b"]), page("europe_pmc", 1, 0, ["c"]), page("europe_pmc", 0, 1, ["d"]), page("europe_pmc", 1, 1, [], 500), page("europe_pmc", 0, 2, ["lost"]), page("europe_pmc", 1, 2, ["lost too"]),
        page("crossref", 0, 0, ["A", "x", "too many"]), page("crossref", 0, 1, ["y"]), page("crossref", 1, 2, [" Y "]), page("crossref", 0, 3, ["never asked"]),
        page("semantic_scholar", 0, 0, ["s", "a"]), page("semantic_scholar", 0, 1, [], 403), page("semantic_scholar", 1, 1, ["off"]),
    ]
    answers = spark.createDataFrame(rows, "source string, query int, page int, status int, payload string")
    run = connectors.candidate_run(answers, 4, 2, 100, 5)
    assert [(r.title, r.source, r.slot) for r in run["candidates"].collect()] == [("a", "europe_pmc", 0), ("b", "europe_pmc", 0), ("c", "europe_pmc", 0), ("x", "crossref", 0), ("d", "europe_pmc", 1), ("y", "crossref", 1), ("s", "semantic_scholar", 5)]
    assert [(r.slot, r.mode, r.raw, r.new, r.total, r.stop) for r in run["pages"].orderBy("slot").collect()] == [(0, "primary", 5, 4, 4, None), (1, "primary", 2, 2, 6, None), (2, "primary", 1, 0, 6, "no_new_unique_candidates"), (5, "fallback", 2, 1, 7, None), (6, "fallback", 0, 0, 7, "no_new_unique_candidates")]
    assert {(r.source, r.query, r.page, r.code) for r in run["failures"].collect()} == {("europe_pmc", 1, 1, "retrieval_error"), ("semantic_scholar", 0, 1, "blocked")}
    short = connectors.candidate_run(answers, 4, 2, 3, 5)
    assert [r.title for r in short["candidates"].collect()] == ["a", "b", "c"] and [r.stop for r in short["pages"].collect()] == ["target_reached"] and short["failures"].count() == 0
    none = connectors.candidate_run(answers.limit(0), 4, 2, 3, 5)
    assert none["candidates"].count() == 0 and none["pages"].count() == 2


def test_circles_take_no_further_rounds(spark, monkeypatch):
    rounds = []
    saved = joins._saved
    monkeypatch.setattr(joins, "_saved", lambda df: rounds.append(1) or saved(df))
    chain = [(f"c{i}", f"c{i + 1}") for i in range(5)]
    circles = [(f"a{i}", f"b{i}") for i in range(200)] + [(f"b{i}", f"a{i}") for i in range(200)] + [("into", "a7")]
    got = {r.alias: (r.root, r.steps, r.status) for r in joins.closure(spark.createDataFrame(chain + circles, "alias string, target string")).collect()}
    assert [got[f"c{i}"] for i in range(5)] == [("c5", 5 - i, "resolved") for i in range(5)]
    assert len(got) == 406 and all(v == (None, None, "cycle") for k, v in got.items() if k[0] != "c")
    assert len(rounds) <= 6  # of the chain, not of the circles


def test_strings_of_documents_stay_in_their_rows(spark):
    rows = spark.createDataFrame([(1, '{"a": ["x\\"y", {"link": {"b": ["gone", "gone"]}, "c": " z  w "}], "lin\\u006b": "gone", "d": ["", "link"]}'), (2, "[broken"), (3, '"alone"')], "id long, payload string")
    out = nested.json_text(rows, "id", "payload")
    assert {r.id: r.text for r in out.collect()} == {1: 'x"y z w link', 2: None, 3: "alone"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_candidates_are_shuffled_once(spark):
    from lodestone.sources import resolvers

    sources = spark.createDataFrame([(1, "10.1/x", None)], "source_id long, doi string, pmcid string")
    place = {"url": "https://a.org/1", "url_for_pdf": "https://a.org/1.pdf", "version": "publishedVersion"}
    answers = spark.createDataFrame([(1, "unpaywall", json.dumps({"is_oa": True, "oa_locations": [place, place]})), (1, "crossref", json.dumps({"link": [{"URL": "https://a.org/1.pdf", "content-type": "application/pdf"}]}))], "source_id long, service string, payload string")
    out = resolvers.resolved(sources, answers)
    assert [tuple(r) for r in out.orderBy("rank").select("rank", "url", "method").collect()] == [(1, "https://a.org/1.pdf", "unpaywall_pdf"), (2, "https://a.org/1", "unpaywall_landing_page")]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_places_part_large_buckets(spark):
    from lodestone.operators import folds

    rows = [(e, c, i) for e in ("a", "B", None) for c in ("1", "2", None) for i in range(3)]
    df = spark.createDataFrame(rows, "e string, c string, i int")
    got = {tuple(r)[:3]: r.place for r in folds.places(df, [], [F.lower("e"), "c", "i"], F.lower("e"), within=F.col("c")).collect()}
    first = lambda x: (x is not None, x or "")
    want = sorted(rows, key=lambda r: (first(r[0] and r[0].lower()), first(r[1]), r[2]))
    assert got == {r: k for k, r in enumerate(want, 1)}


def test_spans_are_cut_from_packed_batches(spark, monkeypatch):
    from lodestone.operators import evidence

    monkeypatch.setattr(evidence, "HELD", 5)
    df = spark.createDataFrame([(i, f"one two  three {i}", s) for i, s in enumerate(["TWO three", None, " ", "absent", "one"] * 3)] + [(99, None, "x")], "i int, t string, s string")
    got = {r.i: r.x for r in df.select("i", evidence.remove_spans(F.col("t"), F.col("s")).alias("x")).collect()}
    assert [got[k] for k in range(5)] == ["one   0", "one two  three 1", "one two  three 2", "one two  three 3", "two  three 4"] and got[99] is None and len(got) == 16


def test_file_names_of_long_texts(spark):
    import re

    from lodestone.functions import text as T

    values = ["ab c" * 500, " " * 600 + "x y", "a" + "_" * 900, "a" + "_" * 900 + "b", "_" * 470 + "q" * 300, "ü" * 481, "w-" * 241, "x" * 120 + " " * 500]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(T.safe_file_name(F.col("v"))).collect()]
    assert got == [re.sub("^_+|_+$", "", re.sub("[^a-zA-Z0-9._-]+", "_", v))[:120] for v in values]


def test_claims_of_a_report_are_shuffled_without_their_wording(spark):
    from lodestone.operators import exports

    validated = spark.createDataFrame([("a", "p1", "c1", 1), ("a", "p1", "c1", 1), ("b", "p1", "c1", 2), ("b", "p2", None, 3), ("c", "none", "c1", 4), ("a", "p2", "c9", 5)], "line string, proposed_claim_id string, citation_id string, n int")
    proposed = spark.createDataFrame([("p1", "Sleep", "adults"), ("p2", "calm", None)], "id string, proposed_effect_label string, population string").withColumns({c: F.lit("x") for c in ("proposed_effect_slug", "direction", "dose_or_exposure", "exposure_category", "study_type", "statement")})
    sources = spark.createDataFrame([("c1", "One"), ("c1", "Other"), (None, "None")], "id string, title string").withColumns({c: F.lit(None).cast("string") for c in ("doi", "pmid", "url")})
    late = {"claim_id": F.concat("line", "proposed_claim_id"), "verdict": F.lit("supported"), "support_level": F.when(F.col("n") > 1, "human_rct").otherwise("odd"), "validated_statement": F.concat(F.lit("said of "), "population"), "limitations": F.array("line")}
    out = exports.public_report(validated, proposed, sources, late)
    got = [(r.place, r.claim_id, r.citation_id, r.evidence, r.finding, r.limitations, r.source_title) for r in out.orderBy("place").collect()]
    ap1, bp1 = ("ap1", "c1", "Odd", "said of adults", '["a"]'), ("bp1", "c1", "Human RCT", "said of adults", '["b"]')
    first = [("bp2", None, "Human RCT", "x", '["b"]', None), ("ap2", "c9", "Human RCT", "x", '["a"]', "c9")]
    assert [g[0] for g in got] == list(range(1, 9)) and [g[1:] for g in got[:2]] == first
    assert sorted(g[1:] for g in got[2:6]) == [(*ap1, "One"), (*ap1, "One"), (*ap1, "Other"), (*ap1, "Other")] and sorted(g[1:] for g in got[6:]) == [(*bp1, "One"), (*bp1, "Other")]


def test_report_query_reads_whole_lines_once(spark, tmp_path):
    from lodestone.plans import registry

    for name in ("lineitem", "part", "supplier"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (rows.limit(50).unionAll(rows.limit(50)) if name == "lineitem" else rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = registry.QUERIES["public_report_rows"](spark, str(tmp_path))
    assert sorted(r.place for r in out.collect()) == list(range(1, 101))
    scans = [x for x in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "FileScan" in x and "l_partkey" in x]
    assert len([x for x in scans if "l_extendedprice" in x]) == 1
