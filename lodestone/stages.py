"""Stages: named functions from tables to tables, with model calls as tables of requests and answers.

A stage never calls a model. It writes the requests that it needs (key, prompt); whatever answers them appends rows
(key, attempt, answer) to a table, and the next run of the stage goes on with what has come. ``answered`` reads the
answers, ``pending`` is what is left to ask, so that a run can stop and resume at any point.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Attempts at an answer before a key has failed (fixed value).
ATTEMPTS = 2


def prompt(task: str, rules: list[str], shape: str, fields: dict[str, Column]) -> Column:
    """The text of a request: task, rules as a list, the shape of the answer, and the row's fields; absent ones are unknown."""
    head = "\n".join([task, "", *(f"- {r}" for r in rules), "", "Return JSON exactly matching this schema:", shape, ""])
    return F.concat_ws("\n", F.lit(head), *(F.concat(F.lit(f"{k}: "), F.coalesce(F.nullif(F.trim(v.cast("string")), F.lit("")), F.lit("unknown"))) for k, v in fields.items()))


def requests(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, prompt, digest): one request for each key; equal prompts have equal digests, so that answers can be shared."""
    return rows.select(key.cast("string").alias("key"), text.alias("prompt")).groupBy("key").agg(F.min("prompt").alias("prompt")).withColumn("digest", F.sha2("prompt", 256))


def answered(asked: DataFrame, answers: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, answer) of the first answer that parses with all required fields, and (key, attempts, problem) of keys without one.

    Answers beyond ``ATTEMPTS`` for a key do not count.
    """
    parsed = F.from_json("answer", schema, {"mode": "PERMISSIVE"})
    sound = F.lit(True)
    for c in required:
        sound &= parsed[c].isNotNull()
    tried = answers.where(F.col("attempt") < ATTEMPTS).select("key", "attempt", F.when(sound, parsed).alias("answer"), (F.try_parse_json("answer").isNull()).alias("broken"))
    best = tried.groupBy("key").agg(F.min_by("answer", F.when(F.col("answer").isNotNull(), F.col("attempt"))).alias("answer"), F.count("*").alias("attempts"), F.max_by("broken", "attempt").alias("broken"))
    rows = asked.select("key").join(best, "key", "left")
    problem = F.when(F.col("attempts").isNull(), "pending").when(F.col("attempts") < ATTEMPTS, "retry").when(F.col("broken"), "invalid_json").otherwise("invalid_answer")
    return rows.where("answer IS NOT NULL").select("key", "answer"), rows.where("answer IS NULL").select("key", F.coalesce("attempts", F.lit(0)).alias("attempts"), problem.alias("problem"))


def pending(asked: DataFrame, failures: DataFrame, limit: int | None = None) -> DataFrame:
    """The requests still to be asked, with the number of the attempt; ``limit`` of them by key for a trial run."""
    rows = asked.join(failures.where(F.col("problem").isin("pending", "retry")).select("key", F.col("attempts").alias("attempt")), "key")
    return rows if limit is None else rows.orderBy("key").limit(limit)


@dataclass
class Stage:
    """Tables in, tables out: ``run`` gets its input tables by name and returns its output tables by name."""

    name: str
    inputs: list[str]
    outputs: list[str]
    run: Callable[..., dict[str, DataFrame]]
    options: dict[str, object] = field(default_factory=dict)


STAGES: dict[str, Stage] = {}


def stage(name: str, inputs: list[str], outputs: list[str], **options):
    """Register a function of its input tables (and options) as a stage."""

    def put(f):
        STAGES[name] = Stage(name, inputs, outputs, f, options)
        return f

    return put


def run_stage(spark: SparkSession, name: str, source: str, target: str, **options) -> dict[str, int]:
    """Run a stage from a folder of Parquet or JSON tables to a folder of Parquet tables; returns the row counts."""
    if name not in STAGES:
        raise KeyError(f"unknown_stage:{name}")
    one = STAGES[name]
    unknown = set(options) - set(one.options)
    if unknown:
        raise TypeError(f"unknown_option:{','.join(sorted(unknown))}")
    out = one.run(*(read_table(spark, source, t) for t in one.inputs), **(one.options | options))
    if sorted(out) != sorted(one.outputs):
        raise ValueError(f"stage_outputs_differ:{name}")
    counts = {}
    for table, df in out.items():
        df.write.mode("overwrite").parquet(f"{target}/{table}.parquet")
        counts[table] = spark.read.parquet(f"{target}/{table}.parquet").count()
    return counts


def _files(spark: SparkSession, folder: str):
    """The names and sizes below a folder of any file system that Spark reads; empty where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s for s in system.listStatus(path)} if system.exists(path) else {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name.parquet``, ``name.jsonl`` or ``name.json`` (an array or one document) of a folder."""
    have = _files(spark, folder)
    for end, read in ((".parquet", spark.read.parquet), (".jsonl", spark.read.json), (".json", spark.read.option("multiLine", "true").json)):
        if f"{name}{end}" in have:
            return read(f"{folder}/{name}{end}")
    raise FileNotFoundError(f"table_not_found:{name}")


def inspect_run(spark: SparkSession, folder: str, expected: list[str], status: str = "status") -> dict:
    """What a run's folder holds: rows of each table, counts by status, failures, and expected tables that are missing."""
    have = {n.rsplit(".", 1)[0] for n in _files(spark, folder) if n.endswith((".parquet", ".jsonl", ".json"))}
    tables, states = {}, {}
    for name in sorted(have):
        df = read_table(spark, folder, name)
        if status in df.columns:
            states[name] = {str(r[0]): r[1] for r in df.groupBy(status).count().orderBy(status).limit(1000).collect()}
            tables[name] = sum(states[name].values())
        else:
            tables[name] = df.count()
    failed = {n: {k: v for k, v in s.items() if k not in ("full_text_found", "found", "accepted", "done")} for n, s in states.items()}
    return {"folder": folder, "tables": tables, "states": states, "failures": {n: f for n, f in failed.items() if f}, "missing": sorted(set(expected) - have)}


def respond(spark: SparkSession, request: dict) -> dict:
    """The bridge: {"tool": name, "input": {...}} to {"ok": true, "output": ...} or {"ok": false, "error": {type, message}}."""
    try:
        tool, given = request["tool"], dict(request.get("input") or {})
        if tool == "list":
            return {"ok": True, "output": sorted(STAGES)}
        if tool == "inspect":
            return {"ok": True, "output": inspect_run(spark, given["folder"], given.get("expected", []))}
        source, target = given.pop("source"), given.pop("target")
        return {"ok": True, "output": run_stage(spark, tool, source, target, **given)}
    except Exception as e:  # the caller gets every failure as an envelope
        return {"ok": False, "error": {"type": type(e).__name__, "message": str(e).splitlines()[0] if str(e) else ""}}


def bridge(spark: SparkSession, read=sys.stdin, write=sys.stdout) -> int:
    """One JSON request from ``read``, one JSON answer to ``write``; 0 if it was fine, 1 if the tool failed, 2 if the request was no JSON object."""
    try:
        request = json.loads(read.read())
        if not isinstance(request, dict):
            raise ValueError("request_not_object")
    except ValueError as e:
        write.write(json.dumps({"ok": False, "error": {"type": "ValueError", "message": str(e)}}) + "\n")
        return 2
    out = respond(spark, request)
    write.write(json.dumps(out) + "\n")
    return 0 if out["ok"] else 1


# The registered stages: from the tables of a run to those of the next step.


@stage("screen", ["citations", "screening_answers"], ["accepted", "rejected"])
def screen(citations, answers):
    from .operators import evidence as E

    rows = citations.join(answers.withColumnRenamed("citation_id", "id"), "id", "left")
    marked = rows.withColumn("_ok", E.accepts({c: F.col(c) for c in answers.columns if c in {*E.VETOES, *E.FLAGS}}))
    return {"accepted": marked.where("_ok").drop("_ok"), "rejected": marked.where("NOT _ok").drop("_ok")}


@stage("resolve", ["sources", "service_answers"], ["addresses"])
def resolve(sources, answers):
    from .sources import resolvers

    return {"addresses": resolvers.resolved(sources, answers)}


@stage("retrieve", ["sources", "attempts"], ["records"])
def retrieve(sources, attempts):
    from .sources import resolvers

    return {"records": resolvers.cascade(sources, attempts)}


@stage("sanitize", ["papers"], ["bodies", "failures"])
def sanitize(papers):
    from .operators import papers as P

    out = P.sanitized(papers)
    return {"bodies": out.where("text IS NOT NULL").drop("preview"), "failures": out.where("text IS NULL").drop("text")}


@stage("context", ["bodies"], ["contexts"], most=45_000)
def context(bodies, most):
    from .operators import papers as P

    return {"contexts": P.extraction_contexts(bodies, most=most)}


@stage("ground", ["quotes", "bodies"], ["grounded"])
def ground(quotes, bodies):
    from .operators import joins

    return {"grounded": joins.grounded(quotes, bodies, "quote_id", "quote", "source_id", "text")}


@stage("export", ["claims", "sources", "lookup"], ["evidence", "new_effects", "exposure", "rejected"], at="1970-01-01T00:00:00+00:00")
def export(claims, sources, lookup, at):
    from .operators import exports

    return exports.health_evidence(claims, sources, lookup, at)


@stage("final", ["merges"], ["main", "effects", "tags", "rejected"], at="1970-01-01T00:00:00+00:00")
def final(merges, at):
    from .operators import exports

    sound, broken = exports.checked(merges)
    return {"main": exports.main_rows(sound, at), "effects": exports.effect_rows(sound, at), "tags": exports.tag_rows(sound, at), "rejected": broken.unionByName(exports.slugless(sound))}


@stage("deduplicate", ["citations"], ["unique"])
def deduplicate(citations):
    from .operators import dedupe

    return {"unique": dedupe.citations(citations)}


@stage("collect", ["answers"], ["candidates", "pages", "failures"], page_size=10, queries=1, target=100, max_pages=5)
def collect(answers, page_size, queries, target, max_pages):
    from .sources import connectors

    return connectors.candidate_run(answers, page_size, queries, target, max_pages)


@stage("read_payloads", ["payloads"], ["texts"])
def read_payloads(payloads):
    from .operators import nested

    return {"texts": nested.json_text(payloads, "source_id", "payload")}


@stage("reroute", ["profiles"], ["profiles", "moved"])
def reroute(profiles):
    from .operators import claims as C

    rows, log = C.reroute(profiles, [c for c in ("canonical_beverage_id", "canonical_beverage_name", "id", "name") if c in profiles.columns])
    return {"profiles": rows, "moved": log}


@stage("report", ["validated", "proposed", "sources"], ["claims", "table"])
def report(validated, proposed, sources):
    from .operators import exports

    rows = exports.public_report(validated, proposed, sources)
    return {"claims": rows, "table": exports.report_table(rows)}


@stage("packet", ["rows", "claims"], ["reports", "rejected"], key="id", most=1_800)
def packet(rows, claims, key, most):
    from .operators import evidence as E

    reports, rejected = E.packet_reports(rows, claims, key, most=most)
    return {"reports": reports, "rejected": rejected}


@stage("aliases", ["pairs"], ["roots"])
def aliases(pairs):
    from .operators import joins

    return {"roots": joins.closure(pairs)}


@stage("complete", ["expected", "answers"], ["rows", "report"], keys="key", values="value", order="seq", fallback="")
def complete(expected, answers, keys, values, order, fallback):
    """``keys``, ``values`` and ``order`` are names separated by commas; ``fallback`` stands for each missing value, without one the join is strict."""
    from .operators import joins

    names = values.split(",")
    rows, told = joins.completed(expected, answers, keys.split(","), names, order.split(","), {v: F.lit(fallback) for v in names} if fallback else None)
    return {"rows": rows, "report": told}
