"""Sinks: documents, lines, logs, fixed CSV, nested-to-flat rows, bundles, Markdown."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Compact JSON lines with null fields kept; Spark's commit makes the write appear as a whole."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def json_cell(c) -> Column:
    """A nested value as compact JSON for a CSV cell, nulls kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def write_csv(df: DataFrame, path: str, columns: list[str], order: list | None = None) -> None:
    """Exactly these columns, nulls as '', nested ones as JSON; ``order`` sorts over all part files by range."""
    cells = [json_cell(F.col(c)) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string") for c in columns]
    out = df.orderBy(*order) if order else df
    out.select(*(F.coalesce(x, F.lit("")).alias(c) for x, c in zip(cells, columns, strict=True))).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def flat(df: DataFrame, nested: str, sep: str = ";") -> DataFrame:
    """One row for each element of an array of structs; lists inside are joined."""
    fields = df.schema[nested].dataType.elementType.fields
    rows = df.withColumn("_e", F.explode(nested)).drop(nested)
    cells = [(F.array_join(F.col(f"_e.{f.name}").cast("array<string>"), sep) if f.dataType.typeName() == "array" else F.col(f"_e.{f.name}")).alias(f.name) for f in fields]
    return rows.select(*(c for c in rows.columns if c != "_e"), *cells)


def markdown_lines(df: DataFrame, title: str, heading: Column, fields: dict[str, Column]) -> DataFrame:
    """A Markdown block for each row."""
    lines = [F.concat(F.lit("## "), heading), F.lit(""), *(F.concat(F.lit(f"- {k}: "), F.coalesce(v.cast("string"), F.lit("none"))) for k, v in fields.items())]
    return df.select(F.concat_ws("\n", *lines).alias("block")).withColumn("document", F.lit(title))


#: The file whose presence makes a version of a bundle visible; where tables are written before that; the names of versions.
MANIFEST, STAGED, VERSION = "manifest.json", "_staged", "v{:012d}"


def _system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written as a whole: under another name first, renamed without overwriting."""
    path_, system = _system(spark, path)
    work = path_(f"{path}.{uuid.uuid4().hex}.tmp")
    out = system.create(work, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(work, path_(path)):
        system.delete(work, False)
        raise FileExistsError(path)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """The folders of a bundle's versions that have a manifest, the newest last."""
    path, system = _system(spark, folder)
    if not system.exists(path(folder)):
        return []
    found = sorted(str(x.getPath()) for x in system.listStatus(path(folder)) if x.isDirectory() and x.getPath().getName().startswith("v"))
    return [x for x in found if system.exists(path(f"{x}/{MANIFEST}"))]


def write_bundle(folder: str, tables: dict[str, DataFrame], keep: int = 2, notes: dict[str, str] | None = None, csv: dict[str, tuple] | None = None) -> dict[str, str]:
    """Publish tables together, as a new version of a bundle: readers see all of them or the version before.

    Tables are staged below the folder, as JSON lines or, where ``csv`` names them with (columns, order), as CSV; ``notes``
    are texts beside them. The manifest, with the rows of each table, is written last; then the staged folder gets the
    next version's name by one rename. A run that fails leaves only a staged folder, which nobody reads. Two runs at once
    get two versions. ``keep``: versions that stay for readers that have begun (at least this one).
    """
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    path, system = _system(spark, folder)
    staged = f"{folder}/{STAGED}/{uuid.uuid4().hex}"
    rows = {}
    for name, df in tables.items():
        if csv and name in csv:
            write_csv(df, f"{staged}/{name}", *csv[name])
        else:
            write_jsonl(df, f"{staged}/{name}")
        written = spark.read.text(f"{staged}/{name}") if not (csv and name in csv) else spark.read.csv(f"{staged}/{name}", header=True, escape='"', multiLine=True)
        rows[name] = written.count()
    for name, text in (notes or {}).items():
        _put(spark, f"{staged}/{name}", text)
    _put(spark, f"{staged}/{MANIFEST}", json.dumps({"tables": rows}, indent=2) + "\n")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    last = versions(spark, folder)
    number = int(last[-1].rsplit("v", 1)[1]) + 1 if last else 0
    while True:
        target = f"{folder}/{VERSION.format(number)}"
        try:
            context.rename(path(staged), path(target), none)
            break
        except Exception as e:  # another run took the number
            if not system.exists(path(target)):
                raise e
            number += 1
    for old in versions(spark, folder)[: -max(keep, 1)]:
        system.delete(path(old), True)
    return {name: f"{target}/{name}" for name in tables}


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The newest version's manifest with its folder; null where nothing was published."""
    found = versions(spark, folder)
    if not found:
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{found[-1]}/{MANIFEST}").collect())  # a few lines
    return json.loads(text) | {"folder": found[-1]}


def read_bundle(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """A table (JSON lines) of the newest version."""
    found = versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing is published in {folder}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{found[-1]}/{name}")


def updated_counts(counts: Column, updates: Column) -> Column:
    """A map with entries replaced."""
    return F.map_concat(F.map_filter(counts, lambda k, _: ~F.map_contains_key(updates, k)), updates)


def write_document(spark: SparkSession, value, path: str) -> None:
    """One JSON document, two spaces deep, with a newline at its end; it appears as a whole. For results that fit the driver, such as summaries."""
    jvm = spark._jvm
    target, work = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(work, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()
    if system.exists(target):
        system.delete(target, False)
    system.rename(work, target)


#: What each Markdown listing shows of a row: title, heading and the fields below it (fixed formats).
LISTINGS = {
    "sources": ("Sources", "title", {"ID": "id", "DOI": "doi", "PMID": "pmid", "Year": "year", "URL": "url"}),
    "rejected_sources": ("Rejected sources", "title", {"ID": "id", "Code": "rejection_code", "Failed requirement": "failed_requirement", "Confidence": "confidence"}),
    "raw_texts": ("Raw texts", "source_id", {"Status": "status", "Method": "stage", "Path": "url"}),
    "proposed_claims": ("Proposed claims", "statement", {"ID": "id", "Citation": "citation_id", "Effect": "proposed_effect_label", "Dose or exposure": "dose_or_exposure"}),
    "validation": ("Validation", "statement", {"Claim": "proposed_claim_id", "Verdict": "verdict", "Accepted": "accepted", "Scope": "scope"}),
    "audit": ("Audit", "claim", {"Issues": "issues", "Next step": "action"}),
}


def listing(df: DataFrame, kind: str) -> DataFrame:
    """The Markdown blocks of a listing; columns that the table lacks show as none."""
    title, heading, fields = LISTINGS[kind]
    shown = lambda c: (F.concat_ws(", ", F.col(c)) if df.schema[c].dataType.typeName() == "array" else F.col(c)) if c in df.columns else F.lit(None).cast("string")
    return markdown_lines(df, title, shown(heading), {k: shown(c) for k, c in fields.items()})
