"""File sources: CSV, JSON lines, JSON documents, decision files, texts, XML; and the checks of their contracts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CSV = {"header": "true", "multiLine": "true", "escape": '"', "inferSchema": "false", "encoding": "UTF-8", "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, expect: list[str] | None = None, exact: bool = False, limit: int | None = None) -> DataFrame:
    """All columns as strings, nulls as ''; a byte-order mark in the header goes.

    ``expect``: required columns, or with ``exact`` the very header.
    """
    df = spark.read.options(**CSV).csv(path)
    df = df.toDF(*(c.lstrip("﻿").strip('"') for c in df.columns))
    if expect is not None:
        require_header(df, expect, exact)
    df = df.na.fill("")
    return df if limit is None else df.limit(limit)


def require_header(df: DataFrame, expect: list[str], exact: bool = False) -> None:
    if exact and df.columns != expect:
        raise ValueError(f"columns_differ:{','.join(df.columns)}")
    missing = sorted(set(expect) - set(df.columns))
    if missing:
        raise ValueError(f"columns_missing:{','.join(missing)}")


def read_csv_numbered(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with ``_csv_row_number``: the header is row 1, so data starts at 2.

    Numbers are exact without gathering the file: a multi-line CSV is one split for each file, so the position in the
    split, which monotonically_increasing_id counts in its lower 33 bits, is the position in the file.
    """
    df = read_csv(spark, path)
    return df.withColumn("_csv_row_number", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 2)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def distinct_names(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The different names in a field of JSON lines, trimmed, without blank ones, in order."""
    rows = read_jsonl(spark, path, f"`{name}` string").select(F.trim(F.col(f"`{name}`")).alias(name))
    return rows.where(F.col(name) != "").distinct().orderBy(name)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds an array of records (or one record)."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_decisions(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, values): decisions as an object with ``decisions`` or a bare list; rows without the key go, the last of a key wins."""
    body = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<map<string,string>>")).otherwise(F.from_json("v", "decisions array<map<string,string>>")["decisions"])
    rows = body.select(F.posexplode(listed).alias("pos", "values")).where(F.coalesce(F.try_element_at("values", F.lit(key)), F.lit("")) != "")
    return rows.groupBy(F.element_at("values", key).alias(key)).agg(F.max_by("values", "pos").alias("values"))


def read_texts(spark: SparkSession, folder: str, manifest: DataFrame, name: str = "file_name", status: str = "status", found: str = "full_text_found") -> DataFrame:
    """Manifest rows with their text bodies, from any folder below; rows of another status or without a file have none.

    A name may be a path: then the file's own path must end with it. Of several files that fit, the first by path counts.
    """
    decoded = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    bodies = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(decoded.alias("_p"), F.col("value").alias("body"))
    bodies = bodies.withColumn("_f", F.element_at(F.split("_p", "/"), -1))
    rows = manifest.select(F.col(name).alias("_n"), F.col(status).alias("_s")).distinct()
    fits = F.col("_p").endswith(F.concat(F.lit("/"), F.regexp_replace("_n", "^(\\./|/)+", "")))
    hit = rows.where(F.col("_s") == found).withColumn("_last", F.element_at(F.split("_n", "/"), -1)).join(bodies, (F.col("_last") == F.col("_f")) & fits)
    first = hit.groupBy("_n").agg(F.min_by("body", "_p").alias("body"))
    return manifest.join(first.withColumnRenamed("_n", "_name"), (F.col(name) == F.col("_name")) & (F.col(status) == found), "left").drop("_name")


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, parent, modified, size) of files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return files.select("path", part(-1).alias("name"), part(-2).alias("parent"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def latest_runs(files: DataFrame) -> DataFrame:
    """(slug, parent): for each name after the first ``_`` of a run folder, the last folder by name."""
    slug = F.regexp_extract("parent", "^[^_]*_(.+)$", 1)
    return files.where(slug != "").groupBy(slug.alias("slug")).agg(F.max("parent").alias("parent"))


def preferred(files: DataFrame, names: list[str]) -> DataFrame:
    """For each parent folder the first of ``names`` that exists."""
    rank = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("name"))
    return files.where(F.col("name").isin(names)).groupBy("parent").agg(F.min_by("path", rank).alias("path"), F.min_by("name", rank).alias("name"))


def confined(root: str, path: str) -> str:
    """``path`` below ``root``; raises if it leads out."""
    import posixpath

    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise PermissionError(f"path_outside_root:{path}")
    return full


def xml_text(xml: Column) -> Column:
    """Text of an XML document, white space collapsed; null where it does not parse."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def one(x):
            if not x or "<!DOCTYPE" in x or "<!ENTITY" in x:  # no entities are expanded
                return None
            try:
                return " ".join(" ".join(ElementTree.fromstring(x).itertext()).split())
            except ElementTree.ParseError:
                return None

        return s.map(one)

    return run(xml)


def pdf_status(content: Column) -> Column:
    """``pdf`` where the bytes carry the magic number, else ``pdf_parse_failed``; extracting text needs a library that is not part of this environment."""
    return F.when(F.substring(content, 1, 4) == F.encode(F.lit("%PDF"), "utf-8"), "pdf").otherwise("pdf_parse_failed")


def pubmed_abstracts(xml: Column) -> Column:
    """An array of (pmid, abstract) of a PubMed answer in XML; sections of an abstract are joined by spaces."""

    @F.pandas_udf("array<struct<pmid:string,abstract:string>>")
    def run(s: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def one(x):
            if not x or "<!ENTITY" in x:
                return []
            try:
                root = ElementTree.fromstring(x)
            except ElementTree.ParseError:
                return []
            out = []
            for article in root.iter("PubmedArticle"):
                text = " ".join(" ".join(" ".join(part.itertext()).split()) for part in article.iter("AbstractText")).strip()
                number = article.findtext(".//PMID")
                if number and text:
                    out.append({"pmid": number.strip(), "abstract": text})
            return out

        return s.map(one)

    return run(xml)


def archived_article(content: Column) -> Column:
    """The XML text of the ``.nxml`` member with the shortest name in a tar.gz; null where there is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import io
        import tarfile

        def one(raw):
            try:
                with tarfile.open(fileobj=io.BytesIO(raw), mode="r:gz") as archive:
                    names = [m for m in archive.getmembers() if m.isfile() and m.name.endswith(".nxml")]
                    return archive.extractfile(min(names, key=lambda m: len(m.name))).read().decode("utf-8", "replace") if names else None
            except (tarfile.TarError, OSError, EOFError, TypeError):
                return None

        return s.map(one)

    return run(content)


def demo_corpus(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Citations of a bundled corpus, one JSON document for each subject: subject_id, subject and the citation's fields."""
    docs = spark.read.option("multiLine", "true").json(path)
    rows = docs.where(F.lower(F.trim("nutrient.name")) == name.strip().lower())
    return rows.select(F.col("nutrient.id").alias("subject_id"), F.col("nutrient.name").alias("subject"), F.explode("citations").alias("c")).select("subject_id", "subject", "c.*")


def pdf_text(content: Column) -> Column:
    """struct(text, status): the text of a PDF's uncompressed and deflated text operators, ``pdf_parse_failed`` where that gives none.

    Reads literal strings shown by Tj, TJ and ' in the page streams, which covers text in simple encodings; encrypted
    files and composite fonts fail, with the status that says so.
    """

    @F.pandas_udf("struct<text:string,status:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        import re
        import zlib

        stream = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
        shown = re.compile(rb"\((?:[^()\\]|\\.)*\)\s*(?:Tj|')|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|Td|TD|ET", re.S)
        literal = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.S)
        escape = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
        plain = {b"n": b"\n", b"r": b" ", b"t": b" ", b"b": b"", b"f": b" "}

        def one(raw):
            if not raw or raw[:4] != b"%PDF" or b"/Encrypt" in raw:
                return None
            out = []
            for m in stream.finditer(raw):
                try:
                    data = zlib.decompress(m[1])
                except zlib.error:
                    data = m[1]
                if b"BT" not in data:
                    continue
                for op in shown.finditer(data):
                    parts = [escape.sub(lambda e: plain.get(e[1], b"") if e[1] in plain else bytes([int(e[1], 8) & 255]) if e[1].isdigit() else e[1] if e[1] in b"()\\" else b"", x) for x in literal.findall(op[0])]
                    out.append(b"".join(parts).decode("latin-1") if parts else " ")
            text = " ".join("".join(out).split())
            return text or None

        texts = s.map(one)
        return pd.DataFrame({"text": texts, "status": texts.map(lambda t: "pdf" if t else "pdf_parse_failed")})

    return run(content)
