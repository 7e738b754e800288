"""A corpus from raw documents: STAGES, each written as Parquet and read again as the next one's input.

1. language: documents without a letter, or of no language that the model knows, go; a null lang is filled in.
2. near_duplicates: one document (the smallest id) of each near-duplicate class stays.
3. repeats: bytes of 100-byte strings that occur earlier go; a document of which nothing is left goes.
4. decontamination: documents that hold a benchmark window go.
5. mixing: documents are sampled towards the target shares of sources, languages and topics.

Cases: decisions hold for an id together with its text, so rows that share an id keep their own texts, and rows without
an id go or stay like any other; null columns, empty and very long texts, ties, repeated rows and empty tables are
taken as the stage's operator takes them; columns beside those of documents are passed through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, language, mixing, order_minhash, suffix
from lodestone.llm.common import checkpoint_dir, cut, table, without


def _own(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _key():
    return F.xxhash64(F.col("text").cast("string"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is of a known language; a null lang is that of the text."""
    model = language.fit(docs)
    found = language.identify(docs, model)
    kept = without(docs, found.where("lang_pred = 'und' OR score = 0").select("doc_id", "key"), "doc_id", _key())
    if not docs.where("lang is null").limit(1).count():
        return kept
    none, key, value = _own(docs, "id"), _own(docs, "key"), _own(docs, "lang")
    blank = language.identify(docs.where("lang is null"), model).select(F.col("doc_id").alias(none), F.col("key").alias(key), F.col("lang_pred").alias(value)).distinct()
    named = kept.join(blank, kept["doc_id"].eqNullSafe(blank[none]) & (_key() == blank[key]), "left")
    return named.select(*(F.coalesce(kept[c], F.when(F.col(value) != "und", F.col(value))).alias(c) if c == "lang" else kept[c] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class; of rows that repeat id and text, one. Rows without words stay."""
    found = cut(order_minhash.near_duplicates(docs))
    kept = without(docs, found.where("not kept").select("doc_id", "key"), "doc_id", _key())
    again = cut(found.where("kept").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"))
    if not again.limit(1).count():
        return kept
    of, none, value = _own(docs, "of"), _own(docs, "again"), _own(docs, "key")
    again = again.toDF(none, value)
    more = kept.withColumn(of, _key()).join(again, F.col("doc_id").eqNullSafe(F.col(none)) & (F.col(of) == F.col(value)))
    return without(kept, again, "doc_id", _key()).unionByName(more.dropDuplicates([none, value]).select(*(F.col(f"`{c}`") for c in docs.columns)))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = suffix.without_repeats(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id", "key"), "doc_id", _key())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [("language", language_id), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("mixing", mix)]

#: Learned models, sketches and raking have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage keeps of ``documents``."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before has been read for the last time
            old = path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
