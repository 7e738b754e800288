"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(table: dict, sql: str | None):
    """Register a function (spark, sf_dir) under its name with its SQL."""

    def put(f):
        table[f.__name__] = (f, sql)
        return f

    return put
