"""Ordered folds: quotas, budgets, deltas, batches and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def quota_fold(buckets: Column, limit: int) -> Column:
    """Buckets (array of arrays of strings) visited in order: repeats of kept items go, each bucket keeps ``limit``.

    An item that the quota cuts is not marked as seen, so a later bucket may keep it. A row's buckets are one record's lists
    and stand in one cell; what is kept, and so searched, is at most the quota times the buckets.
    """
    empty = F.array().cast("array<string>")

    def bucket(state, items):
        kept = F.aggregate(items, empty, lambda k, x: F.when((F.size(k) < limit) & ~F.array_contains(k, x) & ~F.array_contains(state["seen"], x), F.concat(k, F.array(x))).otherwise(k))
        return F.struct(F.concat(state["seen"], kept).alias("seen"), F.concat(state["out"], F.array(kept)).alias("out"))

    start = F.struct(empty.alias("seen"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(buckets, start, bucket)["out"]


def dedupe_flat(df: DataFrame, row: str, item: str, order: list[str]) -> DataFrame:
    """The first occurrence of each item of a row over all buckets."""
    w = Window.partitionBy(row, item).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def budget_prefix(df: DataFrame, group: str, order: str, text: str, most: int, sep: int = 1) -> DataFrame:
    """Rows of each group in order as long as the lengths, with separators, stay within ``most``; nothing after the first overflow."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.length(text), F.lit(0)) + sep).over(w) - sep
    return df.withColumn("used", total).where(F.col("used") <= most)


def deltas(df: DataFrame, order: str, total: str) -> DataFrame:
    """new = growth of the running total (never negative), and the number of rounds without growth up to here.

    One series is ordered as a whole; it has one row for each round.
    """
    w = Window.orderBy(order)
    new = F.greatest(F.lit(0), F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)))
    out = df.withColumn("new", new).withColumn("_n", F.row_number().over(w))
    last = F.max(F.when(F.col("new") > 0, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("zero_rounds", F.col("_n") - F.coalesce(last, F.lit(0))).drop("_n")


def places(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "place", within: Column | None = None) -> DataFrame:
    """Each row's number from 1 among the rows of its keys (none: all rows) by ``order``, without ordering a key in one task.

    ``bucket`` never falls as ``order`` rises, such as the hour of a time or the quotient of an id. Rows are numbered
    within their bucket; the numbers of rows in earlier buckets, counted before the shuffle, are added. Null keys are a key.
    ``within`` parts the rows of a bucket, for buckets that are large themselves: it never falls as ``order`` rises in a bucket.
    """
    if within is not None:
        return _places_within(df, keys, order, bucket, within, name)
    rows = df.withColumn("_b", bucket)
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_at"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    same = F.col("_b").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(before, same).withColumn(name, F.col("_i") + F.col("_before")).select(*df.columns, name)


def _places_within(df: DataFrame, keys: list[str], order: list[str], bucket: Column, within: Column, name: str) -> DataFrame:
    # structs are never null: rows are numbered and joined in one partitioning
    rows = df.withColumns({"_of": F.struct(*keys, bucket.alias("_of")), "_part": F.struct(within.alias("part"))})
    out = numbered_parts(rows, keys, order, rows.groupBy("_of", "_part").agg(F.count("*").alias("_n")))
    return out.withColumn(name, F.col("_i") + F.col("_before")).select(*df.columns, name)


def numbered_parts(rows: DataFrame, keys: list[str], order: list[str], counts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Rows with their number from 1 within their part of a bucket (``_i``), and the count of all that come before that part (``_before``).

    Rows have ``_of`` (a struct of the keys and, as its own ``_of``, the bucket) and ``_part`` (a struct); ``counts`` has how many
    there are of each as ``_n``. What ``more`` tells of a ``_part`` comes with its count (a row each), so that rows are not
    shuffled for it; parts that it lacks keep nulls.
    """
    earlier = lambda *of: F.coalesce(F.sum("_n").over(Window.partitionBy(*of[:-1]).orderBy(of[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = counts.groupBy(F.col("_of").alias("_w")).agg(F.sum("_n").alias("_n")).withColumn("_earlier", earlier(*(f"_w.{k}" for k in keys), "_w._of")).drop("_n")
    before = counts.withColumn("_own", earlier("_of", "_part")).join(whole, F.col("_of") == F.col("_w")).select("_of", "_part", (F.col("_own") + F.col("_earlier")).alias("_before"))
    before = before if more is None else before.join(more, "_part", "left")
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy("_of", "_part").orderBy(*order))).join(before, ["_of", "_part"])


def attempts(df: DataFrame, key: str, order: list[str], previous: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """Attempt numbers of each key from 1, or from the largest number that ``previous`` has, plus 1.

    With a ``bucket`` that never falls as ``order`` rises, as for ``places``, no task orders all attempts of a key.
    """
    out = df.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy(*order))) if bucket is None else places(df, [key], order, bucket, "attempt")
    if previous is None:
        return out
    most = previous.groupBy(key).agg(F.max("attempt").alias("_most"))
    return out.join(most, key, "left").withColumn("attempt", F.col("attempt") + F.coalesce("_most", F.lit(0))).drop("_most")


def best_chunk(text: Column, terms: Column, size: int, step: int) -> Column:
    """struct(score, start, chunk) of the overlapping chunk that holds most terms, the first of equals."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    scored = F.transform(
        starts,
        lambda s: F.struct(
            F.aggregate(terms, F.lit(0), lambda a, t: a + F.contains(F.lower(F.substring(text, s + 1, F.lit(size))), t).cast("int")).alias("score"), (-s).alias("back"), F.substring(text, s + 1, F.lit(size)).alias("chunk")
        ),
    )
    return F.array_max(scored)
