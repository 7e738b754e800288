"""Deduplication and keyed merges. Inputs carry an order column; ties never depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One whole row for each key: the first (or last) by ``order``, as one aggregation with partial sums."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def coalescing(df: DataFrame, key: Column, order: str, fill: list[str]) -> DataFrame:
    """One row for each key: ``order`` of the first row, and of each column the first value that is not blank."""
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(order))
    return df.groupBy(key.alias("key")).agg(F.min(order).alias(order), *(F.min_by(c, F.when(blank(c).isNotNull(), F.col(order))).alias(c) for c in fill), F.count("*").alias("n_rows"))


def conflicts(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the row before them with the same key (the log of a last-wins merge)."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    return df.withColumn("_before", F.lag(now).over(w)).where(F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(now)).drop("_before")


def best_row(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row with the largest rank, compared column by column."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank)))).alias("_row")).select(*keys, "_row.*")


def ordered_distinct(df: DataFrame, keys: list[str], order: list[str], value: str, most: int | None = None) -> DataFrame:
    """Values of each key in the order of their first occurrence, without repeats."""
    first = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_first"))
    out = F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda s: s[value])
    return first.groupBy(*keys).agg((F.slice(out, 1, most) if most else out).alias(value))


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` itself; raises ``duplicate_<what>:<ids>`` if a key repeats."""
    bad = [str(r[0]) for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"duplicate_{what}:{','.join(bad)}")
    return df


def citations(df: DataFrame, order: str = "seq", fill: list[str] | None = None) -> DataFrame:
    """Citations by DOI, else PMID, else title without regard to case: the first row stays, its blanks in ``fill`` are filled from later rows.

    Each later row that has an abstract, a page summary or a body adds a sentence with its source to the selection reason.
    """
    from ..functions.text import normalize_doi

    fill = [c for c in (fill or ["abstract", "page_summary", "body_text", "doi", "pmid", "url"]) if c in df.columns]
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    key = F.coalesce(normalize_doi(F.col("doi")), F.concat(F.lit("pmid:"), blank("pmid")), F.lower(F.trim("title")))
    rest = [c for c in df.columns if c not in (order, "selection_reason", *fill)]
    told = F.coalesce(*(blank(c) for c in ("abstract", "page_summary", "body_text") if c in df.columns), F.lit(None).cast("string")).isNotNull()
    note = F.struct(F.col(order).alias("o"), F.concat(F.lit("Merged additional metadata from "), F.col("source"), F.lit(".")).alias("t"))
    first = F.min_by(F.struct(*rest, F.col("selection_reason")), order)
    out = df.groupBy(key.alias("key")).agg(F.min(order).alias(order), first.alias("_f"), *(F.min_by(c, F.when(blank(c).isNotNull(), F.col(order))).alias(c) for c in fill), F.array_sort(F.collect_list(F.when(told, note))).alias("_notes"), F.count("*").alias("n_rows"))
    later = F.transform(F.filter("_notes", lambda n: n["o"] > F.col(order)), lambda n: n["t"])
    reason = F.nullif(F.concat_ws(" ", F.nullif(F.trim("_f.selection_reason"), F.lit("")), F.nullif(F.array_join(later, " "), F.lit(""))), F.lit(""))
    return out.select("key", order, *(F.col(f"_f.{c}").alias(c) for c in rest), *fill, reason.alias("selection_reason"), "n_rows")
