"""Profiles, references and taxonomies put together from several tables by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def rollup(decisions: DataFrame, group: str, kind: str, order: str, fields: list[str], listed: str, direct: str, reuse: str, score: str | None = None) -> DataFrame:
    """One row for each group of direct and reused members: their numbers, the representative's fields and the distinct ``listed``.

    The representative is the first direct member, else the first; other kinds and blank groups take no part.
    """
    k = F.col(kind)
    first = F.min_by(F.struct(*fields), F.struct((k != direct).alias("d"), F.col(order)))
    best = [F.max(score).alias(score)] if score else []
    some = decisions.where(k.isin(direct, reuse) & (F.trim(F.col(group).cast("string")) != ""))
    out = some.groupBy(group).agg(F.count_if(k == direct).alias("n_direct"), F.count_if(k == reuse).alias("n_reuse"), first.alias("_f"), F.array_sort(F.collect_set(listed)).alias(listed), *best)
    return out.select(group, "n_direct", "n_reuse", "_f.*", listed, *([score] if score else []))


def canonical_rows(rows: DataFrame, slug: str, canonical: Column, order: str, fields: list[str], created: str, updated: str) -> DataFrame:
    """Rows moved to their canonical slug: the fields of the last row that already has it, else of the last, and the span of times.

    Blank times are ignored.
    """
    time = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    base = F.max_by(F.struct(*fields), F.struct((F.col(slug) == canonical).alias("own"), F.col(order)))
    out = rows.groupBy(canonical.alias("_c")).agg(base.alias("_f"), F.min(time(created)).alias("_min"), F.max(time(updated)).alias("_max"), F.count("*").alias("n_rows"))
    return out.select(F.col("_c").alias(slug), "_f.*", F.col("_min").alias(created), F.col("_max").alias(updated), "n_rows")


def settled(rows: DataFrame, slug: str, order: str, definition: list[str], tag: str) -> DataFrame:
    """(slug, definition of the last row, tags of all, n_definitions, status): 'conflict' where a slug has several definitions."""
    d = F.struct(*definition)
    out = rows.groupBy(slug).agg(F.max_by(d, order).alias("_d"), F.array_sort(F.collect_set(tag)).alias("tags"), F.size(F.collect_set(F.to_json(d, {"ignoreNullFields": "false"}))).alias("n_definitions"))
    return out.select(slug, "_d.*", "tags", "n_definitions", F.when(F.col("n_definitions") > 1, "conflict").otherwise("single").alias("status"))


def most_confident(rows: DataFrame, key: str, value: str, score: str, order: str) -> DataFrame:
    """The value of the highest score, the first on ties; a null score is below all."""
    best = F.min_by(value, F.struct(F.coalesce(-F.col(score), F.lit(float("inf"))).alias("s"), F.col(order)))
    return rows.groupBy(key).agg(best.alias(value), F.max(score).alias(score))


def bucket_totals(rows: DataFrame, buckets: list[str]) -> DataFrame:
    """One row: rows, rows with anything in a bucket, and the entries of each bucket; null buckets are empty."""
    n = lambda c: F.coalesce(F.size(F.col(c)).cast("long"), F.lit(0))
    total = sum((n(c) for c in buckets), F.lit(0).cast("long"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(total > 0).alias("n_filled"), *(F.coalesce(F.sum(n(c)), F.lit(0)).alias(f"n_{c}") for c in buckets))


def completed(expected: DataFrame, answers: DataFrame, key: str, value: str, fallback: Column) -> DataFrame:
    """Each expected row with its answer, or the fallback and ``is_fallback``; answers under other keys are ignored.

    Of several answers to a key the smallest value counts, so no expected row is repeated.
    """
    a = answers.groupBy(key).agg(F.min(value).alias("_v"), F.lit(True).alias("_a"))
    return expected.join(a, key, "left").withColumn(value, F.when(F.col("_a"), F.col("_v")).otherwise(fallback)).withColumn("is_fallback", F.col("_a").isNull()).drop("_v", "_a")


def assembled(base: DataFrame, direct: DataFrame, composed: DataFrame, key: str) -> DataFrame:
    """The base rows with ``origin`` by which of two tables knows the key: both, direct, composition, or skipped.

    Both tables count as sets of keys.
    """
    d, c = (t.select(key).distinct().withColumn(n, F.lit(True)) for t, n in ((direct, "_d"), (composed, "_c")))
    origin = F.when(F.col("_d") & F.col("_c"), "both").when(F.col("_d"), "direct").when(F.col("_c"), "composition").otherwise("skipped")
    return base.join(d, key, "left").join(c, key, "left").withColumn("origin", origin).drop("_d", "_c")


def profiles(rows: DataFrame, key: str, amounts: str, aliases: DataFrame, references: DataFrame) -> DataFrame:
    """(key, source_key, name, amount, unit, reference): a JSON object of amounts as rows, one for each usable entry.

    Usable: a finite number other than 0 whose source_key is an alias (source_key, name, unit, once each). References
    (name, reference, once each) meet names without regard to case; rows without one stay, with null.
    """
    parts = rows.select(key, F.explode(F.from_json(amounts, "map<string,string>")).alias("source_key", "_v")).withColumn("amount", F.expr("try_cast(_v AS double)"))
    some = parts.where("amount IS NOT NULL AND amount <> 0 AND NOT isnan(amount) AND abs(amount) < double('infinity')").drop("_v")
    r = references.select(F.lower("name").alias("_n"), "reference")
    named = some.join(aliases.select("source_key", "name", "unit"), "source_key")
    return named.join(r, F.lower(F.col("name")) == F.col("_n"), "left").select(key, "source_key", "name", "amount", "unit", "reference")


def identities(known: DataFrame, new: DataFrame, name: str, order: str) -> DataFrame:
    """The new rows whose name (trimmed, any case) is not known yet; the first row of a name blocks later ones."""
    n = F.lower(F.trim(F.col(name)))
    fresh = new.withColumn("_n", n).where("_n <> ''").join(known.select(n.alias("_n")).distinct(), "_n", "left_anti")
    rest = F.struct(*new.columns)
    return fresh.groupBy("_n").agg(F.min_by(rest, F.col(order)).alias("_r")).select("_r.*")


def limited_fold(first: Column, others: list[Column], limit: int) -> Column:
    """An array of buckets without repeats. The first marks what its limit cuts as seen; later ones are limited before seen items go."""
    none = F.array().cast("array<string>")
    filled = lambda c: F.coalesce(c, none)
    seen, out = F.array_distinct(filled(first)), [F.slice(F.array_distinct(filled(first)), 1, limit)]
    for c in others:
        cut = F.slice(F.array_distinct(filled(c)), 1, limit)
        out.append(F.array_except(cut, seen))
        seen = F.array_union(seen, cut)
    return F.array(*out)


def mapping_status(found: list[tuple[str, Column]], default: str = "unmapped") -> Column:
    """The name of the first place that has the row; places in order of precedence."""
    out = F.lit(default)
    for name, here in reversed(found):
        out = F.when(here, name).otherwise(out)
    return out


def next_action(steps: list[tuple[str, Column]], done: str = "complete") -> Column:
    """The first step whose condition (nothing made yet, or rows that wait) holds."""
    return mapping_status([(n, F.coalesce(c, F.lit(False))) for n, c in steps], done)


def dose_thresholds(override: Column, reference: Column, limit: Column, share: float = 0.1) -> Column:
    """struct(amount, basis, status): a reviewed override, else a share of the reference, else of the caution limit, else none."""
    row = lambda a, b, s: F.struct(a.cast("double").alias("amount"), F.lit(b).alias("basis"), F.lit(s).alias("status"))
    none = row(F.lit(None), "none", "needs_meaningful_review")
    return F.when(override.isNotNull(), row(override, "override", "reviewed")).when(reference > 0, row(reference * share, "reference", "draft_meaningful_baseline")).when(limit > 0, row(limit * share, "caution_limit", "draft_meaningful_baseline")).otherwise(none)


def not_above(amount: Column, unit: Column, upper: Column, upper_unit: Column) -> Column:
    """Whether an upper threshold of the same unit, by its first word, is not above the lower one."""
    primary = lambda u: F.regexp_extract(u, r"^\s*(\S+)", 1)
    return F.coalesce((primary(unit) == primary(upper_unit)) & (primary(unit) != "") & (upper <= amount), F.lit(False))


def band_status(amount: Column, unit: Column, upper: Column, upper_unit: Column, excluded: Column) -> Column:
    """The review status of a lower threshold against an upper one of the same unit; blank parts need a review."""
    known = amount.isNotNull() & F.coalesce(F.trim(unit) != "", F.lit(False))
    above = not_above(amount, unit, upper, upper_unit)
    return F.when(excluded, "not_applicable").when(~known, "needs_meaningful_review").when(above, "needs_meaningful_review_non_monotonic").otherwise("draft_meaningful_baseline")


#: Texts of migrated thresholds (fixed values).
NO_THRESHOLD = "No meaningful threshold set; needs reference-backed meaningful-dose review."
NO_SUPPLEMENT = "Not yet reviewed; populate after supplement-dose reference review."


# What the bands of a dose mean, with {a} and {u} for the meaningful amount and unit, {b} and {v} for those of supplements.
UNDEFINED = "Not yet defined; reviewer must set meaningful threshold before dose routing."
TRACE = "< {a} {u}; do not surface direct health-effect claims, only optional background presence language."
OPEN_BAND = ">= {a} {u}; eligible for normal food-level/naturally occurring health-effect summaries when evidence context supports the effect."
CROSSED_BAND = OPEN_BAND + " Supplement threshold is not above the meaningful threshold; review thresholds before routing supplement-level effects."
CLOSED_BAND = ">= {a} {u} and below {b} {v}; eligible for normal food-level/naturally occurring health-effect summaries."
ACID = "pH <= {b}; high-acidity context may be considered when the effect context matches the recipe acidity. This is not a supplement-dose threshold."
SUPPLEMENT = ">= {b} {v}; supplement-level, therapeutic-dose, high-caution, or high-exposure effects may be considered when the effect context matches the recipe dose."


def filled_in(text: str, **cells: Column) -> Column:
    """A text with columns in place of names in braces."""
    import re

    return F.concat(*(cells[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w\})", text) if p))


def migrated_thresholds(rows: DataFrame, reference: DataFrame, name: str = "canonical_bioactive_name") -> DataFrame:
    """Rows of the old three-column threshold schema in the new one: amount, unit, basis, source and status, each for meaningful and supplement doses.

    ``reference`` (name, reference_type, threshold_notes, source) gives context; columns that a row lacks are blank, and a
    value that the new schema already has stays.
    """
    wanted = [f"{k}_threshold_{c}" for k in ("meaningful", "supplement") for c in ("amount", "unit", "basis", "source")]
    wanted += ["meaningful_review_status", "supplement_review_status", "threshold_basis", "source", "review_status", "notes"]
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit("")
    told = reference.select(F.col(name).alias("_n"), *(F.coalesce(F.trim(c), F.lit("")).alias(f"_{c}") for c in ("reference_type", "threshold_notes", "source")))
    flat = rows.select(F.col(name), *(blank(c).alias(c) for c in wanted)).join(told, F.col(name) == F.col("_n"), "left").fillna("", ["_reference_type", "_threshold_notes", "_source"])
    first = lambda *cells: F.coalesce(*(F.nullif(c, F.lit("")) for c in cells), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, "^[; ]+|[; ]+$", "")
    has = lambda k: (F.col(f"{k}_threshold_amount") != "") & (F.col(f"{k}_threshold_unit") != "")
    context = (F.col("_reference_type") != "") | (F.col("_threshold_notes") != "")
    about = lambda head: trimmed(F.concat(F.lit(f"{head}; reference context: "), F.col("_reference_type"), F.lit("; "), F.col("_threshold_notes")))
    drafted = F.when(context, about("Draft meaningful threshold from existing table")).otherwise(trimmed(F.concat(F.lit("Draft meaningful threshold from existing table; previous basis: "), F.col("threshold_basis"))))
    basis = F.when(has("meaningful"), drafted).when(context, about("No meaningful threshold set")).otherwise(NO_THRESHOLD)
    amount = F.col("meaningful_threshold_amount").try_cast("double")
    upper = F.col("supplement_threshold_amount").try_cast("double")
    status = band_status(F.when(has("meaningful"), amount), F.col("meaningful_threshold_unit"), upper, F.col("supplement_threshold_unit"), F.col(name).cast("string") == "Ph")
    said = lambda text: filled_in(text, a=F.col("meaningful_threshold_amount"), u=F.col("meaningful_threshold_unit"), b=F.col("supplement_threshold_amount"), v=F.col("supplement_threshold_unit"))
    crossed = not_above(amount, F.col("meaningful_threshold_unit"), upper, F.col("supplement_threshold_unit"))
    return flat.select(
        name, "meaningful_threshold_amount", "meaningful_threshold_unit", first(F.col("meaningful_threshold_basis"), basis).alias("meaningful_threshold_basis"), first(F.col("meaningful_threshold_source"), F.col("_source"), F.col("source")).alias("meaningful_threshold_source"),
        first(F.col("meaningful_review_status"), status).alias("meaningful_review_status"), "supplement_threshold_amount", "supplement_threshold_unit",
        F.when(has("supplement"), first(F.col("supplement_threshold_basis"), F.col("threshold_basis"))).otherwise(NO_SUPPLEMENT).alias("supplement_threshold_basis"), F.when(has("supplement"), first(F.col("supplement_threshold_source"), F.col("source"))).otherwise("").alias("supplement_threshold_source"),
        first(F.col("supplement_review_status"), F.when(has("supplement"), F.col("review_status")).otherwise(""), F.lit("needs_supplement_dose_review")).alias("supplement_review_status"),
        F.when(has("meaningful"), said(TRACE)).otherwise(UNDEFINED).alias("trace_definition"), F.when(~has("meaningful"), UNDEFINED).when(~has("supplement"), said(OPEN_BAND)).when(crossed, said(CROSSED_BAND)).otherwise(said(CLOSED_BAND)).alias("meaningful_definition"),
        F.when(~has("supplement"), NO_SUPPLEMENT).when(F.col("supplement_threshold_unit") == "pH", said(ACID)).otherwise(said(SUPPLEMENT)).alias("supplement_definition"), "notes",
    )
