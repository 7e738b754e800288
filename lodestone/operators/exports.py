"""Final tables of merged records: the main rows, effect and tag companions, evidence for import, the public report.

A merged record has id, name, summary_source_type, summary_confidence_status, positive, negative, five effect buckets
(arrays of structs effect_slug, effect_label, summary, evidence_level, score, supporting_nutrients), caveats, model_provider
and model_name. Rows that break a rule leave by a side output with the rule's code instead of ending the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import collapse, name_key, uuid5
from ..sources.sinks import json_cell, write_csv

# Output columns, in order.
MAIN = [
    "canonical_beverage_id", "canonical_beverage_name", "summary_source_type", "summary_confidence_status", "final_positive_summary", "final_negative_summary", "strong_evidence_json", "medium_evidence_json",
    "low_evidence_json", "negative_or_cautionary_effects_json", "supplement_level_only_effects_json", "caveats_json", "model_provider", "model_name", "created_at", "updated_at",
]
EFFECTS = [
    "canonical_beverage_id", "canonical_beverage_name", "effect_slug", "effect_label", "effect_summary", "effect_bucket", "evidence_level", "score", "supporting_nutrients_json", "summary_source_type", "model_provider",
    "model_name", "created_at", "updated_at",
]
TAGS = ["canonical_beverage_id", "canonical_beverage_name", "tag", "tag_type", "source_bucket", "score", "created_at", "updated_at"]
EVIDENCE = [
    "id", "bioactive_type", "bioactive_id", "bioactive_name", "effect_slug", "effect_label", "description", "score", "evidence_level", "tags", "sources", "review_status", "review_notes", "created_at", "updated_at",
]
BUCKETS = ["strong_evidence", "medium_evidence", "low_evidence", "negative_or_cautionary_effects", "supplement_level_only_effects"]
SOURCE_TYPES = ["direct_literature", "composition_based", "unknown"]
FLAGS = {"negative_or_cautionary_effects": "has_cautionary_effects", "supplement_level_only_effects": "has_supplement_level_only_effects"}
NAMESPACE = "c6044f5f-770b-40c5-a87d-4c9fc18d922b"
SUPPORT = {"human_systematic_review": 0.84, "human_rct": 0.75, "human_observational": 0.60, "human_mechanistic": 0.50, "review_author_interpretation": 0.45}


def _text(c) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def main_problem() -> Column:
    """The first broken rule of a merged record; null where it is sound."""
    at = F.concat(F.lit(":"), _text("id"))
    out = F.when(_text("id") == "", "missing_canonical_beverage_id").when(_text("name") == "", F.concat(F.lit("missing_canonical_beverage_name"), at))
    kind = _text("summary_source_type")
    out = out.when(~kind.isin(SOURCE_TYPES), F.concat(F.lit("invalid_summary_source_type"), at, F.lit(":"), kind))
    for column, code in (("summary_confidence_status", "summary_confidence_status"), ("positive", "final_positive_summary"), ("negative", "final_negative_summary")):
        out = out.when(_text(column) == "", F.concat(F.lit(f"missing_{code}"), at))
    for bucket in [*BUCKETS, "caveats"]:
        out = out.when(F.col(bucket).isNull(), F.concat(F.lit("final_main_json_bucket_not_list"), at, F.lit(f":{bucket}")))
    return out


def checked(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound records, and (id, name, problem) of the others; an id that repeats is a problem of each of its rows."""
    twice = merges.groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    marked = merges.join(twice, F.col("id") == F.col("_id"), "left")
    marked = marked.withColumn("problem", F.coalesce(main_problem(), F.when(F.col("_n") > 1, F.concat(F.lit("duplicate_canonical_beverage_id:"), F.col("id")))))
    return marked.where("problem IS NULL").select(*merges.columns), marked.where("problem IS NOT NULL").select("id", "name", "problem")


def main_rows(merges: DataFrame, at: str) -> DataFrame:
    """The 16 columns of the main table; sort by ``order`` when it is written."""
    cells = [json_cell(F.col(b)).alias(f"{b}_json") for b in [*BUCKETS, "caveats"]]
    named = [F.col("id").cast("string").alias(MAIN[0]), F.col("name").alias(MAIN[1]), "summary_source_type", "summary_confidence_status", F.col("positive").alias(MAIN[4]), F.col("negative").alias(MAIN[5])]
    return merges.select(*named, *cells, *(_text(c).alias(c) for c in ("model_provider", "model_name")), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))


def order(*rest: str) -> list:
    """By the name without regard to case, then the id, then ``rest``."""
    return [F.lower("canonical_beverage_name"), "canonical_beverage_id", *rest]


def _each_effect(merges: DataFrame) -> DataFrame:
    buckets = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("effects")) for b in BUCKETS))
    rows = merges.select("id", "name", "summary_source_type", "model_provider", "model_name", F.explode(buckets).alias("b"))
    return rows.select("id", "name", "summary_source_type", "model_provider", "model_name", F.col("b.bucket").alias("bucket"), F.explode("b.effects").alias("e"))


def _score(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def effect_rows(merges: DataFrame, at: str) -> DataFrame:
    """A row of 14 columns for each effect of each bucket; effects without a slug are left to ``slugless``."""
    rows = _each_effect(merges).where(_text("e.effect_slug") != "")
    listed = json_cell(F.coalesce("e.supporting_nutrients", F.array().cast("array<string>")))
    return rows.select(
        F.col("id").cast("string").alias("canonical_beverage_id"), F.col("name").alias("canonical_beverage_name"), F.trim("e.effect_slug").alias("effect_slug"), *(F.coalesce(f"e.{c}", F.lit("")).alias(n) for c, n in (("effect_label", "effect_label"), ("summary", "effect_summary"))),
        F.col("bucket").alias("effect_bucket"), F.coalesce("e.evidence_level", F.lit("")).alias("evidence_level"), _score(F.col("e.score")).alias("score"), listed.alias("supporting_nutrients_json"), "summary_source_type", *(_text(c).alias(c) for c in ("model_provider", "model_name")),
        F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
    )


def slugless(merges: DataFrame) -> DataFrame:
    """(id, name, problem) of effects without a slug."""
    rows = _each_effect(merges).where(_text("e.effect_slug") == "")
    return rows.select("id", "name", F.concat_ws(":", F.lit("missing_effect_slug"), F.col("id").cast("string"), "bucket").alias("problem"))


def tag_rows(merges: DataFrame, at: str) -> DataFrame:
    """Tags of six types, once for each (id, tag, type, bucket), with their highest score."""
    out = F.struct
    tag = lambda value, kind, score: out(value.cast("string").alias("tag"), F.lit(kind).alias("tag_type"), score.cast("double").alias("score"))
    none = F.lit(None).cast("double")
    rows = _each_effect(merges).select("id", "name", "bucket", "e")
    score = F.col("e.score")
    flag = F.create_map(*(F.lit(x) for kv in FLAGS.items() for x in kv))[F.col("bucket")]
    own = F.array(tag(F.col("bucket"), "effect_bucket", none), tag(flag, "routing_flag", none), tag(F.col("e.effect_slug"), "effect_slug", score), tag(F.col("e.effect_label"), "effect_label", score))
    nutrients = F.transform(F.coalesce("e.supporting_nutrients", F.array().cast("array<string>")), lambda x: tag(x, "nutrient", score))
    each = rows.select("id", "name", "bucket", F.explode(F.concat(own, nutrients)).alias("t"))
    kinds = merges.select("id", "name", F.lit("ingredient").alias("bucket"), tag(F.col("summary_source_type"), "source_type", none).alias("t"))
    flat = each.unionByName(kinds).select("id", "name", name_key(F.col("t.tag")).alias("tag"), F.col("t.tag_type").alias("tag_type"), F.col("bucket").alias("source_bucket"), F.col("t.score").alias("score"))
    best = flat.where("tag <> ''").groupBy("id", "tag", "tag_type", "source_bucket").agg(F.min("name").alias("name"), F.max("score").alias("score"))
    return best.select(F.col("id").cast("string").alias("canonical_beverage_id"), F.col("name").alias("canonical_beverage_name"), "tag", "tag_type", "source_bucket", _score(F.col("score")).alias("score"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))


def write_final(merges: DataFrame, folder: str, at: str) -> DataFrame:
    """The main table and its companions as sorted CSV below ``folder``; returns the rows left out, with their problem."""
    sound, broken = checked(merges)
    write_csv(main_rows(sound, at), f"{folder}/main", MAIN, order())
    write_csv(effect_rows(sound, at), f"{folder}/effects", EFFECTS, order("effect_bucket", "effect_slug"))
    write_csv(tag_rows(sound, at), f"{folder}/tags", TAGS, order("tag_type", "tag", "source_bucket"))
    return broken.unionByName(slugless(sound))


def publish_final(merges: DataFrame, folder: str, at: str) -> dict[str, str]:
    """The same tables and the rows left out as one published bundle: readers see all of them or the version before."""
    from ..sources.sinks import write_bundle

    sound, broken = checked(merges)
    tables = {"main": main_rows(sound, at), "effects": effect_rows(sound, at), "tags": tag_rows(sound, at), "rejected": broken.unionByName(slugless(sound))}
    return write_bundle(folder, tables, csv={"main": (MAIN, order()), "effects": (EFFECTS, order("effect_bucket", "effect_slug")), "tags": (TAGS, order("tag_type", "tag", "source_bucket"))})


def stable_id(kind: str, *parts: Column) -> Column:
    """A name-based UUID of the kind and the normalised parts."""
    return uuid5(NAMESPACE, F.concat_ws("|", F.lit(kind), *(name_key(p) for p in parts)))


def support_score(level: Column) -> Column:
    out = F.lit(0.40)
    for name, value in SUPPORT.items():
        out = F.when(level == name, value).otherwise(out)
    return out


def evidence_level(score: Column) -> Column:
    return F.when(score >= 0.75, "strong").when(score >= 0.50, "moderate").otherwise("limited")


def health_evidence(claims: DataFrame, citations: DataFrame, lookup: DataFrame, at: str, seq: str = "seq") -> dict[str, DataFrame]:
    """Evidence rows, new effects, exposure rows and rejected claims of formatted claims.

    ``claims``: seq (their order), bioactive_type, bioactive_id, bioactive_name, citation_id, proposed_claim_id, statement,
    support_level, effect_slug, effect_label, effect_description, description, tags, review_notes, exposure_category,
    dose_or_exposure, concentration_notes. The first claim of each (type, id, slug) passes unless ``lookup`` has that
    key; a passing claim without its citation is rejected after it has taken the slug. Slugs that the lookup knows keep
    its label and make no new effect. Of claims with one place in the order one passes; a claim given twice, in all columns, counts once.

    Only the first claim of each key meets the citations and labels; the others are held against it, and not moved again.
    """
    key = ["bioactive_type", "bioactive_id", "effect_slug"]
    known = lookup.where("coalesce(id, '') <> '' AND coalesce(bioactive_id, '') <> '' AND coalesce(effect_slug, '') <> ''").select(*(F.trim(c).alias(c) for c in key)).distinct().withColumn("_known", F.lit(True))
    labels = lookup.where("trim(coalesce(effect_slug, '')) <> ''").groupBy(F.trim("effect_slug").alias("effect_slug")).agg(F.min_by(F.trim("effect_label"), "lookup_seq").alias("_label"))
    labels = labels.withColumn("_has", F.lit(True))
    told = [c for c in claims.columns if c not in key and c != seq]
    at_ = F.struct(F.col(seq).alias("seq"), F.xxhash64(*told).alias("same"))
    named = claims.where(" AND ".join(f"{c} IS NOT NULL" for c in key))
    first = named.groupBy(*key).agg(F.min(F.struct(at_.alias("at"), F.struct(*told).alias("claim"))).alias("_b"))
    rows = first.select(*key, F.col("_b.at").alias("_first"), "_b.claim.*").join(known, key, "left")
    rows = rows.join(citations.select(F.col("id").alias("citation_id"), F.struct("title", "url", "doi", "pmid", "year").alias("_source")), "citation_id", "left").join(labels, "effect_slug", "left")
    kind = F.when(F.col("_known"), "existing_entity_effect_skipped").when(F.col("_source").isNull(), "invalid_csv_format")
    rows = rows.withColumn("type", kind).withColumn("score", support_score(F.col("support_level")))
    judged = rows.select(*key, "_first", F.col("type").alias("_type")).distinct()
    others = named.withColumn("_at", at_).join(judged, key)
    others = others.withColumn("type", F.when(F.col("_at") != F.col("_first"), "existing_entity_effect_skipped").otherwise(F.col("_type")))
    kept = rows.where("type IS NULL").withColumn("id", stable_id("evidence", F.col("bioactive_type"), F.col("bioactive_id"), F.col("effect_slug")))
    long = F.size(F.split(collapse(F.col("description")), " ")) >= 8
    evidence = kept.select(
        "id", "bioactive_type", "bioactive_id", "bioactive_name", "effect_slug", F.when(F.coalesce("_label", F.lit("")) != "", F.col("_label")).otherwise(F.col("effect_label")).alias("effect_label"), F.when(long, F.col("description")).otherwise(F.col("statement")).alias("description"), "score",
        evidence_level(F.col("score")).alias("evidence_level"), json_cell(F.col("tags")).alias("tags"), json_cell(F.array("_source")).alias("sources"), F.lit("generated").alias("review_status"), "review_notes", F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
    )
    new = kept.where("_has IS NULL").select(stable_id("health-effect", F.col("effect_slug")).alias("id"), "effect_slug", "effect_label", F.col("effect_description").alias("description"), json_cell(F.col("tags")).alias("tags"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"))
    refs = F.array(F.struct("citation_id", "proposed_claim_id"))
    exposure = kept.select(stable_id("exposure", F.col("id")).alias("id"), F.col("id").alias("evidence_row_id"), "bioactive_type", "bioactive_id", "bioactive_name", "effect_slug", "exposure_category", "dose_or_exposure", "concentration_notes", json_cell(refs).alias("source_claims"), F.lit(at).alias("created_at"))
    message = F.when(F.col("type") == "invalid_csv_format", "Missing source metadata for the validated claim.")
    return {"evidence": evidence, "new_effects": new, "exposure": exposure, "rejected": others.where("type IS NOT NULL").select("type", *key, "citation_id", "proposed_claim_id", message.alias("message"))}


def new_entities(claims: DataFrame, lookup: DataFrame, at: str, seq: str = "seq") -> DataFrame:
    """Entities of the claims whose folded name the lookup lacks: type, id, name of their first claim, and a note."""
    known = lookup.select(name_key(F.col("bioactive_name")).alias("_key")).where("_key <> ''").distinct()
    named = claims.select(name_key(F.col("bioactive_name")).alias("_key"), F.col(seq).alias("_seq"), "bioactive_type", "bioactive_id", "bioactive_name").where("_key <> ''")
    first = named.groupBy("_key").agg(F.min_by(F.struct("bioactive_type", "bioactive_id", "bioactive_name"), "_seq").alias("e"))
    rows = first.join(known, "_key", "left_anti")
    return rows.select("e.*", F.lit(at).alias("created_at"), F.lit("Generated because no normalized-name match existed in the lookup CSV.").alias("resolution_note"))


#: What goes into a store, in this order, and what is only to be read.
IMPORTS = ["new_effects", "evidence"]
REVIEW = {"new_entities": "entities that the lookup lacks", "exposure": "exposure that the evidence table has no columns for", "rejected": "claims that repeat known evidence or lack their source"}


def import_note(tables: dict[str, DataFrame]) -> str:
    """Markdown: which tables to import, in order, with their columns, and which are for review."""
    steps = [f"{i}. `{name}`: {', '.join(tables[name].columns)}" for i, name in enumerate((n for n in IMPORTS if n in tables), 1)]
    return "\n".join(["# Import order", "", *steps, "", "Effects come first: evidence refers to their slugs. The two tables have different columns and go to different places.", "", "# For review only", "", *(f"- `{n}`: {what}" for n, what in REVIEW.items() if n in tables), ""])


def write_export(folder: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """The export bundle, published as a whole: CSV tables, evidence and rejected rows as JSON lines, row counts in the manifest, a note on imports."""
    from ..sources.sinks import write_bundle

    csv = {name: (EVIDENCE if name == "evidence" else tables[name].columns, ["bioactive_id" if name == "new_entities" else "id"]) for name in ("evidence", "new_effects", "new_entities", "exposure") if name in tables}
    every = tables | {"evidence_lines": tables["evidence"]}
    return write_bundle(folder, every, notes={"IMPORT.md": import_note(tables)}, csv=csv)


def report_rows(claims: DataFrame) -> DataFrame:
    """Accepted claims as report lines: (place, effect, citation_id, claim_id, line), by effect without regard to case, citation and claim.

    Places are numbers within an effect and citation plus those of the ones before it, so no task orders all claims, nor those of an effect.
    """
    from .folds import places

    line = F.concat(F.lit("- "), F.concat_ws(" ", "statement", F.concat(F.lit("["), "citation_id", F.lit("]")), F.when(F.size("limitations") > 0, F.concat(F.lit("Limitations: "), F.array_join("limitations", "; ")))))
    rows = claims.where("accepted").select("effect", "citation_id", "claim_id", line.alias("line"))
    return places(rows, [], [F.lower("effect"), "citation_id", "claim_id"], F.lower("effect"), within=F.col("citation_id")).select("place", "effect", "citation_id", "claim_id", "line")


# How levels of support are told to the public.
PUBLIC_LEVELS = {
    "human_systematic_review": "Human systematic review", "human_rct": "Human RCT", "human_observational": "Human observational study", "human_mechanistic": "Human mechanistic study", "review_author_interpretation": "Review of human evidence", "unsupported": "Unsupported",
}


def _told_level(level: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PUBLIC_LEVELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, level), F.initcap(F.replace(level, F.lit("_"), F.lit(" "))))


#: Columns of the report's table that a reader sees, with their headings.
REPORT = {"health_effect": "Health effect", "direction": "Direction", "population": "Population", "oral_exposure": "Oral exposure", "evidence": "Evidence", "finding": "Finding", "status": "Status", "source_title": "Source"}


#: Columns that a report takes from validated claims; proposed claims may have columns of these names.
VALIDATED = ["proposed_claim_id", "citation_id", "verdict", "support_level", "validated_statement", "limitations"]


def public_report(validated: DataFrame, proposed: DataFrame, sources: DataFrame, late: dict[str, Column] | None = None) -> DataFrame:
    """The rows of a public report, one for each validated claim, with ``place`` in the report.

    ``validated``: proposed_claim_id, citation_id, verdict, support_level, validated_statement, limitations; ``proposed``: id,
    proposed_effect_label, proposed_effect_slug, direction, population, dose_or_exposure, exposure_category, study_type,
    statement; ``sources``: id, title, doi, pmid, url. Where several validated claims rest on one proposed claim, ``validated``
    tells them apart by a claim_id of its own. ``late`` makes columns of a claim, other than ids and the effect's label, from
    others of both tables: rows cross the network without these, without the report's wording and without their source.
    """
    from .folds import numbered_parts

    told = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    said = proposed.select(F.col("id").alias("proposed_claim_id"), *(c for c in proposed.columns if c not in ("id", "claim_id", *VALIDATED)))
    at = {"_of": F.struct(F.lower("proposed_effect_label").alias("_of")), "_part": F.struct(F.col("citation_id").alias("part"))}
    rows = validated.join(said, "proposed_claim_id").repartition(*at.values()).withColumns(at).withColumns(late or {})
    rows = rows if "claim_id" in rows.columns else rows.withColumn("claim_id", F.col("proposed_claim_id"))
    rows = rows.select(
        *at, "claim_id", "citation_id", F.col("proposed_effect_slug").alias("effect_slug"), F.col("proposed_effect_label").alias("health_effect"), F.initcap("direction").alias("direction"), F.coalesce(told("population"), F.lit("Not reported")).alias("population"),
        F.coalesce(told("dose_or_exposure"), F.replace("exposure_category", F.lit("_"), F.lit(" "))).alias("oral_exposure"), "dose_or_exposure", "exposure_category", "study_type", _told_level(F.col("support_level")).alias("evidence"), F.coalesce(told("validated_statement"), F.col("statement")).alias("finding"),
        F.when(F.col("verdict") == "supported_with_limitations", "Supported with limitations").otherwise("Supported").alias("status"), F.to_json(F.coalesce("limitations", F.array().cast("array<string>"))).alias("limitations"),
    )
    # an id that several sources have makes a row for each: they stand one after the other
    same = Window.partitionBy("id")
    known = sources.where("id IS NOT NULL").select("*", F.struct(F.col("id").alias("part")).alias("_part"), F.row_number().over(same.orderBy("title", "doi", "pmid", "url")).alias("_copy"), F.count("*").over(same).alias("_copies"))
    counts = validated.select("proposed_claim_id", "citation_id").join(said, "proposed_claim_id").groupBy(*(c.alias(n) for n, c in at.items())).agg(F.count("*").alias("_n"))
    counts = counts.join(known.where("_copy = 1").select("_part", "_copies"), "_part", "left").select(*at, (F.col("_n") * F.coalesce("_copies", F.lit(1))).alias("_n"))
    rows = numbered_parts(rows, [], ["claim_id"], counts, known.select("_part", F.col("title").alias("_title"), "doi", "pmid", F.col("url").alias("source_url"), "_copy", "_copies"))
    place = F.col("_before") + (F.col("_i") - 1) * F.coalesce("_copies", F.lit(1)) + F.coalesce("_copy", F.lit(1))
    return rows.select(
        "claim_id", "citation_id", "effect_slug", "health_effect", "direction", "population", "oral_exposure", "dose_or_exposure", "exposure_category", "study_type", "evidence", "finding", "status", "limitations", F.coalesce("_title", "citation_id").alias("source_title"), "doi", "pmid", "source_url",
        place.alias("place"),
    )


def report_table(rows: DataFrame) -> DataFrame:
    """Lines of a Markdown table of the report, by place; cells in one line, bars escaped."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, REPORT)), F.lit(" |"))
    return rows.select("place", line.alias("line"))


def write_report(folder: str, substance: str, rows: DataFrame, counts: dict[str, int]) -> dict[str, str]:
    """The public report, published as a whole: rows as CSV and JSON lines, the table's lines, and a Markdown summary of the counts."""
    from ..sources.sinks import write_bundle

    head = ["| " + " | ".join(REPORT.values()) + " |", "|" + " --- |" * len(REPORT)]
    summary = "\n".join([f"## {substance} Human-Health Evidence", "", *(f"- {name.replace('_', ' ').capitalize()}: {n}" for name, n in counts.items()), "", *head, ""])
    table = report_table(rows).orderBy("place")
    return write_bundle(folder, {"claims": rows, "claims_csv": rows, "table": table}, notes={"REPORT.md": summary}, csv={"claims_csv": (rows.columns, ["place"])})
