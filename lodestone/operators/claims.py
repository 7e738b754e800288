"""Claims: acceptance, rerouting, schema checks with coercion, projections between claim families, guarded joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import name_key, slugify

# What marks a text as preclinical, terms of rerouted cautions, stems of cautionary effects.
PRECLINICAL = [
    r"\bin[\s-]?vitro\b", r"\bcell line(s)?\b", r"\bcultured cells?\b", r"\badipocytes?\b", r"\bastrocytes?\b", r"\bneurons?\b", r"\bcolon cancer cells?\b", r"\b3t3-l1\b", r"\bcaco-?2\b", r"\bhank'?s buffer\b",
    r"\bmouse cell\b", r"\brat model\b", r"\bmouse model\b", r"\bmice\b", r"\brats?\b", r"\banimal model\b",
]
CONCENTRATION = r"\b\d+(\.\d+)?\s*(ug|µg|mcg|mg)\s*/\s*(ml|l)\b"
PRECLINICAL_TYPES = ["animal", "in_vitro", "mechanistic_theory"]
REROUTED_NUTRIENTS = ["fiber", "carbohydrates"]
BENEFIT_CONTEXTS = [
    "dietary fiber", "fermentable fiber", "fiber and whole grains", "fiber can", "fiber in whole", "fiber intake", "higher fiber", "inulin", "non-digestible fiber", "nondigestible fiber", "prebiotic fiber", "soluble fiber",
    "whole grain", "whole-grain", "whole wheat",
]
BENEFITS = [
    "bifidogenic", "blood glucose regulation", "blunt postprandial glucose", "bowel regularity", "butyrate", "cardiovascular health", "colon health", "colorectal cancer risk", "digestive health", "glycemic control", "gut microbiota",
    "insulin sensitivity", "ldl cholesterol", "lower colorectal cancer", "lower ldl", "regularity", "satiety", "short-chain fatty acid",
]
HARMS = [
    "added sugar", "added sugars", "adverse", "blood glucose spikes", "discomfort", "bloating", "gas", "high intake", "high glycemic load", "high sugar", "higher risk", "impair", "increase risk", "increased risk", "lack of fiber",
    "large dose", "negative", "poor glycemic", "poorer", "rapidly absorbed", "refined", "sugar content", "sugars", "uncertain", "worsen",
]
CAUTIONARY = [
    "adverse", "blood[-_ ]?pressure", "body[-_ ]?weight", "cancer", "cardiometabolic", "caries", "cardiovascular[-_ ]?risk", "diabetes", "dental", "glycemic", "harm", "hypertension", "inflammation", "kidney", "ldl", "mortality",
    "obesity", "risk", "toxic", "weight[-_ ]?gain",
]
NO_STATEMENT = "Accepted direct-literature claim without validated statement."


def _text(*cells: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cells))


def is_preclinical(*cells: Column) -> Column:
    """The cells name cells, animals or a concentration in a solution."""
    return F.regexp_like(_text(*cells), F.lit("|".join([*PRECLINICAL, CONCENTRATION])))


def ingredient_accepted(claim: Column, cells: list[str]) -> Column:
    """A claim with an oral exposure, not of preclinical evidence by its type or by the text of ``cells``."""
    oral = F.trim(F.coalesce(claim["oral_exposure"], F.lit(""))) != ""
    return oral & ~F.coalesce(claim["evidence_type"].isin(PRECLINICAL_TYPES), F.lit(False)) & ~is_preclinical(*(claim[c] for c in cells))


def applies_to(claim: Column) -> Column:
    """Evidence on extracts and supplements is form_specific, so that it does not pass to a group's members."""
    return F.when(claim["exposure_category"] == "extract_or_supplement", "form_specific").otherwise(claim["claim_applies_to_group_members"])


def _any(cell: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(cell, t))


def is_false_caution(effect: Column) -> Column:
    """A cautionary effect that is a benefit: of a rerouted nutrient, with a context and a benefit and no harm in its text."""
    text = _text(effect["effect_slug"], effect["effect_label"], effect["summary"], effect["evidence_level"])
    nutrient = F.exists(F.coalesce(effect["supporting_nutrients"], F.array().cast("array<string>")), lambda n: F.lower(n).isin(REROUTED_NUTRIENTS))
    return nutrient & _any(text, BENEFIT_CONTEXTS) & _any(text, BENEFITS) & ~_any(text, HARMS)


def regular_bucket(effect: Column) -> Column:
    """The evidence bucket of an effect, by its level or its score."""
    level, score = F.lower(F.coalesce(effect["evidence_level"], F.lit(""))), F.coalesce(effect["score"], F.lit(0.0))
    strong = level.contains("strong") | (score >= 0.8)
    return F.when(strong, "strong_evidence").when(level.contains("moderate") | level.contains("medium") | (score >= 0.55), "medium_evidence").otherwise("low_evidence")


def rerouted(cautions: Column, regular: Column) -> Column:
    """struct(cautions, regular): false cautions move to the regular effects, in order, unless their slug is there already; a moved slug blocks later ones."""

    def step(state, e):
        blocked = F.exists(state["regular"], lambda r: r["effect_slug"] == e["effect_slug"])
        moved = F.struct(state["cautions"].alias("cautions"), F.concat(state["regular"], F.array(e)).alias("regular"))
        stays = F.struct(F.concat(state["cautions"], F.array(e)).alias("cautions"), state["regular"].alias("regular"))
        return F.when(F.coalesce(is_false_caution(e), F.lit(False)) & ~F.coalesce(blocked, F.lit(False)), moved).otherwise(stays)

    return F.aggregate(cautions, F.struct(F.filter(cautions, lambda _: F.lit(False)).alias("cautions"), regular.alias("regular")), step)


#: Buckets of regular effects, and the one of cautions.
REGULAR, NEGATIVE = ["strong_evidence", "medium_evidence", "low_evidence"], "negative_or_cautionary_effects"


def _moved_to(bucket: str) -> Column:
    return F.transform(F.filter("_r.moved", lambda m: m["to"] == bucket), lambda m: m["effect"])


def reroute(rows: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with false cautions moved to the bucket of their evidence, and the log of the moves (carry, place, effect_slug, moved_to, effect).

    Cautions are taken in order. One stays if its slug is that of a regular effect or of one moved before it; an empty slug
    blocks nothing until a caution without one has moved. Null buckets are empty.
    """
    kind = rows.schema[NEGATIVE].dataType.elementType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    of = lambda b: F.coalesce(F.col(b), none)
    slug = lambda e: F.coalesce(e["effect_slug"], F.lit(""))
    taken = F.filter(F.flatten(F.array(*(F.transform(of(b), slug) for b in REGULAR))), lambda s: s != "")

    def step(state, e):
        stays = F.array_contains(state["slugs"], slug(e)) | ~F.coalesce(is_false_caution(e), F.lit(False))
        kept = F.struct(F.concat(state["stays"], F.array(e)).alias("stays"), state["moved"].alias("moved"), state["slugs"].alias("slugs"))
        moved = F.struct(state["stays"].alias("stays"), F.concat(state["moved"], F.array(F.struct(regular_bucket(e).alias("to"), e.alias("effect")))).alias("moved"), F.concat(state["slugs"], F.array(slug(e))).alias("slugs"))
        return F.when(stays, kept).otherwise(moved)

    start = F.struct(none.alias("stays"), F.array().cast(f"array<struct<to:string,effect:{kind.simpleString()}>>").alias("moved"), taken.alias("slugs"))
    done = rows.withColumn("_r", F.aggregate(of(NEGATIVE), start, step))
    out = done.select(*(F.col("_r.stays").alias(c) if c == NEGATIVE else F.concat(of(c), _moved_to(c)).alias(c) if c in REGULAR else F.col(c) for c in rows.columns))
    log = done.select(*carry, F.posexplode("_r.moved").alias("place", "m")).select(*carry, "place", F.coalesce("m.effect.effect_slug", F.lit("")).alias("effect_slug"), F.lit(NEGATIVE).alias("moved_from"), F.col("m.to").alias("moved_to"), F.col("m.effect").alias("effect"))
    return out, log


def is_cautionary(effect: Column, nutrients: list[str]) -> Column:
    """A cautionary stem in slug, label or summary, and a cautionary nutrient or none at all."""
    own = F.coalesce(effect["supporting_nutrients"], F.array().cast("array<string>"))
    about = (F.size(own) == 0) | F.exists(own, lambda n: F.lower(n).isin(nutrients))
    return about & F.regexp_like(_text(effect["effect_slug"], effect["effect_label"], effect["summary"]), F.lit("|".join(CAUTIONARY)))


def split_cautions(effects: Column, nutrients: list[str]) -> Column:
    """struct(cautionary, regular) of an array of effects."""
    test = lambda e: F.coalesce(is_cautionary(e, nutrients), F.lit(False))
    return F.struct(F.filter(effects, test).alias("cautionary"), F.filter(effects, lambda e: ~test(e)).alias("regular"))


def coerced(c: Column, kind: str, *, choices: list[str] | None = None, aliases: dict[str, str] | None = None, prefix: bool = False, low: float | None = None, high: float | None = None, most: int | None = None) -> tuple[Column, Column]:
    """A value of a schema field and its violation (null if none).

    ``text``: null becomes '', trimmed; ``enum``: lower case with aliases, or the first choice that the value begins with;
    ``number``: within bounds; ``list``: a blank cell is empty, a plain text is a list of one.
    """
    if kind == "list":
        plain = F.trim(F.coalesce(c, F.lit("")))
        parsed = F.from_json(plain, "array<string>")
        return F.when(plain == "", F.array().cast("array<string>")).when(plain.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(plain)), F.lit(None).cast("string")
    if kind == "number":
        value = c.try_cast("double")
        out = F.lit(False)
        out = out if low is None else out | (value < low)
        out = out if high is None else out | (value > high)
        return value, F.when(value.isNull(), "not_a_number").when(out, "out_of_bounds")
    text = F.trim(F.coalesce(c, F.lit("")))
    if kind == "enum":
        key = F.regexp_replace(F.lower(text), r"[\s-]+", "_")
        for a, b in (aliases or {}).items():
            key = F.when(key == a, F.lit(b)).otherwise(key)
        if prefix:
            key = F.coalesce(*(F.when(key.startswith(x), F.lit(x)) for x in choices), key)
        return key, F.when(~key.isin(choices), "not_a_choice")
    return text, F.when(F.length(text) > most, "too_long") if most is not None else F.lit(None).cast("string")


def validated(df: DataFrame, fields: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Rows with coerced fields, and rows that break a rule with their ``violations`` (field:code)."""
    made = {n: coerced(F.col(n), **spec) for n, spec in fields.items()}
    broken = F.filter(F.array(*(F.concat(F.lit(f"{n}:"), v) for n, (_, v) in made.items())), lambda x: x.isNotNull())
    checked = df.withColumn("violations", broken)
    good = checked.where(F.size("violations") == 0).drop("violations")
    return good.withColumns({n: v for n, (v, _) in made.items()}), checked.where(F.size("violations") > 0)


def isolated(df: DataFrame, problem: Column, seq: str, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (line_number, shown columns, error_message) of rows with a problem, which do not stop the others."""
    marked = df.withColumn("_problem", problem)
    return marked.where("_problem IS NULL").drop("_problem"), marked.where("_problem IS NOT NULL").select(F.col(seq).alias("line_number"), *shown, F.col("_problem").alias("error_message"))


def direct_claim(claim: Column, place: Column) -> Column:
    """An accepted claim of the literature as an effect; ``place`` counts from 1. Statement and slug follow their fall-back chains."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    named = F.nullif(slugify(F.concat_ws("_", filled(claim["citation_id"]), filled(claim["proposed_claim_id"])), "_"), F.lit(""))
    slug = F.coalesce(slugify(filled(claim["effect_row_id"]), "_"), named, F.concat(F.lit("claim_"), place.cast("string")))
    statement = F.coalesce(filled(claim["validated_statement"]), filled(claim["claim_scope"]), F.lit(NO_STATEMENT))
    level = F.trim(F.coalesce(claim["support_level"], F.lit("")))
    source = F.struct(*(F.coalesce(claim[c], F.lit("")).alias(c) for c in ("effect_row_id", "citation_id", "verdict", "claim_scope")), level.alias("support_level"))
    return F.struct(F.concat(F.lit("direct_literature_"), slug).alias("effect_slug"), F.lit("Direct literature claim").alias("effect_label"), statement.alias("summary"), source.alias("source_claim"))


def direct_buckets(claims: Column, rule: dict[str, str], other: str) -> dict[str, Column]:
    """Each bucket's effects of an array of claims, in order; ``rule`` leads from support level to bucket, the rest goes to ``other``.

    Claims with accepted = false are left out, and do not count in the places.
    """
    kept = F.filter(claims, lambda c: F.coalesce(c["accepted"], F.lit(True)))
    to = F.create_map(*(F.lit(x) for kv in rule.items() for x in kv))
    made = F.transform(kept, lambda c, i: F.struct(F.coalesce(F.try_element_at(to, F.trim(F.coalesce(c["support_level"], F.lit("")))), F.lit(other)).alias("bucket"), direct_claim(c, i + 1).alias("effect")))

    def of(bucket: str) -> Column:
        return F.transform(F.filter(made, lambda m: m["bucket"] == bucket), lambda m: m["effect"])

    return {b: of(b) for b in dict.fromkeys([*rule.values(), other])}


def compacted(df: DataFrame, keep: list[str], caps: dict[str, int], drop_in: dict[str, list[str]] | None = None) -> DataFrame:
    """Only the columns of ``keep``; of the arrays in ``caps`` the first n elements; of the structs inside arrays in ``drop_in`` without these fields."""

    def cell(c: str) -> Column:
        out = F.slice(c, 1, caps[c]) if c in caps else F.col(c)
        return F.transform(out, lambda e: e.dropFields(*drop_in[c])) if drop_in and c in drop_in else out

    return df.select(*(cell(c).alias(c) for c in keep))


#: Exposure categories of ingredient claims in terms of general ones, and patterns of the food form (fixed values).
EXPOSURES = {"whole_food": "natural_food_level", "juice_or_beverage": "natural_food_level", "powder_or_concentrate": "supplement_level", "extract_or_supplement": "supplement_level"}
BEVERAGE, FRUIT, CONCENTRATE = r"\b(juice|beverage|smoothie)\b", r"\b(pulp|puree|purée|whole fruit|fruit|berry|berries)\b", r"\b(powder|capsule|extract|supplement)\b"


def exposure_of(cells: list[Column], given: Column) -> Column:
    """The exposure category by the claim's text; the given one where that says nothing."""
    text = _text(*cells)
    like = lambda p: F.regexp_like(text, F.lit(p))
    return F.when(like(BEVERAGE), "juice_or_beverage").when(like(FRUIT) & ~like(CONCENTRATE), "whole_food").otherwise(given)


def to_general_claim(df: DataFrame) -> DataFrame:
    """Ingredient claims in the columns of general claims; exposures that have no counterpart are unclear."""
    own = exposure_of([F.col(c) for c in ("ingredient_form", "oral_exposure", "dose_or_serving", "food_matrix", "concentration_notes")], F.col("exposure_category"))
    to = F.create_map(*(F.lit(x) for kv in EXPOSURES.items() for x in kv))
    oral = F.nullif(F.coalesce("oral_exposure", F.lit("")), F.lit(""))
    rows = df.withColumn("_own", own)
    food, concentrate = F.col("_own").isin("whole_food", "juice_or_beverage"), F.col("_own").isin("powder_or_concentrate", "extract_or_supplement")
    return rows.select(
        "id", F.col("ingredient_name").alias("nutrient_name"), "citation_id", "statement", "proposed_effect_slug", "proposed_effect_label", F.col("ingredient_name").alias("compound"), "effect", F.col("claim_direction").alias("direction"), "population",
        F.coalesce(F.nullif(F.col("dose_or_serving"), F.lit("")), oral).alias("dose_or_exposure"), F.when(oral.isNotNull(), "oral").otherwise("unclear").alias("intake_route"), F.coalesce(F.try_element_at(to, F.col("_own")), F.lit("unclear")).alias("exposure_category"),
        F.when(food, "Ingredient-level evidence.").alias("natural_concentration_relevance"), F.when(concentrate, "Concentrated, powder, or extract-like ingredient evidence.").alias("supplement_level_relevance"), "concentration_notes",
    )


def to_ingredient_claim(df: DataFrame) -> DataFrame:
    """General claims in the columns of ingredient claims: the way back, with the widest category of each exposure level."""
    exposure = F.when(F.col("exposure_category") == "natural_food_level", "whole_food").when(F.col("exposure_category") == "supplement_level", "extract_or_supplement").otherwise("unclear")
    return df.select("id", F.col("nutrient_name").alias("ingredient_name"), "citation_id", "statement", "proposed_effect_slug", "proposed_effect_label", "effect", F.col("direction").alias("claim_direction"), "population", F.col("dose_or_exposure").alias("dose_or_serving"), F.when(F.col("intake_route") == "oral", F.col("dose_or_exposure")).alias("oral_exposure"), exposure.alias("exposure_category"), "concentration_notes")


def curation(names: DataFrame, rules: DataFrame, name: str, specific: str, analytical: str) -> DataFrame:
    """The names with a decision and a reason.

    ``rules`` (name, list, text) holds the reviewed lists high, medium, duplicate, vague and preclinical. The order:
    accepted lists, then duplicate (with its own text), vague, the two patterns, preclinical, and what is left.
    """
    lists = rules.groupBy(F.col("name").alias("_key")).agg(F.collect_set("list").alias("_lists"), F.min(F.when(F.col("list") == "duplicate", F.col("text"))).alias("_text"))
    rows = names.join(lists, F.col(name) == F.col("_key"), "left")
    on = lambda x: F.coalesce(F.array_contains("_lists", x), F.lit(False))
    reason = (
        F.when(on("high"), "high").when(on("medium"), "medium").when(on("duplicate"), F.coalesce("_text", F.lit("duplicate"))).when(on("vague"), "vague").when(F.col(name).rlike(specific), "too_specific")
        .when(F.col(name).rlike(analytical), "analytical").when(on("preclinical"), "preclinical").otherwise("too_sparse")
    )
    return rows.select(*names.columns, F.when(on("high") | on("medium"), "accepted").otherwise("rejected").alias("decision"), reason.alias("reason"))


def guarded_join(probe: DataFrame, build: DataFrame, keys: list[str], name: str, build_name: str) -> tuple[DataFrame, DataFrame]:
    """The probe with its match on all keys if the normalised names agree, and (matched, mismatched, unmatched) as one row.

    A mismatch is counted and not joined: its row keeps nulls.
    """
    own = [c for c in build.columns if c not in keys]
    side = build.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in own), F.lit(True).alias("_hit"))
    both = probe.join(side, keys, "left").withColumn("_ok", name_key(F.col(name)).eqNullSafe(name_key(F.col(f"_b_{build_name}"))) & F.col("_hit").isNotNull())
    state = F.when(F.col("_ok"), "matched").when(F.col("_hit").isNotNull(), "mismatched").otherwise("unmatched")
    counts = both.agg(*(F.count_if(state == s).alias(s) for s in ("matched", "mismatched", "unmatched")))
    rows = both.select(*probe.columns, *(F.when(F.col("_ok"), F.col(f"_b_{c}")).alias(c if c not in probe.columns else f"build_{c}") for c in own))
    return rows, counts


def last_summaries(summaries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each composite key."""
    rest = [c for c in summaries.columns if c not in keys]
    return summaries.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def with_summaries(profiles: DataFrame, summaries: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Profiles with the last summary of their composite key; a key without one keeps nulls."""
    return profiles.join(last_summaries(summaries, keys, seq).withColumn("has_summary", F.lit(True)), keys, "left").withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def assembled_sources(identities: DataFrame, key: str, direct: list[DataFrame], mapped: DataFrame, composition: DataFrame, payload: str = "payload") -> DataFrame:
    """(key, direct, composition, source_type, skipped_reason): the five-source assembly.

    ``direct`` tables are tried in order (claims of the first release, of the second, audited ones); ``mapped`` (key,
    target) leads an identity to the target whose composition counts. Literature beats composition for the type, both
    payloads stay; an identity with neither is skipped with the reason.
    """
    out = identities.select(key)
    for i, d in enumerate(direct):
        out = out.join(d.groupBy(key).agg(F.min(payload).alias(f"_d{i}")), key, "left")
    to = mapped.groupBy(key).agg(F.min("target").alias("_to"))
    out = out.join(to, key, "left").withColumn("_of", F.coalesce("_to", F.col(key)))
    out = out.join(composition.groupBy(F.col(key).alias("_of")).agg(F.min(payload).alias("_c")), "_of", "left")
    best = F.coalesce(*(F.col(f"_d{i}") for i in range(len(direct))))
    kind = F.when(best.isNotNull(), "direct_literature").when(F.col("_c").isNotNull(), "composition_based")
    return out.select(key, best.alias("direct"), F.col("_c").alias("composition"), kind.alias("source_type"), F.when(kind.isNull(), F.when(F.col("_to").isNull(), "no_direct_literature_and_no_mapping").otherwise("no_direct_literature_and_no_composition")).alias("skipped_reason"))


def disjoint_union(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables in one, and the keys that more than one row has (none if the union is disjoint)."""
    both = left.unionByName(right)
    return both, both.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def reduction(before: Column, after: Column) -> Column:
    """Per cent by which ``after`` is less than ``before``, two places; 0 where there was nothing."""
    return F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(0.0)


def limited(df: DataFrame, order: list[str], most: int) -> tuple[DataFrame, Column]:
    """The first rows of a trial run, and how many it leaves out."""
    total = df.count()
    return df.orderBy(*order).limit(most), F.lit(max(total - most, 0))


def numbered(df: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Rows with their place (from 1) in a total order, so that results of parallel work can be put back; bucket grows with the order."""
    from .folds import places

    return places(df, [], order, bucket)


def report_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(F.lower(columns[0]), *columns[1:])

