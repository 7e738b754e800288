"""Queries of claims, exports, guarded joins, resolvers and stored answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import stages
from ..functions import text as T
from ..operators import claims as C, dedupe, exports as X, nested
from ..sources import resolvers
from .base import query, read

TABLE: dict = {}
AT = "2024-01-01T00:00:00+00:00"

# Merged records of the fixture: a part with its lines as effects, in five buckets.
_BUCKET = "CASE l_linenumber % 5 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(X.BUCKETS)) + " END"
_EFFECT = ["lower(l_returnflag) || '_' || CAST(l_suppkey % 4 AS STRING) AS effect_slug", "'Label ' || l_returnflag AS effect_label", "'Line status ' || l_linestatus AS summary", "l_linestatus AS evidence_level", "l_quantity AS score", "array('n' || CAST(l_suppkey % 3 AS STRING)) AS supporting_nutrients"]


def _merges(spark, sf_dir):
    effect = F.struct(*(F.expr(e) for e in _EFFECT))
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.expr(_BUCKET).alias("bucket"), F.struct("l_orderkey", "l_linenumber", effect.alias("e")).alias("x"))
    listed = lambda b: F.transform(F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("x")))), lambda s: s["e"]).alias(b)
    effects = lines.groupBy("l_partkey").agg(*(listed(b) for b in X.BUCKETS))
    none = F.array().cast("array<struct<effect_slug:string,effect_label:string,summary:string,evidence_level:string,score:double,supporting_nutrients:array<string>>>")
    part = read(spark, sf_dir, "part").join(effects, F.col("p_partkey") == F.col("l_partkey"), "left")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 5, F.when(F.col("p_size") % 2 == 0, "direct_literature").otherwise("composition_based")).otherwise("guess").alias("summary_source_type"), F.col("p_type").alias("summary_confidence_status"), F.col("p_brand").alias("positive"), F.col("p_type").alias("negative"), *(F.coalesce(b, none).alias(b) for b in X.BUCKETS), F.array(F.col("p_brand")).alias("caveats"), F.lit("local").alias("model_provider"), F.lit(None).cast("string").alias("model_name"),
    )


_KIND = "CASE WHEN p_size % 2 = 0 THEN 'direct_literature' ELSE 'composition_based' END"
_SOUND = "SELECT *, CAST(p_partkey AS VARCHAR) AS pid FROM part WHERE p_size > 5"
_DUCK_BUCKET = _BUCKET
_LINES = f"SELECT p.pid, p.p_name, p.kind, l.*, {_DUCK_BUCKET} AS bucket, lower(l_returnflag) || '_' || CAST(l_suppkey % 4 AS VARCHAR) AS slug, 'n' || CAST(l_suppkey % 3 AS VARCHAR) AS nutrient FROM lineitem l JOIN (SELECT *, {_KIND} AS kind FROM ({_SOUND})) p ON l.l_partkey = p.p_partkey"
_DOUBLE = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"


@query(TABLE, f"""SELECT pid AS canonical_beverage_id, p_name AS canonical_beverage_name, {_KIND} AS summary_source_type, p_brand AS final_positive_summary, p_type AS final_negative_summary, '["' || p_brand || '"]' AS caveats_json, 'local' AS model_provider, '' AS model_name, '{AT}' AS created_at FROM ({_SOUND})""")
def final_main_rows(spark, sf_dir):
    rows = X.main_rows(X.checked(_merges(spark, sf_dir))[0], AT)
    return rows.select("canonical_beverage_id", "canonical_beverage_name", "summary_source_type", "final_positive_summary", "final_negative_summary", "caveats_json", "model_provider", "model_name", "created_at")


@query(TABLE, "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'invalid_summary_source_type:' || p_partkey || ':guess' AS problem FROM part WHERE p_size <= 5")
def final_main_problems(spark, sf_dir):
    return X.checked(_merges(spark, sf_dir))[1]


@query(TABLE, f"""SELECT pid AS canonical_beverage_id, p_name AS canonical_beverage_name, slug AS effect_slug, 'Label ' || l_returnflag AS effect_label, 'Line status ' || l_linestatus AS effect_summary, bucket AS effect_bucket, l_linestatus AS evidence_level,
{_DOUBLE.format('l_quantity')} AS score, '["' || nutrient || '"]' AS supporting_nutrients_json, kind AS summary_source_type, 'local' AS model_provider, '' AS model_name, '{AT}' AS created_at, '{AT}' AS updated_at FROM ({_LINES})""")  # fmt: skip
def final_effect_rows(spark, sf_dir):
    return X.effect_rows(X.checked(_merges(spark, sf_dir))[0], AT)


@query(TABLE, f"""WITH l AS ({_LINES}), t AS (
SELECT pid, p_name, bucket AS tag, 'effect_bucket' AS tag_type, bucket, NULL::DOUBLE AS score FROM l UNION ALL SELECT pid, p_name, 'has_cautionary_effects', 'routing_flag', bucket, NULL FROM l WHERE bucket = 'negative_or_cautionary_effects'
UNION ALL SELECT pid, p_name, 'has_supplement_level_only_effects', 'routing_flag', bucket, NULL FROM l WHERE bucket = 'supplement_level_only_effects' UNION ALL SELECT pid, p_name, slug, 'effect_slug', bucket, l_quantity FROM l
UNION ALL SELECT pid, p_name, lower('Label ' || l_returnflag), 'effect_label', bucket, l_quantity FROM l UNION ALL SELECT pid, p_name, nutrient, 'nutrient', bucket, l_quantity FROM l UNION ALL SELECT pid, p_name, {_KIND}, 'source_type', 'ingredient', NULL FROM ({_SOUND}))
SELECT pid AS canonical_beverage_id, p_name AS canonical_beverage_name, tag, tag_type, bucket AS source_bucket, coalesce({_DOUBLE.format('max(score)')}, '') AS score, '{AT}' AS created_at, '{AT}' AS updated_at FROM t GROUP BY pid, p_name, tag, tag_type, bucket""")  # fmt: skip
def final_tag_rows(spark, sf_dir):
    return X.tag_rows(X.checked(_merges(spark, sf_dir))[0], AT)


# Claims of the fixture: lines as claims on their supplier, parts as citations (a third is missing), customers as the lookup.
_SLUG = "'effect_' || CAST(l_partkey % 7 AS {t})"
_LEVEL = "CASE l_returnflag WHEN 'A' THEN 'human_rct' WHEN 'N' THEN 'human_observational' ELSE 'other' END"


def _evidence(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    claims = lines.select(
        seq.alias("seq"), F.lit("nutrient").alias("bioactive_type"), F.col("l_suppkey").cast("string").alias("bioactive_id"), F.lit("Name").alias("bioactive_name"), F.col("l_partkey").cast("string").alias("citation_id"), F.col("l_orderkey").cast("string").alias("proposed_claim_id"), F.lit("The statement").alias("statement"),
        F.expr(_LEVEL).alias("support_level"), F.expr(_SLUG.format(t="STRING")).alias("effect_slug"), F.lit("New label").alias("effect_label"), F.lit("d").alias("effect_description"), F.when(F.col("l_linestatus") == "O", "a b c d e f g h").otherwise("short one").alias("description"), F.array(F.lit("t")).alias("tags"), F.lit(None).cast("string").alias("review_notes"),
        F.lit("unclear").alias("exposure_category"), F.array(F.lit("1 mg")).alias("dose_or_exposure"), F.lit(None).cast("string").alias("concentration_notes"),
    )
    citations = read(spark, sf_dir, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("int").alias("year"))
    lookup = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lookup_seq"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("nutrient").alias("bioactive_type"), F.col("s_suppkey").cast("string").alias("bioactive_id"), F.concat(F.lit("effect_"), (F.col("s_suppkey") % 3).cast("string")).alias("effect_slug"), F.concat(F.lit(" Known "), F.col("s_suppkey").cast("string")).alias("effect_label"))
    return X.health_evidence(claims, citations, lookup, AT)


_CLAIMS = f"""SELECT CAST(l_suppkey AS VARCHAR) AS bid, {_SLUG.format(t='VARCHAR')} AS slug, CAST(l_partkey AS VARCHAR) AS cit, CAST(l_orderkey AS VARCHAR) AS claim, {_LEVEL} AS level, l_linestatus, p_partkey IS NOT NULL AS cited,
s_suppkey IS NOT NULL AS known, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 3 <> 0) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 = l_partkey % 7"""
_LABELS = "(SELECT 'effect_' || CAST(s_suppkey % 3 AS VARCHAR) AS slug, 'Known ' || min(s_suppkey) AS label FROM supplier GROUP BY s_suppkey % 3)"


@query(TABLE, f"""SELECT bid AS bioactive_id, c.slug AS effect_slug, coalesce(b.label, 'New label') AS effect_label, CASE WHEN l_linestatus = 'O' THEN 'a b c d e f g h' ELSE 'The statement' END AS description, s AS score,
CASE WHEN s >= 0.75 THEN 'strong' WHEN s >= 0.5 THEN 'moderate' ELSE 'limited' END AS evidence_level, b.label IS NULL AS is_new FROM (SELECT *, CASE level WHEN 'human_rct' THEN 0.75 WHEN 'human_observational' THEN 0.6 ELSE 0.4 END::DOUBLE AS s FROM ({_CLAIMS}) WHERE k = 1 AND NOT known AND cited) c LEFT JOIN {_LABELS} b ON b.slug = c.slug""")  # fmt: skip
def health_evidence_rows(spark, sf_dir):
    out = _evidence(spark, sf_dir)
    new = out["new_effects"].select("effect_slug").distinct().withColumn("is_new", F.lit(True))
    rows = out["evidence"].join(new, "effect_slug", "left")
    return rows.select("bioactive_id", "effect_slug", "effect_label", "description", "score", "evidence_level", F.coalesce("is_new", F.lit(False)).alias("is_new"))


@query(TABLE, f"SELECT type, bid AS bioactive_id, slug AS effect_slug, cit AS citation_id, claim AS proposed_claim_id FROM (SELECT *, CASE WHEN known OR k > 1 THEN 'existing_entity_effect_skipped' WHEN NOT cited THEN 'invalid_csv_format' END AS type FROM ({_CLAIMS})) WHERE type IS NOT NULL")
def health_evidence_rejected(spark, sf_dir):
    return _evidence(spark, sf_dir)["rejected"].select("type", "bioactive_id", "effect_slug", "citation_id", "proposed_claim_id")


@query(TABLE, "SELECT e.event_id, CASE WHEN c_custkey IS NULL THEN 'unmatched' WHEN lower(c_mktsegment) = e.segment THEN 'matched' ELSE 'mismatched' END AS state, CASE WHEN lower(c_mktsegment) = e.segment THEN c_name END AS c_name FROM (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'building' ELSE 'furniture' END AS segment FROM events) e LEFT JOIN customer ON c_custkey = e.user_id")
def guarded_name_join(spark, sf_dir):
    probe = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"), F.when(F.col("event_id") % 2 == 0, " Building").otherwise("FURNITURE").alias("segment"))
    build = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    rows, _ = C.guarded_join(probe, build, ["c_custkey"], "segment", "c_mktsegment")
    known = rows.join(build.select("c_custkey", F.lit(True).alias("known")), "c_custkey", "left")
    return known.select("event_id", F.when(F.col("c_name").isNotNull(), "matched").when(F.col("known"), "mismatched").otherwise("unmatched").alias("state"), "c_name")


@query(TABLE, "SELECT p_partkey, x.l_suppkey AS supplier, x.q AS quantity, x.q IS NOT NULL AS has_summary FROM part LEFT JOIN (SELECT l_partkey, l_suppkey, arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS q FROM lineitem GROUP BY 1, 2) x ON x.l_partkey = p_partkey AND x.l_suppkey = p_size")
def composite_key_summaries(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("source_key"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("seq"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("source_key"))
    return C.with_summaries(part, lines, ["p_partkey", "source_key"], "seq").select("p_partkey", "supplier", "quantity", "has_summary")


@query(TABLE, """SELECT p_partkey, coalesce(d1, d2) AS direct, c AS composition, CASE WHEN coalesce(d1, d2) IS NOT NULL THEN 'direct_literature' WHEN c IS NOT NULL THEN 'composition_based' END AS source_type,
CASE WHEN coalesce(d1, d2) IS NULL AND c IS NULL THEN CASE WHEN target IS NULL THEN 'no_direct_literature_and_no_mapping' ELSE 'no_direct_literature_and_no_composition' END END AS skipped_reason FROM part
LEFT JOIN (SELECT l_partkey, min(l_shipdate)::VARCHAR AS d1 FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, min(l_linestatus) AS d2 FROM lineitem WHERE l_quantity < 2 GROUP BY 1) b ON b.l_partkey = p_partkey
LEFT JOIN (SELECT p_partkey AS k, p_partkey - 1 AS target FROM part WHERE p_size > 40) m ON m.k = p_partkey LEFT JOIN (SELECT s_suppkey AS k, s_name AS c FROM supplier) s ON s.k = coalesce(target, p_partkey)""")  # fmt: skip
def five_source_assembly(spark, sf_dir):
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    one = lines.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("payload"))
    two = lines.where("l_quantity < 2").select(F.col("l_partkey").alias("p_partkey"), F.col("l_linestatus").alias("payload"))
    mapped = part.where("p_size > 40").select("p_partkey", (F.col("p_partkey") - 1).alias("target"))
    composition = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("payload"))
    return C.assembled_sources(part, "p_partkey", [one, two], mapped, composition)


@query(TABLE, """SELECT p_partkey, CASE WHEN p_name LIKE '%red%' THEN 'accepted' ELSE 'rejected' END AS decision, CASE WHEN p_name LIKE '%red%' THEN 'high' WHEN p_name LIKE 'big %' THEN 'duplicate of large' WHEN regexp_matches(p_name, 'bolt$') THEN 'too_specific' WHEN regexp_matches(p_name, '^cold') THEN 'analytical' ELSE 'too_sparse' END AS reason FROM part""")
def curation_gate(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = part.select(F.col("p_name").alias("name")).distinct()
    red, big = names.where("name LIKE '%red%'").select("name", F.lit("high").alias("list"), F.lit(None).cast("string").alias("text")), names.where("name LIKE 'big %'").select("name", F.lit("duplicate").alias("list"), F.lit("duplicate of large").alias("text"))
    return C.curation(part, red.unionByName(big), "p_name", "bolt$", "^cold").select("p_partkey", "decision", "reason")


@query(TABLE, """SELECT doc_id, regexp_matches(lower(text), '\\bin[\\s-]?vitro\\b|\\bmice\\b|\\brats?\\b') OR regexp_matches(lower(text), '\\b\\d+(\\.\\d+)?\\s*(ug|µg|mcg|mg)\\s*/\\s*(ml|l)\\b') OR regexp_matches(lower(text), '\\bcell line(s)?\\b|\\bcultured cells?\\b|\\badipocytes?\\b|\\bastrocytes?\\b|\\bneurons?\\b') AS preclinical,
CASE WHEN source = 'src0' THEN 'form_specific' ELSE lang END AS applies FROM documents""")  # fmt: skip
def preclinical_filter(spark, sf_dir):
    claim = F.struct(F.when(F.col("source") == "src0", "extract_or_supplement").alias("exposure_category"), F.col("lang").alias("claim_applies_to_group_members"))
    return read(spark, sf_dir, "documents").select("doc_id", C.is_preclinical(F.col("text")).alias("preclinical"), C.applies_to(claim).alias("applies"))


_CAUTION = "regexp_matches(lower(slug || ' ' || label), 'risk|ldl|harm')"


@query(TABLE, f"""SELECT l_orderkey, CAST(count(*) FILTER (WHERE {_CAUTION} AND (nutrient IS NULL OR nutrient = 'salt')) AS INT) AS n_cautionary, CAST(count(*) FILTER (WHERE NOT ({_CAUTION} AND (nutrient IS NULL OR nutrient = 'salt'))) AS INT) AS n_regular
FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'ldl' WHEN 'N' THEN 'sleep' ELSE 'mood' END AS slug, CASE WHEN l_linestatus = 'F' THEN 'Higher Risk' ELSE 'Calm' END AS label, CASE l_suppkey % 3 WHEN 0 THEN 'salt' WHEN 1 THEN 'zinc' END AS nutrient FROM lineitem) GROUP BY 1""")  # fmt: skip
def caution_split(spark, sf_dir):
    slug, label = F.when(F.col("l_returnflag") == "A", "ldl").when(F.col("l_returnflag") == "N", "sleep").otherwise("mood"), F.when(F.col("l_linestatus") == "F", "Higher Risk").otherwise("Calm")
    nutrient = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("Salt"))).when(F.col("l_suppkey") % 3 == 1, F.array(F.lit("zinc"))).otherwise(F.array().cast("array<string>"))
    effect = F.struct(slug.alias("effect_slug"), label.alias("effect_label"), F.lit(None).cast("string").alias("summary"), nutrient.alias("supporting_nutrients"))
    out = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(effect).alias("e")).select("l_orderkey", C.split_cautions(F.col("e"), ["salt"]).alias("s"))
    return out.select("l_orderkey", F.size("s.cautionary").alias("n_cautionary"), F.size("s.regular").alias("n_regular"))


@query(TABLE, """WITH x AS (SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(DISTINCT l_suppkey % 3) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'F' AND NOT coalesce(list_contains(r, l_suppkey % 3), false)) AS moved, count(*) FILTER (WHERE l_returnflag <> 'A') AS c
FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, list(DISTINCT l_suppkey % 3) AS r FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) ON k = o_orderkey GROUP BY 1)
SELECT o_orderkey, CAST(c - moved AS INT) AS n_cautions, CAST(a + moved AS INT) AS n_regular FROM x""")  # fmt: skip
def reroute_cautions(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    good = F.when(F.col("l_linestatus") == "F", "Soluble fiber for satiety").otherwise("Bloating after soluble fiber, satiety")
    effect = F.struct(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("effect_slug"), good.alias("effect_label"), F.lit("").alias("summary"), F.lit("").alias("evidence_level"), F.array(F.lit("Fiber")).alias("supporting_nutrients"))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("l_linenumber", "l_partkey", "l_quantity", effect.alias("e"))))), lambda s: s["e"])
    both = lines.groupBy("o_orderkey").agg(listed(F.col("l_returnflag") != "A").alias("c"), listed(F.col("l_returnflag") == "A").alias("r"))
    return both.select("o_orderkey", C.rerouted(F.col("c"), F.col("r")).alias("x")).select("o_orderkey", F.size("x.cautions").alias("n_cautions"), F.size("x.regular").alias("n_regular"))


@query(TABLE, """SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'furniture' THEN 'household' ELSE lower(c_mktsegment) END AS segment, c_acctbal AS balance, '' AS violations FROM customer WHERE c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('FURNITURE', 'BUILDING', 'HOUSEHOLD')
UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal, concat_ws(',', CASE WHEN c_mktsegment NOT IN ('FURNITURE', 'BUILDING', 'HOUSEHOLD') THEN 'segment:not_a_choice' END, CASE WHEN c_acctbal NOT BETWEEN 0 AND 9000 THEN 'balance:out_of_bounds' END) FROM customer
WHERE NOT (c_acctbal BETWEEN 0 AND 9000 AND c_mktsegment IN ('FURNITURE', 'BUILDING', 'HOUSEHOLD'))""")  # fmt: skip
def claim_validation(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    good, bad = C.validated(rows, {"segment": {"kind": "enum", "choices": ["household", "building"], "aliases": {"furniture": "household"}}, "balance": {"kind": "number", "low": 0, "high": 9000}})
    return good.withColumn("violations", F.lit("")).unionByName(bad.withColumn("violations", F.array_join("violations", ",")))


@query(TABLE, "SELECT o_orderkey AS line_number, o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 'price_too_high' ELSE 'status_open' END AS error_message FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'O'")
def row_failures(spark, sf_dir):
    problem = F.when(F.col("o_totalprice") > 300000, "price_too_high").when(F.col("o_orderstatus") == "O", "status_open")
    return C.isolated(read(spark, sf_dir, "orders"), problem, "o_orderkey", ["o_orderstatus"])[1]


@query(TABLE, """SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'strong_evidence' WHEN 'N' THEN 'medium_evidence' ELSE 'low_evidence' END AS bucket, 'direct_literature_' || CASE WHEN l_suppkey % 2 = 0 THEN 'row_' || l_suppkey ELSE 'p' || l_partkey END AS effect_slug,
CASE WHEN l_linestatus = 'F' THEN 'Line ' || l_linenumber ELSE 'Accepted direct-literature claim without validated statement.' END AS summary FROM lineitem WHERE l_quantity >= 10""")  # fmt: skip
def direct_claim_projection(spark, sf_dir):
    level = F.when(F.col("l_returnflag") == "A", "human_rct").when(F.col("l_returnflag") == "N", "human_observational").otherwise("other")
    claim = F.struct(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Row "), F.col("l_suppkey").cast("string"))).alias("effect_row_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("citation_id"), F.lit(" ").alias("proposed_claim_id"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"))).alias("validated_statement"), F.lit("").alias("claim_scope"), F.lit("supported").alias("verdict"), level.alias("support_level"), F.when(F.col("l_quantity") < 10, False).alias("accepted"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(claim).alias("claims"))
    made = C.direct_buckets(F.col("claims"), {"human_rct": "strong_evidence", "human_observational": "medium_evidence"}, "low_evidence")
    each = rows.select("l_orderkey", F.explode(F.array(*(F.struct(F.lit(b).alias("bucket"), c.alias("effects")) for b, c in made.items()))).alias("b"))
    return each.select("l_orderkey", "b.bucket", F.explode("b.effects").alias("e")).select("l_orderkey", "bucket", "e.effect_slug", "e.summary")


@query(TABLE, "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS first_lines FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) WHERE k <= 3 GROUP BY 1")
def compact_profiles(spark, sf_dir):
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_linestatus"))).alias("lines")
    rows = C.compacted(read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed), ["l_orderkey", "lines"], {"lines": 3}, {"lines": ["l_linestatus"]})
    return rows.select("l_orderkey", F.array_join(F.transform("lines", lambda s: s["l_linenumber"].cast("string")), ",").alias("first_lines"))


@query(TABLE, """SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' THEN 'natural_food_level' WHEN p_size % 4 < 2 THEN 'natural_food_level' WHEN p_size % 4 = 2 THEN 'supplement_level' ELSE 'unclear' END AS exposure_category, CASE WHEN p_size % 5 = 0 THEN 'by mouth' ELSE p_brand END AS dose_or_exposure, 'oral' AS intake_route FROM part""")
def claim_adaptation(spark, sf_dir):
    given = F.when(F.col("p_size") % 4 == 0, "whole_food").when(F.col("p_size") % 4 == 1, "juice_or_beverage").when(F.col("p_size") % 4 == 2, "extract_or_supplement").otherwise("other")
    claims = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("ingredient_name"), *(F.lit("x").alias(c) for c in ("citation_id", "statement", "proposed_effect_slug", "proposed_effect_label", "effect", "claim_direction", "population")), F.lit("by mouth").alias("oral_exposure"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("dose_or_serving"), F.when(F.col("p_name").contains("bolt"), "Fruit juice").alias("food_matrix"), F.lit(None).cast("string").alias("ingredient_form"), F.lit(None).cast("string").alias("concentration_notes"), given.alias("exposure_category"))
    return C.to_general_claim(claims).select(F.col("id").alias("p_partkey"), "exposure_category", "dose_or_exposure", "intake_route")


@query(TABLE, "SELECT row_number() OVER (ORDER BY lower(p_type), CAST(p_partkey % 10 AS VARCHAR), CAST(p_partkey AS VARCHAR))::INT AS place, p_type AS effect, CAST(p_partkey AS VARCHAR) AS claim_id, '- ' || p_name || ' [' || CAST(p_partkey % 10 AS VARCHAR) || ']' || CASE WHEN p_size > 40 THEN ' Limitations: ' || p_brand ELSE '' END AS line FROM part WHERE p_size > 10")
def report_lines(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    claims = part.select((F.col("p_size") > 10).alias("accepted"), F.col("p_type").alias("effect"), (F.col("p_partkey") % 10).cast("string").alias("citation_id"), F.col("p_partkey").cast("string").alias("claim_id"), F.col("p_name").alias("statement"), F.when(F.col("p_size") > 40, F.array(F.col("p_brand"))).otherwise(F.array().cast("array<string>")).alias("limitations"))
    return X.report_rows(claims).select("place", "effect", "claim_id", "line")


_G = "CASE WHEN x = floor(x) THEN printf('%.0f', x) ELSE printf('%g', x) END"


@query(TABLE, f"SELECT event_id, {_G} AS amount FROM (SELECT event_id, round(value * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.00001 WHEN 2 THEN 1000 ELSE 0.01 END, 6) AS x FROM events)")
def amount_texts(spark, sf_dir):
    factor = F.when(F.col("event_id") % 4 == 0, 1.0).when(F.col("event_id") % 4 == 1, 0.00001).when(F.col("event_id") % 4 == 2, 1000.0).otherwise(0.01)
    return read(spark, sf_dir, "events").select("event_id", T.format_amount(F.col("value") * factor).alias("amount"))


@query(TABLE, r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(regexp_extract(text, '^[^\n]*'), 'ß', 'ss'), 'æ', ' '))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def folded_names(spark, sf_dir):
    line = F.regexp_extract("text", r"^[^\n]*", 0)
    return read(spark, sf_dir, "documents").select("doc_id", T.name_key_folded(line).alias("key"))


@query(TABLE, """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '(' || p_name || ') AND "' || p_type || '" NOT (' || p_brand || ')' WHEN 1 THEN '(' || p_name || ')   "' || p_type || '"' ELSE p_name || ' ' || p_type END AS q FROM part""")
def source_queries(spark, sf_dir):
    q = F.concat(F.lit("("), F.col("p_name"), F.lit(') AND "'), F.col("p_type"), F.lit('"  NOT ('), F.col("p_brand"), F.lit(")"))
    source = F.when(F.col("p_size") % 3 == 0, "pubmed").when(F.col("p_size") % 3 == 1, "firecrawl").otherwise("crossref")
    return read(spark, sf_dir, "part").select("p_partkey", T.query_for(source, q).alias("q"))


@query(TABLE, """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PMC' || (o_custkey + 10000) WHEN 1 THEN 'PMC' || (o_custkey + 10000) END AS pmc, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.mdpi.com/2072-6643/' || (10 + o_custkey % 90) || '/5/' || o_custkey END AS page FROM orders""")
def paper_addresses(spark, sf_dir):
    n = (F.col("o_custkey") + 10000).cast("string")
    url = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x.org/articles/pmc"), n)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://x.org/pmc/articles/"), n, F.lit("/"))).otherwise(F.concat(F.lit("https://x.org/articles/"), n))
    doi = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "https://doi.org/10.3390/NU").otherwise("10.3390/ijms"), (10 + F.col("o_custkey") % 90).cast("string"), F.lit("05"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    return read(spark, sf_dir, "orders").select("o_orderkey", resolvers.pmc_id(url).alias("pmc"), resolvers.mdpi_page(doi).alias("page"))


# Stored answers of the fixture: for each order one Unpaywall and one Crossref document, made from its lines.
@query(TABLE, """WITH loc AS (SELECT l_orderkey, l_suppkey % 4 AS v, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i FROM lineitem),
u AS (SELECT l_orderkey, 2 AS tier, CASE v WHEN 3 THEN 3 ELSE v END AS o0, 0 AS o1, i AS o2, 'https://a.org/' || l_partkey || '.pdf' AS url, 'unpaywall_pdf' AS method FROM loc WHERE l_partkey % 2 = 0
UNION ALL SELECT l_orderkey, 2, v, 1, i, 'https://a.org/' || l_partkey, 'unpaywall_landing_page' FROM loc UNION ALL SELECT l_orderkey, 4, i, 0, 0, 'https://a.org/' || l_partkey || '.pdf', 'crossref_pdf' FROM loc),
f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY tier, o0, o1, o2) AS k FROM u)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, o0, o1, o2, method, url) AS INT) AS rank, url, method FROM f WHERE k = 1""")  # fmt: skip
def open_access_candidates(spark, sf_dir):
    page = F.concat(F.lit("https://a.org/"), F.col("l_partkey").cast("string"))
    version = F.element_at(F.array(*(F.lit(v) for v in [*resolvers.VERSIONS, "other"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    place = F.struct(page.alias("url"), F.when(F.col("l_partkey") % 2 == 0, F.concat(page, F.lit(".pdf"))).alias("url_for_pdf"), version.alias("version"))
    link = F.struct(F.concat(page, F.lit(".pdf")).alias("URL"), F.lit("application/pdf").alias("content-type"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", place.alias("p"), link.alias("l")))).alias("a"))
    unpaywall = F.to_json(F.struct(F.lit(True).alias("is_oa"), F.transform("a", lambda s: s["p"]).alias("oa_locations")))
    crossref = F.to_json(F.struct(F.transform("a", lambda s: s["l"]).alias("link")))
    answers = rows.select(F.col("l_orderkey").alias("source_id"), F.explode(F.array(F.struct(F.lit("unpaywall").alias("service"), unpaywall.alias("payload")), F.struct(F.lit("crossref").alias("service"), crossref.alias("payload")))).alias("x")).select("source_id", "x.*")
    sources = rows.select(F.col("l_orderkey").alias("source_id"), F.lit("10.1/x").alias("doi"), F.lit(None).cast("string").alias("pmcid"))
    return resolvers.resolved(sources, answers).select(F.col("source_id").alias("l_orderkey"), "rank", "url", "method")


_STAGE = "CASE l_suppkey % 3 WHEN 0 THEN 'publisher_page' WHEN 1 THEN 'resolved' ELSE 'europe_pmc' END"
_GOT = "CASE WHEN l_quantity > 45 THEN 'found' WHEN l_returnflag = 'A' THEN 'paywalled' WHEN l_returnflag = 'N' THEN 'retrieval_error' ELSE 'empty' END"


@query(TABLE, f"""WITH t AS (SELECT l_orderkey, (l_suppkey % 3, l_linenumber) AS place, {_GOT} AS status FROM lineitem), x AS (SELECT l_orderkey, min(place) FILTER (WHERE status = 'found') AS hit, min(status = 'retrieval_error') FILTER (WHERE status IN ('paywalled', 'retrieval_error')) AS worst FROM t GROUP BY 1),
n AS (SELECT t.l_orderkey, count(*) AS n FROM t JOIN x ON x.l_orderkey = t.l_orderkey WHERE hit IS NULL OR place <= hit GROUP BY 1)
SELECT o_orderkey, CASE WHEN hit IS NOT NULL THEN 'full_text_found' WHEN worst = false THEN 'paywalled' WHEN worst THEN 'retrieval_error' WHEN o_orderstatus = 'F' THEN 'abstract_only' WHEN o_orderstatus = 'O' THEN 'page_summary_only' WHEN n IS NULL THEN 'no_oa_location' ELSE 'not_available' END AS status,
coalesce(n, 0) AS n_attempts FROM orders LEFT JOIN x ON x.l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey""")  # fmt: skip
def retrieval_cascade(spark, sf_dir):
    tried = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.expr(_STAGE).alias("stage"), F.col("l_linenumber").alias("rank"), F.expr(_GOT).alias("status"), F.lit("u").alias("url"), F.lit("body").alias("text"))
    sources = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "abstract").alias("abstract"), F.when(F.col("o_orderstatus") == "O", "summary").alias("page_summary"))
    return resolvers.cascade(sources, tried).select(F.col("source_id").alias("o_orderkey"), "status", "n_attempts")


@query(TABLE, """SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', '"#') || ' ' || p_type AS text, p_type AS reached FROM part""")
def nested_strings(spark, sf_dir):
    inner = F.struct(F.array(F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit('"#'))), F.lit(" ")).alias("list"), F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size")).alias("deep"))
    payload = F.to_json(F.struct(F.col("p_name").alias("name"), F.array(F.struct(F.lit("hidden").alias("x"))).alias("link"), inner.alias("inner")))
    rows = read(spark, sf_dir, "part").select("p_partkey", payload.alias("payload"))
    reached = rows.select("p_partkey", resolvers.reached(F.col("payload"), "$.inner.deep.type").alias("reached"))
    return nested.json_text(rows, "p_partkey", "payload").join(reached, "p_partkey")


# Documents as answers of an article service: texts of up to 100,000 characters and more, 16 levels deep, with keys to skip on two levels.
_LEVELS = 16
_LONG = "CASE WHEN source = 'src0' THEN repeat(coalesce(text, '') || ' ', CAST(ceil(100000.0 / (length(coalesce(text, '')) + 1)) AS INT)) ELSE text END"


@query(TABLE, rf"""WITH p AS (SELECT doc_id, json_object('head', json_object('coredata', json_object('title', 'hidden', 'link', ['hidden too']), 'lang', lang), 'link', 'gone', 'n_chars', n_chars, 'body', json_array(json_object('quote', 'say "no" \ ' || source || chr(10), 'text', {_LONG}), '  ', CAST('{'[' * _LEVELS}' || CAST(json_object('coredata', 'x', 'source', source) AS VARCHAR) || '{']' * _LEVELS}' AS JSON))) AS j FROM documents),
t AS (SELECT doc_id, id, path, key, trim(regexp_replace(CAST(json_extract_string(atom, '$') AS VARCHAR), '[\s\x1c-\x1f\x85\pZ]+', ' ', 'g')) AS x FROM (SELECT p.doc_id, t.* FROM p, LATERAL json_tree(p.j) t) WHERE type = 'VARCHAR' AND NOT regexp_matches(fullkey, '\.(coredata|link)(\.|\[|$)'))
SELECT doc_id, string_agg(x, ' ' ORDER BY id) AS text FROM t WHERE x <> '' GROUP BY doc_id""")  # fmt: skip
def nested_payloads(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    head = F.struct(F.struct(F.lit("hidden").alias("title"), F.array(F.lit("hidden too")).alias("link")).alias("coredata"), "lang")
    deep = F.struct(F.lit("x").alias("coredata"), "source")
    item = F.to_json(F.struct(F.concat(F.lit('say "no" \\ '), F.col("source"), F.lit("\n")).alias("quote"), F.expr(_LONG).alias("text")))
    body = F.concat(F.lit("["), item, F.lit(', "  ", ' + "[" * _LEVELS), F.to_json(deep), F.lit("]" * _LEVELS + "]"))
    payload = F.concat(F.lit('{"head": '), F.to_json(head), F.lit(', "link": "gone", "n_chars": '), F.col("n_chars").cast("string"), F.lit(', "body": '), body, F.lit("}"))
    return nested.json_text(docs.select("doc_id", payload.alias("payload")), "doc_id", "payload")


@query(TABLE, """WITH c AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN '10.1/' || c_nationkey WHEN 1 THEN 'pmid:' || c_nationkey ELSE lower(c_mktsegment) END AS key, CASE WHEN c_custkey % 4 = 0 THEN 'about ' || c_name END AS abstract FROM customer),
f AS (SELECT key, min(c_custkey) AS seq, count(*) AS n_rows, arg_min(c_name, c_custkey) AS name, arg_min(abstract, c_custkey) FILTER (WHERE abstract IS NOT NULL) AS abstract FROM c GROUP BY key)
SELECT f.key, f.seq, f.n_rows, f.name, f.abstract, 'first' || coalesce(string_agg(' Merged additional metadata from s' || c_nationkey || '.', '' ORDER BY c_custkey), '') AS selection_reason FROM f LEFT JOIN c ON c.key = f.key AND c.c_custkey > f.seq AND c.abstract IS NOT NULL GROUP BY ALL""")  # fmt: skip
def citation_merge(spark, sf_dir):
    n = F.col("c_nationkey").cast("string")
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), n)).alias("doi"), F.when(F.col("c_custkey") % 3 == 1, n).alias("pmid"), F.when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("title"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("about "), F.col("c_name"))).alias("abstract"), F.lit("first").alias("selection_reason"), F.concat(F.lit("s"), n).alias("source"), F.col("c_name").alias("name"),
    )
    return dedupe.citations(rows).select("key", "seq", "n_rows", "name", "abstract", "selection_reason")


@query(TABLE, "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS before, CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS after, round((count(*) - count(DISTINCT c_mktsegment)) / count(*) * 100, 2) AS reduction FROM customer GROUP BY 1")
def reduction_rates(spark, sf_dir):
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("before"), F.count_distinct("c_mktsegment").alias("after"))
    return n.withColumn("reduction", C.reduction(F.col("before"), F.col("after")))


_ANSWER = """SELECT event_id, CAST(event_id AS VARCHAR) AS key, event_type IN ('click', 'view') AS good, event_type = 'error' AS broken FROM events"""


@query(TABLE, f"SELECT key, CASE WHEN good THEN 'answered' WHEN event_id % 2 = 1 THEN 'retry' WHEN broken THEN 'invalid_json' ELSE 'invalid_answer' END AS state FROM ({_ANSWER}) WHERE event_id % 5 <> 0 UNION ALL SELECT key, 'pending' FROM ({_ANSWER}) WHERE event_id % 5 = 0")
def model_answers(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    text = stages.prompt("Classify the event.", ["Use the type only."], '{"label": string}', {"Type": F.col("event_type"), "Value": F.col("value")})
    asked = stages.requests(events, F.col("event_id"), text)
    body = F.when(F.col("event_type").isin("click", "view"), '{"label": "ok"}').when(F.col("event_type") == "error", "{broken").otherwise('{"other": 1}')
    told = events.where("event_id % 5 <> 0").select(F.col("event_id").cast("string").alias("key"), F.explode(F.when(F.col("event_id") % 2 == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("attempt"), body.alias("answer"))
    done, failed = stages.answered(asked, told, "label string", ["label"])
    return done.select("key", F.lit("answered").alias("state")).unionByName(failed.select("key", F.col("problem").alias("state")))


# The same tables with all their columns.
_LISTED = "coalesce(to_json(list({{'effect_slug': slug, 'effect_label': 'Label ' || l_returnflag, 'summary': 'Line status ' || l_linestatus, 'evidence_level': l_linestatus, 'score': CAST(l_quantity AS DOUBLE), 'supporting_nutrients': [nutrient]}} ORDER BY l_orderkey, l_linenumber, slug, l_returnflag, l_linestatus, l_quantity, nutrient) FILTER (bucket = '{0}')), '[]')"


@query(TABLE, f"""WITH l AS ({_LINES}), g AS (SELECT pid, {', '.join(f"CAST({_LISTED.format(b)} AS VARCHAR) AS {b}_json" for b in X.BUCKETS)} FROM l GROUP BY pid)
SELECT p.pid AS canonical_beverage_id, p_name AS canonical_beverage_name, {_KIND} AS summary_source_type, p_type AS summary_confidence_status, p_brand AS final_positive_summary, p_type AS final_negative_summary, {', '.join(f"coalesce({b}_json, '[]') AS {b}_json" for b in X.BUCKETS)},
'["' || p_brand || '"]' AS caveats_json, 'local' AS model_provider, '' AS model_name, '{AT}' AS created_at, '{AT}' AS updated_at FROM ({_SOUND}) p LEFT JOIN g ON g.pid = p.pid""")  # fmt: skip
def final_main_whole(spark, sf_dir):
    return X.main_rows(X.checked(_merges(spark, sf_dir))[0], AT)


@query(TABLE, """WITH c AS (SELECT p_partkey AS id, p_name, p_type, p_brand, CASE WHEN p_name LIKE '%bolt%' THEN 'natural' WHEN p_size % 4 < 2 THEN 'natural' WHEN p_size % 4 = 2 THEN 'supplement' ELSE 'unclear' END AS e, p_size FROM part)
SELECT id, p_name AS nutrient_name, p_brand AS citation_id, p_type AS statement, 'slug' AS proposed_effect_slug, p_name || '!' AS proposed_effect_label, p_name AS compound, 'e' || p_size AS effect, CASE WHEN p_size > 25 THEN 'harmful' ELSE 'beneficial' END AS direction, 'adults' AS population, CASE WHEN p_size % 5 = 0 THEN 'by mouth' ELSE p_brand END AS dose_or_exposure, 'oral' AS intake_route,
CASE e WHEN 'natural' THEN 'natural_food_level' WHEN 'supplement' THEN 'supplement_level' ELSE 'unclear' END AS exposure_category, CASE e WHEN 'natural' THEN 'Ingredient-level evidence.' END AS natural_concentration_relevance, CASE e WHEN 'supplement' THEN 'Concentrated, powder, or extract-like ingredient evidence.' END AS supplement_level_relevance, CAST(NULL AS VARCHAR) AS concentration_notes FROM c""")  # fmt: skip
def claim_adaptation_whole(spark, sf_dir):
    given = F.when(F.col("p_size") % 4 == 0, "whole_food").when(F.col("p_size") % 4 == 1, "juice_or_beverage").when(F.col("p_size") % 4 == 2, "extract_or_supplement").otherwise("other")
    claims = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("ingredient_name"), F.col("p_brand").alias("citation_id"), F.col("p_type").alias("statement"), F.lit("slug").alias("proposed_effect_slug"), F.concat("p_name", F.lit("!")).alias("proposed_effect_label"), F.concat(F.lit("e"), F.col("p_size").cast("string")).alias("effect"), F.when(F.col("p_size") > 25, "harmful").otherwise("beneficial").alias("claim_direction"), F.lit("adults").alias("population"),
        F.lit("by mouth").alias("oral_exposure"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")).alias("dose_or_serving"), F.when(F.col("p_name").contains("bolt"), "Fruit juice").alias("food_matrix"), F.lit(None).cast("string").alias("ingredient_form"), F.lit(None).cast("string").alias("concentration_notes"), given.alias("exposure_category"),
    )
    return C.to_general_claim(claims)


@query(TABLE, f"""WITH x AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_quantity) AS seq, CASE l_returnflag WHEN 'A' THEN 'ldl' WHEN 'N' THEN 'sleep' ELSE 'mood' END AS slug, CASE WHEN l_linestatus = 'F' THEN 'Higher Risk' ELSE 'Calm' END AS label, CASE l_suppkey % 3 WHEN 0 THEN 'salt' WHEN 1 THEN 'zinc' END AS nutrient FROM lineitem),
y AS (SELECT *, {_CAUTION} AND (nutrient IS NULL OR nutrient = 'salt') AS caution, slug || '/' || label || '/' || coalesce(nutrient, '') AS name FROM x)
SELECT l_orderkey, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (caution), '') AS cautionary, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (NOT caution), '') AS regular FROM y GROUP BY l_orderkey""")  # fmt: skip
def caution_split_effects(spark, sf_dir):
    slug, label = F.when(F.col("l_returnflag") == "A", "ldl").when(F.col("l_returnflag") == "N", "sleep").otherwise("mood"), F.when(F.col("l_linestatus") == "F", "Higher Risk").otherwise("Calm")
    nutrient = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("salt"))).when(F.col("l_suppkey") % 3 == 1, F.array(F.lit("zinc"))).otherwise(F.array().cast("array<string>"))
    effect = F.struct(slug.alias("effect_slug"), label.alias("effect_label"), F.lit(None).cast("string").alias("summary"), nutrient.alias("supporting_nutrients"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", effect.alias("e")))), lambda x: x["e"])
    out = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed.alias("e")).select("l_orderkey", C.split_cautions(F.col("e"), ["salt"]).alias("s"))
    told = lambda c: F.array_join(F.transform(f"s.{c}", lambda e: F.concat_ws("/", e["effect_slug"], e["effect_label"], F.array_join(e["supporting_nutrients"], ""))), ",").alias(c)
    return out.select("l_orderkey", told("cautionary"), told("regular"))
