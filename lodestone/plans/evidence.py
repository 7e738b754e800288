"""Queries that screen, retrieve, validate and assemble evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A, evidence as E
from .base import query, read

TABLE: dict = {}


def _listed(flag: str):
    """Suppliers of an order's lines with a return flag, as text, in the order of line and part."""
    rows = F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "l_partkey", "l_suppkey"))))
    return F.transform(rows, lambda s: s["l_suppkey"].cast("string"))


@query(TABLE, """SELECT d.doc_id, CASE WHEN trim(source) <> '' THEN 'abstract' WHEN trim(text) <> '' THEN 'page_summary' ELSE 'missing_context' END AS context,
coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND n_chars >= 200 AND coalesce(lang, '') <> 'fr' AS accepted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")  # fmt: skip
def screening_split(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    said = {
        "entity_match": F.when(F.col("lang") == "fr", "different_species"), "publication_type": F.when(F.col("n_chars") < 200, "news_editorial").otherwise("trial"),
        "accepted": F.col("quality") == 1, "human_health_relevance": F.col("toxic") == 0,
    }
    return rows.select("doc_id", E.context(F.col("source"), F.col("text"))["label"].alias("context"), E.accepts(said).alias("accepted"))


@query(TABLE, """SELECT doc_id, yes AND same AND good AND said AS accepted, CASE WHEN yes AND NOT same THEN 'unsupported' WHEN yes AND NOT (good AND said) THEN 'quote_not_found' ELSE answer END AS verdict,
CAST(CASE WHEN yes THEN CAST(NOT said AS INT) + CAST(NOT same AS INT) + CAST(NOT good AS INT) ELSE 0 END AS INT) AS n_limitations
FROM (SELECT d.doc_id, a.answer, coalesce(a.answer LIKE 'supported%', false) AS yes, coalesce(lang <> 'fr', false) AS same, coalesce(contains(lower(text), 'the'), false) AS good, coalesce(trim(source) <> '', false) AS said
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 0 THEN 'supported_with_limitations' ELSE 'unsupported' END AS answer FROM labels) a ON d.doc_id = a.doc_id)""")  # fmt: skip
def claim_verdicts(spark, sf_dir):
    answer = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 0, "supported_with_limitations").when(F.col("toxic").isNotNull(), "unsupported")
    quotes = F.lower("text").contains("the").cast("int")
    entity = F.when(F.col("lang") != "fr", "exact_or_alias")
    out = E.verdict(answer, entity, quotes, quotes, F.col("source"), F.lit("adults"), F.lit(None).cast("array<string>"))
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", out.alias("v"))
    return rows.select("doc_id", "v.accepted", "v.verdict", F.size("v.limitations").alias("n_limitations"))


_STATUS = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'found' WHEN l_returnflag = 'A' THEN 'retrieval_error' WHEN l_returnflag = 'N' THEN 'paywalled' WHEN l_linestatus = 'F' THEN 'blocked' ELSE 'not_available' END"


@query(TABLE, f"""SELECT l_orderkey, status, l_linenumber, n_attempts FROM (SELECT l_orderkey, status, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n_attempts,
row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE status WHEN 'found' THEN 0 WHEN 'paywalled' THEN 2 WHEN 'blocked' THEN 4 WHEN 'retrieval_error' THEN 5 ELSE 6 END, l_linenumber) AS k
FROM (SELECT l_orderkey, l_linenumber, {_STATUS} AS status FROM lineitem)) WHERE k = 1""")  # fmt: skip
def retrieval_outcomes(spark, sf_dir):
    return E.outcomes(read(spark, sf_dir, "lineitem").withColumn("status", F.expr(_STATUS)), "l_orderkey", ["l_linenumber"])


_PLACES = [
    "l_orderkey", "'https://host' || CAST(l_suppkey % 7 AS STRING) || '.org/' || CAST(l_partkey % 3 AS STRING) AS url", "l_linenumber % 4 AS tier", "l_linestatus = 'F' AS is_pdf", "l_partkey AS idx",
    "CASE l_returnflag WHEN 'A' THEN 'publishedVersion' WHEN 'N' THEN 'submittedVersion' ELSE 'other' END AS version",
]


@query(TABLE, f"""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, v, p, idx, url) AS INT) AS rank, url, tier FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, url ORDER BY tier, v, p, idx) AS k
FROM (SELECT *, CASE version WHEN 'publishedVersion' THEN 0 WHEN 'submittedVersion' THEN 2 ELSE 3 END AS v, NOT is_pdf AS p FROM (SELECT {', '.join(_PLACES)} FROM lineitem))) WHERE k = 1""")  # fmt: skip
def access_locations(spark, sf_dir):
    return E.locations(read(spark, sf_dir, "lineitem").selectExpr(*_PLACES), "l_orderkey")


@query(TABLE, "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fetch' WHEN quality = 1 AND regexp_matches(lower(text), 'license|token') THEN 'reclassify' WHEN quality = 1 THEN 'keep' ELSE 'retry' END AS action FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def retrieval_resume(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    stored = read(spark, sf_dir, "labels").join(docs.select("doc_id", "text"), "doc_id").withColumn("status", F.when(F.col("quality") == 1, "found").otherwise("paywalled"))
    return E.resumed(docs.select("doc_id"), stored, "doc_id", "status", "text", "license|token", retry_failed=True)


@query(TABLE, "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'missing_claim' WHEN o_orderstatus = 'P' OR c_nationkey <> o_orderkey % 25 THEN 'grounding_or_source_mismatch' END AS reason FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def referee_preconditions(spark, sf_dir):
    results = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("claim"), (F.col("o_orderkey") % 25).cast("int").alias("source"), (F.col("o_orderstatus") != "P").cast("int").alias("n_grounded"))
    proposed = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("claim"), F.col("c_nationkey").alias("source"))
    return E.preconditions(results, proposed, "claim", "source").select("o_orderkey", "reason")


@query(TABLE, "SELECT o_orderkey, CASE WHEN a IS NULL THEN 'held_assessment_failed' WHEN a THEN 'validate' ELSE 'held_insufficient_body' END AS gate FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal > 0 END AS a FROM customer) ON o_custkey = c_custkey")
def body_gates(spark, sf_dir):
    bodies = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") > 0).alias("adequate"))
    return E.gated(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), bodies, "o_custkey").select("o_orderkey", "gate")


@query(TABLE, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'body_sanitization_failed' WHEN event_type = 'view' THEN 'paper_exceeds_validation_context' WHEN event_type = 'click' THEN 'full_text_not_found' ELSE event_type END AS code FROM events")
def failure_codes(spark, sf_dir):
    kind, message = F.when(F.col("event_type") == "error", "BodySanitizationError").otherwise(F.col("event_type")), F.when(F.col("event_type") == "view", F.concat(F.lit("paper_exceeds_validation_context:"), F.col("event_id"))).when(F.col("event_type") == "click", "full_text_not_found")
    return read(spark, sf_dir, "events").select("event_id", E.failure_code(kind, message).alias("code"))


@query(TABLE, None)
def title_spans_removed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", E.remove_spans(F.col("text"), F.substring_index("text", "\n", 1)).alias("body"))


@query(TABLE, "SELECT doc_id, contains(lower(text), 'apache license, version 2.0') OR contains(lower(text), 'gnu general public license') AS mentions FROM documents")
def rejected_mentions(spark, sf_dir):
    claims = F.array(*map(F.lit, ("Apache License, Version 2.0", "GNU General Public License", "the")))
    return read(spark, sf_dir, "documents").select("doc_id", E.mentions(F.col("text"), claims).alias("mentions"))


@query(TABLE, "SELECT doc_id, NOT regexp_matches(text, 'without|not any') AND regexp_matches(text, '[Ll]icense|token') AS cautionary FROM documents")
def caution_summaries(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", E.cautionary(F.col("text"), "without|not any", "[Ll]icense|token").alias("cautionary"))


@query(TABLE, "SELECT p_partkey, p_name || '; ' || lower(p_type) || CASE WHEN p_size > 25 THEN '; large' ELSE '' END AS statement FROM part")
def claim_statements(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", E.statement(F.col("p_name"), [F.lower("p_type"), F.lit(" "), F.when(F.col("p_size") > 25, "large")]).alias("statement"))


@query(TABLE, """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_direct, count(*) FILTER (o_orderstatus = 'O') AS n_reuse, coalesce(arg_min(o_totalprice, o_orderkey) FILTER (o_orderstatus = 'F'), arg_min(o_totalprice, o_orderkey)) AS o_totalprice,
string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey""")  # fmt: skip
def group_rollup(spark, sf_dir):
    out = A.rollup(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["o_totalprice"], "o_orderpriority", "F", "O")
    return out.withColumn("priorities", F.array_join("o_orderpriority", ",")).drop("o_orderpriority")


@query(TABLE, """SELECT c AS p_brand, coalesce(arg_max(p_name, p_partkey) FILTER (p_brand = c), arg_max(p_name, p_partkey)) AS p_name, min(p_size) AS p_size, max(p_retailprice) AS p_retailprice, count(*) AS n_rows
FROM (SELECT *, CASE p_brand WHEN 'Brand#2' THEN 'Brand#1' WHEN 'Brand#3' THEN 'Brand#X' ELSE p_brand END AS c FROM part) GROUP BY c""")  # fmt: skip
def canonical_taxonomy(spark, sf_dir):
    canonical = F.when(F.col("p_brand") == "Brand#2", "Brand#1").when(F.col("p_brand") == "Brand#3", "Brand#X").otherwise(F.col("p_brand"))
    return A.canonical_rows(read(spark, sf_dir, "part"), "p_brand", canonical, "p_partkey", ["p_name"], "p_size", "p_retailprice")


@query(TABLE, "SELECT p_name, arg_max(p_brand, p_partkey) AS p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tags, CAST(count(DISTINCT p_brand) AS INT) AS n_definitions, CASE WHEN count(DISTINCT p_brand) > 1 THEN 'conflict' ELSE 'single' END AS status FROM part GROUP BY p_name")
def definition_conflicts(spark, sf_dir):
    return A.settled(read(spark, sf_dir, "part"), "p_name", "p_partkey", ["p_brand"], "p_type").withColumn("tags", F.array_join("tags", ","))


@query(TABLE, "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k = 1")
def most_confident_type(spark, sf_dir):
    return A.most_confident(read(spark, sf_dir, "events"), "user_id", "event_type", "value", "event_id")


@query(TABLE, "SELECT count(DISTINCT l_orderkey) AS n_rows, count(DISTINCT l_orderkey) FILTER (l_returnflag IN ('A', 'R')) AS n_filled, count(*) FILTER (l_returnflag = 'A') AS n_strong, count(*) FILTER (l_returnflag = 'R') AS n_low FROM lineitem")
def bucket_totals(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_listed("A").alias("strong"), _listed("R").alias("low"))
    return A.bucket_totals(rows, ["strong", "low"])


@query(TABLE, "SELECT c_custkey, coalesce(p, 'none') AS o_orderpriority, p IS NULL AS is_fallback FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def completed_answers(spark, sf_dir):
    answers = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.completed(read(spark, sf_dir, "customer").select("c_custkey"), answers, "c_custkey", "o_orderpriority", F.lit("none"))


@query(TABLE, """SELECT c_custkey, c_name, CASE WHEN d AND c THEN 'both' WHEN d THEN 'direct' WHEN c THEN 'composition' ELSE 'skipped' END AS origin
FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS d, bool_or(o_orderstatus = 'P') AS c FROM orders GROUP BY 1) ON c_custkey = o_custkey""")  # fmt: skip
def source_assembly(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.assembled(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "c_custkey")


@query(TABLE, "SELECT event_id, 'k' AS source_key, 'Potassium' AS name, k AS amount, 'mg' AS unit, CAST(3500 AS DOUBLE) AS reference FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k <> 0")
def fallback_profiles(spark, sf_dir):
    aliases = spark.createDataFrame([("k", "Potassium", "mg"), ("na", "Sodium", "mg")], "source_key string, name string, unit string")
    references = spark.createDataFrame([("POTASSIUM", 3500.0)], "name string, reference double")
    return A.profiles(read(spark, sf_dir, "events"), "event_id", "props", aliases, references)


@query(TABLE, "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS k FROM part) WHERE k = 1 AND lower(trim(p_name)) NOT IN (SELECT lower(trim(p_name)) FROM part WHERE p_brand = 'Brand#1' AND p_size < 5)")
def identity_inserts(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    return A.identities(parts.where("p_brand = 'Brand#1' AND p_size < 5"), parts.select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(TABLE, """WITH f AS (SELECT l_orderkey, l_returnflag AS flag, CAST(l_suppkey AS VARCHAR) AS s, min((l_linenumber, l_partkey, l_suppkey)) AS p FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, coalesce(list(s ORDER BY p) FILTER (WHERE flag = 'A'), []) AS a, coalesce(list(s ORDER BY p) FILTER (WHERE flag = 'N'), [])[1:2] AS n, coalesce(list(s ORDER BY p) FILTER (WHERE flag = 'R'), [])[1:2] AS r FROM f GROUP BY 1)
SELECT l_orderkey, CAST(to_json([a[1:2], list_filter(n, lambda x: NOT list_contains(a, x)), list_filter(r, lambda x: NOT list_contains(a, x) AND NOT list_contains(n, x))]) AS VARCHAR) AS kept FROM b""")  # fmt: skip
def limited_buckets(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(_listed("A").alias("a"), _listed("N").alias("n"), _listed("R").alias("r"))
    return rows.select("l_orderkey", F.to_json(A.limited_fold(F.col("a"), [F.col("n"), F.col("r")], 2)).alias("kept"))


@query(TABLE, "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'final' WHEN c_acctbal < 0 THEN 'excluded' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'manual' ELSE 'unmapped' END AS status FROM customer")
def mapping_states(spark, sf_dir):
    ordered = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    status = A.mapping_status([("final", F.col("c_acctbal") > 9000), ("excluded", F.col("c_acctbal") < 0), ("manual", F.col("has"))])
    return read(spark, sf_dir, "customer").join(ordered, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query(TABLE, """SELECT n_nationkey, CASE WHEN n_customers IS NULL THEN 'add_customers' WHEN n_low > 0 THEN 'review_balances' ELSE 'complete' END AS action FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers, count(*) FILTER (c_acctbal < -900) AS n_low FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""")  # fmt: skip
def next_actions(spark, sf_dir):
    counts = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_customers"), F.count_if(F.col("c_acctbal") < -900).alias("n_low"))
    action = A.next_action([("add_customers", F.col("n_customers").isNull()), ("review_balances", F.col("n_low") > 0)])
    return read(spark, sf_dir, "nation").join(counts, "n_nationkey", "left").select("n_nationkey", action.alias("action"))


@query(TABLE, """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 5.0::DOUBLE WHEN p_size > 25 THEN p_retailprice * 0.1::DOUBLE WHEN p_size > 10 THEN p_size * 0.1::DOUBLE END AS amount,
CASE WHEN p_type = 'ECONOMY' THEN 'override' WHEN p_size > 25 THEN 'reference' WHEN p_size > 10 THEN 'caution_limit' ELSE 'none' END AS basis,
CASE WHEN p_type = 'ECONOMY' THEN 'reviewed' WHEN p_size > 10 THEN 'draft_meaningful_baseline' ELSE 'needs_meaningful_review' END AS status FROM part""")  # fmt: skip
def dose_table(spark, sf_dir):
    row = A.dose_thresholds(F.when(F.col("p_type") == "ECONOMY", 5.0), F.when(F.col("p_size") > 25, F.col("p_retailprice")), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")))
    return read(spark, sf_dir, "part").select("p_partkey", row.alias("t")).select("p_partkey", "t.*")


@query(TABLE, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'not_applicable' WHEN l_quantity < 3 THEN 'needs_meaningful_review'
WHEN l_linestatus = 'F' AND l_quantity >= l_discount * 400 THEN 'needs_meaningful_review_non_monotonic' ELSE 'draft_meaningful_baseline' END AS status FROM lineitem""")  # fmt: skip
def threshold_status(spark, sf_dir):
    unit = F.when(F.col("l_linestatus") == "F", "mg").otherwise("g")
    status = A.band_status(F.when(F.col("l_quantity") >= 3, F.col("l_quantity")), F.lit("mg"), F.col("l_discount") * 400, unit, F.col("l_returnflag") == "R")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))
