"""Queries that classify rows by ordered rules, maps and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules
from .base import query, read

TABLE: dict = {}

_REJECT = [
    ("empty_text", "text_required", 0.99, "length(trim(text)) = 0"),
    ("too_short", "min_length", 0.95, "length(text) < 40"),
    ("license_notice", "prose", 0.9, "contains(lower(text), 'license')"),
    ("table_layout", "prose", 0.85, "contains(text, ' | ')"),
    ("symbol_noise", "clean_text", 0.85, "contains(text, '###') OR contains(text, '$$$')"),
    ("shouting", "clean_text", 0.8, "contains(text, '!! ')"),
    ("secret", "no_secrets", 0.9, "contains(text, 'token = ')"),
    ("contact", "no_personal_data", 0.7, "contains(text, '@')"),
    ("one_line", "paragraphs", 0.6, "NOT contains(text, chr(10))"),
    ("very_long", "max_length", 0.55, "length(text) > 20000"),
    ("foreign", "language", 0.5, "lang <> 'en'"),
]


@query(TABLE, "SELECT doc_id, " + ", ".join(f"CASE {' '.join(f'WHEN {c} THEN {v(r)}' for r in _REJECT for c in [r[3]])} ELSE {d} END AS {n}" for n, v, d in (("code", lambda r: f"'{r[0]}'", "'accepted'"), ("failed_requirement", lambda r: f"'{r[1]}'", "'none'"), ("confidence", lambda r: f"CAST({r[2]} AS DOUBLE)", "CAST(1 AS DOUBLE)"))) + " FROM documents")
def rejection_code_case(spark, sf_dir):
    found = rules.first_match([(F.expr(c), (code, need, conf)) for code, need, conf, c in _REJECT], ("accepted", "none", 1.0), ["code", "failed_requirement", "confidence"])
    return read(spark, sf_dir, "documents").select("doc_id", found.alias("r")).select("doc_id", "r.*")


@query(
    TABLE,
    "SELECT p_partkey, CASE WHEN p_name IN ('old bolt', 'old ring') THEN 'skip' WHEN contains(p_name, 'widget') OR contains(p_name, 'gizmo') THEN 'device' WHEN regexp_matches(p_name, '(^|[^a-z0-9])(gear|bolt)($|[^a-z0-9])') THEN 'part' WHEN starts_with(p_name, 'small') THEN 'small' ELSE 'review' END AS decision, split_part(p_name, ' ', 2) AS search_name FROM part",
)
def name_classifier(spark, sf_dir):
    n = F.col("p_name")
    decision = F.when(n.isin("old bolt", "old ring"), "skip").when(T.contains_any(n, ["widget", "gizmo"]), "device").when(T.contains_word(n, ["gear", "bolt"]), "part").when(n.startswith("small"), "small").otherwise("review")
    return read(spark, sf_dir, "part").select("p_partkey", decision.alias("decision"), F.split_part(n, F.lit(" "), F.lit(2)).alias("search_name"))


@query(
    TABLE,
    """SELECT band, basis, allow, count(*) AS n FROM (SELECT CASE WHEN p_size IS NULL THEN 'unknown' WHEN l_quantity < 0.1 * p_size THEN 'trace' WHEN l_quantity < p_size THEN 'meaningful' WHEN l_quantity < 3 * p_size THEN 'high' ELSE 'caution' END AS band,
CASE WHEN p_size IS NULL THEN 'none' ELSE 'reference' END AS basis, coalesce(l_quantity >= 0.1 * p_size, false) AS allow FROM lineitem LEFT JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
)
def dose_band_routing(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey", "left")
    return rows.select(rules.dose_band(F.col("l_quantity"), F.col("p_size")).alias("b")).groupBy("b.band", "b.basis", "b.allow").agg(F.count("*").alias("n"))


@query(TABLE, "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.7 WHEN '3-MEDIUM' THEN 0.5 ELSE 0.3 END::DOUBLE AS score, CASE o_orderpriority WHEN '1-URGENT' THEN 'strong' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' ELSE 'weak' END AS level FROM orders")
def support_level_scores(spark, sf_dir):
    p = F.col("o_orderpriority")
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.mapped(p, {"1-URGENT": 0.9, "2-HIGH": 0.7, "3-MEDIUM": 0.5}, 0.3).alias("score"), rules.mapped(p, {"1-URGENT": "strong", "2-HIGH": "medium", "3-MEDIUM": "low"}, "weak").alias("level"))


@query(TABLE, "SELECT flags, count(*) AS n FROM (SELECT concat_ws(';', CASE WHEN l_discount > 0.08 THEN 'deep_discount' END, CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_extendedprice < 2000 THEN 'cheap' END) AS flags FROM lineitem) GROUP BY flags")
def amount_quality_flags(spark, sf_dir):
    flags = rules.tags([(F.col("l_discount") > 0.08, "deep_discount"), (F.col("l_quantity") > 45, "large"), (F.col("l_extendedprice") < 2000, "cheap")])
    return read(spark, sf_dir, "lineitem").select(F.array_join(flags, ";").alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


@query(
    TABLE,
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN n_chars <> length(text) THEN 'length_mismatch' END, CASE WHEN regexp_matches(text, '[0-9]{12,}') THEN 'long_number' END) AS issues FROM documents""",
)
def issue_tags(spark, sf_dir):
    t = F.col("text")
    issues = rules.tags([(F.length(t) < 100, "short"), (t.contains("@"), "contact"), (F.lower(t).contains("license"), "license"), (F.col("n_chars") != F.length(t), "length_mismatch"), (t.rlike("[0-9]{12,}"), "long_number")])
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(issues, ",").alias("issues"))


@query(TABLE, "SELECT c_custkey, CAST(round(least(0.95, greatest(0.35, c_acctbal / 10000)), 2) AS DOUBLE) AS score, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'normal' ELSE 'rich' END AS level FROM customer")
def clamped_scores(spark, sf_dir):
    b = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select("c_custkey", T.clamp(b / 10000, 0.35, 0.95).alias("score"), F.when(b < 0, "debt").when(b < 5000, "normal").otherwise("rich").alias("level"))
