"""Queries on names, titles, key sets and grounded quotes' classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import literature as L
from .base import query, read

TABLE: dict = {}


@query(TABLE, """SELECT p_partkey, t AS target, CAST(CASE WHEN contains(p_name, t) THEN 4 ELSE 0 END + CASE WHEN contains(t, p_name) THEN 3 ELSE 0 END + len(list_intersect(string_split(p_name, ' '), string_split(t, ' '))) AS INT) AS score FROM part, (VALUES ('small bolt'), ('gear'), ('hot red ring')) x(t) WHERE contains(p_name, t) OR contains(t, p_name) OR len(list_intersect(string_split(p_name, ' '), string_split(t, ' '))) > 0""")
def token_overlap_suggest(spark, sf_dir):
    targets = F.explode(F.array(*(F.lit(t) for t in ("small bolt", "gear", "hot red ring"))))
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", targets.alias("target"))
    return rows.select("p_partkey", "target", L.overlap_score(F.col("p_name"), F.col("target")).alias("score")).where("score > 0")


@query(TABLE, "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' WHEN d.doc_id IS NULL THEN 'right' ELSE 'both' END AS side FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def key_set_compare(spark, sf_dir):
    return L.key_sets(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query(TABLE, "SELECT p_partkey, CASE WHEN o <> '' THEN o ELSE p_name END AS search_name FROM (SELECT p_partkey, p_name, array_to_string(list_filter(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('ring', 'plate')), lambda w, i: i > 1 OR w NOT IN ('small', 'old', 'hot')), ' ') AS o FROM part)")
def canonical_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", L.search_name(F.col("p_name"), ["ring", "plate"], ["small", "old", "hot"]).alias("search_name"))


@query(TABLE, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 0 END DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def evidence_top(spark, sf_dir):
    level = F.when(F.col("o_orderstatus") == "F", "strong").when(F.col("o_orderstatus") == "O", "medium").otherwise("none")
    return L.per_group_top(read(spark, sf_dir, "orders"), "o_custkey", [*L.evidence_order(level, F.col("o_totalprice")), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query(TABLE, """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 600 - coalesce(sum(CASE WHEN coalesce(text, '') <> '' THEN length(text) + 2 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM conversations)
SELECT conv_id, coalesce(CAST(to_json(list({'name': role, 'text': substr(text, 1, CAST(rest AS BIGINT) - 2)} ORDER BY turn, role, text) FILTER (WHERE text <> '' AND rest > 2)) AS VARCHAR), '[]') AS context FROM t GROUP BY conv_id""")  # fmt: skip
def section_budgets(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    sections = F.transform("t", lambda s: F.struct(s["role"].alias("name"), F.coalesce(s["text"], F.lit("")).alias("text")))
    return turns.select("conv_id", F.to_json(L.section_budget(sections, 600)).alias("context"))


@query(TABLE, None)
def fuzzy_title_match(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(names, "l_partkey")
    asked = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "p_name")).alias("first")).select("l_orderkey", "first.*")
    others = lines.join(asked.select("l_orderkey", F.col("l_partkey").alias("own")), "l_orderkey").where("l_partkey <> own")
    return L.answer_titles(asked, others.withColumnRenamed("p_name", "found"), ["l_orderkey"], "p_name", "l_partkey", "found")
