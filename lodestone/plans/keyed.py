"""Queries that merge, look up and audit by key."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import dedupe, joins
from .base import query, read

TABLE: dict = {}


@query(
    TABLE,
    """SELECT md5(lower(trim(text))) AS key, min(d.doc_id) AS doc_id, arg_min(source, d.doc_id) FILTER (trim(source) <> '') AS source, arg_min(quality, d.doc_id) FILTER (quality IS NOT NULL) AS quality, count(*) AS n_rows
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def citation_dedup_coalesce(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return dedupe.coalescing(rows, F.md5(F.lower(F.trim("text"))), "doc_id", ["source", "quality"])


@query(TABLE, "SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def first_wins_index(spark, sf_dir):
    return dedupe.first_wins(read(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], ["doc_id"])


@query(TABLE, "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, count(*) FILTER (changed) AS n_conflicts FROM (SELECT *, coalesce(role <> lag(role) OVER w OR text <> lag(text) OVER w, false) AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id")
def last_wins_conflicts(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    last = dedupe.first_wins(rows.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], last=True)
    log = dedupe.conflicts(rows, "conv_id", ["turn"], ["role", "text"]).groupBy("conv_id").agg(F.count("*").alias("n_conflicts"))
    return last.join(log, "conv_id", "left").select("conv_id", "turn", "role", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


@query(
    TABLE,
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice DESC, l_partkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1",
)
def best_row_merge(spark, sf_dir):
    rank = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_linenumber")]
    return dedupe.best_row(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey"), ["l_orderkey"], rank)


@query(TABLE, "SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_union_distinct(spark, sf_dir):
    return dedupe.ordered_distinct(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], "event_type").select("user_id", F.array_join("event_type", ",").alias("types"))


@query(TABLE, "SELECT source, lang, max(quality) AS quality, arg_max(d.doc_id, quality * 1000000000 - d.doc_id) AS doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source, lang")
def tag_max_score(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return dedupe.best_row(rows, ["source", "lang"], [F.col("quality"), -F.col("doc_id")]).select("source", "lang", "quality", "doc_id")


@query(TABLE, "SELECT split_part(p_name, ' ', 2) AS base, count(*) AS n_parts, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS variants, sum(p_size) AS total_size FROM part GROUP BY 1")
def variant_collapse(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("base")).agg(F.count("*").alias("n_parts"), F.array_join(F.array_sort(F.collect_set("p_name")), "|").alias("variants"), F.sum("p_size").alias("total_size"))


_STATUSES = ["F", "O", "P", "R", "X"]


@query(TABLE, "SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('R'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def status_counts_full_enum(spark, sf_dir):
    every = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in _STATUSES))).alias("status"))
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query(TABLE, "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())")
def audit_grouping_sets(spark, sf_dir):
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM _lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())")


@query(
    TABLE,
    """SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS n_orders, (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) AS n_repeats,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_orphans, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_childless""",
)
def integrity_metrics(spark, sf_dir):
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    totals = items.agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"), (F.count("*") - F.count_distinct("l_orderkey", "l_linenumber")).alias("n_repeats"))
    orphans = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n_orphans"))
    childless = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count("*").alias("n_childless"))
    return totals.crossJoin(orphans).crossJoin(childless)  # one row each


@query(TABLE, "SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def reference_left_join(spark, sf_dir):
    n = joins.small(read(spark, sf_dir, "nation"))
    return read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), "n_regionkey")


@query(
    TABLE,
    """SELECT CASE WHEN o_orderkey IS NULL THEN 'order_missing' WHEN p_partkey IS NULL THEN 'part_missing' WHEN o_orderstatus = 'P' THEN 'order_pending' ELSE 'used' END AS status, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS quantity
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def claim_source_sideoutput(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    both = items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(read(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    status = F.when(F.col("o_orderkey").isNull(), "order_missing").when(F.col("p_partkey").isNull(), "part_missing").when(F.col("o_orderstatus") == "P", "order_pending").otherwise("used")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query(TABLE, "SELECT c_custkey AS key, coalesce(nullif(s_name, ''), nullif(n_name, ''), c_name) AS name FROM customer LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS s_name FROM supplier) ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_custkey")
def overlay_merge(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    first = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name")).alias("name"))
    second = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return joins.overlay(base, "key", [first, second], ["name"])


@query(
    TABLE,
    """WITH idx AS (SELECT split_part(p_name, ' ', 2) AS cand, min(p_partkey) AS target FROM part GROUP BY 1),
t AS (SELECT p_partkey, CAST(u.pos AS INT) AS pos, u.cand FROM part, LATERAL (VALUES (0, p_name), (1, split_part(p_name, ' ', 1)), (2, split_part(p_name, ' ', 2))) u(pos, cand))
SELECT p_partkey, arg_min(target, pos) AS target, min(pos) AS pos FROM t JOIN idx USING (cand) GROUP BY p_partkey""",
)
def ordered_candidate_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    index = part.groupBy(word(2).alias("cand")).agg(F.min("p_partkey").alias("target"))
    return joins.candidate_lookup(part, "p_partkey", F.array("p_name", word(1), word(2)), index, "cand", "target")


@query(TABLE, "SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS match_count, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def nest_join_matches(spark, sf_dir):
    nested = joins.nest_matches(read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["o_orderdate", "o_orderkey"], [])
    return nested.select("c_custkey", "match_count", F.coalesce(F.array_join(F.col("matches.o_orderkey").cast("array<string>"), ","), F.lit("")).alias("orders"))


@query(TABLE, "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query(TABLE, "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO') GROUP BY 1")
def allowlist_semi_join(spark, sf_dir):
    promo = read(spark, sf_dir, "part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").join(promo, "l_partkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(TABLE, "SELECT md5(lower(trim(text))) AS key, count(DISTINCT (lang, source)) AS n_identities, CASE WHEN count(DISTINCT (lang, source)) = 1 THEN min(source) END AS source FROM documents GROUP BY 1")
def ambiguous_identity(spark, sf_dir):
    n = F.count_distinct("lang", "source")
    return read(spark, sf_dir, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("key")).agg(n.alias("n_identities"), F.min("source").alias("_s")).select("key", "n_identities", F.when(F.col("n_identities") == 1, F.col("_s")).alias("source"))


@query(
    TABLE,
    "WITH RECURSIVE p AS (SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT name, k // 2 FROM p WHERE k > 0) SELECT name, 'NATION_' || min(k) AS root FROM p GROUP BY name",
)
def alias_closure(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    pairs = nation.where("n_nationkey > 0").select(F.col("name").alias("alias"), F.concat(F.lit("NATION_"), F.expr("n_nationkey div 2").cast("string")).alias("target"))
    ends = joins.closure(pairs).select(F.col("alias").alias("name"), F.col("root").alias("end"))
    return nation.join(ends, "name", "left").select("name", F.coalesce("end", "name").alias("root"))


# An order is an alias of its customer's order before it; customers of one segment go in a circle, those of another give two targets.
@query(TABLE, """WITH o AS (SELECT o_custkey, c_mktsegment AS s, o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n, first_value(o_orderkey) OVER w AS root, lag(o_orderkey) OVER w AS prev FROM orders JOIN customer ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT 'o' || o_orderkey AS alias, CASE WHEN s <> 'BUILDING' THEN CASE WHEN s = 'MACHINERY' THEN 'c' || o_custkey ELSE 'o' || root END END AS root, CASE WHEN s = 'MACHINERY' THEN 1 WHEN s <> 'BUILDING' THEN k - 1 END AS steps, CASE s WHEN 'BUILDING' THEN 'cycle' WHEN 'MACHINERY' THEN 'ambiguous' ELSE 'resolved' END AS status
FROM o WHERE s IN ('BUILDING') OR k > 1""")  # fmt: skip
def alias_chains(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("s"))
    rows = read(spark, sf_dir, "orders").join(customer, "o_custkey").select("s", "o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    pairs = rows.select(name("o_orderkey").alias("alias"), F.when(F.col("prev").isNotNull(), name("prev")).when(F.col("s") == "BUILDING", name("end")).alias("target"))
    second = rows.where("s = 'MACHINERY' AND prev IS NOT NULL").select(name("o_orderkey").alias("alias"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target"))
    return joins.closure(pairs.unionByName(second))


@query(TABLE, "SELECT 'customer' AS kind, c_custkey AS key, c_acctbal < 0 AS in_debt FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal < 0 FROM supplier")
def union_partition(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), (F.col("c_acctbal") < 0).alias("in_debt"))
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), (F.col("s_acctbal") < 0).alias("in_debt"))
    return c.unionByName(s)


@query(TABLE, """WITH taken AS (SELECT p_name AS t FROM part WHERE p_size > 25 UNION SELECT p_name || '_generated' FROM part WHERE p_type = 'ECONOMY' AND p_size > 25)
SELECT slug, slug || '_generated' || CASE WHEN slug || '_generated' IN (SELECT t FROM taken) THEN '_2' ELSE '' END AS new_slug FROM (SELECT DISTINCT p_name AS slug FROM part WHERE p_size <= 25) WHERE slug IN (SELECT t FROM taken)""")  # fmt: skip
def slug_renames(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnRenamed("p_name", "slug")
    old = part.where("p_size > 25")
    taken = old.select("slug").unionByName(old.where("p_type = 'ECONOMY'").select(F.concat("slug", F.lit("_generated")).alias("slug")))
    return joins.renamed(part.where("p_size <= 25").groupBy("slug").agg(F.min("p_partkey").alias("k")), "slug", taken, "k")


@query(TABLE, "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) END AS pct FROM orders GROUP BY o_custkey")
def completion_rates(spark, sf_dir):
    done = F.count_if(F.col("o_orderstatus") == "F")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), done.alias("n_done"), F.round(100.0 * done / F.count("*"), 2).alias("pct"))
