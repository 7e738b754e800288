"""Queries that fold, number, budget or window ordered rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import folds
from ..streaming import events as stream
from .base import query, read

TABLE: dict = {}


# Each bucket's distinct items in order; a bucket keeps the first two that no earlier one has kept.
@query(TABLE, """WITH f AS (SELECT l_orderkey, l_returnflag AS flag, 's' || l_suppkey % 5 AS slug, min((l_linenumber, l_partkey, 's' || l_suppkey % 5)) AS p FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, coalesce(list(slug ORDER BY p) FILTER (WHERE flag = 'A'), []) AS a, coalesce(list(slug ORDER BY p) FILTER (WHERE flag = 'N'), []) AS n, coalesce(list(slug ORDER BY p) FILTER (WHERE flag = 'R'), []) AS r FROM f GROUP BY 1),
k AS (SELECT *, a[1:2] AS ka FROM b), m AS (SELECT *, list_filter(n, lambda x: NOT list_contains(ka, x))[1:2] AS kn FROM k)
SELECT l_orderkey, CAST(to_json([ka, kn, list_filter(r, lambda x: NOT list_contains(ka, x) AND NOT list_contains(kn, x))[1:2]]) AS VARCHAR) AS kept FROM m""")  # fmt: skip
def bucket_quota_fold(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("slug"), "l_linenumber", "l_partkey")
    listed = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("l_linenumber", "l_partkey", "slug")))), lambda s: s["slug"])
    buckets = items.groupBy("l_orderkey").agg(F.array(listed("A"), listed("N"), listed("R")).alias("buckets"))
    return buckets.select("l_orderkey", F.to_json(folds.quota_fold(F.col("buckets"), 2)).alias("kept"))


@query(TABLE, "SELECT l_orderkey, slug, l_returnflag, l_linenumber FROM (SELECT l_orderkey, l_suppkey % 5 AS slug, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_returnflag, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def bucket_dedupe_flat(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 5).alias("slug"), "l_returnflag", "l_linenumber")
    return folds.dedupe_flat(items, "l_orderkey", "slug", ["l_returnflag", "l_linenumber"])


@query(TABLE, "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS used FROM conversations) WHERE used <= 1800")
def char_budget_prefix(spark, sf_dir):
    return folds.budget_prefix(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 1800).select("conv_id", "turn", "used")


@query(
    TABLE,
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, max(user_id) AS total FROM events GROUP BY 1), n AS (SELECT day, total, greatest(0, total - coalesce(lag(total) OVER (ORDER BY day), 0)) AS new, row_number() OVER (ORDER BY day) AS k FROM d)
SELECT day, total, new, CAST(k - coalesce(max(CASE WHEN new > 0 THEN k END) OVER (ORDER BY day), 0) AS INT) AS zero_rounds FROM n""",
)
def round_deltas(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.max("user_id").alias("total"))
    return folds.deltas(days, "day", "total")


@query(TABLE, "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 25 AS batch FROM part")
def row_batches(spark, sf_dir):
    rows = folds.places(read(spark, sf_dir, "part").select("p_partkey"), [], ["p_partkey"], F.floor(F.col("p_partkey") / 100_000))
    return rows.select("p_partkey", F.floor((F.col("place") - 1) / 25).alias("batch"))


@query(TABLE, "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS attempt FROM events")
def attempt_numbers(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return folds.places(events, ["user_id", "event_type"], ["ts", "event_id"], F.to_date("ts"), "attempt").select("event_id", "user_id", "attempt")


_PRIORITY = ["error", "purchase", "signup", "click", "view"]


@query(TABLE, "SELECT user_id, arg_min(event_type, (list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type), event_id)) AS event_type, arg_min(event_id, (list_position(['error', 'purchase', 'signup', 'click', 'view'], event_type), event_id)) AS event_id FROM events GROUP BY user_id")
def failure_priority_pick(spark, sf_dir):
    rank = F.struct(F.array_position(F.array(*(F.lit(p) for p in _PRIORITY)), F.col("event_type")), F.col("event_id"))
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", rank).alias("event_type"), F.min_by("event_id", rank).alias("event_id"))


@query(TABLE, "SELECT user_id, max(event_id) AS event_id, event_type, max(ts) AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY user_id, event_type")
def latest_state_per_item(spark, sf_dir):
    return stream.latest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "ts"]).select("user_id", "event_id", "event_type", "ts")


@query(TABLE, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling_counts(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(TABLE, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_stream_watermark(spark, sf_dir):
    found = stream.windowed_counts_of_files(spark, f"{sf_dir}/events.parquet")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(TABLE, "SELECT doc_id, tag, value FROM (SELECT d.doc_id, unnest(['lang', 'source', 'quality', 'toxic']) AS tag, unnest([lang, source, CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR)]) AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE value IS NOT NULL")
def tags_explode(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    long = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("tag"), F.col(c).cast("string").alias("value")) for c in ("lang", "source", "quality", "toxic")))).alias("t"))
    return long.select("doc_id", "t.tag", "t.value").where("value is not null")


@query(TABLE, "SELECT p_partkey, unnest(range(0, p_size // 10 + 1)) AS step, 'effect_' || p_type AS effect FROM part")
def effects_explode(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("p_size") / 10))).alias("step"), F.concat(F.lit("effect_"), F.col("p_type")).alias("effect"))
