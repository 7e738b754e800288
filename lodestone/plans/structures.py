"""Queries of papers on their headings, item states, aliases, pages of collectors and coverage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import tables
from ..operators import assembly as A, claims as C, evidence as V, exports as X, joins, papers
from ..sources import connectors
from ..streaming import events as E, items
from .base import query, read

TABLE: dict = {}

# Documents as papers: with an introduction (en), structured without one (de), with their abstract in the text (fr), bare (es and others).
_T = "coalesce(text, '')"
_EN = f"concat('Title of ', CAST(doc_id AS {{s}}), {{n}}, 'Abstract ', left({_T}, 200), {{n}}, 'Keywords: zinc', {{n}}, '1. Introduction', {{n}}, {_T}, {{n}}, '2. Methods', {{n}}, left({_T}, 400), {{n}}, 'Results', {{n}}, {_T}, {{n}}, 'Discussion', {{n}}, 'It is so.', {{n}}, 'Conclusions', {{n}}, 'Enough.', {{n}}, 'References', {{n}}, 'Smith J, and others.')"
_DE = f"concat(repeat('plain head words ', 25), ' Methods ', {_T}, ' Results ', {_T}, ' Discussion It is so. References Smith AB, 2001')"
_FR = f"concat('In short, zinc.  ', {_T}, {{n}}, 'References', {{n}}, 'Smith')"


def _paper(string: str, newline: str) -> str:
    en, fr = _EN.format(s=string, n=newline), _FR.format(n=newline)
    return f"CASE lang WHEN 'en' THEN {en} WHEN 'de' THEN {_DE} WHEN 'fr' THEN {fr} ELSE text END"


def _papers(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("source_id"), "lang", F.expr(_paper("STRING", "'\\n'")).alias("text"), F.expr("CASE lang WHEN 'fr' THEN 'IN SHORT,  zinc.' END").alias("abstract"), F.lit(None).cast("string").alias("title"))


_SPACES = r"'[\s\x1c-\x1f\x{85}\pZ]+'"
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\pZ]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\pZ]+$', '')"
_COLLAPSE = "trim(regexp_replace({0}, " + _SPACES.replace("{", "{{").replace("}", "}}") + ", ' ', 'g'))"
#: The words, dots for what is cut.
_SHORT = f"CASE WHEN length({_COLLAPSE}) <= 4000 THEN {_COLLAPSE} ELSE rtrim(regexp_replace(left({_COLLAPSE}, 3997), '\\s+\\S*$', '')) || '...' END"


@query(TABLE, f"""WITH d AS (SELECT doc_id, lang, {_T} AS t, length({_T}) AS n, text IS NULL AS none FROM documents),
b AS (SELECT *, CASE lang WHEN 'en' THEN concat('1. Introduction', chr(10), t, chr(10), '2. Methods', chr(10), left(t, 400), chr(10), 'Results', chr(10), t, chr(10), 'Discussion', chr(10), 'It is so.')
 WHEN 'de' THEN {_STRIP.format("concat('Methods ', t, ' Results ', t, ' Discussion It is so.')")} WHEN 'fr' THEN {_STRIP.format("CASE WHEN length(ltrim(t)) + 1 >= 500 THEN t ELSE concat(t, chr(10), 'References', chr(10), 'Smith') END")} END AS body,
 CASE lang WHEN 'en' THEN concat('Keywords: zinc 1. Introduction ', t, ' 2. Methods ', left(t, 400), ' Results ', t, ' Discussion It is so.') WHEN 'de' THEN concat(repeat('plain head words ', 25), ' Methods ', t, ' Results ', t, ' Discussion It is so.', CASE WHEN 2 * n + 465 < 500 THEN ' References Smith AB, 2001' ELSE '' END) WHEN 'fr' THEN CASE WHEN length(ltrim(t)) + 1 >= 500 THEN t ELSE concat(t, ' References Smith') END ELSE t END AS preview FROM d),
s AS (SELECT *, CASE lang WHEN 'en' THEN CASE WHEN length(body) >= 500 THEN 'introduction' END WHEN 'fr' THEN CASE WHEN length(body) >= 500 THEN 'abstract_removed' END
 WHEN 'de' THEN CASE WHEN length(body) >= 2000 AND n + 9 >= 800 AND 2 * n + 18 >= 1500 THEN 'structure' WHEN length(body) >= 2000 THEN 'sections' END END AS stage FROM b)
SELECT doc_id, CASE WHEN stage IS NOT NULL THEN body END AS text, coalesce(stage, 'failed') AS stage, CASE WHEN stage IS NULL AND NOT (none AND (lang IS NULL OR lang NOT IN ('en', 'de', 'fr'))) THEN {_SHORT.format('preview')} END AS preview FROM s""")  # fmt: skip
def paper_bodies(spark, sf_dir):
    return papers.sanitized(_papers(spark, sf_dir)).withColumnRenamed("source_id", "doc_id")


_MOST = 3000


@query(TABLE, f"""WITH d AS (SELECT doc_id, {_T} AS t FROM documents),
x AS (SELECT doc_id, concat('Title of ', doc_id, chr(10), 'Keywords: zinc', chr(10)) AS h, {_STRIP.format("concat('1. Introduction', chr(10), t)")} AS i, {_STRIP.format("concat('2. Methods', chr(10), left(t, 400))")} AS m, {_STRIP.format("concat('Results', chr(10), t)")} AS r,
 concat('1. Introduction', chr(10), t, chr(10), '2. Methods', chr(10), left(t, 400), chr(10), 'Results', chr(10), t, chr(10), 'Discussion', chr(10), 'It is so.', chr(10), 'Conclusions', chr(10), 'Enough.') AS rest FROM d),
w AS (SELECT *, h || rest AS whole, concat('Discussion', chr(10), 'It is so.') AS di, concat('Conclusions', chr(10), 'Enough.') AS c FROM x),
l AS (SELECT *, greatest({_MOST} - length(m) - 2, 0) AS lr FROM w), l2 AS (SELECT *, greatest(lr - length(r) - 2, 0) AS ld FROM l), l3 AS (SELECT *, greatest(ld - length(di) - 2, 0) AS lc FROM l2), l4 AS (SELECT *, greatest(lc - length(c) - 2, 0) AS li FROM l3)
SELECT doc_id, CASE WHEN length(whole) <= {_MOST} THEN whole ELSE concat_ws(chr(10) || chr(10), CASE WHEN li > 0 THEN left(i, li) END, m, CASE WHEN lr > 0 THEN left(r, lr) END, CASE WHEN ld > 0 THEN left(di, ld) END, CASE WHEN lc > 0 THEN left(c, lc) END) END AS text,
CASE WHEN length(whole) <= {_MOST} THEN 'complete_body_without_abstract_or_references' ELSE 'section_priority' END AS strategy,
CASE WHEN length(whole) <= {_MOST} THEN 'complete_body' ELSE concat_ws(',', CASE WHEN li > 0 THEN 'introduction' END, 'methods', CASE WHEN lr > 0 THEN 'results' END, CASE WHEN ld > 0 THEN 'discussion' END, CASE WHEN lc > 0 THEN 'conclusions' END) END AS sections FROM l4""")  # fmt: skip
def extraction_contexts(spark, sf_dir):
    text = F.expr(_EN.format(s="STRING", n="'\\n'"))
    bodies = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return papers.extraction_contexts(bodies, "doc_id", most=_MOST).select("doc_id", "text", "strategy", F.array_join("sections", ",").alias("sections"))


# Users of the event stream as items of a session.
_STEP = "CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'start' WHEN 'click' THEN 'complete' WHEN 'error' THEN CASE WHEN value < 20 THEN 'fail' ELSE 'cancel' END WHEN 'purchase' THEN CASE WHEN value < 5 THEN 'accept' WHEN value < 10 THEN 'reject' WHEN value < 60 THEN 'hold' ELSE 'retry' END END"
_PATIENCE, _RETRIES = 30, 4
_NEXT = " ".join(f"WHEN status = '{a}' AND event = '{e}' THEN '{b}'" for (a, e), b in items.TRANSITIONS.items())


@query(TABLE, f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS item, ts, event_id, {_STEP} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT item, 0::BIGINT AS k, '' AS status, NULL::TIMESTAMP AS began, NULL::TIMESTAMP AS since, 0 AS attempts, 0 AS taken, 0 AS timed_out, 0 AS refused FROM e WHERE k = 1
UNION ALL SELECT item, k, CASE WHEN ok THEN goes ELSE status END, CASE WHEN ok THEN CASE WHEN goes = 'running' THEN ts END ELSE began END, CASE WHEN ok THEN ts ELSE since END, attempts + CASE WHEN ok AND event = 'retry' THEN 1 ELSE 0 END, taken + CASE WHEN ok THEN 1 ELSE 0 END, timed_out, refused + CASE WHEN ok THEN 0 ELSE 1 END
FROM (SELECT *, goes IS NOT NULL AND NOT (event = 'retry' AND attempts >= {_RETRIES}) AS ok FROM (SELECT *, CASE {_NEXT} END AS goes FROM (
 SELECT s.item, e.k, e.ts, e.event, s.attempts, s.taken, s.refused, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN NULL ELSE began END AS began, CASE WHEN late THEN began + INTERVAL {_PATIENCE} HOUR ELSE since END AS since, timed_out + CASE WHEN late THEN 1 ELSE 0 END AS timed_out
 FROM (SELECT s.*, e.ts AS at, coalesce(status = 'running' AND e.ts > began + INTERVAL {_PATIENCE} HOUR, false) AS late FROM s JOIN e ON e.item = s.item AND e.k = s.k + 1) s JOIN e ON e.item = s.item AND e.k = s.k + 1)))),
f AS (SELECT s.*, coalesce(status = 'running' AND began + INTERVAL {_PATIENCE} HOUR <= (SELECT max(ts) FROM events), false) AS late FROM s WHERE (item, k) IN (SELECT (item, max(k)) FROM e GROUP BY item))
SELECT item, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN began + INTERVAL {_PATIENCE} HOUR ELSE since END AS since, attempts, taken, timed_out + CASE WHEN late THEN 1 ELSE 0 END AS timed_out, refused FROM f""")  # fmt: skip
def item_states(spark, sf_dir):
    step = lambda rows: rows.select(F.col("user_id").alias("item"), "ts", "event_id", F.expr(_STEP).alias("event"))
    return items.states_of_files(spark, sf_dir, E.SCHEMA, step, "events.parquet", patience=f"{_PATIENCE} hours", retries=_RETRIES)


# Parts as what search services answer: three primary ones, of which two fail on the way, and a fallback; pages are sizes.
_PAGE_SIZE, _TARGET, _PAGES = 12, 260, 10
_OFF = {"openalex": (6, 1, 500), "europe_pmc": (2, 2, 429), "semantic_scholar": (1, 1, 403)}
_PLACED = "SELECT *, p_size - 1 AS page, CAST(p_partkey % 3 AS INT) AS query, row_number() OVER (PARTITION BY p_size, p_partkey % 3 ORDER BY p_partkey) - 1 AS pos FROM part"


def _answers(spark, sf_dir):
    read(spark, sf_dir, "part").createOrReplaceTempView("lodestone_part")
    rows = spark.sql(_PLACED.replace("FROM part", "FROM lodestone_part"))
    doi = lambda n: F.concat(F.lit(f"10.{n}/"), F.col("p_partkey").cast("string"))
    item = {
        "openalex": F.struct(doi(1).alias("doi"), F.col("p_name").alias("display_name"), F.lit(2001).alias("publication_year")), "europe_pmc": F.struct(F.col("p_partkey").cast("string").alias("pmid"), F.col("p_name").alias("title")),
        "crossref": F.struct(F.array("p_name").alias("title")), "semantic_scholar": F.struct(F.col("p_name").alias("title"), F.struct(doi(2).alias("DOI")).alias("externalIds")),
    }
    wrap = {"openalex": lambda x: F.struct(x.alias("results")), "europe_pmc": lambda x: F.struct(F.struct(x.alias("result")).alias("resultList")), "crossref": lambda x: F.struct(F.struct(x.alias("items")).alias("message")), "semantic_scholar": lambda x: F.struct(x.alias("data"))}
    out = None
    for source, i in item.items():
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", i.alias("x")))), lambda e: e["x"])
        page, query, status = _OFF.get(source, (None, None, None))
        code = F.lit(200) if page is None else F.when((F.col("page") > page) & (F.col("query") == 0) | (F.col("page") == page) & (F.col("query") == query), status).otherwise(200)
        one = rows.groupBy("page", "query").agg(F.to_json(wrap[source](listed)).alias("payload")).select(F.lit(source).alias("source"), "query", "page", code.alias("status"), "payload")
        out = one if out is None else out.unionByName(one)
    return out


def _run(spark, sf_dir):
    return connectors.candidate_run(_answers(spark, sf_dir), _PAGE_SIZE, 3, _TARGET, _PAGES)


def _first_failure(page: int, query: int) -> str:
    return f"min(page * 100 + query) FILTER (page > {page} AND query = 0 OR page = {page} AND query = {query})"


_SCAN = f"""WITH a AS ({_PLACED}), o AS (SELECT {', '.join(f'{_first_failure(p, q)} AS {s}' for s, (p, q, _) in _OFF.items())} FROM a), r AS (
SELECT 1 AS c, 'europe_pmc' AS source, query, page, pos, 'pmid:' || p_partkey AS key, page AS slot FROM a, o WHERE page * 100 + query < coalesce(europe_pmc, 1000000) UNION ALL SELECT 2, 'openalex', query, page, pos, '10.1/' || p_partkey, page FROM a, o WHERE page * 100 + query < coalesce(openalex, 1000000)
UNION ALL SELECT 3, 'crossref', query, page, pos, lower(p_name), page FROM a UNION ALL SELECT 0, 'semantic_scholar', query, page, pos, '10.2/' || p_partkey, page + {_PAGES} FROM a, o WHERE page < 2 AND page * 100 + query < coalesce(semantic_scholar, 1000000)),
k AS (SELECT * FROM r WHERE pos < {_PAGE_SIZE // 3} AND (source = 'semantic_scholar' OR slot < {_PAGES})), f1 AS (SELECT key, min(slot) AS slot FROM k WHERE slot < {_PAGES} GROUP BY key),
p1 AS (SELECT i AS slot, (SELECT count(*) FROM k WHERE k.slot = i) AS raw, (SELECT count(*) FROM f1 WHERE f1.slot = i) AS new FROM range({_PAGES}) t(i)), t1 AS (SELECT *, sum(new) OVER (ORDER BY slot) AS total FROM p1),
e1 AS (SELECT coalesce(min(slot) FILTER (total >= {_TARGET} OR new = 0), {_PAGES - 1}) AS last FROM t1), d1 AS (SELECT last, total, total >= {_TARGET} AS full FROM t1, e1 WHERE slot = last),
f2 AS (SELECT key, min(slot) AS slot FROM k WHERE slot >= {_PAGES} AND key NOT IN (SELECT key FROM f1, e1 WHERE slot <= last) GROUP BY key),
p2 AS (SELECT i AS slot, (SELECT count(*) FROM k WHERE k.slot = i) AS raw, (SELECT count(*) FROM f2 WHERE f2.slot = i) AS new FROM range({_PAGES}, {_PAGES} + 2) t(i), d1 WHERE NOT "full"), t2 AS (SELECT p2.*, sum(new) OVER (ORDER BY slot) + d1.total AS total FROM p2, d1),
e2 AS (SELECT coalesce(min(slot) FILTER (total >= {_TARGET} OR new = 0), {_PAGES + 1}) AS last FROM t2),
pages AS (SELECT slot, 'primary' AS mode, slot AS page, raw, new, total FROM t1, e1 WHERE slot <= last UNION ALL SELECT slot, 'fallback', slot - {_PAGES}, raw, new, total FROM t2, e2 WHERE slot <= last),
"""


@query(TABLE, _SCAN + f"kept AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY slot, c, query, pos) AS n FROM k WHERE slot IN (SELECT slot FROM pages)) SELECT key, source, query, page, slot FROM kept WHERE n = 1 ORDER BY slot, c, query, pos LIMIT {_TARGET}")
def candidate_run(spark, sf_dir):
    return _run(spark, sf_dir)["candidates"].select("key", "source", "query", "page", "slot")


@query(TABLE, _SCAN + f"x AS (SELECT 1) SELECT slot, mode, page, raw, new, total, CASE WHEN total >= {_TARGET} THEN 'target_reached' WHEN new = 0 THEN 'no_new_unique_candidates' END AS stop FROM pages")
def candidate_run_pages(spark, sf_dir):
    return _run(spark, sf_dir)["pages"]


@query(TABLE, _SCAN + f"""f AS (SELECT 'openalex' AS source, openalex AS v, 0 AS base, 'retrieval_error' AS code FROM o UNION ALL SELECT 'europe_pmc', europe_pmc, 0, 'rate_limited' FROM o UNION ALL SELECT 'semantic_scholar', semantic_scholar, {_PAGES}, 'blocked' FROM o)
SELECT source, v % 100 AS query, v // 100 AS page, code FROM f WHERE v // 100 + base IN (SELECT slot FROM pages)""")  # fmt: skip
def candidate_run_failures(spark, sf_dir):
    return _run(spark, sf_dir)["failures"]


# Parts as rows that list the names they cover, some cells broken.
_CELL = "CASE WHEN p_size < 4 THEN '[broken' WHEN p_size < 6 THEN '\"text\"' WHEN p_size < 8 THEN NULL ELSE concat('[\"', replace(p_name, ' ', '\", \" '), '\", ', CAST(p_size AS {s}), ', \"  \", null, \"', p_brand, '\"]') END"


@query(TABLE, f"""WITH c AS (SELECT p_partkey, p_brand, p_size, p_name FROM part WHERE p_size >= 8), n AS (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ') || [CAST(p_size AS VARCHAR), '', NULL, p_brand]) AS name, unnest(range(len(string_split(p_name, ' ')) + 4)) AS place FROM c)
SELECT lower(trim(name)) AS key, arg_min(place, (p_partkey, place)) AS place, arg_min(p_partkey, (p_partkey, place)) AS p_partkey, arg_min(p_brand, (p_partkey, place)) AS p_brand FROM n WHERE trim(coalesce(name, '')) <> '' GROUP BY 1""")  # fmt: skip
def coverage_index(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_CELL.format(s="STRING")).alias("names"))
    return joins.coverage_index(rows, "names", ["p_partkey"], ["p_partkey", "p_brand"])


# Customers as the rows that were asked for; orders and users as answers, of which some were not.
_ANSWERED = "SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus AS v FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT user_id + 100000, event_id, event_type FROM events WHERE value > 150"


@query(TABLE, f"WITH a AS (SELECT k, count(*) AS n FROM ({_ANSWERED}) GROUP BY k) SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' ELSE 'both' END AS side, coalesce(n, 0) AS n_answers FROM customer FULL JOIN a ON k = c_custkey")
def answers_compared(spark, sf_dir):
    expected, answers = _expected(spark, sf_dir)
    return joins.compared(expected, answers, ["k"])


@query(TABLE, f"WITH a AS (SELECT k, arg_min(v, (seq, v)) AS v FROM ({_ANSWERED}) GROUP BY k) SELECT c_custkey AS k, c_name, CASE WHEN k IS NULL THEN 'unknown ' || c_mktsegment ELSE v END AS v, k IS NULL AS is_fallback FROM customer LEFT JOIN a ON k = c_custkey")
def answers_completed(spark, sf_dir):
    expected, answers = _expected(spark, sf_dir)
    rows, _ = joins.completed(expected, answers, ["k"], ["v"], ["seq", "v"], {"v": F.concat(F.lit("unknown "), F.col("c_mktsegment"))})
    return rows.drop("c_mktsegment")


def _expected(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("v"))
    users = read(spark, sf_dir, "events").where("value > 150").select((F.col("user_id") + 100000).alias("k"), F.col("event_id").alias("seq"), F.col("event_type").alias("v"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment"), orders.unionByName(users)


# Orders as rows whose cautions are partly benefits; the evidence of a line is its level or its score.
_LEVEL = "CASE l_linenumber WHEN 1 THEN 'Strong trials' WHEN 2 THEN 'moderate' ELSE '' END"
_TO = f"CASE WHEN l_linenumber = 1 OR l_discount * 10 >= 0.8 THEN 'strong_evidence' WHEN l_linenumber = 2 OR l_discount * 10 >= 0.55 THEN 'medium_evidence' ELSE 'low_evidence' END"
_REROUTED = f"""WITH l AS (SELECT *, 's' || (l_suppkey % 3) AS slug, l_linenumber || '/' || l_partkey AS name, {_TO} AS goes, (l_linenumber, l_partkey, l_quantity) AS seq FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
r AS (SELECT l_orderkey AS k, list(DISTINCT slug) AS slugs FROM l WHERE l_returnflag = 'A' GROUP BY 1),
m AS (SELECT *, l_returnflag <> 'A' AND l_linestatus = 'F' AND NOT coalesce(list_contains(slugs, slug), false) AS good FROM l LEFT JOIN r ON k = l_orderkey),
x AS (SELECT *, good AND row_number() OVER (PARTITION BY l_orderkey, slug, good ORDER BY seq) = 1 AS moved FROM m)
"""


def _effects(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    label = F.when(F.col("l_linestatus") == "F", "Soluble fiber for satiety").otherwise("Bloating after soluble fiber, satiety")
    name = F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))
    effect = F.struct(F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("effect_slug"), label.alias("effect_label"), name.alias("summary"), F.expr(_LEVEL).alias("evidence_level"), (F.col("l_discount") * 10).alias("score"), F.array(F.lit("Fiber")).alias("supporting_nutrients"))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("l_linenumber", "l_partkey", "l_quantity", effect.alias("e"))))), lambda s: s["e"])
    rows = lines.groupBy("o_orderkey").agg(listed(F.col("l_returnflag") == "A").alias("strong_evidence"), listed(F.col("l_returnflag") != "A").alias(C.NEGATIVE))
    kind = rows.schema["strong_evidence"].dataType.simpleString()
    return C.reroute(rows.withColumn("medium_evidence", F.lit(None).cast(kind)).withColumn("low_evidence", F.array().cast(kind)), ["o_orderkey"])


@query(TABLE, _REROUTED + """SELECT l_orderkey AS o_orderkey, coalesce(string_agg(name, ',' ORDER BY CASE WHEN moved THEN 1 ELSE 0 END, seq) FILTER (l_returnflag = 'A' OR moved AND goes = 'strong_evidence'), '') AS strong_evidence, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (moved AND goes = 'medium_evidence'), '') AS medium_evidence,
coalesce(string_agg(name, ',' ORDER BY seq) FILTER (moved AND goes = 'low_evidence'), '') AS low_evidence, coalesce(string_agg(name, ',' ORDER BY seq) FILTER (l_returnflag <> 'A' AND NOT moved), '') AS negative_or_cautionary_effects FROM x GROUP BY 1""")  # fmt: skip
def rerouted_rows(spark, sf_dir):
    rows, _ = _effects(spark, sf_dir)
    return rows.select("o_orderkey", *(F.array_join(F.transform(b, lambda e: e["summary"]), ",").alias(b) for b in (*C.REGULAR, C.NEGATIVE)))


@query(TABLE, _REROUTED + "SELECT l_orderkey AS o_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) - 1 AS INT) AS place, slug AS effect_slug, 'negative_or_cautionary_effects' AS moved_from, goes AS moved_to, name AS summary FROM x WHERE moved")
def rerouted_log(spark, sf_dir):
    _, log = _effects(spark, sf_dir)
    return log.select("o_orderkey", "place", "effect_slug", "moved_from", "moved_to", F.col("effect.summary").alias("summary"))


@query(TABLE, "SELECT o_custkey, o_orderpriority AS tag, o_orderstatus AS tag_type, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS source_bucket, max(o_totalprice) AS score, count(*) AS n FROM orders GROUP BY ALL")
def table_function_tags(spark, sf_dir):
    tables.register(spark)
    read(spark, sf_dir, "orders").createOrReplaceTempView("lodestone_orders")
    return spark.sql("SELECT * FROM max_tags(TABLE(SELECT o_custkey, o_orderpriority AS tag, o_orderstatus AS tag_type, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS source_bucket, o_totalprice AS score FROM lodestone_orders), 'o_custkey')")


@query(TABLE, "SELECT 'polyphenol' AS bioactive_type, 'c' || min(c_custkey) AS bioactive_id, arg_min(' ' || c_name || ' ', c_custkey) AS bioactive_name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(replace(s_name, 'Supplier', 'Customer')) FROM supplier) GROUP BY lower(c_name)")
def new_entity_rows(spark, sf_dir):
    claims = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.lit("polyphenol").alias("bioactive_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("bioactive_id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("bioactive_name"))
    lookup = read(spark, sf_dir, "supplier").select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("bioactive_name"))
    return X.new_entities(claims, lookup, "2024-01-01").select("bioactive_type", "bioactive_id", "bioactive_name")


@query(TABLE, """SELECT row_number() OVER (ORDER BY lower(p_type), CAST(l_suppkey AS VARCHAR), l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity || '-' || l_extendedprice) AS place, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_quantity || '-' || l_extendedprice AS claim_id, p_type AS health_effect, 'Positive' AS direction, CASE WHEN p_size > 25 THEN 'Not reported' ELSE p_brand END AS population,
CASE WHEN p_size > 30 THEN 'natural food level' ELSE 'dose ' || p_size END AS oral_exposure, CASE l_returnflag WHEN 'A' THEN 'Human RCT' WHEN 'N' THEN 'Human observational study' ELSE 'Other Kind' END AS evidence, CASE WHEN l_linestatus = 'F' THEN 'validated' ELSE p_name END AS finding, CASE WHEN l_tax > 0.05 THEN 'Supported with limitations' ELSE 'Supported' END AS status, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS source_title
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey""")  # fmt: skip
def public_report_rows(spark, sf_dir):
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    # a line's marks in one small number, which its words are made of once it is in place
    marks = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0) + F.when(F.col("l_tax") > 0.05, 4).otherwise(0) + F.when(F.col("l_linestatus") == "F", 8).otherwise(0)
    marked = lambda bit: F.col("marks").bitwiseAND(bit) != 0
    late = {
        "claim_id": F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "proposed_claim_id", "l_quantity", "l_extendedprice"))), "verdict": F.when(marked(4), "supported_with_limitations").otherwise("supported"),
        "support_level": F.when(marked(2), "human_rct").when(marked(1), "human_observational").otherwise("other_kind"), "validated_statement": F.when(marked(8), "validated"), "limitations": F.array(F.col("l_shipmode") if "l_shipmode" in lines.columns else F.lit("none")),
        "population": F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand")), "dose_or_exposure": F.when(F.col("p_size") <= 30, F.concat(F.lit("dose "), F.col("p_size").cast("string"))),
    }
    validated = lines.withColumnRenamed("l_partkey", "proposed_claim_id").withColumns({"citation_id": F.col("l_suppkey").cast("string"), "marks": marks})
    proposed = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("proposed_effect_label"), F.lit("slug").alias("proposed_effect_slug"), F.lit("positive").alias("direction"), F.lit("natural_food_level").alias("exposure_category"), F.lit("rct").alias("study_type"), F.col("p_name").alias("statement"), "p_brand", "p_size")
    sources = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("doi", "pmid", "url")))
    return X.public_report(validated, proposed, sources, late).select("place", "claim_id", "health_effect", "direction", "population", "oral_exposure", "evidence", "finding", "status", "source_title")


# Suppliers as rows of a report and their lines as accepted claims; some have a text and tags of their own.
_CHARS = 400
_SENTENCE = "'Line ' || l_linenumber || ' of  part ' || l_partkey || CASE WHEN l_quantity > 25 THEN ' (dose/exposure: ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' mg' || CASE WHEN l_linestatus = 'F' THEN '; evidence form: natural food level' ELSE '' END || ').' WHEN l_linestatus = 'F' THEN ' (evidence form: natural food level).' ELSE '' END"


@query(TABLE, f"""WITH c AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS seq, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'negative' END AS side, regexp_replace({_SENTENCE}, ' +', ' ', 'g') AS s, 't' || l_linenumber AS tag, CASE WHEN l_discount > 0.05 THEN 0.9::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM lineitem),
d AS (SELECT *, CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END AS e FROM c WHERE side IS NOT NULL), t AS (SELECT k, side, string_agg(e, ' ' ORDER BY seq) AS text FROM (SELECT *, sum(length(e) + 1) OVER (PARTITION BY k, side ORDER BY seq) - 1 AS z FROM d) WHERE z <= {_CHARS} GROUP BY k, side),
g AS (SELECT k, side, string_agg(tag || ':' || CAST(confidence AS VARCHAR), ',' ORDER BY f) AS tags FROM (SELECT k, side, tag, min(seq) AS f, max(confidence) AS confidence FROM d GROUP BY ALL) GROUP BY k, side),
own AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 5000 THEN s_name ELSE '' END AS text, CASE WHEN s_acctbal > 5000 THEN 'own:0.5' ELSE '' END AS tags FROM supplier)
SELECT own.k, coalesce(p.text, own.text) AS positive, coalesce(pg.tags, own.tags) AS positive_tags, coalesce(n.text, own.text) AS negative, coalesce(ng.tags, own.tags) AS negative_tags FROM own LEFT JOIN t p ON p.k = own.k AND p.side = 'positive' LEFT JOIN t n ON n.k = own.k AND n.side = 'negative'
LEFT JOIN g pg ON pg.k = own.k AND pg.side = 'positive' LEFT JOIN g ng ON ng.k = own.k AND ng.side = 'negative'""")  # fmt: skip
def packet_reports(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"))
    lines = read(spark, sf_dir, "lineitem")
    said = F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" of  part "), F.col("l_partkey").cast("string"))
    none = F.lit(None).cast("string")
    sentence = V.claim_sentence(said, F.when(F.col("l_quantity") > 25, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mg"))), none, F.when(F.col("l_linestatus") == "F", "natural_food_level").otherwise("unclear"), none)
    direction = F.when(F.col("l_returnflag") == "A", "beneficial").when(F.col("l_returnflag") == "N", "harmful").otherwise("mixed")
    claims = lines.select(F.col("l_suppkey").alias("k"), seq.alias("seq"), direction.alias("direction"), sentence.alias("sentence"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("tag"), F.when(F.col("l_discount") > 0.05, 0.9).otherwise(0.55).alias("confidence"))
    text, own = F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise(""), F.when(F.col("s_acctbal") > 5000, '[{"tag": "own", "confidence": 0.5}]').otherwise("[broken")
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("positive"), text.alias("negative"), own.alias("positive_tags"), own.alias("negative_tags"))
    reports, _ = V.packet_reports(rows, claims, "k", most=_CHARS)
    told = lambda c: F.array_join(F.transform(c, lambda t: F.concat(t["tag"], F.lit(":"), t["confidence"].cast("string"))), ",").alias(c)
    return reports.select("k", "positive", told("positive_tags"), "negative", told("negative_tags"))


_UNIT = "CASE WHEN p_size % 3 = 0 THEN 'mg' WHEN p_size % 3 = 1 THEN 'mg per day' ELSE 'pH' END"


@query(TABLE, f"""WITH p AS (SELECT p_partkey AS name, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '' END AS a, CASE WHEN p_size > 10 THEN 'mg' ELSE '' END AS u, CASE WHEN p_size > 20 THEN CAST(p_partkey % 50 AS VARCHAR) ELSE '' END AS b, CASE WHEN p_size > 20 THEN {_UNIT} ELSE '' END AS v FROM part),
c AS (SELECT *, a <> '' AND b <> '' AND split_part(u, ' ', 1) = split_part(v, ' ', 1) AND TRY_CAST(b AS DOUBLE) <= TRY_CAST(a AS DOUBLE) AS crossed FROM p)
SELECT name, CASE WHEN a = '' THEN '{A.UNDEFINED}' ELSE '< ' || a || ' ' || u || '; do not surface direct health-effect claims, only optional background presence language.' END AS trace_definition,
CASE WHEN a = '' THEN '{A.UNDEFINED}' ELSE '>= ' || a || ' ' || u || CASE WHEN b <> '' AND NOT crossed THEN ' and below ' || b || ' ' || v || '; eligible for normal food-level/naturally occurring health-effect summaries.' ELSE '; eligible for normal food-level/naturally occurring health-effect summaries when evidence context supports the effect.' || CASE WHEN crossed THEN ' Supplement threshold is not above the meaningful threshold; review thresholds before routing supplement-level effects.' ELSE '' END END END AS meaningful_definition,
CASE WHEN b = '' THEN '{A.NO_SUPPLEMENT}' WHEN v = 'pH' THEN 'pH <= ' || b || '; high-acidity context may be considered when the effect context matches the recipe acidity. This is not a supplement-dose threshold.' ELSE '>= ' || b || ' ' || v || '; supplement-level, therapeutic-dose, high-caution, or high-exposure effects may be considered when the effect context matches the recipe dose.' END AS supplement_definition,
CASE WHEN a = '' THEN 'needs_meaningful_review' WHEN crossed THEN 'needs_meaningful_review_non_monotonic' ELSE 'draft_meaningful_baseline' END AS meaningful_review_status, CASE WHEN b = '' THEN 'needs_supplement_dose_review' ELSE 'reviewed' END AS supplement_review_status FROM c""")  # fmt: skip
def threshold_definitions(spark, sf_dir):
    given = lambda test, value: F.when(test, value).otherwise("")
    some, more = F.col("p_size") > 10, F.col("p_size") > 20
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), given(some, F.col("p_size").cast("string")).alias("meaningful_threshold_amount"), given(some, "mg").alias("meaningful_threshold_unit"), given(more, (F.col("p_partkey") % 50).cast("string")).alias("supplement_threshold_amount"), given(more, F.expr(_UNIT)).alias("supplement_threshold_unit"), F.lit("reviewed").alias("review_status"))
    reference = rows.limit(0).select("name", *(F.lit("").alias(c) for c in ("reference_type", "threshold_notes", "source")))
    out = A.migrated_thresholds(rows, reference, "name")
    return out.select("name", "trace_definition", "meaningful_definition", "supplement_definition", "meaningful_review_status", "supplement_review_status")
