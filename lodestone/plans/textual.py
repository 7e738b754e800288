"""Queries over texts: grounding, markers, keys, queries, rules, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D, joins
from .base import query, read

TABLE: dict = {}


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _tier3(x: str) -> str:
    for k, v in T.LIGATURES.items():
        x = f"replace({x}, '{k}', '{v}')"
    for _ in range(2):  # without look-around a letter between two hyphens needs a second pass
        x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}])-\s*([\p{{L}}\p{{N}}])', '\1\2', 'g')"
    return _collapse(x)


_GROUND = f"""SELECT doc_id, item_id, CASE WHEN contains(d.text, q.text) THEN 'exact' WHEN contains(d.c, q.c) THEN 'whitespace' ELSE 'normalized' END AS tier
FROM (SELECT doc_id, text, {_collapse('text')} AS c, {_tier3('text')} AS t FROM documents) d JOIN (SELECT item_id, text, {_collapse('text')} AS c, {_tier3('text')} AS t FROM benchmark) q ON contains(d.t, q.t)"""


def _grounded(spark, sf_dir):
    return joins.grounded(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(TABLE, _GROUND)
def quote_grounding(spark, sf_dir):
    return _grounded(spark, sf_dir)


@query(TABLE, f"SELECT doc_id, count(*) AS n_quotes, min(item_id) AS first_item, max(item_id) AS last_item FROM ({_GROUND}) GROUP BY doc_id")
def quote_grounding_by_doc(spark, sf_dir):
    return _grounded(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_quotes"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))


@query(
    TABLE,
    """SELECT doc_id, length(text) >= 1500 AS long_enough, contains(lower(text), 'license') OR contains(lower(text), 'copyright') AS denied,
CAST(contains(lower(text), ' the ') AS INT) + CAST(contains(lower(text), ' der ') AS INT) + CAST(contains(lower(text), ' les ') AS INT) + CAST(contains(lower(text), ' que ') AS INT) AS n_markers,
length(text) >= 1500 AND NOT (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) AND CAST(contains(lower(text), ' the ') AS INT) + CAST(contains(lower(text), ' der ') AS INT) + CAST(contains(lower(text), ' les ') AS INT) + CAST(contains(lower(text), ' que ') AS INT) >= 2 AS is_article FROM documents""",
)
def article_text_test(spark, sf_dir):
    flags = D.article_test(F.col("text"), [" the ", " der ", " les ", " que "], ["license", "copyright"])
    return read(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in flags.items()))


@query(TABLE, r"""SELECT doc_id, CAST(CASE WHEN k > 0 THEN k - 1 ELSE length(text) END AS BIGINT) AS kept_chars FROM (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?m)^(?:Of|The|And)[ .]') THEN length(regexp_extract(text, '(?s)^(.{20,}?)(\n)(?:Of|The|And)[ .]', 1)) + 1 ELSE 0 END AS k0, CASE WHEN regexp_matches(text, '(?s)^.{20,}?\n(?:Of|The|And)[ .]') THEN length(regexp_extract(text, '(?s)^(.{20,}?)\n(?:Of|The|And)[ .]', 1)) + 1 ELSE 0 END AS k FROM documents)""")
def reference_section_cut(spark, sf_dir):
    kept = D.cut_at_heading(F.col("text"), "(?:Of|The|And)[ .]", 20)
    return read(spark, sf_dir, "documents").select("doc_id", F.length(kept).cast("long").alias("kept_chars"))


@query(TABLE, None)
def html_visible_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", D.visible_text(F.col("html")).alias("summary"))


@query(TABLE, r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS text FROM pages""")
def markup_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("text"))


@query(TABLE, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) >= 50, false) AS is_high FROM events")
def json_props_parse(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k >= 50, F.lit(False)).alias("is_high"))


@query(
    TABLE,
    """SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('document|' || doc_id || '|' || lower(source))) AS h FROM documents)""",
)
def uuid5_ids(spark, sf_dir):
    name = F.concat_ws("|", F.lit("document"), F.col("doc_id").cast("string"), F.lower("source"))
    return read(spark, sf_dir, "documents").select("doc_id", T.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", name).alias("uuid"))


@query(TABLE, """SELECT p_partkey, '("' || replace(p_name, ' ', '" OR "') || '") AND ("' || lower(p_type) || '") NOT ("' || lower(p_brand) || '")' AS q FROM part""")
def query_builder(spark, sf_dir):
    q = F.concat(T.or_query(F.split("p_name", " ")), F.lit(" AND "), T.or_query(F.array(F.lower("p_type"))), F.lit(" NOT "), T.or_query(F.array(F.lower("p_brand"))))
    return read(spark, sf_dir, "part").select("p_partkey", q.alias("q"))


@query(TABLE, r"""SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(regexp_replace(substr(s, 1, 77), '\s+\S*$', '')) || '...' END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS s FROM documents)""")
def truncate_word(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 80).alias("short"))


_WEIGHTS = [("license", 3), ("token", 2), ("the", 1), (r"[#$%&]{3}", -2)]
_SCORE_SQL = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN {w} ELSE 0 END" for p, w in _WEIGHTS)


@query(TABLE, f"SELECT lang, doc_id, score, rank FROM (SELECT lang, doc_id, score, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS INT) AS rank FROM (SELECT lang, doc_id, {_SCORE_SQL} AS score FROM documents)) WHERE rank <= 10")
def relevance_rank(spark, sf_dir):
    return D.ranked(read(spark, sf_dir, "documents"), F.lower("text"), _WEIGHTS, ["lang"], "doc_id", 10).select("lang", "doc_id", "score", "rank")


@query(TABLE, "SELECT doc_id, score FROM (SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'public') AS INT) + CAST(contains(lower(text), 'version') AS INT) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def corpus_search(spark, sf_dir):
    return D.term_search(read(spark, sf_dir, "documents"), F.lower("text"), ["license", "public", "version"], "doc_id", 50)


@query(TABLE, "SELECT p_partkey, a AS alias FROM part JOIN (VALUES ('red bolt'), ('ring'), ('small'), ('gear')) t(a) ON contains(' ' || lower(p_name) || ' ', ' ' || a || ' ')")
def alias_token_containment(spark, sf_dir):
    return D.token_aliases(read(spark, sf_dir, "part"), "p_name", ["red bolt", "ring", "small", "gear"]).select("p_partkey", "alias")


_RULES = [("^(red|blue)", "coloured"), ("bolt|gear", "hardware"), ("small|large", "sized"), ("ring$", "jewel")]


@query(TABLE, "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, '{p}') THEN '{v}'" for p, v in _RULES) + " ELSE 'other' END AS rule FROM part")
def regex_rule_table(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", joins.rule_table(F.col("p_name"), _RULES, "other").alias("rule"))


@query(TABLE, "SELECT doc_id, sha256(text) AS digest, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^[-]+|[-]+$', '', 'g') AS slug, lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || '_' || substr(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) AS file FROM documents")
def text_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), T.slugify(F.col("text")).alias("slug"), T.safe_file_name(F.col("text"), F.col("doc_id") % 1000).alias("file"))


@query(TABLE, "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CASE WHEN contains(url, '?') THEN 'query' WHEN url LIKE '%/' THEN 'folder' ELSE 'page' END AS kind, TRY_CAST(regexp_extract(url, '(\\d+)', 1) AS INT) AS number FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1)).alias("host"), F.when(url.contains("?"), "query").when(url.endswith("/"), "folder").otherwise("page").alias("kind"), F.regexp_extract(url, r"(\d+)", 1).try_cast("int").alias("number"))
