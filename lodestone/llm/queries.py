"""The registered queries of this subpackage, each an operator on its whole table, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, collocations, conversations, cotraining, decontaminate, html, language, licences, maxscore, mixing, order_minhash, suffix, toxicity
from .common import table


def remainder(id_col: str, n: int):
    """crc32 of the id's text, modulo ``n``: the folds of the contracts."""
    return F.crc32(F.col(id_col).cast("string")) % n


def held_out(id_col: str, n: int, fold: int):
    """Whether a row is in the fold that nothing is learned from; a row without an id is never learned from."""
    return F.coalesce(remainder(id_col, n) == fold, F.lit(True)).alias("held_out")


#: Words by which a word of a near match may stand from its place.
NEAR = 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=NEAR)
    return found.drop("items", "near", "key")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_repeats(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return cotraining.classify(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = toxicity.sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(*sample))
    return scored.select("doc_id", held_out("doc_id", 5, 0), "score", "predicted")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.probabilities(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "tokens", *(F.round(c, 6).alias(c) for c in ("weight", "p", "repeat")), "sampled")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, learn=remainder("doc_id", 4) != 2), with_spans=True)
    return found.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score", "spans")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(rows.where("vec_id % 50 = 0"), rows)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(turns), turns.select("conv_id"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_html_extraction, op4_quality_cotraining, op5_order_minhash, op6_toxicity, op7_mixing, op8_language, op9_maxscore, op10_licences, op11_conversation_repair, op12_byte_bpe, op13_collocations)}

#: Words as the contracts define them.
_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
post AS (SELECT doc_id, w[i + 1] AS t, i AS p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
need AS (SELECT row_number() OVER (ORDER BY item_id, g) AS win, item_id, n, g FROM win),
terms AS (SELECT win, item_id, n, j, g[j + 1] AS t FROM (SELECT *, unnest(range(0, n)) AS j FROM need)),
freq AS (SELECT t, count(*) AS c FROM post WHERE t IN (SELECT t FROM terms) GROUP BY t),
lead AS (SELECT win, item_id, n, j, t FROM (SELECT terms.*, row_number() OVER (PARTITION BY win ORDER BY coalesce(c, 0), j) AS k FROM terms LEFT JOIN freq USING (t)) WHERE k = 1),
tries AS (SELECT win, item_id, n, doc_id, p - j AS s, j AS own FROM lead JOIN post USING (t)),
met AS (SELECT DISTINCT x.win, x.item_id, x.n, x.doc_id, x.s, terms.j FROM tries x JOIN terms ON terms.win = x.win JOIN post ON post.doc_id = x.doc_id AND post.t = terms.t AND post.p BETWEEN x.s + terms.j - {NEAR} AND x.s + terms.j + {NEAR}),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT win, item_id, doc_id, s FROM met GROUP BY win, item_id, n, doc_id, s HAVING count(*) = n) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
isl AS (SELECT doc_id, i, sum(CASE WHEN i - p <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM dup)),
runs AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS b FROM isl GROUP BY doc_id, r),
kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t, b FROM runs),
ends AS (SELECT doc_id, sum(b - t) AS n_removed, count(*) AS n_spans, max(b) AS last FROM kept GROUP BY doc_id),
pieces AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY t) AS x FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN ends USING (doc_id) LEFT JOIN pieces USING (doc_id)
"""

_OP9 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP11 = r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fold FROM src, tab),
dam AS (SELECT conv_id, turn, CASE fold WHEN 4 THEN 'user' ELSE role END AS role, CASE fold WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fold WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE fold <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM dam),
flt AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM num),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (i > 1 AND b || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM flt GROUP BY conv_id),
dp AS (
SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS v0, {'c': 1000000000::BIGINT, 'a': ''} AS v1, {'c': 1000000000::BIGINT, 'a': ''} AS v2, {'c': 1000000000::BIGINT, 'a': ''} AS v3 FROM cnt
UNION ALL
SELECT conv_id, i, {'c': v0.c + 2, 'a': v0.a || 'D'},
 CASE WHEN r = 's' AND f IN (0, 3) THEN least({'c': v1.c + 2, 'a': v1.a || 'D'}, {'c': v0.c + t, 'a': v0.a || 'K'}) ELSE {'c': v1.c + 2, 'a': v1.a || 'D'} END,
 CASE WHEN f IN (0, 3) THEN least({'c': u.c + 2, 'a': u.a || 'D'}, {'c': v0.c + t + ru, 'a': v0.a || eu}, {'c': v1.c + t + ru, 'a': v1.a || eu}, {'c': w.c + t + ru, 'a': w.a || eu}) ELSE {'c': u.c + 2, 'a': u.a || 'D'} END,
 CASE WHEN f IN (0, 3) THEN least({'c': w.c + 2, 'a': w.a || 'D'}, {'c': u.c + t + ra, 'a': u.a || ea}) ELSE {'c': w.c + 2, 'a': w.a || 'D'} END
FROM (SELECT *, least(v3, {'c': u.c + 5, 'a': u.a || 'I'}) AS w FROM (SELECT dp.conv_id, flt.i, v0, v1, v3, flt.f, flt.r, CASE flt.f WHEN 3 THEN 5 ELSE 0 END AS t, CASE flt.r WHEN 'u' THEN 0 ELSE 1 END AS ru, CASE flt.r WHEN 'u' THEN 'K' ELSE 'R' END AS eu, CASE flt.r WHEN 'a' THEN 0 ELSE 1 END AS ra, CASE flt.r WHEN 'a' THEN 'K' ELSE 'R' END AS ea,
 least(v2, {'c': v0.c + 5, 'a': v0.a || 'I'}, {'c': v1.c + 5, 'a': v1.a || 'I'}, {'c': v3.c + 5, 'a': v3.a || 'I'}) AS u FROM dp JOIN flt ON flt.conv_id IS NOT DISTINCT FROM dp.conv_id AND flt.i = dp.i + 1))),
best AS (SELECT conv_id, least(v0, v3, {'c': v2.c + 5, 'a': v2.a || 'I'}, {'c': v1.c + 10, 'a': v1.a || 'II'}) AS v FROM (SELECT dp.conv_id, i, n, v0, v1, v2, v3 FROM dp JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM dp.conv_id) WHERE i = n),
eds AS (SELECT conv_id, j, v.a[j] AS e, count(*) FILTER (v.a[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, count(*) FILTER (v.a[j] <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m FROM (SELECT *, unnest(range(1, len(v.a) + 1)) AS j FROM best)),
tur AS (SELECT eds.conv_id, j, e, m, role, text, r, max(CASE WHEN m = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY eds.conv_id) AS s FROM eds LEFT JOIN flt ON e <> 'I' AND flt.conv_id IS NOT DISTINCT FROM eds.conv_id AND flt.i = eds.i WHERE e <> 'D'),
rep AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (m - 1 - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS x FROM tur GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v.c, 0) AS BIGINT) AS cost, coalesce(v.a, '') AS audit, sha256(coalesce(x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM a.conv_id
"""

_OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^ \t]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t)),
g AS (SELECT lang, list_slice(w, i, i + m - 1) AS w, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 5) AS s(m) WHERE len(w) >= m) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE len(w) = 1 GROUP BY lang),
c AS (SELECT lang, w, f AS a FROM g WHERE len(w) > 1 AND f >= 30),
k AS (SELECT lang, w, a, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT k.lang, k.w, k.a, k.k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * k.a // (x.f + y.f) AS BIGINT) AS score FROM k JOIN g x ON x.lang = k.lang AND x.w = k.w[1 : k.k] JOIN g y ON y.lang = k.lang AND y.w = k.w[k.k + 1 :]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS i FROM s) WHERE i = 1),
inner_ AS (SELECT lang, list_slice(w, i, i + m - 1) AS w, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, len(w) - m + 2)) AS i FROM c, range(2, 4) AS z(m) WHERE len(w) > m) GROUP BY ALL),
free AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.w = b.w WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def _op7() -> str:
    """The raking written out, one step after another."""
    marks = " ".join(f"WHEN contains(text, '{m}') THEN '{n}'" for n, m in mixing.TOPICS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CASE WHEN text IS NULL OR text = '' THEN 'empty' {marks} WHEN length(text) > {mixing.LONG} THEN 'long' ELSE 'prose' END AS topic,
CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')) AS BIGINT) AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t, 1.0::DOUBLE AS w FROM d GROUP BY ALL)",
        "total AS (SELECT sum(t) AS total FROM c)",
    ]
    for m in mixing.MARGINS:
        steps.append(f"to_{m} AS (SELECT {m}, pow(t, {mixing.TARGETS[m]}) / sum(pow(t, {mixing.TARGETS[m]})) OVER () AS share FROM (SELECT {m}, sum(t) AS t FROM c GROUP BY {m}))")
    last = "c"
    for k in range(mixing.ROUNDS):
        for m in mixing.MARGINS:
            steps.append(f"r{k}_{m} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, t, CASE WHEN now > 0 THEN w * share * total / now ELSE w END AS w FROM (SELECT *, sum(w * t) OVER (PARTITION BY {m}) AS now FROM {last}) x JOIN to_{m} y ON x.{m} = y.{m}, total)")
            last = f"r{k}_{m}"
    return f"""WITH {", ".join(steps)}
SELECT doc_id, source, lang, topic, tokens, round(w, 6) AS weight, round(least(1.0, w * {mixing.FRACTION}), 6) AS p, round(CASE WHEN w > 0 THEN w * {mixing.FRACTION} / least(1.0, w * {mixing.FRACTION}) ELSE 0 END, 6) AS repeat,
CAST(('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0 < least(1.0, w * {mixing.FRACTION}) AS sampled FROM d JOIN {last} USING (source, lang, topic)"""


ORACLE = {"op1_decontamination": _OP1, "op2_suffix_dedup": _OP2, "op7_mixing": _op7(), "op9_maxscore": _OP9, "op11_conversation_repair": _OP11, "op13_collocations": _OP13}
