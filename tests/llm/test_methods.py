"""Operators against brute force, SQL or held-out rows, on the small tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm.common import Words
from lodestone.llm import cotraining, decontaminate, html, language, licences, mixing, order_minhash, queries, suffix, toxicity
from test_queries import TABLES, rows as comparable

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable(names, want.fetchall())


def brute_repeats(texts, width):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                keep[p : p + width] = False
            seen.add(b[p : p + width])
        out[i] = (len(b), int((~keep).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[keep].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("width", [40, 100, 255])
def test_suffix_random(spark, width, monkeypatch):
    rng = random.Random(width)
    blocks = ["".join(rng.choice("ab é\0") for _ in range(rng.choice([30, 90, 200, 400]))) for _ in range(12)]
    texts = {i: "".join(rng.choice(blocks) + "".join(rng.choice("xyz ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))) for i in range(150)}
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 20)  # many buckets: groups go on across their boundaries
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.dedup_repeats(df, width=width).collect()}
    assert got == brute_repeats(texts, width)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 3, (500, 19)).astype(np.uint8)
    order = suffix.multikey_quicksort(rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


def test_html_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{MORE}/pages.parquet").collect()}
    for r in queries.op3_html_extraction(spark, MORE).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(x)).strip() for x in re.split(r"(?:</?(?:p|b|br|h1)>)+", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_order_minhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    text = {r.doc_id: words(r.text) for r in docs.select("doc_id", "text").collect()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in text.items()}
    holders = {}
    for i, g in grams.items():
        for x in g:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for h in holders.values() if len(h) < 300 for p in itertools.combinations(h, 2))
    similar = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(grams[a]) + len(grams[b]) - n)]
    assert similar and all(got[a] == got[b] for a, b in similar)
    assert all(c <= i and got[c] == c for i, c in got.items())


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    pairs = []
    for _ in range(200):
        a = [rng.randrange(4) if rng.random() < 0.3 else rng.randrange(1000) for _ in range(rng.randrange(0, 120))]
        b = list(a)
        for _ in range(rng.randrange(0, 30)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(1000))
        pairs.append((np.array(a, np.uint32) * 2, np.array(b, np.uint32) * 2))
    for (a, b), s in zip(pairs, order_minhash.similarities(pairs), strict=True):
        true = 1 - edit_distance(list(a), list(b)) / max(len(a), len(b)) if max(len(a), len(b)) else 1.0
        assert (s >= 0) == (true >= 0.8 - 1e-9) and s <= true + 1e-9


@pytest.mark.parametrize("most", [0, order_minhash.EDGES])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(order_minhash, "EDGES", most)  # 0: links are contracted over all tasks
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]]
    root = {}
    for a, b in edges * 70:
        low = min(root.get(a, a), root.get(b, b))
        root[a] = root[b] = low
    got = order_minhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7))
    assert {r.id: r.label for r in got.collect()} == root


def test_viterbi():
    rng = np.random.default_rng(0)
    s = rng.normal(0, 3, (1500, 4)).astype(np.float32)
    first = np.array([0, 0, 3, 70, 200, 1500])
    got = language.viterbi(s, first, 6.0)
    value = lambda x, labels: x[np.arange(len(labels)), labels].sum() - 6.0 * (np.diff(labels) != 0).sum()
    for a, b in itertools.pairwise(first):
        if a == b:
            continue
        v, back = s[a].copy(), []
        for x in s[a + 1 : b]:
            top = v.argmax()
            stay = v >= v[top] - 6.0
            back.append(np.where(stay, np.arange(4), top))
            v = np.where(stay, v, v[top] - 6.0) + x
        assert abs(v.max() - value(s[a:b], got[a:b])) < 1e-2


def test_decoders_agree():
    rng = np.random.default_rng(5)
    count = [0, 1, 700, 3, 64, 65, 0, 129]
    first = np.concatenate([[0], np.cumsum(count)])
    for n in (2, 5, 40):
        s = np.where(rng.random((first[-1], n)) < 0.3, 0, -rng.random((first[-1], n)) * 12).astype(np.float32)
        def value(path):
            return s[np.arange(len(path)), path].sum() - 4 * sum((np.diff(path[a:b]) != 0).sum() for a, b in zip(first[:-1], first[1:], strict=True))
        got = [value(f(s, first, 4.0)) for f in (language._by_word, language._by_block, language.viterbi)]
        assert max(got) - min(got) < 1e-2


def test_many_languages_and_marks():
    texts = [" ".join(chr(97 + k % 26) * 3 + chr(97 + k // 26) * 2 for _ in range(50)) for k in range(300)]
    model = language.Model(texts, [f"l{k:03d}" for k in range(300)])
    assert len(model.langs) == 300 and model.table.nbytes <= language.MODEL
    w = language.Letters(pa.array(["हिन्दी भाषा", "\u0301\u0301 \u4dc0", "a\u0301b \u0301", "\ud7b0"]))
    assert w.n.tolist() == [2, 0, 1, 1] and w.size.tolist()[2] == 3


def test_language_held_out(spark):
    found = queries.op8_language(spark, MORE).join(spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    vocab = np.sort(rng.integers(0, 2**63, 5).astype(np.uint64))
    net = toxicity.Network(vocab, np.zeros(5), vocab, np.zeros(5))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, n, real = rng.integers(1, 6, (4, 3)), np.array([2] * 11 + [0]), np.ones((4, 3), bool)
    real[3, 2], ids[3, 2] = False, 0
    tri, at, y = rng.integers(0, 50, 22), np.cumsum(n) - n, np.array([1.0, 0, 1])

    def loss():
        c, some = np.zeros((12, toxicity.CHAR)), np.flatnonzero(n)
        c[some] = np.add.reduceat(net.p["char"][tri], at[some], axis=0) / n[some][:, None]
        x = np.concatenate([net.p["word"][ids], net.p["stem"][ids], c.reshape(4, 3, -1)], 2)
        s = np.concatenate([net.states(x @ net.p[f"x{k}"] + net.p[f"c{k}"], real, k) for k in "fb"], 2)
        q = toxicity.sigmoid(net.pooled(s, real)[2] @ net.p["out"] + net.p["bias"][0])
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()

    grads = net.gradients(ids, ids, tri, at, n, real, y, np.ones(3))
    for k, g in grads.items():
        i = (int(tri[0]), 1) if k == "char" else (int(ids[0, 0]), 1) if k in ("word", "stem") else tuple(rng.integers(0, d) for d in g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[i]) < 1e-4


def auc(good, bad):
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    p = queries.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(p[p.toxic == 1].score.values, p[p.toxic == 0].score.values) > 0.9


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    p = cotraining.classify(docs, cotraining.fit(docs, labels.where(~out))).join(labels.where(out), "doc_id").toPandas()
    assert auc(p[p.quality == 1].score.values, p[p.quality == 0].score.values) > 0.93


def test_licences_base(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    for r in licences.scan(spark.read.parquet(f"{MORE}/documents.parquet")).collect():
        w, places = docs[r.doc_id], []
        for p, label in licences.PHRASES.items():
            p = p.encode().split()
            places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_licence_spans(spark):
    full = licences.TEMPLATES[0][1]
    edited = full.replace("free of charge,", "free of any charge,").replace("publish, ", "")
    df = spark.createDataFrame([(1, f"intro words here {edited} and the end"), (2, " ".join(full.split()[:12])), (3, "no notice here at all")], "doc_id long, text string")
    got = {(r.id, r.label): r for r in licences.spans(df).collect()}
    assert set(got) == {(1, "mit")} and got[1, "mit"].start == 3 and got[1, "mit"].cover > 0.8


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert 0 < len(rows) <= len(docs) and len({r.doc_id for r in rows}) == len(rows)
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    for r in rows:
        w = words(r.text)
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        assert r.n_chars == len(r.text) and r.source == docs[r.doc_id].source


def test_order_minhash_completes_large_groups(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "WIDE", 80)  # several blocks a group; all pairs of different texts are aligned
    rng = random.Random(4)
    sections = [[f"s{k}w{rng.randrange(10**6)}" for _ in range(25)] for k in range(8)]
    ids, rows, want = rng.sample(range(1000), 300), [], []
    for _ in range(150):
        text = [w for s in rng.sample(range(8), 8) for w in sections[s]]
        near = list(text)
        for at in rng.sample(range(200), 7):
            near[at] = f"x{rng.randrange(10**6)}"
        want.append((ids.pop(), ids.pop()))
        rows += [(want[-1][0], " ".join(text)), (want[-1][1], " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert [p for p in want if got[p[0]] != got[p[1]]] == []


def test_order_minhash_sends_words_once_a_tile(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    texts = [[f"x{i}y{k}" if rng.random() < 0.13 else w for k, w in enumerate(base)][: rng.randrange(36, 41)] for i in range(80)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string").selectExpr("id", "text", "xxhash64(text) as key").cache()
    heads = docs.selectExpr("id as node", "id", "key")
    pairs = spark.createDataFrame(list(itertools.combinations(range(80), 2)), "a long, b long").repartition(3)
    sent, verified = spark.sparkContext.accumulator(0), order_minhash._verified

    def counted(least):
        def run(batches):
            def seen():
                for batch in batches:
                    sent.add(sum(len(c) - c.null_count for c in batch.columns if pa.types.is_binary(c.type)))
                    yield batch

            yield from verified(least)(seen())

        return run

    monkeypatch.setattr(order_minhash, "_verified", counted)
    for bucket in (order_minhash.BUCKET, 3000):  # as many buckets as there are tasks to keep busy; as their bytes ask for
        monkeypatch.setattr(order_minhash, "BUCKET", bucket)
        monkeypatch.setattr(order_minhash, "HELD", 50_000)
        got = {(r.a, r.b) for r in order_minhash._aligned(heads, docs, pairs, 0.8).collect()}
        close = {(a, b) for a, b in itertools.combinations(range(80), 2) if edit_distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9}
        assert got == close and 300 < len(close) < 2900
        assert 80 <= sent.value <= 80 * max(math.isqrt(6 * int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1, 80 * 40 * 8 // bucket + 1) < 3160  # not two for each of the 3160 pairs
        sent.value = 0


def test_order_minhash_outline_counts_both_ways():
    same = [f"w{k}" for k in range(75)]
    w = Words(pa.array([" ".join(same + [f"a{k}" for k in range(25)]), " ".join(same + [f"b{k}" for k in range(10)])], pa.string()))
    outline = order_minhash.outlines(w)  # 25 words of the longer lack in the other, 20 may
    assert order_minhash._far(outline[:1], outline[1:], w.n[:1], w.n[1:], 0.8)[0] < 0


def test_order_minhash_row_identity(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    rows = [(5, a), (5, b), (5, c + " tail"), (2, c), (None, a.upper()), (None, b + " more"), (None, "alone of its kind"), (None, None), (7, ""), (2, c)]
    got = order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want = [(5, 5, True), (5, 5, True), (5, 2, False), (2, 2, True), (None, 5, False), (None, 5, False), (None, None, True), (None, None, True), (7, 7, True), (2, 2, True)]
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_order_minhash_bounds_lose_nothing():
    rng = np.random.default_rng(3)
    for case in range(600):
        a = list(rng.integers(0, (60, 4000)[case % 2], rng.integers(1, 150)))
        b = [x for x in a if rng.random() > 0.08]
        if case % 3 == 0:  # a stretch stands elsewhere
            i, j = sorted(rng.integers(0, len(b) + 1, 2))
            moved, rest = b[i:j], b[:i] + b[j:]
            k = rng.integers(0, len(rest) + 1)
            b = rest[:k] + moved + rest[k:]
        for _ in range(rng.integers(0, 20)):
            b.insert(rng.integers(0, len(b) + 1), int(rng.integers(0, 60)))
        if not b:
            continue
        w = Words(pa.array([" ".join(f"w{x}" for x in t) for t in (a, b)], pa.string()))
        outline = order_minhash.outlines(w)
        far = order_minhash._far(outline[:1], outline[1:], w.n[:1], w.n[1:], 0.8)[0] < 0
        true = 1 - edit_distance(list(a), list(b)) / max(len(a), len(b))
        assert not (far and true >= 0.8)
    same = [f"w{x}" for x in rng.permutation(400)]
    w = Words(pa.array([" ".join(same), " ".join(same[200:] + same[:200])], pa.string()))
    outline = order_minhash.outlines(w)
    assert order_minhash._far(outline[:1], outline[1:], w.n[:1], w.n[1:], 0.8)[0] < 0  # the same words, halves exchanged


@pytest.mark.parametrize("rate", [0.1, 0.15, 0.2])
def test_order_minhash_recall_by_edit_similarity(spark, rate):
    rng = random.Random(6)
    rows = []
    for k in range(0, 200, 2):
        text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = list(text)
        for at in rng.sample(range(200), round(rate * 200)):
            near[at] = f"x{rng.randrange(10**6)}"
        rows += [(k, " ".join(text)), (k + 1, " ".join(near))]
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k + 1] == k for k in range(0, 200, 2)) >= 95


def test_mixed_shares_meet_targets(spark):
    counts = {("a", "de"): 200, ("a", "en"): 9800, ("b", "de"): 2000, ("b", "en"): 2000}
    kinds = [k for k, n in counts.items() for _ in range(n)]
    rows = [(None if i % 50 == 0 else i, f"some words here {i}", lang, source, 20) for i, (source, lang) in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.sample(docs, targets={"source": {"a": 0.8, "b": 0.2}, "lang": {"de": 0.2, "en": 0.8}}).collect()
    assert abs(sum(r.lang == "de" for r in got) / len(got) - 0.2) < 0.01
    assert abs(sum(r.source == "b" for r in got) / len(got) - 0.2) < 0.01
    assert abs(len(got) - 7000) < 200 and 100 < sum(r.doc_id is None for r in got) < 180


def test_cotraining_reaches_rare_sources(spark):
    rng = random.Random(3)
    good, bad = ["clear", "useful", "lesson", "study"], ["click", "buy", "spam", "cheap"]
    rows = []
    for k in range(12_000):
        of = good if k % 2 else bad
        rows.append((k, " ".join(rng.choice(of) for _ in range(30)), "en", "rare" if k in (7001, 7002) else "hot", 150))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    model = cotraining.fit(docs, labels)
    rare = docs.select(cotraining.meta_columns(docs, "doc_id", "text", "source", "lang", "n_chars")[0].alias("m"), "source").where("source = 'rare'").first().m
    assert model.views[1].weight[rare] != 0


@pytest.mark.parametrize("wrapper", ['<div class="has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="content-with-nav">', "<form>"])
def test_html_wrappers(wrapper):
    end = "</form>" if wrapper == "<form>" else "</div>"
    page = f'<body>{wrapper}<nav><a href="/">home</a></nav><article><div class="post-header"><h1>Title</h1></div><p>{"some words " * 30}</p></article><div class="cookie-box">We use cookies.</div>{end}</body>'
    got = html.main_text(page, [])
    assert got.startswith("Title\nsome words") and "cookies" not in got and "home" not in got


def test_html_templates_of_a_host(spark):
    body = "text of the page " * 20
    rows = [(k, "http://h/x", f'<body><div class="t{"abcde"[k % 5]}"><p>{body}</p></div></body>') for k in range(20)]
    got = html.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert len(got.paths) == 5


def test_proximity_with_several_documents_in_a_chunk(spark):
    rng = random.Random(8)
    item = "alpha beta gamma delta".split()
    texts = ["x y z beta q", "alpha beta gamma delta"] + [" ".join(rng.choice([*item, "u", "v"]) for _ in range(rng.randint(3, 9))) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, bench, n=4, slop=3).collect()}
    def near(w):
        at = {t: [i for i, x in enumerate(w) if x == t] for t in item}
        counts = Counter(x for t in texts for x in t.split())
        lead = min(range(4), key=lambda j: (counts[item[j]], j))
        return any(all(any(abs(p - (s - lead + j)) <= 3 for p in at[t]) for j, t in enumerate(item)) for s in at[item[lead]])
    assert got == {i: near(t.split()) for i, t in enumerate(texts)}


def test_first_pairs_tell_which_groups_are_not_completed():
    import pyarrow as pa

    from lodestone.llm import order_minhash

    batch = pa.record_batch([pa.array([1, 1, 1, 2, 2, 3, 3, 3]), pa.array([1, 2, 3, 4, 5, 1, 2, 3])], ["sketch", "id"])
    rows = [r for out in order_minhash._first_pairs([batch]) for r in out.to_pylist()]
    assert {(r["a"], r["b"]): r["last"] for r in rows if r["sketch"] is None} == {(1, 2): False, (1, 3): False, (4, 5): True}
    assert sorted((r["sketch"], r["a"]) for r in rows if r["sketch"] is not None) == [(1, 1), (1, 2), (1, 3), (3, 1), (3, 2), (3, 3)]
    spread = pa.record_batch([pa.array([7, 8]), pa.array([[1, 2], [3]]), pa.array([5, 6])], ["id", "sketches", "label"])
    assert [tuple(r.values()) for out in order_minhash._spread([spread]) for r in out.to_pylist()] == [(1, 7, 5), (2, 7, 5), (3, 8, 6)]
