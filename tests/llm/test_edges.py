"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import cotraining, decontaminate, html, language, licences, maxscore, mixing, order_minhash, queries, suffix, toxicity

DATA = "/root/testdata/sf0.001"
EXTRA = "id, text2, row, label, score, words, spans, y, meta, host, paths, weight, p, sampled, bucket, block, whole, sketches, z, n_bytes, wanted, grams, base, _id, _gone, _chosen, _lang, _y".split(", ")


def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def odd_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = " ".join(word() for _ in range(400))
    long = " ".join(word() for _ in range(60_000))
    texts = [None, "", "   ", "!!! 123", "a", "ÉÉ ß ﬁ 漢字 слово", prose, prose, prose + " tail", long, "x" * 300, "x" * 99, "the MIT License", None, "nul \x00 byte " * 12, "word " * 3000, "\n\n\t\n"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None if i % 3 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id here", None, None, None)]
    return [(*r, *["clash"] * len(EXTRA)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), docs_schema()).repartition(3).cache()


@pytest.fixture(scope="module")
def keyed(odd):
    return odd.where("doc_id is not null").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], docs_schema())


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, odd_rows()[6][1][:200]), (5, "ÉÉ ß"), (6, odd_rows()[6][1][:200])], "item_id long, text string")


def test_decontaminate(odd, none, bench):
    got = decontaminate.decontaminate(odd, bench).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and not by[0].contaminated and by[0].n_items == 0
    assert by[4].items == ["3"] and by[4].n_hit == 1
    assert {"4", "6"} <= set(by[6].items) and by[5].items == ["5"]
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0
    blocks = decontaminate.decontaminate(odd, bench, block=400).collect()
    assert sorted(map(repr, blocks)) == sorted(map(repr, got))
    near = decontaminate.decontaminate(odd, bench, slop=3).where("contaminated").count()
    assert near >= len([r for r in got if r.contaminated])


def test_suffix(keyed, none):
    rows = suffix.dedup_repeats(keyed, with_text=True, carry=["id", "text2", "row"]).collect()
    assert len(rows) == keyed.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_bytes == 0 and by[0].kept_text == "" and by[0].row == "clash"
    assert by[6].n_removed == 0 and by[7].n_removed == by[7].n_bytes and by[11].n_removed == 0
    assert by[10].n_removed > 0 and by[8].n_spans == 1
    assert suffix.dedup_repeats(none).count() == 0


def test_near_duplicates(odd, keyed, none):
    got = order_minhash.near_duplicates(keyed).collect()
    assert len(got) == keyed.count()
    by = {r.doc_id: r for r in got}
    assert by[7].class_id == by[8].class_id == 6 and by[0].class_id == 0 and by[13].class_id == 13 and by[2].class_id == 2
    assert by[9].kept and not by[7].kept
    assert order_minhash.near_duplicates(none).count() == 0


def test_language(odd, none):
    model = language.fit(odd)
    got = {r.doc_id: r for r in language.identify(odd, model, with_spans=True).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[3].lang_pred == "und" and got[0].score == 0
    assert got[6].lang_pred == "en" and 0 <= got[6].score <= 1
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none)).collect()} == {"und"}


def test_toxicity(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 1), (7, 1, 0), (8, None, None), (99, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    sample = toxicity.sample(odd, labels, "doc_id", "text", "toxic", F.lit(True))
    net = toxicity.fit(*sample)
    got = toxicity.score(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, net).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit([], [])).collect()} == {0.0}


def test_cotraining(odd, none, spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (8, None), (99, 1), (6, 0)], "doc_id long, quality int")
    got = cotraining.classify(odd, cotraining.fit(odd, labels)).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in cotraining.classify(odd, cotraining.fit(odd, labels.limit(0))).collect()} == {0.5}
    assert cotraining.classify(none, cotraining.fit(none, labels)).count() == 0


def test_mixing(odd, none):
    got = mixing.probabilities(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.p <= 1 for r in got)
    assert mixing.probabilities(none).count() == 0 and mixing.sample(none).count() == 0
    assert mixing.sample(odd, fraction=1e9).columns == odd.columns
    docs = odd.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.described(docs, topic=F.col("source")).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    assert cells.where("topic = source").count() == cells.count()
    cells = mixing.described(docs).groupBy(*mixing.MARGINS).agg(F.sum("tokens").alias("tokens"))
    assert mixing.margin_errors(mixing.raked(cells)).agg(F.max("error")).first()[0] < 1e-3


def test_licences(odd, none):
    got = {r.doc_id: r for r in licences.scan(odd).collect()}
    assert got[12].base_labels == "mit" and got[12].first_word == 1 and got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None
    assert licences.scan(none).count() == 0
    twice = odd.limit(1).sparkSession.createDataFrame([(1, "released under the MIT license"), (1, "nothing here at all"), (None, "released under the MIT license"), (None, None), (1, "released under the MIT license")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels, r.n_spans) for r in licences.scan(twice).collect()) == [("1", "", 0), ("1", "mit", 1), ("1", "mit", 1), ("None", "", 0), ("None", "mit", 1)]


def test_maxscore(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [-1.0, -0.5]), (7, [0.25]), (8, []), (1, [1.0, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string").repartition(3)
    got = maxscore.top_k(df.where("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, 50, 81920), (0, 4, 7, 16384), (0, 5, 8, 0)]
    assert maxscore.top_k(df.limit(0), df).count() == 0 and maxscore.top_k(df.where("vec_id = 0"), df.limit(0)).count() == 0


def test_maxscore_bounds():
    rng = np.random.default_rng(4)
    v = np.where(rng.random((2000, 40)) < 0.05, rng.integers(1, 500, (2000, 40)), 0)
    shard = maxscore.Shard(np.arange(2000), v)
    probed = []
    for q in v[:50]:
        true = np.sort(v @ q)[::-1]
        floor = true[5]
        rows, score = shard.search(q, -1, floor, 5)
        assert sorted(score[score >= floor]) == sorted(true[true >= floor])
        lists = shard.essential(q, floor)
        probed.append(1.0 if lists is None else len(shard.candidates(q, floor)) / 2000)
    assert np.mean(probed) < 0.25  # sparse vectors: most rows stand in no essential list
    for _ in range(200):  # any threshold, dense vectors, ties
        n, d = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        v, q = rng.integers(-4, 5, (n, d)), rng.integers(-4, 5, d)
        floor = float(rng.integers(-30, 30))
        score = v @ q
        rows, got = maxscore.Shard(np.arange(n), v).search(q, -1, floor, 3)
        assert set(np.flatnonzero(score >= floor)) <= set(rows.tolist()) and (got == score[rows]).all()


def test_maxscore_huge(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = maxscore.top_k(df.where("vec_id % 50 = 0"), df).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -(2**63))]


def test_html(spark):
    rows = [(1, "http://h/1", None), (2, None, ""), (3, "odd", "<p>a &amp; b<p>c  d"), (4, "http://h/2", "plain text"), (5, "http://h/3", "<div><script>x<p>y"), (6, "http://h/4", "<article><h1>T</h1><p>one</p><div class='comments'><p>no</p></div></article><footer>f</footer>"), (6, "http://h/4", "<article><p>one")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, id string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(df).collect()]
    assert sorted(got) == [(1, "", 0), (2, "", 0), (3, "a & b\nc d", 9), (4, "plain text", 10), (5, "", 0), (6, "T\none", 5), (6, "one", 3)]
    assert sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df, broadcast=0).collect()) == sorted(got)
    deep = "<div class='" + "x" * 300 + "'>"
    assert len({n.path for n in html.read(deep * 30 + "<p>t</p>")[1]}) == 32  # long paths stay different
    assert html.main_text("<article><p>one</p><p class='share-price'>two</p><p class='share'>no</p></article>", []) == "one\ntwo"
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert html.main_text(long, []).count("\n") == 49_999
    assert html.extract(df.limit(0)).count() == 0


def test_text_ids(spark):
    rng = random.Random(12)
    prose = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(50)) for _ in range(3)]
    rows = [("b", prose[0]), ("a", prose[0] + " tail"), ("c", prose[1]), (None, prose[2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id string, text string, lang string, source string, n_chars long")
    assert sorted((str(r.doc_id), str(r.class_id), r.kept) for r in order_minhash.near_duplicates(docs).collect()) == [("None", "None", True), ("a", "a", True), ("b", "a", False), ("c", "c", True)]
    removed = {r.doc_id: r.n_removed for r in suffix.dedup_repeats(docs).collect()}
    assert removed["a"] == 0 and removed["b"] == len(prose[0].encode()) and removed[None] == 0
    assert {r.doc_id for r in suffix.without_repeats(docs).collect()} == {"a", "c", None}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(1)).where("contaminated").collect()} <= {"a", "b"}
    labels = spark.createDataFrame([("a", 1, 0), ("b", 0, 1), ("c", 1, 0)], "doc_id string, quality int, toxic int")
    assert cotraining.classify(docs, cotraining.fit(docs, labels)).count() == 4
    assert toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, labels, "doc_id", "text", "toxic", F.lit(True)))).count() == 4
    vectors = spark.createDataFrame([("q", [1.0, 0.0]), ("x", [2.0, 0.0]), ("y", [2.0, 1.0])], "vec_id string, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in maxscore.top_k(vectors.where("vec_id = 'q'"), vectors).orderBy("rank").collect()] == [("q", "x", 131072), ("q", "y", 131072)]


def test_stages_judge_rows_by_their_own_text(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice("the of and to in is that for on with".split()) + f"{rng.randrange(10**4)}" for _ in range(80)) for _ in range(4)]
    item = " ".join(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").limit(1).collect())
    rows = [(None, prose[0]), (None, prose[0]), (1, prose[0]), (1, prose[1]), (1, prose[2]), (None, item), (1, item), (2, "12 34"), (None, "!!"), (None, prose[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted((str(r.doc_id), r.text) for r in stages[name](spark, docs, DATA).collect())
    assert left("language") == sorted((str(i), t) for i, t in rows if t not in ("12 34", "!!"))
    assert left("decontamination") == sorted((str(i), t) for i, t in rows if t != item)
    assert left("near_duplicates") == sorted([("1", t) for t in prose[:3]] + [("1", item), ("2", "12 34"), ("None", "!!"), ("None", prose[3])])
    assert [r.text for r in stages["near_duplicates"](spark, docs.where("text = '!!'").unionAll(docs.where("text = '!!'")), DATA).collect()] == ["!!"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, DATA)
    assert got.columns == odd.columns
    assert got.count() <= odd.count()
    assert stage(spark, none, DATA).count() == 0


def test_registered():
    assert list(queries.QUERIES) == [f"op{i}_{n}" for i, n in enumerate("decontamination suffix_dedup html_extraction quality_cotraining order_minhash toxicity mixing language maxscore licences conversation_repair byte_bpe collocations".split(), 1)]


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(600))
    a, b, c = text(), text(), text()
    for names in ({1: 1, 2: 2}, {1: "x", 2: "y"}):
        docs = spark.createDataFrame([(names[1], a), (names[2], a[:300] + b), (names[2], c), (names[2], c)], f"doc_id {'long' if names[1] == 1 else 'string'}, text string")
        got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix.dedup_repeats(docs).collect())
        assert got == [(names[1], 600, 0), (names[2], 600, 0), (names[2], 600, 0), (names[2], 900, 300)]
        left = dict(corpus_pipeline.STAGES)["repeats"](spark, docs, DATA).collect()
        assert sorted((str(r.doc_id), r.text) for r in left) == sorted([(str(names[1]), a), (str(names[2]), b), (str(names[2]), c), (str(names[2]), c)])


def test_languages_beyond_the_model(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    monkeypatch.setattr(language, "SAMPLES", 30)
    docs = spark.createDataFrame([(i, f"wort{i % 7} sprache und rede", f"l{min(i % 40, 9)}") for i in range(400)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.langs == ["l0", "l1", "l9"]


_STORY = " ".join(f"Sentence number {i} says something about the matter at hand." for i in range(12))
_ARTICLE = f"<h1>Title here</h1><p>{_STORY[:300]}</p><p>{_STORY[300:]}</p>"
_READERS = "".join(f"<div class='comment'><p>Reader {i} thinks that this is all quite wrong and says so at length.</p></div>" for i in range(40))


@pytest.mark.parametrize("outer", ['<div class="widget">', '<div id="search">', '<section class="content related">', '<div class="modal">', '<div class="post share">', '<div role="dialog">', '<div id="comments">', '<div class="notice">', '<div class="main reply">', '<div class="search"><div class="widget">'])
def test_articles_in_elements_with_names_of_noise(outer):
    want = "Title here\n" + _STORY[:300].strip() + "\n" + _STORY[300:].strip()
    assert html.main_text(f"<body>{outer}{_ARTICLE}</div>", []) == want
    assert html.main_text(f"<body><nav><a href=x>Home</a></nav>{outer}{_ARTICLE}</div><footer>Small print</footer>", []) == want


def test_noise_beside_articles():
    got = html.main_text(f"<body><div class='layout has-sidebar'><div class='text'>{_ARTICLE}</div></div><div id='comments'>{_READERS}</div>", [])
    assert "Sentence number 11" in got and "Reader" not in got
    section = "<section class='related-work'><h2>Related work</h2><p>One sentence about that thing and its use in practice today.</p><p>A second one says the same about another thing in many other words.</p><p>The third one.</p></section>"
    got = html.main_text(f"<body><article>{_ARTICLE}{section}<div class='share'>Share this</div><div class='ad-slot'>Buy now</div></article><div id='comments'>{_READERS}</div>", [])
    assert "The third one." in got and "Share" not in got and "Buy" not in got and "Reader" not in got
    short = "<div class='x'><p>A short article of one sentence, no more than that.</p></div>"
    assert html.main_text(f"<body>{short}<div id='comments'>{_READERS}</div><div class='cookie'><p>We use cookies. {_STORY[:240]}</p></div>", []) == "A short article of one sentence, no more than that."
