"""Conversation repair, byte-level BPE and collocations against brute force, SQL and the tokenizer's own library."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import bpe, collocations, conversations, queries
from lodestone.llm.common import table

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASH = "conv, key, times, piece, body, first, part, size, phrase, h, n, id, ids, n_tokens, level, a, w, fold, copy".split(", ")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    table(spark, SMALL, "documents")


# Conversations


def random_turns(seed, long=3000):
    rng, rows = random.Random(seed), []
    words = [None, "", " \t", "Hello.", "Hi", "ok?", "no\n", "É!", "a.b", "x", *(f"t{k}." for k in range(60))]
    for c in [None, *range(40)]:
        n = long if c == 7 else rng.choice([1, 2, 3, 5, 8, 20])
        for k in range(n):
            turn = None if rng.random() < 0.05 else k if rng.random() < 0.9 else rng.randrange(n)
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ux"]), rng.choice(words)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_sql(spark, seed):
    rows = random_turns(seed)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    con = duckdb.connect()
    con.register("conversations", pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": [r[2] for r in rows], "text": [r[3] for r in rows]}))
    want = con.execute(queries.ORACLE["op11_conversation_repair"])
    names = [d[0] for d in want.description]
    got = conversations.repair(conversations.damaged(turns), turns.select("conv_id")).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def brute_repair(turns):
    """All edits with at most two insertions at a place, of up to four turns (class, state)."""
    best = None
    for edits in itertools.product("KRD", repeat=len(turns)):
        if any(e != "D" and s == conversations.GONE for e, (_, s) in zip(edits, turns)):
            continue
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""]))
            cost, given, at = 0, [], 0
            for e in audit:
                if e == "I":
                    cost, given = cost + 5, [*given, "?"]
                    continue
                kind, state = turns[at]
                at += 1
                cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and state == conversations.CUT_OFF)
                if e != "D":
                    given.append("suax"[kind] if e == "K" else "?")
            system = given[:1] == ["s"]
            want = ["s"] * system + ["ua"[k % 2] for k in range(len(given) - system)]
            legal = not given or (len(given) - system) % 2 == 0 and len(given) > system and all(g in ("?", w) for g, w in zip(given, want))
            if legal and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_chart_against_all_edits():
    rng = random.Random(4)
    for _ in range(120):
        turns = [(rng.randrange(4), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(4))]
        assert conversations.finish(conversations.parse([(*t, 1) for t in turns], conversations.BEGIN)) == brute_repair(turns)


def test_stretches_join_to_the_whole(monkeypatch):
    rng = random.Random(8)
    for block in (1, 3, 256):
        monkeypatch.setattr(conversations, "BLOCK", block)
        for _ in range(60):
            turns = [(rng.randrange(4), rng.choice([0, 0, 1, 2]), rng.choice([1, 1, 3])) for _ in range(rng.randrange(1, 30))]
            at = rng.randrange(len(turns) + 1)
            tables = [[(x, y, *v) for x in range(4) for y, v in conversations.parse(part, x).items()] for part in (turns[:at], turns[at:])]
            done = {conversations.BEGIN: (0, "")}
            for t in tables:
                done = conversations.joined(done, t)
            one = [(k, s if not i else conversations.GONE, 1) for k, s, n in turns for i in range(n)]
            assert conversations.finish(done) == conversations.finish(conversations.parse(one, conversations.BEGIN))


def test_repair_cases(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "A" * 300_000 + "."), (3, 5, "tool", "x"), (4, None, None, None), (5, 9, "user", "same."), (5, 9, "user", "same."), (5, 10, "assistant", "so.")]
    turns = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in CLASH))
    ids = spark.createDataFrame([(k,) for k in range(1, 7)], "conv_id long")
    got = {r.conv_id: r for r in conversations.repair(turns, ids, output="text").collect()}
    assert got[1].audit == "KKK" and got[1].repaired == "system:Be kind.\nuser:Hi!\nassistant:Yes." and got[1].cost == 0
    assert got[2].audit == "D" and got[2].repaired == "" and got[3].truncated == 1 and got[3].audit == "D"
    assert got[4].blank == 1 and got[4].gaps == 0 and got[5].duplicate == 1 and got[5].audit == "KDK"
    assert got[6].audit == "" and got[6].cost == 0 and got[6].repaired == ""
    turns_out = conversations.repair(turns, output="turns").orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.role, r.text) for r in turns_out] == [(1, "system", "Be kind."), (1, "user", "Hi!"), (1, "assistant", "Yes."), (5, "user", "same."), (5, "assistant", "so.")]
    digest = {r.conv_id: r.repaired_sha256 for r in conversations.repair(turns, ids).collect()}
    assert digest == {k: hashlib.sha256(r.repaired.encode()).hexdigest() for k, r in got.items()}
    assert conversations.repair(turns.limit(0)).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=1500):
    rng = random.Random(3)
    alphabet = "aabcstrevelmdLS'''  \n\t\r!?.12é漢字 　\x85\x1c٣\U0001f600ß\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [*texts, None, "", "a" * 5000, "ab" * 3000, " " * 3000, "\n" * 2000 + "x", "é" * 999, "'" * 50 + "s", "don't we'll I'm they've d'accord 's's'll'llx", "漢字" * 4000, texts[0], texts[0]]


@pytest.mark.parametrize("known, block", [(1 << 18, 1 << 21), (40, 300), (0, 64)])
def test_encode_against_the_library(spark, ranks, library, monkeypatch, known, block):
    texts = odd_texts()
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe.blocks, "__defaults__", (block,))
    docs = spark.createDataFrame([(i, t, *["clash"] * len(CLASH)) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3)
    got = bpe.decode(bpe.encode(docs, ranks, known=known), ranks).collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode() and r.n_tokens == len(r.ids) // 4


def test_replay_with_lower_ranks_later():
    """Merges that make a pair of a lower rank than their own: the piece is finished by itself."""
    rng = random.Random(2)
    for _ in range(40):
        ranks = {bytes([b]): b for b in range(256)}
        made = [b"a", b"b", b"c"]
        for _ in range(12):
            made.append(rng.choice(made) + rng.choice(made))
        for k, t in enumerate(rng.sample(list(dict.fromkeys(t for t in made if len(t) > 1)), k=len({t for t in made if len(t) > 1}))):
            ranks[t] = 300 + k
        want = tiktoken.Encoding("o", pat_str="[abc]+", mergeable_ranks=ranks, special_tokens={})
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
        got = bpe.Merges(ranks).replay([p.encode() for p in pieces])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [want.encode_ordinary(p) for p in pieces]


def test_bpe_query(spark, ranks, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_byte_bpe(spark, SMALL).collect()
    want = {i: library.encode_ordinary(t) for i, t in texts.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {(i, len(want[i]), sha(np.array(want[i], "<u4").tobytes()), sha(t.encode())) for i, t in texts.items()}
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.encode(docs, ranks).count() == 0
    bad = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "ids binary")
    with pytest.raises(Exception, match="no token"):
        bpe.decode(bad, ranks).collect()


# Collocations


def brute_phrases(rows, least, covered, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und", tuple(w[i : i + m])] += 1
    out = []
    some = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in some.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= covered * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in some.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(own[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("shard, bits", [(1 << 22, 1 << 26), (60, 1 << 6)])
def test_collocations_against_brute_force(spark, monkeypatch, shard, bits):
    rng = random.Random(shard)
    monkeypatch.setattr(collocations.shards, "__defaults__", (shard,))
    monkeypatch.setattr(collocations._bitmap, "__defaults__", (bits,))  # 64 bits let nearly all pass
    words = ["de", "en", "the", "New", "york", "É", "漢字", "a b", "%", "x\x1cy"]
    sep = [" ", " ", " ", "\t", "  ", ". ", "\n", ", "]
    rows = [(rng.choice(["en", "de", None, "da", "tiny"]), "".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(80)))) for _ in range(90)]
    rows += [("en", None), ("en", ""), (None, " \t.\n"), ("en", "big apple " * 3000), ("de", "solo")]
    docs = spark.createDataFrame([(*r, *["clash"] * len(CLASH)) for r in rows], "lang string, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(4)
    got = collocations.collocations(docs, least=3, top=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 3, 80, 25)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_sql_on_more_rows(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MORE}/documents.parquet'")
    want = con.execute(queries.ORACLE["op13_collocations"])
    names = [d[0] for d in want.description]
    got = queries.op13_collocations(spark, MORE).select(*names).collect()
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(want.fetchall())


def test_suffix_array():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 4, 7):
        ids, last = rng.integers(0, 4, 300), rng.random(300) < 0.1
        last[-1] = True
        left = collocations._left(last)
        order, common = collocations.suffixes(ids, left, depth)
        ends = [min(i + left[i], i + depth) for i in range(300)]
        keys = [tuple(ids[i : ends[i]]) for i in order]
        assert keys == sorted(keys)
        for k in range(1, 300):
            same = [x == y for x, y in zip(keys[k - 1], keys[k])]
            assert common[k] == (same.index(False) if False in same else len(same))


def test_bpe_remembers_a_bounded_number_of_pairs(monkeypatch):
    from lodestone.llm import bpe

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257, b"abcd": 258, b"ef": 259}
    pieces = [b"abcdef", b"xabyz", b"cdcdab", bytes(range(97, 123))]
    want = bpe.Merges(ranks).replay(pieces)
    monkeypatch.setattr(bpe, "PAIRS", 4)
    merges = bpe.Merges(ranks)
    assert merges.replay(pieces) == want and len(merges.pair) <= 4
