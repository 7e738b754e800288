"""Language identification of mixed-language text.

Words are runs of letters and of the marks on them. The script of a word's first letter (code-point ranges) leaves the languages that were
seen to use the script; character 2-, 3- and 4-grams and the word itself, counted by language in a bounded
sample of labelled documents and smoothed, score each word for each candidate. Viterbi decoding with a penalty for a
change of language labels every word of the whole text; the document's language is the one with most letters.

With up to ``PAIRED`` languages decoding runs over blocks of words at once, as many as ``WORK`` bytes hold: each block gives
the best score from any entry language to any exit language, the blocks of a document are chained, and the paths are
traced back in all blocks together. With more languages all documents of a chunk are decoded word by word, with one
state per language and one switch per word, so that memory grows with the languages and not with their square. The
``LANGUAGES`` most frequent values of the language column are learned (the rest of a column with more is taken for dirt),
and the tables of n-grams shrink so that the model takes ``MODEL`` bytes at most.

Cases: a null text, or one without letters, is ``und`` with score 0; texts of no known language get the language that
was most frequent, with score 0; ties go to the smaller language name; repeated rows, rows without an id and rows that
share an id each get their row; very long texts are decoded whole; with no labelled row every text is ``und``; an empty
table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, chunks, cut, mix, utf8

#: Labelled documents of each language that the model is fitted on, at most, and of all languages; languages, at most.
SAMPLE, SAMPLES, LANGUAGES = 1_000, 64_000, 4_096
#: Bytes of the model; languages that are decoded in blocks, and bytes of their tables at a time.
MODEL, PAIRED, WORK = 256 << 20, 32, 32 << 20
#: Nats that a change of language costs; buckets of each table; most nats that a word can weigh.
PENALTY, BITS, CLIP = 10.0, 17, 12.0
BLOCK = 64
CHUNK = 1 << 19

#: Code-point ranges of scripts (fixed values); other letters have a script of their own.
SCRIPTS = [
    (0x41, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "armenian"), (0x590, 0x5FF, "hebrew"), (0x600, 0x77F, "arabic"),
    (0x8A0, 0x8FF, "arabic"), (0x900, 0x97F, "devanagari"), (0x980, 0x9FF, "bengali"), (0xB80, 0xBFF, "tamil"), (0xC00, 0xC7F, "telugu"), (0xE00, 0xE7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0x20000, 0x3134F, "han"),
]
NAMES = ["other", *dict.fromkeys(s for _, _, s in SCRIPTS)]


MARK = 255


@functools.cache
def letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, ``MARK`` if it is a mark, else 1 + the number of its script."""
    kind = {"L": 1, "M": MARK}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)
    for lo, hi, name in SCRIPTS:
        at = out[lo : hi + 1]
        at[at == 1] = 1 + NAMES.index(name)
    return out


class Letters:
    """The words of a chunk: runs of letters of lower-cased text, with their n-gram buckets."""

    def __init__(self, column, bits: int = BITS):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        low = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
        data, off = utf8(low)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = np.zeros(len(data) + 3, np.uint32)
        b[: len(data)] = data
        b0, b1, b2, b3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
        c = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
        script = letters()[np.minimum(c, 0x10FFFF)]
        off = np.searchsorted(at, off)
        is_letter = script > 0
        n = len(c)
        if (script == MARK).any():  # marks that no letter of the text stands before are none
            place = np.arange(n)
            begin = np.zeros(n, np.int64)
            begin[off[:-1][off[:-1] < n]] = off[:-1][off[:-1] < n]
            begin = np.maximum.accumulate(np.maximum(begin, np.where(script == 0, place + 1, 0)))
            seen = np.maximum.accumulate(np.where(is_letter & (script != MARK), place, -1))
            is_letter &= seen >= begin
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = is_letter[:-1], is_letter[1:]
            before[off[:-1][off[:-1] < n]] = False
            after[off[1:][off[1:] > 0] - 1] = False
        start = np.flatnonzero(is_letter & ~before)
        end = np.flatnonzero(is_letter & ~after) + 1
        self.first = np.searchsorted(start, off)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.size = end - start
        self.script = script[start].astype(np.int64) - 1 if len(start) else np.zeros(0, np.int64)
        c = c[is_letter].astype(U64)
        self.at = np.cumsum(self.size) - self.size  # of each word in the letters
        place = np.arange(len(c)) - np.repeat(self.at, self.size)
        grams, h = [], c + U64(1)
        for back in range(1, 4):
            past = np.zeros(len(c), U64)
            past[back:] = c[:-back] + U64(1)
            past[place < back] = U64(0)
            h = h * U64(0x9E3779B97F4A7C15) + past
            grams.append((mix(h + U64(back)) >> U64(64 - bits)).astype(np.int64))
        self.grams = grams
        if len(c):
            word = np.add.reduceat(mix(c * U64(0xD6E8FEB86659FD93) + place.astype(U64)), self.at)
        else:
            word = np.zeros(0, U64)
        self.word = (mix(word) >> U64(64 - bits)).astype(np.int64)


class Model:
    """Log probabilities by language of n-gram and word buckets, relative to their mean over languages."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        n = len(self.langs)
        self.bits = max(BITS - max(0, (16 * n << BITS) // MODEL).bit_length(), 12)
        if 16 * n << self.bits > MODEL:
            raise ValueError(f"{n} languages are more than a model of {MODEL} bytes can hold")
        number = {x: k for k, x in enumerate(self.langs)}
        of = np.array([number[x] for x in langs], np.int64)
        counts = np.zeros((4, 1 << self.bits, n), np.float32)
        scripts = np.zeros((len(NAMES), n))
        weight = np.zeros(n)
        for a in range(0, len(texts), 100):
            w = Letters(pa.array(texts[a : a + 100], pa.string()), self.bits)
            lang = of[a : a + 100][w.doc]
            per = np.repeat(lang, w.size)
            for k, (g, own) in enumerate([*((g, per) for g in w.grams), (w.word, lang)]):
                counts[k] += np.bincount(g * n + own, minlength=n << self.bits).reshape(-1, n).astype(np.float32)
            scripts += np.bincount(w.script * n + lang, minlength=len(NAMES) * n).reshape(-1, n)
            weight += np.bincount(lang, minlength=n)
        total = counts.sum(1, keepdims=True)
        p = np.log((counts + np.float32(0.3)) / (total + np.float32(0.3 * 2**12)))
        self.table = p - p.mean(2, keepdims=True) if n else p
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        self.uses = share >= 0.02  # scripts of a language
        self.known = self.uses.any(1)
        self.frequent = int(weight.argmax()) if n else 0

    def scores(self, w: Letters) -> np.ndarray:
        """Nats for each word and language; languages that do not use the word's script are far behind."""
        n = len(self.langs)
        out = np.zeros((len(w.size), n), np.float32)
        if not len(w.size):
            return out
        for k, g in enumerate(w.grams):
            out += np.add.reduceat(self.table[k][g], w.at, axis=0)
        out = out / 3 + self.table[3][w.word]
        out = np.maximum(out - out.max(1, keepdims=True), -CLIP)
        out[~self.uses[w.script] & self.known[w.script][:, None]] = -2 * CLIP
        out[~self.known[w.script]] = 0.0
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; first: where each document's words begin, and one more."""
    n_words, n = scores.shape
    if not n_words or n == 1:
        return np.zeros(n_words, np.int64)
    if n > PAIRED:
        return _by_word(scores, first, penalty)
    out = np.zeros(n_words, np.int64)
    blocks = np.cumsum(-(-np.diff(first) // BLOCK))
    most = max(1, WORK // (BLOCK * (n * n + 2 * n) + 4 * n * n))
    a = 0
    while a < len(first) - 1:  # documents whose blocks the working memory holds, one at least
        b = max(a + 1, int(np.searchsorted(blocks, (blocks[a - 1] if a else 0) + most, "right")))
        if blocks[b - 1] - (blocks[a - 1] if a else 0) > most:
            out[first[a] : first[b]] = _by_word(scores[first[a] : first[b]], first[a : b + 1] - first[a], penalty)
        else:
            out[first[a] : first[b]] = _by_block(scores[first[a] : first[b]], first[a : b + 1] - first[a], penalty)
        a = b
    return out


def _by_word(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """All documents in step, one word at a time; for each word and language one bit, and the language of a switch."""
    count = np.diff(first)
    docs = np.argsort(-count, kind="stable")
    docs = docs[count[docs] > 0]
    n_words, n = scores.shape
    active = np.searchsorted(-count[docs], -np.arange(int(count.max(initial=0))), "left")
    stay, source = np.zeros((n_words, n), bool), np.zeros(n_words, np.int64)
    at = first[:-1][docs]
    v = scores[at].copy()
    for t in range(1, len(active)):
        on = int(active[t])
        now, row = v[:on], at[:on] + t
        top = now.argmax(1)
        change = now[np.arange(on), top] - np.float32(penalty)
        keep = now >= change[:, None]
        stay[row], source[row] = keep, top
        v[:on] = np.where(keep, now, change[:, None]) + scores[row]
    state = v.argmax(1)
    out = np.zeros(n_words, np.int64)
    for t in range(len(active) - 1, -1, -1):
        on = int(active[t])
        row = at[:on] + t
        out[row] = state[:on]
        if t:
            state[:on] = np.where(stay[row, state[:on]], state[:on], source[row])
    return out


def _by_block(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    count = np.diff(first)
    n_words, n = scores.shape
    if not n_words:
        return np.zeros(0, np.int64)
    n_blocks = -(-count // BLOCK)
    begin = np.concatenate([[0], np.cumsum(n_blocks)])
    doc = np.repeat(np.arange(len(count)), n_blocks)
    at = first[:-1][doc] + (np.arange(len(doc)) - begin[:-1][doc]) * BLOCK
    size = np.minimum(first[1:][doc] - at, BLOCK)
    far = np.float32(-1e9)
    m = np.where(np.eye(n, dtype=bool), np.float32(0), far)[None].repeat(len(at), 0)
    stay = np.zeros((BLOCK, len(at), n, n), bool)
    source = np.zeros((BLOCK, len(at), n), np.int16)
    for t in range(BLOCK):
        on = np.flatnonzero(size > t)
        if not len(on):
            break
        now = m[on]
        top = now.argmax(2)
        change = np.take_along_axis(now, top[:, :, None], 2) - np.float32(penalty)
        stay[t, on] = keep = now >= change
        source[t, on] = top
        m[on] = np.where(keep, now, change) + scores[at[on] + t][:, None, :]
    # chain the blocks of each document, those with most blocks first
    docs = np.argsort(-n_blocks, kind="stable")
    docs = docs[n_blocks[docs] > 0]
    v = np.zeros((len(docs), n), np.float32)
    entry = np.zeros((len(at), n), np.int16)
    for k in range(int(n_blocks.max())):
        on = int(np.searchsorted(-n_blocks[docs], -k, "left"))
        b = begin[docs[:on]] + k
        way = v[:on, :, None] + m[b]
        entry[b] = way.argmax(1)
        v[:on] = way.max(1)
    state = v.argmax(1)
    leave, enter = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(int(n_blocks.max()) - 1, -1, -1):
        on = int(np.searchsorted(-n_blocks[docs], -k, "left"))
        b = begin[docs[:on]] + k
        leave[b] = state[:on]
        state[:on] = enter[b] = entry[b, state[:on]]
    out = np.zeros(n_words, np.int64)
    for t in range(BLOCK - 1, -1, -1):
        on = np.flatnonzero(size > t)
        out[at[on] + t] = leave[on]
        leave[on] = np.where(stay[t, on, enter[on], leave[on]], leave[on], source[t, on, enter[on]])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_lang: int = SAMPLE) -> Model:
    """A model from at most ``per_lang`` labelled documents of each language, those with the smallest id hashes; ``SAMPLES`` texts at most come to the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if learn is None else learn))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = cut(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES))
    per_lang = max(min(per_lang, SAMPLES // max(counts.count(), 1)), 1)
    # a share of each language's ids that holds enough of them goes on to be ranked, so that no task ranks a frequent language
    share = cut(counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * per_lang + 200) / F.col("count")).alias("share")))
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("u", "id")
    drawn = rows.select("id", "lang", u.alias("u")).join(F.broadcast(share), "lang").where(F.col("u") < F.col("share"))
    chosen = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("id", "lang").distinct()
    some = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "text", "lang")
    got = sorted(((r[0], r[1], r[2]) for r in some.toLocalIterator()), key=lambda r: (str(r[0]), r[2], r[1]))
    return Model([r[1] for r in got], [r[2] for r in got])


def _labelled(shared, penalty: float, with_spans: bool):
    def run(batches):
        model: Model = shared.value
        names = [*model.langs, "und"]
        n = len(model.langs)
        for part in chunks(batches, size=CHUNK):
            w = Letters(part.column("text"), model.bits)
            rows = np.full(part.num_rows, n)
            score = np.zeros(part.num_rows)
            label = np.zeros(len(w.size), np.int64)
            if n and len(w.size):
                s = model.scores(w)
                label = viterbi(s, w.first, penalty)
                sure = np.exp(s[np.arange(len(label)), label]) / np.exp(s).sum(1)
                sure[~model.known[w.script]] = 0.0
                size = np.bincount(w.doc * n + label, weights=w.size, minlength=part.num_rows * n).reshape(-1, n)
                good = np.bincount(w.doc * n + label, weights=w.size * sure, minlength=part.num_rows * n).reshape(-1, n)
                any_ = size.sum(1) > 0
                seen = good.sum(1) > 0
                rows = np.where(any_, np.where(seen, size.argmax(1), model.frequent), n)
                best = np.minimum(rows, n - 1)[:, None]
                score = np.where(any_ & seen, np.take_along_axis(good, best, 1)[:, 0] / np.maximum(size.sum(1), 1), 0.0)
            cols = [part.column("id"), pa.array([names[k] for k in rows], pa.string()), pa.array(np.clip(score, 0, 1))]
            head = ["id", "lang_pred", "score"]
            cols.append(part.column("key"))
            head.append("key")
            if with_spans:
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(label))[: len(start)]
                base = w.first[:-1][w.doc[start]] if len(start) else start
                span = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(label[start] if n else np.zeros(len(start), np.int64))), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["lang", "start", "end"])
                cols.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(start, w.first).astype(np.int32)), span))
                head.append("spans")
            yield pa.record_batch(cols, head)

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """One row for each document: id, lang_pred, score, key (a hash of the text) and, if asked for, spans of words by language."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = f"id {kind}, lang_pred string, score double, key long" + ", spans array<struct<lang:string,start:int,end:int>>" * with_spans
    return rows.mapInArrow(_labelled(shared, penalty, with_spans), out).withColumnRenamed("id", id_col)
