"""Phrase collocations: n-grams counted by suffix arrays of word ids, merged by key, scored by their weakest cut.

A shard is about ``SHARD`` bytes of text. Its words become ids (equal words of one language, equal ids), and a suffix
array over the ids is built by prefix doubling: ranks of one word, of two, of four; a suffix ends with its piece. Runs
of neighbours in the array whose common prefix (LCP) has n words or more are the intervals of the n-grams, and their
lengths the counts. Counts of shards meet by key in Spark:

1. words, by their text: n of each language, and which words are frequent;
2. pairs, then triples, all of whose parts may be frequent, by a hash: which may be frequent themselves;
3. phrases of 2 to 4 words all of whose parts may be frequent, by their text.

No phrase can be more frequent than its parts, so nothing that reaches ``least`` is lost on the way; where hashes meet,
more passes and is counted by its text. What is known of words, pairs and triples travels as bitmaps of ``BITS`` bits,
whatever the corpus; on a very large one more phrases pass them, and the counts stay the same. Cuts, containment and
ranks are joins and aggregates over the frequent phrases.

Cases: null, empty and wordless texts have no words; a null language counts as ``und``; repeated rows count each time;
a very long text is taken in shards that end at the end of a piece; ties of scores go to the more frequent phrase, then
to the smaller in UTF-8 order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, U64, cut, mix, parts, prefix_sums, ranges, same_bytes, span_hash, utf8

#: Bytes of text in a shard, about; bits of a bitmap (a power of two, 2**32 at most); words of the longest phrase.
SHARD, BITS, LONGEST = 1 << 22, 1 << 26, 4
_ENDS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAPS[list(b" \t")] = True


def shards(batches, size: int = SHARD):
    """(lower-cased bytes, starts of pieces, language of each piece) of about ``size`` bytes at a time; shards end where a piece ends."""
    held, total = [], 0
    for batch in batches:
        data, off = utf8(batch.column(batch.schema.get_field_index("text")))
        low = LOWER[data]
        langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), object)
        at = np.unique(np.concatenate([off[:-1], np.flatnonzero(_ENDS[low]) + 1]))
        at = at[at < len(low)]
        own = np.searchsorted(off, at, "right") - 1
        while len(at):
            to = int(np.searchsorted(at, at[0] + size - total, "left"))
            to = min(max(to, 1), len(at))
            end = int(at[to]) if to < len(at) else len(low)
            held.append((low[at[0] : end], at[:to] - at[0] + total, langs[own[:to]]))
            total += end - int(at[0])
            at, own = at[to:], own[to:]
            if total >= size:
                yield tuple(map(np.concatenate, zip(*held)))
                held, total = [], 0
    if total:
        yield tuple(map(np.concatenate, zip(*held)))


class Shard:
    """The words of a shard: an id for each place, the pieces' ends, and the distinct words.

    ``exact`` tells words with one hash apart by their bytes; where hashes are all that counts, they may stay one.
    """

    def __init__(self, low: np.ndarray, at: np.ndarray, langs: np.ndarray, exact: bool = True):
        inside = ~(_GAPS[low] | _ENDS[low])
        first = np.zeros(len(low), bool)
        first[at] = True
        before = np.zeros(len(low), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(low), bool)
        after[:-1] = inside[1:] & ~first[1:]
        start, end = np.flatnonzero(inside & (~before | first)), np.flatnonzero(inside & ~after) + 1
        piece = (np.cumsum(first) - 1)[start]
        names, lang = np.unique(langs.astype(str), return_inverse=True) if len(langs) else (np.zeros(0, str), np.zeros(0, int))
        self.langs = names.tolist()
        salt = np.array([_salt(x) for x in self.langs], U64)
        lang = lang[piece]
        key = mix(span_hash(prefix_sums(low), start, end) * U64(0xD6E8FEB86659FD93) + salt[lang]) if len(start) else np.zeros(0, U64)
        self.hash, where, self.id = np.unique(key, return_index=True, return_inverse=True)
        if exact and ((lang != lang[where][self.id]).any() or not same_bytes(low, start, end, where, self.id)):  # two words with one hash: told apart by their bytes
            known: dict = {}
            self.id = np.array([known.setdefault((c, low[a:b].tobytes()), len(known)) for c, a, b in zip(lang.tolist(), start.tolist(), end.tolist())])
            where = np.unique(self.id, return_index=True)[1]
            self.hash = key[where]
        self.last = np.ones(len(start), bool)  # of its piece
        self.last[:-1] = piece[1:] != piece[:-1]
        self.lang = lang[where]
        size = end[where] - start[where]
        raw = low[ranges(start[where], size)]
        off = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        self.words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(raw)])

    def narrow(self, bits: list, n: int, least: int = 0) -> None:
        """Go on with the places of phrases of ``least`` (``n``) words or more that may be frequent as far as the bitmaps tell.

        ``may[m]`` says of every place whether the phrase of m words from there, m <= n, may be frequent.
        """
        h = self.hash[self.id]
        may, grams = [None, _has(bits[0], h)], h
        for m in range(2, n + 1):
            ok = np.zeros(len(h), bool)
            ok[: 1 - m] = may[-1][: 1 - m] & may[-1][1 : len(h) + 2 - m]
            if m == 2:
                ok[:-1] &= ~self.last[:-1]
            if m <= len(bits):
                grams = _longer(grams, h, m)
                ok[: len(grams)] &= _has(bits[m - 1], grams)
            may.append(ok)
        joined = may[min(2, n)]
        cover = np.zeros(len(h), bool)
        for k in range(least or n):
            cover[k:] |= may[least or n][: len(h) - k]
        self.at = np.flatnonzero(cover)
        self.may, ends, self.id = may, self.last, self.id[self.at]
        self.last = np.ones(len(self.at), bool)
        self.last[:-1] = (self.at[1:] != self.at[:-1] + 1) | ~joined[self.at[:-1]] | ends[self.at[:-1]]

    def counts(self, sizes) -> list[tuple[np.ndarray, np.ndarray]]:
        """A place and the count of each phrase of each size, from one suffix array."""
        left = _left(self.last)
        order, common = suffixes(self.id, left, max(sizes))
        return [intervals(order, common, left, n) for n in sizes]


def _salt(lang: str) -> int:
    return int(span_hash(prefix_sums(np.frombuffer(lang.encode() or b"\0", np.uint8)), np.array([0]), np.array([len(lang.encode()) or 1]))[0])


def suffixes(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first ``depth`` words, and the words (at most ``depth``) that each shares with the one before it.

    Prefix doubling: the rank of 2w words is the rank of the pair (rank of w words here, rank of w words w places on);
    beyond the end of a piece the rank is 0, the least. ``left``: words up to the end of the piece.
    """
    n = len(ids)
    key, width = ids.astype(np.int64) + 1, 1
    order = np.argsort(key)
    while width < depth:
        rank = np.zeros(n, np.int64)
        found = key[order]
        rank[order] = np.cumsum(np.append(True, found[1:] != found[:-1])) if n else found
        beyond = np.zeros(n, np.int64)
        beyond[: n - width] = rank[width:]
        beyond[left <= width] = 0
        key = rank * (n + 1) + beyond
        order = np.argsort(key)
        width *= 2
    common = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    for k in range(depth):
        same = (left[a] > k) & (left[b] > k)
        a, b = a[same], b[same]
        here = np.flatnonzero(same) if not k else here[same]
        same = ids[a + k] == ids[b + k]
        a, b, here = a[same], b[same], here[same]
        common[here + 1] = k + 1
    return order, common


def _left(last: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its piece, itself among them."""
    ends = np.flatnonzero(last)
    return np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(last)) + 1


def intervals(order: np.ndarray, common: np.ndarray, left: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each n-gram: the LCP intervals of ``n`` words."""
    long = np.flatnonzero(left[order] >= n)
    heads = np.flatnonzero(common[long] < n)
    return order[long[heads]], np.diff(heads, append=len(long))


def _bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bitmap of a column ``h`` of the upper halves of hashes, at most ``bits`` / 64 numbers on the driver."""
    place = F.shiftrightunsigned("h", 32 - int(bits).bit_length() + 1)
    rows = hashes.select(place.alias("b")).select(F.shiftright("b", 6).alias("at"), F.expr("shiftleft(1L, cast(b & 63 AS INT))").alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["at"].to_numpy()] = found["bit"].to_numpy()
    return out


def _has(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> U64(64 - int(len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)).astype(np.int64)) & 1 > 0


def _longer(grams: np.ndarray, words: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the phrases of ``m`` words from those of one word less and those of the words."""
    n = max(len(words) - m + 1, 0)
    return mix(grams[:n] * U64(3) + mix(words[m - 1 :]))


def _upper(h: np.ndarray) -> np.ndarray:
    return (h >> U64(32)).astype(np.uint32).view(np.int32)


def _text(s: Shard, places: np.ndarray, n: int) -> pa.Array:
    words = [s.words.take(pa.array(s.id[places + k])) for k in range(n)]
    return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())) if n > 1 else words[0]


def _rows(s: Shard, places: np.ndarray, counts: np.ndarray, n: int, extra: dict | None = None) -> pa.RecordBatch:
    lang = pa.array(s.langs, pa.string()).take(pa.array(s.lang[s.id[places]])) if len(s.langs) else pa.array([], pa.string())
    cells = {"lang": lang, "phrase": _text(s, places, n).cast(pa.string()), "size": pa.array(np.full(len(places), n, np.int32)), "n": pa.array(counts.astype(np.int64))}
    return pa.RecordBatch.from_pydict(cells | (extra or {}))


def count_words(docs: DataFrame) -> DataFrame:
    """Every word of every language: lang, phrase, h (the upper half of its hash), n."""

    def found(batches):
        for x in shards(batches):
            s = Shard(*x)
            [(places, counts)] = s.counts([1])
            yield _rows(s, places, counts, 1, {"h": pa.array(_upper(s.hash[s.id[places]]))}).drop_columns(["size"])

    rows = docs.mapInArrow(found, "lang string, phrase string, n long, h int")
    return rows.groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))


def count_hashes(docs: DataFrame, bits: list, n: int) -> DataFrame:
    """Phrases of ``n`` words whose parts may be frequent, by the upper half of a hash: h, n."""

    def found(batches):
        for x in shards(batches):
            s = Shard(*x, exact=False)
            words = s.hash[s.id]
            s.narrow(bits, n)
            [(places, counts)] = s.counts([n])
            h = words
            for m in range(2, n + 1):
                h = _longer(h, words, m)
            yield pa.RecordBatch.from_pydict({"h": pa.array(_upper(h[s.at[places]])), "n": pa.array(counts.astype(np.int32))})

    return docs.mapInArrow(found, "h int, n int").groupBy("h").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, bits: list, longest: int = LONGEST) -> DataFrame:
    """Phrases of 2 to ``longest`` words that may be frequent: lang, phrase, size, n."""

    def found(batches):
        for x in shards(batches):
            s = Shard(*x)
            s.narrow(bits, longest, 2)
            for n, (places, counts) in zip(range(2, longest + 1), s.counts(range(2, longest + 1))):
                may = s.may[n][s.at[places]]
                yield _rows(s, places[may], counts[may], n)

    rows = docs.mapInArrow(found, "lang string, phrase string, size int, n long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences (lang, phrase, size, n), and all words of each language (lang, n)."""
    docs = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = cut(count_words(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    known = words.where(F.col("n") >= least)
    bits = [_bitmap(known.select("h"))]
    for n in range(2, longest):
        bits.append(_bitmap(count_hashes(docs, bits, n).where(F.col("n") >= least).select("h")))
    phrases = count_phrases(docs, bits, longest).where(F.col("n") >= least)
    return cut(known.select("lang", "phrase", F.lit(1).alias("size"), "n").unionByName(phrases)), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = LONGEST, covered: int = 80, top: int | None = 2000) -> DataFrame:
    """The phrases of each language by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A cut after the first k words leaves parts with l and r occurrences and scores floor(2000000 a / (l + r)). A phrase
    inside a longer one that has at least ``covered`` per cent of its occurrences is dropped. ``top`` None: all.
    """
    grams, totals = phrase_counts(docs, text_col, lang_col, least, longest)
    split = F.split("phrase", " ")
    phrases = grams.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), split.alias("w"))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("first"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda to, n: grams.select("lang", F.col("phrase").alias(to), F.col("n").alias(n))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr("cast(a AS decimal(19,0)) * cast(2000000 AS decimal(7,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = phrases.where("size > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered))
    free = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # a language may hold most of the phrases: ranked in parts first
        part = F.pmod(F.xxhash64("phrase"), F.lit(4 * parts(docs.sparkSession)))
        free = free.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
