"""Near-duplicate classes by Order MinHash, verified by banded alignment.

1. Each document's ``SHINGLE``-word strings are labelled with their occurrence number. For each of ``SKETCHES`` hash
   functions the ``TAKE`` strings with the smallest values are taken in text order; the hash of that sequence is a
   sketch. It agrees for documents that share the strings and their order, as edit-similar texts do.
2. Documents with the same words are one class at once; a representative stands for them.
3. Rows (sketch, representative) are range-partitioned by both, so that a sketch that very many documents share is
   spread over tasks. At first each member of a group is a candidate with the group's first, in groups of more than
   two only with the ``LEADS`` firsts that it shares most sketches with. Groups are then
   completed in rounds: of their members that are not yet in one class, all pairs are candidates unless lengths and
   outlines (counts of words by place and hash) prove that they are no link. Large groups meet block by block, across
   tasks; earlier rounds only try each member's nearest partners, the last tries all. So every pair that agrees on a
   sketch is in one class in the end, or aligned, or proven to be below the threshold.
4. Candidates are dealt into tiles by buckets of their texts, so that a text's words are sent once for each tile and not for
   each pair, and are aligned word by word (64-bit hashes) inside a band: similarity = 1 - edit distance / words of the
   longer. Pairs at ``SIMILARITY`` or more are links; connected components of links are the classes, found by
   pointing to the smallest neighbour and contracting, with distributed checkpoints and only counts on the driver.

A sketch takes strings of three words, not five: two texts of edit similarity 0.8 share too few five-word strings.

Cases: texts without words (null, empty) belong to no group, are classes of their own and are kept; texts of fewer words than a string are
one string; repeated rows share a class and are kept or not alike; rows that share an id are judged each by its own text; rows without an id take part, and
are kept if no row of their class has one; very long texts are read whole; ids may be of any type that has an order; ties go to the smaller id, then the smaller digest; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import IDS, U64, Words, chunks, cut, mix, numbered, parts, ranges, renumbered

SHINGLE, SKETCHES, TAKE, SIMILARITY = 3, 32, 2, 0.8
#: Bins of an outline, rows of a group that is paired at once, rows of a block when groups are completed, pairs held at a time.
BINS, SMALL, WIDE, PAIRS = 768, 64, 4096, 25_000
AT_ONCE = 2_048
#: Bytes of words of a bucket of texts that are aligned, and of the pairs that one call aligns.
BUCKET, HELD = 1 << 24, 1 << 23
#: Sections of a text in its outline: they end at halves of the largest power of two of words that it holds, at that, and at its end.
SECTIONS = 3
#: Partners of a row and block in the rounds that complete the groups; the last takes all.
PARTNERS = (2, None)
#: First ids of its groups that a row is compared with at first; those of groups that are completed anyway wait beyond.
LEADS = 4
#: Links that one task may label.
EDGES = 1_000_000
#: Rows of a partition of sketches, and rows of it that are read at a time.
ROWS, RANGE = 100_000, 16_384

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)


def _shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word strings in text order, and where each document's begin; a short text is one string."""
    n = len(w.hash)
    h = w.hash.copy()
    short = np.minimum(w.n, size)
    left = np.repeat(w.first[1:], w.n) - np.arange(n)  # words up to the end of the document
    for j in range(1, size):
        ok = np.flatnonzero(left > j)
        h[ok] = mix(h[ok] * U64(31) + w.hash[ok + j])
    count = np.maximum(w.n - size + 1, np.minimum(short, 1))
    place = np.arange(n) - np.repeat(w.first[:-1], w.n)
    keep = place < np.repeat(count, w.n)
    return h[keep], np.concatenate([[0], np.cumsum(count)])


def _labelled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each string's hash with its occurrence number in its document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = mix(h ^ mix(doc.astype(U64)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    run = np.arange(len(k)) - np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    number = np.empty(len(k), np.int64)
    number[order] = run
    return np.where(number > 0, mix(h + number.astype(U64) * U64(0x9FB21C651E98DF25)), h)


def sketches(w: Words) -> np.ndarray:
    """A matrix of sketches; rows without words are zero."""
    h, first = _shingles(w, SHINGLE)
    out = np.zeros((len(w.n), SKETCHES), U64)
    some = np.flatnonzero(w.n > 0)
    if not len(some):
        return out
    first = np.append(first[some], len(h))
    size = np.diff(first)
    h = _labelled(h, first)
    place = np.arange(len(h))
    top = U64(2**64 - 1)
    for i, seed in enumerate(_SEEDS):
        v = h * seed
        v ^= v >> U64(32)
        taken = np.zeros((len(some), TAKE), np.int64)
        for t in range(TAKE):
            least = np.minimum.reduceat(v, first[:-1])
            at = np.flatnonzero(v == np.repeat(least, size))
            row = np.searchsorted(first, at, "right") - 1
            _, one = np.unique(row, return_index=True)
            at = at[one]
            taken[:, t] = np.where(size > t, place[at], -1)
            v[at] = top
        taken.sort(axis=1)
        s = np.full(len(some), U64(i + 1))
        for t in range(TAKE):
            s = mix(s * U64(31) + np.where(taken[:, t] >= 0, h[np.maximum(taken[:, t], 0)], U64(0)))
        out[some, i] = s
    return out


def outlines(w: Words) -> np.ndarray:
    """How many words of each section of a document fall into each of ``BINS`` / ``SECTIONS`` hash bins, at most 255."""
    bins = BINS // SECTIONS
    bin_ = ((w.hash >> U64(32)) % U64(bins)).astype(np.int64)
    place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.n)
    power = np.repeat(_power(w.n), w.n)
    section = (place >= power // 2).astype(np.int64) + (place >= power)
    return np.minimum(np.bincount((w.doc * SECTIONS + section) * bins + bin_, minlength=BINS * len(w.n)), 255).astype(np.uint8).reshape(-1, BINS)


def _power(n: np.ndarray) -> np.ndarray:
    """The largest power of two that is not above each number of words."""
    return 1 << np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def _rows(m: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    n, size = m.shape[0], m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _matrix(column, width: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), kind).reshape(len(column), width)


def _wholes(w: Words) -> pa.Array:
    """A digest of each text's words in their order, 128 bits and their number; null where there are none."""
    some = np.flatnonzero(w.n > 0)
    out = np.zeros((len(w.n), 3), U64)
    out[:, 2] = w.n
    if len(some):
        place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.n)).astype(U64)
        for k, seed in enumerate((U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A9A47))):
            out[some, k] = np.add.reduceat(mix(w.hash ^ mix(place + seed)), w.first[:-1][some])
    return pa.array([f"{a:016x}{b:016x}{n:x}" if n else None for a, b, n in out.tolist()], pa.string())


def _sketched(batches):
    for part in chunks(batches):
        w = Words(part.column("text"))
        yield pa.record_batch([part.column("id"), part.column("key"), _wholes(w), pa.array(w.n.astype(np.int32)), _rows(outlines(w)), _rows(sketches(w).astype(">u8"))], ["id", "key", "whole", "n", "outline", "sketches"])


def _dealt(batches):
    """A row (sketch, id) for each sketch."""
    for batch in batches:
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            m = _matrix(part.column("sketches"), SKETCHES, ">u8").astype(U64)
            yield pa.record_batch([pa.array(m.reshape(-1).view(np.int64)), part.column("node").take(pa.array(np.repeat(np.arange(part.num_rows), SKETCHES)))], ["sketch", "id"])


def _first_pairs(batches):
    """Of a sorted range of (sketch, id): each group's first id with the others, as (sketch null, a, b, last); rows (sketch, id, null, null) of groups with further pairs.

    ``last``: the pair stands in a group without further pairs, which is not completed later.

    A group that goes on in the next batch keeps its first id; one at an end of the range may go on in another task.
    """
    key, lead = None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(first: bool, last: bool):
        nonlocal key, lead
        sketch, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        new = np.append(True, sketch[1:] != sketch[:-1])
        edge = np.flatnonzero(new)
        size = np.diff(np.append(edge, len(sketch)))
        head = ids[edge].copy()
        goes_on = not first and key == sketch[0]
        if goes_on:
            head[0] = lead
        open_ = size > 2
        open_[0] |= first or goes_on
        open_[-1] = True
        key, lead = sketch[-1], head[-1]
        mine = np.repeat(head, size)
        row = np.repeat(open_, size)
        pair = np.unique(np.stack([mine, ids, ~row], 1)[mine != ids], axis=0)
        k = int(row.sum())
        gone = np.arange(k + len(pair)) >= k
        return pa.record_batch(
            [pa.array(np.append(sketch[row], np.zeros(len(pair), np.int64)), mask=gone), pa.array(np.append(ids[row], np.minimum(pair[:, 0], pair[:, 1]))), pa.array(np.append(np.zeros(k, np.int64), np.maximum(pair[:, 0], pair[:, 1])), mask=~gone), pa.array(np.append(np.zeros(k, np.int64), pair[:, 2]) > 0, mask=~gone)], ["sketch", "a", "b", "last"]
        )

    first = True
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("sketch").to_numpy(), batch.column("id").to_numpy()))
            if sum(len(x[0]) for x in held) >= RANGE:
                yield settle(first, False)
                first = False
    if held:
        yield settle(first, True)


def _spread(batches):
    """A row (sketch, id, label) for each sketch of a row (id, sketches, label)."""
    for batch in batches:
        if batch.num_rows:
            listed = batch.column("sketches")
            at = pa.array(np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy()))
            yield pa.record_batch([listed.flatten(), batch.column("id").take(at), batch.column("label").take(at)], ["sketch", "id", "label"])


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (key, sketch, left, right, id, label) of groups with several labels, a copy for each pair of blocks that a row meets.

    Rows of a label with more than ``WIDE`` rows have blocks of their own, which never meet each other.
    """
    mixed = cut(rows.groupBy("sketch").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sketch", "n"))
    rows = rows.join(mixed.select("sketch"), "sketch")
    if not mixed.where(F.col("n") > WIDE).limit(1).count():
        return rows.select(F.col("sketch").alias("key"), "sketch", F.lit(True).alias("left"), F.lit(True).alias("right"), "id", "label")
    size = rows.groupBy("sketch", "label").agg(F.count("*").alias("n"))
    size = size.withColumn("own", F.when(F.col("n") > WIDE, F.col("label")))
    size = size.groupBy("sketch", "own").agg(F.sum("n").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    size = size.withColumn("blocks", F.ceil(F.col("n") / WIDE).cast("int"))
    group = size.groupBy("sketch").agg(F.collect_list(F.struct("own", "blocks")).alias("all"), F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("sketch", "all")
    named = F.concat(F.coalesce(F.col("label").cast("string"), F.lit("-")), F.lit(":"))
    joined = rows.join(group, "sketch")
    own = F.filter("all", lambda e: e["own"] == F.col("label"))
    is_own = F.size(own) > 0
    mine = F.when(is_own, own[0]["blocks"]).otherwise(F.filter("all", lambda e: e["own"].isNull())[0]["blocks"])
    place = F.concat(F.when(is_own, named).otherwise("-:"), F.pmod(F.xxhash64("id"), mine).cast("string"))
    met = F.filter("all", lambda e: ~is_own | e["own"].isNull() | (e["own"] != F.col("label")))
    names = F.flatten(F.transform(met, lambda e: F.transform(F.sequence(F.lit(0), e["blocks"] - 1), lambda k: F.concat(F.coalesce(e["own"].cast("string"), F.lit("-")), F.lit(":"), k.cast("string")))))
    out = joined.select("sketch", "id", "label", place.alias("mine"), F.explode(names).alias("other"))
    return out.select(F.xxhash64("sketch", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "sketch", (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"), "id", "label")


def _far(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: float) -> np.ndarray:
    """The distance of the outlines, row by row; -1 where it, or the lengths, show that the texts are no link.

    A link has at most t = (1 - least) * longer edits. One edit takes one count away and adds one, at most: both the counts
    that one text has above the other and those below are at most t, and they differ by the difference of lengths. Cut two
    texts at one place: an alignment shifts the cut by s places, and half of the s + |difference of lengths| that this
    takes are insertions or deletions on the other side. So the counts before the cut and those after it differ by at most
    2 t + |difference of lengths| together. Bins that are full in either text count as equal; no link is lost.
    """
    if len(x) > AT_ONCE:  # a few megabytes of counts at a time
        return np.concatenate([_far(x[k : k + AT_ONCE], y[k : k + AT_ONCE], nx[k : k + AT_ONCE], ny[k : k + AT_ONCE], least) for k in range(0, len(x), AT_ONCE)])
    longer = np.maximum(nx, ny)
    gap = np.abs(nx.astype(np.int64) - ny)
    most = (1 - least) * longer + 1e-6
    out = np.full(len(x), -1, np.int64)
    at = np.flatnonzero(gap <= most)
    x, y = (v[at].reshape(len(at), SECTIONS, BINS // SECTIONS) for v in (x, y))
    open_ = ~((x == 255) | (y == 255)).any(1)
    x, y = ((v * open_[:, None]).astype(np.int16) for v in (x, y))
    d = np.abs(x.sum(1, dtype=np.int16) - y.sum(1, dtype=np.int16)).sum(1)
    near = np.flatnonzero(d + gap[at] <= 2 * most[at])
    at, x, y, d = at[near], x[near], y[near], d[near]
    ok = np.ones(len(at), bool)
    px, py = _power(nx[at]), _power(ny[at])
    for cut in (0, 1):  # the smaller of the two powers, or half of it
        place = np.minimum(px, py) >> cut
        known = (place == px) | (place == px // 2)
        known &= (place == py) | (place == py // 2)
        sides = np.zeros(len(at), np.int64)
        for k in range(SECTIONS - 1):
            for j in range(SECTIONS - 1):
                here = np.flatnonzero(known & ok & (place == (px if k else px // 2)) & (place == (py if j else py // 2)))
                if len(here):
                    head = np.abs(x[here, : k + 1].sum(1, dtype=np.int16) - y[here, : j + 1].sum(1, dtype=np.int16)).sum(1)
                    sides[here] = head + np.abs(x[here, k + 1 :].sum(1, dtype=np.int16) - y[here, j + 1 :].sum(1, dtype=np.int16)).sum(1)
        ok &= ~known | (sides <= 2 * most[at] + gap[at])
    out[at[ok]] = d[ok]
    return out


def _crossed(most: int | None, least: float):
    """Pairs with different labels that may be links, of each pair of blocks; of each row the ``most`` nearest, with (null, null) if that leaves some out.

    A pair that agrees on several sketches belongs to the group of the first of them, so that it is found once.
    """

    def best(x, y, d):
        """Pairs in which one is among the ``most`` nearest of the other, and whether others are left out."""
        if most is None or not len(x):
            return x, y, d, False
        row, at = np.append(x, y), np.tile(np.arange(len(x)), 2)
        order = np.lexsort((np.tile(d, 2), row))
        row, at = row[order], at[order]
        new = np.append(True, row[1:] != row[:-1])
        rank = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        keep = np.unique(at[rank < most])
        return x[keep], y[keep], d[keep], len(keep) < len(x)

    def pairs(cols, edge):
        """Pairs of all groups; ``edge``: where each begins, and one more."""
        sketch, left, right, ids, label, n, outline, sketches_ = cols
        size = np.diff(edge)
        held, over, count = [(np.zeros(0, np.int64),) * 3], False, 0

        def nearest():
            nonlocal held, over, count
            x, y, d, more = best(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, over, count = [(x, y, d)], over or more, len(x)

        def tried(x, y):
            nonlocal count
            ok = (label[x] != label[y]) & ((left[x] & right[y]) | (right[x] & left[y])) & (ids[x] != ids[y])
            x, y = x[ok], y[ok]
            d = _far(outline[x], outline[y], n[x], n[y], least)
            ok = d >= 0
            x, y, d = x[ok], y[ok], d[ok]
            first = (sketches_[x] == sketches_[y]).argmax(1)
            ok = sketches_[x, first] == sketch[x]
            held.append((x[ok], y[ok], d[ok].astype(np.int64)))
            count += int(ok.sum())
            if count > 20 * PAIRS and most is not None:
                nearest()

        small = np.repeat(size <= SMALL, size)
        at = np.flatnonzero(small)
        after = (np.repeat(edge[1:], size) - np.arange(edge[-1]) - 1)[at]
        z = np.append(np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()), PAIRS), "left"), len(at))
        for a, b in zip(z[:-1], z[1:], strict=True):
            if b > a:
                tried(np.repeat(at[a:b], after[a:b]), ranges(at[a:b] + 1, after[a:b]))
        for g in np.flatnonzero(size > SMALL):
            own = np.arange(edge[g], edge[g + 1])
            own = own[np.argsort(n[own], kind="stable")]  # a partner is not longer than a link allows
            to = np.searchsorted(n[own], n[own] / least + 1e-6, "right")
            after = to - np.arange(len(own)) - 1
            z = np.append(np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()), PAIRS), "left"), len(own))
            for a, b in zip(z[:-1], z[1:], strict=True):
                if b > a:
                    tried(np.repeat(own[a:b], after[a:b]), own[ranges(np.arange(a, b) + 1, after[a:b])])
        nearest()
        x, y = held[0][:2]
        low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        both = np.unique(np.stack([low, high], 1), axis=0)
        gone = np.arange(len(both) + over) >= len(both)
        return pa.record_batch([pa.array(np.append(both[:, 0], [0] * over).astype(np.int64), mask=gone), pa.array(np.append(both[:, 1], [0] * over).astype(np.int64), mask=gone)], ["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sketch", "left", "right", "id", "label", "n")]
            held.append((key, *cols, _matrix(batch.column("outline"), BINS), _matrix(batch.column("sketches"), SKETCHES, ">u8").astype(U64).view(np.int64)))
            if held[0][0][0] == key[-1]:  # one group so far
                continue
            key, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            held = [(key[edge[-1] :], *(c[edge[-1] :] for c in cols))]
            yield pairs([c[: edge[-1]] for c in cols], edge)
        if held:
            key, *cols = (np.concatenate(x) for x in zip(*held, strict=True))
            yield pairs(cols, np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))

    return run


def _likely(least: float):
    """The pairs that their outlines do not rule out."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _far(_matrix(batch.column("oa"), BINS), _matrix(batch.column("ob"), BINS), batch.column("na").to_numpy(), batch.column("nb").to_numpy(), least)
                ok = pa.array(d >= 0)
                yield pa.record_batch([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def _worded(batches):
    for part in chunks(batches):
        w = Words(part.column("text"))
        yield pa.record_batch([part.column("id"), pa.array([w.hash[w.first[i] : w.first[i + 1]].tobytes() for i in range(len(w.n))], pa.binary())], ["id", "words"])


def _trim(a: np.ndarray, b: np.ndarray):
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    k = int(differ[0]) if len(differ) else n
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    k = int(differ[0]) if len(differ) else n
    return a[: len(a) - k], b[: len(b) - k]


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as small numbers, equal where the words are."""
    code = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int32)
    return code[: len(a)], code[len(a) :]


def _unshared(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of the longer that the other lacks, counted with repeats."""
    n = max(int(a.max()), int(b.max())) + 1
    return max(len(a), len(b)) - int(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)).sum())


def _unmatched(a: np.ndarray, b: np.ndarray, t: int) -> int:
    """A lower bound of an edit distance of at most ``t``: words of the longer that the other lacks within t places."""
    if len(a) < len(b):
        a, b = b, a
    place = np.sort(b.astype(np.int64) << 31 | np.arange(len(b)))
    own = a.astype(np.int64) << 31
    at = np.arange(len(a))
    k = np.searchsorted(place, own | np.maximum(at - t, 0))
    return int(((k == len(place)) | (place[np.minimum(k, len(place) - 1)] > (own | at + t))).sum())


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], t: int) -> np.ndarray:
    """Cost of the best alignment inside diagonals -t..t, all pairs at once: the edit distance, if that is at most t; never less than it."""
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    top = int(la.max())
    left = np.zeros((top, len(pairs), 1), np.int32)
    right = np.full((len(pairs), int(max(lb.max(), top)) + 2 * t + 2), -1, left.dtype)
    for i, (a, b) in enumerate(pairs):
        left[: len(a), i, 0], right[i, t : t + len(b)] = a, b
    c = np.arange(2 * t + 1, dtype=np.int32)
    far = np.int32(1 << 28)
    now = np.broadcast_to(np.where(c >= t, c - t, far).astype(np.int32), (len(pairs), 2 * t + 1)).copy()
    out = np.full(len(pairs), far, np.int64)
    done = la == 0
    out[done] = lb[done]
    ends = {int(k): np.flatnonzero(la == k) for k in np.unique(la)}
    for i in range(1, top + 1):
        step = now + (left[i - 1] != right[:, i - 1 : i + 2 * t])
        np.minimum(step[:, :-1], now[:, 1:] + 1, out=step[:, :-1])
        step -= c
        now = np.minimum.accumulate(step, axis=1, out=step)
        now += c
        if (end := ends.get(i)) is not None:
            at = lb[end] - la[end] + t
            ok = (at >= 0) & (at <= 2 * t)
            out[end[ok]] = now[end[ok], at[ok]]
    return out


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """1 - cost of the best banded alignment / longer length of each pair; -1 where the edit similarity is below ``least``.

    The band widens until an alignment is good enough or the band holds every alignment that could be, so that the
    decision is exact; the figure itself is a lower bound where a wider band would align better still.
    """
    out = np.full(len(pairs), -1.0)
    wait = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int((1 - least) * longer + 1e-9)
        x, y = _trim(a, b)
        if not len(x) or not len(y):
            d = max(len(x), len(y))
            out[i] = 1 - d / longer if longer and d <= most else -1 if longer else 1
        elif abs(len(x) - len(y)) <= most:
            x, y = _coded(x, y)
            if _unshared(x, y) <= most and _unmatched(x, y, most) <= most:
                wait.append((i, x, y, most, longer))
    band = 8
    while wait:
        wait.sort(key=lambda p: len(p[1]))
        later, at = [], 0
        while at < len(wait):
            size = max(1, min(256, (1 << 22) // ((2 * band + 1) * 8 + len(wait[min(at + 255, len(wait) - 1)][1]) * 16)))
            some = wait[at : at + size]
            at += size
            for p, d in zip(some, _banded([(x, y) for _, x, y, _, _ in some], band), strict=True):
                if d <= p[3]:
                    out[p[0]] = 1 - d / p[4]
                elif band < p[3]:
                    later.append(p)
        wait, band = later, band * 4
    return out


def _verified(least: float):
    """The links among the pairs of each tile: rows (tile, a, null, words of a) come before its rows (tile, a, b, null)."""

    def run(batches):
        tile, words, wait, size = None, {}, [], 0

        def settle():
            nonlocal size
            s = similarities([(x, y) for _, _, x, y in wait], least)
            ok = np.flatnonzero(s >= least)
            out = pa.record_batch([pa.array([wait[k][0] for k in ok], pa.int64()), pa.array([wait[k][1] for k in ok], pa.int64()), pa.array(s[ok])], ["a", "b", "similarity"])
            wait.clear()
            size = 0
            return out

        for batch in batches:
            for at, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("tile", "a", "b")), batch.column("words"), strict=True):
                if at != tile:
                    tile, words = at, {}
                if b is None:
                    words[a] = np.frombuffer(text.as_py(), U64)
                    continue
                wait.append((a, b, words[a], words[b]))
                size += words[a].nbytes + words[b].nbytes
                if len(wait) >= 1024 or size >= HELD:
                    yield settle()
        if wait:
            yield settle()

    return run


def _forest(batches, most: int = 1 << 20, roots: bool = False):
    """Links of a partition without those that close a circle: each node with the smallest of its part. Components stay as they are."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def emit():
        pairs = [(find(x), x) for x in root]
        root.clear()
        a, b = np.array([p for p in pairs if roots or p[0] != p[1]], np.int64).reshape(-1, 2).T
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > most:
            yield emit()
    if root:
        yield emit()


def _labelled_all(batches):
    """Every node of few links with the smallest of its component."""
    return _forest(batches, 4 * EDGES, True)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each node's connected component, for links (a, b).

    Each task first reduces its links to a forest. Up to ``EDGES`` links that are left (16 bytes each) one task
    labels. Beyond, each round every node points to its smallest neighbour, pointers are followed to their roots, and
    the links are contracted to links between roots, until none is left; a node with very many neighbours is only
    ever on the side of a join that Spark splits, or is reduced by partial aggregates.
    """
    edges = cut(links.select("a", "b").coalesce(parts(links.sparkSession)).mapInArrow(_forest, "a long, b long"))
    if edges.limit(EDGES + 1).count() <= EDGES:
        return cut(edges.coalesce(1).mapInArrow(_labelled_all, "a long, b long").select(F.col("b").alias("id"), F.col("a").alias("label")))
    edges = cut(edges.distinct())
    label = None
    while edges.limit(1).count():
        parent = cut(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")))  # a < b
        while True:
            above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
            step = cut(parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            parent = step.select("id", "up")
            if not step.where("moved").limit(1).count():
                break
        top = lambda c: parent.select(F.col("id").alias(c), F.col("up").alias(f"top_{c}"))
        joined = edges.join(top("a"), "a", "left").select(F.coalesce("top_a", "a").alias("a"), "b").join(top("b"), "b", "left").select("a", F.coalesce("top_b", "b").alias("b"))
        edges = cut(joined.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if label is None:
            label = parent.select("id", F.col("up").alias("label"))
        else:
            moved = label.withColumnRenamed("label", "up").join(parent.select(F.col("id").alias("up"), F.col("up").alias("label")), "up", "left")
            label = cut(moved.select("id", F.coalesce("label", "up").alias("label")).unionByName(parent.withColumnRenamed("up", "label")))
    if label is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("label")).limit(0)
    return cut(label.unionByName(label.select("label").distinct().select(F.col("label").alias("id"), "label")))


def representatives(rows: DataFrame) -> DataFrame:
    """node, id, key, whole, n, outline, sketches: one row for all documents with the same words, of rows with these columns.

    ``id`` and ``key`` are those of the first, by id (null last) and key. ``node`` is that id, or, where ids repeat or lack,
    a number below all ids.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "key")).alias("_first")
    heads = rows.where("whole is not null").groupBy("whole").agg(first, *(F.first(c).alias(c) for c in ("n", "outline", "sketches")))
    heads = cut(heads.select("_first.id", "_first.key", "whole", "n", "outline", "sketches"))
    clash = heads.groupBy("id").agg(F.count("*").alias("copies")).where("copies > 1 OR id IS NULL")
    if not clash.limit(1).count():
        return heads.withColumn("node", F.col("id"))
    odd = cut(heads.select("id", "whole").join(clash, heads["id"].eqNullSafe(clash["id"]), "left_semi").orderBy("id", "whole"))
    low = heads.agg(F.coalesce(F.min("id"), F.lit(0))).first()[0]
    numbered = odd.select("whole").rdd.zipWithIndex().map(lambda r: (r[0][0], low - 1 - r[1])).toDF("whole string, number long")
    return cut(heads.join(numbered, "whole", "left").withColumn("node", F.coalesce("number", "id")).drop("number"))


def classes(heads: DataFrame, rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(id, label) of the representatives that have a link, by their nodes: the smallest node of the class."""
    spark = heads.sparkSession
    count = heads.count() * SKETCHES
    dealt = heads.select("node", "sketches").mapInArrow(_dealt, "sketch long, id long")
    ranged = dealt.repartitionByRange(max(parts(spark), count // ROWS + 1), "sketch", "id").sortWithinPartitions("sketch", "id")
    first = cut(ranged.mapInArrow(_first_pairs, "sketch long, a long, b long, last boolean"))
    shape = heads.select("node", "n", "outline", "sketches")
    of = lambda x: shape.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("outline").alias(f"o{x}"))
    star = first.where("sketch IS NULL").groupBy("a", "b").agg(F.count("*").alias("n"), F.bool_or("last").alias("last"))
    shared = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "a"))
    star = star.withColumn("_k", shared).where((F.col("_k") <= LEADS) | F.col("last")).select("a", "b")
    tried = cut(star.join(of("a"), "a").join(of("b"), "b").mapInArrow(_likely(least), "a long, b long"))
    found = _aligned(heads, rows, tried, least)
    label = components(found)
    hot = first.where("sketch IS NOT NULL").select("sketch", F.col("a").alias("id"))
    width = max(parts(spark), hot.count() // ROWS + 1)
    hot = cut(hot.groupBy("id").agg(F.collect_list("sketch").alias("sketches")))  # labels are looked up once for each row
    for most in PARTNERS:
        named = hot.join(label.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "sketches", F.coalesce("label", "id").alias("label"))
        named = named.mapInArrow(_spread, "sketch long, id long, label long")
        met = _blocked(cut(named)).join(shape.withColumnRenamed("node", "id"), "id").repartition(width, "key").sortWithinPartitions("key")
        crossed = cut(met.mapInArrow(_crossed(most, least), "a long, b long").distinct())
        more = cut(crossed.where("a is not null").join(tried, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            extra = _aligned(heads, rows, more, least)
            if extra.limit(1).count():
                found = found.unionAll(extra)
                label = components(found)
            tried = tried.unionAll(more)
        if not crossed.where("a is null").limit(1).count():
            break
    return label


def _aligned(heads: DataFrame, rows: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The links (a, b, similarity) among the pairs (a, b) of nodes.

    Nodes are dealt into buckets, and pairs into tiles by their two buckets. A text's words go to a tile once, not to each
    pair: a node among very many pairs is copied as often as there are buckets, at most. Buckets are as many as keep all tasks
    busy with tiles, more if their words would pass ``BUCKET`` bytes.
    """
    spark = heads.sparkSession
    each = [pairs.select(F.col(c).alias("node")).distinct() for c in "ab"]  # a node stands in many pairs: reduced before both sides meet
    wanted = each[0].unionByName(each[1]).distinct()
    wanted = cut(heads.select("node", F.col("id").alias("_id"), F.col("key").alias("_key")).join(wanted, "node", "left_semi"))
    wanted = F.broadcast(wanted) if wanted.count() <= IDS else wanted
    some = rows.join(wanted, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    worded = some.select(F.col("node").alias("id"), "text").mapInArrow(_worded, "id long, words binary")
    worded = cut(worded.groupBy("id").agg(F.first("words").alias("words")))
    held = worded.agg(F.coalesce(F.sum(F.length("words")), F.lit(0))).first()[0]
    buckets = max(math.isqrt(6 * parts(spark)), held // BUCKET) + 1
    bucket = [F.pmod(F.xxhash64(c), F.lit(buckets)) for c in "ab"]
    tiled = pairs.select((F.least(*bucket) * buckets + F.greatest(*bucket)).alias("tile"), "a", "b")
    each = [tiled.select("tile", F.col(c).alias("id")).distinct() for c in "ab"]
    placed = each[0].unionByName(each[1]).distinct().join(worded, "id").select("tile", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "words")
    both = placed.unionByName(tiled.withColumn("words", F.lit(None).cast("binary")))
    both = both.repartition(max(parts(spark), held // BUCKET + 1), "tile").sortWithinPartitions("tile", F.col("b").asc_nulls_first())
    return cut(both.mapInArrow(_verified(least), "a long, b long, similarity double"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, key (a hash of its text), class_id (the smallest id of its class), kept (the class's first by id, digest of the words and key)."""
    docs, names = numbered(docs.select(id_col, text_col), id_col)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    sketched = cut(rows.mapInArrow(_sketched, "id long, key long, whole string, n int, outline binary, sketches binary"))
    heads = representatives(sketched)
    label = classes(heads, rows, least)
    named = heads.select("node", "id", "key", "whole").join(label.withColumnRenamed("id", "node"), "node", "left").select(F.coalesce("label", "node").alias("label"), "id", "key", "whole")
    named = cut(named)
    many = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("lacks"), "id", "whole", "key")).alias("top"), F.count("*").alias("size")).where("size > 1").select("label", "top")
    own = lambda c: F.when(F.col("top").isNull(), F.col(c)).otherwise(F.col(f"top.{c}"))
    named = named.join(many, "label", "left").select(F.col("whole").alias("_whole"), own("id").alias("class_id"), own("key").alias("first_key"))
    out = sketched.select("id", "key", "whole").join(named, F.col("whole") == F.col("_whole"), "left")
    lone = F.col("whole").isNull()
    kept = lone | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first_key")))
    found = out.select(F.col("id").alias(id_col), "key", F.when(lone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))
    return renumbered(found, names, [id_col, "class_id"])
