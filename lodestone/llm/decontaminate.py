"""Benchmark decontamination with a distributed positional inverted index.

The index is made once and stored in the shared checkpoint folder: a segment for each chunk of training documents,
with the distinct words (64-bit hashes) in order and, for each, the ascending places at which it stands. Document
bounds are stored beside the lists. ``search`` reads segments and no text: the words of a test window are put in the
order of their counts in the whole index, rarest first, and their lists are intersected in that order, each shifted
by the word's place in the window. No posting crosses the network. The benchmark travels to the workers in blocks of
at most ``BLOCK`` bytes of text, one block and one pass over the index at a time; hits are merged by document.

Phrases are exact (``slop`` = 0) or near: above 0, a window occurs where each of its words stands within ``slop`` words
of its place, counted from the window's rarest word, in the same document.

Cases: a null or wordless text has no words and no hits; a wordless or null item has no windows; an item without an id
marks words, but is named nowhere; items with equal words are each reported; repeated rows, rows that share an id
and rows without an id each get a row of their own; very long texts are a segment of their own; ties between equally
rare words go to the earlier word; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, Words, chunks, cut, ranges

#: Bytes of benchmark text that one pass sends to each worker.
BLOCK = 8 << 20


class Windows:
    """The test windows of a block of items: word numbers, their places, and the items that hold them."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        w = Words(pa.array([t for _, t in items], pa.string()))
        self.names = [i for i, _ in items]
        self.vocab, term = np.unique(w.hash, return_inverse=True)
        size = np.minimum(w.n, n)
        count = np.where(w.n > 0, w.n - size + 1, 0)
        start = ranges(w.first[:-1], count)
        self.item = np.repeat(np.arange(len(items)), count)
        self.size = np.repeat(size, count)
        at = start[:, None] + np.arange(n)
        self.term = np.where(np.arange(n) < self.size[:, None], term[np.minimum(at, max(len(term) - 1, 0))] if len(term) else -1, -1).reshape(-1, n)

    def ordered(self, df: np.ndarray) -> None:
        """Put the words of each window in the order of their corpus counts, rarest first."""
        rank = np.where(self.term >= 0, df[self.term] if len(df) else 0, np.iinfo(np.int64).max)
        self.place = np.argsort(rank, axis=1, kind="stable")
        self.by_rarity = np.take_along_axis(self.term, self.place, 1)


def _indexed(batches):
    """Segments: ids and keys of the documents, where their words begin, distinct words, where their lists begin, and the lists."""
    for part in chunks(batches):
        w = Words(part.column("text"))
        order = np.argsort(w.hash, kind="stable")
        h = w.hash[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        cols = (w.first.astype(np.int32), h[edge], np.append(edge, len(h)).astype(np.int32), order.astype(np.int32))
        one = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c)
        yield pa.record_batch([one(part.column("id")), one(part.column("key")), one(pa.array(w.n.astype(np.int64))), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["ids", "keys", "sizes", "first", "terms", "starts", "postings"])


class Segment:
    """A stored segment, with the words of a block of windows looked up."""

    def __init__(self, row: dict):
        self.first, self.terms, self.starts, self.postings = (np.frombuffer(row[k], t) for k, t in (("first", np.int32), ("terms", U64), ("starts", np.int32), ("postings", np.int32)))
        self.n = len(self.postings)

    def looked_up(self, vocab: np.ndarray) -> np.ndarray:
        """The rank in this segment of each word of ``vocab``; -1 where it does not stand here."""
        if not len(self.terms) or not len(vocab):
            return np.full(len(vocab), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, vocab), len(self.terms) - 1)
        return np.where(self.terms[at] == vocab, at, -1)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    @functools.cached_property
    def keys(self) -> np.ndarray:
        """Rank and place of every posting in one ascending number."""
        return np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * np.int64(self.n + 1) + self.postings


def matches(ws: Windows, seg: Segment, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, the places at which they begin, and the documents in which they occur."""
    none = (np.zeros(0, np.int64),) * 3
    rank = seg.looked_up(ws.vocab)
    here = np.append(rank, 0)[ws.term]  # -1 in the term is past a short window's end
    win = np.flatnonzero(((here >= 0) | (ws.term < 0)).all(1) & (ws.size > 0))
    if not len(win):
        return none
    lead = rank[ws.by_rarity[win, 0]]
    count = (seg.starts[lead + 1] - seg.starts[lead]).astype(np.int64)
    own = seg.postings[ranges(seg.starts[lead].astype(np.int64), count)].astype(np.int64)
    win = np.repeat(win, count)
    start = own - ws.place[win, 0]
    home = seg.doc(own)
    begin, end = seg.first[home].astype(np.int64), seg.first[home + 1].astype(np.int64)
    if not slop:
        ok = (start >= begin) & (start + ws.size[win] <= end)
        win, start, home, begin, end = win[ok], start[ok], home[ok], begin[ok], end[ok]
    keys, n = seg.keys, np.int64(seg.n + 1)
    for j in range(1, ws.term.shape[1]):
        if not len(win):
            return none
        t = ws.by_rarity[win, j]
        base = rank[t] * n
        want = start + ws.place[win, j]
        k = np.minimum(np.searchsorted(keys, base + np.maximum(want - slop, begin)), len(keys) - 1)
        p = keys[k] - base
        ok = (t < 0) | ((p >= np.maximum(want - slop, begin)) & (p <= want + slop) & (p < end))
        win, start, home, begin, end = win[ok], start[ok], home[ok], begin[ok], end[ok]
    return win, start, home


def found_in(ws: Windows, seg: Segment, slop: int) -> dict[int, tuple[list[int], list[str]]]:
    """For each document with hits: merged runs of hit words, counted from its first word, and the items."""
    win, start, home = matches(ws, seg, slop)
    if not len(win):
        return {}
    begin, end = seg.first[home].astype(np.int64), seg.first[home + 1].astype(np.int64)
    edge = np.zeros(seg.n + 1, np.int64)
    np.add.at(edge, np.maximum(start, begin), 1)
    np.add.at(edge, np.minimum(start + ws.size[win], end), -1)
    hit = np.cumsum(edge[:-1]) > 0
    pairs = np.unique(np.stack([home, ws.item[win]], 1), axis=0)
    docs, at = np.unique(pairs[:, 0], return_index=True)
    out = {}
    for d, a, b in zip(docs.tolist(), at, np.append(at[1:], len(pairs)), strict=True):
        own = hit[seg.first[d] : seg.first[d + 1]]
        out[d] = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist(), [ws.names[i] for i in pairs[a:b, 1] if ws.names[i] is not None]
    return out


def _term_counts(block):
    def run(batches):
        vocab = block.value.vocab
        total = np.zeros(len(vocab), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row | {"postings": b""})
                rank = seg.looked_up(vocab)
                total += np.where(rank >= 0, np.diff(seg.starts)[rank] if len(seg.terms) else 0, 0)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k, pa.int64()), pa.array(total[k])], ["term", "n"])

    return run


HITS = "seg long, slot int, runs array<long>, items array<string>, near array<string>"


def _searched(block, slop: int, near: int):
    def run(batches):
        ws = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                seg = Segment(row)
                exact = found_in(ws, seg, slop)
                wide = found_in(ws, seg, near) if near else {}
                slots = sorted(exact.keys() | wide.keys())
                runs, items = zip(*(exact.get(d, ([], [])) for d in slots), strict=True) if slots else ((), ())
                yield pa.record_batch(
                    [pa.array([row["seg"]] * len(slots), pa.int64()), pa.array(slots, pa.int32()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array([wide.get(d, ([], []))[1] for d in slots], pa.list_(pa.string()))],
                    ["seg", "slot", "runs", "items", "near"],
                )

    return run


def _merged(batches):
    """Runs and items of all blocks, document by document."""
    for batch in batches:
        hits, items, near = [], [], []
        for r in batch.to_pylist():
            end = n = 0
            for s, e in sorted((s, e) for runs in r["runs"] or [] for s, e in zip(runs[::2], runs[1::2], strict=True)):
                n += max(e, end) - max(s, end)
                end = max(e, end)
            hits.append(n)
            items.append(sorted({i for own in r["items"] or [] for i in own}))
            near.append(sorted({i for own in r["near"] or [] for i in own}))
        yield pa.record_batch(
            [batch.column("id"), batch.column("key"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in hits]), pa.array([len(i) for i in near], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
            ["id", "key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "items", "near"],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row for each segment, numbered by ``seg``."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    stored = cut(rows.mapInArrow(_indexed, f"ids array<{kind}>, keys array<long>, sizes array<long>, first binary, terms binary, starts binary, postings binary"))
    return stored.withColumn("seg", F.monotonically_increasing_id())  # of stored partitions: the same at each read


def blocks_of(bench: DataFrame, id_col: str, text_col: str, n: int, block: int):
    """The benchmark as blocks of windows, one at a time; each is within ``block`` bytes or one item."""
    now, size = [], 0
    for r in bench.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if now and size + len(r[1] or "") * 4 > block:
            yield Windows(now, n)
            now, size = [], 0
        now.append((r[0], r[1]))
        size += len(r[1] or "") * 4
    yield Windows(now, n)


def search(index: DataFrame, bench: DataFrame, item_col="item_id", item_text="text", n: int = 10, slop: int = 0, near: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each indexed document: id, key (a hash of its text), n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, near."""
    spark = index.sparkSession
    few = index.select("first", "terms", "starts")
    found = None
    for ws in blocks_of(bench, item_col, item_text, n, block):
        shared = spark.sparkContext.broadcast(ws)
        df = np.zeros(max(len(ws.vocab), 1), np.int64)
        for t, k in few.mapInArrow(_term_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n")).toLocalIterator():
            df[t] = k
        shared.unpersist()
        ws.ordered(df)
        shared = spark.sparkContext.broadcast(ws)
        hits = cut(index.select("seg", "first", "terms", "starts", "postings").mapInArrow(_searched(shared, slop, near), HITS))
        shared.unpersist()
        found = hits if found is None else found.unionAll(hits)
    each = found.groupBy("seg", "slot").agg(*(F.collect_list(c).alias(c) for c in ("runs", "items", "near")))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows = index.select("seg", F.posexplode(F.arrays_zip("ids", "keys", "sizes")).alias("slot", "doc"))
    rows = rows.select("seg", "slot", F.col("doc.ids").alias("id"), F.col("doc.keys").alias("key"), F.col("doc.sizes").alias("n_words"))
    joined = rows.join(each, ["seg", "slot"], "left").select("id", "key", "n_words", "runs", "items", "near")
    return joined.mapInArrow(_merged, f"id {kind}, key long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long, items array<string>, near array<string>")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", n: int = 10, slop: int = 0, near: int = 0, block: int = BLOCK) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, near, key.

    ``slop`` is that of the hits, ``near`` (0: none) that of a second search whose items are listed beside them.
    """
    return search(build_index(docs, id_col, text_col), bench, item_col, item_text, n, slop, near, block).withColumnRenamed("id", id_col)
