"""Byte-level BPE: texts to token ids and back, by replaying the merges of a vocabulary over the words of a corpus.

A text is split into pieces by the vocabulary's pattern, here as comparisons of character classes over whole blocks of
text. Pieces repeat: those of all documents are counted in Spark, and the most frequent ones (``KNOWN`` at most, so that
they may be broadcast) are encoded once for the corpus; what is left is encoded once for each block. Either is a replay
of merges: an index says for each pair that can merge at which places of which pieces it stands, the ranks are taken in
order, all places of a rank at once, and only the neighbours of merged places are looked at again.

A piece that is a token as a whole is that token. Of equal ranks the place further left goes first. Where a merge makes
a pair of a lower rank than its own, the piece is finished by itself, lowest rank first, as its order demands.

Cases: a null or empty text has no tokens; ids of characters that the vocabulary lacks are those of their bytes, so
every text comes back byte by byte; very long texts are taken block by block; equal counts are in or out together, so
that ties have no effect; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import U64, cut, parts, prefix_sums, ranges, same_bytes, span_hash, utf8

#: Pieces that are encoded once for the corpus, at most, and their bytes, at most; bytes of a block.
KNOWN, KNOWN_BYTES, BLOCK = 1 << 18, 48, 1 << 21
#: Pairs whose ranks a worker remembers (about 170 bytes each).
PAIRS = 1 << 18
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: White space as the pattern's ``\s`` has it.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # surrogates are no characters
    for kind, name in ((_LETTER, "L"), (_NUMBER, "N")):
        out[[ord(c) for run in regex.findall(rf"\p{{{name}}}+", every) for c in run]] = kind
    out[_SPACES] = _SPACE
    return out


def load(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def piece_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin in their UTF-8 bytes; ``off`` has where each text begins, and the end."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character begins
    kind = classes()[points]
    first = np.zeros(n + 3, bool)  # of a text
    first[np.searchsorted(place, off)] = True
    first[n:] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before anything else stands alone, or, a blank, goes with what follows.
    final = np.zeros(n, bool)
    final[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n]
    start |= final
    blank = np.flatnonzero(final & (points == 32))
    start[blank + 1] = False
    # An apostrophe by itself takes the letters of a contraction.
    near = np.append(points, np.zeros(3, np.uint32))
    start = np.append(start, np.ones(3, bool))
    at = np.flatnonzero((points == 39) & start[:n])
    at = at[~first[at + 1] & (classes()[near[at + 1]] == _LETTER)]
    one, two = near[at + 1], np.where(first[at + 2], 0, near[at + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    start[at[short] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 1] = start[at[long] + 2] = False
    start[at[long] + 3] = True
    # A contraction may begin where another ended, so that no letters before it are cut: both begin with an apostrophe.
    return place[start[:n]]


def safe_cut(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where letters or digits end, and so a piece, whatever stands before; else the end."""
    step = 1 << 12
    while at < len(data):
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        to = min(at + step, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to += 1
        window = data[at:to]
        kind = classes()[np.frombuffer(window.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        ends = np.flatnonzero(((kind[:-1] == _LETTER) | (kind[:-1] == _NUMBER)) & (kind[1:] != kind[:-1]))
        if len(ends):
            return at + int(np.flatnonzero((window & 0xC0) != 0x80)[ends[0] + 1])
        at, step = (to if to == len(data) else max(to - 4, at + 1)), step * 2
    return len(data)


def blocks(batch, size: int = BLOCK):
    """Blocks of about ``size`` bytes of a batch's texts: (bytes, bounds of the stretches, row of each stretch)."""
    data, off = utf8(batch.column(batch.schema.get_field_index("text")))
    cuts, rows = [], []
    begin = 0

    def block():
        return data[begin : cuts[-1]], np.array([begin, *cuts]) - begin, list(rows)

    for row in range(len(off) - 1):
        at, end = int(off[row]), int(off[row + 1])
        while True:
            to = end if end - at <= size else at + safe_cut(data[at:end], size)
            cuts.append(to)
            rows.append(row)
            at = to
            if cuts[-1] - begin >= size:
                yield block()
                begin, cuts, rows = cuts[-1], [], []
            if at >= end:
                break
    if rows:
        yield block()


def distinct(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces of a block, which of them stands at each place, and the places' starts."""
    start = piece_starts(data, off)
    end = np.append(start[1:], len(data)) if len(start) else start
    raw = data.tobytes()
    _, where, number = np.unique(span_hash(prefix_sums(data), start, end), return_index=True, return_inverse=True) if len(start) else (start, start, start)
    if not same_bytes(data, start, end, where, number):  # two pieces with one hash
        known: dict = {}
        number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())])
        return list(known), number, start
    return [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())], number, start


class Merges:
    """The ranks of a vocabulary and the replay of its merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}  # the rank to which two neighbours merge; -1: they do not

    def rank(self, left: int, right: int) -> int:
        key = left << 32 | right
        found = self.pair.get(key)
        if found is None:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            found = self.pair[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return found

    def finish(self, ids: list[int]) -> list[int]:
        """One piece by itself: the lowest rank first, of equal ranks the place further left."""
        while len(ids) > 1:
            best, at = min(((r, k) for k in range(len(ids) - 1) if (r := self.rank(ids[k], ids[k + 1])) >= 0), default=(-1, 0))
            if best < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit numbers."""
        out: list = [None] * len(pieces)
        ids: list[int] = []
        bounds, todo = [0], []
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            else:
                todo.append(k)
                ids += map(self.byte.__getitem__, p)
                bounds.append(len(ids))
        n = len(ids)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), set()
        for b in bounds[1:]:
            after[b - 1] = n
            if b < n:
                before[b] = -1
        index: dict[int, list[int]] = {}
        rank = self.rank
        for p in range(n):
            if after[p] < n and (r := rank(ids[p], ids[after[p]])) >= 0:
                index.setdefault(r, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            for p in sorted(index.pop(r)):
                q = after[p]
                if ids[p] < 0 or q >= n or rank(ids[p], ids[q]) != r:
                    continue  # merged or changed meanwhile
                ids[p], ids[q] = r, -1
                q = after[p] = after[q]
                if q < n:
                    before[q] = p
                lower = False
                for left in (before[p], p):
                    if left >= 0 and (right := after[left]) < n:
                        new = rank(ids[left], ids[right])
                        if 0 <= new < r:
                            lower = True
                        elif new >= 0:
                            if new not in index:
                                index[new] = []
                                heapq.heappush(heap, new)
                            index[new].append(left)
                if lower:
                    self._alone(ids, after, before, p, n)
        for k, a, b in zip(todo, bounds, bounds[1:]):
            out[k] = np.array([x for x in ids[a:b] if x >= 0], "<u4").tobytes()
        return out

    def _alone(self, ids, after, before, p, n) -> None:
        """Finish the piece of place ``p``; its places in the index come to nothing, as their neighbours are gone."""
        while before[p] >= 0:
            p = before[p]
        places = []
        while p < n:
            places.append(p)
            p = after[p]
        done = self.finish([ids[p] for p in places])
        for k, p in enumerate(places):
            ids[p] = done[k] if k < len(done) else -1
            after[p] = places[k + 1] if k + 1 < len(done) else n


def known_pieces(docs: DataFrame, ranks, most: int = KNOWN) -> dict[bytes, bytes]:
    """The ids of the most frequent pieces of a column ``text``: at most ``most`` of at most ``KNOWN_BYTES`` bytes."""
    spark = docs.sparkSession

    def count(batches):
        for batch in batches:
            for data, off, _ in blocks(batch):
                pieces, number, _ = distinct(data, off)
                yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.binary()), "n": pa.array(np.bincount(number, minlength=len(pieces)).astype(np.int64))})

    counts = docs.mapInArrow(count, "piece binary, n long").where(F.length("piece") <= KNOWN_BYTES).groupBy("piece").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")))
    total, least = 0, None
    for level, n in sorted(((r.level, r["count"]) for r in counts.groupBy("level").count().collect()), reverse=True):
        total += n
        if total > most:
            break
        least = level
    if least is None:
        return {}

    def encode(batches):
        pieces = [p for batch in batches for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.binary()), "ids": pa.array(_merges(ranks).replay(pieces), pa.binary())})

    found = counts.where(F.col("level") >= least).select("piece").repartition(parts(spark), "piece").mapInArrow(encode, "piece binary, ids binary").toArrow()
    return dict(zip(found["piece"].to_pylist(), found["ids"].to_pylist()))


_ready: dict = {}


def _merges(ranks) -> Merges:
    """Of a broadcast vocabulary, once for each worker."""
    if ranks.value is not _ready.get("ranks"):
        _ready.update(ranks=ranks.value, merges=Merges(ranks.value))
    return _ready["merges"]


def _batches(rows, schema: pa.Schema, size: int = 8 << 20):
    """Batches of rows of about ``size`` bytes in their last column."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[-1]) + 64
        if total >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _shape(docs: DataFrame, id_col: str):
    return docs.schema[id_col].dataType.simpleString()


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """The tokens of every text: the id column, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit numbers)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    box = spark.sparkContext.broadcast(ranks)
    common = spark.sparkContext.broadcast(known_pieces(docs.select("text"), box, known) if known else {})

    def coded(batch):
        ids, done = batch.column(0), []
        row = -1
        for data, off, rows in blocks(batch, BLOCK // 2):  # beside the broadcast pieces a worker holds less
            pieces, number, start = distinct(data, off)
            found = list(map(common.value.get, pieces))
            new = [k for k, x in enumerate(found) if x is None]
            for k, x in zip(new, _merges(box).replay([pieces[k] for k in new])):
                found[k] = x
            size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            flat = np.frombuffer(b"".join(found), "<u4")
            all_ids = flat[ranges((np.cumsum(size) - size)[number], size[number])] if len(number) else flat
            upto = np.append(0, np.cumsum(size[number]))[np.searchsorted(start, off)]
            for k, r in enumerate(rows):
                if r != row:
                    if row >= 0:
                        yield ids[row], b"".join(done)
                    row, done = r, []
                done.append(all_ids[upto[k] : upto[k + 1]].tobytes())
        if row >= 0:
            yield ids[row], b"".join(done)

    def run(batches):
        for batch in batches:
            schema = pa.schema([pa.field("id", batch.schema.field(0).type), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary())])
            yield from _batches(((i.as_py(), len(x) // 4, x) for i, x in coded(batch)), schema)

    return docs.mapInArrow(run, f"id {_shape(docs, id_col)}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of their tokens in a column ``to``; an id that is no token ends the job."""
    box = rows.sparkSession.sparkContext.broadcast(ranks)
    rows = rows.select("*", F.col(ids_col).alias(to))

    def run(batches):
        raw = sorted((r, b) for b, r in box.value.items())
        size = np.zeros(raw[-1][0] + 2, np.int64)
        size[[r for r, _ in raw]] = [len(b) for _, b in raw]
        flat, at = np.frombuffer(b"".join(b for _, b in raw), np.uint8), np.cumsum(size) - size
        for batch in batches:
            out = []
            for x in batch.column(batch.num_columns - 1):
                ids = np.frombuffer(x.as_buffer() or b"", "<u4") if x.is_valid else np.zeros(0, "<u4")
                if (ids >= len(size)).any() or not size[ids].all():
                    raise ValueError("an id is no token of the vocabulary")
                out.append(b"".join(flat[ranges(at[ids[k : k + BLOCK // 4]], size[ids[k : k + BLOCK // 4]])].tobytes() for k in range(0, len(ids), BLOCK // 4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
