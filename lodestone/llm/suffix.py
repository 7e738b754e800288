"""Exact removal of repeated byte strings with a sparse suffix array.

1. Anchors. Of the 32-byte strings in each 100-byte window, the one with the smallest hash (leftmost of equals) is the
   window's anchor. Equal windows have their anchor at the same offset, so only suffixes at anchors (about 3 % of
   all) need sorting, each with the bytes before it that its windows take in.
2. Anchors are dealt by the hash of their leading 32 bytes, in packed blocks. Anchors whose leading bytes are
   alone in the corpus go. Copies with the same surroundings (all bytes of all windows of the anchor, told by 64 bits
   of hash where the leading bytes are equal) are settled here: all but the first are removed, the first stands for all. Copies within a block of
   a chunk's anchors are known to be gone when it is packed and are dealt evenly; so a bucket holds at most one anchor
   of a passage from each block of about 9 MB of text, however often it occurs.
3. Where surroundings differ, the suffixes are range-partitioned by their leading bytes with sampled splitters
   (ties by document and position, so that a frequent passage spreads over tasks), sorted in each bucket by
   multikey quicksort, and neighbours compared: with the common prefix of sorted suffixes and of sorted
   reversed left sides, two anchors share the window that starts ``o`` bytes before them if they agree on
   100 - o bytes to the right and o to the left.
4. Groups at a bucket's edge may go on in the next: their windows that are first in the bucket are compared
   across buckets by a 128-bit digest.

Cases: a null text is empty; very long texts are cut into overlapping pieces; equal strings go by document, then place; texts under ``width`` bytes lose nothing; matches never cross documents; rows that
repeat an id and its text count as one document and each get its row; rows of other texts that share an id are documents of their own, in the order of the texts' hashes; rows without an id lose nothing and
nothing is compared with them; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import CHUNK, U64, chunks, cut, mix, numbered, parts, planes, powers, prefix_sums, renumbered, span_hash, unplanes, utf8

KMER = 32
#: Bytes of text whose anchors share a bucket, and suffixes in a sorting bucket: they bound a task's memory.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 40_000
#: Texts over this many bytes are cut into overlapping pieces while anchors are sought.
PIECE = 1 << 20
HEAD = [("hk", U64), ("hc", U64), ("doc", np.int64), ("at", np.int64), ("lo", np.uint8), ("hi", np.uint8)]


def anchors(data: np.ndarray, off: np.ndarray, width: int):
    """Anchor positions, the hash of their leading bytes, and the nearest and farthest start of their windows."""
    n, spread = len(data), width - KMER + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 4 + (None,)
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    lead = mix((sums[KMER:] - sums[: n - KMER + 1]) * down[: n - KMER + 1])
    key = (lead >> U64(24) << U64(24)) | np.arange(len(lead), dtype=U64)
    size, least = 1, key
    while size * 2 <= spread:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < spread:
        least = np.minimum(least[: n - width + 1], least[spread - size : spread - size + n - width + 1])
    best = (least & U64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(n - width + 1)
    whole = np.zeros(n + 1, np.int32)  # windows that stay in one document
    ends = off[1:] - width + 1
    keep = ends > off[:-1]
    np.add.at(whole, off[:-1][keep], 1)
    np.add.at(whole, ends[keep], -1)
    ok = np.cumsum(whole[: n - width + 1]) > 0
    start, best = start[ok], best[ok]
    # windows with the same anchor follow one another; a document's first window begins a new run in any case
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(best)) - 1
    at = best[first]
    return at, lead[at], start[first], start[last], sums


def _found(batches, width: int, buckets: int, flush: int = 250_000):
    """Packed blocks of anchors by bucket."""
    held: list[tuple[np.ndarray, ...]] = []

    def emit():
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        # copies within the block: the first stands for all, the others need no hashes
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        cols = [c[order] for c in cols]
        again = np.zeros(len(order), bool)
        again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        again[1:] &= (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])
        # copies are gone whatever stands elsewhere: they may go to any bucket, so that no bucket holds all copies of a passage
        anywhere = mix(cols[2].astype(U64) * U64(31) + cols[3].astype(U64))
        bucket = (np.where(again, anywhere, cols[0] >> U64(20)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((again, bucket))
        cols, bucket, again = [c[order] for c in cols], bucket[order], again[order]
        edge = np.flatnonzero(np.diff(np.append(bucket, -1))) + 1
        at = 0
        ids, raws = [], []
        for to in edge:
            own = [c[at:to] for c in cols]
            k = int((~again[at:to]).sum())
            ids.append(int(bucket[at]))
            raws.append(k.to_bytes(8, "little") + b"".join([planes(own[0][:k]), planes(own[1][:k]), *(planes(c) for c in own[2:])]))
            at = to
        return pa.record_batch([pa.array(ids, pa.int32()), pa.array(raws, pa.binary())], ["bucket", "block"])

    count = 0
    for part in chunks(batches):
        ids = part.column("id").to_numpy(zero_copy_only=False)
        data, off = utf8(part.column("text"))
        for a, d, o, base in _pieces(data, off, width):
            at, hk, lo, hi, sums = anchors(d, o, width)
            if not len(at):
                continue
            row = np.searchsorted(o, at, "right") - 1
            hc = span_hash(sums, lo, hi + width) ^ mix(((at - lo) * 256 + (at - hi)).astype(U64))
            held.append((hk, hc, ids[a + row], at - o[row] + base, (at - hi).astype(np.uint8), (at - lo).astype(np.uint8)))
            count += len(at)
            if count >= flush:
                yield emit()
                count = 0
    if held:
        yield emit()


def _packed(batches):
    """Texts compressed for the shuffles."""
    for part in chunks(batches):
        data, off = utf8(part.column("text"))
        z = [pa.compress(data[a:b].tobytes(), "zstd", asbytes=True) if b > a else b"" for a, b in zip(off[:-1], off[1:], strict=True)]
        rest = [k for k in part.schema.names if k != "text"]
        yield pa.record_batch([pa.array(z, pa.binary()), pa.array(np.diff(off)), *(part.column(k) for k in rest)], ["z", "n_bytes", *rest])


def _opened(part) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed texts and where each row's bytes start and end."""
    sizes = part.column("n_bytes").to_numpy(zero_copy_only=False)
    raw = b"".join(bytes(pa.decompress(z.as_buffer(), n, "zstd")) for z, n in zip(part.column("z"), sizes.tolist(), strict=True) if n)
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _pieces(data, off, width):
    """A chunk as it is, or one very long document in overlapping pieces (each window lies in one piece)."""
    if len(off) != 2 or off[1] <= PIECE:
        yield 0, data, off, 0
        return
    for a in range(0, int(off[1]) - width + 1, PIECE):
        piece = data[a : a + PIECE + width - 1]
        yield 0, piece, np.array([0, len(piece)]), a


def _unpack(block: bytes):
    k = int.from_bytes(block[:8], "little")
    tail = sum(np.dtype(t).itemsize for _, t in HEAD[2:])
    n = (len(block) - 8 - 16 * k) // tail
    at, out = 8, []
    for i, (_, kind) in enumerate(HEAD):
        size = np.dtype(kind).itemsize * (k if i < 2 else n)
        out.append(unplanes(block[at : at + size], kind))
        at += size
    return k, out


def _settle(width: int):
    """All anchors of a bucket: intervals that go, and anchors that must be compared as suffixes."""

    def run(key, table):
        heads, gone = [], []
        for raw in table.column("block"):
            k, cols = _unpack(raw.as_py())
            heads.append([cols[0], cols[1], *(c[:k] for c in cols[2:])])
            gone.append([c[k:] for c in cols[2:]])
        hk, hc, doc, at, lo, hi = (np.concatenate(x) for x in zip(*heads, strict=True))
        order = np.lexsort((at, doc, hc, hk))
        hk, hc, doc, at, lo, hi = (x[order] for x in (hk, hc, doc, at, lo, hi))
        n = len(hk)
        same = np.zeros(n, bool)
        same[1:] = (hk[1:] == hk[:-1]) & (hc[1:] == hc[:-1])
        twin = same.copy()  # the same place of a repeated row
        twin[1:] &= (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        gone.append([x[same & ~twin] for x in (doc, at, lo, hi)])
        rest = np.flatnonzero(~same)
        h = hk[rest]
        alone = np.ones(len(rest), bool)
        if len(rest) > 1:
            e = h[1:] == h[:-1]
            alone[1:] &= ~e
            alone[:-1] &= ~e
        rest = rest[~alone]
        gdoc, gat, glo, ghi = (np.concatenate(x) for x in zip(*gone, strict=True))
        d = np.concatenate([gdoc, doc[rest]])
        s = np.concatenate([gat - ghi, at[rest]])
        # copies that another chunk's block had dropped are all later than their first, which was kept
        kind = np.concatenate([np.zeros(len(gdoc), bool), np.ones(len(rest), bool)])
        lo_, hi_ = np.concatenate([glo, lo[rest]]), np.concatenate([ghi, hi[rest]])
        e = np.where(kind, 0, s + hi_ - lo_ + width)
        return pa.table({"doc": d, "suffix": kind, "s": s, "e": e, "lo": lo_.astype(np.int16), "hi": hi_.astype(np.int16)})

    return run


SETTLED = "doc long, suffix boolean, s long, e long, lo short, hi short"


def _suffixes(width: int):
    """The suffixes at the wanted anchors, with their left sides reversed."""

    def run(batches):
        for part in chunks(batches, "z", CHUNK // 2):
            data, off = _opened(part)
            n = len(data)
            wanted = part.column("wanted")
            sizes = wanted.value_lengths().to_numpy(zero_copy_only=False)
            flat = wanted.flatten()
            at, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "lo", "hi"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            ids = part.column("id").to_numpy(zero_copy_only=False)[row]
            for a in range(0, len(at), 20_000):
                z = slice(a, a + 20_000)
                p = off[row[z]] + at[z]
                k = np.arange(width)
                right = np.where(k < (width - lo[z])[:, None], data[np.minimum(p[:, None] + k, n - 1)], 0).astype(np.uint8)
                j = np.arange(width - KMER)
                left = np.where(j < hi[z][:, None], data[np.maximum(p[:, None] - 1 - j, 0)], 0).astype(np.uint8)
                yield pa.record_batch(
                    [_fixed(right[:, :KMER]), _fixed(right[:, KMER:]), _fixed(left), pa.array(ids[z]), pa.array(at[z]), pa.array(lo[z].astype(np.int16)), pa.array(hi[z].astype(np.int16))], ["lead", "tail", "left", "doc", "at", "lo", "hi"]
                )

    return run


PACKED = "z binary, n_bytes long, id long"

SUFFIX = "lead binary, tail binary, left binary, doc long, at long, lo short, hi short"


def _fixed(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    off = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings.

    Strings are partitioned by one 8-byte character at a time; only parts of equal strings go on to the next
    character. All parts of a depth are partitioned together.
    """
    n, size = rows.shape
    order = np.arange(n)
    if n < 2:
        return order
    wide = np.zeros((n, -(-size // 8) * 8), np.uint8)
    wide[:, :size] = rows
    word = wide.view(">u8").astype(U64)
    part = np.zeros(n, np.int64)  # of each place in the order
    open_ = np.arange(n)  # places in parts that hold more than one string
    for depth in range(word.shape[1]):
        own = order[open_]
        w = word[own, depth]
        k = np.lexsort((w, part[open_]))
        order[open_] = own[k]
        w, p = w[k], part[open_][k]
        new = np.ones(len(k), bool)
        new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
        part[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        edge = np.flatnonzero(new)
        many = np.repeat(np.diff(np.append(edge, len(k))) > 1, np.diff(np.append(edge, len(k))))
        open_ = open_[many]
        if not len(open_):
            break
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each sorted string with the one before it."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 100_000):
        z = slice(a, min(a + 100_000, len(order)))
        differ = rows[order[z]] != rows[order[a - 1 : z.stop - 1]]
        out[z] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def _bucket(width: int, buckets: int):
    """Sort one bucket's suffixes; the intervals that go, and digests of windows of the groups at its edges.

    Digests leave in packed blocks, dealt by their first bytes.
    """

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        n = table.num_rows
        column = lambda k, size: utf8_free(table.column(k), n, size)
        right = np.concatenate([column("lead", KMER), column("tail", width - KMER)], axis=1)
        left = column("left", width - KMER)
        doc, at, lo, hi = (table.column(k).to_numpy().astype(np.int64) for k in ("doc", "at", "lo", "hi"))
        rank = np.lexsort((at, doc))
        own = np.ones(n, bool)  # repeated rows give a suffix each; one stands for them
        own[1:] = (doc[rank[1:]] != doc[rank[:-1]]) | (at[rank[1:]] != at[rank[:-1]])
        rank = rank[own]
        n = len(rank)
        right, left, doc, at, lo, hi = (x[rank] for x in (right, left, doc, at, lo, hi))
        order, order_l = multikey_quicksort(right), multikey_quicksort(left)
        lcp, lcp_l = _common(right, order), _common(left, order_l)
        group, group_l = np.zeros(n, np.int64), np.zeros(n, np.int64)
        group[order] = np.cumsum(lcp < KMER)
        edge = (group == group.min()) | (group == group.max())
        omin, omax = np.full(n, width), np.full(n, -1)
        digests, d_row, d_off = [], [], []
        for o in range(width - KMER + 1):
            ok = np.flatnonzero((lo <= o) & (o <= hi))
            if not len(ok):
                continue
            g = np.zeros(n, np.int64)
            g[order] = np.cumsum(lcp < width - o)
            group_l[order_l] = np.cumsum(lcp_l < o)
            _, first = np.unique((g[ok] << 32) | group_l[ok], return_index=True)  # rows are in the order of (doc, at)
            later = np.ones(len(ok), bool)
            later[first] = False
            again = ok[later]
            omin[again] = np.minimum(omin[again], o)
            omax[again] = np.maximum(omax[again], o)
            for r in ok[~later & edge[ok]]:
                digests.append(hashlib.blake2b(left[r, :o][::-1].tobytes() + right[r, : width - o].tobytes(), digest_size=16).digest())
                d_row.append(r)
                d_off.append(o)
        k = np.flatnonzero(omax >= 0)
        none = pa.nulls(len(k), pa.int32()), pa.nulls(len(k), pa.binary())
        yield pa.record_batch([pa.array(doc[k]), pa.array(at[k] - omax[k]), pa.array(at[k] - omin[k] + width), *none], ["doc", "s", "e", "bucket", "block"])
        r, o = np.array(d_row, np.int64), np.array(d_off, np.int64)
        raw = np.frombuffer(b"".join(digests), U64).reshape(-1, 2)
        bucket = (raw[:, 0] % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(np.append(-1, bucket[order])))
        ids, blocks = [], []
        for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
            z = order[a:b]
            ids.append(int(bucket[z[0]]))
            blocks.append(b"".join([planes(raw[z, 0]), planes(raw[z, 1]), planes(doc[r[z]]), planes(at[r[z]] - o[z])]))
        gone = pa.nulls(len(ids), pa.int64())
        yield pa.record_batch([gone, gone, gone, pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["doc", "s", "e", "bucket", "block"])

    return run


def _across(width: int):
    """Windows of a digest bucket that are not the first of their digest."""

    def run(key, table):
        cols = [[], [], [], []]
        for raw in table.column("block"):
            raw = raw.as_py()
            n = len(raw) // 32
            for i, kind in enumerate((U64, U64, np.int64, np.int64)):
                cols[i].append(unplanes(raw[8 * n * i : 8 * n * (i + 1)], kind))
        a, b, doc, s = (np.concatenate(x) for x in cols)
        order = np.lexsort((s, doc, b, a))
        a, b, doc, s = a[order], b[order], doc[order], s[order]
        later = np.zeros(len(a), bool)
        later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twin = np.zeros(len(a), bool)
        twin[1:] = later[1:] & (doc[1:] == doc[:-1]) & (s[1:] == s[:-1])
        k = later & ~twin
        return pa.table({"doc": doc[k], "s": s[k], "e": s[k] + width})

    return run


def utf8_free(column, n: int, size: int) -> np.ndarray:
    """A binary column whose values have ``size`` bytes each, as a matrix."""
    return np.frombuffer(b"".join(x.as_buffer() for c in column.chunks for x in c), np.uint8).reshape(n, size) if size else np.zeros((n, 0), np.uint8)


def _kept(with_text: bool, carried: bool = False):
    def run(batches):
        for part in chunks(batches, "z", CHUNK // 2):
            data, off = _opened(part)
            spans = part.column("spans")
            n_removed, n_spans, shas, texts = [], [], [], []
            for i in range(part.num_rows):
                own = data[off[i] : off[i + 1]]
                runs = merged(spans[i].as_py() or [], len(own))
                keep = np.ones(len(own), bool)
                for s, e in runs:
                    keep[s:e] = False
                left = own[keep].tobytes() if runs else own.tobytes()
                n_removed.append(len(own) - len(left))
                n_spans.append(len(runs))
                shas.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "ignore"))
            cols = [part.column("id"), pa.array(np.diff(off)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            if carried:
                cols.append(part.column("row"))
                names.append("row")
            yield pa.record_batch(cols, names)

    return run


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Disjoint maximal runs, ascending; runs that touch are one."""
    out: list[list[int]] = []
    for x in sorted((x["s"], min(x["e"], size)) if isinstance(x, dict) else x for x in spans):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        elif x[1] > x[0]:
            out.append(list(x))
    return [tuple(x) for x in out]


def removed_spans(docs: DataFrame, id_col: str, text_col: str, width: int = 100) -> DataFrame:
    """(doc, s, e): bytes that a string of ``width`` bytes covers which also starts earlier. Intervals may overlap."""
    if not KMER < width <= 255:
        raise ValueError(f"width must lie between {KMER + 1} and 255")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * parts(spark), int(total // BUCKET_BYTES) + 1)
    blocks = rows.mapInArrow(lambda b: _found(b, width, buckets), "bucket int, block binary")
    settled = cut(blocks.groupBy("bucket").applyInArrow(_settle(width), SETTLED))
    gone = settled.where(~F.col("suffix")).select("doc", "s", "e")
    wanted = settled.where("suffix").groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("s", "lo", "hi")).alias("wanted"))
    n = settled.where("suffix").count()
    suffixes = rows.mapInArrow(_packed, PACKED).join(wanted, "id").mapInArrow(_suffixes(width), SUFFIX)
    by_range = suffixes.repartitionByRange(max(parts(spark), n // BUCKET_ROWS + 1), "lead", "doc", "at")
    pool = parts(spark)
    compared = cut(by_range.mapInArrow(_bucket(width, pool), "doc long, s long, e long, bucket int, block binary"))
    within = compared.where("bucket is null").select("doc", "s", "e")
    across = compared.where("bucket is not null").groupBy("bucket").applyInArrow(_across(width), "doc long, s long, e long")
    return gone.unionAll(within).unionAll(across)


def _apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """Where rows with different texts share an id, ``docs`` with numbers in the order of id and text in place of ids, and the ids of the numbers; else as it is."""
    of = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_name"), F.xxhash64(F.col(text_col).cast("string")).alias("_key"))
    if not of.groupBy("_name").agg((F.max("_key") != F.min("_key")).alias("mixed")).where("mixed").limit(1).count():
        return docs, None
    keys = cut(of.distinct().orderBy("_name", "_key"))
    shape = T.StructType([*keys.schema.fields, T.StructField("_number", T.LongType())])
    names = cut(docs.sparkSession.createDataFrame(keys.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), shape))
    found = docs.join(names, (docs[id_col] == names["_name"]) & (F.xxhash64(docs[text_col].cast("string")) == names["_key"]), "left")
    return found.select(*(names["_number"].alias(c) if c == id_col else docs[c] for c in docs.columns)), names.select("_name", "_number")


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """One row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text and the columns in ``carry``.

    kept_text drops the rest of a character that a removed string cuts in two.
    """
    docs, names = numbered(docs, id_col)
    docs, shared = _apart(docs, id_col, text_col)
    spans = removed_spans(docs, id_col, text_col, width).groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    row = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row)
    out = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    out = out.add("kept_text", T.StringType()) if with_text else out
    out = out.add("row", rows.schema["row"].dataType) if carry else out
    packed = T.StructType([T.StructField("z", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("id", T.LongType())])
    packed = packed.add("row", rows.schema["row"].dataType) if carry else packed
    done = rows.mapInArrow(_packed, packed).join(spans, "id", "left").mapInArrow(_kept(with_text, bool(carry)), out)
    own = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    return renumbered(renumbered(done.select(*own, *(F.col("row").getField(c).alias(c) for c in carry or [])), shared, [id_col]), names, [id_col])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """The documents with repeated bytes taken out of their text, all columns in place; those of which nothing is left go."""
    docs, names = numbered(docs, id_col)
    docs, shared = _apart(docs, id_col, text_col)
    spans = removed_spans(docs, id_col, text_col, width).groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(*(c for c in docs.columns if c != text_col)).alias("row"))
    packed = T.StructType([T.StructField("z", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("id", T.LongType()), T.StructField("row", rows.schema["row"].dataType)])
    out = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
    done = rows.mapInArrow(_packed, packed).join(spans, "id", "left").mapInArrow(_kept(True, True), out.add("row", rows.schema["row"].dataType))
    left = done.where("kept_text <> '' OR n_bytes = 0")
    return renumbered(renumbered(left.select(*(F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns)), shared, [id_col]), names, [id_col])
