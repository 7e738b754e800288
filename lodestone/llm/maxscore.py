"""Exact top-k inner products by MaxScore over posting lists of signed integer vectors.

Each component becomes floor(256 * x). A shard is a chunk of candidate rows. For each component and sign it has posting
lists by impact: the rows with the most extreme values, then the next ones, in the tiers of ``TIERS``; which sign a query
traverses follows from its weight. A row outside a component's lists adds no more than the largest value outside them,
and a row in a tier no more than the tier's largest value, so

    bound of a row = sum over components of the bound outside + the excess of the tier that holds it.

With the k-th best score so far as the threshold, lists are non-essential as long as rows that stand in no other list
cannot reach the threshold: cheap excesses and long lists first. Rows in an essential list are candidates; their
components are probed in blocks, largest first, as long as the partial score plus the rest's bound can compete. Rows
whose bound equals the threshold stay, so ties are exact. Thresholds start from the scores of a few rows, which can only
be too low. Each task returns its own k best for each query, and the shards are merged by rank.

Queries travel to the workers in blocks of ``BLOCK`` rows, one block and one pass over all rows at a time.

Cases: vectors that are null or hold a null or non-finite component take no part; shorter vectors count as
padded with zeros; components and scores beyond 64 bits are cut to the largest; a repeated candidate id gives a row for each copy; rows without an id take no
part; equal scores go to the smaller id; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import cut, numbered, renumbered

#: Queries sent to the workers at a time, rows of a shard, rows whose scores start the thresholds.
BLOCK, SHARD, SEED = 16_384, 4_096, 1_024
#: Shares of a shard's rows at which its lists end, and components probed at a time.
TIERS, PROBE = (1 / 64, 1 / 16, 1 / 4, 1 / 2), 8
#: Largest component.
LARGEST = 2**62


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their integer components padded with zeros to the longest."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = ~np.isfinite(x)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    ok[row[bad]] = False
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = ok[row]
    with np.errstate(over="ignore"):
        out[row[good], place[good]] = np.clip(np.floor(256.0 * x[good]), -float(LARGEST), float(LARGEST)).astype(np.int64)
    return ok, out[ok]


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _safe(v: np.ndarray, q: np.ndarray) -> bool:
    """Whether all products and sums fit 62 bits."""
    top = lambda m: int(np.abs(m).max(initial=0))
    return top(v) * top(q) * max(v.shape[-1], 1) < LARGEST


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``v`` with ``q``, cut to 64 bits."""
    if _safe(v, q):
        return (v * q).sum(1)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(r, q, strict=True)), low), high) for r in v], np.int64)


class Shard:
    """The lists of a chunk of rows and their bounds."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        n, d = v.shape
        self.ids, self.v = ids, v
        self.order = np.argsort(v, axis=0, kind="stable").T  # of each component, rows by value
        self.ends = np.array(sorted({min(max(round(n * t), 1), n) for t in TIERS}))  # rows in the lists of the first tiers
        begin = np.append(0, self.ends)  # the last is what stands outside
        at = np.minimum(begin, n - 1)
        value = np.take_along_axis(v.T, self.order, 1)
        self.most, self.least = value[:, n - 1 - at], value[:, at]  # largest and smallest value of each tier, and outside
        if begin[-1] >= n:  # no row stands outside
            self.most[:, -1], self.least[:, -1] = value[:, 0], value[:, n - 1]

    def essential(self, q: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray] | None:
        """(component, tier) of the essential lists; None if rows outside every list compete too."""
        bound = np.where((q > 0)[:, None], q[:, None] * self.most, q[:, None] * self.least)
        base = int(bound[:, -1].sum())
        if base >= floor:
            return None
        excess = bound[:, :-1] - bound[:, 1:]  # of each tier over the next, down to the outside
        price = np.maximum.accumulate((excess / np.diff(np.append(0, self.ends)))[:, ::-1], axis=1)[:, ::-1]
        j, t = np.unravel_index(np.lexsort((-np.tile(np.arange(excess.shape[1]), len(q)), price.ravel())), excess.shape)
        reach = base + np.cumsum(excess[j, t])
        k = int(np.searchsorted(reach, floor))
        return j[k:], t[k:]

    def candidates(self, q: np.ndarray, floor: float) -> np.ndarray:
        """Rows that stand in an essential list."""
        n = len(self.ids)
        lists = self.essential(q, floor) if floor > -np.inf and _safe(self.v, q) else None
        if lists is None:
            return np.arange(n)
        mark = np.zeros(n, bool)
        begin = np.append(0, self.ends)
        for j, t in zip(*lists, strict=True):
            if q[j]:
                mark[self.order[j, n - begin[t + 1] : n - begin[t]] if q[j] > 0 else self.order[j, begin[t] : begin[t + 1]]] = True
        return np.flatnonzero(mark)

    def search(self, q: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best given the threshold ``floor``, and their scores."""
        rows = self.candidates(q, floor)
        rows = rows[self.ids[rows] != own]
        if not _safe(self.v, q):
            return rows, products(self.v[rows], q)
        best = np.where(q > 0, q * self.most[:, 0], q * self.least[:, 0])
        probe = np.argsort(-best, kind="stable")
        rest = np.append(np.cumsum(best[probe][::-1])[::-1], 0)
        score = np.zeros(len(rows), np.int64)
        for a in range(0, len(probe), PROBE):
            j = probe[a : a + PROBE]
            score += (self.v[np.ix_(rows, j)] * q[j]).sum(1)
            if floor > -np.inf:
                ok = score + rest[min(a + PROBE, len(probe))] >= floor
                if not ok.all():
                    rows, score = rows[ok], score[ok]
        return rows, score


def seeded(own: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among some rows other than its own; minus infinity where they are fewer."""
    out = np.full(len(own), -np.inf)
    if len(ids) <= k:
        return out
    d = max(v.shape[1], q.shape[1])
    v, q = _wide(v, d), _wide(q, d)
    if int(np.abs(v).max(initial=0)) * int(np.abs(q).max(initial=0)) * d >= 2**52:  # floats would round
        return out
    for a in range(0, len(own), 1024):
        score = q[a : a + 1024].astype(np.float64) @ v.T.astype(np.float64)
        score[own[a : a + 1024][:, None] == ids[None]] = -np.inf
        out[a : a + 1024] = np.partition(score, -k, axis=1)[:, -k]
    return out


def _local(queries, k: int):
    def run(batches):
        own, q, start = queries.value
        ids = [np.zeros(0, np.int64)] * len(own)
        scores = [np.zeros(0, np.int64)] * len(own)
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                ok, v = quantised(part.column("vector"))
                if not len(v):
                    continue
                d = max(v.shape[1], q.shape[1])
                shard, wide = Shard(part.column("id").to_numpy(zero_copy_only=False)[ok], _wide(v, d)), _wide(q, d)
                for i in range(len(own)):
                    floor = max(start[i], scores[i][k - 1] if len(scores[i]) >= k else -np.inf)
                    rows, score = shard.search(wide[i], own[i], floor, k)
                    if len(rows):
                        s, t = np.append(scores[i], score), np.append(ids[i], shard.ids[rows])
                        top = np.lexsort((t, -s))[:k]
                        scores[i], ids[i] = s[top], t[top]
        sizes = [len(s) for s in scores]
        if sum(sizes):
            yield pa.record_batch([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows other than its own, ties to the smaller id."""
    if not isinstance(rows.schema[id_col].dataType, T.IntegralType):  # one numbering for both
        _, names = numbered(rows.select(id_col).unionByName(queries.select(id_col)), id_col)
        of = lambda df: renumbered(df.select(id_col, vector_col), names, [id_col], "_name", "_number")
        return renumbered(top_k(of(queries), of(rows), id_col, vector_col, k, block), names, ["query_id", "vec_id"])
    spark = rows.sparkSession
    take = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")
    some = take(rows).limit(SEED).collect()
    ok, v = quantised(pa.array([r[1] for r in some], pa.list_(pa.float64())))
    ids = np.array([r[0] for r in some], np.int64)[ok]
    found, held = [], []

    def search():
        own = np.array([r[0] for r in held], np.int64)
        ok, q = quantised(pa.array([r[1] for r in held], pa.list_(pa.float64())))
        if ok.any():
            shared = spark.sparkContext.broadcast((own[ok], q, seeded(own[ok], q, ids, v, k)))
            found.append(cut(take(rows).mapInArrow(_local(shared, k), "query_id long, vec_id long, score long")))
            shared.unpersist()
        held.clear()

    for r in take(queries).toLocalIterator():
        held.append(r)
        if len(held) == block:
            search()
    search() if held else None
    every = found[0] if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    for x in found[1:]:
        every = every.unionAll(x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
