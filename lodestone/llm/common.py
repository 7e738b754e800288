"""Arrow and numpy helpers shared by the operators of this subpackage.

Texts arrive as Arrow string columns. Tokens and fingerprints are computed on the UTF-8 bytes of a
chunk of documents at once, without a Python object for each word. A chunk holds whole documents and
about ``CHUNK`` bytes, so a worker's memory follows the chunk and not the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..shipping import ship

#: Bytes of text that are tokenised at once; a longer document makes a chunk of its own.
CHUNK = 1 << 19

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 1))
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b & (2**64 - 1), U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (splitmix64): every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any stretch of ``codes``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches start..end; equal stretches have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each row's bytes start and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(batches, column: str = "text", size: int = CHUNK):
    """Split record batches into runs of rows with about ``size`` bytes in ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a chunk: their bounds in the bytes, their document and their 64-bit hash."""

    def __init__(self, column, hashes: bool = True):
        data, self.off = utf8(column)
        self.low = low = LOWER[data]
        n = len(low)
        w = IS_WORD[low]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = w[:-1], w[1:]
            before[self.off[:-1][self.off[:-1] < n]] = False
            after[self.off[1:][self.off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        #: first word of each document, and one more: the number of words
        self.first = np.searchsorted(self.start, self.off)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.hash = span_hash(prefix_sums(low), self.start, self.end) if hashes else None


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), then the same for the next."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, where: np.ndarray, number: np.ndarray) -> bool:
    """Whether every stretch has the bytes of the stretch ``where[number]``, in steps of bounded memory."""
    size = end - start
    if (size != size[where][number]).any():
        return False
    done = np.cumsum(size)
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(done, (done[at - 1] if at else 0) + (1 << 20), "right")), at + 1)
        if (data[ranges(start[at:to], size[at:to])] != data[ranges(start[where][number[at:to]], size[at:to])]).any():
            return False
        at = to
    return True


def planes(a: np.ndarray) -> bytes:
    """An integer array with its bytes in planes, so that the codec of the shuffle packs high zero bytes."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if raw else np.zeros(0, kind)


def checkpoint_dir(spark) -> None:
    """Make ``checkpoint()`` usable: the cluster's shared folder, or in local mode (tests), where none is set, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="lodestone-checkpoint-")
        context.setCheckpointDir(folder)


def cut(df):
    """Write ``df`` to the shared checkpoint folder and go on from there.

    A checkpoint keeps the size that Spark estimated for its plan. Joins multiply such estimates, so that a loop would
    square them in each round, up to numbers of millions of digits; the rows are taken without it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().logical().rdd(), done.schema(), False), spark)


def parts(spark) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark, sf_dir: str, name: str):
    """A table of the corpus; rows go to Python workers in batches that fit beside a full heap."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 2_000:
        spark.conf.set(key, "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with the ids in ``columns`` as numbers in their order, and the names of the numbers; whole numbers stay as they are (None)."""
    if all(isinstance(df.schema[c].dataType, T.IntegralType) for c in columns):
        return df, None
    ids = None
    for c in columns:
        one = df.select(F.col(c).alias("_name"))
        ids = one if ids is None else ids.unionByName(one)
    ids = cut(ids.where("_name is not null").distinct().orderBy("_name"))
    shape = T.StructType([T.StructField("_name", ids.schema["_name"].dataType), T.StructField("_number", T.LongType())])
    names = cut(df.sparkSession.createDataFrame(ids.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])), shape))
    return renumbered(df, names, columns, "_name", "_number"), names


def renumbered(df: DataFrame, names: DataFrame | None, columns, of: str = "_number", to: str = "_name") -> DataFrame:
    """``df`` with the ids in ``columns`` looked up in ``names``; as it is where there are none."""
    for c in columns if names is not None else ():
        side = names.select(F.col(of).alias("_of"), F.col(to).alias("_to"))
        df = df.join(side, df[c] == side["_of"], "left").select(*(F.col("_to").alias(c) if x == c else df[x] for x in df.columns))
    return df


#: Ids that may be broadcast to take rows out.
IDS = 1_000_000


def without(df: DataFrame, gone: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The rows of ``df`` of which (id, key) is not among the two columns of ``gone``; a null id equals a null id. A small ``gone`` moves, not ``df``."""
    gone = cut(gone.toDF("_gone", "_gone_key").distinct())
    gone = F.broadcast(gone) if gone.count() <= IDS else gone
    left = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("_id"), key.alias("_key"))
    return left.join(gone, (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone")), "left_anti").select("row.*")
