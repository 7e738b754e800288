"""Quality by co-training of a text view and a metadata view.

The text view sees shares of hashed byte trigrams of the whole text. The metadata view sees what is known without
reading it: source, language, length, lines and characters in a line, each hashed or binned. Both are logistic
regressions. In each round a view scores all unlabelled documents; its most confident documents of either class, in the
proportion of the classes and from all strata (buckets of source and language) in turn, join the training rows of the
other view. At the end each view is calibrated on
labelled rows that neither was trained on, and the two calibrated logits are combined by a logistic fit on them.

Fitting takes at most ``LABELLED`` labelled documents and, a round and view, ``TAKE`` unlabelled ones or one of each stratum
and class, if that is more; all unlabelled documents compete for these places.

Cases: null source, language or length have a bucket of their own; a null text counts as empty and is scored by its
metadata and an empty trigram profile; with labels of one class only, every score is that class; with none, 0.5;
repeated rows, rows without an id and rows that share an id each get their row; ids may be of any type; documents with
equal confidence go by the smaller id; very long texts are profiled whole, in chunks of whole documents; an empty table
gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import chunks, cut, utf8

#: Documents in the labelled sample, at most.
LABELLED = 3_000
ROUNDS, TAKE, BITS, META = 3, 200, 10, 128
SCALE = 256.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    n = max(len(data) - 2, 0)
    a = data.astype(np.uint32)
    h = (a[:n] | a[1 : n + 1] << 8 | a[2 : n + 2] << 16) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _profile(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of trigram buckets, a row for each document."""
    g = _trigrams(data)
    out = np.zeros((len(off) - 1, 1 << BITS), np.float32)
    for i in range(len(off) - 1):
        own = g[off[i] : max(off[i + 1] - 2, off[i])]
        if len(own):
            out[i] = np.bincount(own, minlength=1 << BITS) * (SCALE / len(own))
    return out


def _mean_weight(data: np.ndarray, off: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The text view's product with ``weight`` without the profile: a sum over the document's trigrams."""
    g = _trigrams(data)
    s = np.zeros(len(g) + 1)
    np.cumsum(weight[g], out=s[1:])
    end = np.maximum(off[1:] - 2, off[:-1])
    n = end - off[:-1]
    at, to = np.minimum(off[:-1], len(g)), np.minimum(end, len(g))
    return (s[to] - s[at]) * (SCALE / np.maximum(n, 1))


def meta_columns(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, chars_col: str) -> list:
    """Buckets of the metadata (five numbers below ``META``), computed in Spark."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chars = F.coalesce(F.col(chars_col).cast("long"), F.lit(-1)) if chars_col in docs.columns else F.length(text).cast("long")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    binned = lambda x, base: F.least(F.floor(F.log2(F.greatest(x, F.lit(1)))).cast("int"), F.lit(15)) + base
    hashed = lambda c, n, base: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))), F.lit(n)).cast("int") + base
    return [hashed(source_col, 64, 0), hashed(lang_col, 16, 64), F.when(chars < 0, 95).otherwise(binned(chars, 80)), binned(lines, 96), binned(F.length(text) / lines, 112)]


def _onehot(meta: np.ndarray) -> np.ndarray:
    out = np.zeros((len(meta), META), np.float32)
    out[np.arange(len(meta))[:, None], meta] = 1
    return out


class Logistic:
    """Logistic regression on scaled features, by accelerated gradient steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float, steps: int = 100):
        self.mean, spread = x.mean(0), x.std(0) + 0.02
        z = ((x - self.mean) / spread).astype(np.float32)
        w, b, u, c = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
        rate = 4.0 / (1.0 + float((z * z).sum(1).mean()))
        for k in range(steps):
            m = k / (k + 3)
            wm, bm = w + m * (w - u), b + m * (b - c)
            e = (1 / (1 + np.exp(-np.clip(z @ wm + bm, -30, 30))) - y).astype(np.float32)
            u, c = w, b
            w = (wm - rate * (z.T @ e / len(y) + shrink * wm)).astype(np.float32)
            b = bm - rate * float(e.mean())
        self.weight = (w / spread).astype(np.float64)
        self.offset = float(b - (self.mean / spread) @ w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.offset


class CoTrained:
    """The two views, their calibration and their combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, most_confident):
        from .toxicity import _platt

        self.prior = float(y.mean()) if len(y) else 0.5
        self.views = None
        if not len(y) or y.min() == y.max():
            return
        hold = np.arange(len(y)) % 4 == 3
        if hold.sum() < 20 or y[hold].min() == y[hold].max():
            hold = np.zeros(len(y), bool)
        x = [text[~hold], meta[~hold]]
        rows = [(x[0], y[~hold]), (x[1], y[~hold])]
        taken: list[list[int]] = [[], []]
        for k in range(ROUNDS + 1):
            self.views = [Logistic(*rows[0], 1e-3), Logistic(*rows[1], 1e-3)]
            if k == ROUNDS:
                break
            for taker, (ids, more, label) in enumerate(most_confident(self.views, taken, self.prior)):
                if len(ids):
                    rows[taker] = (np.concatenate([rows[taker][0], more]), np.concatenate([rows[taker][1], label]))
                    taken[taker] += ids
        ct, cm, cy = (text[hold], meta[hold], y[hold]) if hold.any() else (text, meta, y)
        logits = [self.views[0].logit(ct), self.views[1].logit(cm)]
        self.calibration = [_platt(q, cy) for q in logits]
        z = np.stack([a * q + b for (a, b), q in zip(self.calibration, logits, strict=True)], 1)
        self.combine = Logistic(z.astype(np.float32), cy, 1e-3)

    def scores(self, q_text: np.ndarray, q_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of the text view, the metadata view and both."""
        if self.views is None:
            out = np.full(len(q_text), self.prior)
            return out, out, out
        z = np.stack([a * q + b for (a, b), q in zip(self.calibration, (q_text, q_meta), strict=True)], 1)
        p = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        return p(z[:, 0]), p(z[:, 1]), p(self.combine.logit(z))


def _features(batches):
    for part in chunks(batches):
        data, off = utf8(part.column("text"))
        t = _profile(data, off).astype(np.float16)
        yield pa.record_batch([part.column("id"), part.column("y"), pa.array([r.tobytes() for r in t], pa.binary()), part.column("meta")], ["id", "y", "profile", "meta"])


def _scored(shared):
    def run(batches):
        model: CoTrained = shared.value
        for part in chunks(batches):
            data, off = utf8(part.column("text"))
            meta = part.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, 5)
            if model.views is None:
                q = np.zeros(part.num_rows), np.zeros(part.num_rows)
            else:
                q = _mean_weight(data, off, model.views[0].weight) + model.views[0].offset, model.views[1].weight[meta].sum(1) + model.views[1].offset
            yield pa.record_batch([part.column("id"), *(pa.array(s) for s in model.scores(*q))], ["id", "p_text", "p_meta", "score"])

    return run


def _confident(shared):
    """The documents that a view is sure of: id, stratum, taker, class, confidence."""

    def run(batches):
        views, taken = shared.value
        gone = [np.array(t, np.int64) for t in taken]
        for part in chunks(batches):
            data, off = utf8(part.column("text"))
            meta = part.column("meta").flatten().to_numpy(zero_copy_only=False).reshape(-1, 5)
            ids = part.column("id").to_numpy()
            both = _mean_weight(data, off, views[0].weight) + views[0].offset, views[1].weight[meta].sum(1) + views[1].offset
            for taker, q in ((1, both[0]), (0, both[1])):
                at = np.flatnonzero((np.abs(q) > 1) & ~np.isin(ids, gone[taker]))
                yield pa.record_batch([pa.array(ids[at]), pa.array(meta[at, 0].astype(np.int64) * META + meta[at, 1]), pa.array(np.full(len(at), taker, np.int32)), pa.array((q[at] > 0).astype(np.int32)), pa.array(np.abs(q[at]))], ["id", "stratum", "taker", "y", "sure"])

    return run


def _number(df: DataFrame, id_col: str):
    """A whole number for an id: itself, or a 64-bit hash of another type, which only picks the sample."""
    c = F.col(id_col)
    return c.cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.when(c.isNotNull(), F.xxhash64(c))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", source_col="source", lang_col="lang", chars_col="n_chars", labelled: int = LABELLED) -> CoTrained:
    """A model from the labelled documents with the smallest id hashes and the unlabelled ones that the views are surest of."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(_number(labels, id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    meta = F.array(*meta_columns(docs, id_col, text_col, source_col, lang_col, chars_col))
    rows = docs.select(_number(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"), meta.alias("meta")).where("id is not null")
    some = known.join(rows.select(F.col("id").alias("_id")), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(labelled)

    def features(wanted: DataFrame):
        """ids, profiles, one-hot metadata and labels of the wanted (_id, _y), in a fixed order."""
        own = rows.join(F.broadcast(wanted), F.col("id") == F.col("_id")).select("id", F.col("_y").alias("y"), "text", "meta")
        got = own.mapInArrow(_features, "id long, y int, profile binary, meta array<int>").dropDuplicates(["id"]).collect()
        got.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15) & (2**64 - 1))
        text = np.stack([np.frombuffer(r[2], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, 1 << BITS), np.float32)
        return [r[0] for r in got], text, _onehot(np.array([r[3] for r in got], np.int64).reshape(-1, 5)), np.array([r[1] for r in got], np.float32)

    def most_confident(views, taken, prior):
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast((views, taken))
        sure = rows.mapInArrow(_confident(shared), "id long, stratum long, taker int, y int, sure double")
        sure = sure.join(known.select(F.col("_id").alias("id")), "id", "left_anti")
        place = F.row_number().over(Window.partitionBy("taker", "y", "stratum").orderBy(F.desc("sure"), "id"))
        found = cut(sure.withColumn("place", place).where(F.col("place") <= TAKE))
        strata = found.select("stratum").distinct().count()
        good = max(1, round(TAKE * prior))
        out = []
        for taker in (0, 1):
            chosen: dict[int, int] = {}
            for y, n in ((0, max(1, TAKE - good)), (1, good)):
                for r in found.where((F.col("taker") == taker) & (F.col("y") == y)).orderBy("place", F.desc("sure"), "id").limit(max(n, strata)).collect():
                    chosen.setdefault(r.id, y)
            if not chosen:
                out.append(([], None, None))
                continue
            ids, text, onehot, label = features(spark.createDataFrame(list(chosen.items()), "_id long, _y int"))
            out.append((ids, (text, onehot)[taker], label))
        return out

    _, text, onehot, y = features(some)
    return CoTrained(text, onehot, y, most_confident)


def classify(docs: DataFrame, model: CoTrained, id_col="doc_id", text_col="text", source_col="source", lang_col="lang", chars_col="n_chars", threshold: float = 0.5) -> DataFrame:
    """One row for each document: id, p_text, p_meta, score, keep."""
    meta = F.array(*meta_columns(docs, id_col, text_col, source_col, lang_col, chars_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), meta.alias("meta"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInArrow(_scored(shared), f"id {kind}, p_text double, p_meta double, score double")
    return out.withColumn("keep", F.col("score") >= threshold).withColumnRenamed("id", id_col)
