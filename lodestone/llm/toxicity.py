"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as a learned vector of the word (words of the training sample; others share one) joined to
its characters: a vector of its first ``STEM_BYTES`` bytes and the mean of learned vectors of its character trigrams. Windows of ``WINDOW`` words that overlap by half cover
the whole text. Two GRUs read a window in both directions, attention weighs their states, and a linear layer
gives the window's logit. A document is told by its largest logit, the expected number of toxic windows and the
number of windows; logistic calibration on sample documents that the network has not seen turns these into a
probability, with the classes weighed as they are found among all labels.

Training takes at most ``SAMPLE`` documents of each class. As only documents are labelled, each gives the ``TAKEN`` windows
that look most suspicious by the log odds of its words and their beginnings, and clean documents one more at random.

Cases: a null, empty or wordless text has one window without words and gets that window's calibrated score; documents
shorter than a window have one; without labels of both classes every score is the share of the class seen (0
without labels); repeated rows and rows that share an id each get their row, judged by their own text; very long texts are
read whole, window by window; windows with equal scores are as good as each other, as only their largest score and their
sum count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U64, Words, chunks, mix

#: Documents of each class in the training sample, at most; words of the vocabulary, at most.
SAMPLE, VOCABULARY = 2_000, 20_000
WINDOW, STRIDE = 32, 16
WORD, STEM, CHAR, HIDDEN, ATTEND, CHAR_BITS, STEM_BYTES = 6, 4, 4, 8, 8, 12, 6
EPOCHS, BATCH, RATE, TAKEN = 6, 128, 0.01, 3
CHUNK = 1 << 19


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start word and document of every window; each document has at least one."""
    n = np.diff(first)
    count = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + k * STRIDE, doc


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each word with its edges marked, and where each word's begin."""
    size = w.end - w.start
    at = np.cumsum(size) - size
    own = np.repeat(w.start - at, size) + np.arange(int(size.sum()))
    c = w.low[own].astype(np.int64) + 1 if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(c)) - np.repeat(at, size)
    before, after = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    before[1:], after[:-1] = c[:-1], c[1:]
    before[place == 0] = 0
    after[place == np.repeat(size, size) - 1] = 0
    h = mix((before | c << 9 | after << 18).astype(U64))
    return (h >> U64(64 - CHAR_BITS)).astype(np.int64), at


def stems(w: Words) -> np.ndarray:
    """The first bytes of each word as a number."""
    out = np.zeros(len(w.start), U64)
    for k in range(STEM_BYTES):
        at = w.start + k
        ok = np.flatnonzero(at < w.end)
        out[ok] |= w.low[at[ok]].astype(U64) << U64(8 * k)
    return out


def number(vocab: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + the place of each key in the sorted vocabulary; 0 where it is not there."""
    if not len(vocab):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(vocab, keys), len(vocab) - 1)
    return np.where(vocab[at] == keys, at + 1, 0)


class Network:
    """The parameters and the passes through them."""

    def __init__(self, vocab: np.ndarray, odds: np.ndarray, stem_vocab: np.ndarray, stem_odds: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = WORD + STEM + CHAR, HIDDEN
        init = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.vocab, self.stem_vocab = vocab, stem_vocab
        self.p = {"word": init(len(vocab) + 1, WORD) * 0.3, "stem": init(len(stem_vocab) + 1, STEM) * 0.3, "char": init(1 << CHAR_BITS, CHAR)}
        self.p["word"][1:, 0] = np.clip(odds, -2, 2)
        self.p["stem"][1:, 0] = np.clip(stem_odds, -2, 2)
        self.p["word"][0] = self.p["stem"][0] = 0
        for k in "fb":
            self.p |= {f"x{k}": init(d, 3 * h), f"h{k}": init(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p |= {"att": init(2 * h, ATTEND), "v": init(ATTEND), "out": init(2 * h), "bias": np.zeros(1, np.float32)}
        self.calibration = np.array([1.0, 0.0, 0.0, 0.0])

    def inputs(self, w: Words) -> np.ndarray:
        """The vector of each word."""
        if not len(w.hash):
            return np.zeros((0, WORD + STEM + CHAR), np.float32)
        g, at = trigrams(w)
        size = (w.end - w.start)[:, None]
        return np.concatenate([self.p["word"][number(self.vocab, w.hash)], self.p["stem"][number(self.stem_vocab, stems(w))], np.add.reduceat(self.p["char"][g], at, axis=0) / size], 1).astype(np.float32)

    def states(self, x: np.ndarray, real: np.ndarray, k: str, trace: list | None = None) -> np.ndarray:
        """States of one direction; x: projected inputs [time, windows, 3 hidden]; padding keeps the state."""
        h, wh = HIDDEN, self.p[f"h{k}"]
        now = np.zeros((x.shape[1], h), np.float32)
        out = np.zeros((x.shape[0], x.shape[1], h), np.float32)
        for t in range(x.shape[0]) if k == "f" else range(x.shape[0] - 1, -1, -1):
            hu = now @ wh
            zr = sigmoid(x[t, :, : 2 * h] + hu[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * hu[:, 2 * h :])
            new = n + z * (now - n)
            m = real[t][:, None]
            if trace is not None:
                trace.append((t, now, hu, z, r, n, m))
            now = np.where(m, new, now)
            out[t] = now
        return out

    def pooled(self, s: np.ndarray, real: np.ndarray):
        """Attention over time; windows without words pool to zero."""
        e = np.tanh(s @ self.p["att"])
        a = np.where(real, e @ self.p["v"], np.float32(-1e9))
        a = np.exp(a - a.max(0)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        return e, a, (a[:, :, None] * s).sum(0)

    def logits(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows over the rows of ``words`` (one vector for each word)."""
        out = np.zeros(len(start), np.float32)
        pad = np.concatenate([words, np.zeros((1, words.shape[1]), np.float32)])
        project = {k: pad @ self.p[f"x{k}"] + self.p[f"c{k}"] for k in "fb"}
        for a in range(0, len(start), 4096):
            z = slice(a, a + 4096)
            t = np.arange(int(size[z].max(initial=1)) or 1)[:, None]
            real = t < size[z][None]
            at = np.where(real, start[z][None] + t, len(words))
            s = np.concatenate([self.states(project[k][at], real, k) for k in "fb"], 2)
            out[z] = self.pooled(s, real)[2] @ self.p["out"] + self.p["bias"][0]
        return out

    def gradients(self, ids, stem, tri, tri_at, tri_n, real, y, weight):
        """Loss gradients of a batch of windows; ids [time, windows], tri: trigram buckets of all words in that order."""
        p, h = self.p, HIDDEN
        t_, n_ = ids.shape
        c = np.zeros((t_ * n_, CHAR), np.float32)
        some = np.flatnonzero(tri_n)
        if len(some):
            c[some] = np.add.reduceat(p["char"][tri], tri_at[some], axis=0) / tri_n[some][:, None]
        x = np.concatenate([p["word"][ids], p["stem"][stem], c.reshape(t_, n_, CHAR)], 2)
        trace = {k: [] for k in "fb"}
        s = np.concatenate([self.states(x @ p[f"x{k}"] + p[f"c{k}"], real, k, trace[k]) for k in "fb"], 2)
        e, a, pool = self.pooled(s, real)
        q = sigmoid(pool @ p["out"] + p["bias"][0])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((q - y) * weight / len(y)).astype(np.float32)
        g["out"], g["bias"][0] = pool.T @ dl, dl.sum()
        dpool = dl[:, None] * p["out"]
        da = (dpool[None] * s).sum(2)
        ds = a[:, :, None] * dpool[None]
        da = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnk->k", da, e)
        de = da[:, :, None] * p["v"] * (1 - e * e)
        g["att"] = np.einsum("tni,tnk->ik", s, de)
        ds += de @ p["att"].T
        dx = np.zeros_like(x)
        for j, k in enumerate("fb"):
            dh = np.zeros((n_, h), np.float32)
            own = ds[:, :, j * h : (j + 1) * h]
            for t, old, hu, z, r, n, m in reversed(trace[k]):
                dh = dh + own[t]
                d = np.where(m, dh, 0)
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (old - n) * z * (1 - z)
                dr = dn * hu[:, 2 * h :] * r * (1 - r)
                dxp = np.concatenate([dz, dr, dn], 1)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                g[f"x{k}"] += x[t].T @ dxp
                g[f"c{k}"] += dxp.sum(0)
                g[f"h{k}"] += old.T @ dhu
                dx[t] += dxp @ p[f"x{k}"].T
                dh = np.where(m, d * z, dh) + dhu @ p[f"h{k}"].T
        np.add.at(g["word"], ids, dx[:, :, :WORD])
        np.add.at(g["stem"], stem, dx[:, :, WORD : WORD + STEM])
        g["word"][0] = g["stem"][0] = 0
        if len(some):
            dc = dx[:, :, WORD + STEM :].reshape(-1, CHAR)[some] / tri_n[some][:, None]
            np.add.at(g["char"], tri, np.repeat(dc, tri_n[some], axis=0))
        return g

    def train(self, w: Words, start: np.ndarray, size: np.ndarray, y: np.ndarray, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        word, stem = number(self.vocab, w.hash), number(self.stem_vocab, stems(w))
        pick = lambda of, real, place: np.where(real, of[place] if len(of) else 0, 0)
        g, at = trigrams(w)
        count = w.end - w.start
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(start))
            for a in range(0, len(order), BATCH):
                b = order[a : a + BATCH]
                t = np.arange(max(int(size[b].max()), 1))[:, None]
                real = t < size[b][None]
                place = np.where(real, start[b][None] + t, 0)
                n = np.where(real, count[place] if len(count) else 0, 0).reshape(-1)
                own = np.repeat(at[place].reshape(-1) if len(at) else np.zeros(0, np.int64), n)
                begin = np.cumsum(n) - n
                tri = g[own + np.arange(len(own)) - np.repeat(begin, n)] if len(own) else g[:0]
                grads = self.gradients(pick(word, real, place), pick(stem, real, place), tri, begin, n, real, y[b], weight[b])
                step += 1
                rate = RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in grads.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)

    def evidence(self, w: Words) -> np.ndarray:
        """Largest logit, log of the expected number of toxic windows and log of the number of windows of each document."""
        if not len(w.n):
            return np.zeros((0, 3))
        start, doc = windows(w.first)
        logit = self.logits(self.inputs(w), start, np.minimum(w.first[1:][doc] - start, WINDOW)).astype(np.float64)
        at = np.searchsorted(doc, np.arange(len(w.n)))
        return np.stack([np.maximum.reduceat(logit, at), np.log(np.add.reduceat(sigmoid(logit), at) + 1e-3), np.log(np.bincount(doc))], 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(evidence @ self.calibration[:3] + self.calibration[3])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset of a logistic fit (Newton steps with a little shrinkage)."""
    f = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    a, small = np.zeros(f.shape[1]), np.append(np.full(x.shape[1], 0.01), 1e-6)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(f @ a, -30, 30)))
        step = np.linalg.solve((f * (q * (1 - q))[:, None]).T @ f + np.diag(small + 1e-9), f.T @ (q - y) + small * a)
        a -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return a


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit to one figure."""
    a = logistic(np.asarray(x)[:, None], y)
    return float(a[0]), float(a[1])


def _grouped(texts: list, size: int = CHUNK):
    """Runs of texts with about ``size`` characters."""
    out, n = [], 0
    for t in texts:
        if out and n + len(t or "") > size:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t or "")
    if out:
        yield out


def _odds(keys: np.ndarray, doc: np.ndarray, y: np.ndarray):
    """Keys of at least three documents, sorted, at most ``VOCABULARY``; their log odds of label 1; the odds of each place of ``keys``."""
    docs = len(y)
    key, place = np.unique(keys, return_inverse=True)
    of, d = np.divmod(np.unique(place * docs + doc), docs)
    bad = np.bincount(of, weights=y[d], minlength=len(key))
    good = np.bincount(of, minlength=len(key)) - bad
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    odds = np.where(bad + good >= 3, odds * (bad + good) / (bad + good + 3), 0.0)
    keep = np.flatnonzero(bad + good >= 3)
    keep = np.sort(keep[np.argsort(-np.abs(odds[keep]) - 0.01 * np.log(1 + bad + good)[keep], kind="stable")[:VOCABULARY]])
    return key[keep], odds[keep], odds[place]


def fit(texts: list[str | None], y: list[int], share: float | None = None, seed: int = 1) -> Network | float:
    """A trained network; a share, if only one class was seen. share: of label 1 among all labels, if the sample's differs."""
    y = np.array(y, np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    hold = np.arange(len(y)) % 4 == 3  # documents for calibration
    if hold.sum() < 20 or y[hold].min() == y[hold].max():
        hold = np.zeros(len(y), bool)
    own_texts, ly = [t for t, h in zip(texts, hold, strict=True) if not h], y[~hold]
    hashes, heads, sizes = [], [], []
    for part in _grouped(own_texts):
        w = Words(pa.array(part, pa.string()))
        hashes.append(w.hash)
        heads.append(stems(w))
        sizes.append(w.n)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    docs = len(own_texts)
    doc = np.repeat(np.arange(docs), np.diff(first))
    vocab, odds, suspect = _odds(np.concatenate(hashes), doc, ly)
    stem_vocab, stem_odds, stem_suspect = _odds(np.concatenate(heads), doc, ly)
    net = Network(vocab, odds, stem_vocab, stem_odds, seed)
    start, own = windows(first)
    size = np.minimum(first[1:][own] - start, WINDOW)
    high = np.concatenate([np.maximum(suspect, stem_suspect), [-9.0]])
    t = np.arange(WINDOW)[None]
    suspicion = np.concatenate([high[np.where(t < size[a : a + 8192, None], start[a : a + 8192, None] + t, len(high) - 1)].max(1) for a in range(0, len(start), 8192)])
    order = np.lexsort((start, -suspicion, own))
    at = np.searchsorted(own[order], np.arange(docs))
    count = np.diff(np.append(at, len(order)))
    place = np.arange(len(order)) - np.repeat(at, count)
    top = (place < TAKEN) & ((place == 0) | (ly[own[order]] == 0) | (suspicion[order] > 1.0))
    other = order[at + (np.random.default_rng(seed).random(docs) * count).astype(np.int64)]
    chosen = np.unique(np.concatenate([order[top], other[ly == 0]]))
    pieces, base, done = [], 0, 0
    for part in _grouped(own_texts):
        w = Words(pa.array(part, pa.string()), hashes=False)
        to = np.searchsorted(own[chosen], done + len(part))
        for k in chosen[len(pieces) : to]:
            s, n = start[k] - base, size[k]
            pieces.append(w.low[w.start[s] : w.end[s + n - 1]].tobytes().decode() if n else "")
        base, done = base + len(w.start), done + len(part)
    w = Words(pa.array(pieces, pa.string()))
    net.train(w, w.first[:-1], w.n, ly[own[chosen]])
    calibrate, cy = ([t for t, h in zip(texts, hold, strict=True) if h], y[hold]) if hold.any() else (own_texts, ly)
    net.calibration = logistic(np.concatenate([net.evidence(Words(pa.array(part, pa.string()))) for part in _grouped(calibrate)]), cy)
    if share is not None and 0 < share < 1:
        net.calibration[3] += np.log(share / (1 - share)) - np.log(cy.mean() / (1 - cy.mean()))
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, per_class: int = SAMPLE):
    """Texts and labels of at most ``per_class`` documents of each class, those with the smallest id hashes, and the share of label 1 among all."""
    known = labels.where(F.col(label_col).isin(0, 1) & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    # a share of each class that holds enough documents goes on to be ranked, so that no task ranks a whole class
    u = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("_y") == k, min(1.0, (2.0 * per_class + 200) / n)).otherwise(share)
    order = Window.partitionBy("_y").orderBy("_u", "_id")
    chosen = known.withColumn("_u", u).where(F.col("_u") < share).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_class).select("_id", "_y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("id", "text", "_y")
    got = sorted((r for r in rows.toLocalIterator()), key=lambda r: (hash_of(r[0]), str(r[0]), r[1] or ""))
    return [r[1] for r in got], [r[2] for r in got], counts.get(1, 0) / max(sum(counts.values()), 1)


def hash_of(i) -> int:
    """The place of an id in the sample's order; ids of another type than whole numbers go by a digest of their text."""
    if not isinstance(i, int):
        i = int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "little", signed=True)
    return int(mix(np.array([i], np.int64).astype(U64))[0])


def _scored(shared):
    def run(batches):
        net = shared.value
        for part in chunks(batches, size=CHUNK):
            if isinstance(net, float):
                score = np.full(part.num_rows, net)
            else:
                score = np.clip(net.score(net.evidence(Words(part.column("text")))), 0, 1)
            yield pa.record_batch([part.column("id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, score, predicted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
