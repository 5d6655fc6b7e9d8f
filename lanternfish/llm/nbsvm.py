"""Quality classifier: naive Bayes features under a linear support vector machine.

Indicators of n-grams are scaled by the log-ratio of their smoothed class counts; a linear hinge-loss model over them is
fitted by dual coordinate descent, and its margin is calibrated to a probability. Tokens are words and, beside each, its
shape (letter case, digits, what closes it, whether it repeats the word before), so that shouting, filler and stutter
shows in n-grams of shapes (up to three) while vocabulary shows in n-grams of words (up to two).

All labelled texts are learned from: the class counts are those of them all, and the linear model is the mean of models fitted, each
with its own calibration, to blocks of them that a task can hold. Up to BLOCK texts are one block.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect, discard, filter_bits, flags_of, lean, map_texts, materialize, shuffled, slices, texts_of

BITS = 20
#: Labelled texts of a block, about; every one is in a block. Cells of a piece in which vectors are added up.
BLOCK, PIECE = 6_000, 1 << 14
FILTER_BITS = 23
_SHAPE = re.compile(rb"[A-Z]+|[a-z\x80-\xff]+|[0-9]+")
_TAIL = re.compile(rb"[^A-Za-z0-9\x80-\xff]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(w: bytes) -> bytes:
    core = _SHAPE.sub(lambda m: b"A" if m[0][0] < 91 and m[0][0] > 64 else b"0" if m[0][0] < 58 else b"a", w)
    tail = _TAIL.search(w)
    return core[:4] + b"~" + (tail[0][-3:] if tail else b"")


class _Numbers(dict):
    """Numbers words as they come."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Features:
    """Hashed n-gram indicators of a text, sorted and distinct."""

    MEMO = 100_000

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self._forget()

    def _forget(self):
        self.numbers, self.hashes, self.shapes = _Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        ws = text.split()
        if not ws:
            return np.zeros(0, np.int64)
        if len(self.numbers) > self.MEMO:
            self._forget()
        ids = np.fromiter(map(self.numbers.__getitem__, ws), np.int64, len(ws))
        if fresh := self.numbers.fresh:
            self.numbers.fresh = []
            room = len(self.numbers)
            if room > len(self.hashes):  # grown by doubling
                grown = np.zeros(max(room, 2 * len(self.hashes)), np.uint64)
                self.hashes, self.shapes = np.concatenate([self.hashes, grown[len(self.hashes) :]]), np.concatenate([self.shapes, grown[len(self.shapes) :]])
            self.hashes[room - len(fresh) : room] = [zlib.crc32(w) for w in fresh]
            self.shapes[room - len(fresh) : room] = [zlib.crc32(_shape(w), 7) for w in fresh]
        word, shape = self.hashes[ids], self.shapes[ids]
        shape[1:] ^= np.where(ids[1:] == ids[:-1], np.uint64(0x5BD1E995), np.uint64(0))
        out = [self._fold(word, 1), self._fold(shape, 2)]
        if len(ws) > 1:
            out += [self._fold(x[:-1] * np.uint64(31) + x[1:], k) for x, k in ((shape, 3), (word, 5))]
        if len(ws) > 2:
            out.append(self._fold(shape[:-2] * np.uint64(961) + shape[1:-1] * np.uint64(31) + shape[2:], 4))
        return np.unique(np.concatenate(out)).astype(np.int64)

    def _fold(self, x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind * 0x51ED270B)) * _MIX
        return (x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(32) & self.mask


def ratios(counts: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """Log-ratio of smoothed class counts (two rows) of indicators among n texts of each class."""
    ratio = np.log(((counts[1] + alpha) / (n[1] + 2 * alpha)) / ((counts[0] + alpha) / (n[0] + 2 * alpha)))
    ratio[counts.sum(axis=0) < 3] = 0.0  # indicators met once or twice say nothing of other texts
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, c: float = 1.0, epochs: int = 12, seed: int = 7, ratio: np.ndarray | None = None):
    """(weights, bias, a, b, ratios): weights of the scaled indicators, P(1) = 1 / (1 + exp(-(a * margin + b))). ratio: that of more
    texts than these."""
    y = np.where(labels > 0, 1.0, -1.0)
    size = 1 << bits
    if not len(y) or abs(y.sum()) == len(y):
        prior = 0.0 if not len(y) else 4.0 * y[0]
        return np.zeros(size, np.float32), 0.0, 1.0, prior, np.zeros(size, np.float32)
    if ratio is None:
        counts = np.zeros((2, size))
        for x, t in zip(rows, y):
            counts[int(t > 0), x] += 1
        ratio = ratios(counts, np.array([(y < 0).sum(), (y > 0).sum()]), alpha)

    def solve(order):
        # min over w of |w|^2 / 2 + sum C max(0, 1 - y w.x)^1, in the dual, one coordinate at a time; rows have unit length
        w, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
        vals = [ratio[x] for x in rows]
        norm = [max(1e-9, float(np.sqrt((v * v).sum() + 1e-9))) for v in vals]
        weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * c
        for _ in range(epochs):
            moved = 0.0
            for i in rng.permutation(order):
                v = vals[i] / norm[i]
                g = y[i] * (w[rows[i]] @ v + bias) - 1
                new = min(max(dual[i] - g / 2.0, 0.0), weight[i])
                if new != dual[i]:
                    step = (new - dual[i]) * y[i]
                    w[rows[i]] += step * v
                    bias += step
                    moved += abs(new - dual[i])
                    dual[i] = new
            if moved < 1e-3 * len(order):
                break
        return w * ratio, bias, norm

    rng = np.random.default_rng(seed)
    folds = rng.integers(0, 3, len(y))
    margins = np.zeros(len(y))
    for k in range(3):  # margins of rows that the model has not seen, for the calibration
        w, bias, norm = solve(np.flatnonzero(folds != k))
        for i in np.flatnonzero(folds == k):
            margins[i] = w[rows[i]].sum() / norm[i] + bias
    a, b = platt(margins, y)
    w, bias, _ = solve(np.arange(len(y)))
    return w.astype(np.float32), float(bias), a, b, ratio.astype(np.float32)


def platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the margins by Newton steps, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-6, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * m).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def packed(x: np.ndarray) -> bytes:
    """Sorted distinct numbers as the bytes of their gaps, the lowest bytes first, so that they compress."""
    return np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(4, -1).T.ravel().view("<u4"), dtype=np.int64)


def _pieces(x: np.ndarray) -> pa.RecordBatch:
    """A vector of whole pieces."""
    parts = x.astype("<f8").reshape(-1, PIECE)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["piece", "sums"])


def _sum(pieces: DataFrame) -> np.ndarray:
    """Sum of all vectors that pieces (piece, sums) are of. A piece has a row of 128 KB from each block or task."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(PIECE)
        for x in rows["sums"]:
            total += np.frombuffer(x.as_py(), "<f8")
        return pa.table({"piece": rows["piece"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    got = pieces.groupBy("piece").applyInArrow(add, "piece int, sums binary").toArrow().sort_by("piece")
    return np.frombuffer(b"".join(got["sums"].to_pylist()), "<f8")


def _labelled(docs: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """marks (doc_id, y, block) with the indicators x of their documents; only what joins, or nearly, is taken apart and sent."""
    spot = F.xxhash64("doc_id").alias("spot")
    told = docs.sparkSession.sparkContext.broadcast(filter_bits(marks.select(spot), "spot", FILTER_BITS))

    def run(batches):
        flags, f = flags_of(told.value), Features(bits)
        for b in batches:
            b = b.filter(pa.array(flags[b.column(2).to_numpy() & ((1 << FILTER_BITS) - 1)] > 0))
            for part in slices([b]):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([packed(f(t)) for t in texts_of(part)], pa.binary())], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = lean(docs).where("doc_id is not null and text is not null").select("doc_id", "text", spot).mapInArrow(run, f"doc_id {kind}, x binary")
    return rows.join(shuffled(marks), "doc_id").select("block", "doc_id", "y", "x")


def train(docs: DataFrame, labels: DataFrame, label: str, held: int, folds: int, bits: int = BITS):
    """Fit on all labelled documents whose crc32(doc_id as text) mod folds is not held. Rows without a label, a doc_id or a text are
    left out. (weights, bias, a, b, ratios) as of `fit`, its calibration within weights and bias."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    blocks, size = max(1, -(-marks.count() // BLOCK)), 1 << bits
    rows = materialize(_labelled(docs, marks.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")), bits), "svm-rows")
    collect(rows)
    n = np.zeros(2, np.int64)
    for r in rows.groupBy("y").count().collect():
        n[r["y"]] = r["count"]
    if not n.all():
        discard(rows)
        return fit([np.zeros(0, np.int64)] * int(n.any()), np.full(int(n.any()), int(n[1] > 0)), bits)  # the prior alone

    def count(batches):
        counts = np.zeros(2 * size)
        for b in batches:
            for y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[unpacked(x) + y * size] += 1
        yield _pieces(counts)

    ratio = ratios(_sum(rows.select("y", "x").mapInArrow(count, "piece int, sums binary")).reshape(2, size), n, 1.0)
    told = rows.sparkSession.sparkContext.broadcast(ratio)

    def block(rows: pa.Table) -> pa.Table:
        t = rows.sort_by("doc_id")
        w, bias, a, b, _ = fit([unpacked(x) for x in t["x"].to_pylist()], t["y"].to_numpy(), bits, ratio=told.value)
        last = np.zeros(PIECE)
        last[:2] = a * bias + b, 1.0
        return pa.Table.from_batches([_pieces(np.concatenate([a * w.astype(np.float64), last]))])

    got = _sum(rows.groupBy("block").applyInArrow(block, "piece int, sums binary"))
    fitted = got[size + 1]
    discard(rows)
    return (got[:size] / fitted).astype(np.float32), float(got[size] / fitted), 1.0, 0.0, ratio.astype(np.float32)


def score(docs: DataFrame, model, keep: list[str], name: str = "score", bits: int = BITS) -> DataFrame:
    """keep's columns plus the probability of label 1 of each whole text; null and empty texts get the prior's. A narrow
    map; the model (8 MB) is a broadcast of fixed size."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        f = Features(bits)
        w, bias, a, b, ratio = told.value

        def add(texts):
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                x = f(t)
                norm = np.sqrt(float((ratio[x].astype(np.float64) ** 2).sum()) + 1e-9)
                out[i] = a * (float(w[x].astype(np.float64).sum()) / norm + bias) + b
            return {name: 1 / (1 + np.exp(-np.clip(out, -500, 500)))}

        return add

    return map_texts(docs, None, [pa.field(name, pa.float64())], f"{name} double", keep, make=make)


def classify(docs: DataFrame, labels: DataFrame, held: int = 1, folds: int = 3, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or keep) plus score, predicted (score >= 0.5).

    Without usable labels, or with labels of one class only, every text gets one prior score. Repeated rows score alike;
    columns named score or predicted give way."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    return score(docs, train(docs, labels, "quality", held, folds), keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
