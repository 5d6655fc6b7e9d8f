"""Toxicity by compression distance.

zstandard dictionaries are trained on toxic and on ordinary text; each window of a text is compressed under both, and the bytes
that the toxic one saves over the ordinary one are the window's distance. Both begin with the same content, trained on ordinary
text, so that chance matches cancel. What the toxic one has beyond it is trained on toxic texts without the words that ordinary
ones hold about as often: trained on toxic texts as they are, it is filled with the common speech that both sides share.

Distances are calibrated by window: a distance's weight is the log-ratio of how often windows of toxic and of ordinary texts
have it, and a document's figures are sums, greatest values and counts over its windows. A logistic model of them gives a
document's log-odds. The labelled texts are dealt into PARTS; each part is described under dictionaries of the other parts, so
weights, model and threshold are fitted on texts that their dictionaries have not seen. A new text has the mean of the log-odds under
all parts' dictionaries, less the cutoff of the largest F1 on the labelled texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Bytes of a window, of the general part and each side's own part of a dictionary, and zstandard's level.
WINDOW, GENERAL, OWN, LEVEL = 40, 49_152, 4_096, 3
#: Labelled texts of each class that training sees at most, each whole, and parts that they are dealt into.
SAMPLE, PARTS = 3_000, 4
#: A word is told apart if toxic texts hold it so many times as often as ordinary ones, and this many of them.
RATIO, FEW = 30, 4
#: Stands at a dictionary's end and before every window: so a window is never stored raw, and each match counts.
LEAD = bytes(range(33, 97))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    """Lower-case A-Z, and every run of bytes below 0x80 that are neither letter nor digit as one space."""
    return b" " + b" ".join(text.translate(_FOLD).split()) + b" "


def windows(text: bytes, width: int = WINDOW) -> list[bytes]:
    """Windows of about width bytes that cover the whole text, cut at spaces where there are any."""
    out, at, n = [], 0, len(text)
    while at < n - 1:
        end = at + width
        if end >= n:
            out.append(text[at:])
            break
        cut = text.find(b" ", end, end + width)
        cut = min(end + width, n - 1) if cut < 0 else cut
        out.append(text[at : cut + 1])
        at = cut
    return out or [text]


class Distance:
    """Bytes that the first of two dictionaries saves over the second on each window."""

    def __init__(self, toxic: bytes, ordinary: bytes, level: int = LEVEL):
        self.tools = []
        for d in (ordinary, toxic):
            z = zstandard.ZstdCompressionDict(d + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            z.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=z, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        a, b = (t.compress for t in self.tools)
        return np.array([len(a(p)) - len(b(p)) for p in (LEAD + p for p in parts)], dtype=np.int64)


def dictionary(samples: list[bytes], size: int, k: int = 24, d: int = 6) -> bytes:
    """A dictionary trained on the samples; where they are too few to train on, they are it themselves."""
    samples = [x for x in samples if x.strip()]
    if sum(map(len, samples)) > 3 * size and len(samples) > 20:
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=d, f=20, accel=1, split_point=1.0).as_bytes()
        except (zstandard.ZstdError, ValueError):
            pass
    return b"".join(samples)[-size:]


def _cut(texts: list[bytes], width: int = 64) -> list[bytes]:
    return [w for t in texts for w in windows(t, width)]


def told_apart(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The toxic texts without the words that ordinary ones hold about as often."""
    own, other = (Counter(w for t in ts for w in set(t.split())) for ts in (toxic, ordinary))
    most = RATIO * len(toxic) / max(1, len(ordinary))
    least = min(FEW, max(1, len(toxic) // 4))
    left = [b" ".join(w for w in t.split() if own[w] >= least and own[w] > most * (other[w] + 1)) for t in toxic]
    return [b" " + x + b" " for x in left if x]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from normalised texts."""
    general = dictionary(_cut(ordinary), GENERAL, 32, 8) or b" "
    return general + dictionary(_cut(told_apart(toxic, ordinary)), OWN), general


#: Distances are told apart from -REACH to 2 * REACH.
REACH = 8


def _cells(d: np.ndarray) -> np.ndarray:
    return np.clip(d, -REACH, 2 * REACH) + REACH


def weights(toxic: list[np.ndarray], ordinary: list[np.ndarray]) -> np.ndarray:
    """Log-ratio of the shares of windows with each distance."""
    a, b = (np.bincount(_cells(np.concatenate(x)), minlength=3 * REACH + 1) + 0.5 for x in (toxic, ordinary))
    return np.log(a / a.sum()) - np.log(b / b.sum())


def figures(d: np.ndarray, weight: np.ndarray) -> list[float]:
    s = weight[_cells(d)]
    top = np.sort(s)[::-1]
    return [float(s.sum()), float(np.maximum(s, 0).sum()), float(top[0]), float(top[:3].sum()), float(s.sum() / np.sqrt(len(s))), float(np.log1p(len(s))), *(float(np.log1p((d >= x).sum())) for x in (2, 3, 4, 5, 6, 8))]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 3.0):
    """(mean, scale, weights with the constant last) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = np.c_[(x - mean) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = p * (1 - p) + 1e-9
        step = np.linalg.solve(z.T @ (z * s[:, None]) + l2 * np.eye(len(w)), z.T @ (p - y) + l2 * w)
        w = w - step
        if abs(step).max() < 1e-6:
            break
    return mean, scale, w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cutoff of z with the largest F1."""
    order = np.argsort(-z, kind="stable")
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(z) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float(z[order[i]] + z[order[min(i + 1, len(z) - 1)]]) / 2


class Model:
    """Pairs of dictionaries, weights of distances, and the calibration; or, without two texts of each class, one prior score."""

    def __init__(self, pairs=None, weight=None, calibration=None, prior: float = 0.001):
        self.pairs, self.weight, self.calibration, self.prior = pairs, weight, calibration, prior

    def scorer(self):
        """texts -> scores"""
        if self.calibration is None:
            return lambda texts: np.full(len(texts), self.prior)
        tools = [Distance(*p) for p in self.pairs]

        def run(texts):
            parts = [windows(normal(t)) for t in texts]
            odds = sum(log_odds([t(p) for p in parts], self.weight, self.calibration) for t in tools) / len(tools)
            return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

        return run


def log_odds(distances: list[np.ndarray], weight: np.ndarray, calibration) -> np.ndarray:
    mean, scale, w = calibration
    x = np.array([figures(d, weight) for d in distances])
    return np.c_[(x - mean) / scale, np.ones(len(x))] @ w


def fit(texts: list[bytes], labels: list[int], prior: float | None = None) -> Model:
    """The model of labelled texts; prior is the share of toxic ones where these are not all."""
    sides = [[normal(t) for t, y in zip(texts, labels) if (y > 0) == k] for k in (False, True)]
    if min(map(len, sides)) < 2:
        return Model(prior=0.999 if len(sides[1]) > len(sides[0]) else 0.001)
    n = min(PARTS, *map(len, sides))
    pairs = [train_dictionaries(*([t for i, t in enumerate(x) if i % n != k] for x in reversed(sides))) for k in range(n)]
    tools = [Distance(*p) for p in pairs]
    ordinary, toxic = ([tools[i % n](windows(t)) for i, t in enumerate(x)] for x in sides)
    weight = weights(toxic, ordinary)
    x, y = np.array([figures(d, weight) for d in ordinary + toxic]), np.array([0] * len(ordinary) + [1] * len(toxic))
    mean, scale, w = logistic(x, y)
    if prior is not None:  # the sample's share of toxic texts is not the corpus's
        w[-1] += np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    w[-1] -= best_cut(np.c_[(x - mean) / scale, np.ones(len(x))] @ w, y)
    return Model(pairs, weight, (mean, scale, w))


def train(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5) -> Model:
    """Fit on labelled documents whose crc32(doc_id as text) mod folds is not held: of each class up to SAMPLE of the
    lowest xxhash64 of doc_id, each with its whole text."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % folds != held)
    share = marks.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    half = [marks.where(F.col("y") > 0 if k else F.col("y") <= 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(half[0].unionByName(half[1])), "doc_id")  # 2 * SAMPLE rows at most
    got = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.encode("text", "UTF-8").alias("t"), "y").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    share = min(max(share, 0.005), 0.995) if share is not None else None
    return fit(got["t"].to_pylist(), got["y"].to_pylist(), share)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep's columns plus score, the probability that the whole text is toxic. A narrow map; the broadcast model is 2 * PARTS
    dictionaries of under 64 KB."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        run = told.value.scorer()
        return lambda texts: {"score": run(texts)}

    return map_texts(docs, None, [pa.field("score", pa.float64())], "score double", keep, make=make)


def classify(docs: DataFrame, labels: DataFrame, held: int = 0, folds: int = 5, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or keep) plus score, predicted (score >= 0.5).

    Null text scores as the empty one; fewer than two labelled texts of a class give every text one prior score;
    repeated rows score alike; columns named score or predicted give way."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    return score(docs, train(docs, labels, held, folds), keep).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
