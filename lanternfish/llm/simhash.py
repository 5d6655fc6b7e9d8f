"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most two bits agree wholly in one
segment and in all but one bit of the next (pigeonhole, segments taken in a circle). The first is a key as it is; the
second is read as a word of the perfect binary Golay code (23, 12, 7) and decoded to the index of the nearest codeword,
and, where that is three bits off, to the five codewords four bits off as well: words one bit apart always share one of
these indices. Equal keys are candidates, verified by their distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_texts, materialize

SEED = 42
#: The Golay code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of a bucket up to which its pairs are formed; those of larger buckets are linked exactly another way.
SMALL_BUCKET = 32


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for i in range(22, 10, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


def _tables():
    near = np.zeros(2048, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for s, x in zip(_syndrome(e).tolist(), e.tolist()):
            if weight <= 3:
                near[s] = x
            else:
                far[s].append(x)
    deep = np.array([int(x).bit_count() == 3 for x in near])
    more = np.array([(f[:5] if d else [0] * 5) for f, d in zip(far, deep)], np.int64)
    return near, deep, more


_NEAR, _DEEP, _MORE = _tables()


def codeword_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the 12-bit codeword indices of 23-bit words: one, or six for a word three bits off."""
    s = _syndrome(x)
    one = (x.astype(np.int64) ^ _NEAR[s]) >> 11
    rows = np.flatnonzero(_DEEP[s])
    rest = (x.astype(np.int64)[rows, None] ^ _MORE[s[rows]]) >> 11
    return np.concatenate([np.arange(len(x)), np.repeat(rows, 5)]), np.concatenate([one, rest.ravel()])


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of 64-bit fingerprints: segment number, exact segment, codeword index of the next."""
    fp = fp.astype(np.uint64)
    segment = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        r, c = codeword_indices(segment[(i + 1) % 3])
        rows.append(r)
        keys.append((i << 34) | (segment[i][r] << 12) | c)
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(ws)] if len(ws) < k else map(b" ".join, zip(*(ws[i:] for i in range(k))))
    h = xxhash.xxh64_intdigest
    return np.array([h(p, SEED) for p in parts], dtype=np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Each bit set in over half the hashes."""
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3, keep: list[str] | None = None) -> DataFrame:
    """keep's columns (all by default) plus fp, the SimHash of the text's k-word shingles, as a signed long. Null or
    wordless text: 0; fewer than k words: the whole sequence is the one shingle. A narrow map."""
    keep = [c for c in (keep or docs.columns) if c != "fp"]

    def add(texts):
        return {"fp": pa.array(np.array([fingerprint(shingle_hashes(t, k)) for t in texts], dtype=np.uint64).view(np.int64))}

    return map_texts(docs, add, [pa.field("fp", pa.int64())], "fp long", keep)


def _key_rows(fps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 50_000):
                part = fp[at : at + 50_000]
                rows, keys = keys_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long").distinct()


def buckets(fps: DataFrame, tag: str) -> DataFrame:
    """(key, fp, n): the keys that n >= 2 distinct fingerprints share."""
    rows = materialize(_key_rows(fps), tag)
    shared = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), tag)
    return materialize(rows.join(shared, "key"), tag)


def links(fps: DataFrame, small: int = SMALL_BUCKET, tag: str = "simhash") -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints at two bits or less that connect all that are so linked.

    Buckets of up to `small` fingerprints form their pairs, which are verified. Fingerprints of larger buckets send
    themselves and their 64 neighbours at one bit: two meet at a point exactly if they differ in at most two bits, all
    that meet at a point are linked, and at most 65 distinct ones can, so stars there hold every link in linear size.
    """
    rows = buckets(fps, tag)
    few = rows.where(F.col("n") <= small).select("key", "fp")
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.fp > y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    crowd = rows.where(F.col("n") > small).select("fp").distinct()
    points = materialize(crowd.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point")), tag)
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = points.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """One row a document: doc_id, fp and component_id, the smallest doc_id that links of two bits or less reach.

    Equal fingerprints are one node, so copies cost a row each and no pair. A null doc_id counts only where its
    component has no other; repeated rows get a row each; an empty table gives none."""
    rows = materialize(fingerprints(docs, k, ["doc_id"]), "simhash-docs")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = materialize(components(links(nodes)), "simhash-roots")
    part = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    part = materialize(part, "simhash-part")
    least = materialize(part.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    named = materialize(part.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
