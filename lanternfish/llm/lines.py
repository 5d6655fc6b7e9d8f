"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words. Each sends itself and, for every word, itself without it, as hashed keys. Lines that
differ in one word meet in the variant without it, at the same place; a line with one word more meets the other's self.
So all that share a variant and its place are within one edit of each other, whatever their number, and need no pairs:
each is held against the earliest there, and that edit distance is verified. A line goes if an earlier one equals it or
is within one edit (a word put in, left out or changed). Edits are for lines of LEAST_WORDS or more; repeats go at any length.

Before that, lines that no other can match are told apart cheaply: of a pair within one edit either the first or the
last half of the shorter one's words is untouched, so a line whose half-keys are all its own sends no variants.
The lines that do are numbered in the order of their places, so that all that follows moves numbers, not places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, filter_bits, flags_of, materialize, shuffled, slices, texts_of

#: Words of a line from which on one edit makes no other line of it; shorter ones go as exact repeats alone.
LEAST_WORDS = 5
#: Bits of the filter that tells which lines a second pass is about (its size is fixed: 1 MB).
FILTER_BITS = 23


def words(line: bytes) -> list[bytes]:
    return line.lower().split()


def within_one(a: list, b: list) -> bool:
    """Whether a becomes b by at most one word put in, left out or changed."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _h(ws: list[bytes], tag: int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(ws), tag)


def half_keys(ws: list[bytes]) -> list[int]:
    n = len(ws)
    out = []
    for short in (n, n - 1):
        h = short // 2
        out += [_h(ws[:h], 2 * short), _h(ws[n - h :] if h else [], 2 * short + 1)]
    return out


def variants(ws: list[bytes]) -> tuple[list[int], list[int]]:
    """(hashes, places) of the line (place -1) and of it without each word."""
    return [_h(ws, 0), *(_h(ws[:i] + ws[i + 1 :], 0) for i in range(len(ws)))], list(range(-1, len(ws)))


def _signed(x) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("sig"), "text")


def _lines(texts: list[bytes]):
    """(row, number, words) of every line with a word."""
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split(b"\n")):
            if ws := words(line):
                yield i, k, ws


def line_rows(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(lo, hi, doc, sig, line, halves): of each line with a word its 128-bit hash, its document (doc_id and hash of the text),
    its number and, where the slice of texts first has a line of `least` words or more, its half-keys."""

    def run(batches):
        for part in slices(batches):
            lo, hi, row, number, halves, ends, seen = [], [], [], [], [], [0], set()
            for i, k, ws in _lines(texts_of(part)):
                x = xxhash.xxh3_128_intdigest(b" ".join(ws))
                lo.append(x & (1 << 64) - 1)
                hi.append(x >> 64)
                row.append(i)
                number.append(k)
                if len(ws) >= least and x not in seen:
                    seen.add(x)
                    halves += half_keys(ws)
                ends.append(len(halves))
            take = pa.array(row, pa.int64())
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(_signed(halves)))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(lo)), pa.array(_signed(hi)), part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()), keys], names=["lo", "hi", "doc", "sig", "line", "halves"])

    return _named(docs).mapInArrow(run, "lo long, hi long, doc long, sig long, line int, halves array<long>")


def _place():
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "sig", "line")


def _texts_of_lines(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(id, lo, hi, words) of the lines whose lo is in wanted, numbered in the order of their earliest places. Tasks pass on
    what a filter of fixed size lets through, each line once a slice; the join removes the rest."""
    told = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted, "lo", FILTER_BITS))

    def run(batches):
        flags, mask = flags_of(told.value), (1 << FILTER_BITS) - 1
        for part in slices(batches):
            lo, hi, row, number, text, seen = [], [], [], [], [], set()
            doc = part.column(0).to_pylist()
            order = sorted(range(part.num_rows), key=lambda i: (doc[i] is None, doc[i] or 0, part.column(1)[i].as_py()))
            texts = texts_of(part)
            for i, k, ws in _lines([texts[i] for i in order]):
                if len(ws) >= least:
                    joined = b" ".join(ws)
                    x = xxhash.xxh3_128_intdigest(joined)
                    if flags[x & mask] and x not in seen:
                        seen.add(x)
                        lo.append(x & (1 << 64) - 1)
                        hi.append(x >> 64)
                        row.append(order[i])
                        number.append(k)
                        text.append(joined)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(_signed(lo)), pa.array(_signed(hi)), part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()), pa.array(text, pa.binary())], names=["lo", "hi", "doc", "sig", "line", "words"])

    got = _named(docs).mapInArrow(run, "lo long, hi long, doc long, sig long, line int, words binary").join(shuffled(wanted), "lo", "left_semi")
    first = got.groupBy("lo", "hi").agg(F.min(F.struct(_place().alias("place"), "words")).alias("m"))
    return first.select("lo", "hi", "m.*").orderBy("place").select(F.monotonically_increasing_id().alias("id"), "lo", "hi", "words")


def _variant_rows(lines: DataFrame) -> DataFrame:
    """(v, at, id) for every variant of lines."""

    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                v, at, row = [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    hs, ps = variants(t.split())
                    v += hs
                    at += ps
                    row += [i] * len(hs)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(v)), pa.array(at, pa.int32()), part.column(0).take(pa.array(row, pa.int64()))], names=["v", "at", "id"])

    return lines.select("id", "words").mapInArrow(run, "v long, at int, id long")


def _verified(pairs: DataFrame) -> DataFrame:
    """Of (lo, hi, words, earlier words) the (lo, hi) whose edit distance is one."""

    def run(batches):
        for b in batches:
            ok = pa.array([within_one(x.split(), y.split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_())
            yield b.select(["lo", "hi"]).filter(ok)

    return pairs.select("lo", "hi", "words", "earlier").mapInArrow(run, "lo long, hi long")


def removals(docs: DataFrame, least: int = LEAST_WORDS, tag: str = "lines") -> DataFrame:
    """(doc, sig, removed), a written table: for each document that loses lines their numbers, from 0."""
    rows = materialize(line_rows(docs, least), tag)
    repeated = rows.groupBy("lo", "hi").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").select("lo", "hi", "first")
    repeated = materialize(repeated, tag)
    keyed = rows.select("lo", F.explode("halves").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).where("a <> b").select("key"), tag)
    wanted = materialize(keyed.join(shuffled(shared), "key", "left_semi").select("lo").distinct(), tag)
    lines = materialize(_texts_of_lines(docs, wanted, least), tag)
    sent = materialize(_variant_rows(lines), tag)
    discard(shared, wanted)
    own = materialize(sent.groupBy("v", "at").agg(F.min("id").alias("m"), F.count("*").alias("c")), tag)
    selves = own.where("at = -1").select("v", F.col("m").alias("self"))
    others = own.where("at >= 0").groupBy("v").agg(F.min("m").alias("other"))
    # what each variant's members are held against: the earliest at their place or the line that the variant is
    best = own.join(shuffled(selves), "v", "left").join(shuffled(others), "v", "left").where("(at >= 0 and (c > 1 or self is not null)) or (at = -1 and other is not null)")
    best = materialize(best.select("v", "at", F.when(F.col("at") >= 0, F.least("m", "self")).otherwise(F.col("other")).alias("b")), tag)
    met = materialize(sent.join(shuffled(best), ["v", "at"]).where("b < id").groupBy("id").agg(F.min("b").alias("b")), tag)
    discard(own, sent, best)
    pairs = shuffled(met).join(lines, "id").join(shuffled(lines.select(F.col("id").alias("b"), F.col("words").alias("earlier"))), "b")
    near = materialize(_verified(pairs), tag)
    discard(met, lines)
    gone = repeated.withColumn("near", F.lit(False)).unionByName(near.select("lo", "hi", F.lit(None).cast(repeated.schema["first"].dataType).alias("first"), F.lit(True).alias("near")))
    gone = gone.groupBy("lo", "hi").agg(F.max("near").alias("near"), F.max("first").alias("first"))
    hit = rows.select("lo", "hi", "doc", "sig", "line").join(shuffled(gone), ["lo", "hi"]).where(F.col("near") | ~_place().eqNullSafe(F.col("first")))
    out = materialize(hit.groupBy("doc", "sig").agg(F.array_sort(F.collect_set("line")).alias("removed")), tag)  # one document's lines
    discard(rows, repeated, near)
    return out


def dedup(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated lines taken out of text, plus n_lines, removed (numbers of the lines that went, from 0).

    Earlier means the smaller (doc_id, hash of the text, line number), null doc_ids last. Case of A-Z and white space do
    not count. Lines of fewer than `least` words go only as exact repeats; lines without a word and null texts stay as they
    are. Rows equal in doc_id and text are one document as to what is earlier and keep the same lines. Columns named n_lines or
    removed give way; others may have any name."""
    names = [c for c in docs.columns if c not in ("n_lines", "removed")]
    gone = removals(docs, least).select("sig", "doc", F.col("removed").alias("lost"))
    base = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("own_sig"), F.col("doc_id").cast("long").alias("own_doc"))
    got = base.join(shuffled(gone), F.col("own_sig").eqNullSafe(F.col("sig")) & F.col("own_doc").eqNullSafe(F.col("doc")), "left")
    lines = F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lost", i)), "\n")
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(kept)
    n = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return got.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names), n.alias("n_lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("removed"))
