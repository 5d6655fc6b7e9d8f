"""Personal data: exact base spans, and information-theoretic sanitisation of what gives them away.

Emails, addresses, cards and phone numbers are found by form. Each distinct one is a protected entity, and so is what several
share: an email's domain, an address's network, a phone's area. Corpus co-occurrence then estimates what neighbouring terms disclose.
With p(t | e) the share of e's contexts (the different surroundings it is met in, so that copies of a text weigh once) that
hold the term, and p(t), p(e) the shares of all texts that hold them, a term discloses e if log2 p(t | e) / p(t) reaches
`alpha` of e's information content, -log2 p(e), in two contexts or more, and if so many contexts are more than chance: by the
likelihood-ratio test of a binomial share, corrected for the number of pairs tested. Disclosing terms near their entity become
spans of kind "term": to be generalised (replaced by what they are) or removed with the base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate, islice
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import filter_bits, flags_of, materialize, slices, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as near, least number of different contexts, share of the entity's
#: information that a term must give, and chance of one false term in a whole corpus.
NEAR, SUPPORT, ALPHA, ERROR = 8, 2, 0.8, 0.01
#: Characters of text that are looked at together: what stands near entities is many times the text where they are thick.
SLICE = 300_000
#: Bits of the filter that tells which words the corpus count is about (its size is fixed: 1 MB).
FILTER_BITS = 23
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in digits]
    return (sum(d[-1::-2]) + sum((2 * x - 9 if x > 4 else 2 * x) for x in d[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ signs: linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > floor and _LOCAL.match(text, s - 1):
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; matches that fail their check are dropped, without another try."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def word_hash(w: str) -> int:
    """Hash of a word, A-Z lower-cased (bytes.lower leaves all else alone)."""
    return xxhash.xxh64_intdigest(w.encode().lower())


def entities_of(kind: int, value: str) -> list[str]:
    """What a span stands for: itself, and the domain, network or area that others share with it."""
    out = [f"{kind}:{value}"]
    if kind == 0:
        out.append(f"domain:{value.rpartition('@')[2]}")
    elif kind == 1:
        out.append(f"network:{value.rpartition('.')[0]}")
    elif kind == 3:
        out.append(f"area:{_NOT_DIGIT.sub('', value)[:-7]}")
    return out


def near(text: str, spans: list[tuple[int, int, int]], width: int = NEAR) -> list[tuple[int, int, int, int, int]]:
    """(entity, term, context, start, end) of the words near each entity, whole ones however long; entity, term and context are
    hashes. What stands inside a base span is no term."""
    out = []
    starts, reach = [a for a, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    inside = lambda s, f: (i := bisect_left(starts, f)) > 0 and reach[i - 1] > s
    back, n = text[::-1], len(text)
    for a, kind, e in spans:
        before = [(n - m.end(), n - m.start()) for m in islice(_WORD.finditer(back, n - a), width)]
        places = before[::-1] + [m.span() for m in islice(_WORD.finditer(text, e), width)]
        ws = [(s, f, text[s:f]) for s, f in places if f - s > 2 and not inside(s, f)]
        context = word_hash(" ".join(w for _, _, w in ws))
        for x in entities_of(kind, text[a:e]):
            out += [(word_hash(x), word_hash(w), context, s, f) for s, f, w in ws]
    return out


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_NEAR = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _nested(rows: list[tuple], ends: list[int], kind: pa.StructType) -> pa.Array:
    """Lists of structs from rows in a row and where each list ends; 64-bit hashes become signed."""
    columns = zip(*rows) if rows else [()] * kind.num_fields
    arrays = [pa.array((np.array(c, np.uint64).view(np.int64) if f.name in ("entity", "term", "context") else np.array(c, np.int64)).astype(f.type.to_pandas_dtype())) for f, c in zip(kind, columns)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind)))


def scan(docs: DataFrame) -> DataFrame:
    """docs' doc_id plus base (spans), entities (hashes) and near (words near them)."""
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("base array<struct<start:long,kind:int,end:long>>, near array<struct<entity:long,term:long,context:long,start:long,end:long>>").fields])

    def run(batches):
        for part in slices(batches, limit=SLICE):
            spans, span_ends, words, word_ends = [], [0], [], [0]
            for t in texts_of(part):
                t = t.decode("utf-8", "replace")
                found = base_spans(t)
                spans += found
                span_ends.append(len(spans))
                words += near(t, found) if found else []
                word_ends.append(len(words))
            yield pa.RecordBatch.from_arrays([part.column(0), _nested(spans, span_ends, _SPAN), _nested(words, word_ends, _NEAR)], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many texts of docs each of terms occurs. Tasks sum up what passes a filter of fixed size made
    from all of terms; the join after it removes what passed by chance."""
    told = docs.sparkSession.sparkContext.broadcast(filter_bits(terms, "term", FILTER_BITS))

    def run(batches):
        flags, mask, memo, sums = flags_of(told.value), (1 << FILTER_BITS) - 1, {}, {}
        for part in slices(batches):
            for t in texts_of(part):
                for w in set(t.translate(_FOLD).split()):
                    h = memo.get(w)
                    if h is None:
                        if len(memo) > 150_000:
                            memo.clear()
                        h = xxhash.xxh64_intdigest(w)
                        h = memo[w] = h if flags[h & mask] else 0
                    if h:
                        sums[h] = sums.get(h, 0) + 1
            if len(sums) > 500_000:
                yield _table(sums)
                sums = {}
        if sums:
            yield _table(sums)

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


#: Bytes as _WORD sees them, A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _table(sums: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.fromiter(sums, np.uint64, len(sums)).view(np.int64)), pa.array(np.fromiter(sums.values(), np.int64, len(sums)))], names=["term", "n"])


def critical(pairs: int, error: float = ERROR) -> float:
    """Value that twice a log-likelihood ratio passes by chance in one of `pairs` tests with the chance `error` (one side)."""
    return NormalDist().inv_cdf(1 - error / max(1, pairs)) ** 2


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, end; kinds as in KINDS) of every row of docs; spans holds base and
    the disclosing terms, by start, then kind.

    Null text is empty; repeated rows are rows of their own, and as copies are one context; documents without an entity
    have no terms; an empty table gives no rows; further columns are ignored."""
    docs = docs.select("doc_id", "text")
    rows = materialize(scan(docs).withColumn("row", F.monotonically_increasing_id()), "pii-scan")
    close = rows.where(F.size("near") > 0).select("row", F.inline("near"))
    pairs = close.groupBy("entity", "term", "context").agg(F.lit(1)).groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    pairs = materialize(pairs, "pii-pairs")
    n, tested = float(max(rows.count(), 1)), pairs.count()
    contexts = close.groupBy("entity", "context").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("ne"))
    texts = close.groupBy("entity", "row").agg(F.lit(1)).groupBy("entity").agg(F.count("*").alias("te"))
    counts = materialize(corpus_counts(docs, pairs.select("term").distinct()), "pii-terms")
    told = pairs.join(contexts, "entity").join(texts, "entity").join(counts.withColumnRenamed("n", "nt"), "term")
    share, chance = F.col("both") / F.col("ne"), F.least(F.col("nt") / n, F.lit(1.0))
    miss = F.col("ne") - F.col("both")
    ratio = F.col("both") * F.log(share / chance) + F.when(miss > 0, miss * F.log((miss / F.col("ne")) / F.greatest(1 - chance, F.lit(1e-12)))).otherwise(0.0)
    enough = (F.log2(share / chance) >= alpha * F.log2(n / F.col("te"))) & (share > chance) & (2 * ratio > critical(tested))
    disclosing = materialize(told.where(enough).select("entity", "term"), "pii-disclosing")
    spans = close.join(disclosing, ["entity", "term"], "left_semi").select("row", F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("end")).alias("s"))
    added = spans.groupBy("row").agg(F.collect_set("s").alias("more"))  # words of one text
    return rows.join(added, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:long,kind:int,end:long>>")))).alias("spans"))


def joined(spans: str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")


def sanitise(text: str, spans: list[tuple[int, int, int]], remove: bool = False) -> str:
    """text with (start, kind, end) spans generalised to their kind, or removed; of overlapping spans the first counts."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out.append(text[at:s] + ("" if remove else f"[{KINDS[k]}]"))
            at = e
    return "".join(out) + text[at:]
