"""Near-duplicate groups on word shingles, found through SimHash fingerprints and shared rare shingles, verified by Jaccard
similarity.

Keys are those of the whole text's SimHash as in `simhash` (exact segment, Golay codeword index of the next) and, since that
moves by many bits when a few words of a text change, the shingles of the text's prefix: in one order of all shingles,
the first n - ceil(s * n) + 1 of a set of n. Two sets of similarity s or more have the first shingle that they share in both
prefixes, so no such pair goes without a shared key. Small buckets form their pairs; in larger ones every member is
first held against LEADERS members chosen by as many hash orders, which links most of a large group in linear work.
What is left are pairs of members that those links do not connect. In a bucket most members are connected by now: the few that
are not with the most are held against all. Where they are many, buckets are split by the next shingle that members share
(within a prefix longer by one), and again, and then every pair left whose sizes and places allow it is verified. Before the sets
of two texts are fetched, their sketches (counts of shingles by cell) must allow the similarity: an upper bound, so no pair is lost.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect, components, discard, filter_bits, flags_of, materialize, shuffled, slices, texts_of
from .simhash import fingerprint, keys_of, shingle_hashes

#: Members up to which a bucket forms all pairs, leaders of a larger one, members apart from the most up to which a bucket is
#: not split, and shingles that the smallest buckets share.
SMALL, LEADERS, SPLIT, LEVELS = 6, 8, 256, 3
#: Cells of a sketch: a text's shingles are counted by cell, and no two share more than the lesser counts of all cells add up to.
CELLS = 128
#: Shingles are ordered by the counts, over all texts, of 2 ** ORDER_BITS cells; a row holds the counts of PIECE cells. Any order
#: gives the same links; one with the common shingles last is fast.
ORDER_BITS, PIECE = 23, 1 << 14
FILTER_BITS = 23
#: Shares of the keys that are dealt out one after another: disk holds the rows of one at a time.
PASSES = 4


def prefix_length(n: int, similarity: float) -> int:
    """Shingles of a set of n of which a set at that similarity must hold one."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _prefix(similarity: float, level: int):
    return (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + level).cast("int")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), "text")


def _order(docs: DataFrame, k: int) -> np.ndarray:
    """The rank of each cell's shingles, a byte each: eight times the logarithm of their count over all texts. Each task sends its
    counts once, so that what is shuffled is of fixed size a task."""
    size, mask = 1 << ORDER_BITS, np.uint64((1 << ORDER_BITS) - 1)

    def count(batches):
        total = np.zeros(size, np.uint32)
        for part in slices(batches):
            own = [shingle_hashes(t, k) for t in texts_of(part)]
            cells, n = np.unique(np.concatenate(own) & mask, return_counts=True)
            total[cells] += n.astype(np.uint32)
        rows = np.minimum(total, 65_535).astype("<u2").reshape(-1, PIECE)
        low = rows.view(np.uint8).reshape(len(rows), PIECE, 2).transpose(0, 2, 1)  # low bytes first: they compress
        for i in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(low[i].tobytes(), 1)], pa.binary())], names=["piece", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(PIECE, np.int64)
        for x in rows["counts"]:
            both = np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(2, PIECE)
            total += both[0] + both[1].astype(np.int64) * 256
        ranks = np.minimum(np.rint(8 * np.log2(total + 1)), 255).astype(np.uint8)
        return pa.table({"piece": rows["piece"][:1], "ranks": pa.array([ranks.tobytes()], pa.binary())})

    got = docs.select("text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, ranks binary").toArrow()
    out = np.zeros((size // PIECE, PIECE), np.uint8)
    for i, x in zip(got["piece"].to_pylist(), got["ranks"].to_pylist()):
        out[i] = np.frombuffer(x, np.uint8)
    return out.ravel()


def _scan(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc, text_hash, node, n, same, sketch, whole, prefix): node is the hash of the words, n the number of different shingles,
    same the hash of their set, sketch a byte a cell (empty where a count is over 255), whole the keys of the text's fingerprint,
    prefix the set's first shingles with LEVELS - 1 more."""
    told = docs.sparkSession.sparkContext.broadcast(_order(docs, k))
    none = np.zeros(0, np.int64)

    def run(batches):
        rank, mask = told.value, np.uint64((1 << ORDER_BITS) - 1)
        for part in slices(batches):
            node, n, same, sketch, whole, prefix = [], [], [], [], [], []
            for t in texts_of(part):
                node.append(xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())))
                h = shingle_hashes(t, k)
                own = np.unique(h)
                n.append(len(own))
                same.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                cells = np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                sketch.append(b"" if cells.max() > 255 else cells.astype(np.uint8).tobytes())
                whole.append(np.unique(keys_of(np.array([fingerprint(h)], dtype=np.uint64))[1]) if len(h) else none)
                own = own[np.argsort(rank[own & mask], kind="stable")]
                prefix.append(own[: prefix_length(len(own), similarity) + LEVELS - 1].view(np.int64) if len(own) else none)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), pa.array(whole, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                                             names=["doc", "text_hash", "node", "n", "same", "sketch", "whole", "prefix"])

    return _named(docs).mapInArrow(run, "doc long, text_hash long, node long, n long, same long, sketch binary, whole array<long>, prefix array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the set of 32-bit shingle hashes of each of nodes."""
    told = docs.sparkSession.sparkContext.broadcast(filter_bits(nodes, "node", FILTER_BITS))

    def run(batches):
        flags, mask = flags_of(told.value), (1 << FILTER_BITS) - 1
        for part in slices(batches):
            node, sets = [], []
            for t in texts_of(part):
                x = xxhash.xxh3_64_intdigest(b" ".join(t.lower().split()))
                if flags[x & mask]:
                    node.append(x)
                    sets.append(np.unique(shingle_hashes(t, k).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    got = docs.select("text").mapInArrow(run, "node long, shingles array<int>")
    return got.join(shuffled(nodes), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _shared(nodes: DataFrame, similarity: float) -> DataFrame:
    """(key, size, node, n, at): the keys that two texts or more share, at the key's place in the prefix, -1 for a fingerprint's."""
    parts = [_shared_of(nodes, similarity, share) for share in range(PASSES)]
    out = materialize(reduce(DataFrame.unionByName, parts), "near-met")
    discard(*parts)
    return out


def _shared_of(nodes: DataFrame, similarity: float, share: int) -> DataFrame:
    """Those of the keys of a share: told by bits above those of the filter, which keeps its size for each."""
    keys = nodes.select("node", F.explode(F.concat("whole", F.slice("prefix", F.lit(1), _prefix(similarity, 1)))).alias("key"))
    keys = keys.where(F.pmod(F.shiftright("key", FILTER_BITS), F.lit(PASSES)) == share)
    shared = materialize(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"), "near-shared")
    collect(shared)
    told = nodes.sparkSession.sparkContext.broadcast(filter_bits(shared, "key", FILTER_BITS))

    def run(batches):
        flags, mask = flags_of(told.value), (1 << FILTER_BITS) - 1
        for b in batches:
            for c, place in ((2, False), (3, True)):
                part = b.column(c)
                lengths = np.diff(part.offsets.to_numpy())
                key = part.flatten().to_numpy()
                row = np.repeat(np.arange(len(lengths)), lengths)
                at = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths) if place else np.full(len(key), -1)
                fine = np.flatnonzero(((key >> FILTER_BITS) % PASSES == share) & (flags[key & mask] > 0))
                yield pa.RecordBatch.from_arrays([pa.array(key[fine]), b.column(0).take(pa.array(row[fine])), b.column(1).take(pa.array(row[fine])), pa.array(at[fine].astype(np.int32))], names=["key", "node", "n", "at"])

    rows = nodes.select("node", "n", "whole", F.slice("prefix", F.lit(1), _prefix(similarity, 1)).alias("prefix")).mapInArrow(run, "key long, node long, n long, at int")
    rows = materialize(rows.dropDuplicates(["key", "node"]), "near-keys")  # a text's copies count once
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    out = materialize(rows.join(shuffled(sizes), "key"), "near-met-part")
    discard(shared, rows)
    return out


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) whose sketches do not rule the similarity out."""
    side = lambda c, n, t: shuffled(sketches.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(t)))

    def run(batches):
        for x in batches:
            need = np.ceil((x.column(2).to_numpy() + x.column(3).to_numpy()) * (similarity / (1 + similarity)) - 1e-9)
            left, right = x.column(4).to_pylist(), x.column(5).to_pylist()
            told = np.array([bool(p and q) for p, q in zip(left, right)], bool)
            rows = np.flatnonzero(told)
            cells = [np.frombuffer(b"".join(t[i] for i in rows), np.uint8).reshape(-1, CELLS) for t in (left, right)]
            told[rows] = np.minimum(*cells).sum(axis=1, dtype=np.int64) < need[rows]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(~told))

    both = pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return both.mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, k: int, similarity: float) -> DataFrame:
    """pairs (a, b) whose shingle sets are that similar."""
    pairs, all_pairs = materialize(_possible(pairs, sketches, similarity), "near-possible"), pairs
    told = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    told = materialize(told, "near-nodes")
    sets = materialize(_sets(docs, told, k), "near-sets")
    left = shuffled(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")))
    right = shuffled(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")))
    both = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("x", "y")))
    out = materialize(both.where(F.col("c") >= similarity * (F.size("x") + F.size("y") - F.col("c"))).select("a", "b"), "near-links")
    discard(told, sets, pairs, all_pairs)
    return out


def _alike(x, y, similarity: float):
    return F.least(x, y) >= similarity * F.greatest(x, y)


def _first_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of small buckets, and the members of larger ones with their leaders."""
    few, crowd = met.where(F.col("size") <= SMALL).select("key", "node", "n"), met.where(F.col("size") > SMALL).select("key", "node", "n")
    lead = [F.min(F.struct(F.xxhash64(F.lit(j), "node").alias("o"), "node", "n")).alias(f"l{j}") for j in range(LEADERS)]
    leaders = F.array_distinct(F.array(*(F.struct(F.col(f"l{j}.node").alias("node"), F.col(f"l{j}.n").alias("n")) for j in range(LEADERS))))
    led = crowd.join(shuffled(crowd.groupBy("key").agg(*lead).select("key", leaders.alias("leaders"))), "key")
    small = few.alias("x").join(few.alias("y"), "key").where("x.node > y.node").where(_alike(F.col("x.n"), F.col("y.n"), similarity)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    # a text's buckets mostly share their leaders: they are put together (a text has a few dozen keys) before a row is made of each
    own = led.groupBy("node", "n").agg(F.array_distinct(F.flatten(F.collect_list("leaders"))).alias("leaders"))
    fine = F.filter("leaders", lambda l: (l["node"] != F.col("node")) & _alike(F.col("n"), l["n"], similarity))
    large = own.select("node", F.explode(F.transform(fine, lambda l: l["node"])).alias("l")).select(F.greatest("node", "l").alias("a"), F.least("node", "l").alias("b"))
    return small.unionByName(large).distinct()


def _other_pairs(nodes: DataFrame, met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of larger buckets that roots (node, root) do not connect and whose sizes and places allow the similarity.

    A pair is sought at the shingles it shares first. With `level` shared up to these places, no more than the shorter rest can follow."""
    part = met.where((F.col("size") > SMALL) & (F.col("at") >= 0)).select("key", "node", "n", "at")
    members = part.join(shuffled(roots), "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    levels = LEVELS if similarity > 2 / 3 else 1  # then sets of fewer shingles than levels are alike only if equal: linked already
    found, tables = [], []
    for level in range(1, levels + 1):
        members = materialize(members, "near-members")
        sizes = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("most"))
        mixed = sizes.select("key", (F.col("size") - F.col("most.c")).alias("apart"), F.col("most.root").alias("most")).where("apart > 0")
        met = materialize(members.join(shuffled(mixed), "key"), "near-mixed")
        discard(members, *tables)
        few = met if level == levels else met.where(F.col("apart") <= SPLIT)
        need = F.ceil((F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9)
        reach = level + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) - 1
        got = few.where("root <> most").alias("x").join(few.alias("y"), "key").where("x.root <> y.root and (y.root = y.most or x.node > y.node)")
        got = got.where(_alike(F.col("x.n"), F.col("y.n"), similarity) & (reach >= need)).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
        found.append(materialize(got.distinct(), "near-apart"))
        tables = [met]
        if level < levels:
            big = met.where(F.col("apart") > SPLIT).join(shuffled(nodes.select("node", "prefix").dropDuplicates(["node"])), "node")
            after = F.slice("prefix", F.lit(1), _prefix(similarity, level + 1))
            each = big.select("key", "node", "n", "root", F.col("at").alias("before"), F.posexplode(after).alias("at", "next")).where("at > before")
            members = each.select(F.xxhash64("key", "next").alias("key"), "node", "n", "at", "root")
    out = materialize(reduce(DataFrame.unionByName, found).distinct(), "near-rest")
    discard(*tables, *found)
    return out


def links(docs: DataFrame, scanned: DataFrame, k: int, similarity: float) -> DataFrame:
    """(a, b): verified links between different texts that connect all that verified pairs connect."""
    met = _shared(scanned, similarity)
    sketches = materialize(scanned.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "same", "sketch"))), "near-sketches")
    first = _verified(docs, materialize(_first_pairs(met, similarity), "near-pairs"), sketches, k, similarity)
    some = sketches.where("n > 0").select("node", "same")
    twins = some.groupBy("same").agg(F.min("node").alias("b"), F.count("*").alias("size")).where("size > 1").select("same", "b")
    equal = some.join(shuffled(twins), "same").where("node <> b").select(F.col("node").alias("a"), "b")
    first = materialize(first.unionByName(equal), "near-first-links")
    roots = components(first, "near-roots")
    rest = _verified(docs, _other_pairs(scanned, met, roots, similarity), sketches, k, similarity)
    discard(sketches, met)
    return first.unionByName(rest)


def groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, text_hash, first): every document (doc_id and hash of its text) of a group of two or more, with the
    group's first (doc, text_hash): that of the smallest doc_id, null ones last.

    Texts of the same words (A-Z lower-cased, white space aside) are one node, so copies cost no pair; texts without words
    are copies of each other. Empty tables give no rows."""
    scanned = materialize(_scan(docs, k, similarity), "near-scan")
    roots = components(links(docs, scanned, k, similarity), "near-components")
    named = scanned.select("doc", "text_hash", "node").join(roots.select(F.col("node"), "root"), "node", "left").select("doc", "text_hash", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "near-named")
    discard(scanned)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")
    first = materialize(named.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"), "near-first")
    return named.join(first, "root").select("doc", "text_hash", F.struct("first.doc", "first.text_hash").alias("first"))


def dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group: the first. Of rows equal in doc_id and text one stays."""
    gone = groups(docs, k, similarity).where("not (doc <=> first.doc and text_hash <=> first.text_hash)").select("doc", "text_hash").distinct()
    gone = materialize(gone, "near-gone")
    base = docs.select(F.col("doc_id").cast("long").alias("own_doc"), F.xxhash64("text").alias("own_hash"), F.struct(*docs.columns).alias("row"))
    kept = base.join(gone, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_hash") == F.col("text_hash")), "left_anti")
    return kept.dropDuplicates(["own_doc", "own_hash"]).select("row.*")
