"""LM scoring with a probabilistic suffix tree over words.

Symbols are the training words met OFTEN times or more, one for all other words, and an end mark; texts are written down once as
symbols. The tree is grown from them a level at a time, as distributed tables. A context of d symbols is a candidate if it occurs
LEAST times, which the table of the level above tells; only what follows candidates is counted. A candidate stays if what
follows it differs from what follows its suffix: if the divergence, weighted by the context's count, passes a likelihood-ratio
test. All that pass stay, so the tree grows with the corpus. What follows a context fewer than MET times is one event, the rest, in
the test; in the distribution its counts, and what absolute discounting takes off the others, go to the distribution of the longest
retained suffix. A symbol is scored in the state of the longest retained suffix of what stands before it, back to the start of
its text.

Within the symbol of the other words a word has its discounted share of their exact counts; what the discount takes is
the share of the one event "a word not met in training". The events are thus those of the unigram base, which has the
same counts: V words and an unknown one.

A tree of more than MODEL entries is broadcast in parts, one after another. All contexts that a position may stand in end with
the same symbol and lie in one part, so a part scores its positions to the end: a text's score is the sum over the parts, and no
position is ever written or sent. The HEAD most frequent words are broadcast and the counts of the rest are joined.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import collect, discard, filter_bits, flags_of, materialize, shuffled, slices, texts_of

#: Symbols of a context at most, bits of a symbol.
DEPTH, BITS = 3, 16
ABSENT, END, RARE, FIRST = 0, 1, 2, 3
#: Least count of a word that is a symbol of its own, symbols at most (what BITS hold).
OFTEN, SYMBOLS = 500, (1 << BITS) - FIRST
#: Least count of a context, of what is told apart after one, critical value of the test beyond its own spread, and discount.
LEAST, MET, CRITICAL, OFF = 150, 5, 20.0, 0.75
#: Most frequent words (16 bytes each) that are broadcast; entries (12 bytes each) of the tree that are broadcast at once, and the
#: least number for which a part is worth a pass.
HEAD, MODEL, LEAST_PART = 400_000, 6_000_000, 500
#: Bits of the filters that tell which contexts a pass is about (their size is fixed: 1 MB).
FILTER_BITS = 23
#: Passes in which longer contexts are counted, each over all texts and over its share of what is counted.
PASSES = 4
#: Words of a task's table before it is sent on, text handled at once, distinct keys of a task before they are sent on.
LOCAL_WORDS, LOCAL_BYTES, LOCAL_KEYS = 400_000, 3_000_000, 2_000_000
LOW = (1 << BITS) - 1


def contexts(stream: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For contexts of 1 to depth symbols (their number, oldest highest; whether it is there) before each position after the
    first. Nothing stands before an end mark, which counts as a symbol of the context itself."""
    n = len(stream)
    last = np.maximum.accumulate(np.where(stream == END, np.arange(n), -1))
    room = np.arange(1, n) - last[:-1]
    out, now = [], stream.astype(np.int64)
    for d in range(1, depth + 1):
        out.append((now[:-1], room >= d))
        older = np.zeros(n, np.int64)
        older[d:] = stream[: n - d]
        now = now | older << (BITS * d)
    return out


def contexts_at(stream: np.ndarray, at: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for the symbols after the positions `at` alone."""
    now, there = stream[at].astype(np.int64), np.ones(len(at), bool)
    out = [(now, there)]
    for d in range(1, depth):
        there = there & (stream[np.maximum(at - d + 1, 0)] != END)
        now = now | np.where(there, stream[np.maximum(at - d, 0)], 0) << (BITS * d)
        out.append((now, there))
    return out


def slot(x):
    """Where a context stands in a filter."""
    return (x ^ (x >> 19) ^ (x >> 37)) & ((1 << FILTER_BITS) - 1)


def slot_column(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 19)).bitwiseXOR(F.shiftright(x, 37)).bitwiseAND((1 << FILTER_BITS) - 1)


def _filter(states: DataFrame) -> np.ndarray:
    return filter_bits(states.select(slot_column(F.col("ctx")).alias("slot")), "slot", FILTER_BITS)


def signed(h) -> np.ndarray:
    return np.fromiter(h, dtype=np.uint64).view(np.int64)


def merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of tables of counts, sorted by key."""
    k = np.concatenate([k for k, _ in tables])
    o = np.argsort(k, kind="stable")
    k, n = k[o], np.concatenate([n for _, n in tables])[o]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[starts], np.add.reduceat(n, starts)


def discount(once: int, twice: int) -> float:
    """Absolute discounting's estimate from how many were met once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n): counts of all words of docs by their 64-bit hash. Tasks sum up before the shuffle."""

    def run(batches):
        words: Counter = Counter()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(signed(map(xxhash.xxh64_intdigest, words))), pa.array(np.fromiter(words.values(), np.int64, len(words)))], names=["key", "n"])
        for part in slices(batches, limit=LOCAL_BYTES):
            for t in texts_of(part):
                words.update(t.lower().split())
            if len(words) >= LOCAL_WORDS:
                yield table()
                words = Counter()
        if words:
            yield table()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers words as they come; None, the end of a text, is 0."""

    def __init__(self):
        super().__init__({None: 0})
        self.fresh: list[bytes] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Lexicon:
    """Place of words in the head (-1: elsewhere, -2: end of a text) and their hash, memoised; places are in order of frequency."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self._forget()

    def _forget(self):
        self.numbers, self.place, self.hash = _Numbers(), np.array([-2]), np.array([0])

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of every word, texts in a row, each closed by its end."""
        if len(self.numbers) > 300_000:
            self._forget()
        stream = chain.from_iterable(chain(ws, (None,)) for ws in texts)
        ids = np.fromiter(map(self.numbers.__getitem__, stream), np.int64)
        h, self.numbers.fresh = signed(map(xxhash.xxh64_intdigest, self.numbers.fresh)), []
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            place = np.where(self.keys[at] == h, self.order[at], -1)
        else:
            place = np.full(len(h), -1)
        self.place, self.hash = np.concatenate([self.place, place]), np.concatenate([self.hash, h])
        return self.place[ids], self.hash[ids]


def planes(symbols: np.ndarray) -> bytes:
    """16-bit symbols as all their low, then all their high bytes: the table's compression finds the high ones mostly alike."""
    return symbols.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def symbols_in(batch: pa.RecordBatch, name: str = "symbols") -> np.ndarray:
    """The symbols of all rows in a row, after an end mark."""
    parts = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.concatenate([[END], *(np.frombuffer(x, np.uint8).reshape(2, -1).T.ravel().view(np.uint16) for x in parts)]).astype(np.int64)


def share(last, after):
    """The pass that counts what ends with these two symbols: numbers or columns."""
    return ((last * 40503 + after * 30011) & 0xFFFF) * PASSES >> 16


def share_column(up: Column) -> Column:
    mixed = (F.shiftrightunsigned(up, BITS).bitwiseAND(LOW) * 40503 + up.bitwiseAND(LOW) * 30011).bitwiseAND(0xFFFF)
    return F.shiftright(mixed * PASSES, 16)


def count_grams(coded: DataFrame, told, d: int, turn: int) -> DataFrame:
    """(up, key, n): counts of what follows contexts of d symbols, of those that a filter of candidates (told, a broadcast) lets
    through. key is the context with the symbol after it, up the same without the oldest symbol. Rows are dealt by up, where the level
    above has its row; of contexts of more than one symbol a turn counts its share. For those of one that level is broadcast."""

    def run(batches):
        flags, tables, held = flags_of(told.value), [], 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged(tables)], names=["key", "n"])

        for part in batches:
            stream = symbols_in(part)
            at = np.arange(len(stream) - 1) if d == 1 else np.flatnonzero(share(stream[:-1], stream[1:]) == turn)
            ctx, there = contexts_at(stream, at, d)[-1]
            there = there & (flags[slot(ctx)] > 0)
            key, n = np.unique(ctx[there] << BITS | stream[at + 1][there], return_counts=True)
            tables.append((key, n))
            held += len(key)
            if held >= LOCAL_KEYS:
                yield table()
                tables, held = [], 0
        if held:
            yield table()

    rows, up = coded.where("learn").select("symbols").mapInArrow(run, "key long, n long"), F.col("key").bitwiseAND((1 << BITS * d) - 1).alias("up")
    if d == 1:
        return rows.groupBy("key").agg(F.sum("n").alias("n")).select(up, "key", "n")
    return rows.select(up, "key", "n").repartition("up").groupBy("up", "key").agg(F.sum("n").alias("n"))


def grow(coded: DataFrame, symbols: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(contexts, entries) of what stays. symbols (key, n) are all symbols' counts. contexts: ctx, seen (its count), k (followers told
    apart), alpha (log10 of the share of its probability after the suffix that a symbol not told apart keeps). entries: key (ctx and
    follower), seen, lp (log10 probability of the follower after ctx)."""
    total = F.lit(float(symbols.agg(F.sum("n")).first()[0] or 1))
    level = symbols.select("key", "n", total.alias("seen"), (F.col("n") / total).alias("q"))
    kept, entries = [], []
    for d in range(1, depth + 1):
        whole = F.col("n") >= LEAST
        own = level.where(whole if d == 1 else whole & (F.col("key").bitwiseAND(LOW) != END)).select(F.col("key").alias("ctx"), F.col("n").cast("double").alias("all"))
        own = materialize(own, "lm-candidates")  # a table of its own, so that its size is known where it is joined
        above = level.select(F.col("key").alias("up"), (F.col("n") / F.col("seen")).alias("p"), F.col("q").alias("pq"))
        told = coded.sparkSession.sparkContext.broadcast(_filter(own))
        ctx = F.shiftrightunsigned("key", BITS).alias("ctx")
        turns = []
        for turn in range(1 if d == 1 else PASSES):  # each one's shuffle files go before the next one's are written
            side = F.broadcast(above) if d == 1 else shuffled(above.where(share_column(F.col("up")) == turn))  # the symbols: 2 ** BITS rows at most
            grams = count_grams(coded, told, d, turn).where(F.col("n") >= MET)
            turns.append(materialize(grams.join(side, "up").select(ctx, "key", "n", "p", "pq").join(own, "ctx"), "lm-rows"))
            del grams, side
            collect(coded)
        rows = reduce(DataFrame.unionByName, turns)
        sums = rows.groupBy("ctx").agg(F.first("all").alias("all"), F.count("*").alias("k"), F.sum("n").alias("told"), F.sum("p").alias("p"), F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("p"))).alias("gain"))
        rest = F.col("all") - F.col("told")
        gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("all") / F.greatest(1 - F.col("p"), F.lit(1e-9)))).otherwise(0.0)
        # twice the gain is about chi-square with k degrees of freedom if the suffix tells as much
        stays = 2 * gain > CRITICAL + F.col("k") + 2 * F.sqrt(2.0 * F.col("k"))
        told = materialize(sums.select("ctx", F.col("all").alias("seen"), "k", ((OFF * F.col("k") + rest) / F.col("all")).alias("share"), stays.alias("stays")), "lm-told")
        q = F.when(F.col("stays"), (F.col("n") - OFF) / F.col("seen") + F.col("share") * F.col("pq")).otherwise(F.col("pq"))
        level = rows.join(told, "ctx").select("key", "n", "seen", q.alias("q"), "stays")
        level = materialize(level if d < depth else level.where("stays"), "lm-level")
        discard(*turns, own)
        kept.append(told.where("stays").select("ctx", "seen", "k", F.log10("share").alias("alpha")))
        entries.append(level.where("stays").select("key", "seen", F.log10("q").alias("lp")))
    return reduce(DataFrame.unionByName, kept), reduce(DataFrame.unionByName, entries)


def _bin(count: str) -> Column:
    return F.floor(F.log2(count) * 16)


def split_at(bins: DataFrame, room: int) -> int:
    """The least bin from which on all of bins (bin, k) together hold `room` at most."""
    used, cut = 0, 1 << 20
    for r in bins.orderBy(F.desc("bin")).collect():  # a thousand bins at most
        used += r["k"]
        if used > room:
            break
        cut = r["bin"]
    return cut


class Parts:
    """Deals contexts and positions to parts of about `room` entries by the symbol before; a symbol that more than half a part
    follows is dealt by the two symbols before, its contexts of one symbol go to each part it has."""

    def __init__(self, symbols: np.ndarray, single: np.ndarray, deep: np.ndarray, room: int):
        room, size = max(room, LEAST_PART), 1 << BITS
        alone, longer, self.ways = np.zeros(size, np.int64), np.zeros(size, np.int64), np.ones(size, np.int64)
        alone[symbols], longer[symbols] = single, deep
        if (alone + longer).sum() > room:
            self.ways = np.maximum(1, -(-2 * longer // room))
        self.first = np.cumsum(self.ways) - self.ways
        self.part, used, now = np.zeros(int(self.ways.sum()), np.int64), 0, 0
        for i, w in enumerate(np.repeat(alone + longer // self.ways, self.ways).tolist()):
            if used and used + w > room:
                used, now = 0, now + 1
            self.part[i], used = now, used + w
        self.n = now + 1

    @staticmethod
    def way(x):
        """What tells a symbol's ways apart, of the symbol before it: a number or a column."""
        return x * 40503

    def of(self, last: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.part[self.first[last] + (self.way(second) >> 5) % self.ways[last]]

    def positions(self, stream: np.ndarray, part: int) -> np.ndarray:
        """Positions of stream after which a symbol is scored in part."""
        if self.n == 1:
            return np.arange(len(stream) - 1)
        return np.flatnonzero(self.of(stream[:-1], np.concatenate([[ABSENT], stream[:-2]])) == part)

    def dealt(self, rows: DataFrame, context: Column, *columns: Column) -> list[DataFrame]:
        """For each part its rows' columns. The parts are written down apart, each is read alone."""
        if self.n == 1:
            return [rows.select(*columns)]
        last = np.repeat(np.arange(len(self.ways)), self.ways)
        plan = pa.table({"last": last, "way": np.arange(len(last)) - self.first[last], "ways": self.ways[last], "part": self.part})
        plan = F.broadcast(rows.sparkSession.createDataFrame(plan))  # 2 ** BITS rows, and two more for each part
        second, way = F.shiftrightunsigned(context, BITS).bitwiseAND(LOW), F.col("way")
        rows = rows.select(*columns, context.bitwiseAND(LOW).alias("last"), second.alias("second"))
        deep = rows.where("second <> 0").join(plan, "last").where(F.shiftright(self.way(F.col("second")), 5) % F.col("ways") == way)
        single = rows.where("second = 0").join(plan.select("last", "part").distinct(), "last")
        names = rows.columns[: len(columns)]
        got = materialize(deep.select("part", *names).unionByName(single.select("part", *names)).repartition("part").sortWithinPartitions("part"), "lm-parts")
        return [got.where(F.col("part") == i).select(*names) for i in range(self.n)]


class Tree:
    """A part's contexts as sorted arrays, and the symbols' own probabilities (log10)."""

    def __init__(self, root: np.ndarray, ctx: np.ndarray, alpha: np.ndarray, key: np.ndarray, lp: np.ndarray):
        self.root, self.ctx, self.alpha, self.key, self.lp = root, ctx, alpha, key, lp

    @staticmethod
    def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether it is there) of x in a sorted table."""
        if not len(table):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def log10(self, after: np.ndarray, told: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 probability of the symbols `after`, in the states told (see `contexts`)."""
        out, left = np.zeros(len(after)), np.arange(len(after))
        for ctx, there in reversed(told):
            rows = left[there[left]]
            place, is_state = self.find(self.ctx, ctx[rows])
            rows, place = rows[is_state], place[is_state]
            where, met = self.find(self.key, ctx[rows] << BITS | after[rows])
            out[rows] += np.where(met, self.lp[where] if len(self.lp) else 0.0, self.alpha[place])
            done = np.zeros(len(out), bool)
            done[rows[met]] = True
            left = left[~done[left]]
        out[left] += self.root[after[left]]
        return out


def encoded(docs: DataFrame, head, counts, n_symbols: int, z: float, end_base: float, known_end: int, own: tuple[float, float]) -> DataFrame:
    """(doc_id, learn, symbols, n_tokens, n_known, base, own, tail): texts as symbols (16 bits each, an end mark last), sums of what the
    head's words have in the base and within the symbol of other words, and the hashes of words that the head lacks."""
    less, mass = own
    out = StructType.fromDDL("doc_id long, learn boolean, symbols binary, n_tokens long, n_known long, base double, own double, tail array<long>")
    out.fields[0] = docs.schema["doc_id"]

    def run(batches):
        lexicon, ns = Lexicon(head.value), counts.value
        base_of = np.concatenate([np.log10(ns + 0.1) - z, [end_base, 0.0]])  # places -2: end, -1: joined later
        own_of = np.concatenate([np.zeros(n_symbols), np.log10(np.maximum(ns[n_symbols:] - less, 1e-9) / mass), [0.0, 0.0]])
        for part in slices(batches, limit=LOCAL_BYTES):
            place, hashes = lexicon([t.lower().split() for t in texts_of(part)])
            symbols = np.where(place == -2, END, np.where((place >= 0) & (place < n_symbols), place + FIRST, RARE)).astype(np.uint16)
            rare = place == -1
            ends = np.flatnonzero(place == -2)
            first = np.concatenate([[0], ends[:-1] + 1])
            known = np.where(place == -2, known_end, place >= 0).astype(np.int64)
            sums = lambda x: pa.array(np.add.reduceat(x, first))
            lens = np.concatenate([[0], np.cumsum(np.add.reduceat(rare.astype(np.int32), first))]).astype(np.int32)
            data = pa.array([planes(symbols[a : b + 1]) for a, b in zip(first, ends)], pa.binary())
            tail = pa.ListArray.from_arrays(pa.array(lens), pa.array(hashes[rare]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), data, pa.array(ends - first + 1), sums(known), sums(base_of[place]), sums(own_of[place]), tail], names=out.names)

    return docs.select("doc_id", "text", "learn").mapInArrow(run, out)


def walked(coded: DataFrame, told, part: int) -> DataFrame:
    """(row, lp): sums of the log10 probabilities of the symbols that a part of the tree scores; told is a broadcast (tree, parts)."""

    def run(batches):
        tree, parts = told.value
        for batch in batches:
            stream = symbols_in(batch, "symbols")
            at = parts.positions(stream, part)
            ends = np.flatnonzero(stream[1:] == END)
            row = np.searchsorted(ends, at)
            past = contexts(stream, DEPTH) if parts.n == 1 else contexts_at(stream, at, DEPTH)
            lp, met = np.bincount(row, tree.log10(stream[at + 1], past), len(ends)), np.bincount(row, minlength=len(ends)) > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(met)), pa.array(lp[met])], names=["row", "lp"])

    return coded.select("row", "symbols").mapInArrow(run, "row long, lp double")


def _scored(coded: DataFrame, root: np.ndarray, parts: Parts, part: int, states: DataFrame, entries: DataFrame) -> DataFrame:
    """What a part scores, written down; the part is let go."""
    near, close = states.toArrow().sort_by("ctx"), entries.toArrow().sort_by("key")  # `room` rows or so
    tree = Tree(root, *(t[c].to_numpy() for t, c in ((near, "ctx"), (near, "alpha"), (close, "key"), (close, "lp"))))
    del near, close
    told = coded.sparkSession.sparkContext.broadcast((tree, parts))
    del tree
    got = materialize(walked(coded, told, part), "lm-walked")
    told.destroy()
    return got


def score(docs: DataFrame, training=None, room: int = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs; `training` says which rows are
    learned from (default: all). `room` bounds what is broadcast of the tree at once; it does not change a score.

    Null text counts as empty: one token, the end. With nothing to learn from every word is unknown. Repeated rows count
    and score each; a null doc_id is a row like any other; further columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.coalesce(training, F.lit(False)) if training is not None else F.lit(True)).alias("learn"))
    learned = docs.where("learn")
    n_docs = learned.count()
    words = materialize(count_words(learned), "lm-words")
    collect(words)
    total, distinct, once, twice = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n, v, less = total + n_docs, distinct + (1 if n_docs else 0), discount(once, twice)
    z = float(np.log10(n + 0.1 * (v + 1)))
    scale = _bin("n")
    top = words.where(scale >= split_at(words.groupBy(scale.alias("bin")).agg(F.count("*").alias("k")), HEAD)).toArrow().sort_by([("n", "descending"), ("key", "ascending")])  # HEAD rows at most
    keys, ns = top["key"].to_numpy(), top["n"].to_numpy()
    n_symbols = min(SYMBOLS, int((ns >= OFTEN).sum()))
    # the class of other words: their discounted shares, and the share of a word not met
    others, other_words = total - int(ns[:n_symbols].sum()), distinct - n_symbols
    mass = float(max(others, 1))
    unknown = float(np.log10(max(less * other_words, less) / mass))
    counted = [(END, n_docs), (RARE, max(others, 1)), *((FIRST + i, int(x)) for i, x in enumerate(ns[:n_symbols]))]
    end_base = float(np.log10(n_docs + 0.1)) - z
    head, counts = spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(ns)
    coded = encoded(docs, head, counts, n_symbols, z, end_base, 1 if n_docs else 0, (less, mass))
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    states, entries = grow(coded, spark.createDataFrame([x for x in counted if x[1]], "key long, n long"))
    root = np.full(1 << BITS, -np.inf)
    for x, m in counted:
        root[x] = np.log10(max(m, 0.1) / max(sum(m for _, m in counted), 1))
    k, lone = F.col("k") + 1, F.col("ctx") <= LOW  # a context's entries and itself
    sizes = states.groupBy(F.col("ctx").bitwiseAND(LOW).alias("last")).agg(F.sum(F.when(lone, k).otherwise(0)).alias("single"), F.sum(F.when(lone, 0).otherwise(k)).alias("deep")).toArrow()  # 2 ** BITS rows at most
    parts = Parts(*(sizes[c].to_numpy() for c in ("last", "single", "deep")), room)
    near = parts.dealt(states, F.col("ctx"), F.col("ctx"), F.col("alpha").cast("float").alias("alpha"))
    close = parts.dealt(entries, F.shiftrightunsigned("key", BITS), F.col("key"), F.col("lp").cast("float").alias("lp"))
    scored = [_scored(coded, root, parts, i, *x) for i, x in enumerate(zip(near, close))]
    scored = scored[0] if parts.n == 1 else reduce(DataFrame.unionByName, scored).groupBy("row").agg(F.sum("lp").alias("lp"))
    # the other words: no one of them is among the HEAD most frequent, so no key of this join is hot
    met = F.col("n").isNotNull()
    rest = coded.select("row", F.explode("tail").alias("key")).join(shuffled(words), "key", "left").groupBy("row").agg(
        F.sum(F.when(met, F.log10(F.col("n") + 0.1) - z).otherwise(-z - 1.0)).alias("more_base"),
        F.sum(F.when(met, F.log10((F.col("n") - less) / mass)).otherwise(unknown)).alias("more_own"), F.count("n").alias("more"))
    zero = F.lit(0.0)
    got = coded.drop("symbols", "tail", "learn").join(scored.select("row", "lp"), "row").join(rest, "row", "left")
    return got.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
                      (F.col("lp") + F.col("own") + F.coalesce("more_own", zero)).alias("score"))
