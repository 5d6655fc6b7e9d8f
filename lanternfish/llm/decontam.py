"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (normalised) form one automaton; a training text runs through it a word at a time, the longest match
that ends at each word being its length. A match of `window` words, or a whole shorter item, is an occurrence; its words
are hit. The automaton is built over blocks of items of bounded size, each block a pass, so what is broadcast never
follows the benchmark's size.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SLICE_CHARS, lean, materialize, slices, texts_of

WINDOW = 10
#: Words of one automaton at most: about 2 states and 3 transitions each, near 60 MB.
BLOCK_WORDS = 100_000
#: A-Z fall to a-z, digits, a-z and bytes from 0x80 stay, all else parts words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids, self.vocab = window, [], {}
        nxt: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        at: dict[str, int] = {}
        paths = []
        for name, ws in items:
            k = at.setdefault(name, len(at))
            last, path = 0, []
            for w in ws:
                last = self._add(nxt, link, size, last, self.vocab.setdefault(w, len(self.vocab)))
                path.append(last)
            paths.append((k, len(ws), path))
        self.ids = list(at)
        self.link, self.size = link, size
        self.step = {s << 32 | c: t for s, to in enumerate(nxt) for c, t in to.items()}
        # The state of the `window`-word suffix of each state, the items it occurs in, and the short items that end in a state.
        self.at_window = [-1] * len(size)
        self.found: dict[int, tuple[int, ...]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        within: dict[int, set[int]] = {}
        for k, n, path in paths:
            if n < window:
                whole.setdefault(path[-1], []).append((n, k))
                continue
            for v in path[window - 1 :]:
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                within.setdefault(u, set()).add(k)
        self.found = {u: tuple(sorted(s)) for u, s in within.items()}
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for v in sorted(range(len(size)), key=size.__getitem__):
            up = link[v]
            if up >= 0:
                got = self.short.get(up, ()) + tuple(whole.get(v, ()))
                if got:
                    self.short[v] = got
                self.at_window[v] = v if size[v] >= window > size[up] else self.at_window[up]
        self.least = min([n for _, n, _ in paths] + [window])

    @staticmethod
    def _add(nxt, link, size, last: int, c: int) -> int:
        if (q := nxt[last].get(c)) is not None:
            if size[q] == size[last] + 1:
                return q
            return Automaton._clone(nxt, link, size, last, c, q)
        cur = len(size)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else Automaton._clone(nxt, link, size, p, c, q)
        return cur

    @staticmethod
    def _clone(nxt, link, size, p: int, c: int, q: int) -> int:
        new = len(size)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def scan(self, ids: list[int], base: int = 0):
        """(end, length, items) of each occurrence in a run of known words; end is exclusive."""
        step, link, size, k = self.step, self.link, self.size, self.window
        v = n = 0
        for i, c in enumerate(ids, base + 1):
            to = step.get(v << 32 | c)
            while to is None and v:
                v = link[v]
                n = size[v]
                to = step.get(v << 32 | c)
            if to is None:
                continue
            v, n = to, n + 1
            if n >= k:
                u = v if size[link[v]] < k else self.at_window[v]
                yield i, k, self.found.get(u, ())
            for m, item in self.short.get(v, ()):
                if m <= n:
                    yield i, m, (item,)


def occurrences(a: Automaton, texts: list[bytes]):
    """For each text: its number of words, the hit runs [(start, end) in words, merged] and the item numbers."""
    counts, joined = [], []
    for t in texts:
        joined.append(t.translate(FOLD))
        joined.append(b"\x01")
    stream = b" ".join(joined).split()
    get = a.vocab.get
    ids = np.fromiter((get(w, -1) for w in stream), dtype=np.int64, count=len(stream))
    ends = np.fromiter((i for i, w in enumerate(stream) if w == b"\x01"), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(texts) else ends
    counts = ends - starts
    known = np.concatenate([[False], ids >= 0, [False]])
    change = np.flatnonzero(known[1:] != known[:-1])
    first, after = change[::2], change[1::2]
    keep = after - first >= a.least
    hits: dict[int, tuple[list, set]] = {}
    for s, e in zip(first[keep].tolist(), after[keep].tolist()):
        doc = None
        for end, n, items in a.scan(ids[s:e].tolist(), s):
            if doc is None:
                doc = int(np.searchsorted(ends, s))
                runs, who = hits.setdefault(doc, ([], set()))
                off = int(starts[doc])
            runs.append((end - n - off, end - off))
            who.update(items)
    return counts.tolist(), {d: (merge(r), w) for d, (r, w) in hits.items()}


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """Blocks of (item id as text, words), of at most block_words words each; a longer item is cut into overlapping parts."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ws = words((row[1] or "").encode())
        parts = [ws] if len(ws) <= block_words else [ws[i : i + block_words] for i in range(0, len(ws) - window + 1, block_words - window + 1)]
        for part in parts:
            if part and n + len(part) > block_words and block:
                yield block
                block, n = [], 0
            if part:
                block.append((row[0] if row[0] is not None else "", part))
                n += len(part)
    if block:
        yield block


EXTRA = "n_words long, hit_runs array<struct<start:long,end:long>>, items array<string>"


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs plus n_words, hit_runs (in words, end exclusive, merged) and items (ids as text, sorted, distinct).

    Null or wordless texts have no words and no hits; items without words never occur; a null item id counts as "".
    Repeated documents are matched each. Columns of docs with these names give way. No shuffle: each block of items is
    one more map over the documents (a written table between blocks)."""
    keep = [c for c in docs.columns if c not in ("n_words", "hit_runs", "items")]
    base = StructType([docs.schema[c] for c in keep])
    out = StructType([*base.fields, *StructType.fromDDL(EXTRA).fields])
    return _passes(docs.select(*keep), benchmark, window, block_words, _pass, out)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, make, last_schema: StructType) -> DataFrame:
    """One map over docs for each block of items; make gives the last one's function."""
    df = lean(docs).withColumns({"n_words": F.lit(0).cast("long"), "hit_runs": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    plain = StructType([*docs.schema.fields, *StructType.fromDDL(EXTRA).fields])
    todo = _at_least_one(blocks(benchmark, block_words, window))
    block = next(todo)
    while block is not None:
        after = next(todo, None)
        told, name = docs.sparkSession.sparkContext.broadcast((block, window)), uuid.uuid4().hex
        if after is None:
            return df.select(*plain.names).mapInArrow(make(told, name, plain.names), last_schema)
        df = materialize(df.select(*plain.names).mapInArrow(_pass(told, name, plain.names), plain), "decontam")
        block = after


def _at_least_one(it):
    some = False
    for x in it:
        some = True
        yield x
    if not some:
        yield []


_BUILT: dict = {}


def _automaton(told, name: str) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        items, window = told.value
        _BUILT[name] = Automaton(items, window)
    return _BUILT[name]


def _pass(told, name, names):
    def run(batches):
        a = _automaton(told, name)
        for part in slices(batches, limit=SLICE_CHARS):
            counts, hits = occurrences(a, texts_of(part))
            col = lambda c: part.column(part.schema.get_field_index(c))
            runs, items = col("hit_runs").to_pylist(), col("items").to_pylist()
            for d, (r, who) in hits.items():
                runs[d] = [{"start": s, "end": e} for s, e in merge([(x["start"], x["end"]) for x in runs[d]] + r)]
                items[d] = sorted({*items[d], *(a.ids[k] for k in who)})
            new = {"n_words": pa.array(counts, pa.int64()), "hit_runs": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else col(c) for c in names], names=names)

    return run


def n_hit() -> F.Column:
    return F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])


def clean_text(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the words of the runs (and what lies between them)."""
    spans = [m.span() for m in SPLIT.finditer(text)] if runs else []
    out, at = [], 0
    for s, e in runs:
        out.append(text[at : spans[s][0]])
        at = spans[e - 1][1]
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """docs without contamination: hit runs of more than max_span words leave the text, and a document of whose words
    more than max_coverage are hit leaves whole. Documents without a hit come back as they were."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), "text")  # so that no column clashes with what matching adds
    schema = StructType([rows.schema["_row"], rows.schema["text"]])
    cuts = (max_span, max_coverage)
    got = _passes(rows, benchmark, window, BLOCK_WORDS, lambda told, name, columns: _clean(told, name, cuts), schema)
    return got.select(*(F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in names))


def _clean(told, name, cuts):
    """The last pass over (_row, text, n_words, hit_runs, items): matching and cutting in one."""
    max_span, max_coverage = cuts

    def run(batches):
        a = _automaton(told, name)
        for part in slices(batches, limit=SLICE_CHARS):
            counts, hits = occurrences(a, texts_of(part))
            texts, before = part.column(1), part.column(3).to_pylist()
            keep, cut = [True] * part.num_rows, {}
            for d in {*hits, *(i for i, r in enumerate(before) if r)}:
                runs = merge([(x["start"], x["end"]) for x in before[d]] + hits.get(d, ([], ()))[0])
                keep[d] = sum(e - s for s, e in runs) <= max_coverage * counts[d]
                cut[d] = [r for r in runs if r[1] - r[0] > max_span]
            if cut:
                ts = texts.to_pylist()
                for d, runs in cut.items():
                    ts[d] = clean_text(ts[d], runs)
                texts = pa.array(ts, pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), texts], names=["_row", "text"]).filter(pa.array(keep, pa.bool_()))

    return run


def items_digest() -> F.Column:
    return F.sha2(F.array_join(F.array_sort("items"), ","), 256)


def digest_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
