"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A merge list decides how many bytes to the right of a token can still change it. `Merges.lookahead` computes a
sufficient bound from the list itself: a rule (b, c) can only be kept from firing on the right by c's own formation or
by a rule of lower rank that takes c first, so the bound is a longest path through rules of falling rank. Tokens that
end further from the buffer's end than that are stable and leave; the rest waits for more bytes. Memory is the bound
plus one block, whatever the text's length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: The split pattern of byte-level BPE vocabularies.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
RUNS = [regex.compile(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]
#: Characters of text fed at once, bytes of an open piece kept beside the lookahead, and pieces remembered.
BLOCK, WINDOW, MEMO = 65_536, 4_096, 250_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the
    others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.ids, self.special = ids, special or {}
        self.rule = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [ids[a + b] for a, b in pairs]
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for b, i in ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.first = [ids.get(bytes([b])) for b in range(256)]
        self.lookahead = self._lookahead(pairs)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _lookahead(pairs) -> int:
        formed: dict[bytes, int] = {}  # bytes right of a token that its formation depends on
        taken: dict[bytes, int] = {}  # bytes right of a token that the rules so far could take or need
        for a, b in pairs:
            f = max(0, formed.get(b, 0), taken.get(b, 0), formed.get(a, 0) - len(b))
            formed[a + b] = max(f, formed.get(a + b, 0))
            taken[a] = max(taken.get(a, 0), len(b) + f)
        return max([1, *taken.values(), *formed.values()])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the lowest rank first, the leftmost of equal ranks first."""
        first, rule, made, none = self.first, self.rule.get, self.made, len(self.made)
        parts = [first[b] for b in piece]
        if len(parts) <= 48:
            ranks = [rule(x << 32 | y, none) for x, y in zip(parts, parts[1:])]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                parts[i] = new = made[r]
                del parts[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = rule(new << 32 | parts[i + 1], none)
                if i:
                    ranks[i - 1] = rule(parts[i - 1] << 32 | new, none)
            return parts
        n = len(parts)
        left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []
        for i in range(n - 1):
            if (r := rule(parts[i] << 32 | parts[i + 1], none)) < none:
                heap.append((r, i, parts[i], parts[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j, new = right[i], made[r]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = new, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q < n and (r := rule(parts[p] << 32 | parts[q], none)) < none:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return [p for p in parts if p != -1]


class OpenPiece:
    """Encodes one piece of unbounded length, a fragment at a time."""

    def __init__(self, merges: Merges):
        self.m, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), WINDOW):
            self.held += data[at : at + WINDOW]
            out += self._stable(len(self.held) - self.m.lookahead)
        return out

    def _stable(self, limit: int) -> list[int]:
        if limit <= 0:
            return []
        out, end = [], 0
        for t in self.m.merge(self.held):
            if end + len(self.m.bytes_of[t]) > limit:
                break
            end += len(self.m.bytes_of[t])
            out.append(t)
        self.held = self.held[end:]
        return out

    def close(self) -> list[int]:
        out, self.held = (self.m.merge(self.held) if self.held else []), b""
        return out


class Encoder:
    """feed() text in blocks of any size, then finish(): ids leave as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.m, self.tail, self.open, self.kind = merges, "", None, 0

    def _ids(self, pieces) -> list[int]:
        m, memo, out = self.m, self.m.memo, []
        for p in pieces:
            got = memo.get(p)
            if got is None:
                got = m.older.get(p) or tuple(m.merge(p.encode()))
                if len(p) <= 64:
                    if len(memo) >= MEMO:  # what has not been met since the last turn is forgotten
                        m.older, m.memo = memo, {}
                        memo = m.memo
                    memo[p] = got
            out += got
        return out

    def feed(self, block: str, last: bool = False) -> array:
        out, buf = array("I"), self.tail + block
        self.tail = ""
        while buf or self.open:
            if self.open:
                m = RUNS[self.kind].match(buf)
                end = m.end() if m else 0
                ended = end < len(buf) or last
                keep = 1 if self.kind == 0 and not (last and end == len(buf)) and end else 0  # the last space may belong to what follows
                out.extend(self.open.feed(buf[: end - keep].encode()))
                buf = buf[end - keep :]
                if not ended:
                    self.tail = buf
                    return out
                out.extend(self.open.close())
                self.open = None
                continue
            if last:
                out.extend(self._ids(PIECES.findall(buf)))
                return out
            pieces, pos = [], 0
            for m in PIECES.finditer(buf):
                if m.end() > len(buf) - 3:
                    break
                pieces.append(m.group())
                pos = m.end()
            out.extend(self._ids(pieces))
            buf = buf[pos:]
            if len(buf) <= WINDOW:
                self.tail = buf
                return out
            lead = 1 if buf[0] == " " and not RUNS[0].match(buf[1]) else 0
            self.kind = next(k for k, r in enumerate(RUNS) if r.match(buf[lead]))
            self.open = OpenPiece(self.m)
            out.extend(self.open.feed(buf[:lead].encode()))
            buf = buf[lead:]
        return out

    def finish(self) -> array:
        return self.feed("", last=True)


@lru_cache(maxsize=8)
def _finder(special: tuple[str, ...]):
    """Expression of the strings of special tokens, of several at one place the longest."""
    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")


def _plain(merges: Merges, text: str, start: int, end: int, out: array) -> None:
    if end - start <= BLOCK:
        out.extend(Encoder(merges).feed(text[start:end], last=True))
        return
    e = Encoder(merges)
    for p in range(start, end, BLOCK):
        out.extend(e.feed(text[p : min(p + BLOCK, end)]))
    out.extend(e.finish())


def encode(merges: Merges, text: str) -> array:
    """Ids of a whole text; the strings of special tokens become their ids, as the tokenizers library has it. They are found in
    one pass, however many there are."""
    out, at = array("I"), 0
    for m in _finder(tuple(merges.special)).finditer(text):
        _plain(merges, text, at, m.start(), out)
        out.append(merges.special[m[0]])
        at = m.end()
    _plain(merges, text, at, len(text), out)
    return out


class Decoder:
    """Byte-to-text state machine: a code point leaves once its last byte has come; malformed bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.of, self.state = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.of.__getitem__, ids)), last)


def decode(merges: Merges, ids) -> str:
    d = Decoder(merges)
    return "".join([d.feed(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]) + d.feed([], True)


@lru_cache(maxsize=4)
def load(path: str) -> Merges:
    """A byte-level BPE in the tokenizers library's JSON form. The file must be at this path on every machine."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    back = {c: b for b, c in byte_letters().items()}
    raw = lambda s: bytes(back[c] for c in s)
    added = {a["content"]: a["id"] for a in j.get("added_tokens", [])}
    ids = {raw(s): i for s, i in j["model"]["vocab"].items() if s not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
    return Merges(ids, [(raw(a), raw(b)) for a, b in pairs], added)


def encode_documents(docs: DataFrame, path: str, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs' columns (or keep) plus n_tokens, ids array<int> and, on demand, decoded, the text read back from the ids.

    A narrow map: one pass, no shuffle, a text at a time in blocks. Null text counts as empty: no ids, decoded "".
    Columns of docs that clash with the new names give way to them. Repeated rows are encoded each.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("n_tokens", "ids", "decoded")]
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32()))] + [pa.field("decoded", pa.string())] * decoded
    ddl = "n_tokens long, ids array<int>" + ", decoded string" * decoded

    def make():
        m = load(path)

        def add(texts: list[bytes]) -> dict:
            ids = [encode(m, t.decode("utf-8", "replace")) for t in texts]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.frombuffer(b"".join(x.tobytes() for x in ids), dtype=np.int32)
            return {"n_tokens": [len(x) for x in ids], "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))} | ({"decoded": [decode(m, x) for x in ids]} if decoded else {})

        return add

    return map_texts(docs, None, fields, ddl, keep, make=make)


def ids_digest(df: DataFrame, keep: list[str], ids: str = "ids") -> DataFrame:
    """keep's columns plus ids_sha256: lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit integers."""
    from pyspark.sql.types import StructType

    out = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("ids_sha256 string").fields])

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            flat, ends = col.values.to_numpy(zero_copy_only=False).astype("<u4"), col.offsets.to_numpy()
            sums = [hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sums)], names=[*keep, "ids_sha256"])

    return df.select(*keep, ids).mapInArrow(run, out)
