"""What archives hold: records of one capture, source-map references, strings built from literals, failed date ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from datetime import date, datetime, timedelta, timezone
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_BYTES = 3_000_000
# What a content type must hold for its text to be analysed, and the charsets that are read.
TEXT_TYPES = ("text/", "javascript", "json", "xml", "octet-stream")
CHARSETS = {"utf-8": "utf-8-sig", "utf8": "utf-8-sig", "us-ascii": "ascii", "iso-8859-1": "latin-1", "windows-1252": "cp1252"}
RECORD = "uri string, captured string, status int, mime string, text string, problem string"


def _instant(text: str) -> str:
    """A date with its zone as digits of UTC, "" if it is none."""
    try:
        moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return ""
    return moment.astimezone(timezone.utc).strftime("%Y%m%d%H%M%S") if moment.tzinfo else ""


def record(data: bytes, want_uri: str | None = None, want_digest: str | None = None, want_time: str | None = None) -> dict:
    """The response of one gzip member of an archive: its text, or the problem that keeps it from being used."""
    empty = dict.fromkeys(x.split()[0] for x in RECORD.split(", "))
    try:
        d = zlib.decompressobj(31)
        raw = d.decompress(data, MAX_BYTES + 1)
    except zlib.error:
        return empty | {"problem": "not gzip"}
    if len(raw) > MAX_BYTES or d.unconsumed_tail:
        return empty | {"problem": "too large"}
    if not d.eof or d.unused_data:
        return empty | {"problem": "not one member"}
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    http, _, body = block.partition(b"\r\n\r\n")
    lines = http.decode("latin-1").split("\r\n")
    kind = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])).get("content-type", "")
    body = body.removesuffix(b"\r\n\r\n")
    out = empty | {"uri": fields.get("warc-target-uri"), "captured": _instant(fields.get("warc-date", "")), "mime": kind.split(";")[0].strip().lower()}
    status = re.match(r"HTTP/\d\S* (\d{3})", lines[0])
    out["status"] = int(status[1]) if status else None
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    told = fields.get("warc-payload-digest", "").upper().removeprefix("SHA1:")
    charset = re.search(r"charset=[\"']?([a-z0-9_-]+)", kind.lower())
    checks = (("not a response", fields.get("warc-type") == "response"), ("other uri", want_uri in (None, out["uri"])), ("other digest", want_digest in (None, told) and told in ("", digest)), ("other time", bool(out["captured"]) and want_time in (None, out["captured"])),
              ("not found", out["status"] == 200), ("type", any(k in kind.lower() for k in TEXT_TYPES)))
    problem = next((name for name, ok in checks if not ok), None)
    if problem:
        return out | {"problem": problem}
    try:
        text = body.decode(CHARSETS[charset[1] if charset else "utf-8"])
    except (KeyError, UnicodeError):
        return out | {"problem": "charset"}
    return out | ({"problem": "binary"} if "\0" in text else {"text": text})


def records(files: DataFrame) -> DataFrame:
    """(path, RECORD) of binaryFile rows, each one member; a record that cannot be used says why."""
    schema = StructType([files.schema["path"], *StructType.fromDDL(RECORD).fields])

    def run(batches):
        for b in batches:
            rows = [record(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[f.name] for r in rows], pa.int32() if f.name == "status" else pa.string()) for f in schema.fields[1:])], names=schema.names)

    return files.select("path", "content").mapInArrow(run, schema)


def member(uri: str, captured: str, body: bytes, kind: str = "text/html") -> bytes:
    """One gzip member as `record` reads it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n\r\n".encode() + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {captured}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n", mtime=0)


_TOKEN = re.compile(r"""//[#@]\s*sourceMappingURL=(?P<line>\S+)[^\S\n]*$|/\*[#@]\s*sourceMappingURL=(?P<block>[^\s*]+)\s*\*/|//[^\n]*|/\*.*?\*/|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)""", re.S | re.M)
#: Heads of data URLs that hold a map.
INLINE_MAPS = ("data:application/json;base64", "data:application/json;charset=utf-8;base64")


def map_reference(script: str) -> str | None:
    """The last source-map directive that stands in a comment, not in a string."""
    found = [m["line"] or m["block"] for m in _TOKEN.finditer(script) if m["line"] or m["block"]]
    return found[-1] if found else None


def declared_map(script: str, url: str) -> str | None:
    """What a script's directive names: the address of its map, or the map itself where it is inline. Other inline data raise."""
    told = map_reference(script)
    if told is None or not told.startswith("data:"):
        return told and urljoin(url, told)
    head, _, body = told.partition(",")
    if head not in INLINE_MAPS or len(told) > 2 * MAX_BYTES:
        raise ValueError("unsupported inline map")
    text = base64.b64decode(body, validate=True)
    if len(text) > MAX_BYTES:
        raise ValueError("map too large")
    return text.decode("utf-8").strip()


_DECLARED = re.compile(r'\b(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*=\s*("(?:[^"\\\n]|\\.)*"(?:\s*\+\s*"(?:[^"\\\n]|\\.)*"){1,15})\s*(?=[;\n,]|$)')


def literal_strings(script: str, most: int = 200, longest: int = 8192) -> list[tuple[str, str, int]]:
    """(name, value, line) of variables that are sums of up to sixteen string literals, comments and other strings aside."""
    blank = lambda m: m[0] if m["text"] and m[0][0] == '"' else re.sub(r"[^\n]", " ", m[0])
    masked, out = _TOKEN.sub(blank, script), []
    for m in _DECLARED.finditer(masked):
        try:
            value = "".join(map(json.loads, re.findall(r'"(?:[^"\\\n]|\\.)*"', m[2])))
        except ValueError:
            continue
        if len(value) <= longest and len(out) < most:
            out.append((m[1], value, masked.count("\n", 0, m.start()) + 1))
    return out


def scripts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, map_url, strings) of scripts."""
    schema = StructType([texts.schema[key], *StructType.fromDDL("map_url string, strings array<struct<name:string,value:string,line:int>>").fields])
    kind = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string()), ("line", pa.int32())]))

    def run(batches):
        for b in batches:
            ts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([map_reference(t) for t in ts], pa.string()), pa.array([[dict(name=n, value=v, line=k) for n, v, k in literal_strings(t)] for t in ts], kind)], names=schema.names)

    return texts.select(key, text).mapInArrow(run, schema)


def bisect(first: date, last: date, failed, budget: int = 64) -> tuple[list[tuple[date, date]], list[tuple[date, date]]]:
    """(ranges that answer, ranges that never do) of a span of days: a range that fails is halved, breadth first, until it
    is a day or the budget of questions is spent. `failed(first, last)` tells; what is not asked counts as failing."""
    queue, good, bad = [(first, last)], [], []
    while queue:
        a, b = queue.pop(0)
        if budget <= 0:
            bad.append((a, b))
            continue
        budget -= 1
        if not failed(a, b):
            good.append((a, b))
        elif a == b:
            bad.append((a, b))
        else:
            middle = a + timedelta(days=(b - a).days // 2)
            queue += [(a, middle), (middle + timedelta(days=1), b)]
    return sorted(good), sorted(bad)


def header_hosts(responses: DataFrame, base: str) -> DataFrame:
    """(host, source, confidence) from (csp, location, origin) headers, under a base domain."""
    named = (("csp", 0.8, F.col("csp")), ("location", 0.9, F.col("location")), ("origin", 0.7, F.col("origin")))
    found = [F.transform(F.regexp_extract_all(F.coalesce(F.lower(c), F.lit("")), F.lit(r"(?:https?://|\s|^)(?:\*\.)?([a-z0-9-]+(?:\.[a-z0-9-]+)+)"), F.lit(1)), _told(name, conf)) for name, conf, c in named]
    got = responses.select(F.inline(F.flatten(F.array(*found)))).where((F.col("host") == base) | F.endswith("host", F.lit("." + base)))
    return got.groupBy("host", "source").agg(F.max("confidence").alias("confidence"))


def _told(name: str, conf: float):
    return lambda h: F.struct(h.alias("host"), F.lit(name).alias("source"), F.lit(conf).alias("confidence"))
