"""WARC archives: write captures, read records back, assemble transactions.

Each capture is three records: a response (or a revisit of one with an equal payload), the request and a metadata
record; the last two name the first in WARC-Concurrent-To, and a revisit names the response in WARC-Refers-To. Reading yields one row
a record; assembly brings the three together on that identifier, in one shuffle, as one nested row a capture. Files are gzip, a member a record, and roll at a size, so that
a reader's task is bounded. Writers return a manifest; files of attempts that failed are not in it and are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, slices

#: Bytes from which on a file is closed and of files that one reading task is given.
ROLL_BYTES, TASK_BYTES = 32_000_000, 256_000_000
WRITTEN = "path string, records long, bytes long"
RECORD = ("path string, position long, record_id string, concurrent_to string, warc_type string, target_uri string, warc_date string, "
          "payload_digest string, refers_to string, http_length long, payload binary, payload_bytes long, computed_digest string, fields map<string,string>")
CAPTURE = ("key", "url", "payload", "refers_to", "refers_url", "sole")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("truncated WARC record")
        yield headers, block


def named_id(digest: str, key) -> str:
    """The record id of the one response with that payload: what revisits refer to can be told without having written it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest}:{key}')}>"


def _clean(v) -> str | None:
    return None if v is None else " ".join(str(v).split())


def write_captures(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", roll: int = ROLL_BYTES) -> DataFrame:
    """Write captures (key long, url, payload binary or null, refers_to long, refers_url, sole boolean) under path; refers_to
    null makes a response; sole says that only one response has the payload and its key. Returns the manifest (path, records,
    bytes), itself a written table. Null payload is empty."""

    def run(batches):
        store, base = pafs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        out, name, n, size = None, None, 0, 0
        for part in slices(batches, "payload"):
            for key, url, payload, refers, refers_url, sole in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in CAPTURE)):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(name, compression=None), 0, 0
                payload = payload or b""
                digest, uri = f"sha1:{base32_sha1(payload)}", _clean(url)
                ids = [f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3)]
                if refers is None and sole:
                    ids[0] = named_id(digest, key)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                common = {"WARC-Date": date, "WARC-Target-URI": uri}
                first = common | {"WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
                if refers is None:
                    main = record("response", ids[0], first, http + payload)
                else:
                    main = record("revisit", ids[0], first | {"WARC-Profile": PROFILE, "WARC-Refers-To": named_id(digest, refers) if sole else None, "WARC-Refers-To-Target-URI": _clean(refers_url), "WARC-Refers-To-Date": date}, http)
                about = "".join(f"{k}: {v}\r\n" for k, v in (("capture-key", key), ("refers-to-key", refers)) if v is not None).encode()
                rest = common | {"WARC-Concurrent-To": ids[0]}
                request = record("request", ids[1], rest | {"Content-Type": "application/http; msgtype=request"}, f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode())
                for data in (main, request, record("metadata", ids[2], rest | {"Content-Type": "application/warc-fields"}, about)):
                    member = gzip.compress(data, 6, mtime=0)
                    out.write(member)
                    n, size = n + 1, size + len(member)
                if size >= roll:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    return materialize(captures.select("key", "url", F.col("payload").cast("binary"), "refers_to", "refers_url", "sole").mapInArrow(run, WRITTEN), "warc-manifest")


def read_records(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record of the manifest's files, read as streams. Payload digests are computed from what was read.
    Without payloads only their lengths and digests are kept."""
    def run(batches):
        rows = []
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = pafs.LocalFileSystem() if path.startswith("/") else None, path
                if store is None:
                    store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as raw:
                    held = 0
                    for i, (h, block) in enumerate(parse(io.BufferedReader(gzip.GzipFile(fileobj=_File(raw))))):
                        kind, payload, http, about = h["warc-type"], None, None, {}
                        if kind in ("response", "revisit"):
                            head, _, body = block.partition(b"\r\n\r\n")
                            http = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                            payload = body if kind == "response" else None
                        elif kind == "metadata":
                            about = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
                        rows.append((path, i, h["warc-record-id"], h.get("warc-concurrent-to"), kind, h.get("warc-target-uri"), h.get("warc-date"),
                                     (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, h.get("warc-refers-to"), http, payload if payloads else None,
                                     None if payload is None else len(payload), None if payload is None else base32_sha1(payload), list(about.items())))
                        held += len(block)
                        if held > 8_000_000 or len(rows) >= 5000:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // TASK_BYTES), manifest.sparkSession.sparkContext.defaultParallelism)))
    files = manifest.select("path").repartition(tasks, "path")
    return files.mapInArrow(run, RECORD)


class _File(io.RawIOBase):
    """A pyarrow stream as the file object gzip reads from."""

    def __init__(self, raw):
        self.raw = raw

    def readable(self):
        return True

    def read(self, n=-1):
        return self.raw.read(n if n and n > 0 else None)

    def readinto(self, b):
        got = self.raw.read(len(b))
        b[: len(got)] = got
        return len(got)


def _batch(rows) -> pa.RecordBatch:
    s, i = pa.string(), pa.int64()
    kinds = [s, i, s, s, s, s, s, s, s, i, pa.binary(), i, s, pa.map_(s, s)]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, its request and its metadata, which meet on the first one's identifier.
    It is unique, so no key is hot. A capture without request or metadata has null there; of two the one that comes first in its
    file counts; those that name no capture in records are left out."""
    kind = F.col("warc_type")
    main = kind.isin("response", "revisit")
    own = F.struct("path", "position", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", "http_length", "payload", "payload_bytes", "computed_digest")
    about = F.struct("path", "position", F.col("record_id").alias("id"), "target_uri", "fields")
    at = F.struct("path", "position")
    sides = (F.min_by(F.when(main, own), F.when(main, at)).alias("capture"), *(F.min_by(F.when(kind == k, about), F.when(kind == k, at)).alias(k) for k in ("request", "metadata")))
    met = records.where(main | kind.isin("request", "metadata")).withColumn("id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    return met.groupBy("id").agg(*sides).where("capture is not null").withColumnRenamed("id", "record_id")


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) as captures. Of equal payloads of at least min_bytes the largest page_id is the
    response, the others refer to it. Rows that tie for it are all responses, referred to by URL and date alone; a null page_id ranks lowest. The digests
    are summed up before the shuffle; the join back on them is a plain shuffled join that AQE splits where a payload is hot."""
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    each = rows.where(F.length("payload") >= min_bytes).groupBy("digest", "key").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    best = each.groupBy("digest").agg(F.max(F.struct("key", "url", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    told = rows.join(materialize(best, "warc-best"), "digest", "left")
    other = F.col("best.key").isNotNull() & ~F.col("key").eqNullSafe(F.col("best.key"))
    sole = F.coalesce((F.col("best.n") == 1) & F.col("best.key").isNotNull(), F.lit(False))
    return told.select("key", "url", "payload", F.when(other, F.col("best.key")).alias("refers_to"), F.when(other, F.col("best.url")).alias("refers_url"), sole.alias("sole"))


def archive_pages(spark: SparkSession, pages: DataFrame, path: str | None = None, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Write a capture for each of pages' rows, read the archives back, and return the assembled captures.

    Null html is an empty payload, a null url a record without target, a null page_id a capture without key; repeated
    rows are captures of their own; an empty table writes no file and returns no row; other columns are ignored."""
    manifest = write_captures(mark_revisits(pages, min_bytes), path or scratch_path(spark, "warc"))
    return assemble(read_records(manifest, payloads))
