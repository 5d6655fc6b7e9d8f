"""Archive indexes, record locators, repository trees, source maps, files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files and folders of a local scan; suffixes of hosts that are not public.
TEXT_SUFFIXES = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "json", "py", "rb", "go", "rs", "java", "kt", "php", "cs", "c", "h", "cpp", "sh", "env", "yaml", "yml", "toml", "ini", "conf", "properties", "xml", "html", "md", "txt", "pem", "key")
SKIP_DIRS = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "venv")
NOT_PUBLIC = (".local", ".localhost", ".internal", ".invalid", ".test")
CAPTURE_PARAMS = ("v", "ver", "version", "build", "cache", "t", "_", "hash")


def local_files(spark: SparkSession, path: str, max_bytes: int = 2_000_000, suffixes=TEXT_SUFFIXES) -> DataFrame:
    """Text files under path as artifacts, with `limited` where a file is too large, binary or not UTF-8 (content null)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.split(F.replace(F.col("path"), F.lit(path), F.lit("")), "/")
    name = F.lower(F.element_at(inner, -1))
    wanted = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).isin(*suffixes) | F.startswith(name, F.lit(".env")) | name.isin("dockerfile", "makefile", "id_rsa", "id_ed25519")
    kept = files.where(wanted & ~F.arrays_overlap(inner, F.array(*map(F.lit, SKIP_DIRS))))
    body, text = decoded(F.col("content")), F.col("length") <= max_bytes
    got = kept.select(F.sha2("path", 256).alias("id"), F.lit("local").alias("source_type"), F.col("path").alias("locator"), F.col("length").alias("size"), F.when(text, body).alias("content"))
    return got.withColumn("limited", F.col("content").isNull())


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes without NUL in the first 8,192, its byte order mark taken off; else null."""
    nul = F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00")))
    text = F.call_function("try_validate_utf8", content.cast("string"))
    return F.when(~nul, F.regexp_replace(text, "^﻿", ""))


#: Fixed value: fields of an index row.
CDX = ("timestamp", "original", "mimetype", "statuscode", "digest")


def cdx_rows(responses: DataFrame, column: str = "body", filters: tuple[str, ...] = ()) -> DataFrame:
    """(timestamp, original, mimetype, statuscode, digest) from index pages: a JSON array of arrays under a header row.
    Pages without that header give nothing; rows that are not of its shape, not successful, not dated, or that a filter
    ("field:expression", which the whole field must match) rejects are left out."""
    rows = F.from_json(column, "array<array<string>>")
    paged = responses.select(rows.alias("rows")).where(F.get("rows", F.lit(0)) == F.array(*map(F.lit, CDX)))
    one = paged.select(F.posexplode("rows").alias("i", "r")).where("i > 0")
    got = one.where(F.size("r") == len(CDX)).select(*(F.get("r", F.lit(k)).alias(n) for k, n in enumerate(CDX)))
    got = got.where((F.col("statuscode") == "200") & F.col("timestamp").rlike("^[0-9]{14}$"))
    for name, _, pattern in (f.partition(":") for f in filters):
        got = got.where(F.col(name).rlike(f"^(?:{pattern})$"))
    return got


def jsonl_rows(responses: DataFrame, column: str = "body") -> DataFrame:
    """(url, timestamp, filename, offset, length, digest) from indexes of one JSON object a line."""
    schema = "url string, timestamp string, status string, mime string, filename string, offset string, length string, digest string"
    got = responses.select(F.explode(F.split(column, "\n")).alias("line")).select(F.from_json("line", schema).alias("r")).select("r.*")
    fine = (F.col("status") == "200") & F.col("offset").rlike("^[0-9]+$") & F.col("length").rlike("^[0-9]+$") & F.lower("mime").rlike("javascript|json|html|text/plain")
    return got.where(fine).select("url", "timestamp", "filename", F.col("offset").cast("long").alias("offset"), F.col("length").cast("long").alias("length"), "digest")


def valid_locator(collection: Column, filename: Column, offset: Column, length: Column, digest: Column) -> Column:
    """Whether a record locator names a range of one archive file and nothing else."""
    named = F.regexp_extract(filename, r"^crawl-data/(CC-MAIN-\d{4}-\d{2})/segments/[0-9.]+/warc/[A-Za-z0-9._-]+\.warc\.gz$", 1)
    top = 1 << 53
    return (collection.rlike(r"^CC-MAIN-\d{4}-\d{2}$") & (named == collection) & (F.length(filename) <= 300) & ~F.contains(filename, F.lit("..")) & (offset >= 0) & (offset < top)
            & length.between(1, 3_000_000) & (offset + length < top) & digest.rlike("^[A-Z2-7]{32}$"))


def permitted_capture(host: Column, ts: Column, root: str, first: str, last: str, subdomains: bool = True) -> Column:
    day = F.to_date(F.left(ts, F.lit(8)), "yyyyMMdd")
    ours = (host == root) | (F.endswith(host, F.lit("." + root)) if subdomains else F.lit(False))
    return ours & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def tree_snapshot(tree: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Entries (repo, mode, kind, path, size) of a repository's tree that a snapshot takes: plain blobs with safe, unambiguous
    paths, in path order until the budgets are spent. Budgets are running sums per repository."""
    from pyspark.sql import Window as W

    safe = (~F.col("path").rlike(r"(^|/)\.\.(/|$)|[\x00-\x1F]|^/")) & (F.length("path") <= 1024) & F.col("mode").isin("100644", "100755") & (F.col("kind") == "blob")
    alike = F.row_number().over(W.partitionBy("repo", F.lower("path")).orderBy("path"))
    order = W.partitionBy("repo").orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    kept = tree.where(safe).withColumn("_a", alike).where("_a = 1").drop("_a")
    return kept.withColumns({"_n": F.count("*").over(order), "_b": F.sum("size").over(order)}).where((F.col("_n") <= max_files) & (F.col("_b") <= max_bytes)).drop("_n", "_b")


def commit_parents(commits: DataFrame) -> DataFrame:
    return commits.select("commit", F.explode(F.regexp_extract_all("raw", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1))).alias("parent"))


MAP = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("sourcesContent", T.ArrayType(T.StringType()))])


def map_sources(maps: DataFrame, column: str = "body", max_sources: int = 100) -> DataFrame:
    """(map_id, i, source, content): sources with content of flat version-3 maps."""
    m = maps.select("map_id", F.from_json(column, MAP).alias("m")).where((F.col("m.version") == 3) & (F.size("m.sources") <= max_sources))
    both = m.select("map_id", F.posexplode(F.arrays_zip("m.sources", "m.sourcesContent")).alias("i", "z"))
    return both.select("map_id", "i", F.col("z.sources").alias("source"), F.col("z.sourcesContent").alias("content")).where("content is not null")


_DIGITS = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}
#: How deep maps may hold maps, and segments that are read of all.
MAP_DEPTH, MAP_SEGMENTS = 4, 100_000


def vlq(segment: str) -> list[int]:
    """Numbers of a base64-VLQ segment: five bits a digit, lowest first, the sixth tells that more follow, the lowest the sign."""
    out: list[int] = []
    bits = count = 0
    for c in segment:
        digit = _DIGITS.get(c)
        if digit is None or count > 6:
            raise ValueError("invalid VLQ")
        bits |= (digit & 31) << 5 * count
        count += 1
        if digit < 32:
            out.append(-(bits >> 1) if bits & 1 else bits >> 1)
            bits = count = 0
    if count:
        raise ValueError("incomplete VLQ")
    return out


def flat_maps(root: dict):
    """(map, generated line and column at which it begins) of a source map and the maps of its sections."""
    stack = [(root, 0, 0, 0)]
    while stack:
        m, line, column, depth = stack.pop()
        if depth > MAP_DEPTH:
            raise ValueError("maps too deep")
        if "sections" not in m:
            yield m, line, column
        for part in reversed(m.get("sections", [])):
            at = part["offset"]
            stack.append((part["map"], line + at["line"], at["column"] + (0 if at["line"] else column), depth + 1))


def segments(m: dict):
    """(generated line, generated column, source, line, column) of a flat map's segments that name a source, all from 0."""
    place = [0, 0, 0, 0]  # source, line, column, name: each is told as a difference from the one before
    for row, text in enumerate(m.get("mappings", "").split(";")):
        column = 0
        for fields in map(vlq, filter(None, text.split(","))):
            if len(fields) not in (1, 4, 5):
                raise ValueError("invalid segment")
            column += fields[0]
            place = [a + b for a, b in zip(place, [*fields[1:], 0, 0, 0, 0])]
            if column < 0 or min(place[:3]) < 0 or (len(fields) > 1 and place[0] >= len(m.get("sources", ()))) or (len(fields) == 5 and not 0 <= place[3] < len(m.get("names", ()))):
                raise ValueError("invalid position")
            yield (row, column, *place[:3]) if len(fields) > 1 else None


def generated_location(body: str, source: str, content: str, line: int, column: int) -> dict | None:
    """Where the bundle holds a place (line from 1, UTF-16 column from 0) of a source with that name and content: at the segment nearest
    to its left on that line, the first of equals. None if no segment tells; broken maps raise."""
    best, read = None, 0
    for m, line0, column0 in flat_maps(json.loads(body)):
        texts = m.get("sourcesContent", [])
        wanted = {i for i, s in enumerate(m.get("sources", [])) if s == source and i < len(texts) and texts[i] == content}
        for x in segments(m) if wanted else ():
            read += 1
            if read > MAP_SEGMENTS:
                raise ValueError("too many segments")
            if x and x[2] in wanted and x[3] == line - 1 and x[4] <= column and (best is None or column - x[4] < best[0]):
                best = (column - x[4], line0 + x[0] + 1, x[1] + (0 if x[0] else column0))
    if best is None:
        return None
    return {"original_line": line, "original_column": column, "generated_line": best[1], "generated_column": best[2], "accuracy": "nearest_segment" if best[0] else "exact_segment"}
