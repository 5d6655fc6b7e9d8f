"""Shared plumbing: tables, shared scratch space, bounded Arrow slices and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one slice of an Arrow batch holds at most (a single longer text is a slice).
SLICE_CHARS = 2_000_000
#: Rows of an Arrow batch at most: rows are whole texts, and batches are held on both sides of the pipe to Python.
BATCH_ROWS = 500
#: Bytes of a row group of an intermediate table: what a writing task holds. (Tables are zstd: snappy's buffers lie outside
#: the heap, and nothing collects them before the heap is full.)
ROW_GROUP = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and
    the session is a single process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/lanternfish/{tag}-{uuid.uuid4().hex}"


def lean(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches lowered to BATCH_ROWS if they are larger. The setting stays: plans are read when they run."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, column pruning stays,
    and every later read survives a lost executor."""
    path = scratch_path(df.sparkSession, tag)
    lean(df).write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled at every size: what grows with the corpus is not to be broadcast while it is small."""
    return df.hint("merge")


def collect(df: DataFrame) -> None:
    """Shuffle files go when the driver's garbage collector finds that no plan holds them: it is asked to look."""
    df.sparkSession._jvm.java.lang.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote; for when all that is made from them has been written itself. Shuffle files of
    theirs go too."""
    for t in tables:
        if path := t.__dict__.pop("scratch", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if tables:
        collect(tables[0])


def release() -> None:
    """Give freed memory back to the system: workers live on, and what one stage needed is not the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with bounded text, so that memory does not follow the batch size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if batch.num_rows > start:
            yield batch.slice(start)
    release()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def map_texts(df: DataFrame, add: Callable[[list[bytes]], dict[str, list | pa.Array]], fields: list[pa.Field], ddl: str,
              keep: list[str], text: str = "text", make: Callable[[], Callable] | None = None) -> DataFrame:
    """keep's columns plus what add(texts) returns for each slice. make(), if given, builds add once a task."""
    from pyspark.sql.types import StructType

    schema = StructType([df.schema[c] for c in keep])
    out = StructType([*schema.fields, *StructType.fromDDL(ddl).fields])

    def run(batches):
        f = make() if make else add
        for part in slices(batches, text):
            got = f(texts_of(part, text))
            columns = [part.column(part.schema.get_field_index(c)) for c in keep]
            columns += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=fld.type) for fld, x in ((fld, got[fld.name]) for fld in fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(fld.name for fld in fields)])

    need = list(dict.fromkeys([*keep, text]))
    return lean(df).select(*need).mapInArrow(run, out)


def filter_bits(df: DataFrame, name: str, bits: int) -> np.ndarray:
    """2 ** bits flags, eight a byte: those at the low bits of a long column's values are set. The size is fixed; what
    many values set makes the filter let more through, never less."""
    slot = F.col(name).bitwiseAND((1 << bits) - 1)
    cells = df.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast({name} & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("set")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[cells["cell"].to_numpy()] = cells["set"].to_numpy()
    return words.view(np.uint8)


def flags_of(packed: np.ndarray) -> np.ndarray:
    """Those flags, a byte each."""
    return np.unpackbits(packed, bitorder="little")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable. Alternating large and
    small stars; each round's edges are a written table, minima are their own table so that joins on a hub are
    split by AQE. Nodes without an edge to another node are absent."""
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)

    def mark(df: DataFrame):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(now)
    while seen[0]:
        down = materialize(now.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(now.select(F.col("a").alias("u"), F.col("b").alias("v")))
                           .groupBy("u").agg(F.min("v").alias("m")).where("m < u"), tag)
        large = now.join(down, now.b == down.u, "left").select("a", F.coalesce("m", "b").alias("b"))
        large = materialize(large.distinct(), tag)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), tag)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        now, old = materialize(small.distinct(), tag), now
        discard(down, large, least, old)
        after = mark(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("b").alias("node")).distinct().join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
