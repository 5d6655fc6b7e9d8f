"""Event logs: what is reported, throttled, packed into batches and folded; on tables and on streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Events that always or never count, that only the latest of counts, and what others are told apart by.
CRITICAL = ("scan_started", "scan_completed", "scan_failed", "scan_error", "scan_stopped", "artifact_batch_ready", "scan_progress")
TELEMETRY = ("heartbeat_debug", "analysis_timing", "retry_attempt", "confidence_score_only")
ALWAYS = ("scan_started", "scan_completed", "scan_failed", "scan_error", "secret_found")
NOISE = ("batch_started", "batch_completed", "initial_stats", "crawl_started", "crawl_completed", "crawl_final_stats", "task_failed", "processing_error", "parse_error")
TERMINAL = ("scan_completed", "scan_failed", "scan_error")
SNAPSHOTS = ("scan_progress", "stats_update")
#: States of a scan and the steps between them.
STEPS = (("pending", "running"), ("pending", "failed"), ("running", "paused"), ("running", "completed"), ("running", "failed"), ("paused", "running"), ("paused", "failed"))


def reported(kind: Column, data: Column) -> Column:
    """The report contract over JSON data: artifacts and lifecycle always, telemetry never, analyses if they count something,
    endpoints if severe or sure; the rest passes."""
    number = lambda p: F.coalesce(F.get_json_object(data, p).cast("double"), F.lit(0.0))
    endpoint = F.coalesce(F.get_json_object(data, "$.severity").isin("MEDIUM", "HIGH", "CRITICAL"), F.lit(False)) | (number("$.confidence") >= 0.7)
    return (F.when(F.get_json_object(data, "$.artifacts").isNotNull(), True).when(kind.isin(*CRITICAL), True).when(kind.isin(*TELEMETRY), False)
            .when(kind == "js_analysis_complete", (number("$.metadata.secret_count") > 0) | (number("$.metadata.endpoint_count") > 0)).when(kind == "endpoint_found", endpoint).otherwise(True))


def delivery_class(kind: Column) -> Column:
    return F.when(kind.isin(*TERMINAL), "drain").when(kind.isin(*ALWAYS), "flush").when(kind.isin(*NOISE), "drop").otherwise("buffered")


def cooled(events: DataFrame, seconds: float) -> DataFrame:
    """events (key, ts, id) kept if `seconds` have passed since the last kept one of their key. The fold needs a key's
    events in order; it runs an Arrow batch at a time with the last kept time as its only state, so a hot key costs time
    but no memory. Events that tie in time are in order of id."""
    schema = events.schema
    places = (schema.names.index("key"), schema.names.index("ts"))

    def run(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        key, last, step = object(), 0, int(seconds * 1e6)
        for b in batches:
            keep = []
            for k, t in zip(b.column(places[0]).to_pylist(), pc.cast(b.column(places[1]), pa.int64()).to_pylist()):
                fresh = k != key or t - last >= step
                if fresh:
                    key, last = k, t
                keep.append(fresh)
            yield b.filter(pa.array(keep, pa.bool_()))

    return events.repartition("key").sortWithinPartitions("key", "ts", "id").mapInArrow(run, schema)


def cooled_stream(events: DataFrame, seconds: float) -> DataFrame:
    """The same on a stream of (key, ts, id): the time of the last kept event is each key's state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        for f in frames:
            keep = []
            for t in (f := f.sort_values(["ts", "id"]))["ts"]:
                fresh = last is None or t.value // 1000 - last >= seconds * 1e6
                last = t.value // 1000 if fresh else last
                keep.append(fresh)
            if last is not None:
                state.update((last,))
            yield f[keep]

    return events.groupBy("key").applyInPandasWithState(step, events.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def coalesced(progress: DataFrame) -> DataFrame:
    """progress (scan_id, ts, id, phase) where the phase changes: what must flow at once. Elapsed time is `cooled`'s."""
    before = F.lag("phase").over(W.partitionBy("scan_id").orderBy("ts", "id"))
    return progress.where("phase is not null").withColumn("before", before).where("before is null or before <> phase").drop("before")


def paced(progress: DataFrame, seconds: float = 1.5, parts: tuple[str, ...] = ("phase",)) -> DataFrame:
    """progress (scan_id, ts, id, and parts, the first of which is the phase) that flows: where a phase is told and one of the parts
    is not what it was in the event before, or `seconds` after what flowed last. Like `cooled` a fold over a scan's events in order,
    with the time of what flowed last as its state."""
    schema = progress.schema
    w = W.partitionBy("scan_id").orderBy("ts", "id")
    moved = F.lag("id").over(w).isNull()
    for c in parts:
        moved = moved | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    told = progress.withColumn("_moved", moved & F.coalesce(F.col(parts[0]) != "", F.lit(False)))
    places = [told.columns.index(c) for c in ("scan_id", "ts", "_moved")]

    def run(batches: Iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        scan, last, step = object(), 0, int(seconds * 1e6)
        for b in batches:
            keep = []
            for k, t, m in zip(b.column(places[0]).to_pylist(), pc.cast(b.column(places[1]), pa.int64()).to_pylist(), b.column(places[2]).to_pylist()):
                flows = m or k != scan or t - last >= step
                if flows:
                    scan, last = k, t
                keep.append(flows)
            yield b.drop_columns(["_moved"]).filter(pa.array(keep, pa.bool_()))

    return told.repartition("scan_id").sortWithinPartitions("scan_id", "ts", "id").mapInArrow(run, schema)


def flushed(events: DataFrame, kinds: tuple[str, ...] = SNAPSHOTS) -> DataFrame:
    """(scan_id, terminal_id, event_type, data, last): what each terminal event of events (scan_id, ts, id, event_type, data) sends: the
    latest snapshot of each kind since the terminal event before it, then itself (last)."""
    ended = F.col("event_type").isin(*TERMINAL)
    before = F.coalesce(F.sum(ended.cast("int")).over(W.partitionBy("scan_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    told = events.where(ended | F.col("event_type").isin(*kinds)).withColumn("stretch", before)
    ends = told.where(ended).select("scan_id", "stretch", F.col("id").alias("terminal_id"), "event_type", "data")
    held = told.where(~ended).groupBy("scan_id", "stretch", "event_type").agg(F.max_by("data", F.struct("ts", "id")).alias("data"))
    sent = held.join(ends.select("scan_id", "stretch", "terminal_id"), ["scan_id", "stretch"])
    cols = ("scan_id", "terminal_id", "event_type", "data")
    return sent.select(*cols, F.lit(False).alias("last")).unionByName(ends.select(*cols, F.lit(True).alias("last")))


def admitted(log: DataFrame, pending: DataFrame, quarantined: DataFrame) -> DataFrame:
    """log (event_id, payload) plus verdict: new, duplicate (the same payload is held already), or conflict (another is)."""
    held = pending.select("event_id", "payload").unionByName(quarantined.select("event_id", "payload"))
    held = held.groupBy("event_id").agg(F.min("payload").alias("_a"), F.max("payload").alias("_b"))
    same = F.col("_a").eqNullSafe(F.col("payload")) & F.col("_b").eqNullSafe(F.col("payload"))
    return log.join(held.withColumn("_h", F.lit(True)), "event_id", "left").withColumn("verdict", F.when(F.col("_h").isNull(), "new").when(same, "duplicate").otherwise("conflict")).drop("_a", "_b", "_h")


def latest(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key, "event_type").agg(F.max_by("data", F.struct("ts", "id")).alias("data"), F.max("ts").alias("ts"))


def before_terminal(events: DataFrame) -> DataFrame:
    """events (scan_id, ts, id, event_type) up to and with each scan's first terminal one."""
    ended = F.sum(F.col("event_type").isin(*TERMINAL).cast("int")).over(W.partitionBy("scan_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("_e", F.coalesce(ended, F.lit(0))).where("_e = 0").drop("_e")


def transitions(states: DataFrame) -> DataFrame:
    """states (scan_id, ts, id, status) plus before and allowed."""
    steps = states.sparkSession.createDataFrame(list(STEPS), "before string, status string").withColumn("ok", F.lit(True))
    told = states.withColumn("before", F.lag("status").over(W.partitionBy("scan_id").orderBy("ts", "id")))
    return told.join(F.broadcast(steps), ["before", "status"], "left").withColumn("allowed", F.col("before").isNull() | (F.col("before") == F.col("status")) | F.coalesce("ok", F.lit(False))).drop("ok")  # six steps


def batches(log: DataFrame, max_rows: int = 200, max_chars: int = 1_048_576) -> DataFrame:
    """log (scan_id, seq, payload) plus batch: greedy packing in order, a batch holding max_rows events and max_chars (1,024
    and each payload's length with 20) at most, and one event at least. The running sums are an Arrow fold per scan."""
    schema = StructType([*log.schema.fields, StructField("batch", LongType())])
    at = [log.schema.names.index(c) for c in ("scan_id", "payload")]

    def run(it: Iterator):
        import pyarrow as pa

        scan, n, used, batch = object(), 0, 0, 0
        for b in it:
            out = []
            for s, p in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                cost = len(p or "") + 20
                if s != scan:
                    scan, n, used, batch = s, 0, 1024, 0
                elif n >= max_rows or used + cost > max_chars:
                    n, used, batch = 0, 1024, batch + 1
                n, used = n + 1, used + cost
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "batch"])

    return log.repartition("scan_id").sortWithinPartitions("scan_id", "seq").mapInArrow(run, schema)


def collisions(log: DataFrame) -> DataFrame:
    """Event ids that stand for more than one payload."""
    return log.groupBy("event_id").agg(F.countDistinct("payload").alias("payloads")).where("payloads > 1")


def replayable(failed: DataFrame, now: Column) -> DataFrame:
    """Dead letters of the last day that were tried fewer than three times, with one more try counted."""
    return failed.where((F.col("failed_at") > now - F.expr("interval 24 hours")) & (F.col("retry_count") < 3)).withColumn("retry_count", F.col("retry_count") + 1)


def progress_fold(progress: DataFrame) -> DataFrame:
    """Per scan of (scan_id, batch_index, processed, artifacts): the counter never falls, a batch told twice adds once."""
    once = progress.groupBy("scan_id", "batch_index").agg(F.max("processed").alias("processed"), F.max("artifacts").alias("artifacts"))
    return once.groupBy("scan_id").agg(F.max("processed").alias("processed"), F.sum("artifacts").alias("artifacts"), F.count("*").alias("batches"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; on a stream, windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), "n")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream's events, each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
