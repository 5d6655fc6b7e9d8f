"""Comparisons of scans: what is new, gone or kept; what can be reused; what precedes what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def delta(previous: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(key, state): new, existing or resolved, over distinct keys."""
    p, c = previous.select(key).distinct().withColumn("p", F.lit(1)), current.select(key).distinct().withColumn("c", F.lit(1))
    state = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("existing")
    return p.join(c, key, "full").select(key, state.alias("state"))


def baselines(scans: DataFrame) -> DataFrame:
    """(scan_id, previous): for complete scans the latest earlier complete one of the same target and scope. An incomplete
    scan is no baseline and has none: what it lacks is not resolved."""
    fine = scans.where("status = 'completed' and complete")
    return fine.select("scan_id", F.lag("scan_id").over(W.partitionBy("target_id", "scope").orderBy("seq")).alias("previous"))


def reusable(checkpoint: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose locator and digest a checkpoint has: their findings stand."""
    return files.join(checkpoint.select("locator", "digest"), ["locator", "digest"], "left_semi")


def stale(checkpoint: DataFrame, visited: DataFrame) -> DataFrame:
    return checkpoint.join(visited.select("locator"), "locator", "left_anti")


def incremental(checkpoint: DataFrame, files: DataFrame, recompute) -> DataFrame:
    """(locator, digest, result): kept where unchanged, recomputed where changed or new, gone where missing."""
    kept = checkpoint.join(files.select("locator", "digest"), ["locator", "digest"], "left_semi")
    rest = files.join(checkpoint.select("locator", "digest"), ["locator", "digest"], "left_anti")
    return kept.unionByName(recompute(rest))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left plus `value` and its time from the latest row of right with the same key at or before left's time. One
    shuffle on the key: both sides in one ordered window, so hot keys cost a sort and no pairs."""
    fill = [c for c in left.columns if c not in (key, at)]
    l = left.select(key, at, F.struct(*fill).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_t"), F.lit(1).alias("_side"))
    r = right.select(key, at, F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(value).alias("_v"), F.col(at).alias("_t"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = l.unionByName(r).withColumns({f"{value}_asof": F.last("_v", ignorenulls=True).over(w), f"{at}_asof": F.last("_t", ignorenulls=True).over(w)})
    return both.where("_side = 1").select(key, at, "_l.*", f"{value}_asof", f"{at}_asof")


def first_of_content(captures: DataFrame) -> DataFrame:
    """captures (capture_id, content_hash, ts) plus reused_from: the earliest capture of the same content, null for itself. Contents that
    came once have no row to join with; however many copies one has, they are summed up before the shuffle and split in the join."""
    first = captures.groupBy("content_hash").agg(F.min_by("capture_id", F.struct("ts", "capture_id")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    told = captures.join(first, "content_hash", "left")
    return told.withColumn("reused_from", F.when(F.col("_first") != F.col("capture_id"), F.col("_first"))).drop("_first")
