"""Frontiers: admission of candidates, and closure over links by breadth-first rounds."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table in the shared folder (spark.checkpoint.dir), or checkpointed by the session's own means."""
    spark: SparkSession = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/lanternfish/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def admit(candidates: DataFrame, seen: DataFrame, max_depth: int, cap: int = 20_000) -> DataFrame:
    """(url, depth) of candidates (url, depth, in_scope, is_js) that are new, in scope and not too deep (scripts go at any
    depth): of a URL the least deep, of all the first `cap` by depth and URL."""
    fine = candidates.where("in_scope").where((F.col("depth") <= max_depth) | F.col("is_js"))
    return fine.groupBy("url").agg(F.min("depth").alias("depth")).join(seen.select("url"), "url", "left_anti").orderBy("depth", "url").limit(cap)


def closure(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): what edges (src, dst) reach from seeds (node) in at most max_depth steps, each at its least depth.
    A round joins only the newest nodes, and is a written table; rounds end where nothing new comes."""
    edges = scratch(edges.select("src", "dst").distinct(), "edges")
    new = seen = scratch(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, max_depth + 1):
        step = new.join(edges, new.node == edges.src).select(F.col("dst").alias("node")).distinct()
        new = scratch(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def two_passes(seeds: DataFrame, found_on: DataFrame, first: int = 5) -> DataFrame:
    """(node, confidence): what found_on (src, dst, confidence) tells of seeds (node), then of the first `first` nodes so found, the
    most confident first; a node found twice has its higher confidence."""
    step = lambda nodes: nodes.join(found_on, nodes.node == found_on.src).groupBy(F.col("dst").alias("node")).agg(F.max("confidence").alias("confidence"))
    one = scratch(step(seeds.select("node").distinct()), "pass")
    two = step(one.orderBy(F.desc("confidence"), "node").limit(first).select("node"))
    return one.unionByName(two).groupBy("node").agg(F.max("confidence").alias("confidence"))
