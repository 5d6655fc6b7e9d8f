"""Orders, quotas and budgets over captures, hosts, caches and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_host(found: DataFrame, dns_sources: tuple[str, ...] = ("dns",)) -> DataFrame:
    """One row a URL of (url, source, confidence, seen): the most confident, then not from DNS, then first seen."""
    order = W.partitionBy("url").orderBy(F.desc("confidence"), F.col("source").isin(*dns_sources), "seen")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def capture_order(captures: DataFrame, tie: str = "ts") -> DataFrame:
    """captures (url, ts) plus turn: of each URL the first, the last, then the middle; equal times in order of `tie`. URLs take turns:
    rows go in order of (turn, url)."""
    w = W.partitionBy("url")
    i, n = F.row_number().over(w.orderBy("ts", tie)), F.count("*").over(w)
    ranked = captures.withColumns({"i": i, "n": n}).withColumn("turn", F.when(F.col("i") == 1, 1).when(F.col("i") == F.col("n"), 2).otherwise(F.col("i") + 1).cast("int"))
    return ranked.drop("i", "n")


def last_of_capture(captures: DataFrame, order: str) -> DataFrame:
    """captures, each (url, ts) once: that which comes last in order."""
    return captures.groupBy("url", "ts").agg(F.max_by(F.struct(*(c for c in captures.columns if c not in ("url", "ts"))), order).alias("_x")).select("url", "ts", "_x.*")


def last_findings(findings: DataFrame, order: str, cap: int = 200) -> DataFrame:
    """findings, each fingerprint once: its last row in order; the first `cap` in order of where a fingerprint first stands."""
    rest = [c for c in findings.columns if c != "fingerprint"]
    each = findings.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), order).alias("_x"), F.min(order).alias("_first"))
    return each.orderBy("_first", "fingerprint").limit(cap).select("fingerprint", "_x.*")


def evenly(rows: DataFrame, key: str, most: int) -> DataFrame:
    """`most` rows (two at least) at even steps of key order, the first and the last among them; all rows if there are no more.
    For short lists, as collections of an archive: the order is one window over all rows."""
    ranked = rows.withColumns({"_i": F.row_number().over(W.orderBy(key)) - 1, "_n": F.count("*").over(W.partitionBy())})
    step = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    hit = F.floor(step * (F.col("_n") - 1) / (most - 1)) == F.col("_i")
    return ranked.where((F.col("_n") <= most) | hit).drop("_i", "_n")


def quota_select(pools: DataFrame, maximum: int, shares: tuple[float, ...] = (0.6, 0.25, 0.15)) -> DataFrame:
    """Up to maximum rows of pools (pool 0.., rank from 1): each pool's quota first, then what is left in pool order.
    The ranks within pools come with the input; what is added up here are pools, a handful."""
    sizes = pools.groupBy("pool").agg(F.count("*").alias("size"))
    quota = F.lit(0)
    for k, s in enumerate(shares):
        quota = F.when(F.col("pool") == k, max(1, int(maximum * s))).otherwise(quota)
    order = W.orderBy("pool")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    t = sizes.withColumn("wanted", F.least(quota, "size"))
    t = t.withColumn("take", F.greatest(F.least(F.col("wanted"), F.lit(maximum) - F.coalesce(F.sum("wanted").over(before), F.lit(0))), F.lit(0)))
    t = t.withColumns({"left": F.col("size") - F.col("take"), "room": F.lit(maximum) - F.sum("take").over(W.partitionBy())})
    t = t.withColumn("extra", F.greatest(F.least(F.col("left"), F.col("room") - F.coalesce(F.sum("left").over(before), F.lit(0))), F.lit(0)))
    return pools.join(F.broadcast(t.select("pool", (F.col("take") + F.col("extra")).alias("_n"))), "pool").where(F.col("rank") <= F.col("_n")).drop("_n")


def rate_violations(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """requests (key, ts) plus in_window, the requests of the last `seconds`, and limited, whether they pass the limit."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("key").orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("in_window", F.count("*").over(w)).withColumn("limited", F.col("in_window") > limit)


def variants(observed: DataFrame) -> DataFrame:
    """observed (identity, ts, id, hash) plus change: new, unchanged or variant against the observation before."""
    before = F.lag("hash").over(W.partitionBy("identity").orderBy("ts", "id"))
    return observed.withColumn("change", F.when(before.isNull(), "new").when(before == F.col("hash"), "unchanged").otherwise("variant"))


def within_budget(items: DataFrame, max_bytes: int, max_rows: int, partition: str) -> DataFrame:
    """The newest of items (partition, ts, id, size) whose sizes add up to max_bytes and that number max_rows at most."""
    w = W.partitionBy(partition).orderBy(F.desc("ts"), F.desc("id"))
    ranked = items.withColumns({"_n": F.row_number().over(w), "_b": F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0))})
    return ranked.where((F.col("_n") <= max_rows) & (F.col("_b") <= max_bytes)).drop("_n", "_b")


def introduced(commits: DataFrame) -> DataFrame:
    """(finding, ordinal): from (finding, ordinal from the newest, has, parent_has) the first commit, going back through
    commits that have the finding, whose parents all lack it."""
    w = W.partitionBy("finding").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    held = commits.withColumn("unbroken", F.min(F.col("has").cast("int")).over(w) == 1)
    return held.where("unbroken and not parent_has").groupBy("finding").agg(F.min("ordinal").alias("ordinal"))


def page_after(rows: DataFrame, key: str, after, size: int = 128) -> DataFrame:
    """The next page of rows in key order."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
