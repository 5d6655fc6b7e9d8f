"""Aggregates over scans: quality, domain health, progress, coverage, expositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(rule, tp, fp, fn, precision, recall) from distinct (case_id, rule) on each side."""
    both = expected.distinct().withColumn("a", F.lit(True)).join(found.distinct().withColumn("b", F.lit(True)), ["case_id", "rule"], "full")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    got = both.groupBy("rule").agg(F.count_if(a & b).alias("tp"), F.count_if(b & ~a).alias("fp"), F.count_if(a & ~b).alias("fn"))
    ratio = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(x) + F.col(y)), 6)
    return got.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def domain_stats(requests: DataFrame) -> DataFrame:
    """Per domain from (domain, ok, response_time): counts, mean time of successes, success rate in percent."""
    ok = F.col("ok")
    return requests.groupBy("domain").agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("response_time"))), 4).alias("avg_response_time"),
                                          F.round(100.0 * F.avg(ok.cast("double")), 4).alias("success_rate"))


def failure_streaks(requests: DataFrame) -> DataFrame:
    """Per domain from (domain, ts, id, ok): the longest run of consecutive failures and the one at the end."""
    order = W.partitionBy("domain").orderBy("ts", "id")
    runs = requests.withColumn("block", F.sum(F.col("ok").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    per = runs.groupBy("domain", "block").agg(F.count_if(~F.col("ok")).alias("failures"))
    return per.groupBy("domain").agg(F.max("failures").alias("longest"), F.max_by("failures", "block").alias("current"))


def exposition(counters: DataFrame, prefix: str) -> DataFrame:
    """(line): metrics in the text format scrapers read, from (name, value)."""
    return counters.select(F.concat(F.lit(prefix + "_"), "name", F.lit(" "), F.col("value").cast("string")).alias("line"))


def crawl_progress(urls: DataFrame) -> DataFrame:
    """One row from urls (state: queued, processed or failed; is_js): totals, what is left, and the share done in percent."""
    state = lambda *x: F.col("state").isin(*x)
    total, done = F.count("*"), F.count_if(state("processed"))
    return urls.agg(total.alias("total_urls"), done.alias("processed_urls"), F.count_if(state("queued") & ~F.col("is_js")).alias("remaining_urls"), F.count_if(state("queued") & F.col("is_js")).alias("js_remaining"),
                    F.count_if(state("failed")).alias("failed_urls"), F.coalesce(F.try_divide(100.0 * done, total), F.lit(0.0)).alias("progress_percent"))
