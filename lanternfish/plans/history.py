"""Queries over scans, captures, event logs and their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta as L
from ..operators import metrics as M
from ..operators import ranking as K
from ..sources import archives as A
from ..sources import tables as T
from ..streaming import events as S


def _t(spark, sf_dir, name="events") -> DataFrame:
    return T.table(spark, sf_dir, name)


def _fingerprints(spark, sf_dir, rest) -> DataFrame:
    return _t(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != rest).select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("fingerprint"))


def scan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.delta(_fingerprints(spark, sf_dir, 0), _fingerprints(spark, sf_dir, 3)).groupBy("state").agg(F.count("*").alias("n"))


def scan_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    scans = o.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("target_id"), F.col("o_orderpriority").alias("scope"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), (F.col("o_orderkey") % 7 != 0).alias("complete"), F.col("o_orderkey").alias("seq"))
    return L.baselines(scans)


def _files(spark, sf_dir, salt) -> DataFrame:
    d = F.col("doc_id")
    return _t(spark, sf_dir, "documents").where(d % 11 != salt).select(F.concat_ws("/", "source", d.cast("string")).alias("locator"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(d % 5 == 0, F.lit(str(salt))).otherwise("")), 256).alias("digest"))


def checkpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reusable(_files(spark, sf_dir, 1), _files(spark, sf_dir, 2)).select("locator")


def stale_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.stale(_files(spark, sf_dir, 1), _files(spark, sf_dir, 2)).select("locator")


def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _files(spark, sf_dir, 1).withColumn("result", F.lit("kept"))
    return L.incremental(old, _files(spark, sf_dir, 2), lambda df: df.withColumn("result", F.lit("scanned"))).groupBy("result").agg(F.count("*").alias("n"))


def asof_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return L.as_of(left, right, "user_id", "ts", "view_id").select("event_id", "user_id", F.col("view_id_asof").alias("view_id"))


def content_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.col("doc_id").alias("ts"))
    return L.first_of_content(d).where("reused_from is not null").select("capture_id", "reused_from")


def recheck_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every asset of each user's manifest (views) was analysed (a later click)."""
    e = _t(spark, sf_dir)
    manifest = e.where("event_type = 'view'").select("user_id").distinct()
    done = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"))
    return manifest.join(done, "user_id", "left").agg(F.count("*").alias("assets"), F.count("n").alias("analyzed"), F.bool_and(F.col("n").isNotNull()).alias("covered"))


def recheck_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 entries, of known kinds, the last kind of each URL."""
    p = _t(spark, sf_dir, "pages").orderBy("page_id").limit(500).select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("url"), F.when(F.col("page_id") % 3 == 0, "document").when(F.col("page_id") % 3 == 1, "javascript").otherwise("image").alias("kind"))
    return p.where(F.col("kind").isin("document", "javascript")).groupBy("url").agg(F.max_by("kind", "page_id").alias("kind"))


def _requests(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir).select((F.col("user_id") % 25).alias("domain"), "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response_time"))


def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.domain_stats(_requests(spark, sf_dir))


def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that are left alone: fewer than three of ten requests succeed (here: purchases)."""
    r = _requests(spark, sf_dir).drop("ok").join(_t(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok")), "id")
    return M.domain_stats(r).where("total > 10 and success_rate < 30").select("domain", "success_rate")


def failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.failure_streaks(_requests(spark, sf_dir))


def domain_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.domain_stats(_requests(spark, sf_dir)).join(M.failure_streaks(_requests(spark, sf_dir)), "domain")
    return d.agg(F.count_if(F.col("success_rate") > 80).alias("healthy"), F.count_if(F.col("current") >= 5).alias("problematic"), F.count("*").alias("domains"))


def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir)
    k = lambda x: F.count_if(F.col("event_type") == x)
    done, bad = k("view") + k("click"), k("error")
    return e.groupBy("user_id").agg(done.alias("processed"), bad.alias("failed"), F.round(F.coalesce(F.try_divide(100.0 * done, done + bad), F.lit(0.0)), 4).alias("success_rate"))


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(code % 5 == 0, "blocked").when(code % 5 == 1, "missing").when(code % 5 == 2, "rate_limited").otherwise("server")
    return _t(spark, sf_dir).where("event_type = 'error'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir).groupBy(F.concat(F.col("event_type"), F.lit("_total")).alias("name")).agg(F.count("*").alias("value"))
    return M.exposition(c, "agent")


def subdomain_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("url"), F.when(F.col("event_type") == "view", "dns").otherwise(F.col("event_type")).alias("source"), F.round(F.col("event_id") % 10 / 10, 1).alias("confidence"), F.col("event_id").alias("seen"))
    return K.best_host(e)


def _captures(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir).select(F.concat(F.lit("u"), F.lpad((F.col("user_id") % 50).cast("string"), 3, "0")).alias("url"), F.col("event_id").alias("ts"))


def capture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.capture_order(_captures(spark, sf_dir))


def capture_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = _t(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "click", 2).alias("pool")).where("pool is not null")
    ranked = e.withColumn("rank", F.row_number().over(W.partitionBy("pool").orderBy("event_id")))
    return K.quota_select(ranked, 300).select("event_id", "pool")


def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rate_violations(_t(spark, sf_dir).select((F.col("user_id") % 10).alias("key"), "ts", "event_id"), 8, 1800).select("event_id", "in_window", "limited")


def variant_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select(F.col("user_id").alias("identity"), "ts", F.col("event_id").alias("id"), F.get_json_object("props", "$.k").alias("hash"))
    return K.variants(e).groupBy("change").agg(F.count("*").alias("n"))


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.col("doc_id").alias("ts"), F.col("n_chars").alias("size"))
    return K.within_budget(d, 100_000_000, 4096, "source").select("id")


def introduced_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = _t(spark, sf_dir).select(F.col("user_id").alias("finding"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id"))).alias("ordinal"), (F.col("event_type") != "error").alias("has"))
    return K.introduced(e.where("ordinal <= 32").withColumn("parent_has", F.coalesce(F.lead("has").over(W.partitionBy("finding").orderBy("ordinal")), F.lit(False))))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.page_after(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


def _kinds(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "view", "js_analysis_complete").when(F.col("event_type") == "click", "endpoint_found").when(F.col("event_type") == "error", "retry_attempt").when(F.col("event_type") == "signup", "scan_started").otherwise("batch_started")
    data = F.concat(F.lit('{"metadata":{"secret_count":'), (k % 3).cast("string"), F.lit('},"severity":"'), F.when(k % 4 == 0, "HIGH").otherwise("LOW"), F.lit('","confidence":'), F.round(k % 10 / 10, 1).cast("string"), F.lit("}"))
    return _t(spark, sf_dir).select("event_id", kind.alias("event_type"), data.alias("data"))


def event_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).groupBy("event_type", S.reported(F.col("event_type"), F.col("data")).alias("reported")).agg(F.count("*").alias("n"))


def event_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kinds(spark, sf_dir).groupBy(S.delivery_class(F.col("event_type")).alias("route")).agg(F.count("*").alias("n"))


def event_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select((F.col("user_id") % 30).alias("key"), "ts", F.col("event_id").alias("id"))
    return S.cooled(e, 6 * 3600.0).select(F.col("id").alias("event_id"))


def progress_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("phase"))
    return S.coalesced(e).select(F.col("id").alias("event_id"), "phase")


def progress_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that flows: where the phase changes, or twelve hours after what flowed last."""
    e = _t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") != "signup", F.col("event_type")).otherwise("").alias("phase"))
    return S.paced(e, 12 * 3600.0).select(F.col("id").alias("event_id"))


def terminal_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "scan_completed").when(F.col("event_type") == "view", "scan_progress").when(F.col("event_type") == "click", "stats_update").otherwise("heartbeat")
    e = _t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), kind.alias("event_type"), F.col("props").alias("data"))
    return S.flushed(e)


def outbox_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of new events whose ids are, in part, held already as pending or quarantined."""
    e = _t(spark, sf_dir)
    log = e.select((F.col("event_id") % 700).alias("event_id"), F.col("props").alias("payload"))
    held = lambda r: e.where((F.col("event_id") < 700) & (F.col("event_id") % 3 == r)).select("event_id", F.col("props").alias("payload"))
    return S.admitted(log, held(0), held(1)).groupBy("verdict").agg(F.count("*").alias("n"))


def capture_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one URL and time as one, the last provider's."""
    e = _t(spark, sf_dir).select((F.col("user_id") % 50).alias("url"), F.date_trunc("day", "ts").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("provider"))
    return K.last_of_capture(e, "seq").groupBy("url", "provider").agg(F.count("*").alias("n"))


def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 fingerprints, each with its last finding."""
    e = _t(spark, sf_dir).select(F.sha2((F.col("event_id") * 7 % 1000).cast("string"), 256).alias("fingerprint"), F.col("event_id").alias("seq"), F.col("event_type").alias("rule"))
    return K.last_findings(e, "seq").select("fingerprint", "rule", "seq")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight of the days on which events fell, evenly spread."""
    return K.evenly(_t(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct(), "day", 8)


def crawl_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type").isin("view", "purchase"), "processed").when(F.col("event_type") == "error", "failed").otherwise("queued")
    got = M.crawl_progress(_t(spark, sf_dir).select(state.alias("state"), (F.col("event_id") % 4 == 0).alias("is_js")))
    return got.withColumn("progress_percent", F.round("progress_percent", 6))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select("user_id", "event_type", "ts", F.col("event_id").alias("id"), F.col("props").alias("data"))
    return S.latest(e, "user_id").select("user_id", "event_type", "data")


def terminal_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "scan_completed").otherwise("scan_progress").alias("event_type"))
    return S.before_terminal(e).groupBy("scan_id").agg(F.count("*").alias("n"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "paused").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("pending")
    e = _t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), status.alias("status"))
    return S.transitions(e).groupBy("status", "allowed").agg(F.count("*").alias("n"))


def outbox_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir).select((F.col("user_id") % 5).alias("scan_id"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return S.batches(e).groupBy("scan_id", "batch").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def outbox_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("scan_id")).agg(F.count("*").alias("pending"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("used"))


def outbox_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collisions(_t(spark, sf_dir).select((F.col("event_id") % 500).alias("event_id"), F.col("props").alias("payload")))


def outbox_acknowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir)
    return e.join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("pending"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir)
    failed = e.select("event_id", F.col("ts").alias("failed_at"), (F.col("event_id") % 5).alias("retry_count"))
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return S.replayable(failed.where(F.col("failed_at") <= now), now).select("event_id", "retry_count")


def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return S.progress_fold(_t(spark, sf_dir).select(F.col("user_id").alias("scan_id"), (F.col("event_id") % 20).alias("batch_index"), k.alias("processed"), (k % 4).alias("artifacts")))


def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(_t(spark, sf_dir), "1 day").withColumn("total", F.round("total", 4))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(_t(spark, sf_dir), "user_id", "1 day")


def cdx_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit('["'), F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("page_id").cast("int")), "yyyyMMddHHmmss"), F.lit('","'), F.col("url"), F.lit('","text/html","'), F.when(F.col("page_id") % 4 == 0, "404").otherwise("200"), F.lit('","D'), F.col("page_id").cast("string"), F.lit('"]'))
    body = _t(spark, sf_dir, "pages").select(F.concat(F.lit('[["timestamp","original","mimetype","statuscode","digest"],'), row, F.lit("]")).alias("body"))
    return A.cdx_rows(body, filters=("mimetype:text/.*", r"original:https?://[^/]+/.*[02468]")).select("timestamp", "original", "digest")


def jsonl_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    line = F.to_json(F.struct("url", F.lit("20240101000000").alias("timestamp"), F.when(p % 5 == 0, "301").otherwise("200").alias("status"), F.lit("text/html").alias("mime"), F.lit("f").alias("filename"), F.when(p % 7 == 0, "x").otherwise(p.cast("string")).alias("offset"), F.lit("10").alias("length"), F.lit("d").alias("digest")))
    return A.jsonl_rows(_t(spark, sf_dir, "pages").select(line.alias("body"))).select("url", "offset", "length")


def record_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    name = F.concat(F.lit("crawl-data/CC-MAIN-2024-1"), (p % 3).cast("string"), F.lit("/segments/1.2/warc/"), F.when(p % 5 == 0, "../x").otherwise("x"), F.lit(".warc.gz"))
    ok = A.valid_locator(F.lit("CC-MAIN-2024-10"), name, p * 1000, p % 50, F.repeat(F.when(p % 7 == 0, "1").otherwise("A"), 32))
    return _t(spark, sf_dir, "pages").select("page_id", ok.alias("valid"))


def tree_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    tree = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.when(d % 9 == 0, "120000").otherwise("100644").alias("mode"), F.lit("blob").alias("kind"), F.concat(F.when(d % 8 == 0, "../").otherwise(""), F.lit("f"), F.lpad(d.cast("string"), 7, "0")).alias("path"), F.col("n_chars").alias("size"))
    return A.tree_snapshot(tree, 10, 30_000).select("repo", "path")


def sourcemap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    body = F.to_json(F.struct(F.when(p % 6 == 0, 2).otherwise(3).alias("version"), F.array(F.lit("a.js"), F.concat(F.lit("b"), p.cast("string"))).alias("sources"), F.array(F.col("url"), F.lit(None).cast("string")).alias("sourcesContent")))
    return A.map_sources(_t(spark, sf_dir, "pages").select(p.alias("map_id"), body.alias("body"))).select("map_id", "source", "content")


QUERIES = (scan_delta, scan_baselines, checkpoint_reuse, stale_antijoin, incremental_scan, asof_map, content_reuse, recheck_coverage, recheck_manifest, domain_stats, domain_gate, failure_streak, domain_health, scan_metrics, failure_reasons, exposition,
           subdomain_best, capture_order, capture_quota, rate_window, variant_detect, cache_evict, introduced_commit, keyset_page, event_contract, event_routes, event_cooldown, progress_coalesce, progress_paced, terminal_flush, outbox_lookup, capture_dedup, finding_dedup, even_sample, crawl_progress, latest_snapshot, terminal_freeze, state_transitions,
           outbox_batches, outbox_usage, outbox_collisions, outbox_acknowledge, dead_letters, progress_fold, event_tumbling, event_sessions, cdx_parse, jsonl_index, record_locators, tree_snapshot, sourcemap_sources)

_K = "cast(json_extract_string(props, '$.k') as bigint)"
_FILES = "select doc_id, source || '/' || doc_id as locator, sha256(coalesce(text, '') || case when doc_id % 5 = 0 then '{0}' else '' end) as digest from documents where doc_id % 11 <> {0}"
_REQ = "with r as (select user_id % 25 as domain, ts, event_id as id, event_type <> 'error' as ok, value as t from events) "
_STATS = "select domain, count(*) as total, count(*) filter (ok) as success, count(*) filter (not ok) as failed, round(avg(t) filter (ok), 4) as avg_response_time, round(100.0 * avg(ok::integer), 4) as success_rate from r group by 1"
_STREAK = "select domain, max(f) as longest, arg_max(f, b) as current from (select domain, b, count(*) filter (not ok) as f from (select *, sum(ok::integer) over (partition by domain order by ts, id rows unbounded preceding) as b from r) group by 1, 2) group by 1"
_KINDS = f"with k as (select event_id, case event_type when 'view' then 'js_analysis_complete' when 'click' then 'endpoint_found' when 'error' then 'retry_attempt' when 'signup' then 'scan_started' else 'batch_started' end as event_type, {_K} as k from events) "

SQL = {
    "scan_delta": "select case when p is null then 'new' when c is null then 'resolved' else 'existing' end as state, count(*) as n from (select o_orderkey as p from orders where o_orderkey % 10 <> 0) full join (select o_orderkey as c from orders where o_orderkey % 10 <> 3) on p = c group by 1",
    "scan_baselines": "select o_orderkey as scan_id, lag(o_orderkey) over (partition by o_custkey, o_orderpriority order by o_orderkey) as previous from orders where o_orderstatus <> 'P' and o_orderkey % 7 <> 0",
    "checkpoint_reuse": f"select b.locator from ({_FILES.format(1)}) a join ({_FILES.format(2)}) b using (locator, digest)",
    "stale_antijoin": f"select locator from ({_FILES.format(1)}) where locator not in (select locator from ({_FILES.format(2)}))",
    "incremental_scan": f"select case when a.digest is null then 'scanned' else 'kept' end as result, count(*) as n from ({_FILES.format(2)}) b left join ({_FILES.format(1)}) a using (locator, digest) group by 1",
    "asof_map": "select p.event_id, p.user_id, v.view_id from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, max(event_id) as view_id from events where event_type = 'view' group by 1, 2) v on p.user_id = v.user_id and p.ts >= v.ts",
    "content_reuse": "select doc_id as capture_id, f as reused_from from (select doc_id, min(doc_id) over (partition by coalesce(text, '')) as f from documents) where f <> doc_id",
    "recheck_coverage": "select count(*) as assets, count(n) as analyzed, bool_and(n is not null) as covered from (select distinct user_id from events where event_type = 'view') left join (select user_id, count(*) as n from events where event_type = 'click' group by 1) using (user_id)",
    "recheck_manifest": "select url, arg_max(kind, page_id) as kind from (select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) as url, case page_id % 3 when 0 then 'document' when 1 then 'javascript' else 'image' end as kind from (select * from pages order by page_id limit 500)) where kind <> 'image' group by 1",
    "domain_stats": _REQ + _STATS,
    "domain_gate": _REQ.replace("event_type <> 'error'", "event_type = 'purchase'") + f"select domain, success_rate from ({_STATS}) where total > 10 and success_rate < 30",
    "failure_streak": _REQ + _STREAK,
    "domain_health": _REQ + f"select count(*) filter (success_rate > 80) as healthy, count(*) filter (current >= 5) as problematic, count(*) as domains from ({_STATS}) join ({_STREAK}) using (domain)",
    "scan_metrics": "select user_id, d as processed, b as failed, round(coalesce(100.0 * d / nullif(d + b, 0), 0), 4) as success_rate from (select user_id, count(*) filter (event_type in ('view', 'click')) as d, count(*) filter (event_type = 'error') as b from events group by 1)",
    "failure_reasons": f"select case {_K} % 5 when 0 then 'blocked' when 1 then 'missing' when 2 then 'rate_limited' else 'server' end as reason, count(*) as n from events where event_type = 'error' group by 1",
    "exposition": "select 'agent_' || event_type || '_total ' || count(*) as line from events group by event_type",
    "subdomain_best": "select * from (select 'h' || (user_id % 40) as url, case when event_type = 'view' then 'dns' else event_type end as source, round(event_id % 10 / 10, 1) as confidence, event_id as seen from events) qualify row_number() over (partition by url order by confidence desc, source = 'dns', seen) = 1",
    "capture_order": "select url, ts, cast(case when i = 1 then 1 when i = n then 2 else i + 1 end as integer) as turn from (select *, row_number() over (partition by url order by ts) as i, count(*) over (partition by url) as n from (select 'u' || lpad(cast(user_id % 50 as varchar), 3, '0') as url, event_id as ts from events))",
    "capture_quota": """with e as (select event_id, case event_type when 'view' then 0 when 'signup' then 1 when 'click' then 2 end as pool from events), r as (select *, row_number() over (partition by pool order by event_id) as rank from e where pool is not null),
        z as (select pool, count(*) as size, case pool when 0 then 180 when 1 then 75 else 45 end as quota from r group by 1), t as (select *, greatest(least(least(quota, size), 300 - coalesce(sum(least(quota, size)) over (order by pool rows between unbounded preceding and 1 preceding), 0)), 0) as take from z),
        x as (select *, size - take as rest, 300 - sum(take) over () as room from t), y as (select *, greatest(least(rest, room - coalesce(sum(rest) over (order by pool rows between unbounded preceding and 1 preceding), 0)), 0) as extra from x)
        select event_id, pool from r join y using (pool) where rank <= take + extra""",
    "rate_window": "select event_id, count(*) over w as in_window, count(*) over w > 8 as limited from events window w as (partition by user_id % 10 order by ts range between interval 1800 seconds preceding and current row)",
    "variant_detect": "select case when b is null then 'new' when b = h then 'unchanged' else 'variant' end as change, count(*) as n from (select json_extract_string(props, '$.k') as h, lag(json_extract_string(props, '$.k')) over (partition by user_id order by ts, event_id) as b from events) group by 1",
    "cache_evict": "select doc_id as id from documents qualify row_number() over (partition by source order by doc_id desc) <= 4096 and sum(n_chars) over (partition by source order by doc_id desc rows unbounded preceding) <= 100000000",
    "introduced_commit": "with c as (select user_id as finding, row_number() over (partition by user_id order by event_id desc) as ordinal, event_type <> 'error' as has from events), d as (select *, coalesce(lead(has) over (partition by finding order by ordinal), false) as parent_has from c where ordinal <= 32), u as (select *, min(has::integer) over (partition by finding order by ordinal rows unbounded preceding) = 1 as ok from d) select finding, min(ordinal) as ordinal from u where ok and not parent_has group by 1",
    "keyset_page": "select doc_id, source from documents where doc_id > 100 order by doc_id limit 128",
    "event_contract": _KINDS + "select event_type, case event_type when 'js_analysis_complete' then k % 3 > 0 when 'endpoint_found' then k % 4 = 0 or k % 10 >= 7 when 'retry_attempt' then false else true end as reported, count(*) as n from k group by 1, 2",
    "event_routes": _KINDS + "select case event_type when 'scan_started' then 'flush' when 'batch_started' then 'drop' else 'buffered' end as route, count(*) as n from k group by 1",
    "event_cooldown": "with recursive o as (select user_id % 30 as key, ts, event_id as id, row_number() over (partition by user_id % 30 order by ts, event_id) as i from events), r as (select key, i, id, ts as last, true as kept from o where i = 1 union all select o.key, o.i, o.id, case when o.ts - r.last >= interval 6 hours then o.ts else r.last end, o.ts - r.last >= interval 6 hours from r join o on o.key = r.key and o.i = r.i + 1) select id as event_id from r where kept",
    "progress_coalesce": "select event_id, event_type as phase from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is null or b <> event_type",
    "progress_paced": """with recursive o as (select user_id, event_id, ts, row_number() over w as i, event_type <> 'signup' and event_type is distinct from lag(case when event_type <> 'signup' then event_type else '' end) over w as moved from events window w as (partition by user_id order by ts, event_id)),
        r as (select user_id, i, event_id, ts as last, true as flows from o where i = 1 union all select o.user_id, o.i, o.event_id, case when o.moved or o.ts - r.last >= interval 12 hours then o.ts else r.last end, o.moved or o.ts - r.last >= interval 12 hours from r join o on o.user_id = r.user_id and o.i = r.i + 1)
        select event_id from r where flows""",
    "terminal_flush": """with k as (select user_id as scan_id, ts, event_id as id, case event_type when 'purchase' then 'scan_completed' when 'view' then 'scan_progress' when 'click' then 'stats_update' end as event_type, props as data from events where event_type in ('purchase', 'view', 'click')),
        t as (select * from k where event_type = 'scan_completed'), n as (select k.*, (select arg_min(t.id, struct_pack(a := t.ts, b := t.id)) from t where t.scan_id = k.scan_id and (t.ts, t.id) > (k.ts, k.id)) as terminal_id from k where event_type <> 'scan_completed')
        select scan_id, terminal_id, event_type, arg_max(data, struct_pack(a := ts, b := id)) as data, false as "last" from n where terminal_id is not null group by 1, 2, 3 union all select scan_id, id, event_type, data, true from t""",
    "outbox_lookup": """with l as (select event_id % 700 as id, props from events), h as (select event_id as id, props as held from events where event_id < 700 and event_id % 3 in (0, 1))
        select case when held is null then 'new' when held = props then 'duplicate' else 'conflict' end as verdict, count(*) as n from l left join h using (id) group by 1""",
    "capture_dedup": "select url, provider, count(*) as n from (select user_id % 50 as url, date_trunc('day', ts) as d, arg_max(event_type, event_id) as provider from events group by 1, 2) group by 1, 2",
    "finding_dedup": "select fingerprint, rule, seq from (select sha256(cast(event_id * 7 % 1000 as varchar)) as fingerprint, arg_max(event_type, event_id) as rule, max(event_id) as seq, min(event_id) as f from events group by 1) order by f, fingerprint limit 200",
    "even_sample": "with d as (select list_sort(list(distinct cast(ts as date))) as l from events) select unnest(case when len(l) <= 8 then l else list_transform(range(0, 8), lambda i: l[1 + cast(i * (len(l) - 1) // 7 as bigint)]) end) as day from d",
    "crawl_progress": "select count(*) as total_urls, count(*) filter (s = 'p') as processed_urls, count(*) filter (s = 'q' and event_id % 4 <> 0) as remaining_urls, count(*) filter (s = 'q' and event_id % 4 = 0) as js_remaining, count(*) filter (s = 'f') as failed_urls, round(100.0 * count(*) filter (s = 'p') / count(*), 6) as progress_percent from (select event_id, case when event_type in ('view', 'purchase') then 'p' when event_type = 'error' then 'f' else 'q' end as s from events)",
    "latest_snapshot": "select user_id, event_type, arg_max(props, struct_pack(a := ts, b := event_id)) as data from events group by 1, 2",
    "terminal_freeze": "select user_id as scan_id, count(*) as n from (select *, coalesce(sum((event_type = 'purchase')::integer) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as e from events) where e = 0 group by 1",
    "state_transitions": "with s as (select user_id, ts, event_id, case event_type when 'view' then 'running' when 'click' then 'paused' when 'error' then 'failed' when 'purchase' then 'completed' else 'pending' end as status from events), b as (select status, lag(status) over (partition by user_id order by ts, event_id) as before from s) select status, before is null or before = status or (before, status) in (" + ", ".join(f"('{a}', '{b}')" for a, b in S.STEPS) + ") as allowed, count(*) as n from b group by 1, 2",
    "outbox_batches": "select scan_id, b as batch, count(*) as n, min(seq) as first_seq from (select user_id % 5 as scan_id, event_id as seq, (row_number() over (partition by user_id % 5 order by event_id) - 1) // 200 as b from events) group by 1, 2",
    "outbox_usage": "select user_id % 5 as scan_id, count(*) as pending, cast(coalesce(sum(length(props)), 0) as bigint) as used from events group by 1",
    "outbox_collisions": "select event_id % 500 as event_id, count(distinct props) as payloads from events group by 1 having count(distinct props) > 1",
    "outbox_acknowledge": "select event_type, count(*) as pending from events where event_id % 3 <> 0 group by 1",
    "dead_letters": "select event_id, event_id % 5 + 1 as retry_count from events where ts <= timestamp '2024-01-20' and ts > timestamp '2024-01-19' and event_id % 5 < 3",
    "progress_fold": f"select scan_id, max(p) as processed, cast(sum(a) as bigint) as artifacts, count(*) as batches from (select user_id as scan_id, event_id % 20 as b, max({_K}) as p, max({_K} % 4) as a from events group by 1, 2) group by 1",
    "event_tumbling": "select time_bucket(interval 1 day, ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "event_sessions": "select user_id, min(ts) as session_start, count(*) as n from (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 day then 0 else 1 end as s from events)) group by user_id, g",
    "cdx_parse": "select strftime(timestamp '2024-01-01' + to_days(cast(page_id as integer)), '%Y%m%d%H%M%S') as timestamp, url as original, 'D' || page_id as digest from pages where page_id % 4 <> 0 and regexp_full_match(url, 'https?://[^/]+/.*[02468]')",
    "jsonl_index": "select url, page_id as \"offset\", 10::bigint as length from pages where page_id % 5 <> 0 and page_id % 7 <> 0",
    "record_locators": "select page_id, page_id % 3 = 0 and page_id % 5 <> 0 and page_id % 50 >= 1 and page_id % 7 <> 0 as valid from pages",
    "tree_snapshot": "select repo, path from (select source as repo, 'f' || lpad(cast(doc_id as varchar), 7, '0') as path, n_chars as size from documents where doc_id % 9 <> 0 and doc_id % 8 <> 0) qualify count(*) over (partition by repo order by path rows unbounded preceding) <= 10 and sum(size) over (partition by repo order by path rows unbounded preceding) <= 30000",
    "sourcemap_sources": "select page_id as map_id, 'a.js' as source, url as content from pages where page_id % 6 <> 0",
}
