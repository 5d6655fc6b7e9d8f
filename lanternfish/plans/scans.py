"""Queries over scans' scores, reasons and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan as S
from ..functions import urls as U
from ..sources import tables as T
from .web import PARTS


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def content_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", S.script_valid(F.col("html"), F.lit("text/html")).alias("script"), S.page_valid(F.col("html"), F.lit("application/octet-stream")).alias("page"), S.looks_like_script(F.col("url")).alias("named_script"))


def analysis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(_k()) % 6).alias("endpoints"), (F.min(_k()) % 4).alias("findings"), (F.sum(_k()) * 100).alias("size"))
    return e.select("user_id", F.round(S.analysis_confidence(F.col("endpoints"), F.col("findings"), F.col("findings") * 0.8, F.col("size")), 4).alias("score"))


def http_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (401, 404, 429, 500, 302))), (_k() % 5 + 1).cast("int"))
    return T.table(spark, sf_dir, "events").groupBy(S.http_reason(status).alias("reason")).agg(F.count("*").alias("n"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select((_k() % 10).alias("tries")).distinct().select("tries", S.backoff(F.col("tries"), 1.0, 30.0).alias("outbox"), S.backoff(F.col("tries"), 300.0, 3600.0).alias("breaker"))


def archive_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    u = F.concat(F.lit("https://h"), p.cast("string"), F.when(p % 6 == 0, ".internal").otherwise(".example.com"), F.when(p % 6 == 1, ":8443").otherwise(""), F.lit("/x"), F.when(p % 6 == 2, "?user=1").when(p % 6 == 3, "?v=1.2&t=").when(p % 6 == 4, "#f").otherwise("?v=1"))
    return T.table(spark, sf_dir, "pages").select("page_id", S.archive_url(u).alias("allowed"))


def policy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("page_id")
    return T.table(spark, sf_dir, "pages").select("page_id", S.detector_policy("detector-v4", d % 2 == 0, d.cast("string"), F.when(d % 3 == 0, "rendered")).alias("policy"), S.scope_fingerprint(U.host(F.col("url")).alias("target"), F.lit(True).alias("subdomains")).alias("scope"))


def phase_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), "ts", F.col("event_id").alias("id"), F.element_at(F.array(*map(F.lit, S.PHASES)), (_k() % 4 + 1).cast("int")).alias("phase"))
    return S.steady_phase(e).select("id", "shown")


def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("domain"), "ts", F.col("event_id").alias("id"), (~F.col("event_type").isin("error", "click")).alias("ok"))
    return S.breaker_open(e, 3, 6 * 3600).groupBy("domain").agg(F.count_if("blocked").alias("blocked"), F.count("*").alias("requests"))


def progress_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "events").select("event_id", S.guarded_progress(_k(), F.col("user_id") % 40).alias("p")).select("event_id", "p.current", "p.total")


def same_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages stand on each host, ports and case aside."""
    return T.table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(U.html_root(F.col("url"))).alias("roots"))


QUERIES = (content_validity, analysis_scores, http_reasons, retry_waits, archive_contract, policy_fingerprints, phase_guard, breaker, progress_guard, same_hosts)

_K = "cast(json_extract_string(props, '$.k') as bigint)"
_n = lambda t, ws: " + ".join(f"contains({t}, '{w}')::int" for w in ws)
SQL = {
    "content_validity": PARTS + f"""select page_id, not regexp_matches(lower(ltrim(substr(html, 1, 512))), '^(?:<!doctype html|<html|<body)') and ({_n('substr(html, 1, 1024)', S.SCRIPT_WORDS)} >= 2 or {_n('substr(html, 1, 1024)', S.SCRIPT_SIGNS)} >= 3) as script,
        {_n('lower(html)', S.PAGE_WORDS)} > 0 or regexp_matches(trim(html), '^[{{\\[]') as page, regexp_matches(lower(path), '\\.(?:js|mjs|cjs)$') or {_n('lower(url)', S.SCRIPT_PLACES)} > 0 as named_script from x""",
    "analysis_scores": f"select user_id, round(least(least(e * 0.15, 0.6) + least(f * 0.8 * 0.4 + f * 0.1, 0.8) + case when s > 50000 then 0.25 when s > 10000 then 0.15 when s > 1000 then 0.05 else 0 end, 1.0)::double, 4) as score from (select user_id, max({_K}) % 6 as e, min({_K}) % 4 as f, sum({_K}) * 100 as s from events group by 1)",
    "http_reasons": f"select (['access_denied', 'resource_missing', 'rate_limited', 'server_error', 'http_error'])[{_K} % 5 + 1] as reason, count(*) as n from events group by 1",
    "retry_waits": f"select tries, least(30.0, pow(2.0, tries))::double as outbox, least(3600.0, 300.0 * pow(2.0, tries))::double as breaker from (select distinct {_K} % 10 as tries from events)",
    "archive_contract": "select page_id, page_id % 6 = 5 as allowed from pages",
    "policy_fingerprints": PARTS + "select page_id, sha256('detector-v4:' || case when page_id % 2 = 0 then 'True' else 'False' end || ':' || page_id || case when page_id % 3 = 0 then ':rendered' else '' end) as policy, sha256('{\"target\":\"' || host || '\",\"subdomains\":true}') as scope from x",
    "phase_guard": f"select event_id as id, (['discovery', 'crawling', 'analysis', 'finalizing'])[max({_K} % 4 + 1) over (partition by user_id order by ts, event_id rows unbounded preceding)] as shown from events",
    "breaker": "with e as (select user_id % 25 as domain, ts, event_id as id, event_type not in ('error', 'click') as ok from events), b as (select *, sum(ok::int) over (partition by domain order by ts, id rows unbounded preceding) as b from e), r as (select *, sum((not ok)::int) over (partition by domain, b order by ts, id rows unbounded preceding) as r from b), l as (select *, lag(r) over (partition by domain order by ts, id) as br, lag(ts) over (partition by domain order by ts, id) as lt from r) select domain, count(*) filter (br >= 3 and floor(epoch(ts)) - floor(epoch(lt)) < 21600) as blocked, count(*) as requests from l group by 1",
    "progress_guard": f"select event_id, least(greatest({_K}, 0), greatest(user_id % 40, 1)) as current, greatest(user_id % 40, 1) as total from events",
    "same_hosts": PARTS + "select host, count(*) as pages, count(distinct scheme || '://' || lower(auth) || path || qs) as roots from x group by 1",
}
