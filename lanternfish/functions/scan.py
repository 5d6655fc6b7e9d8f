"""Expressions about scans: validity of content, scores, reasons, waits, fingerprints, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import urls as U
from .text import either

# Limits by profile, words that tell pages and scripts, reasons of failures, phases in order.
PROFILES = {
    "quick": {"max_files": 10_000, "max_bytes": 100_000_000, "max_file_bytes": 1_000_000},
    "standard": {"max_files": 100_000, "max_bytes": 500_000_000, "max_file_bytes": 5_000_000},
    "deep": {"max_files": 200_000, "max_bytes": 1_000_000_000, "max_file_bytes": 10_000_000},
}
SCRIPT_WORDS = ("function", "var ", "let ", "const ", "return ", "if ", "for ", "while ")
SCRIPT_SIGNS = ("() =>", "=>", "{", "}", ";", "=", "//", "/*")
PAGE_WORDS = ("<html", "<script", "<div", "<body", "<head", "<title", "function", "var ", "const ", "let ", "export", "import", "window.", "document.")
PAGE_TYPES = ("application/json", "application/xml", "application/yaml", "application/x-yaml", "application/toml")
SCRIPT_PLACES = ("/static/", "/assets/", "/chunks/", "/bundles/", "/_next/", "/js/", "/javascript/", "/scripts/", "chunk-", "bundle.", "main.", "vendor.", "app.", "runtime.", "polyfills.", "common.", "shared.")
UNAVAILABLE = ("http_error", "resource_missing", "access_denied", "rate_limited", "server_error", "network_error", "download_timeout", "response_limit", "invalid_content", "circuit_open", "scope_refused")
PHASES = ("discovery", "crawling", "analysis", "finalizing")
SCAN_MESSAGES = {
    "No target pages were fetched successfully": "target_unreachable", "Response exceeds the scan size limit": "response_limit", "Request or redirect is outside scan scope": "scope_refused",
    "TLS downgrade redirect refused": "scope_refused", "Private targets require ALLOW_PRIVATE_TARGETS=true": "scope_refused", "Special network addresses are not scanning targets": "scope_refused",
}


def _hits(text: Column, words) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def script_valid(text: Column, mime: Column) -> Column:
    nul = F.regexp_count(text, F.lit("\\x00")) / F.greatest(F.length(text), F.lit(1))
    page = F.lower(F.ltrim(F.substring(text, 1, 512))).rlike(r"^(?:<!doctype html|<html|<body)")
    head, kind = F.substring(text, 1, 1024), F.lower(mime)
    return ~page & (either(F.contains(kind, F.lit(k)) for k in ("javascript", "ecmascript", "application/json")) | (((_hits(head, SCRIPT_WORDS) >= 2) | (_hits(head, SCRIPT_SIGNS) >= 3)) & (nul < 0.01)))


def page_valid(text: Column, mime: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(mime, ";", 1)))
    typed = ~F.contains(text, F.lit("\x00")) & (F.startswith(kind, F.lit("text/")) | kind.isin(*PAGE_TYPES))
    return typed | (_hits(F.lower(text), PAGE_WORDS) > 0) | F.trim(text).rlike(r"^[{\[]")


def looks_like_script(url: Column) -> Column:
    return U.is_js(url) | (_hits(F.lower(url), SCRIPT_PLACES) > 0)


def analysis_confidence(endpoints: Column, findings: Column, confidence: Column, size: Column) -> Column:
    """From distinct endpoints, findings and their summed confidence, and the size in bytes."""
    tier = F.when(size > 50_000, 0.25).when(size > 10_000, 0.15).when(size > 1_000, 0.05).otherwise(0.0)
    return F.least(F.least(endpoints * 0.15, F.lit(0.6)) + F.least(confidence * 0.4 + findings * 0.1, F.lit(0.8)) + tier, F.lit(1.0))


def http_reason(status: Column) -> Column:
    return F.when(status.isin(401, 403), "access_denied").when(status.isin(404, 410), "resource_missing").when(status == 429, "rate_limited").when(status.between(500, 599), "server_error").otherwise("http_error")


def scan_reason(message: Column) -> Column:
    """A public code for an error's text; the text itself goes no further."""
    out = F.lit("scan_failed")
    for text, code in SCAN_MESSAGES.items():
        out = F.when(message == text, code).otherwise(out)
    return out


def backoff(tries: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), tries))


def scope_fingerprint(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def detector_policy(policy: str, aggressive: Column, digest: Column, acquisition: Column) -> Column:
    flag = F.when(aggressive, "True").otherwise("False")
    return F.sha2(F.concat(F.lit(policy + ":"), flag, F.lit(":"), digest, F.when(F.coalesce(acquisition, F.lit("")) != "", F.concat(F.lit(":"), acquisition)).otherwise("")), 256)


def archive_url(url: Column) -> Column:
    """Whether an archive may be asked for a URL: public domain, default port, no user or fragment, cache parameters alone,
    no token in path or query."""
    names = F.transform(F.filter(F.split(U.query(url), "&"), lambda x: x != ""), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "^[^=]*=?(.*)$", 1).alias("v")))
    fine = F.forall(names, lambda x: x["k"].isin("v", "ver", "version", "build", "cache", "t", "_", "hash") & x["v"].rlike("^[A-Za-z0-9._-]{1,64}$"))
    port = F.when(U.scheme(url) == "https", U.port(url).isin("", "443")).otherwise(U.port(url).isin("", "80"))
    host = U.host(url)
    token = r"gh[pousr]_[A-Za-z0-9_.-]{20,}|github_pat_[A-Za-z0-9_]{20,}|AIza[A-Za-z0-9_-]{30,}|AKIA[A-Z0-9]{16}|gsk_[A-Za-z0-9]{20,}"
    public = F.contains(host, F.lit(".")) & ~host.rlike(r"^[0-9.]+$|\.(?:local|localhost|internal|invalid|test)$")
    return ((F.length(url) <= 2048) & ~url.rlike(r"[\x00-\x20\x7F]") & U.scheme(url).isin("http", "https") & ~F.contains(U.authority(url), F.lit("@")) & (U.fragment(url) == "") & port & fine & public
            & ~F.concat(U.path(url), F.lit("?"), U.query(url)).rlike(token))


def findings_envelope(count: Column, files: Column, severity: Column) -> Column:
    return F.struct(F.coalesce(count, F.lit(0)).alias("leaks_found"), F.coalesce(files, F.array().cast("array<string>")).alias("files"), F.coalesce(severity, F.lit("info")).alias("severity"))


def limited(failed: Column, succeeded: Column, cancelled: Column, errors: Column, required_unavailable: Column) -> Column:
    """Whether a scan ended with less than all analysed though nothing else went wrong."""
    return (failed > 0) & (cancelled == 0) & (errors > 0) & required_unavailable & (succeeded > 0)


def steady_phase(events: DataFrame) -> DataFrame:
    """events (scan_id, ts, id, phase) plus shown: the furthest phase so far; an earlier one does not take over."""
    place = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    far = F.max(place).over(W.partitionBy("scan_id").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("shown", F.get(F.array(*map(F.lit, PHASES)), (far - 1).cast("int")))


def guarded_progress(current: Column, total: Column) -> Column:
    """(current, total) as they may be shown: total one at least, current not beyond it."""
    t = F.greatest(total, F.lit(1))
    return F.struct(F.least(F.greatest(current, F.lit(0)), t).alias("current"), t.alias("total"))


def breaker_open(requests: DataFrame, threshold: int, seconds: int) -> DataFrame:
    """requests (domain, ts, id, ok) plus blocked: whether `threshold` failures in a row, the last within `seconds`, stand before."""
    w = W.partitionBy("domain").orderBy("ts", "id")
    block = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = requests.withColumn("_b", block)
    run = F.sum((~F.col("ok")).cast("int")).over(W.partitionBy("domain", "_b").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
    told = marked.withColumn("_run", run).withColumns({"_before": F.lag("_run").over(w), "_last": F.lag("ts").over(w)})
    since = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("_last").cast("timestamp"))
    return told.withColumn("blocked", F.coalesce((F.col("_before") >= threshold) & (since < seconds), F.lit(False))).drop("_b", "_run", "_before", "_last")
