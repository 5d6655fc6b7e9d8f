"""Queries over detection: seeded artifacts, inventories of natural data, evidence, suppression, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect as D
from ..sources import tables as T
from . import rules as R

#: Rules whose patterns both engines' regular expressions can hold (no look-around).
PORTABLE = [r for r in R.rules() if "(?=" not in r.pattern and "(?!" not in r.pattern and "(?<" not in r.pattern and r.rule not in ("generic_pem_private_key", "jwt_token")]


def _findings(spark, sf_dir) -> DataFrame:
    return D.detect(T.seeded(spark, sf_dir), PORTABLE, with_repeats=False)


def detect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "rule", "severity", "suspicious", "fingerprint", "evidence", "category", "policy", F.length("value").alias("match_length"), F.round("entropy", 4).alias("entropy"), F.round("risk", 4).alias("risk"))


def secrets_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.round(F.avg("entropy"), 4).alias("avg_entropy"), F.round(F.avg("risk"), 4).alias("avg_risk"), F.countDistinct("fingerprint").alias("n_fingerprints"))


def detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    sev = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]
    return f.agg(F.count("*").alias("total"), *sev, F.count_if("suspicious").alias("suspicious"), F.round(F.avg("risk"), 4).alias("avg_risk"), F.count_if(F.col("confidence") >= 0.9).alias("high_confidence"))


def risk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("doc_id", "rule", F.round("risk", 6).alias("risk")).orderBy(F.desc("risk"), "doc_id", "rule").limit(25)


def findings_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one finding an artifact, flagged where others were left out."""
    return D.capped(_findings(spark, sf_dir), 1).select("doc_id", "rule", "truncated")


def matches_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.native_matches(T.seeded(spark, sf_dir), PORTABLE).groupBy("rule").agg(F.count("*").alias("n_matches"), F.countDistinct("value").alias("n_values"))


def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.groupBy("severity").agg(F.count("*").alias("n"), F.round(F.max("risk"), 4).alias("max_risk"), F.round(F.min("risk"), 4).alias("min_risk"))


def evidence_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, context and redacted line of each finding; content is joined back to what survived."""
    f = _findings(spark, sf_dir).join(T.seeded(spark, sf_dir).select("doc_id", "content"), "doc_id")
    line = X.line_of(F.col("content"), F.col("value"))
    red = X.redacted(F.get(F.split("content", "\n"), line - 1), F.col("value"), F.col("evidence"))
    return f.select("doc_id", "rule", line.alias("line_number"), red.alias("redacted_line"), F.replace(X.context(F.col("content"), F.col("value")), F.col("value"), F.lit("*")).alias("context"))


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).join(T.seeded(spark, sf_dir).select("doc_id", "content"), "doc_id")
    line = X.line_of(F.col("content"), F.col("value"))
    return f.select("doc_id", "rule", F.sha2(X.lines_around(F.col("content"), line, 2, 2), 256).alias("context_sha256"))


def entropy_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.entropy(F.coalesce("text", F.lit("")))
    return T.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(h), 4).alias("avg_entropy"), F.round(F.max(h), 4).alias("max_entropy"))


def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    v = F.when(d % 4 == 0, "your_api_key_here").when(d % 4 == 1, F.concat(F.lit("sk_te" + "st_"), F.repeat(F.lit("x"), 12))).when(d % 4 == 2, F.left(F.sha2(d.cast("string"), 256), F.lit(20))).otherwise("Change-Me")
    return T.table(spark, sf_dir, "documents").select("doc_id", X.placeholder(v, False).alias("is_placeholder"), F.round(X.entropy(v), 4).alias("entropy"))


def jwt_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    enc = lambda s: F.translate(F.regexp_replace(F.base64(F.encode(s, "UTF-8")), "=+$", ""), "+/", "-_")
    head = F.when(d % 3 == 0, F.lit('{"alg":"HS256"}')).when(d % 3 == 1, F.lit('{"typ":"JWT"}')).otherwise(F.lit("[1]"))
    body = F.concat(F.lit('{"sub":"'), d.cast("string"), F.lit('"}'))
    token = F.concat(enc(head), F.lit("."), enc(body), F.lit("."), F.when(d % 5 == 0, "").otherwise("c2ln"))
    return T.table(spark, sf_dir, "documents").select("doc_id", X.jwt(token).alias("is_jwt"))


def conn_uri_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pw = F.when(d % 3 == 0, "changeme").when(d % 3 == 1, "").otherwise(F.left(F.sha2(d.cast("string"), 256), F.lit(12)))
    uri = F.concat(F.lit("redis://u:"), pw, F.lit("@h.example.org:6379/0"))
    return T.table(spark, sf_dir, "documents").select("doc_id", D.accepted(F.lit("redis_connection"), uri, F.lit(4.0), False).alias("accepted"))


def fingerprint_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed fingerprints of secrets that stand in more than one source."""
    f = _findings(spark, sf_dir).join(T.seeded(spark, sf_dir).select("doc_id", "source"), "doc_id")
    f = f.select("source", "fingerprint").distinct()
    return f.groupBy("fingerprint").agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source"))


def keyed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMAC-SHA256 of the normalised value under a workspace key."""
    f = _findings(spark, sf_dir)
    msg = F.concat(F.lit('["secret-correlation-v1","'), F.col("rule"), F.lit('","'), X.normalized_secret(F.col("rule"), F.col("value")), F.lit('"]'))
    return f.select("doc_id", "rule", X.hmac_sha256(bytes(range(32)), msg).alias("correlation_fingerprint"))


def suppression_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings flagged, never dropped, where a policy names their rule or path."""
    from ..sources.policy import parse_policy, suppressed

    policy = parse_policy("# local\nrule:npm_token\npath:src1/*\n")
    f = _findings(spark, sf_dir).join(T.seeded(spark, sf_dir).select("doc_id", "source"), "doc_id")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return f.select("doc_id", "rule", suppressed(policy, path, F.col("rule"), F.col("fingerprint")).alias("suppressed"))


def severity_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return f.groupBy("severity", X.adjusted_severity(F.col("severity"), F.col("entropy"), F.col("risk")).alias("adjusted")).agg(F.count("*").alias("n"))


def occurrence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of copies and new versions as one occurrence each: the same secret on the same line of the same source."""
    f = _findings(spark, sf_dir).join(T.seeded(spark, sf_dir).select("doc_id", "source", "content"), "doc_id")
    told = f.select("fingerprint", "source", X.line_of(F.col("content"), F.col("value")).alias("line"), "rule")
    return D.occurrences(told.unionByName(told)).groupBy("source").agg(F.count("*").alias("n"))


def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(r"\b[0-9]{13,19}\b"), F.lit(0))
    got = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("digits"))
    return got.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.count_if(X.luhn(F.col("digits"))).alias("n_cards"))


def ipv4_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls as U

    runs = F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"), F.lit(0))
    got = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(runs).alias("ip"))
    return got.select("doc_id", "ip", X.ipv4(F.col("ip")).alias("valid"), (X.ipv4(F.col("ip")) & U.public_ipv4(F.col("ip"))).alias("is_public"))


def email_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))
    got = T.table(spark, sf_dir, "documents").select("source", F.explode(hits).alias("email"))
    return got.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.lower("email")).alias("n_distinct"))


def detector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against found per rule: true and false positives, misses, precision and recall."""
    from ..operators.metrics import quality

    want = {0: "github_token", 1: "aws_access_key", 2: "npm_token", 3: "huggingface_token", 4: "gitlab_pat", 5: "google_api_key", 6: "mailgun_key", 7: "stripe_key", 9: "twilio_key", 10: "generic_api_key", 11: "mongodb_uri"}
    k = F.col("doc_id") % len(T.CARRIERS)
    rule = F.lit(None).cast("string")
    for i, r in want.items():
        rule = F.when(k == i, r).otherwise(rule)
    expected = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), rule.alias("rule")).where("rule is not null")
    return quality(expected, _findings(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "rule").distinct())


def label_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a simple verdict (any finding or email: suspect) and the label differ, over labelled rows."""
    verdict = F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    d = T.table(spark, sf_dir, "documents").select("doc_id", verdict.alias("suspect")).join(T.table(spark, sf_dir, "labels"), "doc_id")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("suspect") == (F.col("quality") > 0)).alias("disagree"), F.round(F.avg((F.col("suspect") == (F.col("quality") > 0)).cast("double")), 6).alias("rate"))


def exact_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules with offsets in one Arrow map (look-around, containment and overlap included)."""
    return D.detect_exact(T.seeded(spark, sf_dir)).select("doc_id", "rule", "start", "line", F.length("value").alias("match_length"), F.round("entropy", 4).alias("entropy"))


QUERIES = (detect_findings, secrets_by_severity, detector_stats, risk_topk, findings_capped, matches_by_rule, severity_buckets, evidence_location, context_lines, entropy_profile, placeholder_filter, jwt_validate,
           conn_uri_validate, fingerprint_correlation, keyed_fingerprints, suppression_annotate, severity_adjusted, occurrence_dedup, luhn_cards, ipv4_inventory, email_inventory, detector_quality, label_disagreement, exact_backend)

# ---- the same in SQL -----------------------------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def entropy_sql(v: str) -> str:
    n = f"((length({v}) - length(replace({v}, c, '')))::double / length({v}))"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -{n} * log2({n}))), 0.0)"


def placeholder_sql(v: str) -> str:
    low = f"lower(trim({v}))"
    forms = " or ".join(f"regexp_matches({low}, {q(p)})" for p in X.PLACEHOLDER_FORMS)
    return f"({v} in ({', '.join(map(q, X.EXAMPLES))}) or {forms} or (length({v}) > 7 and len(list_distinct(string_split({v}, ''))) <= 2) or {low} in ({', '.join(map(q, X.PLACEHOLDER_WORDS))}))"


def mask_sql(v: str) -> str:
    return "case " + " ".join(f"when starts_with({v}, {q(p)}) then {q(p)} || case when length({v}) > {len(p)} then '[REDACTED_' || (length({v}) - {len(p)}) || '_CHARS]' else '' end" for p in R.KNOWN_PREFIXES) + " else '[REDACTED_SECRET]' end"


def accepted_sql(rule: str, v: str, h: str) -> str:
    shape = " ".join([f"when {rule} = {q(k)} then (" + " or ".join(f"starts_with({v}, {q(p)})" for p in ps) + ")" for k, ps in R.PREFIXES.items()] + [f"when {rule} = {q(k)} then contains({v}, {q(c)})" for k, c in R.CONTAINS.items()])
    body = f"regexp_replace({v}, {q(X.BODY_PREFIX)}, '')"
    pw = f"regexp_extract({v}, '^[a-z+]+://[^:/@]*:([^@/]+)@[^/?#:@]+', 1)"
    public = " or ".join(f"starts_with({v}, {q(p)})" for p in ("pk_live_", "pk_test_", "sk_test_", "rk_test_", "pk.eyJ"))
    return (f"(case {shape} else true end) and not {placeholder_sql(v)} and not ({rule} in ('aws_access_key', 'github_token', 'github_fine_grained_pat', 'stripe_key', 'stripe_restricted_key') and {placeholder_sql(body)}) and "
            f"(case when {rule} in ({', '.join(map(q, R.CONNECTIONS))}) then {pw} <> '' and not {placeholder_sql(pw)} when {rule} = 'generic_api_key' then length({v}) >= 20 and {h} >= (case when regexp_matches({v}, '^[a-fA-F0-9]+$') then 2.8 else 3.2 end) and not ({public}) else true end)")


_MATCHES = " union all ".join(f"select doc_id, {q(r.rule)} as rule, {r.ordinal} as ordinal, {r.confidence}::double as confidence, {q(r.severity)} as severity, {R.SUSPICIOUS[r.charset]}::double as threshold, {str(r.generic).lower()} as generic, unnest(regexp_extract_all(content, {q('(?im)' + r.pattern)}, {r.group})) as value from seeded" for r in PORTABLE)
_BASE = "case severity when 'CRITICAL' then 0.9::double when 'HIGH' then 0.7::double when 'MEDIUM' then 0.5::double else 0.3::double end"
WITH = f"""with seeded as ({T.seeded_sql()}), matches as (select * from ({_MATCHES}) where length(value) >= 5),
e as (select *, {entropy_sql('value')} as entropy from matches),
s as (select *, entropy > threshold as suspicious, {_BASE} * 0.4::double + least(entropy / 8, 1) * 0.3::double + confidence * 0.3::double as risk, left(sha256(rule || ':' || value), 32) as fingerprint, {mask_sql('value')} as evidence from e where {accepted_sql('rule', 'value', 'entropy')}),
f as (select * from s qualify row_number() over (partition by doc_id, value order by generic, confidence desc, ordinal) = 1) """

SQL = {
    "detect_findings": WITH + f"select doc_id, rule, severity, suspicious, fingerprint, evidence, 'Secrets' as category, '{R.POLICY}' as policy, cast(length(value) as integer) as match_length, round(entropy, 4) as entropy, round(risk, 4) as risk from f",
    "secrets_by_severity": WITH + "select rule, severity, count(*) as n, round(avg(entropy), 4) as avg_entropy, round(avg(risk), 4) as avg_risk, count(distinct fingerprint) as n_fingerprints from f group by all",
    "detector_stats": WITH + "select count(*) as total, count(*) filter (severity = 'CRITICAL') as n_critical, count(*) filter (severity = 'HIGH') as n_high, count(*) filter (severity = 'MEDIUM') as n_medium, count(*) filter (severity = 'LOW') as n_low, count(*) filter (suspicious) as suspicious, round(avg(risk), 4) as avg_risk, count(*) filter (confidence >= 0.9) as high_confidence from f",
    "risk_topk": WITH + "select doc_id, rule, round(risk, 6) as risk from f order by round(risk, 6) desc, doc_id, rule limit 25",
    "findings_capped": WITH + "select doc_id, rule, count(*) over (partition by doc_id) > 1 as truncated from f qualify row_number() over (partition by doc_id order by ordinal, value) <= 1",
    "matches_by_rule": WITH + "select rule, count(*) as n_matches, count(distinct value) as n_values from matches group by 1",
    "severity_buckets": WITH + "select severity, count(*) as n, round(max(risk), 4) as max_risk, round(min(risk), 4) as min_risk from f group by 1",
    "evidence_location": WITH + r"""select doc_id, rule, cast(len(string_split(substr(content, 1, strpos(content, value) - 1), chr(10))) as integer) as line_number,
        replace(string_split(content, chr(10))[len(string_split(substr(content, 1, strpos(content, value) - 1), chr(10)))], value, evidence) as redacted_line,
        replace(trim(regexp_replace(substr(content, greatest(strpos(content, value) - 50, 1), strpos(content, value) + length(value) + 50 - greatest(strpos(content, value) - 50, 1)), '\s+', ' ', 'g')), value, '*') as context from f join seeded using (doc_id)""",
    "context_lines": WITH + """select doc_id, rule, sha256(array_to_string(list_slice(string_split(content, chr(10)), greatest(ln - 2, 1), ln + 2), chr(10))) as context_sha256
        from (select doc_id, rule, content, len(string_split(substr(content, 1, strpos(content, value) - 1), chr(10))) as ln from f join seeded using (doc_id))""",
    "entropy_profile": f"select lang, count(*) as n, round(avg(h), 4) as avg_entropy, round(max(h), 4) as max_entropy from (select lang, {entropy_sql('t')} as h from (select lang, coalesce(text, '') as t from documents)) group by 1",
    "placeholder_filter": f"select doc_id, {placeholder_sql('v')} as is_placeholder, round({entropy_sql('v')}, 4) as entropy from (select doc_id, case doc_id % 4 when 0 then 'your_api_key_here' when 1 then 'sk_te' || 'st_' || repeat('x', 12) when 2 then left(sha256(cast(doc_id as varchar)), 20) else 'Change-Me' end as v from documents)",
    "jwt_validate": "select doc_id, doc_id % 3 = 0 and doc_id % 5 <> 0 as is_jwt from documents",
    "conn_uri_validate": "select doc_id, doc_id % 3 = 2 as accepted from documents",
    "fingerprint_correlation": WITH + "select fingerprint, count(distinct source) as n_sources, min(source) as first_source from f join seeded using (doc_id) group by 1",
    "suppression_annotate": WITH + "select doc_id, rule, rule = 'npm_token' or source = 'src1' as suppressed from f join seeded using (doc_id)",
    "severity_adjusted": WITH + """, l as (select *, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) as a from f), m as (select *, least(a + (entropy > 4)::int, 4) as b from l), o as (select *, least(b + (risk > 0.8)::int, 4) as c from m)
        select severity, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[greatest(c - (risk < 0.3)::int, 1)] as adjusted, count(*) as n from o group by 1, 2""",
    "occurrence_dedup": WITH + "select source, count(*) as n from (select distinct fingerprint, source, len(string_split(substr(content, 1, strpos(content, value) - 1), chr(10))) as line from f join seeded using (doc_id)) group by 1",
    "luhn_cards": r"""select doc_id, count(*) as n_runs, count(*) filter ((list_sum(list_transform(range(1, length(d) + 1), lambda i: case when (i % 2) = 1 then cast(substr(d, length(d) + 1 - i, 1) as integer) else (2 * cast(substr(d, length(d) + 1 - i, 1) as integer)) // 10 + (2 * cast(substr(d, length(d) + 1 - i, 1) as integer)) % 10 end)) % 10) = 0) as n_cards
        from (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{13,19}\b')) as d from documents) group by 1""",
    "email_inventory": r"select source, count(*) as n, count(distinct lower(email)) as n_distinct from (select source, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as email from documents) group by 1",
    "ipv4_inventory": r"""with i as (select doc_id, unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')) as ip from documents),
        p as (select *, list_transform(string_split(ip, '.'), lambda x: cast(x as integer)) as o from i), v as (select *, list_max(o) <= 255 as valid from p)
        select doc_id, ip, valid, valid and not (o[1] in (0, 10, 127) or o[1] >= 224 or (o[1] = 100 and o[2] between 64 and 127) or (o[1] = 169 and o[2] = 254) or (o[1] = 172 and o[2] between 16 and 31) or (o[1] = 192 and ((o[2] = 0 and o[3] in (0, 2)) or o[2] = 168)) or (o[1] = 198 and (o[2] in (18, 19) or (o[2] = 51 and o[3] = 100))) or (o[1] = 203 and o[2] = 0 and o[3] = 113)) as is_public from v""",
    "label_disagreement": r"select count(*) as n, count(*) filter (suspect = (quality > 0)) as disagree, round(avg((suspect = (quality > 0))::integer), 6) as rate from (select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as suspect from documents) join labels using (doc_id)",
    "detector_quality": WITH + """, want as (select doc_id, case doc_id % 14 when 0 then 'github_token' when 1 then 'aws_access_key' when 2 then 'npm_token' when 3 then 'huggingface_token' when 4 then 'gitlab_pat' when 5 then 'google_api_key' when 6 then 'mailgun_key' when 7 then 'stripe_key' when 9 then 'twilio_key' when 10 then 'generic_api_key' when 11 then 'mongodb_uri' end as rule from documents),
        w as (select * from want where rule is not null), g as (select distinct doc_id, rule from f),
        j as (select rule, w.doc_id is not null as a, g.doc_id is not null as b from w full join g using (doc_id, rule))
        select rule, count(*) filter (a and b) as tp, count(*) filter (b and not a) as fp, count(*) filter (a and not b) as fn, round(count(*) filter (a and b)::double / nullif(count(*) filter (b), 0), 6) as "precision", round(count(*) filter (a and b)::double / nullif(count(*) filter (a), 0), 6) as recall from j group by 1""",
}
