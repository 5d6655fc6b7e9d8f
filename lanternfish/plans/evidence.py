"""Queries over evidence: redaction, paths, roles, semantic observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detect as D
from ..operators import evidence as V
from ..sources import tables as T
from .detection import PORTABLE, WITH


def _located(spark, sf_dir) -> DataFrame:
    f = D.detect(T.seeded(spark, sf_dir), PORTABLE, with_repeats=False).join(T.seeded(spark, sf_dir).select("doc_id", "source", "content"), "doc_id")
    start = F.instr("content", F.col("value")) - 1
    return f.select("doc_id", "rule", "value", "source", "content", start.cast("long").alias("start"), (start + F.length("value")).cast("long").alias("end"))


def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _located(spark, sf_dir)
    got = V.redact_spans(T.seeded(spark, sf_dir), f.select("doc_id", "start", "end"))
    return got.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"))


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping stretches of each user's activity (two hours from each event) as one."""
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("start"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + 7200).alias("end"))
    return V.merge_spans(e).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"))


def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.struct(F.lit("abcdef").alias("value"), F.lit(0).alias("start"), F.lit(6).alias("end")), F.struct(F.lit("cde").alias("value"), (d % 12).cast("int").alias("start"), (d % 12 + 3).cast("int").alias("end")))).alias("s")).select("doc_id", "s.*")
    return V.overlapped(docs)


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    p = F.when(d % 5 == 0, F.concat(F.lit("/home/u/SRC/x/src/"), d.cast("string"), F.lit(".js"))).when(d % 5 == 1, F.concat(F.lit("C:\\w\\f"), d.cast("string"))).when(d % 5 == 2, F.concat(F.lit("https://u:p@H.example.org:8080/a?x="), d.cast("string"))).when(d % 5 == 3, "").otherwise(F.concat(F.lit("//plain/"), d.cast("string")))
    return T.table(spark, sf_dir, "documents").select("doc_id", V.relative_path(p).alias("path"))


def _paths():
    d = F.col("doc_id")
    return F.element_at(F.array(*map(F.lit, ("a/tests/x.py", "docs/guide.txt", "README.md", "web/app.min.js", "vendor/x.js", "conf/.env.local", "conf/app.yaml", "src/main.go"))), (d % 8 + 1).cast("int"))


def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").groupBy(V.file_role(_paths()).alias("role")).agg(F.count("*").alias("n"))


def semantic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.semantic(_located(spark, sf_dir).withColumn("path", _paths()))
    return f.select("doc_id", "rule", "assignment", "variable_role", "file_role", F.array_join("usage_categories", ",").alias("usage"), F.col("references").cast("int").alias("references"), "format_check")


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _located(spark, sf_dir)
    red = V.redact_spans(T.seeded(spark, sf_dir), f.select("doc_id", "start", "end"))
    both = f.select("doc_id", "rule", X.line_of(F.col("content"), F.col("value")).alias("line")).join(red, "doc_id")
    return V.contexts(both, before=3, after=3, budget=600)


QUERIES = (redact_lines, span_merge, overlap_filter, relative_paths, file_roles, semantic_evidence, code_context)

_PATH = "(['a/tests/x.py', 'docs/guide.txt', 'README.md', 'web/app.min.js', 'vendor/x.js', 'conf/.env.local', 'conf/app.yaml', 'src/main.go'])[doc_id % 8 + 1]"
_ROLE = "(['test', 'documentation', 'documentation', 'generated', 'generated', 'configuration', 'configuration', 'application'])[doc_id % 8 + 1]"
SQL = {
    "redact_lines": WITH + "select doc_id, sha256(case when value is null then content else replace(content, value, '[REDACTED]') end) as redacted_sha256 from seeded left join f using (doc_id)",
    "span_merge": "with e as (select user_id as doc_id, cast(floor(epoch(ts)) as bigint) as s from events), m as (select *, max(s + 7200) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) as r from e), i as (select *, sum(case when r is null or s > r then 1 else 0 end) over (partition by doc_id order by s rows unbounded preceding) as g from m), b as (select doc_id, g, max(s) + 7200 - min(s) as c from i group by 1, 2) select doc_id, count(*) as n, cast(sum(c) as bigint) as covered from b group by 1",
    "overlap_filter": "select doc_id, 'abcdef' as value, 0 as start, 6 as \"end\" from documents union all select doc_id, 'cde', cast(doc_id % 12 as integer), cast(doc_id % 12 + 3 as integer) from documents where doc_id % 12 >= 6",
    "relative_paths": "select doc_id, case doc_id % 5 when 0 then 'src/' || doc_id || '.js' when 1 then 'w/f' || doc_id when 2 then 'https://h.example.org:8080/a' when 3 then 'unknown' else 'plain/' || doc_id end as path from documents",
    "file_roles": f"select {_ROLE} as role, count(*) as n from documents group by 1",
    "semantic_evidence": WITH + f""", v as (select doc_id, rule, {_ROLE} as file_role, case when doc_id % 14 in (0, 1, 2, 10) then 'literal_assignment' else 'literal_without_assignment' end as assignment, case doc_id % 14 when 10 then 'credential' when 0 then 'other' when 1 then 'other' when 2 then 'other' else 'unknown' end as variable_role from f)
        select doc_id, rule, assignment, variable_role, file_role, case when file_role = 'documentation' then 'comment_or_documentation' when rule = 'mongodb_uri' then 'credential_in_connection_uri' else '' end as usage, case assignment when 'literal_assignment' then 2 else 1 end as "references", case when rule = 'generic_api_key' then 'generic_assignment_pattern' when rule = 'mongodb_uri' then 'parsed_connection_uri' else 'detector_pattern_match' end as format_check from v""",
}
