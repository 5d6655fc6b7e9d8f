"""Tables as artifacts: a text with its identity, kind and hash. Seeded carriers plant synthetic credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(df: DataFrame, locator, text, source_type: str, content_type: str = "text/plain") -> DataFrame:
    """(id, source_type, locator, content_type, language, size, content_hash, content); size and hash are of the UTF-8 text."""
    body = F.coalesce(text, F.lit(""))
    language = F.col("lang") if "lang" in df.columns else F.lit("")
    return df.select(F.sha2(locator, 256).alias("id"), F.lit(source_type).alias("source_type"), locator.alias("locator"), F.lit(content_type).alias("content_type"), language.alias("language"),
                     F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("content_hash"), body.alias("content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return artifacts(df, F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), "documents")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an http(s) URL that names no user."""
    from ..functions import urls as U

    df = table(spark, sf_dir, "pages").where(U.scheme(F.col("url")).isin("http", "https") & ~F.contains(U.authority(F.col("url")), F.lit("@")))
    return artifacts(df, F.col("url"), F.col("html"), "web", "text/html")


#: Carriers by doc_id mod 14: what stands before and after the generated body, its length, whether upper case.
CARRIERS = (
    ('const t = "gh' + 'p_', '";', 36, False), ('key: "AK' + 'IA', '",', 16, True), ("npm = np" + "m_", "\n", 36, False), ("'h" + "f_", "'", 34, False), ('"glp' + 'at-', '"', 20, False),
    ('"AI' + 'za', '"', 35, False), ("'ke" + "y-", "'", 32, False), ('"sk_li' + 've_', '"', 24, False), ('"sk_te' + 'st_', '"', 24, False), ('"S' + 'K', '"', 32, False),
    ('api_key = "', '"', 40, False), ("mong" + "odb://user:", "@db.example.org/app ", 20, False), ('"gh' + 'p_' + "x" * 36, '"', 0, False), ('"gh' + 'p_', '"', 40, False),
)


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, content): documents with one synthetic credential, or look-alike, on a first line of its own."""
    n, d = len(CARRIERS), F.col("doc_id")
    digest = F.sha2(d.cast("string"), 256)
    line = F.lit("")
    for k, (before, after, length, upper) in enumerate(CARRIERS):
        body = F.left(digest, F.lit(length))
        line = F.when(d % n == k, F.concat(F.lit(before), F.upper(body) if upper else body, F.lit(after))).otherwise(line)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(line, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("content"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seeded_sql() -> str:
    cases = " ".join(
        f"when {k} then {_quoted(b.strip(chr(10)))} || {'upper' if u else ''}(left(sha256(cast(doc_id as varchar)), {n})) || {_quoted(a) if a != chr(10) else 'chr(10)'}" for k, (b, a, n, u) in enumerate(CARRIERS))
    return f"select doc_id, lang, source, (case doc_id % {len(CARRIERS)} {cases} end) || chr(10) || coalesce(text, '') as content from documents"
