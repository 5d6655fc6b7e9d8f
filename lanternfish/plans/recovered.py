"""Queries over what archives hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery as V
from ..sources import tables as T


def header_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id").cast("string")
    h = T.table(spark, sf_dir, "pages").select(F.concat(F.lit("default-src 'self' https://a"), F.right(p, F.lit(1)), F.lit(".example.com *.cdn.example.com other.org")).alias("csp"), F.concat(F.lit("https://b"), F.right(p, F.lit(1)), F.lit(".example.com/x")).alias("location"), F.lit("*").alias("origin"))
    return V.header_hosts(h, "example.com")


def script_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and values of strings built from literals, and source-map references, of generated scripts."""
    p = F.col("page_id").cast("string")
    js = F.concat(F.lit('// var no = "x" + "y";\nvar a = "k" + "'), p, F.lit('";\nlet s = \'sourceMappingURL=no\';\n//# sourceMappingURL=m'), p, F.lit(".map\n"))
    got = V.scripts(T.table(spark, sf_dir, "pages").select("page_id", js.alias("js")), "page_id", "js")
    return got.select("page_id", "map_url", F.get("strings", F.lit(0))["value"].alias("value"), F.get("strings", F.lit(0))["line"].alias("line"), F.size("strings").cast("long").alias("n"))


QUERIES = (header_hosts, script_strings)
SQL = {
    "header_hosts": "select distinct 'a' || (page_id % 10) || '.example.com' as host, 'csp' as source, 0.8::double as confidence from pages union select 'cdn.example.com', 'csp', 0.8::double union select distinct 'b' || (page_id % 10) || '.example.com', 'location', 0.9::double from pages",
    "script_strings": "select page_id, 'm' || page_id || '.map' as map_url, 'k' || page_id as value, 2 as line, 1::bigint as n from pages",
}
