"""Queries over URLs, pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import extract as E
from ..functions.scan import SCRIPT_PLACES
from ..operators import frontier
from ..sources import tables as T
from .detection import q


def url():
    return F.col("url")


def _pages(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "pages")


def page_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.web_pages(spark, sf_dir).select("id", "locator", "size", "content_hash", "content_type")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.scheme(url()).alias("scheme"), U.host(url()).alias("host"), U.path(url()).alias("path"), U.query(url()).alias("query"), U.fragment(url()).alias("fragment"))


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.upper(U.scheme(url())), F.lit("://"), F.upper(U.authority(url())), F.lit(":"), F.when(U.scheme(url()) == "https", "443").otherwise("80"), F.lit("/a/./b/.."), U.path(url()), F.when(U.query(url()) != "", F.concat(F.lit("?"), U.query(url()))).otherwise(""), F.lit("#x"))
    return _pages(spark, sf_dir).select("page_id", U.normalize(url()).alias("plain"), U.normalize(messy).alias("messy"))


def url_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("page_id") % 4 == 1, F.concat(url(), F.repeat(F.lit("x"), 2100))).when(F.col("page_id") % 4 == 2, F.replace(url(), F.lit("http"), F.lit("gopher"))).when(F.col("page_id") % 4 == 3, F.replace(url(), F.lit("example"), F.lit("-exa_mple"))).otherwise(url())
    return _pages(spark, sf_dir).select("page_id", F.array_join(U.valid(bad), ",").alias("errors"))


def url_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(U.scheme(url()).alias("scheme"), U.bare_domain(U.authority(url())).alias("domain")).agg(F.count("*").alias("n"), F.count_if(U.query(url()) != "").alias("with_query"), F.count_if(U.fragment(url()) != "").alias("with_fragment"))


def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.canonical_asset(url()).alias("asset_url"), F.sha2(U.canonical_asset(url()), 256).alias("asset_id"))


def js_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    js = F.concat(F.lit("https://CDN.shopify.com./v2/assets/app-"), F.left(F.sha2(F.col("page_id").cast("string"), 256), F.lit(10)), F.lit(".js?t=1&module=a&x="), F.col("page_id").cast("string"))
    return _pages(spark, sf_dir).select("page_id", U.js_identity(js).alias("identity"))


def _variants():
    """URLs as they stand in scripts: without a scheme, with a host for a folder, relative, of other kinds."""
    u = url()
    rest = F.regexp_replace(u, "^https?:", "")
    forms = (u, rest, F.concat(F.lit("/cdn."), F.regexp_extract(u, r"^https?://([^/?#]+)", 1), F.lit("/lib/x")), F.lit("/main.js"), F.lit("app.a1b2c3.js"), F.lit("data:text/plain,x"), F.lit("javascript:void(0)"), F.lit("tel:1"), F.lit(""),
             F.concat(F.lit("files/v"), F.col("page_id").cast("string"), F.lit(".tar.gz")), F.lit("static.one.two/y"), F.lit("a.b.qzqz/z"), F.lit("page.html"))
    return F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))


def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of URL each is, and its spelling, against the page's own."""
    got = U.classified(_pages(spark, sf_dir).select("page_id", F.regexp_extract(url(), r"^(https?://[^/?#]+)", 1).alias("base"), F.when(_variants() == url(), F.regexp_replace(url(), r"[?#].*$", "")).otherwise(_variants()).alias("url")), "url", "base")
    return got.select("page_id", "class", "normalized")


def target_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users give as targets: hosts, URLs with ports, and things that are none."""
    u = url()
    host = F.regexp_extract(u, r"^https?://([^/?#]+)", 1)
    forms = (F.concat(u, F.lit("#part")), host, F.concat(F.lit("ftp://"), host), F.concat(F.lit("https://me@"), host), F.concat(host, F.lit("/a b")), F.concat(host, F.lit(":8443")), F.concat(host, F.lit(":99999")), F.concat(F.lit("-"), host), F.lit(""))
    return U.targets(_pages(spark, sf_dir).select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int")).alias("given")), "page_id", "given")


def script_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that generated bundles name in the forms of loaders and frameworks."""
    p = F.col("page_id").cast("string")
    js = F.concat(F.lit('import("./a'), p, F.lit('.js"); import x from "/lib/b.js?v=1"; loadScript("https://cdn.example.net/c.js"); e.src = "//cdn.example.net/d.js";\nchunkFilename: "e.chunk.js", lazy(() => import("./views/home"));\n__webpack_require__("./static/js/x"); var m = ["/_next/static/f.js", "/js/main.0a1b2c3d.js", "/assets/vendor'),
                  p, F.lit('.js", "no.css"];\n'), F.coalesce("html", F.lit("")))
    return E.script_references(_pages(spark, sf_dir).select("page_id", F.lit("https://app.example.com/js/main.js").alias("url"), js.alias("content")), "page_id", "content", "url")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.links(_pages(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"), F.min("target").alias("first_target"))


def script_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    return p.select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?i)<script"), F.lit(0))).cast("long").alias("n_scripts"), F.size(F.regexp_extract_all("html", F.lit(E.SRC), F.lit(1))).cast("long").alias("n_sources"),
                    F.size(F.regexp_extract_all("html", F.lit(E.PRELOAD), F.lit(1))).cast("long").alias("n_preloads"))


def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", U.in_scope(url(), F.lit("example.com")).alias("in_scope"), U.bare_domain(U.authority(url())).alias("domain"))


def _scripts(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    s = F.concat(F.lit('fetch("/api/v'), (d % 3).cast("string"), F.lit('/users/'), d.cast("string"), F.lit('");\nimport x from "./m'), (d % 7).cast("string"), F.lit('.js";\nconst baseURL: "https://svc.example.com/hook";\nnew Worker("/w.js");import "lodash";\n'), F.coalesce("text", F.lit("")))
    return T.table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("https://app.example.com/js/main.js").alias("url"), s.alias("content"))


def endpoint_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.endpoints(_scripts(spark, sf_dir), "doc_id", "content").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("endpoint")), " ").alias("endpoints"))


def endpoint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.endpoints(_scripts(spark, sf_dir), "doc_id", "content").withColumn("kind", U.classify_endpoint(F.col("endpoint")))
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(U.endpoint_confidence(F.col("endpoint"), F.lit("await fetch"))), 4).alias("avg_confidence"))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.modules(_scripts(spark, sf_dir)).groupBy("target").agg(F.count("*").alias("n"))


def asset_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see https://a.example.com/x/"), d.cast("string"), F.lit(", http://u:p@b.example.com/ and https://c.example.com:8443/ (https://d.example.com/"), F.repeat(F.lit("k"), 45), F.lit(") https://e.example.com)")).alias("text"))
    return E.references(docs, "doc_id", "text")


def host_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.content_hosts(_pages(spark, sf_dir).select(F.concat_ws(" ", "url", "html").alias("t")), "t", "example.com")


def certificate_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select(F.concat(F.lit("*.h"), (F.col("page_id") % 20).cast("string"), F.lit(".example.com\nH"), (F.col("page_id") % 5).cast("string"), F.lit(".EXAMPLE.com\nother.org")).alias("names"))
    return E.certificate_hosts(p, "names", "example.com")


# First labels that hosts often have, and those that often stand for another name.
PREFIXES = ("api", "www", "app", "dev", "test", "staging", "prod", "demo", "admin", "dashboard", "console", "portal", "login", "auth", "account", "billing", "payments", "shop", "store", "cdn", "static", "assets", "media", "uploads",
            "downloads", "images", "img", "video", "stream", "development", "sandbox", "playground", "experiment", "docs", "help", "support", "status", "monitor", "mail", "email", "smtp", "imap", "pop", "m", "mobile", "mobil", "wap",
            "us", "uk", "eu", "asia", "apac", "emea", "origin", "edge", "gateway", "proxy", "vpn")
ALIASES = ("assets", "cdn", "static", "media", "uploads", "downloads", "images", "img", "video")


def candidate_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty common prefixes and the alias names for every domain, kept where a table of names resolves them, with how they were
    thought of."""
    tried = spark.createDataFrame([(x, "common_prefix") for x in PREFIXES[:50]] + [(x, "cname") for x in ALIASES], "prefix string, source string")
    hosts = _pages(spark, sf_dir).select(U.host(url()).alias("host")).distinct()
    domains = hosts.select(F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("domain")).distinct()
    thought = domains.crossJoin(F.broadcast(tried)).select(F.concat_ws(".", "prefix", "domain").alias("host"), "source")  # 59 rows
    return thought.join(hosts, "host", "left_semi")


def two_pass_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found from the first one, then from the first five of those."""
    edges = _edges(spark, sf_dir).withColumn("confidence", F.round(F.col("dst") % 10 / 10.0, 1))
    more = edges.select("dst", ((F.col("dst") + 1) % 97).alias("more"), "confidence").select(F.col("dst").alias("src"), F.col("more").alias("dst"), "confidence")
    return frontier.two_passes(spark.createDataFrame([(0,)], "node long"), edges.unionByName(more))


def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that say the same up to blank lines and margins, by hash."""
    h = X.normalized_content(F.coalesce("text", F.lit("")))
    return T.table(spark, sf_dir, "documents").groupBy(h.alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def challenge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(E.challenge(F.col("html"))).alias("challenged"), F.count_if(E.js_like(F.col("html"))).alias("script_like"))


def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat_ws(".", *((F.col("page_id") * k % 256).cast("string") for k in (7, 3, 11, 5)))
    return _pages(spark, sf_dir).select("page_id", U.public_ipv4(ip).alias("is_public"))


def _edges(spark, sf_dir) -> DataFrame:
    p, n = F.col("page_id"), _pages(spark, sf_dir).count()
    return _pages(spark, sf_dir).select(p.alias("src"), F.explode(F.array((p * 7 + 1) % n, (p * 3 + 2) % n)).alias("dst"))


def bfs_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.closure(spark.createDataFrame([(0,)], "node long"), _edges(spark, sf_dir), 6)


def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs_frontier(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


def frontier_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir)
    c = p.select(U.html_root(url()).alias("url"), (F.col("page_id") % 6).cast("int").alias("depth"), U.in_scope(url(), F.lit("example.com")).alias("in_scope"), U.is_js(url()).alias("is_js"))
    seen = p.where("page_id % 10 = 0").select(U.html_root(url()).alias("url"))
    return frontier.admit(c, seen, 3)


QUERIES = (page_artifacts, url_parts, url_normalize, url_validate, url_metrics, asset_ids, js_identity, page_links, script_inventory, script_references, url_classes, target_contract, scope_filter, endpoint_extract, endpoint_classes, module_edges, asset_references,
           host_discovery, certificate_hosts, candidate_hosts, content_identity, challenge_pages, public_addresses, bfs_frontier, depth_histogram, frontier_admission, two_pass_discovery)

# ---- the same in SQL -----------------------------------------------------------------------------------------------

_P = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
PARTS = f"""with p as (select *, lower(regexp_extract(url, {_P}, 1)) as scheme, regexp_extract(url, {_P}, 2) as auth, regexp_extract(url, {_P}, 3) as path, regexp_extract(url, {_P}, 4) as query, regexp_extract(url, {_P}, 5) as frag from pages),
x as (select *, lower(regexp_extract(auth, '^(?:[^@]*@)?([^:]*)', 1)) as host, case when query <> '' then '?' || query else '' end as qs, case when path = '' then '/' else path end as path1 from p) """
_BARE = r"regexp_replace(regexp_extract(lower(auth), '^([^:]*)', 1), '^www\.', '')"
_SCRIPT = """with s as (select doc_id, 'fetch("/api/v' || (doc_id % 3) || '/users/' || doc_id || '");' || chr(10) || 'import x from "./m' || (doc_id % 7) || '.js";' || chr(10) || 'const baseURL: "https://svc.example.com/hook";' || chr(10) || 'new Worker("/w.js");import "lodash";' || chr(10) || coalesce(text, '') as content from documents) """
_all = lambda v, ps: "flatten([" + ", ".join(f"regexp_extract_all({v}, {q(p)}, 1)" for p in ps) + "])"
_LINES = "list_filter(string_split(content, chr(10)), lambda x: " + " or ".join(f"contains(lower(x), '{h}')" for h in E.HINTS) + ")"
_EXTRACT = f"list_distinct(list_filter(list_transform(list_concat({_all('content', (E.LITERAL, *E.ENDPOINTS, *E.LONG_ENDPOINTS, *E.COMPLEX))}, flatten(list_transform({_LINES}, lambda x: {_all('x', E.LONG_ENDPOINTS)}))), lambda x: replace(trim(x), '\\/', '/')), lambda x: x <> ''))"


def _kind_sql(v: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains(lower({v}), {q(w)})" for w in ws) + f" then {q(k)}" for k, ws in U.CLASSES) + " else 'general_endpoint' end"


_CONF = "least(1.0, 0.5 + " + " + ".join(f"case when {' or '.join(f'contains(lower({t}), {q(w)})' for w in ws)} then {b} else 0 end" for t, bs in (("endpoint", U.URL_BOOSTS), ("'await fetch'", U.CONTEXT_BOOSTS)) for b, ws in bs) + ")"
_BFS = """with recursive n as (select count(*) as n from pages), e as (select page_id as src, unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n]) as dst from pages, n),
r as (select 0::bigint as node, 0 as depth union select dst, depth + 1 from r join e on src = node where depth < 6), b as (select node, min(depth) as depth from r group by 1) """
_IN_SCOPE = f"scheme in ('http', 'https') and {_BARE} <> '' and ({_BARE} = 'example.com' or ends_with({_BARE}, '.example.com') or ({_BARE} in ({', '.join(map(q, U.CDN))}) and regexp_matches(lower(path), '\\.(?:js|mjs|cjs)$')))"
_ROOT = "scheme || '://' || lower(auth) || path || qs"

_VARIANTS_SQL = """(['' || regexp_replace(url, '[?#].*$', ''), regexp_replace(url, '^https?:', ''), '/cdn.' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/lib/x', '/main.js', 'app.a1b2c3.js', 'data:text/plain,x', 'javascript:void(0)', 'tel:1', '', 'files/v' || page_id || '.tar.gz', 'static.one.two/y', 'a.b.qzqz/z', 'page.html'])[page_id % 13 + 1]"""
_PLAUSIBLE = (f"regexp_extract(lower(e), '([^.]*)$', 1) not in ({', '.join(map(q, U.FILE_ENDINGS))}) and (" + " or ".join(f"regexp_matches(lower(e), {q(p)})" for p in U.NETWORKS)
              + f" or regexp_extract(lower(e), '([^.]*)$', 1) in ({', '.join(map(q, U.TLDS))}) or regexp_matches(lower(e), '\\.[a-z]{{2}}$') or regexp_matches(e, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') or regexp_matches(lower(e), '\\..*\\.[a-z]{{2,}}$'))")
_GIVEN_SQL = """([url || '#part', h.h, 'ftp://' || h.h, 'https://me@' || h.h, h.h || '/a b', h.h || ':8443', h.h || ':99999', '-' || h.h, ''])[page_id % 9 + 1]""".replace("h.h", "regexp_extract(url, '^https?://([^/?#]+)', 1)")
_BUNDLE_SQL = """'import("./a' || page_id || '.js"); import x from "/lib/b.js?v=1"; loadScript("https://cdn.example.net/c.js"); e.src = "//cdn.example.net/d.js";' || chr(10) || 'chunkFilename: "e.chunk.js", lazy(() => import("./views/home"));' || chr(10) || '__webpack_require__("./static/js/x"); var m = ["/_next/static/f.js", "/js/main.0a1b2c3d.js", "/assets/vendor' || page_id || '.js", "no.css"];' || chr(10) || coalesce(html, '')"""

SQL = {
    "page_artifacts": PARTS + "select sha256(url) as id, url as locator, cast(octet_length(encode(coalesce(html, ''))) as bigint) as size, sha256(coalesce(html, '')) as content_hash, 'text/html' as content_type from x where scheme in ('http', 'https') and not contains(auth, '@')",
    "url_parts": PARTS + "select page_id, scheme, host, path, query, frag as fragment from x",
    "url_normalize": PARTS + "select page_id, scheme || '://' || host || path1 || qs as plain, scheme || '://' || host || '/a' || path || qs as messy from x",
    "url_validate": "select page_id, case page_id % 4 when 1 then 'length' when 2 then 'scheme' when 3 then 'host' else '' end as errors from pages",
    "url_metrics": PARTS + f"select scheme, {_BARE} as domain, count(*) as n, count(*) filter (query <> '') as with_query, count(*) filter (frag <> '') as with_fragment from x group by all",
    "asset_ids": PARTS + "select page_id, scheme || '://' || host || path1 || qs as asset_url, sha256(scheme || '://' || host || path1 || qs) as asset_id from x",
    "js_identity": "select page_id, 'js::cdn.shopify.com::/assets/app' || case when regexp_matches(left(sha256(cast(page_id as varchar)), 10), '^[a-f0-9]{8,}$') then '' end || '.js::module=a&x=' || page_id as identity from pages",
    "page_links": PARTS + f""", l as (select page_id, x.*, unnest(regexp_extract_all(html, {q(E.HREF)}, 1)) as ref from x), t as (select page_id, case when starts_with(ref, '/') then scheme || '://' || host || ref else ref end as target from l where ref <> '')
        select page_id, count(*) as n_links, count(distinct target) as n_targets, min(target) as first_target from t group by 1""",
    "script_inventory": f"select page_id, len(regexp_extract_all(html, '(?i)<script')) as n_scripts, len(regexp_extract_all(html, {q(E.SRC)}, 1)) as n_sources, len(regexp_extract_all(html, {q(E.PRELOAD)}, 1)) as n_preloads from pages",
    "scope_filter": PARTS + f"select page_id, {_IN_SCOPE} as in_scope, {_BARE} as domain from x",
    "endpoint_extract": _SCRIPT + f"select doc_id, count(*) as n, array_to_string(list_sort(list(endpoint)), ' ') as endpoints from (select doc_id, unnest({_EXTRACT}) as endpoint from s) group by 1",
    "endpoint_classes": _SCRIPT + f"select {_kind_sql('endpoint')} as kind, count(*) as n, round(avg({_CONF}), 4) as avg_confidence from (select doc_id, unnest({_EXTRACT}) as endpoint from s) group by 1",
    "module_edges": _SCRIPT + f", r as (select unnest(list_distinct({_all('content', [p.replace('{1,2048}', '+') for p in E.MODULES])})) as ref from s) select case when starts_with(ref, 'http') then ref when starts_with(ref, '/') then 'https://app.example.com' || ref else 'https://app.example.com/js/' || replace(ref, './', '') end as target, count(*) as n from r where regexp_matches(ref, '^(?:\\.{{1,2}}/|/|https?://)') group by 1",
    "url_classes": f"""with i as (select page_id, {_VARIANTS_SQL} as u, regexp_extract(url, '^(https?)://([^/?#]+)', 2) as h, url from pages), g as (select *, regexp_extract(u, {q(U.EMBEDDED)}, 1) as e, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as sc from i),
        k as (select *, case when u = '' then 'empty' {' '.join(f"when sc = '{n}' then '{c}'" for n, c in U.OTHER_SCHEMES.items())} when starts_with(u, '//') then 'protocol_relative' when regexp_matches(u, '^(?:https?|ftps?)://') then 'absolute'
            when e <> '' and {_PLAUSIBLE} then 'embedded_host' else 'relative' end as class from g)
        select page_id, class, case class when 'protocol_relative' then 'https:' || regexp_replace(u, '#.*$', '') when 'absolute' then u when 'embedded_host' then 'https://' || ltrim(u, '/') when 'relative' then regexp_extract(url, '^(https?://[^/?#]+)', 1) || case when starts_with(u, '/') then u else '/' || u end end as normalized from k""",
    "target_contract": f"""with i as (select page_id, {_GIVEN_SQL} as t from pages), f as (select *, case when contains(t, '://') then t else 'https://' || t end as w from i), a as (select *, lower(regexp_extract(w, '^([^:]+)://', 1)) as sc, regexp_extract(w, '://([^/?#]*)', 1) as au, regexp_extract(w, '://[^/?#]*([^?#]*)', 1) as pa, regexp_extract(w, '\\?([^#]*)', 1) as qu from f),
        h as (select *, lower(regexp_extract(au, '^([^:]*)', 1)) as ho, regexp_extract(au, ':([0-9]+)$', 1) as po from a),
        p as (select *, case when t = '' then 'length' when regexp_matches(t, '[\\x00-\\x20\\x7f\\\\]') then 'characters' when po <> '' and cast(po as integer) > 65535 then 'host' when sc not in ('http', 'https') then 'scheme' when contains(au, '@') then 'user'
            when not regexp_full_match(ho, '[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)*') then 'host' end as problem from h)
        select page_id, case when problem is null then sc || '://' || ho || case when po <> '' then ':' || po else '' end || case when pa = '' then '/' else pa end || case when qu <> '' then '?' || qu else '' end end as target, problem from p""",
    "script_references": f"""with s as (select page_id, {_BUNDLE_SQL} as content from pages), r as (select page_id, unnest({_all('content', [f'(?i){p}' for p in E.SCRIPT_FILES])}) as ref from s),
        t as (select page_id, case when regexp_matches(ref, '^https?://') then ref when starts_with(ref, '//') then 'https:' || ref when starts_with(ref, '/') then 'https://app.example.com' || ref else 'https://app.example.com/js/' || replace(ref, './', '') end as target from r where length(ref) >= 3)
        select distinct page_id, target from t where regexp_matches(lower(regexp_extract(target, '^https?://[^/?#]*([^?#]*)', 1)), '\\.(?:js|mjs|cjs)$') or {' or '.join(f"contains(lower(target), '{w}')" for w in SCRIPT_PLACES)}""",
    "asset_references": "select doc_id, unnest(['https://a.example.com/x/' || doc_id, 'https://e.example.com/']) as locator from documents",
    "host_discovery": f"select host, count(*) as n from (select page_id, unnest(list_distinct(list_transform({_all("concat_ws(' ', url, html)", [f'(?i){p}' for p in E.HOST_FORMS])}, lambda h: lower(h)))) as host from pages) where host = 'example.com' or ends_with(host, '.example.com') group by 1",
    "certificate_hosts": "select host, 0.85::double as confidence from (select 'h' || (page_id % 20) || '.example.com' as host from pages union select 'h' || (page_id % 5) || '.example.com' from pages)",
    "candidate_hosts": PARTS + r"select distinct a.host, t.source from x a join (select distinct regexp_extract(host, '^[^.]+\.(.+)$', 1) as domain from x) d on ends_with(a.host, '.' || d.domain) join (values " + ", ".join(f"('{p}', '{k}')" for k, ps in (("common_prefix", PREFIXES[:50]), ("cname", ALIASES)) for p in ps) + ") t(prefix, source) on a.host = t.prefix || '.' || d.domain",
    "two_pass_discovery": """with n as (select count(*) as n from pages), e0 as (select page_id as src, unnest([(page_id * 7 + 1) % n, (page_id * 3 + 2) % n]) as dst from pages, n), e1 as (select *, round(dst % 10 / 10.0, 1)::double as c from e0),
        e as (select * from e1 union all select dst, (dst + 1) % 97, c from e1), a as (select dst as node, max(c) as c from e where src = 0 group by 1), f as (select node from a order by c desc, node limit 5),
        b as (select dst as node, max(c) as c from e where src in (select node from f) group by 1) select node, max(c) as confidence from (select * from a union all select * from b) group by 1""",
    "content_identity": r"select sha256(array_to_string(list_filter(list_transform(string_split(replace(trim(coalesce(text, '')), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) as content_hash, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1",
    "challenge_pages": "select count(*) as n, count(*) filter (contains(h, 'cf-chl-') or contains(h, 'g-recaptcha') or contains(h, 'type=\"password\"') or contains(h, 'type=''password''')) as challenged, count(*) filter (not regexp_matches(lower(ltrim(html)), '^<(?:!doctype|html)') and " + " + ".join(f"contains(html, '{w}')::int" for w in ("function", "var ", "let ", "const ", "=>", "return", "import ", "export ")) + " >= 2) as script_like from (select html, lower(substr(html, 1, 65536)) as h from pages)",
    "public_addresses": "select page_id, not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and ((b = 0 and c in (0, 2)) or b = 168)) or (a = 198 and (b in (18, 19) or (b = 51 and c = 100))) or (a = 203 and b = 0 and c = 113)) as is_public from (select page_id, page_id * 7 % 256 as a, page_id * 3 % 256 as b, page_id * 11 % 256 as c from pages)",
    "bfs_frontier": _BFS + "select * from b",
    "depth_histogram": _BFS + "select depth, count(*) as n from b group by 1",
    "frontier_admission": PARTS + f", c as (select {_ROOT} as url, cast(page_id % 6 as integer) as depth, {_IN_SCOPE} as s, page_id from x) select url, min(depth) as depth from c where s and depth <= 3 and url not in (select url from c where page_id % 10 = 0) group by 1 order by 2, 1 limit 20000",
}
