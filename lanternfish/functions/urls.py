"""Expressions over URLs. Parts come from one expression, so malformed URLs give nulls, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import either

#: scheme, authority, path, query, fragment (the generic syntax of RFC 3986).
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# Fixed values.
CDN = ("static.cdninstagram.com", "static.xx.fbcdn.net", "connect.facebook.net", "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "cdn.skypack.dev", "esm.sh", "cdn.esm.sh", "cdn.polyfill.io",
       "googletagmanager.com", "google-analytics.com", "ajax.googleapis.com", "apis.google.com", "fonts.googleapis.com", "fonts.gstatic.com", "www.gstatic.com", "gstatic.com", "code.jquery.com",
       "stackpath.bootstrapcdn.com", "maxcdn.bootstrapcdn.com", "netdna.bootstrapcdn.com", "ajax.aspnetcdn.com", "js.stripe.com", "www.paypalobjects.com", "platform.twitter.com", "platform.linkedin.com")
#: Schemes that are left alone, by class; last labels that are of hosts, and that are of files; hosts of known networks.
OTHER_SCHEMES = {"data": "data_url", "blob": "blob_url", "javascript": "javascript_url", "mailto": "mailto_url", "file": "file_url", "about": "about_url",
                 **dict.fromkeys(("tel", "sms", "geo", "whatsapp", "skype", "facetime"), "unknown_scheme")}
TLDS = ("com", "net", "org", "info", "biz", "xyz", "online", "site", "website", "tech", "io", "ai", "app", "dev", "cloud", "store", "shop", "blog", "news", "media", "group", "agency", "center", "company", "digital", "global", "guru",
        "host", "network", "pro", "services", "edu", "gov", "mil", "int", "eu", "asia", "cat", "coop", "jobs", "mobi", "museum", "name", "post", "tel", "travel", "aero")
FILE_ENDINGS = ("js", "mjs", "cjs", "jsx", "ts", "tsx", "css", "scss", "sass", "less", "html", "htm", "xml", "json", "map", "txt", "md", "yml", "yaml", "csv", "env", "lock", "webmanifest", "wasm", "png", "jpg", "jpeg", "gif", "svg", "webp",
                "ico", "bmp", "avif", "woff", "woff2", "ttf", "eot", "otf", "mp4", "webm", "mp3", "wav", "ogg", "avi", "mov", "pdf", "doc", "docx", "xls", "xlsx", "zip", "gz", "tar", "py", "php", "rb", "go", "java", "c", "cpp", "sh")
NETWORKS = (r"^.*\.(?:cdn|cloudfront|akamaihd|akamaiedge|edgekey)\.(?:net|com)$", r"^.*\.(?:cloudflare|fastly|cdn77|bunnycdn|stackpath)\.(?:com|net)$", r"^.*\.(?:googleapis|gstatic|googleusercontent|ggpht)\.com$",
            r"^.*\.(?:amazonaws|s3)\.(?:com|eu|ap|sa|ca|us|uk)$", r"^.*\.(?:azureedge|blob\.core\.windows\.net|azure\.net)$", r"^.*\.(?:fbcdn|facebook|fb)\.(?:net|com)$", r"^.*\.(?:twimg|twitter|t\.co)\.com$",
            r"^.*\.(?:instagram|cdninstagram)\.com$", r"^.*\.(?:linkedin|licdn)\.com$", r"^.*\.(?:youtube|ytimg|googlevideo)\.com$", r"^.*\.(?:vimeo|vimeocdn)\.com$", r"^.*\.(?:github|githubusercontent)\.com$",
            r"^.*\.(?:cloudinary|imgix|imageshack|imgur)\.(?:com|net)$", r"^(?:assets?|static|cdn|media|images?|img|js|css|fonts?|scripts?|bundles?)\.")
#: Mistyped schemes, a host at the front of a path, and what can be salvaged with https:// before it.
TYPOS = (("htttp://", "http://"), ("http//", "http://"), ("https//", "https://"))
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMBEDDED = rf"^/?({_LABEL}(?:\.{_LABEL})+)/?(.*)$"
SALVAGE = (r"(?i)^www\.[a-z0-9.-]+\.[a-z]{2,}(?:\.[a-z]{2,})?/.*$", r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(?:\.[a-z]{2,})?/.*$", r"(?i)^[a-z0-9.-]+\.[a-z]{2,}(?:\.[a-z]{2,})?$", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?(?:/.*)?$")
CACHE_PARAMS = ("v", "version", "ts", "t", "_", "cache", "cb", "rand", "random")
CLASSES = (
    ("api_endpoint", ("/api/", "api.", "v1/", "v2/", "v3/", "graphql")),
    ("auth_endpoint", ("auth", "login", "token", "oauth", "jwt", "session")),
    ("admin_endpoint", ("admin", "dashboard", "manage", "private", "internal")),
    ("static_resource", ("static", "assets", "images", "css", "js", ".png", ".jpg", ".svg", ".ico")),
    ("websocket", ("ws://", "wss://", "websocket")),
    ("webhook", ("webhook", "callback", "hook")),
)
#: Boosts of an endpoint's confidence: from the URL, from its surroundings.
URL_BOOSTS = ((0.3, ("/api/", "auth", "token", "secret", "admin")), (0.2, ("graphql", "rest", "v1", "v2", "v3")), (0.2, ("webhook", "callback", "websocket")))
CONTEXT_BOOSTS = ((0.1, ("fetch", "axios", "ajax", "xhr", "request")), (0.1, ("api", "endpoint", "url", "baseurl")), (0.2, ("secret", "token", "key", "password")))


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


scheme = lambda u: F.lower(part(u, 1))
authority = lambda u: part(u, 2)
path = lambda u: part(u, 3)
query = lambda u: part(u, 4)
fragment = lambda u: part(u, 5)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def contains_any(text: Column, words) -> Column:
    return either(F.contains(text, F.lit(w)) for w in words)


def classify_endpoint(url: Column) -> Column:
    low, out = F.lower(url), F.lit("general_endpoint")
    for name, words in reversed(CLASSES):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return out


def endpoint_confidence(url: Column, context: Column) -> Column:
    total = F.lit(0.5)
    for text, boosts in ((F.lower(url), URL_BOOSTS), (F.lower(context), CONTEXT_BOOSTS)):
        for weight, words in boosts:
            total = total + F.when(contains_any(text, words), weight).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def without_dot_segments(p: Column) -> Column:
    """The path with . and .. resolved; a trailing slash stays."""
    parts = F.split(p, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin(".", ""), acc).otherwise(F.concat(acc, F.array(s))))
    body = F.concat(F.lit("/"), F.array_join(kept, "/"))
    ends = p.rlike(r"(?:/|/\.|/\.\.)$") & (body != "/")
    resolved = F.when(ends, F.concat(body, F.lit("/"))).otherwise(body)
    return F.when(F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit("/.")) & ~F.contains(p, F.lit("//")), p).otherwise(resolved)


def tidy(url: Column) -> Column:
    """Escaped slashes, mistyped schemes, control characters, white space and doubled slashes put right; spaces are encoded. Each
    step uses the one before it once: expressions that repeat their argument would multiply."""
    u = F.regexp_replace(F.trim(url), r"\\+/", "/")
    for wrong, right in TYPOS:
        u = F.regexp_replace(u, "^" + wrong, right)
    u = F.regexp_replace(F.regexp_replace(u, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"\s+", "%20")
    return F.regexp_replace(F.regexp_replace(u, r"^(?i)(https?):/+([^/])", "$1://$2"), r"([^:/])/{2,}", "$1/")


#: The parts of a URL as a struct: one expression is run, however many parts are looked at.
PARTS = "struct<scheme:string,authority:string,path:string,query:string,asked:boolean,fragment:string>"


_CUT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#(.*))?$"


def _bound(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(url: Column) -> Column:
    """PARTS of a URL. Put it in a column of its own before its fields are used."""
    def fields(cut):
        get = lambda i: F.get(cut, F.lit(i))
        return F.struct(F.lower(get(0)).alias("scheme"), get(1).alias("authority"), get(2).alias("path"), F.substr(get(3), F.lit(2)).alias("query"), (get(3) != "").alias("asked"), get(4).alias("fragment"))

    return _bound(F.split(F.regexp_replace(url, _CUT, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001"), fields)


def joined_parts(base: Column, ref: Column) -> Column:
    """PARTS of a reference against an absolute base, both PARTS, as browsers resolve them."""
    folder = F.regexp_extract(F.when(base["path"] == "", F.lit("/")).otherwise(base["path"]), r"^(.*/)", 1)
    whole, other_host, rooted, same = ref["scheme"] != "", ref["authority"] != "", F.startswith(ref["path"], F.lit("/")), ref["path"] == ""
    path = F.when(whole | other_host | rooted, ref["path"]).when(same, base["path"]).otherwise(F.concat(folder, ref["path"]))
    query = F.when(~whole & ~other_host & same & ~ref["asked"], base["query"]).otherwise(ref["query"])
    return F.struct(F.when(whole, ref["scheme"]).otherwise(base["scheme"]).alias("scheme"), F.when(whole | other_host, ref["authority"]).otherwise(base["authority"]).alias("authority"), path.alias("path"), query.alias("query"), (query != "").alias("asked"), ref["fragment"].alias("fragment"))


def spelled(p: Column, keep_fragment: bool = False) -> Column:
    """PARTS in one spelling: lower-case scheme and host, no user, no default port, resolved path; null without scheme or host."""
    h, n = F.lower(F.regexp_extract(p["authority"], r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)), F.regexp_extract(p["authority"], r":([0-9]+)$", 1)
    default = F.when(p["scheme"] == "https", "443").when(p["scheme"] == "http", "80").when(p["scheme"] == "ftp", "21").otherwise("")
    tail = F.concat(F.when(n.isin("", default) | (n == default), "").otherwise(F.concat(F.lit(":"), n)), without_dot_segments(p["path"]), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    tail = F.concat(tail, F.when(p["fragment"] != "", F.concat(F.lit("#"), p["fragment"])).otherwise("")) if keep_fragment else tail
    return F.when((p["scheme"] != "") & (h != ""), F.concat(p["scheme"], F.lit("://"), h, tail))


def normalize(url: Column, keep_fragment: bool = False) -> Column:
    """Absolute URLs in one spelling (see `spelled`), after `tidy`."""
    return _bound(parts(tidy(url)), lambda p: spelled(p, keep_fragment))


def plausible_host(host: Column) -> Column:
    """Whether a dotted name is a host, not a file: its last label is of no file, and the name is in a known network or ends in a known or
    two-letter label, is an address, or has three labels of which the last is of letters."""
    h = F.lower(host)
    last = F.substring_index(h, ".", -1)
    address = h.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    named = h.rlike(rf"^{_LABEL}(?:\.{_LABEL})*$") & last.rlike("^[a-z]{2,}$") & h.rlike(r"\..*\.")
    return F.contains(h, F.lit(".")) & ~last.isin(*FILE_ENDINGS) & (either(h.rlike(p) for p in NETWORKS) | last.isin(*TLDS) | last.rlike("^[a-z]{2}$") | address | named)


def classified(urls: DataFrame, url: str = "url", base: str | None = None) -> DataFrame:
    """urls plus class and normalized (null where there is none): what kind of URL it is, and its one spelling. A host at the front of
    what looks like a path outranks resolution against the base. Validity has its say last: what fails `valid` is invalid."""
    told = urls.withColumn("_u", tidy(F.coalesce(F.col(url), F.lit("")))).withColumn("_p", parts(F.col("_u")))
    if base is None:
        told = told.withColumn("_b", F.lit(None).cast(PARTS))
    else:
        told = told.withColumn("_b", parts(normalize(F.col(base))))
    told = told.withColumns({"_h": F.regexp_extract("_u", EMBEDDED, 1), "_rest": F.regexp_extract("_u", EMBEDDED, 2)})
    u, host_in, rest = F.col("_u"), F.col("_h"), F.col("_rest")
    raw = F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(url), F.lit(""))), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    kind = F.when(u == "", "empty")
    for scheme_name, name in OTHER_SCHEMES.items():
        kind = kind.when(raw == scheme_name, name)
    kind = kind.when(F.startswith(u, F.lit("//")), "protocol_relative").when(u.rlike("^(?:https?|ftps?)://"), "absolute").when((host_in != "") & plausible_host(host_in), "embedded_host")
    kind = kind.when(F.col("_b.scheme").isNotNull(), "relative").when(either(u.rlike(p) for p in SALVAGE), "malformed_salvaged").otherwise("invalid")
    told = told.withColumn("class", kind)
    c = F.col("class")
    fixed = (F.when(c == "protocol_relative", F.concat(F.lit("https:"), u)).when(c == "absolute", u).when(c == "embedded_host", F.concat(F.lit("https://"), host_in, F.lit("/"), rest)).when(c == "malformed_salvaged", F.concat(F.lit("https://"), u)))
    told = told.withColumn("_f", parts(fixed)).withColumn("normalized", F.when(c == "relative", spelled(joined_parts(F.col("_b"), F.col("_p")))).otherwise(spelled(F.col("_f"))))
    bad = F.coalesce(F.size(valid(F.col("normalized"))) > 0, F.lit(True))
    plain = c.isin("empty", *OTHER_SCHEMES.values())
    return told.withColumns({"class": F.when(~plain & bad, "invalid").otherwise(c), "normalized": F.when(~plain & ~bad, F.col("normalized"))}).drop("_u", "_p", "_b", "_f", "_h", "_rest")


def resolve(base: Column, ref: Column) -> Column:
    """A reference against an absolute base, as browsers do for http URLs; other schemes stay as they are."""
    def body(both):
        p = joined_parts(both["b"], both["r"])
        return _bound(p, lambda x: F.concat(x["scheme"], F.lit("://"), x["authority"], without_dot_segments(x["path"]), F.when(x["asked"], F.concat(F.lit("?"), x["query"])).otherwise("")))
    return F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref).otherwise(_bound(F.struct(parts(base).alias("b"), parts(ref).alias("r")), body))


def valid(url: Column) -> Column:
    """Names of the checks that a URL fails: length, scheme, host, path."""
    h = host(url)
    labels = F.split(h, r"\.")
    good_host = (h != "") & h.rlike(r"^[a-z0-9.-]+$") & F.forall(labels, lambda x: F.length(x).between(1, 63) & ~F.startswith(x, F.lit("-")) & ~F.endswith(x, F.lit("-")))
    checks = [("length", F.length(url) <= 2048), ("scheme", scheme(url).isin("http", "https", "ws", "wss", "ftp", "ftps")), ("host", good_host), ("path", ~F.array_contains(F.split(path(url), "/"), ".."))]
    return F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks)), lambda x: x.isNotNull())


def is_js(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(?:js|mjs|cjs)$")


def display(url: Column) -> Column:
    p = F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), p, path(url))


def bare_domain(value: Column) -> Column:
    d = F.regexp_replace(value, r"^.*?://", "")
    d = F.lower(F.trim(F.regexp_extract(d, r"^([^/:]*)", 1)))
    return F.regexp_replace(d, r"^www\.", "")


def in_scope(url: Column, base: Column) -> Column:
    """The base domain and its subdomains; well-known CDNs for scripts alone."""
    d = bare_domain(authority(url))
    return scheme(url).isin("http", "https") & (d != "") & ((d == base) | F.endswith(d, F.concat(F.lit("."), base)) | (d.isin(*CDN) & is_js(url)))


def canonical_asset(url: Column) -> Column:
    default = F.when(scheme(url) == "https", "443").otherwise("80")
    p = F.when((port(url) != "") & (port(url) != default), F.concat(F.lit(":"), port(url))).otherwise("")
    q = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.concat(scheme(url), F.lit("://"), host(url), p, F.when(path(url) == "", "/").otherwise(path(url)), q)


def html_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))


def js_host(h: Column) -> Column:
    h = F.regexp_replace(F.lower(h), r"\.+$", "")
    return F.when(h.rlike(r"^static\.[a-z]{2}\.fbcdn\.net$"), "static.fbcdn.net").when(h.rlike(r"^(?:[a-z0-9]+-)?cdn\.shopify\.com$"), "cdn.shopify.com").otherwise(h)


def js_path(p: Column) -> Column:
    """Version segments, build hashes and doubled slashes go."""
    p = F.regexp_replace(p, r"(?i)/(?:v\d+(?:[._-]\d+)*|v[0-9a-z._-]{1,20})/", "/")
    p = F.regexp_replace(p, r"/_next/static/(?:chunks|css)/([^/]+?)(?:-[a-f0-9]{8,})?(\.\w+)$", "/_next/static/$1$2")
    p = F.regexp_replace(p, r"/assets/([^/]+?)(?:-[a-f0-9]{8,})?(\.\w+)$", "/assets/$1$2")
    p = F.regexp_replace(p, r"/([^/]+?)\.(?:[a-f0-9]{8,})\.(chunk\.js)$", "/$1.$2")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    folder = F.regexp_extract(p, r"^(.*/)[^/]*$", 1)
    clean = F.regexp_replace(F.regexp_replace(name, r"(?i)[a-f0-9]{8,}", ""), r"\.{2,}", ".")
    p = F.when(F.contains(name, F.lit(".")) & F.contains(p, F.lit("/")), F.concat(folder, clean)).otherwise(p)
    p = F.regexp_replace(p, "/{2,}", "/")
    p = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))


def js_query(q: Column) -> Column:
    """Parameters without cache breakers; of a repeated one the first."""
    pairs = F.filter(F.split(q, "&"), lambda x: F.contains(x, F.lit("=")))
    names = F.transform(pairs, lambda x: F.substring_index(x, "=", 1))
    kept = F.filter(pairs, lambda x, i: ~F.lower(F.substring_index(x, "=", 1)).isin(*CACHE_PARAMS) & (F.array_position(names, F.substring_index(x, "=", 1)) == i + 1))
    return F.array_join(kept, "&")


def js_identity(url: Column) -> Column:
    return F.concat_ws("::", F.lit("js"), js_host(authority(url)), js_path(path(url)), js_query(query(url)))


def public_ipv4(value: Column) -> Column:
    """Whether an IPv4 address is globally reachable."""
    n = F.aggregate(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    # The blocks set aside (private, loopback, link-local, shared, documentation, benchmarks, multicast, reserved).
    blocks = ((0, 8), (10 << 24, 8), (100 << 24 | 64 << 16, 10), (127 << 24, 8), (169 << 24 | 254 << 16, 16), (172 << 24 | 16 << 16, 12), (192 << 24, 24), (192 << 24 | 2 << 8, 24), (192 << 24 | 168 << 16, 16),
              (198 << 24 | 18 << 16, 15), (198 << 24 | 51 << 16 | 100 << 8, 24), (203 << 24 | 113 << 8, 24), (224 << 24, 4), (240 << 24, 4))
    return ~either(n.between(start, start + (1 << (32 - bits)) - 1) for start, bits in blocks)


def target_problem(value: str | None) -> tuple[str | None, str | None]:
    """(target, problem) of what a user gives as a scan's target: an http(s) URL, or a host, without user, white space or control
    characters, its host an address or labels that IDNA takes, its port in range; the fragment goes, an empty path becomes /."""
    import ipaddress
    import re
    from urllib.parse import urlsplit, urlunsplit

    text = (value or "").strip()
    if not text or len(value or "") > 2048:
        return None, "length"
    if re.search(r"[\x00-\x20\x7f\\]", text):
        return None, "characters"
    try:
        u = urlsplit(text if "://" in text else f"https://{text}")
        port, name = u.port, (u.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
    except (ValueError, UnicodeError):
        return None, "host"
    problem = "scheme" if u.scheme.lower() not in ("http", "https") else "user" if "@" in u.netloc else "host" if not name or "%" in name else None
    if problem:
        return None, problem
    try:
        host = f"[{name}]" if ipaddress.ip_address(name).version == 6 else name
    except ValueError:
        if not all(re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", x) for x in name.split(".")):
            return None, "host"
        host = name
    return urlunsplit((u.scheme.lower(), host if port is None else f"{host}:{port}", u.path or "/", u.query, "")), None


def targets(given: DataFrame, key: str, column: str) -> DataFrame:
    """(key, target, problem) of each row, by Arrow batches: IDNA is Python's."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([given.schema[key], StructField("target", StringType()), StructField("problem", StringType())])

    def run(batches):
        for b in batches:
            told = [target_problem(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in told], pa.string()), pa.array([p for _, p in told], pa.string())], names=schema.names)

    return given.select(key, column).mapInArrow(run, schema)
