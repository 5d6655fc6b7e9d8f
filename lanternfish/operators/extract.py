"""Rows from text: links, scripts, modules, endpoints, hosts, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import either

# Forms in which scripts name modules, endpoints and values that mark a token in a path.
MODULES = (
    r"""\bimport\s*(?:\(\s*)?["']([^"'\r\n]{1,2048})["']""",
    r"""\b(?:import|export)\s+[^;\r\n]{0,512}?\bfrom\s*["']([^"'\r\n]{1,2048})["']""",
    r"""\b(?:require|importScripts)\s*\(\s*["']([^"'\r\n]{1,2048})["']""",
    r"""\bnew\s+(?:Worker|SharedWorker)\s*\(\s*["']([^"'\r\n]{1,2048})["']""",
    r"""\bnew\s+URL\s*\(\s*["']([^"'\r\n]{1,2048}\.(?:js|mjs|cjs)(?:\?[^"'\r\n]*)?)["']\s*,\s*import\.meta\.url""",
)
# Forms in which scripts name endpoints (a literal that is a path or URL, calls, settings, comments), words by which a line
# is taken to be about endpoints, and forms in which scripts name scripts.
LITERAL = r"""(?i)["']((?:/|https?://)[^"'\s]+?(?:\?.*?)?)["']"""
ENDPOINTS = (
    r"""["'](/api/[^"'\s<>]+)["']""", r"""["'](/v[0-9]+/[^"'\s<>]+)["']""", r"""["'](/graphql[^"'\s<>]*)["']""", r"""["'](/rest/[^"'\s<>]+)["']""", r"""["'](/admin[^"'\s<>]*)["']""",
    r"""["'](/internal[^"'\s<>]*)["']""", r"""["'](/private[^"'\s<>]*)["']""", r"""["'](/secure[^"'\s<>]*)["']""", r"""["'](/auth[^"'\s<>]*)["']""", r"""["'](/login[^"'\s<>]*)["']""",
    r"""["'](/oauth[^"'\s<>]*)["']""", r"""fetch\(["']([^"'\s]+)["']""", r"""axios\.(?:get|post|put|delete)\(["']([^"'\s]+)["']""", r"""import\(["']([^"'\s]+)["']""", r"""require\(["']([^"'\s]+)["']""",
    r"""new WebSocket\(["']([^"'\s]+)["']""", r"""["'](/static/[^"'\s<>]+)["']""", r"""["'](/assets/[^"'\s<>]+)["']""", r"""["'](/images?/[^"'\s<>]+)["']""", r"""router\.(?:get|post|put|delete)\(["']([^"'\s]+)["']""",
    r"""app\.(?:get|post|put|delete)\(["']([^"'\s]+)["']""", r"""route\(["']([^"'\s]+)["']""", r"""\.open\(["'](?:GET|POST|PUT|DELETE)["'],["']([^"'\s]+)["']""", r"""this\.\$http\.(?:get|post|put|delete)\(["']([^"'\s]+)["']""",
    r"""__webpack_require__\(["']([^"'\s]+)["']""", r"""serviceWorker\.register\(["']([^"'\s]+)["']""",
)
#: Those that may run over the end of a line, and so find other things on a line alone than in the whole text.
LONG_ENDPOINTS = (
    r"""\.ajax\([^)]*url["']?:["']([^"'\s]+)""", r"""window\.location[^=]*=["']([^"'\s]+)""", r"""document\.location[^=]*=["']([^"'\s]+)""", r"""location\.href[^=]*=["']([^"'\s]+)""", r"""axios\([^)]*url:\s*["']([^"'\s]+)["']""",
    r"""fetch\([^)]*["']([^"'\s]+)["']""", r"""baseURL:\s*["']([^"'\s]+)["']""", r"""apiUrl:\s*["']([^"'\s]+)["']""", r"""endpoint:\s*["']([^"'\s]+)["']""", r"""workbox\.precaching\.precacheAndRoute\([^)]*["']([^"'\s]+)["']""",
    r"""//\s*(?:endpoint|api|url):\s*([^\s]+)""", r"""/\*\s*(?:endpoint|api|url):\s*([^*]+)\*/""", r"""["']url["']\s*:\s*["']([^"'\s]+)["']""", r"""["']endpoint["']\s*:\s*["']([^"'\s]+)["']""", r"""["']path["']\s*:\s*["']([^"'\s]+)["']""",
)
COMPLEX = (
    r"""(?i)(?:const|let|var)\s+\w+\s*=\s*["']([^"'\s]+)["']""", r"""(?i)\w+\.(?:url|endpoint|api|path)\s*=\s*["']([^"'\s]+)["']""", r"""(?i)(?:url|endpoint|api):\s*["']([^"'\s]+)["']""",
    r"""(?i)\.(?:get|post|put|delete|patch)\(["']([^"'\s]+)["']""", r"""(?i)\.request\([^)]*["']([^"'\s]+)["']""", r"""(?i)\.(?:load|open)\([^)]*["']([^"'\s]+)["']""",
)
HINTS = ("api", "auth", "v1", "v2", "v3", "token", "secret", "jwt", "key", "login", "user", "admin", "oauth", "verify", "validate", "password", "reset", "register", "endpoint", "url", "baseurl", "graphql", "rest", "websocket", "webhook", "callback", "redirect")
MODERN = (
    r"""["']([^"']+chunk[^"']*\.js[^'"]*)["']""", r"""["']([^"']+bundle[^"']*\.js[^'"]*)["']""", r"""["']([^"']+main\.[a-f0-9]{8}\.js[^'"]*)["']""", r"""["']([^"']+\.[a-f0-9]{8,}\.js[^'"]*)["']""",
    r"""__webpack_require__\(\s*["']([^"']+)["']""", r"""loadComponent\(\s*["']([^"']+\.js)["']""", r"""["'](/_next/[^"']+\.js)["']""", r"""["'](/static/js/[^"']+\.js[^'"]*)["']""", r"""["'](/assets/[^"']+\.js)["']""",
    r"""["'](/js/[^"']+\.js)["']""", r"""import\(\s*["']([^"']+?)["']""", r"""dynamicImport\(\s*["']([^"']+?)["']""", r"""["']([^"']+instagram[^"']*\.js[^'"]*)["']""", r"""["']([^"']+fb[^"']*\.js[^'"]*)["']""",
    r"""["']([^"']+react[^"']*\.js[^'"]*)["']""", r"""["']([^"']+vendor[^"']*\.js[^'"]*)["']""",
)
IMPORTED = (r"""import\(\s*['"]([^'"]+\.js[^'"]*)['"]""", r"""import\s+.*?\s+from\s+['"]([^'"]+\.js[^'"]*)['"]""")
INLINE_SCRIPTS = (*IMPORTED, r"""require\(\s*['"]([^'"]+\.js[^'"]*)['"]""", r"""["'](https?://[^"']+\.js[^'"]*)["']""", r"""["'](/[^"']+\.js[^'"]*)["']""", *MODERN)
SCRIPT_FILES = (*IMPORTED, r"""src\s*=\s*['"]([^'"]+\.js[^'"]*)['"]""", r"""loadScript\(\s*['"]([^'"]+\.js[^'"]*)['"]""", r"""chunkFilename:\s*['"]([^'"]+\.js[^'"]*)['"]""", r"""lazy\(\s*\(\)\s*=>\s*import\(['"]([^'"]+)['"]\)""", *MODERN)
TOKEN_IN_PATH = r"(?i)(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{30,}|(?:gh[pousr]_|github_pat_|sk_(?:live|test)_|xox[baprs]-)[\w-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]+|[a-z0-9_+=-]{40,}"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"'#]*)"""
SRC = r"""(?i)<script\s[^>]*?src\s*=\s*["']([^"']+)["']"""
PRELOAD = r"""(?i)<link\s[^>]*?rel\s*=\s*["'](?:modulepreload|preload)["'][^>]*?href\s*=\s*["']([^"']+)["']"""
BASE = r"""(?i)<base\s[^>]*?href\s*=\s*["']([^"']+)["']"""


def all_of(text: Column, patterns) -> Column:
    """Distinct values of group 1 of every pattern, in the patterns' order."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))))


def _resolved(rows: DataFrame, keep: list[str], base: str, ref: str) -> DataFrame:
    """rows' keep and target: ref against base. Each URL is taken apart once, in a column of its own."""
    told = rows.withColumns({"_b": U.parts(U.tidy(F.col(base))), "_r": U.parts(U.tidy(F.col(ref)))})
    told = told.withColumn("_t", U.joined_parts(F.col("_b"), F.col("_r")))
    # exploded, not filtered: a filter would be pushed down, and all that target is made of with it, once for each use
    return told.select(*keep, F.explode(F.filter(F.array(U.spelled(F.col("_t"))), lambda x: x.isNotNull())).alias("target"))


def links(pages: DataFrame, pattern: str = HREF) -> DataFrame:
    """(page_id, url, target): what a page's elements name, resolved against its base element or URL."""
    own = F.regexp_extract("html", BASE, 1)
    base = F.when(own.rlike("^https?://"), own).otherwise(F.col("url"))
    got = pages.select("page_id", "url", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("ref"))
    return _resolved(got.where("ref <> ''"), ["page_id", "url"], "base", "ref")


def modules(scripts: DataFrame, text: str = "content", base: str = "url") -> DataFrame:
    """(base, target): literal module references; bare specifiers are not URLs."""
    got = scripts.select(F.col(base).alias("base"), F.explode(all_of(F.col(text), MODULES)).alias("ref"))
    return _resolved(got.where(F.col("ref").rlike(r"^(?:\.{1,2}/|/|https?://)")), ["base"], "base", "ref")


def script_references(scripts: DataFrame, key: str, text: str, base: str, patterns: tuple[str, ...] = SCRIPT_FILES) -> DataFrame:
    """(key, target): the scripts that a script, or an inline one, names, in one spelling, each once. What looks like none is left out."""
    from ..functions.scan import looks_like_script

    told = all_of(F.col(text), [f"(?i){p}" for p in patterns])
    got = scripts.select(key, F.col(base).alias("base"), F.explode(F.filter(told, lambda x: F.length(x) >= 3)).alias("ref"))
    found = U.classified(got, "ref", "base")
    return found.select(key, F.explode(F.filter(F.array("normalized"), lambda x: x.isNotNull() & looks_like_script(x))).alias("target")).distinct()


def endpoints(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, endpoint): distinct endpoint literals of each text, and of its lines that hold a hint: there the forms that may run over
    the end of a line are looked for again."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: U.contains_any(F.lower(x), HINTS))
    again = F.flatten(F.transform(lines, lambda x: all_of(x, LONG_ENDPOINTS)))
    whole = all_of(F.col(text), (LITERAL, *ENDPOINTS, *LONG_ENDPOINTS, *COMPLEX))
    found = F.array_distinct(F.transform(F.concat(whole, again), lambda x: F.replace(F.trim(x), F.lit("\\/"), F.lit("/"))))
    return scripts.select(key, F.explode(F.filter(found, lambda x: x != "")).alias("endpoint"))


def references(docs: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """(key, locator): the first `limit` distinct URLs of a text that name no user, odd port, template or token."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"""https?://[^\s'"<>`\\]{1,512}"""), F.lit(0)), lambda u: F.regexp_replace(u, r"[);,}\].]+$", "")))
    clean = lambda u: F.concat(U.scheme(u), F.lit("://"), U.host(u), F.when(U.path(u) == "", "/").otherwise(U.path(u)))
    fine = lambda u: (U.host(u) != "") & ~F.contains(U.authority(u), F.lit("@")) & U.port(u).isin("", "80", "443") & ~F.concat(U.host(u), U.path(u)).rlike(TOKEN_IN_PATH) & ~U.path(u).rlike(r"[${}]")
    kept = F.slice(F.array_distinct(F.transform(F.filter(found, fine), clean)), 1, limit)
    return docs.select(key, F.explode(kept).alias("locator"))


#: Forms in which texts name hosts.
HOST_FORMS = (r"""["']https?://([a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,})[^"']*["']""", r"""["']//([a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,})[^"']*["']""", r"""(?:url|domain|host|api)[\s=:]+["']([a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,})["']""",
              r"""(?:fetch|axios|ajax|XMLHttpRequest)\(["']https?://([a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,})[^"']*["']""", r"""wss?://([a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,})""")


def content_hosts(texts: DataFrame, text: str, base: str) -> DataFrame:
    """Hosts under a base domain that texts name, with how many texts name each."""
    hosts = F.array_distinct(F.transform(all_of(F.col(text), [f"(?i){p}" for p in HOST_FORMS]), lambda h: F.lower(h)))
    got = texts.select(F.explode(hosts).alias("host")).where((F.col("host") == base) | F.endswith("host", F.lit("." + base)))
    return got.groupBy("host").agg(F.count("*").alias("n"))


def certificate_hosts(entries: DataFrame, names: str, base: str) -> DataFrame:
    """(host, confidence) from certificate log entries, whose names are parted by line ends."""
    each = F.transform(F.split(names, "\n"), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^\*\.", ""))
    return entries.select(F.explode(each).alias("host")).where((F.col("host") == base) | F.endswith("host", F.lit("." + base))).distinct().withColumn("confidence", F.lit(0.85))


def js_like(text: Column) -> Column:
    words = ("function", "var ", "let ", "const ", "=>", "return", "import ", "export ")
    hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    return (~F.lower(F.ltrim(text)).rlike("^<(?:!doctype|html)")) & (hits >= 2)


def challenge(text: Column) -> Column:
    """Whether a page asks for a captcha or a password instead of showing content."""
    head = F.lower(F.substring(text, 1, 65536))
    return either(F.contains(head, F.lit(m)) for m in ("cf-chl-", "g-recaptcha", 'type="password"', "type='password'"))
