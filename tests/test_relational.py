import base64
import datetime as dt
import gzip
import importlib
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import urls as U
from lanternfish.operators import delta, extract, frontier, metrics, ranking
from lanternfish.operators import recovery as V
from lanternfish.plans import registry
from lanternfish.sources import archives
from lanternfish.streaming import events as S

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("url,want", [
    ("HTTP://User:pw@Example.COM:80/a/../b//c/?q=1#f", "http://example.com/b/c/?q=1"), ("https://h:443", "https://h/"), ("https://h:8443/x/.", "https://h:8443/x/"), (r"https:\/\/h\/x", "https://h/x"), ("http:/h/x", "http://h/x"), ("/only/path", None), ("https://h/../../z", "https://h/z")])
def test_normalize(spark, url, want):
    got = one(spark, U.normalize(F.lit(url)))
    assert got == want and (want is None or one(spark, U.normalize(F.lit(want))) == want)


@pytest.mark.parametrize("ref,want", [("x.js", "https://h/a/x.js"), ("../x", "https://h/x"), ("/r?q", "https://h/r?q"), ("//c/d", "https://c/d"), ("https://z/", "https://z/"), ("?p=1", "https://h/a/b?p=1")])
def test_resolve(spark, ref, want):
    assert one(spark, U.resolve(F.lit("https://h/a/b"), F.lit(ref))) == want


def test_scope_and_identity(spark):
    scope = lambda u: one(spark, U.in_scope(F.lit(u), F.lit("example.com")))
    assert scope("https://www.example.com/") and scope("https://a.example.com/x") and scope("https://unpkg.com/x.js") and not scope("https://unpkg.com/x.html") and not scope("https://notexample.com/") and not scope("ftp://example.com/")
    same = [one(spark, U.js_identity(F.lit(u))) for u in ("https://x.org/v1/app.deadbeef01.chunk.js?v=1&k=a", "https://X.org/v2.3/app.deadbeef99.chunk.js?k=a&t=5")]
    assert same[0] == same[1] == "js::x.org::/app.chunk.js::k=a"


def test_endpoint_classes(spark):
    for u, k in (("/api/users", "api_endpoint"), ("/login", "auth_endpoint"), ("/dashboard", "admin_endpoint"), ("/x.png", "static_resource"), ("ws://h/s", "websocket"), ("/callback", "webhook"), ("/plain", "general_endpoint")):
        assert one(spark, U.classify_endpoint(F.lit(u))) == k


def test_links_and_modules(spark):
    page = spark.createDataFrame([(1, "https://h/d/p.html", '<base href="https://b/x/"><a class="k" href="y#f">1</a><a href=\'/z\'>2</a><a href="#top">3</a>'), (2, "https://h/", None)], "page_id long, url string, html string")
    assert sorted(r["target"] for r in extract.links(page).collect()) == ["https://b/x/y", "https://b/z"]
    js = spark.createDataFrame([("https://h/a/m.js", 'import "./n.js"; export {x} from "../o.js"; require("bare"); new Worker("/w.js")')], "url string, content string")
    assert {r["target"] for r in extract.modules(js).collect()} == {"https://h/a/n.js", "https://h/o.js", "https://h/w.js"}


def test_closure(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (9, 8)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {(r["node"], r["depth"]) for r in frontier.closure(seeds, edges, 3).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert frontier.closure(seeds.limit(0), edges, 3).count() == 0


def test_delta_and_baselines(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "fingerprint string") for s in ("aabc", "bcd"))
    assert {(r[0], r[1]) for r in delta.delta(a, b).collect()} == {("a", "resolved"), ("b", "existing"), ("c", "existing"), ("d", "new")}
    scans = spark.createDataFrame([(1, "t", "s", "completed", True, 1), (2, "t", "s", "completed", False, 2), (3, "t", "s", "cancelled", True, 3), (4, "t", "s", "completed", True, 4), (5, "t", "z", "completed", True, 5)], "scan_id long, target_id string, scope string, status string, complete boolean, seq long")
    assert {(r[0], r[1]) for r in delta.baselines(scans).collect()} == {(1, None), (4, 1), (5, None)}


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5, "a"), ("k", 1, "b"), ("z", 9, "c")], "k string, t int, id string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 5, 50), ("k", 7, 70)], "k string, t int, v int")
    assert {(r["id"], r["v_asof"], r["t_asof"]) for r in delta.as_of(left, right, "k", "t", "v").collect()} == {("a", 50, 5), ("b", None, None), ("c", None, None)}


def test_ranking(spark):
    c = spark.createDataFrame([("u", t) for t in (1, 2, 3, 4)] + [("w", 9)], "url string, ts int")
    assert [r["ts"] for r in ranking.capture_order(c).where("url = 'u'").orderBy("turn").collect()] == [1, 4, 2, 3]
    pools = spark.createDataFrame([(0, i) for i in range(1, 3)] + [(1, i) for i in range(1, 11)] + [(2, i) for i in range(1, 11)], "pool int, rank int")
    assert {r["pool"]: r["n"] for r in ranking.quota_select(pools, 10).groupBy("pool").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 7, 2: 1}
    commits = spark.createDataFrame([("f", 1, True, True), ("f", 2, True, False), ("f", 3, False, False), ("g", 1, False, False)], "finding string, ordinal int, has boolean, parent_has boolean")
    assert [(r[0], r[1]) for r in ranking.introduced(commits).collect()] == [("f", 2)]


def test_quality(spark):
    e = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "case_id int, rule string")
    f = spark.createDataFrame([(1, "a"), (4, "a")], "case_id int, rule string")
    assert {tuple(r) for r in metrics.quality(e, f).collect()} == {("a", 1, 1, 1, 0.5, 0.5), ("b", 0, 0, 1, None, 0.0)}


def test_cooldown_counts_from_the_last_kept(spark, tmp_path):
    df = spark.createDataFrame([("k", at(s), i) for i, s in enumerate((0, 3, 6, 7, 12))] + [("j", at(1), 9), (None, at(1), 10)], "key string, ts timestamp, id long")
    assert sorted(r["id"] for r in S.cooled(df, 5).collect()) == [0, 2, 4, 9, 10]
    df.where("key is not null").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.cooled_stream(stream, 5).writeStream.format("memory").queryName("cooled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("cooled").collect()) == [0, 2, 4, 9]


def test_stream_windows_and_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, at(i * 60), "view", 1.0) for i in range(50)], "event_id long, ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, s in (("once", S.once(read())), ("tumbled", S.tumbling(read(), "10 minutes"))):
        s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 5 and spark.table("tumbled").count() >= 3


def test_batches(spark):
    log = spark.createDataFrame([(1, i, "x" * 10) for i in range(405)] + [(2, 0, "y" * 3000), (2, 1, "z"), (3, 0, None)], "scan_id long, seq long, payload string")
    n = {(r[0], r[1]): r[2] for r in S.batches(log).groupBy("scan_id", "batch").count().collect()}
    assert n == {(1, 0): 200, (1, 1): 200, (1, 2): 5, (2, 0): 2, (3, 0): 1}
    assert max(r[0] for r in S.batches(log, max_chars=2000).where("scan_id = 2").select("batch").collect()) == 1  # one event at least


def test_contract(spark):
    cases = [("heartbeat_debug", "{}", False), ("heartbeat_debug", '{"artifacts":[1]}', True), ("js_analysis_complete", '{"metadata":{"secret_count":0}}', False), ("endpoint_found", '{"confidence":0.7}', True), ("endpoint_found", None, False), ("anything", None, True)]
    df = spark.createDataFrame(cases, "k string, d string, want boolean")
    assert all(r[0] == r[1] for r in df.select(S.reported(F.col("k"), F.col("d")), "want").collect())


def test_terminal_and_transitions(spark):
    e = spark.createDataFrame([("s", at(i), i, k) for i, k in enumerate(("scan_progress", "scan_failed", "scan_progress"))], "scan_id string, ts timestamp, id long, event_type string")
    assert S.before_terminal(e).count() == 2
    st = spark.createDataFrame([("s", at(i), i, k) for i, k in enumerate(("pending", "running", "completed", "running"))], "scan_id string, ts timestamp, id long, status string")
    assert [r["allowed"] for r in S.transitions(st).orderBy("id").collect()] == [True, True, True, False]


def test_local_files(spark, tmp_path):
    (tmp_path / "a" / ".git").mkdir(parents=True)
    for name, data in (("a/x.js", b"\xef\xbb\xbfok"), ("a/b.js", b"a\0b"), ("a/bad.py", b"\xff\xfe"), ("a/big.txt", b"x" * 5000), ("a/pic.png", b"x"), ("a/.git/c.js", b"x"), ("a/Dockerfile", b"FROM x")):
        (tmp_path / name).write_bytes(data)
    got = {r["locator"].rsplit("/", 1)[1]: (r["content"], r["limited"]) for r in archives.local_files(spark, str(tmp_path), max_bytes=4000).collect()}
    assert got == {"x.js": ("ok", False), "b.js": (None, True), "bad.py": (None, True), "big.txt": (None, True), "Dockerfile": ("FROM x", False)}


def test_source_maps(spark):
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def code(n):
        n, out = (-n << 1 | 1) if n < 0 else n << 1, ""
        while True:
            n, d = n >> 5, n & 31
            out += digits[d | 32 if n else d]
            if not n:
                return out

    assert archives.vlq(code(-7) + code(0) + code(123456)) == [-7, 0, 123456]
    seg = lambda *x: "".join(map(code, x))
    flat = {"version": 3, "sources": ["a.js", "b.js"], "sourcesContent": ["A", "B"], "names": [], "mappings": ";".join([",".join([seg(0, 0, 0, 0), seg(4, 1, 0, 6)]), seg(2, 0, 1, -2)])}
    where = lambda m, *x: (lambda r: r and (r["generated_line"], r["generated_column"], r["accuracy"]))(archives.generated_location(json.dumps(m), *x))
    assert where(flat, "b.js", "B", 1, 9) == (1, 4, "nearest_segment") and where(flat, "b.js", "B", 2, 4) == (2, 2, "exact_segment") and where(flat, "b.js", "B", 1, 5) is None and where(flat, "a.js", "other", 1, 0) is None
    parts = {"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": {"version": 3, "sections": []}}, {"offset": {"line": 3, "column": 10}, "map": flat}]}
    assert where(parts, "b.js", "B", 1, 6) == (4, 14, "exact_segment") and where(parts, "b.js", "B", 2, 4) == (5, 2, "exact_segment")
    for broken in ("AA", "A!", seg(0, 5, 0, 0), seg(-1, 0, 0, 0)):
        with pytest.raises(ValueError):
            archives.generated_location(json.dumps(flat | {"mappings": broken}), "a.js", "A", 1, 0)
    df = spark.createDataFrame([(1, '{"version":3,"sources":["a","b"],"sourcesContent":["x",null]}'), (2, "{"), (3, '{"version":2,"sources":["a"],"sourcesContent":["x"]}'), (4, None)], "map_id long, body string")
    assert [(r["map_id"], r["source"], r["content"]) for r in archives.map_sources(df).collect()] == [(1, "a", "x")]


def test_index_rows(spark):
    body = '[["timestamp","original","mimetype","statuscode","digest"],["20240101000000","u","t","200","d"],["bad","u","t","200","d"],["20240101000000","u","t","404","d"],["x"]]'
    assert archives.cdx_rows(spark.createDataFrame([(body,), ("nonsense",), (None,)], "body string")).count() == 1


def test_registry_is_whole():
    q, o = registry.queries(), registry.oracle_sql()
    assert len(q) >= 90 and set(o) <= set(q) and len(set(q) - set(o)) <= 4


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) > 80, len(e.oracle_sql()) > 80)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert out.stdout.strip() == "True True", out.stderr[-500:]


@pytest.mark.parametrize("name", ["detect_findings", "evidence_location", "page_links", "endpoint_extract", "scan_delta", "asof_map", "capture_quota", "rate_window", "event_cooldown", "outbox_batches", "semantic_evidence", "redact_lines", "js_identity", "introduced_commit"])
def test_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "events", "orders", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    rnd = lambda v: round(v, 4) if isinstance(v, float) else v
    mine = sorted(str([rnd(x[c]) for c in cols]) for x in df.collect())
    theirs = sorted(str([rnd(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert cols == sorted(names) and mine == theirs


def test_archive_records(spark, tmp_path):
    from lanternfish.operators import recovery as V

    good = V.member("https://h/x", "2024-01-02T03:04:05Z", "é".encode(), "text/html; charset=utf-8")
    cases = {"good": good, "junk": b"no archive here", "two": good + good, "image": V.member("u", "2024-01-01T00:00:00Z", b"x", "image/png"), "bad": V.member("u", "2024-01-01T00:00:00Z", b"\xff", "text/plain")}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in V.records(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"good": ("é", None), "junk": (None, "not gzip"), "two": (None, "not one member"), "image": (None, "type"), "bad": (None, "charset")}
    assert V.record(b"")["problem"] == "not one member"
    assert V.record(good)["captured"] == "20240102030405" and V.record(good, "https://other")["problem"] == "other uri" and V.record(good, want_time="20240102030406")["problem"] == "other time"


def test_bisection():
    from lanternfish.operators import recovery as V

    first, last, sick = dt.date(2024, 1, 1), dt.date(2024, 1, 16), dt.date(2024, 1, 6)
    good, bad = V.bisect(first, last, lambda a, b: a <= sick <= b)
    days = [a + dt.timedelta(days=i) for a, b in good for i in range((b - a).days + 1)]
    assert bad == [(sick, sick)] and len(days) == 15 and len(set(days)) == 15
    assert V.bisect(first, last, lambda a, b: True, budget=1)[1] == [(first, dt.date(2024, 1, 8)), (dt.date(2024, 1, 9), last)]


def test_script_strings():
    from lanternfish.operators import recovery as V

    js = 'var s = "//# sourceMappingURL=no";\n/* var c = "a" + "b"; */\nconst k = "a\\u0062" + "c";\n//# sourceMappingURL=x.map\n'
    assert V.map_reference(js) == "x.map" and V.literal_strings(js) == [("k", "abc", 3)]


def test_declared_maps():
    inline = "data:application/json;base64," + base64.b64encode(b' {"version":3} ').decode()
    assert V.map_reference("a /*# sourceMappingURL=x.map */") == "x.map" and V.map_reference("let s = '//# sourceMappingURL=no'; // see //# sourceMappingURL=no") is None
    assert V.declared_map("x\n//# sourceMappingURL=../m.map\n", "https://h.example/js/app.js") == "https://h.example/m.map"
    assert V.declared_map(f"//# sourceMappingURL=old.map\n//# sourceMappingURL={inline}", "https://h.example/") == '{"version":3}' and V.declared_map("none", "https://h.example/") is None
    with pytest.raises(ValueError):
        V.declared_map("//# sourceMappingURL=data:text/plain,x", "https://h.example/")


def test_record_types_and_charsets():
    one = lambda body, kind: V.record(V.member("https://h/x", "2024-01-02T03:04:05+01:00", body, kind))
    assert one(b"<a/>", "application/atom+xml")["text"] == "<a/>" and one(b"x", "application/octet-stream")["text"] == "x" and one(b"x", "application/atom+xml")["captured"] == "20240102020405"
    assert one(b"\x93q\x94", "text/plain; charset=windows-1252")["text"] == "\u201cq\u201d" and one(b"x", "text/plain; charset=koi8-r")["problem"] == "charset" and one(b"a\0b", "text/plain")["problem"] == "binary" and one(b"x", "image/png")["problem"] == "type"


@pytest.mark.parametrize("host,want", [("cdn.site.com", True), ("main.js", False), ("app.a1b2.js", False), ("x.y.z", False), ("a.de", True), ("one.two.three", True), ("10.0.0.1", True), ("plain", False), ("static.foo.bar1", True), ("v1.tar.gz", False)])
def test_plausible_hosts(spark, host, want):
    assert one(spark, U.plausible_host(F.lit(host))) is want


def test_url_classes_and_targets(spark):
    rows = [(r"https:\/\/h.com\/a", "absolute", "https://h.com/a"), ("htttp://h.com//x", "absolute", "http://h.com/x"), ("https//h.com/a b", "absolute", "https://h.com/a%20b"), ("/static.xx.fbcdn.net/r.js", "embedded_host", "https://static.xx.fbcdn.net/r.js"), ("../q?x=1", "relative", "https://b.org/q?x=1"),
            ("ftp://h.com/x", "absolute", "ftp://h.com/x"), ("mailto:a@b.cc", "mailto_url", None), ("   ", "empty", None), ("https://-bad-/x", "invalid", None), (None, "empty", None)]
    got = U.classified(spark.createDataFrame([(i, u, "https://b.org/d/e") for i, (u, *_) in enumerate(rows)], "i int, url string, base string"), "url", "base").orderBy("i").collect()
    assert [(r["class"], r["normalized"]) for r in got] == [(c, n) for _, c, n in rows]
    alone = U.classified(spark.createDataFrame([(0, "a_b/c"), (1, "www.exa.com/x")], "i int, url string")).orderBy("i").collect()
    assert [(r["class"], r["normalized"]) for r in alone] == [("invalid", None), ("embedded_host", "https://www.exa.com/x")]
    assert [U.target_problem(x) for x in ("bücher.example", "https://[::1]:8443/x#f", "HTTP://H.example.?q", "http://a_b.example", "http://u@h", "h:70000", "gopher://h", None)] == [
        ("https://xn--bcher-kva.example/", None), ("https://[::1]:8443/x", None), ("http://h.example/?q", None), (None, "host"), (None, "user"), (None, "host"), (None, "scheme"), (None, "length")]


def test_endpoints_by_line(spark):
    js = 'router.get("/x")\n// endpoint: https://h/api\nconst u = "/users/list";\nfetch(\n"/late")\n$.ajax({method: "GET", url:"/q"})'
    got = {r["endpoint"] for r in extract.endpoints(spark.createDataFrame([(1, js)], "i int, t string"), "i", "t").collect()}
    assert {"/x", "https://h/api", "/users/list", "/late", "/q"} <= got
