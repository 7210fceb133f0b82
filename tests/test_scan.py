import http.server
import json
import threading
import time
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from glintscan.config import ScanConfig
from glintscan.functions.text import entropy_tokens, resolve_url, shannon_entropy, snippet, snippet_bytes
from glintscan.operators import blobs as B
from glintscan.operators import detect, report, tech
from glintscan.plans.scan import scan_pages, scan_report
from glintscan.sources.pages import fetch_resources, load, read_pages, write_report
from glintscan.streaming.scan import findings_stream, print_sink, scan_stream

URL = "https://h.example/a/b?q#top"
SCHEMA = "page_id long, url string, html string"


def pages(spark, *html):
    return spark.createDataFrame([(i, URL, h) for i, h in enumerate(html, 1)], SCHEMA)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(("html", "bodies"), [
    ("<script>a</script>", ["a"]),
    ("<SCRIPT type=module>a</Script >b", ["a"]),
    ("<script> \xa0\n</script><script>b</script>", ["b"]),
    ('<script src="">a</script>', ["a"]),
    ("<!-- <script>a</script> --><script>b</script>", ["b"]),
    ("<textarea><script>a</script></textarea><title><script>b</script></title><noscript><script>c</script></noscript>", []),
    ('<p title="<script>a</script>">x</p>', []),
    ("<script>a<b", ["a<b"]),
    ("<script>x\r\ny\rz</script>", ["x\ny\nz"]),
    ("<scripty>a</scripty>", []),
    ("", []),
    ("<div>" * 5 + "<script data-x='>'>a</script>", ["a"]),
])
def test_inline_scripts(spark, html, bodies):
    found = B.blobs(pages(spark, html)).filter("source = 'inline'").orderBy("blob_ord").collect()
    assert [(r.body, r.path) for r in found] == [(b, f"{URL}#inline-{k}") for k, b in enumerate(bodies, 1)]


def test_external_scripts(spark):
    html = "<script src='/js/1.js'></script><script>in</script><script data-src=no src=\"x.js?a&amp;b\"></script><script src=/js/1.js></script><script src=gone.js></script>"
    resources = spark.createDataFrame([("https://h.example/js/1.js", 200, "one"), ("https://h.example/a/x.js?a&b", 200, "two"), ("https://h.example/a/gone.js", 404, "three")], "url string, status int, body string")
    df = pages(spark, html, "")
    found = B.blobs(df, resources)
    assert [(r.source, r.body) for r in found.filter("page_id = 1").orderBy("blob_ord").collect()] == [("external", "one"), ("inline", "in"), ("external", "two"), ("external", "one"), ("html", html)]
    assert {r.page_id: r.js_blobs for r in B.blob_counts(df, found).collect()} == {1: 4, 2: 0}


@pytest.mark.parametrize("ref", ["//o.example/x", "/x", "x", "../x", "../../../x", "?z", "#f", "https://o.example/a/../b", "./", "..", "x/./y/../z", "", "a//b", "x?y=/../z"])
@pytest.mark.parametrize("base", ["https://h.example/a/b/c?q#top", "http://h.example", "http://h.example/a/"])
def test_resolution(spark, base, ref):
    want = {"https://o.example/a/../b": "https://o.example/b"}.get(ref, urljoin(base, ref))
    if ref == "a//b":  # an empty segment stays
        want = urljoin(base, "a/!/b").replace("!/", "/")
    if ref == "":
        want = base.partition("#")[0]
    if ref == "?z" and base == "http://h.example":
        want = "http://h.example?z"
    assert value(spark, resolve_url(F.lit(base), F.lit(ref))).rstrip("/") == want.rstrip("/")


def test_unresolvable(spark):
    for ref in ("a\nb", "/%zz", "1a:b"):
        assert value(spark, resolve_url(F.lit(URL), F.lit(ref))) is None
    p = pages(spark, "<script src=httpx.js></script>")
    assert [r.script_url for r in B.external_scripts(p, ScanConfig(headless=True)).collect()] == ["httpx.js"]
    assert [r.script_url for r in B.external_scripts(p).collect()] == ["https://h.example/a/httpx.js"]


def test_lines(spark):
    df = spark.createDataFrame([(1, 0, "p", "a\r\nb\n")], "page_id long, blob_ord int, path string, body string")
    assert [(r.line, r.text) for r in detect.lines(df).collect()] == [(1, "a\r"), (2, "b"), (3, "")]


@pytest.mark.parametrize(("line", "token", "want"), [
    ("TOKEN" + "x" * 30, "TOKEN", "TOKEN" + "x" * 20 + "..."),
    ("y" * 20 + "TOKEN", "TOKEN", "y" * 20 + "TOKEN"),
    ("y" * 21 + "TOKEN", "TOKEN", "..." + "y" * 20 + "TOKEN"),
    ("aTOKENb " + "z" * 40 + " TOKEN", "TOKEN", "aTOKENb " + "z" * 18 + "..."),
    ("é" + "y" * 19 + "TOKEN", "TOKEN", "...�" + "y" * 19 + "TOKEN"),
    ("q" * 101, "none", "q" * 100 + "..."),
])
def test_snippet(spark, line, token, want):
    assert value(spark, snippet(F.lit(line), F.lit(token))) == want
    assert bytes(value(spark, snippet_bytes(F.lit(line), F.lit(token)))).decode("utf-8", "replace") == want


def test_entropy(spark):
    assert value(spark, shannon_entropy(F.lit("éééé"))) == 0.5
    assert value(spark, shannon_entropy(F.lit(""))) == 0
    assert value(spark, shannon_entropy(F.lit("abcd"))) == 2
    assert value(spark, entropy_tokens(F.lit("a b\tc\"d'e,f;g\rh  i"))) == ["a", "b", "c", "d", "e", "f", "g\rh", "i"]


KEY = "abcdefghij0123456789_-Ab"


def test_first_of_equal_findings_stays(spark):
    script = f'a\napi_key="{KEY}"\napi_key="{KEY}"\n'
    html = f"<script>{script}</script><script>{script}</script>"
    found = scan_pages(pages(spark, html, html)).filter("detector = 'Generic API Key'")
    assert sorted((r.page_id, r.path.removeprefix(URL), r.line) for r in found.collect()) == sorted((p, s, n) for p in (1, 2) for s, n in (("#inline-1", 2), ("#inline-2", 2), ("", 2)))
    again = detect.keep_first(found)
    assert again.count() == found.count()


def test_partitions_do_not_matter(spark):
    df = pages(spark, *[f"<script>x = '/api/v{i}/u'; api_key='{KEY}{i}'</script>" for i in range(20)])
    rows = lambda d: sorted(map(tuple, scan_pages(d).collect()))
    assert rows(df.repartition(1)) == rows(df.repartition(7))


def test_reports(spark, tmp_path):
    df = pages(spark, f"<!doctype html><script>api_key='{KEY}'; x = '/api/<b>'</script>", "plain")
    made = scan_report(df)
    summary = {r.page_id: r for r in made["summary"].collect()}
    assert (summary[1].js_blobs, summary[1].total, summary[1].secret, summary[1].endpoint) == (1, 4, 2, 2)
    assert (summary[2].total, summary[2].technologies) == (0, None)
    plain = {r.page_id: r.text for r in made["plain"].collect()}
    assert "\nSECRET (2)\n" in plain[1] and "CONFIG" not in plain[1] and plain[1].index("SECRET") < plain[1].index("ENDPOINT")
    assert plain[2].endswith("Findings: 0\n\n" + report.NOTHING + "\n")
    data = {r.page_id: r.json for r in made["json"].collect()}
    assert "<" not in data[1] and json.loads(data[2]) == {"findings": None, "js_blobs": 0, "technologies": None, "url": URL}
    assert [f["line"] for f in json.loads(data[1])["findings"]] == [1] * 4
    block = {r.page_id: r.text for r in made["blocks"].collect()}
    assert "\nSECRETS\n" in block[1] and "  Location: " in block[1] and block[2].endswith(report.NOTHING + "\n")
    assert "Tech: HTML5\n" in {r.page_id: r.text for r in made["summary_text"].collect()}[1]
    assert report.plain_lines(made["findings"], ScanConfig(quiet=True)).count() == 0
    assert all("****" in r.text for r in report.plain_lines(made["findings"], ScanConfig(mask_tokens=True)).collect())
    for form in ("json", "text", "parquet"):
        write_report(made, f"{tmp_path}/{form}", form)
    text = "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*")))
    objects = []
    while text.strip():
        one, end = json.JSONDecoder().raw_decode(text.lstrip())
        objects.append(one)
        text = text.lstrip()[end:]
    assert len(objects) == 2 and data[2] == json.dumps(json.loads(data[2]), indent=2)
    quiet = ScanConfig(quiet=True)
    silent = {r.page_id: r.text for r in scan_report(df, cfg=quiet)["plain"].collect()}
    assert silent[2] == "" and silent[1].startswith("\nSECRET (2)\n")
    df.write.json(f"{tmp_path}/pages")
    assert read_pages(spark, f"{tmp_path}/pages", "json").count() == 2


def test_technologies_from_headers(spark):
    df = spark.createDataFrame([(1, "/wp-content/", {"Server": ["nginx/1.2"]}), (2, "x", None)], "page_id long, html string, headers map<string,array<string>>")
    assert {r.page_id: r.technologies for r in tech.fingerprint(df).collect()} == {1: ["MySQL", "Nginx", "PHP", "WordPress"], 2: None}


def test_streams_give_what_batches_give(spark, tmp_path):
    df = pages(spark, *[f"<script>api_key='{KEY}{i}'</script>" for i in range(6)]).withColumn("ts", F.timestamp_seconds(F.col("page_id")))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    scan_stream(stream(), lambda found, n: got.extend((r.page_id, r.detector, r.path, r.token, r.line) for r in found.collect()), f"{tmp_path}/c1").awaitTermination()
    want = sorted((r.page_id, r.detector, r.path, r.token, r.line) for r in scan_pages(df).collect())
    assert sorted(got) == want
    q = findings_stream(stream(), "ts").writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.page_id, r.detector, r.path, r.token, r.line) for r in spark.table("found").collect()) == want


def test_repeated_pages_are_one_page(spark):
    html = f"<script>api_key='{KEY}'</script><script>x = '/api/v1/u'</script>"
    one = spark.createDataFrame([(1, URL, html)], SCHEMA)
    rows = scan_report(one.union(one).union(one))["summary"].collect()
    want = scan_report(one)["summary"].collect()
    assert len(rows) == 3 and set(rows) == set(want) and want[0].js_blobs == 2


def test_one_parse_of_a_page(spark):
    df = pages(spark, "<script src=/a.js></script>")
    resources = spark.createDataFrame([("https://h.example/a.js", 200, f"api_key='{KEY}'")], "url string, status int, body string")
    plan = scan_report(df, resources)["summary"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<noscript") == 0 or plan.count("regexp_extract_all(html") <= 2  # both branches of the one condition


def test_scripts_are_scanned_once_and_met_by_every_page(spark):
    html = "<script src=/a.js></script><script src=/gone.js></script><script src=/a.js></script>"
    resources = spark.createDataFrame([("https://h.example/a.js", 200, f"x\napi_key='{KEY}'"), ("https://h.example/gone.js", 404, "api_key"), ("https://h.example/none.js", 200, None)], "url string, status int, body string")
    df = pages(spark, html, html, "")
    found = scan_pages(df, resources).filter("detector = 'Generic API Key'").collect()
    assert sorted((r.page_id, r.path, r.line, r.blob_ord) for r in found) == [(k, "https://h.example/a.js", 2, 0) for k in (1, 2)]
    assert sorted((r.page_id, r.js_blobs) for r in scan_report(df, resources)["summary"].collect()) == [(1, 2), (2, 2), (3, 0)]
    want = detect.keep_first(detect.raw_findings(detect.lines(B.blobs(df, resources))))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, scan_pages(df, resources).select(*want.columns).collect()))


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            where = self.path.partition("?")[0]
            if where == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page?new")
                self.end_headers()
                return
            time.sleep({"/slow.js": 9, "/later.js": 3}.get(where, 0))
            self.send_response(404 if where.startswith("/gone") else 200)
            self.send_header("Server", "nginx/1.2")
            self.end_headers()
            self.wfile.write({"/page": b"<script src=/a.js></script><script src=slow.js></script><script src=gone.js></script>", "/a.js": self.headers["User-Agent"].encode()}.get(where, b"x"))

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_pages_are_fetched(spark, server):
    urls = spark.createDataFrame([(1, f"{server}/moved#top"), (2, f"{server}/gone"), (3, "http://127.0.0.1:1/"), (4, "no address"), (5, f"{server}/slow.js")], "page_id long, url string")
    cfg = ScanConfig(timeout_s=4)
    df, resources = load(spark, urls, cfg=cfg)
    rows = df.collect()
    assert [(r.page_id, r.url, r.headers["Server"][-1]) for r in rows] == [(1, f"{server}/page?new#top", "nginx/1.2")]
    got = {r.url.removeprefix(server): (r.status, r.body) for r in resources.collect()}
    assert got == {"/a.js": (200, cfg.user_agent), "/slow.js": (0, None), "/gone.js": (404, None)}
    assert {r.path for r in B.blobs(df, resources).filter("source = 'external'").collect()} == {f"{server}/a.js"}
    assert tech.fingerprint(df).collect()[0].technologies == ["Nginx"]


def test_a_browser_session_has_a_time_for_each_script(spark, server):
    scripts = spark.createDataFrame([(f"{server}/later.js",), (f"{server}/a.js",)], "script_url string").withColumn("seconds_left", F.lit(0.0))
    status = lambda cfg: {r.url.removeprefix(server): r.status for r in fetch_resources(scripts, cfg).collect()}
    assert status(ScanConfig()) == {"/later.js": 0, "/a.js": 0}
    assert status(ScanConfig(headless=True, script_timeout_s=20)) == {"/later.js": 200, "/a.js": 200}
    assert status(ScanConfig(headless=True, script_timeout_s=1)) == {"/later.js": 0, "/a.js": 200}


def test_command(spark, tmp_path, capsys):
    from glintscan.__main__ import main

    pages(spark, f"<script>api_key='{KEY}'</script>", "plain").write.parquet(f"{tmp_path}/pages")
    assert main([f"{tmp_path}/pages", "--plain", "--output", f"{tmp_path}/out"]) == 0
    printed = capsys.readouterr().out
    assert printed.count("Scanned: ") == 2 and "\nSECRET (2)\n" in printed
    assert len(list((tmp_path / "out").glob("part-*"))) > 0
    assert main([f"{tmp_path}/pages", "--json", "--quiet"]) == 0 and '"js_blobs": 1' in capsys.readouterr().out
    assert main([f"{tmp_path}/no such table"]) == 1 and "Error" in capsys.readouterr().err
    with pytest.raises(ValueError):
        load(spark, spark.createDataFrame([(1, "x")], "page_id long, url string"), cfg=ScanConfig(headless=True))


def test_stream_prints(spark, tmp_path):
    df = pages(spark, f"<script>api_key='{KEY}'</script>")
    df.write.parquet(f"{tmp_path}/in")
    query = scan_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), print_sink(), f"{tmp_path}/c")
    query.awaitTermination()  # the console is the JVM's own, which can't be captured
    assert query.exception() is None and query.lastProgress["numInputRows"] == 1
