import json

import pytest
from pyspark.sql import functions as F

from callsight.operators import diff, findings, graph, manifest, openapi, scope, web
from callsight.operators import endpoints as ep
from callsight.operators import signals as sg
from callsight.operators import views as vw
from callsight.plans.report import Report
from callsight.schemas import CALLS
from callsight.sinks import tables as sinks
from callsight.sources import capture, snapshots

SITE = "https://shop.test"


def call(scan, seq, method, url, status=200, body=None, request=None, headers=None, page="https://shop.test/", mime="application/json", ms=10):
    return (scan, seq, method, url, status, mime, "fetch", headers or {}, request, {"X-Frame-Options": "DENY"}, body, False, None, None, 0, ms, page)


ROWS = [
    call("before", 1, "get", f"{SITE}/api/users/1?page=1&token=a", body='{"id":1,"email":"a@b.test","kind":"x"}'),
    call("before", 2, "GET", f"{SITE}/api/users/2?page=2&token=b", body='{"id":2,"email":"c@d.test","kind":"y"}', ms=30),
    call("before", 3, "GET", f"{SITE}/api/users/3", 500, body='{"error":"Stack Trace follows"}', ms=20),
    call("before", 4, "POST", "https://api.segment.io/v1/t", request='{"event":"e"}', mime=""),
    call("before", 5, "GET", f"{SITE}/old"),
    call("after", 1, "GET", f"{SITE}/api/users/1?sort=up", body='{"id":1,"email":null,"kind":"z"}', headers={"Cookie": "s"}),
    call("after", 2, "GET", f"{SITE}/api/users/2", body='{"id":"2","kind":"x"}'),
    call("after", 3, "POST", "https://api.segment.io/v1/t", request='{"event":"e","user":1}', mime=""),
    call("after", 4, "PUT", f"{SITE}/api/users/9", 404, page="https://other.test/p"),
]


@pytest.fixture(scope="module")
def report(spark):
    calls = spark.createDataFrame(ROWS, CALLS)
    seeds = spark.createDataFrame([("before", SITE), ("after", SITE)], "scan_id string, seed_url string")
    return Report(calls, seeds)


def by_id(rows, scan):
    return {r["id"]: r for r in rows.where(F.col("scan_id") == scan).collect()}


def test_calls_are_keyed_once(report):
    assert report.rules is None and report.calls.inputFiles()  # settled: no table parses a URL again
    assert report.calls is report.calls and report.calls.count() == len(ROWS)


def test_endpoints(report):
    got = by_id(report.endpoints, "before")
    users = got["GET /api/users/{id}"]
    assert (users["count"], users["status_codes"], users["category"]) == (3, [200, 500], "data-fetching")
    assert (users["timing"]["p50"], users["timing"]["p95"], users["timing"]["max"]) == (20, 30, 30)
    assert users["request_body_sample"] is None and users["response_body_sample"].startswith('{"id":1')
    assert users["request_gap"] == "no-body" and users["response_gap"] is None
    assert got["POST /v1/t"]["category"] == "analytics"
    assert by_id(report.endpoints, "after")["PUT /api/users/{id}"]["category"] == "mutations"


def test_params_and_vendor(report):
    params = {r["name"]: r["sample_values"] for r in report.params.where("scan_id = 'before'").collect()}
    assert params == {"page": ["1", "2"], "token": ["[REDACTED]"]}
    vendor = report.vendors.where("scan_id = 'after'").first()
    assert (vendor["vendor"], vendor["payload_keys"]) == ("Segment", ["event", "user"])


def test_findings(report):
    got = {(r["scan_id"], r["kind"]) for r in report.findings.collect()}
    assert ("before", "unauthenticated") in got and ("after", "unauthenticated") in got
    assert ("before", "pii") in got and ("before", "verbose-error") in got
    assert ("after", "inconsistent-shape") in got and ("before", "inconsistent-shape") not in got
    missing = report.findings.where("kind = 'missing-security-header' and scan_id = 'before'")
    assert missing.count() == 5 and missing.where(F.col("detail").startswith("x-frame-options")).count() == 0


def test_resources(report):
    got = {r["path"]: (r["methods"], r["missing_methods"]) for r in report.resources.where("scan_id = 'after'").collect()}
    assert got["/api/users/{id}"] == (["GET", "PUT"], ["PATCH", "DELETE"])
    assert got["/v1/t"] == (["POST"], [])


def snapshots_of(report):
    tables = report.tables("endpoints", "params", "shapes", "errors", "vendors", "operations", "introspection")
    return diff.snapshot(tables, "before"), diff.snapshot(tables, "after")


def test_changes(report):
    got = {r["id"]: r for r in diff.changes(*snapshots_of(report)).collect()}
    assert (got["GET /old"]["kind"], got["GET /old"]["breaking"]) == ("removed", True)
    assert (got["PUT /api/users/{id}"]["kind"], got["PUT /api/users/{id}"]["breaking"]) == ("added", False)
    users = got["GET /api/users/{id}"]
    assert users["breaking"] and users["details"] == [
        "status codes 200, 500 → 200",
        "response id: type integer → integer|string",
        "response kind: enum values removed: \"y\"",
        "response kind: enum values added: \"z\"",
        "new query parameters: sort",
        "query parameters not observed this time: page, token",
    ] or set(users["details"]) >= {"response id: type integer → integer|string", "new query parameters: sort"}
    tracked = got["POST /v1/t"]
    assert not tracked["breaking"] and "vendor payload keys added: user" in tracked["details"]


def test_no_change_against_itself(report):
    before, _ = snapshots_of(report)
    assert diff.changes(before, before).count() == 0
    assert diff.gate(diff.changes(before, before)).first()["has_changes"] is False


def test_views(report):
    rows = report.endpoints
    assert [r["id"] for r in vw.slowest_endpoints(rows, 1).orderBy("scan_id").collect()][1] == "GET /api/users/{id}"
    found = vw.endpoint_filter(rows, "SEGMENT", values=report.values, params=report.params)
    assert {r["id"] for r in found.collect()} == {"POST /v1/t"}
    assert {r["scan_id"] for r in vw.endpoint_filter(rows, "sort", params=report.params).collect()} == {"after"}
    shared = vw.share_safe({"endpoints": rows, "params": report.params})
    assert not {"request_headers", "response_body_sample", "sample_values"} & {c for t in shared.values() for c in t.columns}


def test_graph(report):
    parts = graph.request_graph(report.endpoints, report.values, report.seeds, max_pages=1)
    pages = {r["scan_id"]: (r["label"], r["requests"]) for r in parts["pages"].collect()}
    assert pages == {"before": ("/", 3), "after": ("/", 2)}
    assert {r["scan_id"]: r["omitted_pages"] for r in parts["omitted"].collect()} == {"before": 0, "after": 1}


def test_openapi_document_is_json(report):
    operations = openapi.openapi_operations(report.endpoints, report.params, report.shapes, report.errors, report.vendors)
    fragments = openapi.openapi_document(openapi.openapi_paths(operations), operations, report.values, report.seeds)
    rows = fragments.where("scan_id = 'before'").orderBy("part", "at").collect()
    document = json.loads("".join(r["text"] for r in rows))
    assert set(document["paths"]) == {"/api/users/{id}", "/old", "/v1/t"}
    operation = document["paths"]["/api/users/{id}"]["get"]
    assert [p["name"] for p in operation["parameters"]] == ["id", "page", "token"]
    schema = operation["responses"]["200"]["content"]["application/json"]["schema"]
    assert schema["properties"]["email"] == {"type": "string", "format": "email"}
    assert sorted(schema["required"]) == ["email", "id", "kind"] and schema["properties"]["id"]["maximum"] == 2
    assert operation["responses"]["500"]["content"]["application/json"]["schema"]["properties"]["error"] == {"type": "string"}


def test_openapi_first_operation_wins(report, spark):
    operations = spark.createDataFrame(
        [("s", "GET", "x", "b", '{"n":1}'), ("s", "GET", "/x", "a", '{"n":2}'), ("s", "POST", "/x", "c", '{"n":3}')],
        "scan_id string, method string, url_pattern string, category string, operation string",
    )
    rows = openapi.openapi_paths(operations).collect()
    assert [(r["path"], r["path_item"], r["operations"]) for r in rows] == [("/x", '{"get":{"n":2},"post":{"n":3}}', 2)]
    seeds = spark.createDataFrame([("s", "https://a.test/")], "scan_id string, seed_url string")
    fragments = openapi.openapi_document(openapi.openapi_paths(operations), operations, report.values, seeds)
    document = json.loads("".join(r["text"] for r in fragments.where("scan_id = 's'").orderBy("part", "at").collect()))
    assert document["servers"] == [{"url": "https://a.test/"}] and document["tags"] == [{"name": "a"}, {"name": "c"}]


def test_signals(report, spark):
    rows = sg.signals(report.endpoints, report.values)
    assert sg.schema_violations(rows) == [] and rows.count() == report.endpoints.count()
    assert sg.schema_violations(rows.withColumn("host", F.lit("x"))) == ['unexpected field "host"']
    good = '{"version":1,"endpointCount":0,"signals":[{"method":"GET"}]}'
    payloads = spark.createDataFrame([(1, good), (2, "[]"), (3, '{"signals":{}}'), (4, '{"signals":[3,{"a":[]}]}')], "id int, payload string")
    got = sorted((r["id"], r["problem"]) for r in sg.payload_violations(payloads).collect())
    assert got == [
        (2, "$: the payload must be a JSON object"), (3, "$.signals: must be an array"),
        (4, "$.signals[0]: must be an object"), (4, "$.signals[1].a: must be a scalar, not a nested value"), (4, '$.signals[1]: unexpected field "a"'),
    ]


def test_scope(spark):
    table = spark.createDataFrame(
        [("s", "https://www.shop.test", ["api.shop.test:8443", "https://cdn.test/x"], ["admin", "*.pdf", "/"], False)],
        "scan_id string, seed_url string, include_hosts array<string>, exclude_paths array<string>, include_third_party boolean",
    )
    urls = ["https://shop.test/a", "https://api.shop.test:8443/x", "https://api.shop.test/x", "http://cdn.test/", "https://shop.test/admin/1",
            "https://shop.test/administrator", "https://shop.test/f/a.pdf", "bad"]
    rows = spark.createDataFrame([("s", u) for u in urls], "scan_id string, url string")
    assert {r["url"] for r in scope.in_scope(rows, table).collect()} == {urls[0], urls[1], urls[3], urls[5]}
    assert {r["url"] for r in scope.exclude_paths(rows, table).collect()} == set(urls) - {urls[4], urls[6]}
    targets = spark.createDataFrame([(u,) for u in ("https://a.test", "ftp://a.test", "http://10.0.0.1", "x")], "seed_url string")
    assert [r["refused"] for r in scope.target_check(targets).collect()] == [
        None, "only http and https can be scanned", "private or local address", "invalid URL",
    ]


ROBOTS = "User-agent: *\nDisallow: /a # no\nAllow: /a/b\nDisallow:\n\nUser-agent: Bot\nUser-agent: other\nDisallow: /\nCrawl-delay: 1.5\nSitemap: /m"


def test_robots(spark):
    robots = spark.createDataFrame([("https://a.test", ROBOTS)], "origin string, raw string")
    urls = spark.createDataFrame([(u,) for u in ("https://a.test/a/x", "https://a.test/a/b/c", "https://a.test/z", "https://b.test/a")], "url string")
    verdict = lambda agent: [r["allowed"] for r in web.robots_filter(urls, robots, agent).orderBy("url").collect()]
    assert verdict("*") == [True, False, True, True]
    assert verdict("MyBot/2") == [False, False, False, True]
    settings = web.robots_settings(robots).first()
    assert settings["crawl_delay_seconds"] == 1.5 and settings["sitemaps"] == ["/m"]


def test_crawl(spark):
    page = lambda name, *links: (f"https://a.test/{name}", "".join(f'<a href="{x}">.</a>' for x in links))
    pages = spark.createDataFrame(
        [page("", "/one", "/two?utm_source=x"), page("one", "/three", "/"), page("two", "/four"), page("three", "/five"), page("four")],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("s", "https://a.test")], "scan_id string, seed_url string")
    walk = lambda **kw: [r["url"][15:] for r in web.reachable_pages(seeds, web.link_table(pages), **kw)[0].orderBy("depth", "order").collect()]
    assert walk(max_depth=2, max_pages=None) == ["", "one", "two", "three", "four"]
    assert walk(max_depth=2, max_pages=3) == ["", "one", "two"]
    assert walk(max_depth=0, max_pages=None) == [""]
    assert walk() == ["", "one", "two", "three", "four", "five"]


def test_crawl_robots(spark):
    """Rules judge the link as written; refused pages behind the last visited one are not reported."""
    page = lambda name, *links: (f"https://a.test/{name}", "".join(f'<a href="{x}">.</a>' for x in links))
    pages = spark.createDataFrame([page("", "/en/", "/one", "/no/1", "/two", "/no/2"), page("one"), page("two")], "url string, html string")
    seeds = spark.createDataFrame([("s", "https://a.test")], "scan_id string, seed_url string")
    robots = spark.createDataFrame([("https://a.test", "User-agent: *\nDisallow: /en/\nDisallow: /no/")], "origin string, raw string")
    paths = lambda rows: sorted(r["url"][15:] for r in rows.collect())
    seen = {}
    for most in (2, 3, None):
        visited, blocked = web.reachable_pages(seeds, web.link_table(pages), max_pages=most, robots=robots)
        seen[most] = paths(visited), paths(blocked)
    assert seen[2] == (["", "one"], ["en"])
    assert seen[3] == (["", "one", "two"], ["en", "no/1"])
    assert seen[None] == (["", "one", "two"], ["en", "no/1", "no/2"])


def test_technologies(spark):
    rows = spark.createDataFrame(
        [("s", 2, "u", {"server": "nginx"}, '<meta name="generator" content="Hugo 1">', ["laravel_session_x"], ["/jquery-3.1.min.js"]),
         ("s", 1, "u", {"cf-ray": "1"}, "wp-content", [], [])],
        "scan_id string, page_seq bigint, url string, headers map<string,string>, html string, cookies array<string>, scripts array<string>",
    )
    got = {r["name"]: (r["category"], r["evidence"]) for r in web.detect_technologies(rows).collect()}
    assert got == {
        "nginx": ("web-server", "server: nginx"), "Hugo 1": ("generator", "meta: generator"), "Laravel": ("framework", "cookie: laravel_session"),
        "jQuery": ("ui-library", "script: jquery"), "Cloudflare": ("cdn", "header: cf-ray"), "WordPress": ("cms", "html: wp-content"),
    }


SNAPSHOT = {
    "schemaVersion": 1,
    "meta": {"seedUrl": SITE},
    "endpoints": [
        {"id": "GET /x", "method": "GET", "urlPattern": "/x", "category": "data-fetching", "count": 1, "statusCodes": [200],
         "queryParams": [{"name": "q", "sampleValues": []}], "requestBodySchema": None,
         "responseSchema": {"type": "object", "required": ["a"], "properties": {
             "a": {"type": "string", "enum": ["p", "q"]}, "l": {"type": "array", "items": {"oneOf": [{"type": "integer", "minimum": 1, "maximum": 2}, {"type": "string"}]}}}}}
    ],
    "webSockets": [{"url": "wss://shop.test/s", "frameCount": 3, "sentCount": 1, "receivedCount": 2}],
}


def test_stored_reports(spark, tmp_path):
    changed = json.loads(json.dumps(SNAPSHOT))
    del changed["endpoints"][0]["responseSchema"]["properties"]["a"]
    changed["webSockets"] = []
    read = lambda name, text: (tmp_path / name).write_text(text) and snapshots.read_snapshot(spark, str(tmp_path / name))
    before = snapshots.snapshot_tables(read("b.json", json.dumps(SNAPSHOT)))
    after = snapshots.snapshot_tables(read("a.json", json.dumps(changed)))
    shapes = {".".join(r["path"]): (r["types"], r["enum"]) for r in before.shapes.collect()}
    assert shapes == {"": (["object"], None), "a": (["string"], ["p", "q"]), "l": (["array"], None), "l.[]": (["integer", "string"], None)}
    got = {r["id"]: (r["kind"], r["breaking"], r["details"]) for r in diff.changes(before, after).collect()}
    assert got == {
        "GET /x": ("changed", True, ["response field removed: a"]),
        "WS wss://shop.test/s": ("removed", True, ["not observed in this scan (was 3 frame(s))"]),
    }
    for bad, message in (("{", "not valid JSON"), ("{}", "'meta' and 'endpoints'"), ('{"schemaVersion":2,"meta":{},"endpoints":[]}', "found 2")):
        with pytest.raises(Exception, match=message):
            read("bad.json", bad).collect()


def test_written_tables(report, spark, tmp_path):
    tables = report.tables("endpoints", "params")
    sinks.write_report(tables, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/params")).count() == report.params.count()
    for name in ("2024-01", "2024-02"):
        sinks.write_snapshot(tables, str(tmp_path / "snap"), name)
    latest = sinks.read_snapshot_tables(spark, str(tmp_path / "snap"), ["endpoints"])
    assert latest["endpoints"].count() == report.endpoints.count()
    sinks.write_signals(sg.signals(report.endpoints, report.values), str(tmp_path / "signals"))
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_text("a")
    (tmp_path / "files/b.txt").write_text("b")
    sinks.write_manifest(spark, str(tmp_path / "files"), str(tmp_path / "manifest"))
    (tmp_path / "files/b.txt").write_text("changed")
    listed = sinks.read_manifest(spark, str(tmp_path / "manifest"))
    digests = manifest.file_digests(manifest.read_artifacts(spark, str(tmp_path / "files")))
    assert {r["file"]: r["status"] for r in manifest.verify_manifest(listed, digests).collect()} == {"a.txt": "ok", "b.txt": "mismatch"}


def test_capture_rules(spark):
    failed = capture.failed_calls(spark.createDataFrame([("s", 1, "get", f"{SITE}/a#x", "fetch", {}, 0, 5, "raw page#")],
        "scan_id string, call_seq bigint, method string, url string, resource_type string, request_headers map<string,string>, started_at bigint, duration_ms bigint, triggered_by string"))
    row = ep.keyed_calls(failed).first()
    assert (row["method"], row["url"], row["status"], row["triggered_by"]) == ("GET", f"{SITE}/a", 0, "raw page#")
    raw = spark.createDataFrame([("s", 1, 1, "sent", "é", None, 0), ("s", 1, 2, "sent", None, bytearray(b"\x00\x01"), 0)],
        "scan_id string, conn_seq bigint, frame_seq bigint, direction string, text string, data binary, at bigint")
    got = [(r["type"], r["payload"], r["size"]) for r in capture.frames_from_raw(raw).orderBy("frame_seq").collect()]
    assert got == [("text", "é", 2), ("binary", "AAE=", 2)]
    gate = spark.createDataFrame([("b", "application/json", "10"), ("b", "text/html", "1"), ("b", "application/json", "99")], "b string, m string, l string")
    kept = [r[0] for r in gate.select(capture.gated_response_body(F.col("b"), F.col("m"), F.col("l"), 50)).collect()]
    assert kept == ["b", None, None]
