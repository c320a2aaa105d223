"""Keying of calls: URLs in compiled steps, pages after they are counted."""

from pyspark.sql import functions as F

from callsight.functions import urls
from callsight.operators import endpoints as ep
from callsight.operators import graph

CALL = (
    "scan_id string, call_seq bigint, method string, url string, status int, mime_type string, request_headers map<string,string>,"
    " request_body string, response_headers map<string,string>, response_body string, duration_ms bigint, triggered_by string"
)
PAGE = "https://shop.test/p"


def keyed(spark, *calls):
    """Keyed calls of ``(url, status, page)``."""
    rows = [("s", n, "GET", url, status, "", {}, None, {}, None, 1, page) for n, (url, status, page) in enumerate(calls)]
    return ep.keyed_calls(spark.createDataFrame(rows, CALL))


def test_pages_are_normalised_once_they_are_counted(spark):
    url = "https://api.test/a"
    calls = keyed(spark, (url, 200, f"{PAGE}/?utm_source=x"), (url, 200, PAGE), (url, 0, f"{PAGE}/"), (url, None, None), (url, 204, "no url"))
    # As recorded: no page is parsed for each of its calls.
    assert [r[0] for r in calls.orderBy("call_seq").select("triggered_by").collect()] == [f"{PAGE}/?utm_source=x", PAGE, f"{PAGE}/", None, "no url"]
    pages = ep.endpoint_values(calls).where("kind = 'page'").orderBy("first_seq").select("value", "first_seq", "calls")
    assert [tuple(r) for r in pages.collect()] == [(PAGE, 0, 2), (f"{PAGE}/", 2, 1), ("no url", 4, 1)]


def test_steps_as_columns_agree_with_one_expression(spark):
    given = [
        "https://a.test/api/orders/42/items/7?b=2&a=1&utm_source=x", "https://a.test/1/2/3", "HTTPS://A.Test:443//x/../9/?a=1&a=0", "https://a.test/f?a=1&&a=2&c",
        "https://me:pw@a.test/%0A/5?q=a%20b", "https://a.test/a\n", "not a url", "", None, "https://a.test", "https://a.test/é/12/é/13?é=1", "wss://a.test:80/1?", "http://a.test/12\r",
    ]
    steps = keyed(spark, *[(u, 200, None) for u in given]).orderBy("call_seq").select("url", "host", "path", "origin", "url_pattern")
    whole = spark.createDataFrame([(n, u) for n, u in enumerate(given)], "n int, url string").orderBy("n").select(
        urls.normalize_url("url"), urls.url_host("url"), urls.url_path("url"), urls.url_origin("url"), F.coalesce(urls.url_pattern("url"), F.lit(""))
    )
    assert [tuple(r) for r in steps.collect()] == [tuple(r) for r in whole.collect()]
    compiled = steps_before_keys(keyed(spark, (given[0], 200, None)))
    assert "AS _fields" in compiled and "lambda" not in compiled


def steps_before_keys(calls):
    """The columns that a keyed call is put together from, without paths that must be cleaned."""
    plan = calls._jdf.queryExecution().analyzed().toString()
    return "\n".join(line for line in plan.splitlines() if "AS _fields" in line or "AS _marked" in line)


def test_paths_with_identifiers(spark):
    given = [
        "/api/orders/42", "/api/orders/42/items/7", "/1/2/3", "/1/a/2/b/3/4", "/a//5/", "/", "", "/x\x01/5", "/x\x01y", "/5\n/6\n", "/a/5\r", "/a/5\x85", "/a/5 /6", "5/6",
        "/f/deadbeefdead/x", "/{id}/7", "/$1/7", "/a\\1/7/8",
    ]
    rows = spark.createDataFrame([(n, p) for n, p in enumerate(given)], "n int, p string").orderBy("n")
    assert [r[0] for r in rows.select(urls.path_pattern(F.col("p"))).collect()] == [
        "/api/orders/{id}", "/api/orders/{id}/items/{id2}", "/{id}/{id2}/{id3}", "/{id}/a/{id2}/b/{id3}/{id4}", "/a/{id}", "/", "", "/x\x01/{id}", "/x\x01y", "/5\n/{id}\n", "/a/{id}\r", "/a/{id}\x85", "/a/5\u2028/{id}", "5/{id}", "/f/{id}/x", "/{id}/{id}", "/$1/{id}", "/a\\1/{id}/{id2}",
    ]


def test_graph_labels_its_pages_once(spark):
    ends = spark.createDataFrame([("s", "GET", "/a", 3), ("s", "GET", "/b", 9)], "scan_id string, method string, url_pattern string, count bigint")
    rows = [("s", "GET", path, "page", f"{PAGE}/{n}") for n, path in enumerate(["/a", "/b", "/a"])] + [("s", "GET", "/a", "page", f"{PAGE}/1")]
    values = spark.createDataFrame(rows, "scan_id string, method string, url_pattern string, kind string, value string")
    seeds = spark.createDataFrame([("s", "https://shop.test/")], "scan_id string, seed_url string")
    found = graph.request_graph(ends, values, seeds, max_pages=2)
    lines = graph.mermaid_lines(found)
    assert all("/settled-" in path for path in found["pages"].inputFiles()) and found["pages"].inputFiles()
    got = [r["line"] for r in lines.orderBy("part", "rank", "rank2").collect()]
    assert got == ["flowchart LR", '  p0["/p/1"]', '  p1["/p/0"]', '  e0["GET /b"]', '  e1["GET /a"]', "  p0 --> e0", "  p0 --> e1", "  p1 --> e1"]
    assert [tuple(r) for r in found["omitted"].select("omitted_pages", "omitted_requests").collect()] == [(1, 0)]
