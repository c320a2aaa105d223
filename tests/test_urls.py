from pyspark.sql import functions as F

from callsight.functions import urls


def evaluate(spark, column, values):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, u string")
    return [r["x"] for r in rows.select("n", column.alias("x")).orderBy("n").collect()]


def test_normalize(spark):
    given = [
        "HTTPS://Shop.Test:443/a/?b=2&a=1&utm_source=n&a=0&ref=x#top",
        "https://shop.test",
        "http://shop.test:8080//x//",
        "https://shop.test/p?q=a%20b&empty",
        "not a url",
        "https://me:pw@shop.test/a/../b/./c",
        "https://shop.test/für?x=ü",
    ]
    assert evaluate(spark, urls.normalize_url("u"), given) == [
        "https://shop.test/a?a=1&a=0&b=2",
        "https://shop.test/",
        "http://shop.test:8080//x",
        "https://shop.test/p?empty=&q=a+b",
        "not a url",
        "https://me:pw@shop.test/b/c",
        "https://shop.test/f%C3%BCr?x=%C3%BC",
    ]


def test_plain_urls_are_kept_as_they_are(spark):
    plain = ["https://shop.test/en/1/a.b_c~d", "ws://shop.test/x", "http://a-b.test/A/-/0"]
    odd = ["https://shop.test/a/", "https://shop.test/./a", "https://shop.test:443/a", "https://Shop.test/a", "https://shop.test//a", "https://shop.test/a\n", "https://shop.test", "https://shop.test/a?"]
    assert evaluate(spark, F.col("u").rlike(urls._PLAIN_URL), plain + odd) == [True] * len(plain) + [False] * len(odd)
    full = urls.normalize_url("u", urls.url_parts("u"))  # given parts, always rebuilt
    assert evaluate(spark, full, plain) == plain
    assert evaluate(spark, urls.normalize_url("u"), plain + odd) == evaluate(spark, full, plain + odd)


def test_query_entries(spark):
    given = ["a=1&b", "=x&&c==", "a%20b=c+d&%zz=%zz", "n=\n"]
    got = evaluate(spark, F.transform(urls.query_entries(F.col("u")), lambda e: F.concat(e["name"], F.lit(">"), e["value"])), given)
    assert got == [["a>1", "b>"], [">x", "c>="], ["a b>c d", "%zz>%zz"], ["n>\n"]]


def test_normalize_is_idempotent(spark):
    given = ["https://a.test/x/?b=1&a=%C3%A9+1", "http://a.test", "https://a.test/ü/"]
    once = evaluate(spark, urls.normalize_url("u"), given)
    assert evaluate(spark, urls.normalize_url("u"), once) == once


def test_pattern(spark):
    given = [
        "https://a.test/api/orders/42",
        "https://a.test/api/orders/42/items/7",
        "https://a.test/1/2/3",
        "https://a.test/f/123e4567-e89b-12d3-a456-426614174000",
        "https://a.test/h/deadbeefdead",
        "https://a.test/h/deadbeef",
        "https://a.test/t/abcdefghijklmnopqrstuvwxyz",
        "https://a.test/t/abcdefghijklmnopqrst_1",
        "https://a.test//x//",
        "https://a.test",
        "nope",
    ]
    assert evaluate(spark, urls.url_pattern("u"), given) == [
        "/api/orders/{id}",
        "/api/orders/{id}/items/{id2}",
        "/{id}/{id2}/{id3}",
        "/f/{id}",
        "/h/{id}",
        "/h/deadbeef",
        "/t/abcdefghijklmnopqrstuvwxyz",
        "/t/{id}",
        "/x",
        "/",
        "nope",
    ]


def test_hosts(spark):
    given = ["https://www.a.test/x", "http://a.test", "https://a.test:8443", "https://b.test", "bad"]
    assert evaluate(spark, urls.same_domain("u", F.lit("https://a.test/")), given) == [True, True, False, False, False]
    private = ["http://localhost:3000", "127.0.0.1", "10.1.2.3", "http://192.168.0.1/", "172.16.0.1", "172.32.0.1", "x.local", "a.test"]
    assert evaluate(spark, urls.is_private_host("u"), private) == [True, True, True, True, True, False, True, False]


def test_paths(spark):
    patterns = ["/api/orders/{id}/items", "/api/orders", "/{id}/x", "", "/a/{id}"]
    assert evaluate(spark, urls.collection_root("u"), patterns) == ["/api/orders", "/api/orders", "/{id}/x", "/", "/a"]
    assert evaluate(spark, urls.is_item("u"), patterns) == [False, False, False, False, True]
    assert evaluate(spark, urls.has_param("u"), patterns) == [True, False, True, False, True]
    assert evaluate(spark, urls.operation_id(F.lit("GET"), "u"), patterns)[0] == "getapi_orders_by_id_items"


def test_links(spark):
    hrefs = ["/a", "b?x=1", "//o.test/c", "?q=2", "https://z.test/", "../up", "mailto:a@b.c"]
    base = F.lit("https://a.test/dir/page?y=1")
    resolved = evaluate(spark, urls.resolve_link("u", base), hrefs)
    assert evaluate(spark, urls.serialize_url("u"), resolved) == [
        "https://a.test/a",
        "https://a.test/dir/b?x=1",
        "https://o.test/c",
        "https://a.test/dir/page?q=2",
        "https://z.test/",
        "https://a.test/up",
        "mailto:a@b.c",
    ]
    html = ["""<a href="/x">1</a><A class=q HREF='/y'>2</A><a href="#z">3</a><a href="/w#f">4</a>"""]
    assert evaluate(spark, urls.link_targets("u"), html) == [["/x", "/y"]]


def test_page_label(spark):
    given = ["https://a.test/p?x=1", "https://b.test/p", "odd"]
    assert evaluate(spark, urls.page_label("u", F.lit("https://a.test/")), given) == ["/p?x=1", "b.test/p", "odd"]


def test_plain_queries_are_ordered_without_decoding(spark):
    given = [
        "https://shop.test/a?b=2&a=1&utm_source=n&ref=x",
        "https://shop.test/a?a.b=1&a=2&a-b=3",  # a name orders before the names it begins
        "https://shop.test/a?b=2&a=9&a=1",  # a name that comes twice keeps its order
        "https://shop.test/a?utm_x=1",
        "https://shop.test/a?reference=1&UTM_y=2&xref=3",
        "https://shop.test/a?b=%61&a=+",
        "https://shop.test/a?b&=1&a=1=2",
    ]
    assert evaluate(spark, urls.normalize_url("u"), given) == [
        "https://shop.test/a?a=1&b=2",
        "https://shop.test/a?a=2&a-b=3&a.b=1",
        "https://shop.test/a?a=9&a=1&b=2",
        "https://shop.test/a",
        "https://shop.test/a?reference=1&xref=3",
        "https://shop.test/a?a=+&b=a",
        "https://shop.test/a?=1&a=1%3D2&b=",
    ]
    # Nothing of a plain query is decoded: no field is opened where the names differ.
    assert evaluate(spark, F.col("u").rlike(urls._PLAIN_QUERY), ["a=1&b=", "a=%41", "a", "=1", "a=1&&b=2"]) == [True] + [False] * 4
