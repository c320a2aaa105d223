from pyspark.sql import functions as F

from callsight.functions import text as tx
from callsight.functions.vendors import is_tracking_host, vendor_of
from tests.test_urls import evaluate


def test_string_formats(spark):
    given = {
        "123e4567-e89b-12d3-a456-426614174000": "uuid",
        "2024-01-02T03:04:05.5Z": "date-time",
        "2024-01-02": "date",
        "03:04": "time",
        "P1Y2M3DT4H5M6S": "duration",
        "PT": None,
        "P": None,
        "https://x.test": "uri",
        "a@b.test": "email",
        "EUR": "currency",
        "€1,234.50": "currency",
        "XYZ": None,
        "2024-01-02\n": None,
        "plain words": None,
    }
    assert evaluate(spark, tx.string_format("u"), list(given)) == list(given.values())


def test_sensitive_values(spark):
    whole = {
        "eyJhbGciOi.J9.x_y": True,
        "me@mail.test": True,
        "123-45-6789": True,
        "+1 (555) 010-9999": True,
        "2024-01-02": False,
        "5550109999": False,
        "aGVsbG8gd29ybGQgMTIzNDU2Nzg5": True,
        "aaaaaaaaaaaaaaaaaaaaaaaa1": False,
        "just-a-slug-of-some-words": False,
        "": False,
    }
    assert evaluate(spark, tx.is_sensitive_scalar("u"), list(whole)) == list(whole.values())
    inside = {"write to me@mail.test now": True, "ssn 123-45-6789.": True, "x123-45-67890": False, "nothing": False}
    assert evaluate(spark, tx.is_sensitive_value("u"), list(inside)) == list(inside.values())
    assert evaluate(spark, tx.is_sensitive_scalar("u"), list(inside)) == [False] * 4


def test_sensitive_names(spark):
    params = {"access_token": True, "apiKey": True, "monkey": False, "sessionId": True, "page": False, "Pin": True, "spin": False}
    assert evaluate(spark, tx.is_sensitive_param("u"), list(params)) == list(params.values())
    keys = {"accessToken": True, "x-api-key": True, "username": False, "Card_Number": True}
    assert evaluate(spark, tx.is_sensitive_key("u"), list(keys)) == list(keys.values())


def test_log_lines(spark):
    given = ["TOKEN=abc PASSWORD_X=1 ok", "Bearer abcdefgh1", "Bearer short", "nothing here"]
    assert evaluate(spark, tx.redact_log_line("u"), given) == [
        "TOKEN=[REDACTED] PASSWORD_X=[REDACTED] ok",
        "Bearer [REDACTED]",
        "Bearer short",
        "nothing here",
    ]


def test_rendering(spark):
    sizes = ["0", "12", "1023", "1024", "1280", "20480", "1572864", "99999999"]
    assert evaluate(spark, tx.format_bytes(F.col("u").cast("bigint")), sizes) == [
        "0 B", "12 B", "1023 B", "1.0 KB", "1.3 KB", "20 KB", "1.5 MB", "95 MB",
    ]
    spans = ["5", "999", "1000", "20150", "1250", "61000", "3599999"]
    assert evaluate(spark, tx.format_duration(F.col("u").cast("bigint")), spans) == [
        "5ms", "999ms", "1.0s", "20.1s", "1.3s", "1m 1s", "59m 60s",
    ]
    assert evaluate(spark, tx.truncate_text("u", 4), ["abcd", "abcde"]) == ["abcd", "abc…"]


def test_headers(spark):
    rows = spark.createDataFrame(
        [({"Cache-Control": "no-store", "AGE": "5", "cf-cache-status": "HIT"},), ({"age": "soon"},), ({},)], "h map<string,string>"
    )
    got = [r["c"] for r in rows.select(tx.cache_info("h").alias("c")).collect()]
    assert (got[0]["control"], got[0]["age"], got[0]["status"]) == ("no-store", 5.0, "HIT")
    assert got[1] is None and got[2] is None


def test_gaps(spark):
    assert evaluate(spark, tx.request_gap("u"), ['{"a":1}', "[1]", "3", "text", None]) == [None, None, "not-json", "not-json", "no-body"]
    assert evaluate(spark, tx.absent_body_gap("u"), ["image/png", "application/json; x", "", "text/html"]) == [
        "binary", "no-body", "no-body", "not-json",
    ]


def test_vendors(spark):
    hosts = ["api.segment.io", "segment.io", "notsegment.io", "api.stripe.com", "x.stripe.com:8443"]
    names = [v and v["name"] for v in evaluate(spark, vendor_of("u"), hosts)]
    assert names == ["Segment", "Segment", None, "Stripe", None]
    assert evaluate(spark, is_tracking_host("u"), hosts) == [True, True, False, False, False]


def test_cache_headers_are_met_as_they_are_read(spark):
    given = [
        None, {}, {"x-cache": "HIT"}, {"X-Cache": "HIT"}, {"X-Cache": None}, {"age": "x"}, {"AGE": "5"}, {"Etag": ""},
        {"etag": None, "ETag": "v"}, {"Vary": None, "vary": "a"}, {"accept": "x-cache"}, {"x": None, "Cache-Control": "no-store"},
    ]
    rows = spark.createDataFrame([(h,) for h in given], "h map<string,string>")
    both = rows.select(F.coalesce(tx.has_cache_info("h"), F.lit(False)).alias("met"), tx.cache_info("h").isNotNull().alias("read")).collect()
    assert [r["met"] for r in both] == [r["read"] for r in both]
    assert [r["met"] for r in both][:4] == [False, False, True, True]
