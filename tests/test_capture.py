"""The order in which a capture is scoped, limited and masked."""

from pyspark.sql import functions as F

from callsight.operators import resume, scope
from callsight.plans import capture
from callsight.plans.capture import Rules, captured, limit_places
from callsight.plans.report import Report
from callsight.schemas import SCOPE
from callsight.sources import samples

CALLS = (
    "scan_id string, call_seq long, url string, resource_type string, mime_type string, request_headers map<string,string>, "
    "response_headers map<string,string>, request_body string, response_body string, response_body_truncated boolean"
)


def call(seq, request=None, response=None, url="https://a.example/x", kind="xhr", length=None, mime="application/json"):
    return ("s", seq, url, kind, mime, {"cookie": "c"}, {"content-length": length} if length else {}, request, response, False)


def stored(spark, rows, state=None, **rules):
    frame = spark.createDataFrame(rows, CALLS)
    found = captured(frame, Rules(**rules), state).orderBy("call_seq").collect()
    return [(r.call_seq, r.request_body, r.response_body, r.response_body_truncated) for r in found]


def test_budget_breaks_once_and_for_all(spark):
    rows = [call(1, "aaaa", "bbbb"), call(2, "cccc", "d" * 30), call(3, "e", None), call(4, None, "f")]
    got = stored(spark, rows, max_chars=10, total_chars=21)
    assert got == [(1, "aaaa", "bbbb", False), (2, "cccc", None, False), (3, None, None, False), (4, None, None, False)]
    assert stored(spark, rows, max_chars=10, total_chars=22)[1] == (2, "cccc", "d" * 10, True)
    state = spark.createDataFrame([("s", 1, "https://a.example/", 0, 1, 0, 12, 0, 0)], resume.STATE)
    assert stored(spark, rows, state, max_chars=10, total_chars=21, max_calls=3) == [(1, "aaaa", "bbbb", False), (2, None, None, False)]
    assert stored(spark, [], max_calls=3) == []


def test_calls_leave_before_they_are_charged_or_counted(spark):
    scope = spark.createDataFrame([("s", "https://a.example/", [], [], False)], SCOPE)
    rows = [
        call(1, "x" * 9, kind="image"), call(2, "x" * 9, url="https://b.example/"), call(3, "x" * 9), call(4, "y", "n" * 9, mime="text/html"),
        call(5, "z", "n" * 9, length="11"), call(6, "z", "n" * 9, length="odd"), call(7, "late"),
    ]
    got = stored(spark, rows, scope=scope, max_chars=10, total_chars=20, max_calls=4)
    # 6 is charged with 12 characters too many, but its request still fits.
    assert got == [(3, "x" * 9, None, False), (4, "y", None, False), (5, "z", None, False), (6, "z", None, False)]


def test_bodies_are_masked_whole_and_then_cut(spark):
    body = '{"user":1,"email":"someone@example.com"}'
    got = stored(spark, [call(1, body, body)], max_chars=30)
    assert got == [(1, '{"user":1,"email":"[REDACTED]"}'[:30], '{"user":1,"email":"[REDACTED]"}'[:30], True)]
    assert stored(spark, [call(1, body, None)], max_chars=30, mask=False) == [(1, body[:30], None, False)]


def test_limits_are_found_in_the_buckets_where_they_break(spark, monkeypatch):
    rows = [call(n, "x" * (n % 5), "y" * (n % 7)) for n in range(0, 400_000, 997)]
    frame, read, inside = spark.createDataFrame(rows, CALLS), [], capture.running_in
    monkeypatch.setattr(capture, "running_in", lambda sizes, near, *rest: read.append(near.count()) or inside(sizes, near, *rest))
    for max_calls, total in ((150, 1_000), (10_000, 700), (67, 1 << 40), (1_000_000, 1 << 40), (0, 0)):
        taken, last, broke = 0, None, None
        for nth, row in enumerate(rows):
            last = row[1] if nth < max_calls else last
            taken += len(row[7]) + len(row[8])
            if taken > total and broke is None:
                broke = (row[1], taken - len(row[8]) <= total)
        got = limit_places(frame, Rules(max_calls=max_calls, total_chars=total)).first()
        assert (got["_last"], got["_broke"] and tuple(got["_broke"])) == (last, broke)
    # At most a bucket for each limit is put in order; without a limit in reach, none.
    assert max(read) <= 2 and read[3] == 0


def test_calls_are_not_shuffled_by_their_scan(spark):
    rows = spark.createDataFrame([call(1), call(2, url="https://b.example/")], CALLS)
    wide = spark.createDataFrame([("s", "https://a.example/", [], ["/x"], False)], SCOPE)
    for kept in (scope.capture_scope(rows, wide), scope.allowed_hosts(rows, wide), scope.exclude_paths(rows, wide)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_no_original_reaches_a_table_of_the_report(spark, sf):
    calls = samples.calls(spark, sf)
    assert calls.where(F.col("request_body").contains("@example.com")).count() > 0
    tables = Report(calls, samples.seeds(spark), rules=Rules()).tables()
    for name, rows in tables.items():
        assert rows.where(F.to_json(F.struct("*")).rlike("[a-z0-9]+@example.com|sid=[0-9]")).count() == 0, name
