import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from callsight.operators import caps
from callsight.operators.running import with_pace, with_running
from callsight.operators.selection import nearest_rank


def rank(values, p):
    return sorted(values)[math.ceil(p * len(values)) - 1]


def test_nearest_rank_matches_sorting(spark):
    rng = random.Random(7)
    groups = {f"g{n}": [rng.randint(-5, 10 ** rng.randint(1, 9)) for _ in range(n)] for n in (1, 2, 3, 19, 20, 21, 100, 400)}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v bigint")
    got = {r["k"]: (r["p50"], r["p95"], r["max"]) for r in nearest_rank(rows, ["k"], "v").collect()}
    assert got == {k: (rank(vs, 0.5), rank(vs, 0.95), max(vs)) for k, vs in groups.items()}


def test_one_value_holds_most_rows(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 4600, 7).otherwise(F.col("id")).alias("v"))
    got = nearest_rank(rows, ["k"], "v").first()
    assert (got["p50"], got["p95"], got["max"]) == (7, 4749, 4999)


def test_running_matches_window(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("s"), (F.col("id") * 7 % 11).alias("v"))
    out = with_running(rows, ["k"], ["s"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, width=100)
    w = Window.partitionBy("k").orderBy("s")
    plain = rows.withColumn("total", F.sum("v").over(w)).withColumn("top", F.max("v").over(w))
    assert out.select("k", "s", "total", "top").exceptAll(plain.select("k", "s", "total", "top")).count() == 0
    start = spark.createDataFrame([(0, 1000, 99), (1, -5, 0)], "k bigint, total bigint, top bigint")
    later = with_running(rows, ["k"], ["s"], {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}, width=100, start=start)
    moved = plain.withColumns(
        {
            "total": F.col("total") + F.expr("CASE k WHEN 0 THEN 1000 WHEN 1 THEN -5 ELSE 0 END"),
            "top": F.greatest("top", F.expr("CASE k WHEN 0 THEN 99 ELSE 0 END")),
        }
    )
    assert later.select("k", "s", "total", "top").exceptAll(moved.select("k", "s", "total", "top")).count() == 0


def test_pace_matches_windows(spark):
    rng = random.Random(9)
    starts = [(rng.choice("ab"), rng.randint(-500, 5000), at) for at in range(400)]
    rows = spark.createDataFrame(starts, "k string, t bigint, s bigint")
    got = {row.s: (row.previous_at, row.paced_at) for row in with_pace(rows, ["k"], "t", "s", 30, width=64).collect()}
    for key in "ab":
        last, free = None, None
        for _, t, s in sorted((k, t, s) for k, t, s in starts if k == key):
            free = t if free is None else max(t, free + 30)
            assert got[s] == (last, free)
            last = t
    assert len(got) == 400
    assert with_pace(rows.limit(0), ["k"], "t", "s", 30).count() == 0


def test_body_budget_is_sticky(spark):
    sizes = [30, 50, 40, 1, 200]
    rows = spark.createDataFrame([("s", n, 0, "x" * size) for n, size in enumerate(sizes)], "scan_id string, call_seq bigint, part int, body string")
    kept = caps.body_budget(rows, ["scan_id"], ["call_seq", "part"], "body", max_chars=45, total_chars=100)
    got = [(r["body"] and len(r["body"]), r["truncated"]) for r in kept.orderBy("call_seq").collect()]
    assert got == [(30, False), (45, True), (None, False), (None, False), (None, False)]


def test_caps(spark):
    frames = spark.createDataFrame(
        [("s", c, f, "sent" if f % 2 else "received") for c in (1, 2) for f in range(c * 3)], "scan_id string, conn_seq bigint, frame_seq bigint, direction string"
    )
    assert [r[0] for r in caps.cap_frames(frames, 2).orderBy("conn_seq", "frame_seq").select("frame_seq").collect()] == [0, 1, 0, 1]
    counters = {r["conn_seq"]: (r["frame_count"], r["sent_count"], r["frames_truncated"]) for r in caps.frame_counters(frames, 3).collect()}
    assert counters == {1: (3, 1, False), 2: (6, 3, True)}


def test_pacing(spark):
    rows = spark.createDataFrame([("o", 0, 1), ("o", 10, 2), ("o", 12, 3), ("o", 500, 4)], "origin string, started_at bigint, call_seq bigint")
    got = [(r["gap_ms"], r["too_soon"], r["paced_at"]) for r in caps.request_pacing(rows, 100).orderBy("call_seq").collect()]
    assert got == [(None, False, 0), (10, True, 100), (2, True, 200), (488, False, 500)]
