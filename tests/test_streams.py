"""Streams that stop, start again, and bring rows in any order."""

import random

import pytest
from pyspark.sql import functions as F

from callsight.operators import caps
from callsight.streaming import live, prefix

FRAMES = "scan_id string, conn_seq long, frame_seq long, at long, payload string"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(prefix.STORE)
    spark.conf.set(prefix.STORE, prefix.ROCKSDB)
    yield
    spark.conf.set(prefix.STORE, before)


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, schema, make, files=1):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    query = live.start_batches(make(source), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return query.recentProgress


def outcome(spark, folder):
    return sorted((tuple(row) for row in spark.read.parquet(f"{folder}/out").drop("batch").collect()), key=str)


def test_frames_are_those_of_the_batch_limit_and_state_is_released(spark, tmp_path):
    rng, folder = random.Random(7), str(tmp_path)
    rows = [("s", c, f, f * 1000, rng.choice(["x", None])) for c in range(12) for f in range(rng.randint(1, 14))]
    expected = caps.cap_frames(spark.createDataFrame(rows, FRAMES), 5)
    rng.shuffle(rows)
    make = lambda frames: prefix.first_frames(frames, 5)
    for part in (rows[:20], rows[20:50]):
        arrive(spark, f"{folder}/in", part, FRAMES)
    assert run(spark, folder, FRAMES, make)[-1].stateOperators[0].numRowsTotal > 0
    for part in (rows[50:], [(None, None, None, 10**13, None)]):  # the query goes on where it stopped
        arrive(spark, f"{folder}/in", part, FRAMES)
    last = run(spark, folder, FRAMES, make)[-1]
    assert outcome(spark, folder) == sorted((tuple(row) for row in expected.collect()), key=str)
    assert last.stateOperators[0].numRowsTotal <= 2  # of the late row alone


def test_budget_is_sticky_in_any_order(spark, tmp_path):
    rng, folder = random.Random(8), str(tmp_path)
    schema = "scan_id string, call_seq long, part int, kind string, body string, at long"
    rows = [(s, c, p, "k", "b" * rng.randint(0, 40), c) for s in "ab" for c in range(25) for p in (0, 1)]
    batch = caps.body_budget(spark.createDataFrame(rows, schema), ["scan_id"], ["call_seq", "part"], "body", 30, 400)
    names = ["scan_id", "call_seq", "body", "truncated"]
    expected = sorted(tuple(row) for row in batch.where("body is not null").select(*names).collect())
    rng.shuffle(rows)
    for part in (rows[:30], rows[30:], [(None, None, None, None, None, 10**13)]):
        arrive(spark, f"{folder}/in", part, schema)
    run(spark, folder, schema, lambda bodies: prefix.budgeted_bodies(bodies, "at", 30, 400))
    found = spark.read.parquet(f"{folder}/out").where("scan_id is not null")
    assert sorted(tuple(row) for row in found.select(*names).collect()) == expected


def test_rows_within_a_limit():
    rows = [((1,), 3), ((2,), 4), ((3,), 9), ((4,), 1)]
    assert prefix.within(rows, 8) == (rows[:2], (3,))  # a smaller row after the break does not come back
    assert prefix.within(rows, 17) == (rows, None)
    assert prefix.within([], 0) == ([], None)


def test_every_request_and_response_is_accounted_for(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path)
    schema = "request_id long, side string, at long"
    asked = {at: 10_000_000 + rng.randint(0, 50_000) for at in range(60)}
    answered = {at: asked.get(at, 10_020_000) + rng.randint(0, 4000) for at in range(20, 80)}
    rows = [(i, "asked", t) for i, t in asked.items()] + [(i, "answered", t) for i, t in answered.items()]
    rng.shuffle(rows)
    late = [(-1, "asked", 10**13), (-2, "answered", 10**13)]  # these two wait on
    source = lambda side, name: (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        .where(F.col("side") == side).select("request_id", F.timestamp_millis("at").alias(name))
    )

    def go():
        pairs = live.paired_calls(source("asked", "requested_at"), source("answered", "answered_at"), wait_ms=2000)
        live.start_pairs(pairs, f"{folder}/out", f"{folder}/state").awaitTermination()
        return {row.outcome: row.rows for row in live.pair_counts(spark, f"{folder}/out").collect()}

    for part in (rows[:50], rows[50:]):
        arrive(spark, f"{folder}/in", part, schema)
    early = go()
    assert set(early) == {"paired"}  # the rest is still waiting
    arrive(spark, f"{folder}/in", late, schema)
    counts = go()
    paired = sum(1 for at in asked if at in answered and answered[at] - asked[at] <= 2000)
    assert counts == {"paired": paired, "unanswered": len(asked) - paired, "late": len(answered) - paired}
    assert early["paired"] == paired


def test_live_percentiles_are_within_their_bound_and_batches_are_put_together(spark, tmp_path):
    rng, folder = random.Random(4), str(tmp_path)
    schema = "scan_id string, method string, url_pattern string, duration_ms long"
    rows = [("s", "GET", rng.choice("ab"), rng.choice([0, 7, rng.randint(0, 300), rng.randint(0, 10**7), None])) for _ in range(900)]
    rows += [("s", "GET", "c", None)]
    make = lambda calls: live.live_latency(calls)
    folders = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if "=" in p.name)
    for part in range(3):
        arrive(spark, f"{folder}/in", rows[part::3], schema)
        source = spark.readStream.schema(schema).parquet(f"{folder}/in")
        live.start_batches(make(source), f"{folder}/out", f"{folder}/state", "update").awaitTermination()
        live.compact_batches(spark, f"{folder}/out", live.latest_latency, keep=1)
        live.compact_batches(spark, f"{folder}/out", live.latest_latency, keep=1)  # nothing left to do
    assert folders() == ["base=1", "batch=2"]
    found = live.latency_percentiles(live.latest_latency(live.read_batches(spark, f"{folder}/out"))).collect()
    assert sorted(row.url_pattern for row in found) == ["a", "b"]
    for row in found:
        values = sorted(v for _, _, p, v in rows if p == row.url_pattern and v is not None)
        exact = [values[-(-len(values) * p // 100) - 1] for p in (50, 95)]
        assert all(abs(got - value) <= value / 256 for got, value in zip((row.p50, row.p95), exact))
        assert row.max == values[-1]
    with pytest.raises(FileNotFoundError):
        live.read_batches(spark, f"{folder}/none")
