"""Scans that are cut at any row and resumed."""

import random

import pytest

from callsight.operators import caps, resume

CALLS = "scan_id string, call_seq long, started_at long, request_body string, response_body string"
SOCKETS = "scan_id string, conn_seq long"


def capture(seed):
    rng = random.Random(seed)
    return [
        (scan, at, 100 + at, *(rng.choice([None, "x" * rng.randint(0, 30)]) for _ in range(2)))
        for scan in ("a", "b")
        for at in range(40)
    ]


@pytest.fixture
def seeds(spark):
    return spark.createDataFrame([("a", "https://a.example/"), ("b", "https://b.example/x"), ("c", "https://c.example/")], "scan_id string, seed_url string")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("cut", [0, 1, 13, 39, 40])
def test_a_cut_scan_keeps_what_the_whole_keeps(spark, seeds, tmp_path, cut):
    rows = capture(cut)
    whole = spark.createDataFrame(rows, CALLS)
    before, after = (spark.createDataFrame(part, CALLS) for part in ([r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]))
    sockets = spark.createDataFrame([("a", at) for at in range(9)], SOCKETS)
    stored = {"calls": caps.cap_calls(before, 25), "sockets": caps.cap_sockets(sockets.where(f"conn_seq < {cut}"), 4)}
    resume.write_state(resume.scan_state(before, seeds, sockets.where(f"conn_seq < {cut}"), max_chars=20), f"{tmp_path}/state")
    state = resume.read_state(spark, f"{tmp_path}/state", seeds)
    later = {"calls": after, "sockets": sockets.where(f"conn_seq >= {cut}")}
    found = resume.restore(stored, later, state, max_calls=25, max_sockets=4)
    assert rows_of(found["calls"]) == rows_of(caps.cap_calls(whole, 25))
    assert rows_of(found["sockets"]) == rows_of(caps.cap_sockets(sockets, 4))
    budget = lambda frame, **kw: caps.body_budget(caps.call_payloads(frame), ["scan_id"], ["call_seq", "part"], "body", 20, 300, **kw)
    both = budget(before).unionByName(resume.resumed_bodies(caps.call_payloads(after), state, 20, 300))
    assert rows_of(both) == rows_of(budget(whole))
    again = resume.scan_state(after, seeds, later["sockets"], earlier=state, max_chars=20)
    once = resume.scan_state(whole, seeds, sockets, max_chars=20)
    assert rows_of(again.select(once.columns)) == rows_of(once)


@pytest.mark.parametrize(
    "row, message",
    [
        (("a", 1, "https://other.example/"), "is for https://other.example/, not https://a.example/"),
        (("a", 2, "https://a.example/"), "is of another version"),
        (("a", None, "https://a.example/"), "is of another version"),
        (("a", 1, None), "does not name a seed URL"),
        (("z", 1, "https://a.example/"), "is of a scan that is not asked for"),
    ],
)
def test_a_wrong_state_is_refused(spark, seeds, tmp_path, row, message):
    state = spark.createDataFrame([(*row, 1, 1, 1, 1, 0, 0)], resume.STATE)
    resume.write_state(state, f"{tmp_path}/state")
    with pytest.raises(resume.WrongState, match=message):
        resume.read_state(spark, f"{tmp_path}/state", seeds)


def test_a_seed_is_compared_in_normal_form(spark, seeds, tmp_path):
    resume.write_state(spark.createDataFrame([("a", 1, "https://A.example:443/#top", 1, 1, 1, 0, 0, 0)], resume.STATE), f"{tmp_path}/state")
    assert resume.read_state(spark, f"{tmp_path}/state", seeds).count() == 1
