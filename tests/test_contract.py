"""The contract, on sound reports and on broken rows."""

import pytest

from callsight.operators.contract import CONTRACT, Rule, report_violations, violations
from callsight.plans.report import Report
from callsight.sources import samples

SCHEMA = (
    "id string, n int, tags array<string>, size struct<p50:int,p95:int>, heads map<string,string>, list array<struct<kind:string,marks:array<int>>>"
)
RULES = {
    "id": Rule(required=True, filled=True, pattern="^[a-z]"),
    "n": Rule(least=1, most=9),
    "tags": Rule(required=True, filled=True, unique=True, ordered=True, items=Rule(required=True, one_of=("a", "b"))),
    "size": Rule(fields={"p50": Rule(required=True), "p95": Rule(least=0)}, rising=("p50", "p95")),
    "heads": Rule(values=Rule(required=True, filled=True)),
    "list": Rule(items=Rule(required=True, fields={"kind": Rule(required=True, one_of=("x",)), "marks": Rule(items=Rule(least=0))})),
}
GOOD = ("a1", 5, ["a", "b"], (1, 2), {"k": "v"}, [("x", [0, 1]), ("x", None)])


@pytest.mark.parametrize(
    "place, value, expected",
    [
        (None, None, set()),
        (0, None, {("id", "is missing")}),
        (0, "", {("id", "is empty"), ("id", "is not of the required form")}),
        (1, None, set()),
        (1, 0, {("n", "is less than 1")}),
        (1, 10, {("n", "is more than 9")}),
        (2, None, {("tags", "is missing")}),
        (2, [], {("tags", "is empty")}),
        (2, ["b", "a"], {("tags", "is not in order")}),
        (2, ["a", "a", None], {("tags", "repeats an element"), ("tags[2]", "is missing")}),
        (2, ["a", "z"], {("tags[1]", "is not one of the known values")}),
        (3, None, set()),
        (3, (None, -1), {("size.p50", "is missing"), ("size.p95", "is less than 0")}),
        (3, (3, 2), {("size", "has p50 above p95")}),
        (4, {"k": "v", "m": ""}, {("heads.m", "is empty")}),
        (4, {"o": None}, {("heads.o", "is missing")}),
        (5, [None], {("list[0]", "is missing")}),
        (5, [("x", []), ("y", [0, -1]), (None, None)], {("list[1].kind", "is not one of the known values"), ("list[1].marks[1]", "is less than 0"), ("list[2].kind", "is missing")}),
    ],
)
def test_every_breach_is_told_with_its_path(spark, place, value, expected):
    row = list(GOOD)
    if place is not None:
        row[place] = value
    found = violations(spark.createDataFrame([tuple(row)], SCHEMA), "t", RULES).collect()
    assert {(r.path, r.problem) for r in found} == expected and len(found) == len(expected)


def test_a_missing_column_is_a_breach(spark):
    rows = spark.createDataFrame([("a1",)], "id string")
    found = violations(rows, "t", {"id": Rule(required=True), "gone": Rule()}).collect()
    assert [(r.table, r.row, r.path, r.problem) for r in found] == [("t", None, "gone", "the column is missing")]


def test_a_sound_report_keeps_the_contract(spark, sf):
    tables = Report(samples.calls(spark, sf), samples.seeds(spark)).tables()
    assert set(tables) == set(CONTRACT)
    assert report_violations(tables).collect() == []
