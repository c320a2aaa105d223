import random

from callsight.operators import shape as sh

DOCS = [
    '{"id":1,"tags":["a","b"],"at":"2024-01-02","n":1,"x":null,"u":1}',
    '{"id":2,"tags":[],"at":"2024-01-03","n":1.5,"u":"s"}',
    '{"id":3,"tags":null,"at":"soon","n":2,"o":{"p":{"q":{"r":{"deep":1}}}}}',
    '[{"k":1},{"other":2}]',
    "not json",
    "7",
    '{"a":1,"a":2}',
]


def shape_rows(spark, docs):
    rows = spark.createDataFrame([("g", d) for d in docs], "g string, body string")
    found = sh.schema_paths(sh.body_nodes(rows, ["g"], "body"), ["g"]).collect()
    return {".".join(r["path"]): (r["types"], r["format"], r["required"], r["enum"], r["minimum"], r["maximum"]) for r in found}


def test_merge_rules(spark):
    got = shape_rows(spark, DOCS)
    assert got[""] == (["array", "object"], None, False, None, None, None)
    assert got["id"] == (["integer"], None, True, None, 1.0, 3.0)
    assert got["n"] == (["number"], None, True, None, 1.0, 2.0)
    assert got["tags"][0] == ["array"] and not got["tags"][2]
    # Every element counts for values, the first one for the shape.
    assert got["tags.[]"] == (["string"], None, False, ["a", "b"], None, None)
    # One sample without the format drops it; a date is no member of a closed set.
    assert got["at"] == (["string"], None, True, None, None, None)
    assert got["x"] == (["null"], None, False, None, None, None)
    assert got["u"][0] == ["integer", "string"]
    assert got["o.p.q.r"][0] == ["object"] and "o.p.q.r.deep" not in got
    assert "[].k" in got and "[].other" not in got
    assert "a" not in got  # repeated keys are not JSON here


def test_merge_ignores_order_and_partitioning(spark):
    docs = DOCS * 3
    random.Random(3).shuffle(docs)
    rows = spark.createDataFrame([("g", d) for d in docs], "g string, body string").repartition(7)
    found = sh.schema_paths(sh.body_nodes(rows, ["g"], "body"), ["g"]).collect()
    got = {".".join(r["path"]): (r["types"], r["format"], r["required"], r["enum"], r["minimum"], r["maximum"]) for r in found}
    assert got == shape_rows(spark, DOCS)


def test_partial_states_add_up(spark):
    keys = ["g"]
    state = lambda docs: sh.path_counts(
        sh.observed_values(sh.body_nodes(spark.createDataFrame([("g", d) for d in docs], "g string, body string"), keys, "body"), keys), keys
    )
    merged = sh.merge_counts(state(DOCS[:2]).unionByName(state(DOCS[2:])), keys)
    whole = state(DOCS)
    assert merged.select(whole.columns).exceptAll(whole).count() == 0


def test_first_fifty_fields(spark):
    doc = "{" + ",".join(f'"f{60 - n}":{n}' for n in range(60)) + ',"3":0}'
    got = shape_rows(spark, [doc, '{"nested":' + doc + "}"])
    names = {k for k in got if k.startswith("f")}
    # Whole-number keys come first, then the others as written.
    assert "3" in got and "f60" in names and "f12" in names and "f11" not in names
    nested = {k for k in got if k.startswith("nested.")}
    assert "nested.3" in nested and "nested.f12" in nested and "nested.f11" not in nested


def test_enum_limits(spark):
    values = lambda n: [f'{{"v":"k{i}"}}' for i in range(n)]
    assert shape_rows(spark, values(10))["v"][3] == sorted(f"k{i}" for i in range(10))
    assert shape_rows(spark, values(11))["v"][3] is None
    assert shape_rows(spark, ['{"v":"a b"}', '{"v":"c"}'])["v"][3] is None
    assert shape_rows(spark, ['{"v":"' + "x" * 41 + '"}', '{"v":"c"}'])["v"][3] is None


def test_frame_gaps(spark):
    frames = spark.createDataFrame(
        [("s", 1, 1, "sent", "text", "hi", False), ("s", 2, 1, "sent", "binary", "AA", False), ("s", 3, 1, "sent", "text", '{"a":1}', False),
         ("s", 4, 1, "sent", "text", "cut", True), ("s", 5, 1, "sent", "text", None, False)],
        "scan_id string, conn_seq bigint, frame_seq bigint, direction string, type string, payload string, truncated boolean",
    )
    flags = frames.selectExpr("scan_id", "conn_seq", "false as frames_truncated").distinct()
    gaps = sh.frame_gaps(frames, flags, sh.frame_schema_paths(frames)).collect()
    got = {(r["conn_seq"], r["direction"]): r["reason"] for r in gaps}
    assert [got[(n, "sent")] for n in range(1, 6)] == ["not-json", "binary", None, "truncated", "no-body"]
    assert got[(1, "received")] == "no-body"


def test_limits_are_arguments_and_keys_may_hold_quotes(spark):
    wide = "{" + ",".join(f'"z{60 - n}":{{"in":{n}}}' for n in range(60)) + "}"
    docs = ['{"it\'s":' + wide + ',"its":' + wide + ',"q\\"b":[null,' + wide + '],"a.b":{"[]":' + wide + "}}"]
    rows = spark.createDataFrame([("g", d) for d in docs], "g string, body string")
    walk = lambda limits: sh.body_nodes(rows, ["g"], "body", limits).where("shape").collect()
    shown = lambda limits, parent: sorted(r["path"][-1] for r in walk(limits) if r["path"][:-1] == parent)
    first = sorted(f"z{60 - n}" for n in range(7))
    for parent in (["it's"], ["its"], ['q"b', "[]"], ["a.b", "[]"]):
        assert shown(sh.Limits(fields=7), parent) == first
        assert len(shown(sh.DEFAULT, parent)) == 50
        assert len(shown(sh.Limits(fields=60), parent)) == 60
    assert {len(r["path"]) for r in walk(sh.Limits(depth=2, fields=7))} == {0, 1, 2}
    assert max(len(r["path"]) for r in walk(sh.Limits(depth=6))) == 4
    values = spark.createDataFrame([("g", f'{{"v":"x{n}"}}') for n in range(12)], "g string, body string")
    found = lambda limits: sh.schema_paths(sh.body_nodes(values, ["g"], "body", limits), ["g"], limits).where("size(path) = 1").first()["enum"]
    assert found(sh.DEFAULT) is None and len(found(sh.Limits(enum_values=12))) == 12
    assert found(sh.Limits(enum_values=12, enum_length=2)) is None


def test_nodes_keep_the_format_of_a_long_text_and_only_its_beginning(spark):
    address = "https://shop.test/" + "a" * 500
    rows = spark.createDataFrame([("g", '{"u":"%s","n":[{"s":"%s"}]}' % (address, "x " * 400))], "g string, body string")
    found = {sh.ELEMENT.join(r["path"]): r for r in sh.body_nodes(rows, ["g"], "body").where("text is not null").collect()}
    longest = sh.DEFAULT.enum_length + 1
    assert {len(r["text"]) for r in found.values()} == {longest}
    assert found["u"]["text"] == address[:longest] and found["u"]["format"] == "uri"
    assert [r["format"] for path, r in found.items() if path != "u"] == [None]
