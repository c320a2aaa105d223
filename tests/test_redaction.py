import json
import random

from pyspark.sql import functions as F

from callsight.operators import leaks, redaction


def masked(spark, bodies, limit=None):
    rows = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, b string")
    out = rows.select("n", redaction.redact_body("b", limit).alias("r")).orderBy("n").collect()
    return [r["r"]["body"] for r in out], [r["r"]["secrets"] for r in out]


def test_bodies(spark):
    bodies = [
        '{"password":"x","note":"hello","n":1.0,"deep":{"credentials":{"a":["y",5,true]}}}',
        '{"note":"mail me@mail.test please"}',
        "me@mail.test",
        "contact me@mail.test",
        "{broken",
        None,
        '{"b":1,"2":2,"1":{"ok":null}}',
        '["123-45-6789"]',
    ]
    texts, secrets = masked(spark, bodies)
    assert json.loads(texts[0]) == {
        "password": "[REDACTED]", "note": "hello", "n": 1, "deep": {"credentials": {"a": ["[REDACTED]", 5, True]}},
    }
    assert '"n":1,' in texts[0]
    assert texts[1:] == [
        '{"note":"[REDACTED]"}', "[REDACTED]", "contact me@mail.test", "{broken", None, '{"1":{"ok":null},"2":2,"b":1}', '["[REDACTED]"]',
    ]
    assert sorted(secrets[0]) == ["x", "y"] and secrets[2] == ["me@mail.test"]


def test_any_depth(spark):
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    bodies = [deep(10, '"me@mail.test"'), deep(300, '["me@mail.test"]'), deep(1, deep(40, '{"token":[["x"]]}')), deep(200_000, '"me@mail.test"')]
    texts, secrets = masked(spark, bodies)
    assert texts[:3] == [b.replace("me@mail.test", "[REDACTED]").replace('"x"', '"[REDACTED]"') for b in bodies[:3]]
    assert secrets[:3] == [["me@mail.test"], ["me@mail.test"], ["x"]]
    assert "me@mail.test" not in texts[3]


def test_masking_twice_changes_nothing(spark):
    once, _ = masked(spark, ['{"token":"a","x":[1,"b@c.test"]}', "plain"])
    again, found = masked(spark, once)
    assert again == once


def test_size_limit_is_optional(spark):
    body = '{"password":"' + "x" * 100 + '"}'
    assert masked(spark, [body], 50)[0] == [body]
    assert masked(spark, [body])[0] == ['{"password":"[REDACTED]"}']


def test_headers(spark):
    rows = spark.createDataFrame([({"Cookie": "a=1", "X-Note": "me@mail.test", "Accept": "*/*"},)], "h map<string,string>")
    got = rows.select(redaction.redact_headers("h").alias("h"), redaction.header_secrets("h").alias("s")).first()
    assert got["h"] == {"Cookie": "[REDACTED]", "X-Note": "[REDACTED]", "Accept": "*/*"}
    assert sorted(got["s"]) == ["a=1", "me@mail.test"]


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    secrets = sorted({word(rng.randint(6, 40)) for _ in range(60)} | {"x" * 7, "x" * 9, "prefix-one", "prefix-two"})
    texts = [word(rng.randint(0, 60)) for _ in range(80)] + [f"..{s}.." for s in secrets[::7]] + ["xxxxxxxx", "prefix-", "a prefix-two"]
    expected = {n for n, t in enumerate(texts) if any(s in t for s in secrets)}
    leaves = spark.createDataFrame(list(enumerate(texts)), "id int, leaf string")
    ledger = spark.createDataFrame([(s,) for s in secrets], "value string")
    found = leaks.leaking_leaves(leaves, ["id"], "leaf", ledger)
    assert {r["id"] for r in found.collect()} == expected
    assert "Python" not in found._jdf.queryExecution().toString()


def test_leaks_at_every_place(spark):
    secrets = ["naïve\nsecret", "\U0001f600mark-one", "ends-here"]
    texts = ["\U0001f600" * 3 + "naïve\nsecret", "x" * 30_000 + "\U0001f600mark-one", "ends-here", "naïve secret", "", None, "ends-"]
    leaves = spark.createDataFrame(list(enumerate(texts)), "id int, leaf string")
    ledger = spark.createDataFrame([(s,) for s in secrets], "value string")
    assert {r["id"] for r in leaks.leaking_leaves(leaves, ["id"], "leaf", ledger).collect()} == {0, 1, 2}
    assert leaks.leaking_leaves(leaves, ["id"], "leaf", ledger.limit(0)).count() == 0


def test_ledger_and_summary(spark):
    values = spark.createDataFrame([(" abcdef ",), ("abcdef",), ("short",), (None,)], "value string")
    assert [r["value"] for r in redaction.secret_ledger(values).collect()] == ["abcdef"]
    hits = spark.range(20).select(F.lit("s").alias("scan_id"), F.format_string("p%02d", "id").alias("path"))
    got = leaks.leak_summary(hits, ["scan_id"], "path").first()
    assert got["total"] == 20 and got["paths"] == [f"p{n:02d}" for n in range(8)]


def test_masking_is_not_worked_out_in_the_tasks_of_the_scan(spark, tmp_path):
    from callsight.plans.queries import secret_ledger

    rows = spark.sql(
        "select id as event_id, timestamp_ntz'2024-01-02' as ts, id as user_id, 'signup' as event_type, 1.5D as value, "
        "concat('{\"k\": ', id, '}') as props from range(4)"
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("select id as page_id, 'https://shop.test/' as url, '' as html from range(2)").write.parquet(f"{tmp_path}/pages.parquet")
    found = secret_ledger(spark, str(tmp_path))
    assert sorted(r["value"] for r in found.collect()) == ["ops1@example.com", *(f"u{n}@example.com" for n in range(4))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_redact_json_bodies") == 2  # once for each side of a call, and in no filter
