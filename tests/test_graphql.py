from callsight.operators import graphql
from callsight.operators.endpoints import keyed_calls

DOCUMENTS = {
    "query Q($a: In = {x: 1}) @live { one: first(a: $a, b: {c: 1}) { nested(z: 1) } second @skip(if: true) { q } ...F ... on T { t } }": (
        "query", "Q", ["first", "second"], ["a", "b"],
    ),
    "{ viewer { id } }": ("query", None, ["viewer"], []),
    '# query Fake { x }\nmutation M { add(text: "query { no }", big: """{ " }""") }': ("mutation", "M", ["add"], ["big", "text"]),
    "subscription { ticks }": ("subscription", None, ["ticks"], []),
    "query query { query }": ("query", "query", ["query"], []),
}


def test_documents(spark):
    rows = spark.createDataFrame([(d,) for d in DOCUMENTS], "query string")
    tagged = graphql.document_operations(rows).collect()
    from hashlib import sha256

    got = {r["doc"]: (r["type"], r["name"], r["selections"], r["arguments"]) for r in tagged}
    assert got == {sha256(d.encode()).hexdigest(): want for d, want in DOCUMENTS.items()}
    assert not any(r["introspection"] for r in tagged)


def test_several_operations_and_fragments(spark):
    doc = "fragment F on T { x } query A { a } fragment G on T { y { z } } query B { __schema { types { name } } }"
    got = graphql.document_operations(spark.createDataFrame([(doc,)], "query string")).collect()
    assert sorted((r["name"], tuple(r["selections"])) for r in got) == [("A", ("a",)), ("B", ("__schema",))]
    assert all(r["introspection"] for r in got)


def call(seq, url, body=None, headers=None, method="POST"):
    return ("s", seq, method, url, 200, "application/json", "fetch", headers or {}, body, {}, None, False, None, None, 0, 1, "")


def test_requests(spark):
    from callsight.schemas import CALLS

    rows = [
        call(1, "https://a.test/graphql", '{"query":"query A { a }","operationName":"A"}'),
        call(2, "https://a.test/graphql", '{"operationName":"P"}'),
        call(3, "https://a.test/x", '{"operationName":"P"}'),
        call(4, "https://a.test/x", '{"operationName":"P","extensions":{"persistedQuery":{"h":1}}}'),
        call(5, "https://a.test/x", "query Raw { r }", {"content-type": "application/graphql"}),
        call(6, "https://a.test/x?query=%7B%20q%20%7D", method="GET"),
        call(7, "https://a.test/x", '{"query":"shoes"}'),
        call(8, "https://a.test/x", '{"query":"query A { a }","operationName":"IntrospectionQuery"}'),
        call(9, "https://a.test/graphql?operationName=G", method="GET"),
    ]
    keyed = keyed_calls(spark.createDataFrame(rows, CALLS))
    found = graphql.graphql_calls(keyed)
    assert sorted(r["call_seq"] for r in found.collect()) == [1, 2, 4, 5, 6, 8, 9]
    ops = {(r["method"], r["url_pattern"], r["type"], r["name"]) for r in graphql.graphql_operations(found).collect()}
    assert ops == {
        ("POST", "/graphql", "query", "A"), ("POST", "/graphql", "unknown", "P"), ("GET", "/graphql", "unknown", "G"),
        ("POST", "/x", "unknown", "P"), ("POST", "/x", "query", "Raw"), ("GET", "/x", "query", None),
        ("POST", "/x", "query", "A"), ("POST", "/x", "unknown", "IntrospectionQuery"),
    }
    flags = {(r["method"], r["url_pattern"]): r["introspection"] for r in graphql.graphql_introspection(found).collect()}
    assert flags[("POST", "/x")] and not flags[("POST", "/graphql")]
