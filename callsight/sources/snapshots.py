"""Stored report documents as comparable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callsight import fixed_values as fv
from callsight import schemas
from callsight.operators.diff import Snapshot


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A report document; reading its rows fails when it is not one, or has another version."""
    raw = spark.read.text(path, wholetext=True)
    return check_snapshot(raw.select(F.col("value").alias("document")))


def check_snapshot(documents: DataFrame) -> DataFrame:
    """Parse report documents (``document`` text) and refuse the ones this library cannot compare."""
    parsed = F.from_json("document", schemas.SNAPSHOT, {"mode": "PERMISSIVE"})
    shape = F.schema_of_variant(F.try_parse_json("document"))
    problem = (
        F.when(shape.isNull(), F.lit("the baseline is not valid JSON"))
        .when(
            F.col("r.meta").isNull() | F.col("r.endpoints").isNull(),
            F.lit("the baseline must be a report with 'meta' and 'endpoints'"),
        )
        .when(
            F.col("r.schemaVersion").isNull(),
            F.lit(f"expected schemaVersion {fv.REPORT_SCHEMA_VERSION} but the baseline has none"),
        )
        .when(
            F.col("r.schemaVersion") != fv.REPORT_SCHEMA_VERSION,
            F.concat(
                F.lit(f"expected schemaVersion {fv.REPORT_SCHEMA_VERSION} but found "),
                F.col("r.schemaVersion").cast("string"),
            ),
        )
    )
    checked = documents.select("document", parsed.alias("r"))
    return checked.select(
        F.when(problem.isNotNull(), F.raise_error(problem).cast(f"struct<{_as_fields()}>")).otherwise(F.col("r")).alias("r")
    ).select("r.*")


def _as_fields() -> str:
    """The snapshot schema as struct fields."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(schemas.SNAPSHOT).fields)


def document_shapes(rows: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """Nested schema documents (a variant column) flattened to path rows, level by level."""
    text = lambda node, name: F.try_variant_get(node, f"$.{name}", "string")
    sub = lambda node, name, kind: F.try_variant_get(node, f"$.{name}", kind)

    def variants(node: Column) -> Column:
        """The node itself, or the members of its union."""
        return F.when(
            sub(node, "oneOf", "array<variant>").isNotNull(), sub(node, "oneOf", "array<variant>")
        ).otherwise(F.array(node))

    def children(item: Column) -> Column:
        fields = F.flatten(
            F.transform(
                variants(item["node"]),
                lambda v: F.transform(
                    F.coalesce(F.map_entries(sub(v, "properties", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>")),
                    lambda e: F.struct(
                        F.array_append(item["path"], e["key"]).alias("path"),
                        e["value"].alias("node"),
                        F.coalesce(F.array_contains(sub(v, "required", "array<string>"), e["key"]), F.lit(False)).alias("required"),
                    ),
                ),
            )
        )
        elements = F.transform(
            F.filter(
                F.transform(variants(item["node"]), lambda v: sub(v, "items", "variant")), lambda v: v.isNotNull()
            ),
            lambda v: F.struct(F.array_append(item["path"], F.lit("[]")).alias("path"), v.alias("node"), F.lit(False).alias("required")),
        )
        return F.concat(fields, elements)

    level = rows.where(F.col(schema).isNotNull() & ~F.is_variant_null(schema)).select(
        *keys, F.struct(F.array().cast("array<string>").alias("path"), F.col(schema).alias("node"), F.lit(False).alias("required")).alias("i")
    )
    found = level
    for _ in range(fv.MAX_DEPTH):
        level = level.select(*keys, F.explode(children(F.col("i"))).alias("i"))
        found = found.unionByName(level)
    members = variants(F.col("i.node"))
    kinds = F.array_sort(F.array_distinct(F.transform(members, lambda v: text(v, "type"))))
    first = lambda name, kind: F.get(
        F.filter(F.transform(members, lambda v: sub(v, name, kind)), lambda x: x.isNotNull()), F.lit(0)
    )
    return found.select(
        *keys,
        F.col("i.path").alias("path"),
        F.array_compact(kinds).alias("types"),
        first("description", "string").alias("format"),
        F.col("i.required").alias("required"),
        F.array_sort(first("enum", "array<string>")).alias("enum"),
        first("minimum", "double").alias("minimum"),
        first("maximum", "double").alias("maximum"),
    )


def snapshot_tables(report: DataFrame) -> Snapshot:
    """The tables the comparison needs, from a report read by :func:`read_snapshot`."""
    each = report.select(F.explode("endpoints").alias("e"))
    endpoints = each.select(
        F.col("e.id").alias("id"),
        F.array_sort("e.statusCodes").alias("status_codes"),
        F.col("e.category").alias("category"),
        F.col("e.responseBytes.p95").alias("p95_response_bytes"),
        F.col("e.requestBodySchemaReason").alias("request_gap"),
        F.col("e.responseSchemaReason").alias("response_gap"),
    )
    errors = each.select(F.col("e.id").alias("id"), F.explode("e.errorResponses").alias("x"))
    sides = (
        each.select(F.col("e.id").alias("id"), F.lit("response").alias("side"), F.col("e.responseSchema").alias("schema"))
        .unionByName(
            each.select(F.col("e.id").alias("id"), F.lit("request").alias("side"), F.col("e.requestBodySchema").alias("schema"))
        )
        .unionByName(
            errors.select("id", F.concat(F.lit("error:"), F.col("x.status").cast("string")).alias("side"), F.col("x.schema").alias("schema"))
        )
    )
    operations = each.select(F.col("e.id").alias("id"), F.explode("e.graphql.operations").alias("o"))
    empty = F.array().cast("array<string>")
    sockets = report.select(F.posexplode("webSockets").alias("conn_seq", "w")).select(
        F.concat(F.lit("WS "), F.col("w.url")).alias("id"),
        "conn_seq",
        F.col("w.frameCount").alias("frame_count"),
        F.lit(None).cast("string").alias("sent_gap"),
        F.lit(None).cast("string").alias("received_gap"),
    )
    last = sockets.groupBy("id").agg(F.max("conn_seq").alias("conn_seq"))
    return Snapshot(
        endpoints=endpoints,
        params=each.select(F.col("e.id").alias("id"), F.explode("e.queryParams.name").alias("name")),
        shapes=document_shapes(sides, ["id", "side"], "schema").select("id", "side", "path", "types", "enum", "minimum", "maximum"),
        errors=errors.select("id", F.col("x.status").alias("status"), F.col("x.schemaReason").alias("schema_reason")),
        vendors=each.where("e.vendor is not null").select(
            F.col("e.id").alias("id"),
            F.col("e.vendor.name").alias("vendor"),
            F.col("e.vendor.category").alias("vendor_category"),
            F.coalesce("e.vendor.payloadKeys", empty).alias("payload_keys"),
        ),
        operations=operations.select(
            "id",
            F.col("o.type").alias("type"),
            F.col("o.name").alias("name"),
            F.coalesce("o.selections", empty).alias("selections"),
            F.coalesce("o.arguments", empty).alias("arguments"),
        ),
        introspection=each.where("e.graphql is not null").select(
            F.col("e.id").alias("id"), F.coalesce("e.graphql.introspection", F.lit(False)).alias("introspection")
        ),
        sockets=sockets.join(last, ["id", "conn_seq"], "left_semi").drop("conn_seq"),
    )


def contract_violations(endpoints: DataFrame) -> DataFrame:
    """Rows of an endpoint table that break the report contract: a missing field or an unknown name."""
    known = F.array(*[F.lit(c) for c in fv.CATEGORIES])
    reasons = F.array(*[F.lit(r) for r in fv.GAP_REASONS])
    outside = lambda column, names: F.col(column).isNotNull() & ~F.array_contains(names, F.col(column))
    problem = F.concat_ws(
        "; ",
        *[F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("id", "method", "url_pattern", "category", "count")],
        F.when(outside("category", known), F.lit("unknown category")),
        F.when(outside("request_gap", reasons) | outside("response_gap", reasons), F.lit("unknown gap reason")),
        F.when(F.col("count") < 1, F.lit("count is not positive")),
    )
    return endpoints.select("id", problem.alias("problem")).where("problem <> ''")
