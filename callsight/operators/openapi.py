"""OpenAPI documents from endpoint tables.

Schemas are rebuilt from their path rows, deepest level first: one grouped round
per level turns children into the text of their parent. Documents stay rows (one
per path), so a scan with many endpoints is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import infer_scalar_type
from callsight.functions.urls import operation_id
from callsight.operators.endpoints import KEY
from callsight.operators.shape import ELEMENT


def json_text(value: Column | str) -> Column:
    """A string as JSON text."""
    value = F.col(value) if isinstance(value, str) else value
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _number(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def _object(*fields: Column) -> Column:
    """``{a,b}`` of the fields that are not null."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))


def _field(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), text)


def _list(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _node_text() -> Column:
    """Schema text of a row with ``types, format, enum, minimum, maximum, properties, required_keys, items``."""

    def single(kind: Column) -> Column:
        is_text, is_number = kind == "string", kind.isin("integer", "number")
        is_object = kind == "object"
        return _object(
            F.when(kind == "null", F.lit('"type":"string","nullable":true')).when(
                kind != "any", _field("type", json_text(kind))
            ),
            F.when(is_object & F.col("properties").isNotNull(), _field("properties", F.col("properties"))),
            F.when((kind == "array") & F.col("items").isNotNull(), _field("items", F.col("items"))),
            F.when(is_object & (F.size("required_keys") > 0), _field("required", _list(F.col("required_keys")))),
            F.when(is_text & F.col("format").isNotNull(), _field("format", json_text("format"))),
            F.when(is_text & F.col("enum").isNotNull(), _field("enum", _list(F.transform("enum", json_text)))),
            F.when(is_number & F.col("minimum").isNotNull(), _field("minimum", _number(F.col("minimum")))),
            F.when(is_number & F.col("maximum").isNotNull(), _field("maximum", _number(F.col("maximum")))),
        )

    return F.when(F.size("types") == 1, single(F.col("types")[0])).otherwise(
        F.concat(F.lit('{"oneOf":'), _list(F.transform("types", single)), F.lit("}"))
    )


def openapi_schemas(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per shape: its OpenAPI schema as JSON text (``schema``)."""
    empty = F.lit(None).cast("string")
    rows = shapes.select(*keys, "path", "types", "format", "required", "enum", "minimum", "maximum")
    children = None
    for depth in range(fv.MAX_DEPTH, -1, -1):
        level = rows.where(F.size("path") == depth)
        if children is None:
            level = level.withColumns(
                {"properties": empty, "required_keys": F.array().cast("array<string>"), "items": empty}
            )
        else:
            level = level.join(children, [*keys, "path"], "left").withColumn(
                "required_keys", F.coalesce("required_keys", F.array().cast("array<string>"))
            )
        texts = level.select(*keys, "path", "required", _node_text().alias("schema"))
        if depth == 0:
            return texts.select(*keys, "schema")
        step = F.element_at("path", -1)
        is_field = step != ELEMENT
        name = json_text(step)
        children = (
            texts.withColumns({"_name": name, "_is_field": is_field, "path": F.slice("path", 1, depth - 1)})
            .groupBy(*keys, "path")
            .agg(
                F.array_sort(F.collect_list(F.when(F.col("_is_field"), F.concat("_name", F.lit(":"), "schema")))).alias("_fields"),
                F.array_sort(F.collect_list(F.when(F.col("_is_field") & F.col("required"), F.col("_name")))).alias(
                    "required_keys"
                ),
                F.max(F.when(~F.col("_is_field"), F.col("schema"))).alias("items"),
            )
            .withColumn(
                "properties",
                F.when(F.size("_fields") > 0, F.concat(F.lit("{"), F.array_join("_fields", ","), F.lit("}"))),
            )
            .drop("_fields")
        )


def openapi_operations(
    endpoints: DataFrame, params: DataFrame, shapes: DataFrame, errors: DataFrame, vendors: DataFrame
) -> DataFrame:
    """One row per endpoint with its operation object as JSON text."""
    schemas = openapi_schemas(shapes, [*KEY, "side"])
    side = lambda name: schemas.where(F.col("side") == name).select(*KEY, F.col("schema").alias(f"{name}_schema"))
    by_status = F.concat(F.lit("error:"), F.col("status").cast("string"))
    contracts = (
        errors.withColumn("side", by_status)
        .join(schemas, [*KEY, "side"], "left")
        .groupBy(*KEY)
        .agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct("status", F.struct(F.coalesce("schema", F.lit("{}")).alias("schema"), F.col("schema_reason").alias("reason")))
                )
            ).alias("contracts")
        )
    )
    query = (
        params.withColumn("type", infer_scalar_type(F.col("sample_values")))
        .groupBy(*KEY)
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "first_at",
                            _object(
                                _field("name", json_text("name")),
                                F.lit('"in":"query","required":false'),
                                F.concat(F.lit('"schema":{"type":"'), "type", F.lit('"}')),
                                F.when(
                                    F.size("sample_values") > 0,
                                    _field("example", json_text(F.get("sample_values", F.lit(0)))),
                                ),
                            ).alias("text"),
                        )
                    )
                ),
                lambda p: p["text"],
            ).alias("query_parameters")
        )
    )
    full = (
        endpoints.join(side("request"), KEY, "left")
        .join(side("response"), KEY, "left")
        .join(contracts, KEY, "left")
        .join(query, KEY, "left")
        .join(vendors.select(*KEY, "vendor", "vendor_category", "payload_keys"), KEY, "left")
    )
    none = F.array().cast("array<string>")
    path_parameters = F.transform(
        "path_params",
        lambda p: _object(_field("name", json_text(p)), F.lit('"in":"path","required":true,"schema":{"type":"string"}')),
    )
    parameters = F.concat(path_parameters, F.coalesce("query_parameters", none))

    def response(status: Column) -> Column:
        contract = F.try_element_at(F.col("contracts"), status)
        schema = F.when(contract.isNotNull(), contract["schema"]).otherwise(F.coalesce("response_schema", F.lit("{}")))
        reason = F.when(contract.isNotNull(), contract["reason"]).otherwise(F.col("response_gap"))
        number = status.cast("string")
        body = _object(
            F.when(status == 0, F.lit('"description":"Request failed (no response)"')).otherwise(
                F.concat(F.lit('"description":"'), number, F.lit(' response"'))
            ),
            F.when(schema != "{}", F.concat(F.lit('"content":{"application/json":{"schema":'), schema, F.lit("}}"))),
            F.when(reason.isNotNull(), _field("x-schema-reason", json_text(reason))),
        )
        return F.concat(F.lit('"'), F.when(status == 0, F.lit("default")).otherwise(number), F.lit('":'), body)

    stats = lambda name, column: F.when(F.col(column).isNotNull(), _field(name, F.to_json(column)))
    has_body = (
        F.col("request_body_sample").isNotNull() | F.col("request_schema").isNotNull()
    ) & F.col("method").isin(fv.OPENAPI_BODY_METHODS)
    request_schema = F.coalesce("request_schema", F.lit('{"type":"object"}'))
    operation = _object(
        _field("summary", json_text(F.concat_ws(" ", "method", "url_pattern"))),
        _field("operationId", json_text(operation_id("method", "url_pattern"))),
        F.concat(F.lit('"tags":['), json_text("category"), F.lit("]")),
        F.when(F.size(parameters) > 0, _field("parameters", _list(parameters))),
        F.when(
            has_body,
            _field(
                "requestBody",
                _object(
                    F.concat(F.lit('"content":{"application/json":{"schema":'), request_schema, F.lit("}}")),
                    F.when(F.col("request_gap").isNotNull(), _field("x-schema-reason", json_text("request_gap"))),
                ),
            ),
        ),
        F.concat(F.lit('"responses":{'), F.array_join(F.transform("status_codes", response), ","), F.lit("}")),
        _field("x-observed-count", F.col("count").cast("string")),
        stats("x-observed-latency-ms", "timing"),
        stats("x-observed-response-bytes", "response_bytes"),
        F.when(F.col("vendor").isNotNull(), _field("x-vendor", json_text("vendor"))),
        F.when(F.col("vendor").isNotNull(), _field("x-vendor-category", json_text("vendor_category"))),
        F.when(
            F.size("payload_keys") > 0, _field("x-vendor-payload-keys", _list(F.transform("payload_keys", json_text)))
        ),
    )
    return full.select(*KEY, "category", operation.alias("operation"))


def first_operations(operations: DataFrame) -> DataFrame:
    """One operation per scan, path and method: that of the first endpoint by category and id."""
    path = F.when(F.col("url_pattern").startswith("/"), F.col("url_pattern")).otherwise(
        F.concat(F.lit("/"), "url_pattern")
    )
    first = F.min(F.struct("category", F.concat_ws(" ", "method", "url_pattern").alias("id"), "operation")).alias("first")
    chosen = operations.groupBy("scan_id", path.alias("path"), F.lower("method").alias("verb")).agg(first)
    return chosen.select("scan_id", "path", "verb", "first.category", "first.operation")


def openapi_paths(operations: DataFrame) -> DataFrame:
    """One row per scan and path: the path item with its operations by method, each method once."""
    entry = F.concat(json_text("verb"), F.lit(":"), "operation").alias("entry")
    return first_operations(operations).select("scan_id", "path", entry).groupBy("scan_id", "path").agg(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("entry")), ","), F.lit("}")).alias("path_item"),
        F.count(F.lit(1)).alias("operations"),
    )


def openapi_document(paths: DataFrame, operations: DataFrame, values: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ordered text fragments per scan: (scan_id, part, at, text). Joined in order they form the document."""
    counted = operations.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    tagged = first_operations(operations).groupBy("scan_id").agg(F.array_sort(F.collect_set("category")).alias("tags"))
    summary = counted.join(tagged, "scan_id")
    tags = _list(F.transform("tags", lambda t: F.concat(F.lit('{"name":'), json_text(t), F.lit("}"))))
    head = summary.join(seeds, "scan_id").select(
        "scan_id",
        F.lit(0).alias("part"),
        F.lit("").alias("at"),
        F.concat(
            F.lit(f'{{"openapi":"{fv.OPENAPI_VERSION}","info":{{"title":'),
            json_text(F.concat(F.lit("API surface of "), F.regexp_extract("seed_url", r"^[^:]+://([^/?#]+)", 1))),
            F.lit(',"description":"Best-effort description inferred from '),
            F.col("n").cast("string"),
            F.lit(' observed endpoint patterns.","version":"1"},"tags":'),
            tags,
            F.lit(',"servers":['),
        ).alias("text"),
    )
    origins = values.where(F.col("kind") == "origin").select("scan_id", "value").distinct()
    unserved = head.join(origins, "scan_id", "left_anti").select("scan_id")
    origins = origins.unionByName(seeds.join(unserved, "scan_id").select("scan_id", F.col("seed_url").alias("value")))
    listed = _separated(
        origins.select(
            "scan_id",
            F.lit(1).alias("part"),
            F.col("value").alias("at"),
            F.concat(F.lit('{"url":'), json_text("value"), F.lit("}")).alias("text"),
        )
    )
    middle = head.select("scan_id", F.lit(2).alias("part"), F.lit("").alias("at"), F.lit('],"paths":{').alias("text"))
    items = _separated(
        paths.select(
            "scan_id",
            F.lit(3).alias("part"),
            F.col("path").alias("at"),
            F.concat(json_text("path"), F.lit(":"), "path_item").alias("text"),
        )
    )
    tail = head.select("scan_id", F.lit(4).alias("part"), F.lit("").alias("at"), F.lit("}}").alias("text"))
    return head.unionByName(listed).unionByName(middle).unionByName(items).unionByName(tail)


def _separated(rows: DataFrame) -> DataFrame:
    """Put a comma before every fragment but the first of its scan."""
    first = rows.groupBy("scan_id").agg(F.min("at").alias("_first"))
    comma = F.when(F.col("at") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    return rows.join(first, "scan_id").withColumn("text", F.concat(comma, "text")).drop("_first")
