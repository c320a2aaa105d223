"""JSON shapes: every body becomes rows of (path, type), and shapes are merged by grouping them.

A path is an array of steps; the step ``[]`` is "element of an array". Shapes are
kept flat (one row per path) because they nest without a fixed schema.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.memo import reused
from callsight.functions.text import gap_name, gap_rank, is_enum_member, json_container, string_format
from callsight.functions.urls import bind
from callsight.operators.sizing import settle

ELEMENT = "[]"


@dataclass(frozen=True)
class Limits:
    """How far a shape is read: levels below the root, fields of an object, and what makes a closed value set."""

    depth: int = fv.MAX_DEPTH
    fields: int = fv.MAX_PROPERTIES
    enum_values: int = fv.MAX_ENUM_VALUES
    enum_length: int = fv.MAX_ENUM_LENGTH


DEFAULT = Limits()


def _json_type(value: Column) -> Column:
    """``null array object string integer number boolean`` of a variant."""
    number = F.try_variant_get(value, "$", "double")
    return bind(
        F.schema_of_variant(value),
        lambda name: F.when(name == "BIGINT", F.lit("integer"))
        .when(name == "STRING", F.lit("string"))
        .when(name == "VOID", F.lit("null"))
        .when(name.startswith("OBJECT"), F.lit("object"))
        .when(name.startswith("ARRAY"), F.lit("array"))
        .when(name == "BOOLEAN", F.lit("boolean"))
        .when(number == F.floor(number), F.lit("integer"))
        .otherwise(F.lit("number")),
    )


def _ranked_keys(text: Column) -> Column:
    """Keys of the object that a JSON text is, as a browser lists them: whole numbers first, then as written."""
    return bind(
        F.array_distinct(F.json_object_keys(text)),
        lambda keys: F.concat(
            F.transform(
                F.array_sort(
                    F.transform(
                        F.filter(keys, lambda k: k.rlike(r"^(0|[1-9][0-9]{0,9})$")),
                        lambda k: F.struct(k.cast("bigint").alias("n"), k.alias("k")),
                    )
                ),
                lambda item: item["k"],
            ),
            F.filter(keys, lambda k: ~k.rlike(r"^(0|[1-9][0-9]{0,9})$")),
        ),
    )


def _may_be_wide(text: Column, fields: int) -> Column:
    """Can an object within this JSON text have more fields than the limit? Each field has a colon."""
    return F.length(text) - F.length(F.replace(text, F.lit(":"))) > fields


_SELF, _CHILD, _UNKNOWN = 0, 1, 2


@reused
def _opening(fields: int) -> dict[str, Column]:
    """What a row needs before it is opened: where its shape continues, and which rows come of it."""
    is_array = F.col("type") == "array"
    items = F.col("value").cast("array<variant>")
    real = F.filter(F.transform(items, lambda v, i: F.when(~F.is_variant_null(v), i)), lambda i: i.isNotNull())
    first = F.when(is_array & F.col("value").isNotNull(), F.get(real, F.lit(0)))
    ranked = bind(_ranked_keys(F.col("raw")), lambda names: F.when(F.size(names) > fields, F.slice(names, 1, fields)))
    return {"_first": first, "_few": F.when((F.col("type") == "object") & F.col("raw").isNotNull(), ranked)}


@reused
def _roles() -> Column:
    # An array without a value still has elements, of unknown type.
    return F.explode(
        F.when(F.col("value").isNull(), F.array(F.lit(_SELF)))
        .when((F.col("type") == "array") & F.col("_first").isNull(), F.array(F.lit(_SELF), F.lit(_CHILD), F.lit(_UNKNOWN)))
        .otherwise(F.array(F.lit(_SELF), F.lit(_CHILD)))
    )


@reused
def _kind() -> Column:
    child = F.col("_role") == _CHILD
    return F.when(F.col("_role") == _SELF, F.col("type")).when(child, _json_type(F.col("_child"))).otherwise(F.lit("any"))


@reused
def _content() -> Column:
    return F.when(F.col("_kind") == "string", F.when(F.col("_role") == _CHILD, F.try_variant_get("_child", "$", "string")))


@reused
def _closing(fields: int, last: bool, longest: int) -> list[Column]:
    """The columns of a row after its container was opened."""
    own, child, is_array = F.col("_role") == _SELF, F.col("_role") == _CHILD, F.col("type") == "array"
    container = child & F.col("_kind").isin("object", "array")
    named = F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, _: k == F.col("_key"))
    inside = F.when(is_array, F.get(F.from_json("raw", "array<string>"), F.col("_pos"))).otherwise(F.get(F.map_values(named), F.lit(0)))
    # Few children are as wide: their text is only looked for where their colons are many.
    # Nested, as Spark would work out both sides of an "and" of which parts come twice, and write every child as text.
    wide = F.when(F.col("raw").isNotNull(), F.when(container, _may_be_wide(F.to_json("_child"), fields)))
    in_shape = F.when(is_array, F.coalesce(F.col("_pos") == F.col("_first"), F.lit(False))).otherwise(
        F.col("_few").isNull() | F.array_contains("_few", F.col("_key"))
    )
    gone = F.lit(None)
    return [
        F.when(own, F.col("path"))
        .otherwise(F.array_append("path", F.when(is_array, F.lit(ELEMENT)).otherwise(F.col("_key"))))
        .alias("path"),
        F.col("_kind").alias("type"),
        F.when(child, F.col("shape") & in_shape).otherwise(F.col("shape")).alias("shape"),
        # A long text ends here: deeper levels and the counting need its format and its beginning.
        F.when(own, F.col("text")).otherwise(F.left("_text", F.lit(longest + 1))).alias("text"),
        F.when(own, F.col("format")).otherwise(string_format("_text")).alias("format"),
        F.when(own, F.col("number"))
        .when(F.col("_kind").isin("integer", "number"), F.try_variant_get("_child", "$", "double"))
        .alias("number"),
        (gone.cast("variant") if last else F.when(container, F.col("_child"))).alias("value"),
        (gone.cast("string") if last else F.when(wide, inside)).alias("raw"),
    ]


def _walked(rows: DataFrame, keys: list[str], limits: Limits, last: bool) -> DataFrame:
    """Every row again, and the children of those that are containers still to be opened (``value`` is set).

    ``raw`` is the text of a container that may hold an object with too many fields: only there the written
    order matters, which a parsed value does not keep.
    """
    opened = rows.withColumns(_opening(limits.fields)).withColumn("_role", _roles())
    content = F.when(F.col("_role") == _CHILD, F.col("value")).outer()
    children = rows.sparkSession.tvf.variant_explode_outer(content).toDF("_pos", "_key", "_child")
    each = opened.lateralJoin(children).where("_role <> 1 or _pos is not null")  # an empty container has no child
    typed = each.withColumn("_kind", _kind()).withColumn("_text", _content())
    return typed.select(*keys, *_closing(limits.fields, last, limits.enum_length))


def body_nodes(bodies: DataFrame, keys: list[str], body: str, limits: Limits = DEFAULT) -> DataFrame:
    """One row per node of every JSON body, down to the depth limit.

    ``shape`` marks the nodes a shape is read from: the first fields of an object, up to the limit, and the
    first non-null element of an array. The other nodes only contribute values. A body is parsed once and
    opened level by level in the same task; nodes are rows from the start. ``format`` is judged on a whole
    string, of which ``text`` keeps one character more than a member of a value set may have.
    """
    parsed = bodies.select(*keys, F.col(body).alias("_body"), json_container(body).alias("value")).where("value is not null")
    rows = parsed.select(
        *keys,
        F.array().cast("array<string>").alias("path"),
        # Told by its first sign: the schema of a whole body would be read to its depth.
        F.when(F.col("_body").rlike(r"^\s*\{"), F.lit("object")).otherwise(F.lit("array")).alias("type"),
        F.lit(True).alias("shape"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("format"),
        F.lit(None).cast("double").alias("number"),
        "value",
        F.when(_may_be_wide(F.col("_body"), limits.fields), F.col("_body")).alias("raw"),
    )
    for level in range(limits.depth):
        rows = _walked(rows, keys, limits, level + 1 == limits.depth)
    finite = F.when(F.abs("number") < float("inf"), F.col("number"))
    return rows.drop("value", "raw").withColumn("number", finite)


TYPE_COUNTS = ["object", "array", "string", "integer", "number", "boolean", "null", "any"]


def observed_values(nodes: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """Counted observations: one row per path, type, format and (shortened) string.

    The one shuffle every shape statistic is built on. A path that holds most of the nodes is
    spread over its values; repeated values collapse before the shuffle. Strings too long for a
    value set need not be told apart, so only their beginning travels.
    """
    return nodes.groupBy(
        *keys, "path", "type", "shape", "format", F.left("text", F.lit(limits.enum_length + 1)).alias("text")
    ).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("low"), F.max("number").alias("high"))


def path_counts(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable state of a shape: how often every path had each type, its formats and its bounds.

    All buffers are numbers, and the states of any split of the input add up (:func:`merge_counts`).
    """
    shaped = lambda test, name: F.sum(F.when(F.col("shape") & test, F.col("n")).otherwise(0)).alias(name)
    return observed.groupBy(*keys, "path").agg(
        *[shaped(F.col("type") == kind, f"n_{kind}") for kind in TYPE_COUNTS],
        *[shaped(F.col("format").eqNullSafe(name), f"f_{name}") for name, _ in fv.STRING_FORMATS],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def merge_counts(states: DataFrame, keys: list[str]) -> DataFrame:
    """Combine shape states of several inputs."""
    summed = [f"n_{kind}" for kind in TYPE_COUNTS] + [f"f_{name}" for name, _ in fv.STRING_FORMATS]
    return states.groupBy(*keys, "path").agg(
        *[F.sum(F.col(f"`{name}`")).alias(name) for name in summed],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def enum_values(observed: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """Closed value sets: two or more distinct short strings per path, up to the limit.

    Of the distinct strings only one more than the limit is kept per path (before the shuffle already),
    which is enough to tell a small set from a large one.
    """
    distinct = observed.where(F.col("text").isNotNull()).select(*keys, "path", "text", "format").distinct()
    few = Window.partitionBy(*keys, "path").orderBy("text")
    return (
        distinct.withColumn("_rank", F.row_number().over(few))
        .where(F.col("_rank") <= limits.enum_values + 1)
        .groupBy(*keys, "path")
        .agg(
            F.array_sort(F.collect_list("text")).alias("enum"),
            F.bool_and(is_enum_member("text", F.col("format"), limits.enum_length)).alias("_plain"),
        )
        .where(F.size("enum").between(2, limits.enum_values) & F.col("_plain"))
        .select(*keys, "path", "enum")
    )


def schema_paths(nodes: DataFrame, keys: list[str], limits: Limits = DEFAULT) -> DataFrame:
    """The merged shape: types, format, required, enum and bounds of every path."""
    observed = settle(observed_values(nodes, keys, limits))
    return shape_of(path_counts(observed, keys), enum_values(observed, keys, limits), keys)


def shape_of(counts: DataFrame, enums: DataFrame, keys: list[str]) -> DataFrame:
    has = lambda kind: F.col(f"n_{kind}") > 0
    types = F.filter(
        F.array(
            F.when(has("array"), F.lit("array")),
            F.when(has("boolean"), F.lit("boolean")),
            F.when(has("integer") & ~has("number"), F.lit("integer")),
            F.when(has("number"), F.lit("number")),
            F.when(has("object"), F.lit("object")),
            F.when(has("string"), F.lit("string")),
        ),
        lambda kind: kind.isNotNull(),
    )
    only = F.when(F.size(types) > 0, types).when(has("null"), F.array(F.lit("null"))).otherwise(F.array(F.lit("any")))
    agreed = F.coalesce(
        *[
            F.when(has("string") & (F.col(f"`f_{name}`") == F.col("n_string")), F.lit(name))
            for name, _ in fv.STRING_FORMATS
        ]
    )
    shaped = counts.where(" + ".join(f"n_{kind}" for kind in TYPE_COUNTS) + " > 0")
    rows = shaped.select(
        *keys,
        "path",
        only.alias("types"),
        agreed.alias("format"),
        F.expr("n_object + n_array + n_string + n_integer + n_number + n_boolean").alias("_present"),
        F.col("n_object").alias("_objects"),
        "low",
        "high",
    )
    parents = rows.select(*keys, F.col("path").alias("_parent"), F.col("_objects").alias("_parent_objects"))
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    numeric = F.array_contains("types", "integer") | F.array_contains("types", "number")
    spans = numeric & (F.col("low") < F.col("high"))
    return (
        rows.withColumn("_parent", parent)
        .join(parents, [*keys, "_parent"], "left")
        .join(enums, [*keys, "path"], "left")
        .select(
            *keys,
            "path",
            "types",
            "format",
            F.coalesce(
                (F.try_element_at("path", F.lit(-1)) != ELEMENT) & (F.col("_present") == F.col("_parent_objects")),
                F.lit(False),
            ).alias("required"),
            F.when(F.array_contains("types", "string") & F.col("format").isNull(), F.col("enum")).alias("enum"),
            F.when(spans, F.col("low")).alias("minimum"),
            F.when(spans, F.col("high")).alias("maximum"),
        )
    )


def path_text(path: Column | str = "path") -> Column:
    """``a.b[].c``; empty for the root."""
    path = F.col(path) if isinstance(path, str) else path
    return F.aggregate(
        path,
        F.lit(""),
        lambda text, step: F.when(step == ELEMENT, F.concat(text, F.lit(ELEMENT)))
        .when(text == "", step)
        .otherwise(F.concat(text, F.lit("."), step)),
    )


# --- the bodies of endpoints and sockets ---------------------------------------


def endpoint_bodies(keyed: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Bodies by side: ``request``, ``response`` (successes only, when any has a body) and ``error:<status>``.

    ``base`` tells per endpoint whether a successful answer had a body; it has one row per
    endpoint, so Spark chooses how to join it from its measured size.
    """
    flags = base.select(*key, "success_sampled")
    ok = F.col("status").between(200, 299)
    sides = F.array(
        F.struct(F.lit("request").alias("side"), F.col("request_body").alias("body")),
        F.struct(
            F.lit("response").alias("side"),
            F.when(ok | ~F.col("success_sampled"), F.col("response_body")).alias("body"),
        ),
        F.struct(
            F.concat(F.lit("error:"), F.col("status").cast("string")).alias("side"),
            F.when(F.col("status") >= 400, F.col("response_body")).alias("body"),
        ),
    )
    return (
        keyed.select(*key, "status", "request_body", "response_body")
        .where("request_body is not null or response_body is not null")
        .join(flags, key)
        .select(*key, F.explode(sides).alias("s"))
        .where("s.body is not null")
        .select(*key, "s.side", "s.body")
    )


def endpoint_schema_paths(keyed: DataFrame, base: DataFrame, key: list[str], limits: Limits = DEFAULT) -> DataFrame:
    keys = [*key, "side"]
    return schema_paths(body_nodes(endpoint_bodies(keyed, base, key), keys, "body", limits), keys, limits)


def frame_schema_paths(frames: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Message shapes per connection and direction; only text frames count."""
    keys = ["scan_id", "conn_seq", "direction"]
    return schema_paths(body_nodes(frames.where(F.col("type") == "text"), keys, "payload", limits), keys, limits)


def frame_gaps(frames: DataFrame, truncated: DataFrame, has_schema: DataFrame) -> DataFrame:
    """Why a direction of a connection has no complete message shape.

    ``truncated`` has ``(scan_id, conn_seq, frames_truncated)``; ``has_schema`` one row per
    connection and direction with a shape. A direction without frames is ``no-body``.
    """
    keys = ["scan_id", "conn_seq", "direction"]
    is_text = F.col("type") == "text"
    seen = frames.groupBy(*keys).agg(
        F.bool_or("truncated").alias("cut"),
        F.bool_and(F.col("type") == "binary").alias("all_binary"),
        F.bool_and(~is_text | F.col("payload").isNull()).alias("no_text"),
        F.count(F.lit(1)).alias("n"),
    )
    both = F.explode(F.array(F.lit("sent"), F.lit("received")))
    shaped = has_schema.select(*keys).distinct().withColumn("shaped", F.lit(True))
    return (
        truncated.select("scan_id", "conn_seq", "frames_truncated", both.alias("direction"))
        .join(seen, keys, "left")
        .join(shaped, keys, "left")
        .select(
            *keys,
            F.when(F.col("frames_truncated") | F.coalesce("cut", F.lit(False)), F.lit("truncated"))
            .when(F.col("n").isNull(), F.lit("no-body"))
            .when(F.col("all_binary"), F.lit("binary"))
            .when(F.col("shaped"), F.lit(None).cast("string"))
            .when(F.col("no_text"), F.lit("no-body"))
            .otherwise(F.lit("not-json"))
            .alias("reason"),
        )
    )


def worst_gap(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """The most consequential gap reason per key, null when there is none."""
    return rows.groupBy(*keys).agg(gap_name(F.max(gap_rank(F.col(reason)))).alias(reason))
