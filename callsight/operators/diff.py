"""Comparison of two scans of the same site.

The inputs are the endpoint tables of both scans, joined on endpoint id. Every
rule yields detail rows ``(id, part, text, breaking)``; :func:`changes` folds
them into one row per added, removed or changed endpoint or socket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import describe_statuses, format_bytes, gap_phrase, show_value
from callsight.operators.endpoints import endpoint_id
from callsight.operators.shape import ELEMENT, path_text
from callsight.operators.sizing import settle

DETAIL = ["id", "part", "text", "breaking"]


@dataclass
class Snapshot:
    """The tables of one scan, each keyed by endpoint ``id``.

    * endpoints: id, status_codes, category, p95_response_bytes, request_gap, response_gap
    * params: id, name
    * shapes: id, side, path, types, enum, minimum, maximum
    * errors: id, status, schema_reason
    * vendors: id, vendor, vendor_category, payload_keys
    * operations: id, type, name, selections, arguments
    * introspection: id, introspection
    * sockets: id (``WS <url>``), frame_count, sent_gap, received_gap; their shapes use the sides
      ``sent`` and ``received``
    """

    endpoints: DataFrame
    params: DataFrame | None = None
    shapes: DataFrame | None = None
    errors: DataFrame | None = None
    vendors: DataFrame | None = None
    operations: DataFrame | None = None
    introspection: DataFrame | None = None
    sockets: DataFrame | None = None


def snapshot(tables: dict[str, DataFrame], scan_id: str) -> Snapshot:
    """One scan of the report tables (see :mod:`callsight.plans.report`)."""

    def scan(name: str, *columns: str) -> DataFrame | None:
        rows = tables.get(name)
        if rows is None:
            return None
        rows = rows.where(F.col("scan_id") == scan_id)
        rows = rows if "id" in rows.columns else rows.withColumn("id", endpoint_id())
        return rows.select(*columns) if columns else rows

    endpoints = scan("endpoints")
    return Snapshot(
        endpoints=endpoints.select(
            "id", "status_codes", "category", F.col("response_bytes.p95").alias("p95_response_bytes"), "request_gap", "response_gap"
        ),
        params=scan("params", "id", "name"),
        shapes=scan("shapes", "id", "side", "path", "types", "enum", "minimum", "maximum"),
        errors=scan("errors", "id", "status", "schema_reason"),
        vendors=scan("vendors", "id", "vendor", "vendor_category", "payload_keys"),
        operations=scan("operations"),
        introspection=scan("introspection"),
        sockets=scan("sockets"),
    )


def _sides(before: DataFrame, after: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join two tables with equal columns; the others get a ``b_`` or ``a_`` prefix."""
    named = lambda rows, prefix: rows.select(
        *on, *[F.col(c).alias(f"{prefix}{c}") for c in rows.columns if c not in on], F.lit(True).alias(f"{prefix}seen")
    )
    return named(before, "b_").join(named(after, "a_"), on, how)


def presence(before: DataFrame, after: DataFrame, added: Column, removed: Column) -> DataFrame:
    """Rows only one side has. ``added`` and ``removed`` are texts over the ``a_`` and ``b_`` columns."""
    both = _sides(before, after, ["id"], "full_outer")
    return both.where("b_seen is null or a_seen is null").select(
        "id",
        F.when(F.col("b_seen").isNull(), F.lit("added")).otherwise(F.lit("removed")).alias("kind"),
        F.col("a_seen").isNull().alias("breaking"),
        F.when(F.col("b_seen").isNull(), added).otherwise(removed).alias("text"),
    )


def _detail(rows: DataFrame, part: int, text: Column, breaking: Column | bool) -> DataFrame:
    flag = F.lit(breaking) if isinstance(breaking, bool) else breaking
    return rows.select("id", F.lit(part).alias("part"), text.alias("text"), flag.alias("breaking"))


def diff_statuses(before: DataFrame, after: DataFrame) -> DataFrame:
    both = _sides(before.select("id", "status_codes"), after.select("id", "status_codes"), ["id"], "inner")
    success = lambda name: F.exists(name, lambda s: s.between(200, 299))
    lost = success("b_status_codes") & ~success("a_status_codes")
    text = F.concat(
        F.lit("status codes "),
        describe_statuses("b_status_codes"),
        F.lit(" → "),
        describe_statuses("a_status_codes"),
        F.when(lost, F.lit(" (no longer returns 2xx)")).otherwise(F.lit("")),
    )
    return _detail(both.where(F.col("b_status_codes") != F.col("a_status_codes")), 1, text, lost)


def diff_category(before: DataFrame, after: DataFrame) -> DataFrame:
    both = _sides(before.select("id", "category"), after.select("id", "category"), ["id"], "inner")
    text = F.concat(F.lit("category "), "b_category", F.lit(" → "), "a_category")
    return _detail(both.where("b_category <> a_category"), 2, text, False)


def _shared_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("id").join(after.select("id"), "id", "left_semi")


def diff_vendors(before: Snapshot, after: Snapshot) -> DataFrame:
    """Vendor, vendor category and payload key drift of endpoints both scans have."""
    shared = _shared_ids(before.endpoints, after.endpoints)
    both = _sides(before.vendors, after.vendors, ["id"], "full_outer").join(shared, "id", "left_semi")
    unnamed = lambda name: F.coalesce(name, F.lit("unattributed"))
    other = ~F.col("b_vendor").eqNullSafe(F.col("a_vendor"))
    renamed = _detail(both.where(other), 3, F.concat(F.lit("vendor "), unnamed("b_vendor"), F.lit(" → "), unnamed("a_vendor")), False)
    same = both.where(~other)
    category = _detail(
        same.where("b_vendor_category <> a_vendor_category"),
        4,
        F.concat(F.lit("vendor category "), "b_vendor_category", F.lit(" → "), "a_vendor_category"),
        False,
    )
    gained, lost = F.array_except("a_payload_keys", "b_payload_keys"), F.array_except("b_payload_keys", "a_payload_keys")
    added = _detail(
        same.where(F.size(gained) > 0), 5, F.concat(F.lit("vendor payload keys added: "), F.array_join(gained, ", ")), False
    )
    gone = _detail(
        same.where(F.size(lost) > 0),
        6,
        F.concat(F.lit("vendor payload keys not observed this time: "), F.array_join(lost, ", ")),
        False,
    )
    return renamed.unionByName(category).unionByName(added).unionByName(gone)


def diff_growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """Responses whose p95 size grew by half and by at least 5 kB."""
    both = _sides(before.select("id", "p95_response_bytes"), after.select("id", "p95_response_bytes"), ["id"], "inner")
    old, new = F.col("b_p95_response_bytes"), F.col("a_p95_response_bytes")
    grew = new - old
    percent = F.floor(grew * 100 / old + 0.5).cast("bigint").cast("string")
    text = F.concat(
        F.lit("response payload grew sharply: p95 "),
        format_bytes(old),
        F.lit(" → "),
        format_bytes(new),
        F.lit(" (+"),
        percent,
        F.lit("%)"),
    )
    sharp = (old > 0) & (grew >= fv.GROWTH_MIN_BYTES) & (new >= old * fv.GROWTH_RATIO)
    return _detail(both.where(sharp), 7, text, False)


# --- shapes --------------------------------------------------------------------


def side_gaps(snapshot: Snapshot) -> DataFrame:
    """Every side a shape could have, with its gap reason: (id, side, reason)."""
    ends = snapshot.endpoints.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("response").alias("side"), F.col("response_gap").alias("reason")),
                F.struct(F.lit("request").alias("side"), F.col("request_gap").alias("reason")),
            )
        ).alias("s"),
    ).select("id", "s.side", "s.reason")
    errors = snapshot.errors.select(
        "id", F.concat(F.lit("error:"), F.col("status").cast("string")).alias("side"), F.col("schema_reason").alias("reason")
    )
    rows = ends.unionByName(errors)
    if snapshot.sockets is not None:
        rows = rows.unionByName(
            snapshot.sockets.select(
                "id",
                F.explode(
                    F.array(
                        F.struct(F.lit("sent").alias("side"), F.col("sent_gap").alias("reason")),
                        F.struct(F.lit("received").alias("side"), F.col("received_gap").alias("reason")),
                    )
                ).alias("s"),
            ).select("id", "s.side", "s.reason")
        )
    return rows


def _label(side: Column) -> Column:
    return (
        F.when(side == "response", F.lit("response"))
        .when(side == "request", F.lit("request body"))
        .when(side == "sent", F.lit("WebSocket sent message"))
        .when(side == "received", F.lit("WebSocket received message"))
        .otherwise(F.concat(F.lit("error response "), F.replace(side, F.lit("error:"), F.lit(""))))
    )


def comparable_sides(before: Snapshot, after: Snapshot) -> DataFrame:
    """Sides both scans have, with what stands in the way of comparing them (``verdict``)."""
    shaped = lambda snap: snap.shapes.where(F.size("path") == 0).select("id", "side").distinct()
    with_shape = lambda snap: side_gaps(snap).join(
        shaped(snap).withColumn("shaped", F.lit(True)), ["id", "side"], "left"
    ).withColumn("shaped", F.coalesce("shaped", F.lit(False)))
    both = _sides(with_shape(before), with_shape(after), ["id", "side"], "inner")
    note = F.coalesce("a_reason", "b_reason")
    verdict = (
        F.when(~F.col("b_shaped") & ~F.col("a_shaped"), F.lit("none"))
        .when(~F.col("b_shaped"), F.lit("new"))
        .when(~F.col("a_shaped"), F.lit("gone"))
        .when(note.isNotNull(), F.lit("partial"))
        .otherwise(F.lit("compare"))
    )
    return both.select("id", "side", note.alias("note"), verdict.alias("verdict"))


def diff_shape_presence(sides: DataFrame) -> DataFrame:
    """Shapes that appeared, vanished, or were seen too incompletely to compare."""
    label, phrase = _label(F.col("side")), gap_phrase(F.col("note"))
    text = (
        F.when(F.col("verdict") == "new", F.concat(label, F.lit(" schema newly inferred")))
        .when(
            F.col("verdict") == "gone",
            F.concat(
                label,
                F.lit(" schema no longer inferred"),
                F.when(phrase.isNotNull(), F.concat(F.lit(" ("), phrase, F.lit(")"))).otherwise(F.lit("")),
            ),
        )
        .otherwise(F.concat(label, F.lit(" not fully observed ("), phrase, F.lit("); shape not compared")))
    )
    return _detail(sides.where(F.col("verdict").isin("new", "gone", "partial")), 8, text, False)


def _outside_unions(shapes: DataFrame) -> DataFrame:
    """Paths none of whose ancestors has several types: a union is compared as a whole."""
    unions = shapes.where(F.size("types") > 1).select("id", "side", F.col("path").alias("ancestor"))
    below = (
        shapes.where(F.size("path") > 0)
        .select("id", "side", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 1)).alias("n"))
        .withColumn("ancestor", F.slice("path", F.lit(1), F.col("n")))
        .join(unions, ["id", "side", "ancestor"], "left_semi")
        .select("id", "side", "path")
    )
    return shapes.join(below, ["id", "side", "path"], "left_anti")


def _number_text(value: Column) -> Column:
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def diff_schema(before: Snapshot, after: Snapshot, sides: DataFrame | None = None) -> DataFrame:
    """Type, enum, bound and field changes of the shapes both scans observed in full."""
    sides = comparable_sides(before, after) if sides is None else sides
    compared = sides.where(F.col("verdict") == "compare").select("id", "side")
    reached = lambda snap: _outside_unions(snap.shapes.join(compared, ["id", "side"], "left_semi"))
    # Shapes are small next to the calls they describe; every rule below reads this one table.
    both = settle(_sides(reached(before), reached(after), ["id", "side", "path"], "full_outer"))

    label = _label(F.col("side"))
    text = path_text()
    where = F.when(text == "", F.lit("(root)")).otherwise(text)
    at = F.concat(label, F.lit(" "), where, F.lit(": "))

    pairs = both.where("b_seen and a_seen")
    same = F.col("b_types") == F.col("a_types")
    names = lambda column: F.array_join(F.filter(column, lambda t: t.isNotNull()), "|")
    types = _detail(
        pairs.where(~same), 9, F.concat(at, F.lit("type "), names("b_types"), F.lit(" → "), names("a_types")), True
    )
    equal = pairs.where(same)
    shown = lambda values: F.array_join(F.transform(values, show_value), ", ")
    lost, gained = F.array_except("b_enum", "a_enum"), F.array_except("a_enum", "b_enum")
    enums = [
        _detail(
            equal.where("b_enum is null and a_enum is not null"),
            10,
            F.concat(at, F.lit("enum added ("), shown("a_enum"), F.lit(")")),
            True,
        ),
        _detail(
            equal.where("b_enum is not null and a_enum is null"),
            10,
            F.concat(at, F.lit("enum no longer inferred (was "), shown("b_enum"), F.lit(")")),
            False,
        ),
        _detail(equal.where(F.size(lost) > 0), 10, F.concat(at, F.lit("enum values removed: "), shown(lost)), True),
        _detail(equal.where(F.size(gained) > 0), 11, F.concat(at, F.lit("enum values added: "), shown(gained)), False),
    ]
    bounds = []
    for part, name in ((12, "minimum"), (13, "maximum")):
        old, new = F.col(f"b_{name}"), F.col(f"a_{name}")
        inward = new > old if name == "minimum" else new < old
        spelled = lambda value: F.coalesce(_number_text(value), F.lit("unbounded"))
        bounds.append(
            _detail(
                equal.where(~old.eqNullSafe(new)),
                part,
                F.concat(at, F.lit(f"{name} "), spelled(old), F.lit(" → "), spelled(new)),
                old.isNull() | F.coalesce(inward, F.lit(False)),
            )
        )
    # A field only one side has is reported where its parent exists on both.
    is_field = (F.size("path") > 0) & F.coalesce(F.try_element_at("path", F.lit(-1)) != ELEMENT, F.lit(False))
    parents = pairs.select("id", "side", F.col("path").alias("parent"))
    single = both.where("b_seen is null or a_seen is null").where(is_field)
    topmost = single.withColumn("parent", F.slice("path", F.lit(1), F.size("path") - 1)).join(
        parents, ["id", "side", "parent"], "left_semi"
    )
    removed = _detail(topmost.where("a_seen is null"), 14, F.concat(label, F.lit(" field removed: "), text), True)
    added = _detail(topmost.where("b_seen is null"), 15, F.concat(label, F.lit(" field added: "), text), False)
    rows = types
    for other in [*enums, *bounds, removed, added]:
        rows = rows.unionByName(other)
    return rows


def diff_params(before: Snapshot, after: Snapshot) -> DataFrame:
    """Query parameter names that appeared, or were not observed this time."""
    shared = _shared_ids(before.endpoints, after.endpoints)
    both = _sides(before.params.distinct(), after.params.distinct(), ["id", "name"], "full_outer").join(
        shared, "id", "left_semi"
    )
    gone = F.col("a_seen").isNull()
    listed = (
        both.where("b_seen is null or a_seen is null")
        .groupBy("id", gone.alias("gone"))
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    )
    text = F.when(F.col("gone"), F.concat(F.lit("query parameters not observed this time: "), "names")).otherwise(
        F.concat(F.lit("new query parameters: "), "names")
    )
    return _detail(listed, 16, text, False)


def diff_graphql(before: Snapshot, after: Snapshot) -> DataFrame:
    """Operations, their selections and arguments, and introspection."""
    shared = _shared_ids(before.endpoints, after.endpoints)
    flags = settle(_sides(before.introspection, after.introspection, ["id"], "full_outer").join(shared, "id", "left_semi"))
    stopped = _detail(flags.where("a_seen is null"), 17, F.lit("GraphQL requests no longer observed on this endpoint"), False)
    turned_on = F.coalesce("a_introspection", F.lit(False)) & ~F.coalesce("b_introspection", F.lit(False))
    seen = _detail(flags.where(F.col("a_seen") & turned_on), 22, F.lit("GraphQL introspection newly observed"), False)
    unseen = _detail(
        flags.where("b_seen and a_seen and b_introspection and not a_introspection"),
        22,
        F.lit("GraphQL introspection no longer observed"),
        False,
    )
    keyed = lambda rows: rows.select(
        "id",
        F.concat_ws(":", "type", F.coalesce("name", F.lit(""))).alias("op"),
        F.concat(F.coalesce("name", F.lit("anonymous")), F.lit(" ("), "type", F.lit(")")).alias("shown"),
        F.coalesce("name", F.lit("anonymous")).alias("name"),
        "selections",
        "arguments",
    )
    state = flags.select("id", F.col("b_seen").alias("b_gql"), F.col("a_seen").alias("a_gql"))
    ops = settle(
        _sides(keyed(before.operations), keyed(after.operations), ["id", "op"], "full_outer").join(
            state.where("a_gql"), "id"
        )
    )
    one_sided = (
        ops.where("b_seen is null or a_seen is null")
        .groupBy("id", F.col("a_seen").isNull().alias("gone"), F.col("b_gql").isNull().alias("fresh"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("a_shown", "b_shown"))), ", ").alias("ops"))
    )
    listed = _detail(
        one_sided,
        18,
        F.when(F.col("fresh"), F.concat(F.lit("GraphQL operations newly observed: "), "ops"))
        .when(F.col("gone"), F.concat(F.lit("GraphQL operations not observed this time: "), "ops"))
        .otherwise(F.concat(F.lit("new GraphQL operations: "), "ops")),
        F.col("gone"),
    )
    rows = stopped.unionByName(seen).unionByName(unseen).unionByName(listed)
    pairs = ops.where("b_seen and a_seen")
    for part, kind, column in ((19, "selection", "selections"), (20, "argument", "arguments")):
        lost, gained = F.array_except(f"b_{column}", f"a_{column}"), F.array_except(f"a_{column}", f"b_{column}")
        prefix = F.concat(F.lit("GraphQL "), "a_name", F.lit(f" {kind}(s) "))
        rows = rows.unionByName(
            _detail(pairs.where(F.size(lost) > 0), part, F.concat(prefix, F.lit("removed: "), F.array_join(lost, ", ")), True)
        ).unionByName(
            _detail(pairs.where(F.size(gained) > 0), part, F.concat(prefix, F.lit("added: "), F.array_join(gained, ", ")), False)
        )
    return rows


# --- all together --------------------------------------------------------------


def change_details(before: Snapshot, after: Snapshot) -> DataFrame:
    """Detail rows of endpoints and sockets both scans have."""
    sides = settle(comparable_sides(before, after))
    rows = (
        diff_statuses(before.endpoints, after.endpoints)
        .unionByName(diff_category(before.endpoints, after.endpoints))
        .unionByName(diff_vendors(before, after))
        .unionByName(diff_growth(before.endpoints, after.endpoints))
        .unionByName(diff_shape_presence(sides))
        .unionByName(diff_schema(before, after, sides))
        .unionByName(diff_params(before, after))
    )
    if before.introspection is not None and after.introspection is not None:
        rows = rows.unionByName(diff_graphql(before, after))
    return rows


def latest_sockets(sockets: DataFrame) -> DataFrame:
    """One connection per URL: the last one opened stands for the others."""
    last = sockets.groupBy("scan_id", "url").agg(F.max("conn_seq").alias("conn_seq"))
    return sockets.join(last, ["scan_id", "url", "conn_seq"], "left_semi").withColumn("id", F.concat(F.lit("WS "), "url"))


def changes(before: Snapshot, after: Snapshot, details: DataFrame | None = None) -> DataFrame:
    """One row per added, removed or changed endpoint: kind, breaking flag and ordered details."""
    details = change_details(before, after) if details is None else details
    only = presence(
        before.endpoints.select("id", "status_codes"),
        after.endpoints.select("id", "status_codes"),
        F.concat(F.lit("new endpoint (observed "), describe_statuses("a_status_codes"), F.lit(")")),
        F.concat(F.lit("not observed in this scan (was "), describe_statuses("b_status_codes"), F.lit(")")),
    )
    if before.sockets is not None and after.sockets is not None:
        frames = lambda name: F.concat(F.col(name).cast("string"), F.lit(" frame(s)"))
        only = only.unionByName(
            presence(
                before.sockets.select("id", "frame_count"),
                after.sockets.select("id", "frame_count"),
                F.concat(F.lit("new WebSocket connection (observed "), frames("a_frame_count"), F.lit(")")),
                F.concat(F.lit("not observed in this scan (was "), frames("b_frame_count"), F.lit(")")),
            )
        )
    changed = details.groupBy("id").agg(
        F.lit("changed").alias("kind"),
        F.bool_or("breaking").alias("breaking"),
        F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda d: d["text"]).alias("details"),
    )
    return only.select("id", "kind", "breaking", F.array("text").alias("details")).unionByName(changed)


def change_counts(rows: DataFrame) -> DataFrame:
    kind = lambda name: F.count_if(F.col("kind") == name).alias(name)
    return rows.agg(kind("added"), kind("removed"), kind("changed"), F.count_if("breaking").alias("breaking"))


def gate(rows: DataFrame) -> DataFrame:
    """Whether anything changed, and whether anything broke."""
    return rows.agg(
        (F.count(F.lit(1)) > 0).alias("has_changes"), F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("breaking")
    )


def change_summary(rows: DataFrame, limit: int = fv.SUMMARY_ITEMS) -> DataFrame:
    """The first changes by id as text lines; the rest is counted in ``more``."""
    mark = F.when(F.col("kind") == "added", F.lit("+")).when(F.col("kind") == "removed", F.lit("-")).otherwise(F.lit("~"))
    line = F.concat(mark, F.lit(" "), "id", F.when(F.col("breaking"), F.lit(" [breaking]")).otherwise(F.lit("")))
    more = rows.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more")).scalar()
    return rows.orderBy("id").limit(limit).select("id", line.alias("line"), "details", more.alias("more"))


def engine_note(before_engine: Column, after_engine: Column) -> Column:
    """A caution when both scans name their engine and the names differ."""
    text = F.concat(
        F.lit("Note: the baseline ran in "),
        before_engine,
        F.lit(" and this scan in "),
        after_engine,
        F.lit(" — some differences may be engine-specific."),
    )
    return F.when((before_engine != "") & (after_engine != "") & (before_engine != after_engine), text)
