"""Report views over the endpoint table: search, sort, group, top lists, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import format_duration
from callsight.operators.endpoints import KEY


def sort_endpoints(endpoints: DataFrame) -> DataFrame:
    """Category, then id, in byte order."""
    return endpoints.orderBy("scan_id", "category", "id")


def _top(endpoints: DataFrame, value: Column, limit: int) -> DataFrame:
    best = Window.partitionBy("scan_id").orderBy(value.desc(), F.col("category"), F.col("id"))
    ranked = endpoints.where(value.isNotNull()).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= limit)


def slowest_endpoints(endpoints: DataFrame, limit: int = fv.TOP_ENDPOINTS) -> DataFrame:
    """Highest p95 latency per scan."""
    return _top(endpoints, F.col("timing.p95"), limit)


def largest_responses(endpoints: DataFrame, limit: int = fv.TOP_ENDPOINTS) -> DataFrame:
    """Highest p95 response size per scan."""
    return _top(endpoints, F.col("response_bytes.p95"), limit)


def all_rows(endpoints: DataFrame, removed: DataFrame | None = None, sockets: DataFrame | None = None) -> DataFrame:
    """Endpoints, rows for endpoints only the baseline had, and socket rows, as one table."""
    rows = endpoints
    for extra in (removed, sockets):
        if extra is not None:
            rows = rows.unionByName(extra, allowMissingColumns=True)
    return rows


def removed_rows(changes: DataFrame, scan_id: str) -> DataFrame:
    """A minimal row per removed endpoint."""
    split = F.instr("id", " ")
    return changes.where(F.col("kind") == "removed").select(
        F.lit(scan_id).alias("scan_id"),
        "id",
        F.when(split == 0, F.lit("—")).otherwise(F.substring_index("id", " ", 1)).alias("method"),
        F.when(split == 0, F.col("id")).otherwise(F.expr("substring(id, instr(id, ' ') + 1)")).alias("url_pattern"),
        F.lit("__removed").alias("category"),
    )


def socket_rows(sockets: DataFrame) -> DataFrame:
    """A row per connection, shaped like an endpoint."""
    return sockets.select(
        "scan_id",
        F.concat(F.lit("WS "), "url").alias("id"),
        F.lit("WS").alias("method"),
        F.col("url").alias("url_pattern"),
        F.lit("websocket").alias("category"),
        F.col("frame_count").alias("count"),
    )


def annotate_changes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with what happened to them since the baseline, ``unchanged`` when nothing did."""
    marks = changes.select("id", F.col("kind").alias("change"), F.col("breaking").alias("change_breaking"))
    return rows.join(marks, "id", "left").withColumns(
        {
            "change": F.coalesce("change", F.lit("unchanged")),
            "change_breaking": F.coalesce("change_breaking", F.lit(False)),
        }
    )


def search_text(endpoint: DataFrame) -> Column:
    """Lower-cased text of the fields that are part of the row; long lists are searched as rows."""
    have = set(endpoint.columns)
    listed = lambda name: F.array_join(F.transform(name, lambda v: v.cast("string")), " ")
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("id", "method", "url_pattern", "category") if c in have]
    parts += [F.coalesce(listed(c), F.lit("")) for c in ("status_codes", "path_params", "payload_keys") if c in have]
    parts += [F.coalesce(F.col(c), F.lit("")) for c in ("vendor", "vendor_category") if c in have]
    if "cache" in have:
        parts.append(F.concat_ws(" ", F.col("cache.control"), F.col("cache.etag"), F.col("cache.status")))
    if "is_graphql" in have:
        parts.append(F.when(F.col("is_graphql"), F.lit("graphql")).otherwise(F.lit("")))
    return F.lower(F.concat_ws(" ", *parts))


def endpoint_filter(
    rows: DataFrame,
    query: str = "",
    category: str | None = None,
    method: str | None = None,
    status: int | None = None,
    breaking: bool = False,
    changed: bool = False,
    values: DataFrame | None = None,
    params: DataFrame | None = None,
    operations: DataFrame | None = None,
) -> DataFrame:
    """The rows a reader asked for.

    Origins, MIME types, pages, parameter names and operations are searched in their own tables,
    so no list is built to be searched.
    """
    kept = rows
    if category is not None:
        kept = kept.where(F.col("category") == category)
    if method is not None:
        kept = kept.where(F.col("method") == method)
    if status is not None:
        kept = kept.where(F.array_contains("status_codes", status))
    if breaking:
        kept = kept.where("change_breaking")
    if changed:
        kept = kept.where(F.col("change") != "unchanged")
    text = query.strip().lower()
    if not text:
        return kept
    hits = lambda column: F.contains(F.lower(column), F.lit(text))
    found = kept.where(F.contains(search_text(kept), F.lit(text))).select(*KEY)
    for extra, column in ((values, "value"), (params, "name"), (operations, "name")):
        if extra is not None:
            found = found.unionByName(extra.where(hits(F.col(column))).select(*KEY))
    return kept.join(found.distinct(), KEY, "left_semi")


def endpoint_sort(rows: DataFrame, key: str, descending: bool = False, pages: DataFrame | None = None) -> DataFrame:
    """Order rows by method, path, category, status, count, time, pages or change."""
    if key == "pages" and pages is not None:
        rows = rows.join(pages, KEY, "left")
    change = F.when(F.col("change") != "unchanged", F.concat(F.when(F.col("change_breaking"), "0").otherwise("1"), "change"))
    keys = {
        "method": lambda: F.col("method"),
        "path": lambda: F.col("url_pattern"),
        "category": lambda: F.col("category"),
        "status": lambda: F.coalesce(F.array_min("status_codes"), F.lit(-1)),
        "count": lambda: F.coalesce("count", F.lit(-1)),
        "time": lambda: F.coalesce("timing.p95", F.lit(-1)),
        "pages": lambda: F.coalesce("pages", F.lit(-1)),
        "change": lambda: F.coalesce(change, F.lit("" if descending else "~")),
    }
    column = keys[key]()
    return rows.orderBy(column.desc() if descending else column.asc(), "category", "id")


def page_counts(values: DataFrame) -> DataFrame:
    """Triggering pages per endpoint."""
    return values.where(F.col("kind") == "page").groupBy(*KEY).agg(F.count(F.lit(1)).alias("pages"))


def group_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows per group, with the place of the group's first row in category and id order."""
    return rows.groupBy("scan_id", F.col(key).alias("group")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("category", "id")).alias("first")
    )


def category_summary(endpoints: DataFrame) -> DataFrame:
    """Endpoints and calls per category, in the fixed category order (``position``)."""
    position = F.array_position(F.array(*[F.lit(c) for c in fv.CATEGORIES]), F.col("category"))
    return endpoints.groupBy("scan_id", "category").agg(
        F.count(F.lit(1)).alias("endpoints"), F.sum("count").alias("calls")
    ).withColumn("position", position.cast("int"))


def auth_flows(endpoints: DataFrame) -> DataFrame:
    return endpoints.where(F.col("category") == "authentication").select(*KEY, "id", "status_codes", "count")


def third_party_calls(endpoints: DataFrame, vendors: DataFrame) -> DataFrame:
    """Third-party endpoints with their vendor; their origins stay in the values table."""
    third = endpoints.where(F.col("category") == "third-party").select(*KEY, "id", "count")
    return third.join(vendors.select(*KEY, "vendor"), KEY, "left")


def scorecard(
    scans: DataFrame,
    endpoints: DataFrame,
    resources: DataFrame,
    technologies: DataFrame,
    findings: DataFrame,
    pages: DataFrame,
    breaking: DataFrame | None = None,
) -> DataFrame:
    """One row per scan: how much was found. ``scans`` lists the scan ids."""
    count = lambda rows, name: rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias(name))
    severity = lambda level: F.count_if(F.col("severity") == level).alias(level)
    folded = findings.groupBy("scan_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))
    tables = [
        count(endpoints, "endpoints"),
        resources.groupBy("scan_id").agg(F.count_distinct("resource").alias("resources")),
        count(technologies, "technologies"),
        folded.groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"), *[severity(s) for s in fv.SEVERITIES]),
        count(pages, "pages"),
    ]
    if breaking is not None:
        tables.append(breaking)
    card = scans.select("scan_id")
    for table in tables:
        card = card.join(table, "scan_id", "left")
    return card.na.fill(0)


def scorecard_line(duration_ms: Column) -> Column:
    """The scorecard as one sentence."""
    many = lambda name, one, more: F.concat(
        F.col(name).cast("string"), F.lit(" "), F.when(F.col(name) == 1, F.lit(one)).otherwise(F.lit(more))
    )
    some = lambda name, one, more: F.when(F.col(name) > 0, many(name, one, more))
    parts = [
        many("endpoints", "endpoint", "endpoints"),
        some("resources", "resource", "resources"),
        some("technologies", "technology", "technologies"),
        F.coalesce(
            some("high", "high-severity finding", "high-severity findings"), some("findings", "finding", "findings")
        ),
        F.concat(many("pages", "page", "pages"), F.lit(" in "), format_duration(duration_ms)),
    ]
    return F.concat(F.lit("Scorecard — "), F.concat_ws(" · ", *parts))


def has_contract(endpoints: DataFrame, params: DataFrame, shapes: DataFrame, errors: DataFrame) -> DataFrame:
    """Endpoints with anything to say about their contract."""
    described = params.select(*KEY).unionByName(shapes.select(*KEY)).unionByName(errors.select(*KEY)).distinct()
    flagged = endpoints.join(described.withColumn("_described", F.lit(True)), KEY, "left")
    own = (
        F.col("request_gap").isNotNull()
        | F.col("response_gap").isNotNull()
        | (F.size("path_params") > 0)
        | F.col("is_graphql")
    )
    return flagged.where(F.coalesce("_described", F.lit(False)) | own).drop("_described")


# --- share-safe tables: columns that cannot hold a captured value ----------------

SHARE_COLUMNS = {
    "endpoints": ["scan_id", "method", "url_pattern", "category", "status_codes", "count", "path_params", "request_gap", "response_gap"],
    "params": ["scan_id", "method", "url_pattern", "name"],
    "shapes": ["scan_id", "method", "url_pattern", "side", "path", "types", "format", "required", "enum", "minimum", "maximum"],
    "errors": ["scan_id", "method", "url_pattern", "status", "schema_reason"],
    "vendors": ["scan_id", "method", "url_pattern", "vendor", "vendor_category"],
    "operations": ["scan_id", "method", "url_pattern", "type", "name", "selections"],
    "technologies": ["scan_id", "name", "category"],
    "findings": ["scan_id", "kind", "severity", "title", "endpoint"],
    "changes": ["id", "kind", "breaking"],
}


def share_safe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Only allow-listed columns of every table; tables without an entry are left out."""
    return {name: tables[name].select(*columns) for name, columns in SHARE_COLUMNS.items() if name in tables}


def share_sockets(sockets: DataFrame) -> DataFrame:
    """Connections by path and counters: a query string could hold a token."""
    path = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "url")
    return sockets.select("scan_id", path.alias("path"), "frame_count", "sent_count", "received_count")
