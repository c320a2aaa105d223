"""Endpoint roll-up: calls grouped by scan, method and URL pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.categories import categorize
from callsight.functions.graphql import is_graphql_request
from callsight.functions.text import cache_info, gap_name, gap_rank, has_cache_info, is_sensitive_param, request_gap, response_gap
from callsight.functions.memo import reused
from callsight.functions.urls import (
    marked_path, normalize_url, parts_of, path_params, pattern_of, query_entries, sorted_fields, trimmed_path, url_fields, url_host, url_origin
)
from callsight.functions.vendors import vendor_of
from callsight.operators.selection import nearest_rank
from callsight.operators.sizing import settle

KEY = ["scan_id", "method", "url_pattern"]


def endpoint_id(method: Column | str = "method", pattern: Column | str = "url_pattern") -> Column:
    return F.concat_ws(" ", method, pattern)


@reused
def _key_columns() -> dict[str, Column]:
    parts = F.col("_url")
    return {
        # Key columns end in a literal, so they are visibly never null: joins on them add no
        # null filter, which would parse every URL once more.
        "scan_id": F.coalesce("scan_id", F.lit("")),
        "method": F.coalesce(F.upper("method"), F.lit("")),
        "url": normalize_url("url", parts, F.col("_fields")),
        "host": parts["host"],
        "path": parts["path"],
        "origin": url_origin("url", parts),
        "url_pattern": F.coalesce(pattern_of(F.col("_path"), F.col("_marked")), F.col("url"), F.lit("")),
        "mime_type": F.trim(F.substring_index(F.coalesce("mime_type", F.lit("")), ";", 1)),
        "status": F.coalesce("status", F.lit(0)),
    }


def keyed_calls(calls: DataFrame) -> DataFrame:
    """Calls with normalised URL, host, path, origin and URL pattern; each URL is parsed once.

    The steps are columns, so that Spark compiles them. The page stays as recorded: :func:`endpoint_values`
    normalises it once for all calls that an endpoint owes to it.
    """
    fields = calls.withColumn("_url", url_fields("url")).withColumn("_url", parts_of(F.col("_url")))
    steps = fields.withColumns({"_fields": sorted_fields(F.col("_url.query")), "_path": trimmed_path(F.col("_url.path"))})
    marked = steps.withColumn("_marked", marked_path(F.col("_path")))
    return marked.withColumns(_key_columns()).drop("_url", "_fields", "_path", "_marked")


def _first_where(condition: Column) -> Column:
    return F.min(F.when(condition, F.col("call_seq")))


def status_rollup(keyed: DataFrame) -> DataFrame:
    """One row per endpoint and status. Every buffer is a number, so the map side hashes and nothing is sorted."""
    return keyed.groupBy(*KEY, "status").agg(*_status_measures())


@reused
def _status_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.min("call_seq").alias("first_seq"),
        F.max("call_seq").alias("last_seq"),
        _first_where(F.col("request_body").isNotNull()).alias("request_seq"),
        _first_where(F.col("response_body").isNotNull()).alias("response_seq"),
        _first_where(F.col("request_body_file").isNotNull()).alias("request_file_seq"),
        _first_where(F.col("response_body_file").isNotNull()).alias("response_file_seq"),
        _first_where(has_cache_info("response_headers")).alias("cache_seq"),
        F.bool_or(is_graphql_request()).alias("is_graphql"),
        F.max(gap_rank(request_gap("request_body"))).alias("request_gap"),
        F.max(gap_rank(response_gap("response_body", "response_body_truncated", "mime_type"))).alias("response_gap"),
    ]


def endpoint_base(by_status: DataFrame) -> DataFrame:
    """Endpoints with counts, status codes, gap reasons and the capture positions of their first and last calls."""
    ok = F.col("status").between(200, 299)
    ok_body = F.bool_or(ok & F.col("response_seq").isNotNull())
    positions = ["first_seq", "request_seq", "response_seq", "request_file_seq", "response_file_seq", "cache_seq"]
    return by_status.groupBy(*KEY).agg(
        F.sum("count").alias("count"),
        F.array_sort(F.collect_set("status")).alias("status_codes"),
        *[F.min(name).alias(name) for name in positions],
        F.max("last_seq").alias("last_seq"),
        F.bool_or("is_graphql").alias("is_graphql"),
        ok_body.alias("success_sampled"),
        gap_name(F.max("request_gap")).alias("request_gap"),
        gap_name(F.when(ok_body, F.max(F.when(ok, F.col("response_gap")))).otherwise(F.max("response_gap"))).alias(
            "response_gap"
        ),
    )


def rollup_endpoints(keyed: DataFrame) -> DataFrame:
    """Endpoints with count, status codes and exact latency percentiles."""
    base = endpoint_base(status_rollup(keyed)).withColumn("id", endpoint_id())
    return base.join(latency_stats(keyed), KEY)


def latency_stats(keyed: DataFrame) -> DataFrame:
    stats = nearest_rank(keyed, KEY, "duration_ms")
    return stats.select(*KEY, F.struct("p50", "p95", "max").alias("timing"))


def call_stats(keyed: DataFrame) -> DataFrame:
    """Latency and UTF-8 body sizes per endpoint in one pass; a side without bodies is null."""
    measures = F.array(
        F.struct(F.lit("timing").alias("measure"), F.col("duration_ms").alias("value")),
        F.struct(F.lit("request").alias("measure"), F.octet_length("request_body").cast("bigint").alias("value")),
        F.struct(F.lit("response").alias("measure"), F.octet_length("response_body").cast("bigint").alias("value")),
    )
    each = keyed.select(*KEY, F.explode(measures).alias("m")).select(*KEY, "m.measure", "m.value")
    stats = nearest_rank(each, [*KEY, "measure"], "value")
    of = lambda name: F.first(F.when(F.col("measure") == name, F.struct("p50", "p95", "max")), ignorenulls=True)
    return stats.groupBy(*KEY).agg(
        of("timing").alias("timing"), of("request").alias("request_bytes"), of("response").alias("response_bytes")
    )


def endpoint_values(keyed: DataFrame) -> DataFrame:
    """Distinct origins, MIME types and triggering pages per endpoint, with their first position.

    These lists grow with the data, so they stay rows: (key, kind, value, first_seq, calls).
    Pages are normalised after they are counted as recorded; a failed call keeps its page.
    """
    as_is = F.lit(True)
    lists = F.array(
        F.struct(F.lit("origin").alias("kind"), F.col("origin").alias("value"), as_is.alias("as_is")),
        F.struct(F.lit("mime").alias("kind"), F.when(F.col("mime_type") != "", F.col("mime_type")).alias("value"), as_is.alias("as_is")),
        F.struct(F.lit("page").alias("kind"), F.col("triggered_by").alias("value"), (F.col("status") == 0).alias("as_is")),
    )
    recorded = (
        keyed.select(*KEY, "call_seq", F.explode(lists).alias("v"))
        .select(*KEY, "call_seq", "v.kind", "v.value", "v.as_is")
        .where(F.col("value").isNotNull())
        .groupBy(*KEY, "kind", "value", "as_is")
        .agg(F.min("call_seq").alias("first_seq"), F.count(F.lit(1)).alias("calls"))
    )
    return (
        recorded.withColumn("value", F.when(F.col("as_is"), F.col("value")).otherwise(normalize_url("value")))
        .groupBy(*KEY, "kind", "value")
        .agg(F.min("first_seq").alias("first_seq"), F.sum("calls").alias("calls"))
    )


def representatives(keyed: DataFrame, base: DataFrame, picks: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Columns of chosen calls per endpoint.

    ``picks`` maps a prefix to ``(position column of base, call columns)``. The positions are a
    few numbers per endpoint; settled, their size is known, and while it is small Spark
    broadcasts them, so the wide columns are read in one scan without a shuffle.
    """
    roles = F.array(
        *[F.struct(F.lit(name).alias("role"), F.col(seq).alias("call_seq")) for name, (seq, _) in picks.items()]
    )
    wanted = settle(
        base.select(*KEY, F.explode(roles).alias("r"))
        .where("r.call_seq is not null")
        .select("scan_id", F.col("r.call_seq").alias("call_seq"), "r.role")
        .groupBy("scan_id", "call_seq")
        .agg(F.collect_set("role").alias("_roles"))
    )
    columns = sorted({column for _, names in picks.values() for column in names} - set(KEY) - {"call_seq"})
    found = keyed.select(*KEY, "call_seq", *columns).join(wanted, ["scan_id", "call_seq"])
    return found.groupBy(*KEY).agg(
        *[
            F.first(F.when(F.array_contains("_roles", name), F.col(column)), ignorenulls=True).alias(f"{name}_{column}")
            for name, (_, names) in picks.items()
            for column in names
        ]
    )


_FIRST_CALL = {"first": ("first_seq", ["host", "path", "mime_type"])}


def _categorized(endpoints: DataFrame, seeds: DataFrame) -> DataFrame:
    """Category and heuristic from the columns :data:`_FIRST_CALL` picks."""
    seed_hosts = seeds.select("scan_id", url_host("seed_url").alias("seed_host"))
    verdict = categorize(
        F.col("first_host"),
        F.col("first_path"),
        F.col("method"),
        F.col("first_mime_type"),
        F.col("seed_host"),
        F.col("is_graphql"),
    )
    return (
        endpoints.join(seed_hosts, "scan_id", "left")
        .withColumn("_verdict", verdict)
        .withColumns({"category": F.col("_verdict.category"), "heuristic": F.col("_verdict.heuristic")})
        .drop("_verdict", "first_host", "first_path", "first_mime_type", "seed_host")
    )


def with_category(base: DataFrame, keyed: DataFrame, seeds: DataFrame) -> DataFrame:
    """Category and deciding heuristic, judged on the endpoint's first call."""
    return _categorized(base.join(representatives(keyed, base, _FIRST_CALL), KEY), seeds).withColumn("id", endpoint_id())


def endpoints(keyed: DataFrame, seeds: DataFrame) -> DataFrame:
    """The endpoint table: roll-up, category, and the headers, bodies and caching of its chosen calls."""
    base = settle(endpoint_base(status_rollup(keyed)))
    chosen = representatives(
        keyed,
        base,
        {
            **_FIRST_CALL,
            "last": ("last_seq", ["request_headers", "response_headers"]),
            "request": ("request_seq", ["request_body"]),
            "response": ("response_seq", ["response_body"]),
            "request_file": ("request_file_seq", ["request_body_file"]),
            "response_file": ("response_file_seq", ["response_body_file"]),
            "cache": ("cache_seq", ["response_headers"]),
        },
    )
    return (
        _categorized(base.join(chosen, KEY), seeds)
        .join(call_stats(keyed), KEY)
        .select(
            *KEY,
            endpoint_id().alias("id"),
            "category",
            "heuristic",
            "count",
            "status_codes",
            "is_graphql",
            "success_sampled",
            F.col("last_request_headers").alias("request_headers"),
            F.col("last_response_headers").alias("response_headers"),
            F.col("request_request_body").alias("request_body_sample"),
            F.col("response_response_body").alias("response_body_sample"),
            F.col("request_file_request_body_file").alias("request_body_file"),
            F.col("response_file_response_body_file").alias("response_body_file"),
            "request_gap",
            "response_gap",
            path_params("url_pattern").alias("path_params"),
            "timing",
            "request_bytes",
            "response_bytes",
            cache_info("cache_response_headers").alias("cache"),
        )
    )


def query_params(keyed: DataFrame, redact: bool = True) -> DataFrame:
    """Query parameter names per endpoint with up to five distinct values, in the order first seen.

    Values are counted per (endpoint, name, value) before they are listed, and only the five
    earliest per name are brought together.
    """
    entries = keyed.select(
        *KEY, "call_seq", F.posexplode(query_entries(F.regexp_extract("url", r"(?s)\?(.*)$", 1))).alias("at", "entry")
    )
    seen = (
        entries.groupBy(*KEY, F.col("entry.name").alias("name"), F.col("entry.value").alias("value"))
        # Call position and place in its query as one number: the map side can hash it.
        .agg(F.min(F.col("call_seq") * 4096 + F.col("at")).alias("first_at"))
    )
    filled = F.col("value") != ""
    earliest = Window.partitionBy(*KEY, "name").orderBy(F.col("value") == "", "first_at")
    few = seen.withColumn("_rank", F.row_number().over(earliest)).where("_rank <= 5")
    samples = F.transform(
        F.sort_array(F.collect_list(F.when(filled, F.struct("_rank", "value")))), lambda item: item["value"]
    )
    named = few.groupBy(*KEY, "name").agg(samples.alias("sample_values"), F.min("first_at").alias("first_at"))
    if not redact:
        return named
    masked = F.when(F.size("sample_values") > 0, F.array(F.lit(fv.REDACTED))).otherwise(F.col("sample_values"))
    return named.withColumn(
        "sample_values", F.when(is_sensitive_param("name"), masked).otherwise(F.col("sample_values"))
    )


def error_contracts(keyed: DataFrame) -> DataFrame:
    """Failed answers per endpoint and status: count, first body, strongest gap reason."""
    errors = keyed.where(F.col("status") >= 400)
    base = settle(
        errors.groupBy(*KEY, "status").agg(
            F.count(F.lit(1)).alias("count"),
            _first_where(F.col("response_body").isNotNull()).alias("response_seq"),
            F.max(gap_rank(response_gap("response_body", "response_body_truncated", "mime_type"))).alias("gap"),
        )
    )
    wanted = base.where("response_seq is not null").select("scan_id", F.col("response_seq").alias("call_seq"))
    bodies = (
        errors.join(wanted, ["scan_id", "call_seq"])
        .select(*KEY, "status", F.col("response_body").alias("body_sample"))
    )
    return base.join(bodies, [*KEY, "status"], "left").select(
        *KEY, "status", "count", "body_sample", gap_name(F.col("gap")).alias("schema_reason")
    )


def error_mimes(keyed: DataFrame) -> DataFrame:
    """Distinct MIME types of failed answers per endpoint and status."""
    return (
        keyed.where((F.col("status") >= 400) & (F.col("mime_type") != ""))
        .groupBy(*KEY, "status", "mime_type")
        .agg(F.min("call_seq").alias("first_seq"), F.count(F.lit(1)).alias("calls"))
    )


def vendor_attribution(categorized: DataFrame, values: DataFrame, payload_keys: DataFrame) -> DataFrame:
    """Vendor of analytics and third-party endpoints: the first origin that names one decides.

    ``payload_keys`` has one row per endpoint and key (see :func:`vendor_payload_keys`).
    """
    gated = categorized.where(F.col("category").isin("analytics", "third-party")).select(*KEY, "category")
    origin = F.regexp_replace("value", r"^[^:]*://", "")
    found = (
        values.where(F.col("kind") == "origin")
        .join(gated.select(*KEY), KEY, "left_semi")
        .withColumn("vendor", vendor_of(origin))
        .where(F.col("vendor").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("first_seq", F.col("vendor.name").alias("name"), F.col("vendor.category").alias("category"))).alias("v"))
    )
    keys = payload_keys.join(found.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(
        F.array_sort(F.collect_set("key")).alias("payload_keys")
    )
    return found.join(keys, KEY, "left").select(
        *KEY,
        F.col("v.name").alias("vendor"),
        F.col("v.category").alias("vendor_category"),
        F.coalesce("payload_keys", F.array().cast("array<string>")).alias("payload_keys"),
    )


def vendor_payload_keys(params: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Keys an endpoint receives: query parameter names and top-level request fields."""
    keys = params.select(*KEY, F.col("name").alias("key"))
    if shapes is not None:
        top = shapes.where((F.col("side") == "request") & (F.size("path") == 1) & (F.col("path")[0] != "[]"))
        keys = keys.unionByName(top.select(*KEY, F.col("path")[0].alias("key")))
    return keys.distinct()
