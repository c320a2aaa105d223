"""The registered queries: every operator over the whole sample tables.

Results are flat: lists are joined to text, so they compare with any engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight import schemas
from callsight.functions import text as tx
from callsight.functions import urls
from callsight.operators import caps, contract, diff, findings, graph, graphql, leaks, manifest, openapi, redaction, resume, scope
from callsight.operators import endpoints as ep
from callsight.operators import shape as sh
from callsight.operators import signals as sg
from callsight.operators import views as vw
from callsight.operators import web
from callsight.operators.endpoints import KEY
from callsight.operators.resources import group_resources, resource_of
from callsight.operators.sizing import settle
from callsight.plans import capture, report
from callsight.session import checkpoint_folder
from callsight.sinks import tables
from callsight.sources import capture as capture_source
from callsight.sources import samples
from callsight.sources.samples import AFTER, BEFORE, table
from callsight.streaming import live, prefix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return report.keyed(samples.calls(spark, sf))


_REPORTS: dict[tuple[str, str], report.Report] = {}


def _report(spark: SparkSession, sf: str) -> report.Report:
    """The report of the sample capture; its settled tables serve all views of one application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _REPORTS:
        _REPORTS[key] = report.Report(samples.calls(spark, sf), samples.seeds(spark), rules=None)
    return _REPORTS[key]


def forget() -> None:
    """Drop the settled tables, so the next query computes its own (used by the benchmark)."""
    _REPORTS.clear()


def _joined(values: Column | str, sep: str = "|") -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(values, lambda v: v.cast("string")), sep)


def _big(column: str) -> Column:
    return F.col(column).cast("bigint")


# --- URLs ----------------------------------------------------------------------


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.url_parts("url").alias("u")).select("page_id", "u.scheme", "u.host", "u.path", "u.query")


@query
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalize_url("url").alias("normalized"))


@query
def url_pattern(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", urls.url_pattern("url").alias("pattern"))
    return pages.select(
        "page_id",
        "pattern",
        _joined(urls.path_params("pattern")).alias("params"),
        urls.collection_root("pattern").alias("root"),
        urls.has_param("pattern").alias("has_param"),
        urls.is_item("pattern").alias("is_item"),
        urls.operation_id(F.lit("GET"), "pattern").alias("operation_id"),
    )


@query
def same_domain(spark: SparkSession, sf: str) -> DataFrame:
    seed = F.lit("https://ththre.example.com/")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.same_domain("url", seed).alias("same_domain"),
        urls.is_private_host("url").alias("private_host"),
        urls.url_origin("url").alias("origin"),
        urls.page_label("url", seed).alias("label"),
    )


@query
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    links = web.extract_links(samples.captured_pages(spark, sf))
    return links.select(F.col("url").alias("page_url"), _big("pos").alias("pos"), "href", "link")


# --- filters and limits --------------------------------------------------------


def _scope(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [
            (BEFORE, samples.SEED_URL, ["CDN.other.example.net"], ["/api/users", "/api/*/items/*"], False),
            (AFTER, samples.SEED_URL, [], ["/api/orders"], False),
        ],
        "scan_id string, seed_url string, include_hosts array<string>, exclude_paths array<string>, include_third_party boolean",
    )


@query
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return scope.allowed_hosts(samples.calls(spark, sf).select("scan_id", "call_seq", "url"), _scope(spark)).select("scan_id", "call_seq")


@query
def capture_scope(spark: SparkSession, sf: str) -> DataFrame:
    wide = _scope(spark).withColumn("include_third_party", F.col("scan_id") == AFTER)
    rows = samples.calls(spark, sf).select("scan_id", "call_seq", "url")
    return scope.capture_scope(rows, wide).groupBy("scan_id").agg(F.count(F.lit(1)).alias("calls"))


@query
def path_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return scope.exclude_paths(samples.calls(spark, sf).select("scan_id", "call_seq", "url"), _scope(spark)).select("scan_id", "call_seq")


@query
def redirect_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Every call as a landing: the page that triggered it asked, the called URL was reached."""
    landings = samples.calls(spark, sf).select("scan_id", F.col("triggered_by").alias("url"), F.col("url").alias("landed_url"))
    kept, refused = scope.redirect_guard(landings.distinct(), _scope(spark))
    return (
        kept.withColumn("reason", F.lit("kept"))
        .unionByName(refused)
        .groupBy("scan_id", "reason")
        .agg(F.count(F.lit(1)).alias("landings"))
    )


@query
def target_guard(spark: SparkSession, sf: str) -> DataFrame:
    targets = table(spark, sf, "pages").select("page_id", F.col("url").alias("seed_url"))
    return scope.target_check(targets).select("page_id", F.coalesce("refused", F.lit("accepted")).alias("verdict"))


@query
def cap_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.calls(spark, sf).select("scan_id", "call_seq")
    return caps.cap_calls(rows, limit=2_000)


@query
def dropped_calls(spark: SparkSession, sf: str) -> DataFrame:
    return caps.dropped(samples.calls(spark, sf).select("scan_id"), 2_000, ["scan_id"])


@query
def cap_frames(spark: SparkSession, sf: str) -> DataFrame:
    return caps.cap_frames(samples.frames(spark, sf), limit=5).select("conn_seq", "frame_seq", "direction", "payload")


@query
def conn_counters(spark: SparkSession, sf: str) -> DataFrame:
    return caps.frame_counters(samples.frames(spark, sf), limit=5).drop("scan_id")


@query
def body_budget(spark: SparkSession, sf: str) -> DataFrame:
    payloads = caps.call_payloads(samples.calls(spark, sf))
    kept = caps.body_budget(payloads, ["scan_id"], ["call_seq", "part"], "body", max_chars=60, total_chars=150_000)
    return kept.select("scan_id", "call_seq", "kind", "truncated", F.coalesce("body", F.lit("(dropped)")).alias("body"))


def _cut(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A capture that stopped after two fifths of its places, and what followed."""
    stop = F.floor(calls.agg(F.max("call_seq")).scalar() * 2 / 5)
    return calls.where(F.col("call_seq") < stop), calls.where(F.col("call_seq") >= stop)


def _stopped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The calls before a cut, those after it, and the stored state of the scans at the cut."""
    before, after = _cut(samples.calls(spark, sf))
    path = f"{checkpoint_folder(spark)}/state-{uuid.uuid4().hex}"
    resume.write_state(resume.scan_state(before, samples.seeds(spark), max_chars=60), path)
    return before, after, resume.read_state(spark, path, samples.seeds(spark))


@query
def resumed_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The calls kept of a scan that was cut and resumed."""
    before, after, state = _stopped(spark, sf)
    stored = {"calls": caps.cap_calls(before, 2_000)}
    return resume.restore(stored, {"calls": after}, state, max_calls=2_000)["calls"].select("scan_id", "call_seq")


@query
def resumed_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies kept of a scan that was cut and resumed."""
    before, after, state = _stopped(spark, sf)
    first = caps.body_budget(caps.call_payloads(before), ["scan_id"], ["call_seq", "part"], "body", 60, 150_000)
    kept = first.unionByName(resume.resumed_bodies(caps.call_payloads(after), state, 60, 150_000))
    return kept.select("scan_id", "call_seq", "kind", "truncated", F.coalesce("body", F.lit("(dropped)")).alias("body"))


@query
def resumed_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of the scans after their later part, from the stored state and that part alone."""
    _, after, state = _stopped(spark, sf)
    return resume.scan_state(after, samples.seeds(spark), earlier=state, max_chars=60).drop("version")


@query
def spill_budget(spark: SparkSession, sf: str) -> DataFrame:
    payloads = caps.call_payloads(samples.calls(spark, sf))
    masked = redaction.redact_body("body")["body"]
    spilled = caps.spilled_payloads(payloads, masked, max_chars=60, total_chars=150_000)
    return spilled.select("scan_id", "call_seq", "payload_key", F.sha2("body", 256).alias("digest"))


@query
def recent_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        urls.url_host("url").alias("host"), "page_id", urls.page_label("url", F.lit(samples.SEED_URL)).alias("label")
    )
    return caps.recent_rows(pages, ["host"], "page_id", 3).withColumn("position", _big("position"))


@query
def pacing_audit(spark: SparkSession, sf: str) -> DataFrame:
    starts = samples.calls(spark, sf).select(urls.url_origin("url").alias("origin"), "started_at", "call_seq")
    return caps.request_pacing(starts, 120_000)


@query
def dedupe_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every triggering page as a visit; the first per normalised URL stays."""
    visits = samples.calls(spark, sf).select(
        "scan_id", F.col("call_seq").alias("page_seq"), "triggered_by", urls.normalize_url("triggered_by").alias("normalized_url")
    )
    return caps.dedupe_pages(visits).select("scan_id", "page_seq", "normalized_url")


# --- endpoints -----------------------------------------------------------------


@query
def endpoint_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = ep.rollup_endpoints(_keyed(spark, sf))
    return rolled.select(
        "scan_id",
        "method",
        "url_pattern",
        F.col("count").alias("calls"),
        _joined("status_codes").alias("statuses"),
        F.col("timing.p50").alias("p50_ms"),
        F.col("timing.p95").alias("p95_ms"),
        F.col("timing.max").alias("max_ms"),
    )


@query
def size_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(_keyed(spark, sf))


def _sizes(rows: DataFrame) -> DataFrame:
    stats = ep.call_stats(rows)
    return stats.select(
        *KEY,
        *[
            F.col(f"{side}_bytes.{stat}").alias(f"{side}_{stat}")
            for side in ("request", "response")
            for stat in ("p50", "p95", "max")
        ],
    )


@query
def endpoint_values(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).values


@query
def categorize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keyed(spark, sf)
    base = settle(ep.endpoint_base(ep.status_rollup(rows)))
    return ep.with_category(base, rows, samples.seeds(spark)).select(*KEY, "category", "heuristic")


@query
def gap_reasons(spark: SparkSession, sf: str) -> DataFrame:
    base = ep.endpoint_base(ep.status_rollup(_keyed(spark, sf)))
    return base.select(*KEY, F.coalesce("request_gap", F.lit("")).alias("request_gap"), F.coalesce("response_gap", F.lit("")).alias("response_gap"))


@query
def endpoint_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).endpoints.select(
        *KEY,
        "request_body_sample",
        "response_body_sample",
        tx.has_header("request_headers", "cookie").alias("sent_cookie"),
        F.coalesce(tx.header_value("response_headers", "x-cache"), F.lit("")).alias("x_cache"),
    )


@query
def cache_info(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).endpoints.select(*KEY, F.col("cache").alias("c")).where("c is not null").select(
        *KEY,
        F.coalesce("c.control", F.lit("")).alias("control"),
        F.col("c.age").cast("bigint").alias("age"),
        F.coalesce("c.status", F.lit("")).alias("status"),
    )


@query
def query_params(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).params.select(*KEY, "name", _joined("sample_values").alias("samples"))


@query
def query_param_types(spark: SparkSession, sf: str) -> DataFrame:
    raw = ep.query_params(_keyed(spark, sf), redact=False)
    return raw.select(*KEY, "name", tx.infer_scalar_type(F.col("sample_values")).alias("type"), tx.is_sensitive_param("name").alias("sensitive"))


@query
def error_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).errors.select(
        *KEY,
        _big("status").alias("status"),
        F.col("count").alias("calls"),
        "body_sample",
        F.coalesce("schema_reason", F.lit("")).alias("schema_reason"),
    )


@query
def error_mimes(spark: SparkSession, sf: str) -> DataFrame:
    return ep.error_mimes(_keyed(spark, sf)).withColumn("status", _big("status"))


@query
def vendor_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).vendors.select(*KEY, "vendor", "vendor_category", _joined("payload_keys").alias("payload_keys"))


@query
def failed_calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keyed(spark, sf).where(F.col("status") == 0)
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("failed"), F.min("call_seq").alias("first_seq"))


# --- shapes --------------------------------------------------------------------


def _flat_shape(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(
        *keys,
        sh.path_text().alias("path"),
        _joined("types").alias("types"),
        F.coalesce("format", F.lit("")).alias("format"),
        "required",
        F.coalesce(_joined("enum"), F.lit("")).alias("enum"),
        _big("minimum").alias("minimum"),
        _big("maximum").alias("maximum"),
    )


@query
def schema_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_shape(_report(spark, sf).shapes, [*KEY, "side"])


@query
def socket_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_shape(sh.frame_schema_paths(samples.frames(spark, sf)), ["conn_seq", "direction"])


@query
def socket_gaps(spark: SparkSession, sf: str) -> DataFrame:
    frames = samples.frames(spark, sf)
    kept = caps.cap_frames(frames, limit=7)
    gaps = sh.frame_gaps(kept, caps.frame_counters(frames, limit=7), sh.frame_schema_paths(kept))
    return gaps.select("conn_seq", "direction", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def string_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Format of every page URL, document language and order date."""
    texts = (
        table(spark, sf, "pages").select(F.lit("url").alias("source"), F.col("url").alias("value"))
        .unionByName(table(spark, sf, "documents", spread=True).select(F.lit("lang").alias("source"), F.col("lang").alias("value")))
        .unionByName(
            table(spark, sf, "orders").select(
                F.lit("date").alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")
            )
        )
        .unionByName(
            table(spark, sf, "events").select(
                F.lit("stamp").alias("source"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("value")
            )
        )
        .unionByName(
            table(spark, sf, "events").select(
                F.lit("money").alias("source"), F.concat(F.lit("€"), F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("value")
            )
        )
    )
    fmt = F.coalesce(tx.string_format("value"), F.lit("none"))
    member = tx.is_enum_member("value")
    return texts.groupBy("source", fmt.alias("format"), member.alias("enum_member")).agg(F.count(F.lit(1)).alias("n"))


# --- redaction -----------------------------------------------------------------


@query
def sensitive_values(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, page URLs and customer phone numbers judged by value."""
    texts = (
        table(spark, sf, "documents", spread=True).select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("value"))
        .unionByName(table(spark, sf, "pages").select(F.lit("url").alias("source"), F.col("page_id").alias("id"), F.col("url").alias("value")))
        .unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("value")))
    )
    return texts.select(
        "source", "id", tx.is_sensitive_scalar("value").alias("scalar"), tx.is_sensitive_value("value").alias("sensitive")
    )


@query
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of every page URL weighed; in millionths of a bit, to compare across engines."""
    bits = tx.entropy_per_char(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.floor(bits * 1_000_000 + 0.5).cast("bigint").alias("micro_bits"))


@query
def redact_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    masked = tx.redact_log_line("text")
    return table(spark, sf, "documents", spread=True).select(
        "doc_id", F.sha2(masked, 256).alias("digest"), F.length(masked).cast("bigint").alias("chars")
    )


@query
def redact_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.calls(spark, sf).select(
        "scan_id", "call_seq", F.explode(redaction.redact_headers("request_headers")).alias("name", "value")
    )
    return rows


@query
def redact_bodies(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples.calls(spark, sf).where("request_body is not null")
    return rows.select("scan_id", "call_seq", redaction.redact_body("request_body")["body"].alias("body"))


@query
def secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    # Of a plain explode Spark infers a filter on the masking, and applies it before the rows are spread, in the few tasks of the scan.
    masked = redaction.redact_calls(samples.calls(spark, sf)).select(F.explode_outer("secrets").alias("value"))
    return redaction.secret_ledger(masked)


def _leaves(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents", spread=True).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("leaf")
    )
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("leaf"))
    return documents.unionByName(pages)


def _document_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses and assigned tokens found anywhere in the documents."""
    found = F.concat(
        F.regexp_extract_all("text", F.lit(f"({fv.EMAIL_TEXT})"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r'token = "([^"\s]+)"'), F.lit(1)),
    )
    return redaction.secret_ledger(table(spark, sf, "documents", spread=True).select(F.explode(found).alias("value")))


@query
def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaking_leaves(_leaves(spark, sf), ["source", "id"], "leaf", _document_secrets(spark, sf))


@query
def leak_summary(spark: SparkSession, sf: str) -> DataFrame:
    hits = leak_scan(spark, sf).withColumn("path", F.concat_ws(".", "source", F.col("id").cast("string")))
    return leaks.leak_summary(hits, ["source"], "path").select("source", "total", _joined("paths").alias("paths"))


# --- findings, resources, graph ------------------------------------------------


def _finding(rows: DataFrame) -> DataFrame:
    return rows.select("scan_id", "kind", "severity", F.coalesce("endpoint", F.lit("")).alias("endpoint"), "detail")


@query
def finding_unauthenticated(spark: SparkSession, sf: str) -> DataFrame:
    return _finding(findings.unauthenticated(_report(spark, sf).endpoints))


@query
def finding_pii(spark: SparkSession, sf: str) -> DataFrame:
    return _finding(findings.pii_fields(_report(spark, sf).shapes))


@query
def finding_verbose_error(spark: SparkSession, sf: str) -> DataFrame:
    return _finding(findings.verbose_errors(_report(spark, sf).errors))


@query
def finding_security_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _finding(findings.missing_security_headers(_report(spark, sf).endpoints))


@query
def finding_inconsistent_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _finding(findings.inconsistent_shapes(_report(spark, sf).shapes))


@query
def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = findings.finding_summary(_report(spark, sf).findings)
    return summary.select("scan_id", "kind", "severity", "endpoints", "details", _big("severity_rank").alias("severity_rank"))


@query
def resources(spark: SparkSession, sf: str) -> DataFrame:
    grouped = group_resources(_report(spark, sf).endpoints)
    return grouped.select(
        "scan_id", "resource", _joined("categories").alias("categories"), "path", _joined("methods").alias("methods"), _joined("missing_methods").alias("missing")
    )


@query
def resource_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    return resource_of(found.endpoints, found.resources).select(*KEY, "resource")


def _graph(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    found = _report(spark, sf)
    return graph.request_graph(found.endpoints, found.values, found.seeds)


@query
def request_graph_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)["pages"].select("scan_id", "node", "label", "requests")


@query
def request_graph_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)["requests"].select("scan_id", "node", "label", "calls")


@query
def request_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)["edges"].select("scan_id", "page_node", "request_node", "calls")


@query
def request_graph_omitted(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)["omitted"]


@query
def request_graph_mermaid(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mermaid_lines(_graph(spark, sf)).select("scan_id", "line")


# --- comparison ----------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str, *names: str) -> tuple[diff.Snapshot, diff.Snapshot]:
    """Both scans, with the named tables only where a rule needs no others."""
    wanted = names or ("params", "shapes", "errors", "vendors", "operations", "introspection")
    tables = _report(spark, sf).tables("endpoints", *wanted)
    return diff.snapshot(tables, BEFORE), diff.snapshot(tables, AFTER)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    if not hasattr(found, "sample_changes"):
        found.sample_changes = settle(diff.changes(*_snapshots(spark, sf)))
    return found.sample_changes


def _details(rows: DataFrame) -> DataFrame:
    return rows.select("id", "text", "breaking")


@query
def diff_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints only one scan has."""
    side = lambda scan: _report(spark, sf).endpoints.where(F.col("scan_id") == scan).select("id", "status_codes")
    return diff.presence(
        side(BEFORE),
        side(AFTER),
        F.concat(F.lit("new endpoint (observed "), tx.describe_statuses("a_status_codes"), F.lit(")")),
        F.concat(F.lit("not observed in this scan (was "), tx.describe_statuses("b_status_codes"), F.lit(")")),
    )


@query
def diff_statuses(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _snapshots(spark, sf, "params")
    rows = diff.diff_statuses(before.endpoints, after.endpoints).unionByName(diff.diff_category(before.endpoints, after.endpoints))
    return _details(rows)


@query
def diff_params(spark: SparkSession, sf: str) -> DataFrame:
    """The sample calls all endpoints alike, so each scan is made to lack one parameter of some endpoints."""
    before, after = _snapshots(spark, sf, "params")
    before = replace(before, params=before.params.where("name <> 'token' or id like '%/orders%'"))
    after = replace(after, params=after.params.where("name <> 'page' or id not like '%/users%'"))
    return _details(diff.diff_params(before, after))


@query
def diff_vendors(spark: SparkSession, sf: str) -> DataFrame:
    return _details(diff.diff_vendors(*_snapshots(spark, sf, "vendors")))


@query
def diff_growth(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _snapshots(spark, sf, "params")
    return _details(diff.diff_growth(before.endpoints, after.endpoints))


@query
def diff_schema(spark: SparkSession, sf: str) -> DataFrame:
    return _details(diff.diff_schema(*_snapshots(spark, sf, "shapes", "errors")))


@query
def diff_schema_gaps(spark: SparkSession, sf: str) -> DataFrame:
    sides = diff.comparable_sides(*_snapshots(spark, sf, "shapes", "errors"))
    return _details(diff.diff_shape_presence(sides))


@query
def diff_graphql(spark: SparkSession, sf: str) -> DataFrame:
    return _details(diff.diff_graphql(*_snapshots(spark, sf, "operations", "introspection")))


@query
def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_counts(_changes(spark, sf))


@query
def change_summary(spark: SparkSession, sf: str) -> DataFrame:
    return diff.change_summary(_changes(spark, sf)).select("id", "line", F.size("details").cast("bigint").alias("details"), "more")


@query
def change_gate(spark: SparkSession, sf: str) -> DataFrame:
    return diff.gate(_changes(spark, sf))


# --- views ---------------------------------------------------------------------


@query
def slowest_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    top = vw.slowest_endpoints(_report(spark, sf).endpoints)
    return top.select("scan_id", _big("rank").alias("rank"), "id", F.col("timing.p95").alias("p95_ms"))


@query
def largest_responses(spark: SparkSession, sf: str) -> DataFrame:
    top = vw.largest_responses(_report(spark, sf).endpoints)
    return top.select("scan_id", _big("rank").alias("rank"), "id", F.col("response_bytes.p95").alias("p95_bytes"), tx.format_bytes(F.col("response_bytes.p95")).alias("shown"))


@query
def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return vw.category_summary(_report(spark, sf).endpoints).withColumn("position", _big("position"))


@query
def auth_flows(spark: SparkSession, sf: str) -> DataFrame:
    flows = vw.auth_flows(_report(spark, sf).endpoints)
    return flows.select("scan_id", "id", tx.describe_statuses("status_codes").alias("statuses"), F.col("count").alias("calls"))


@query
def third_party_calls(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    calls = vw.third_party_calls(found.endpoints, found.vendors)
    return calls.select("scan_id", "id", F.coalesce("vendor", F.lit("—")).alias("vendor"), F.col("count").alias("calls"))


@query
def endpoint_search(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoints a reader finds with "segment" (in an origin) or "post /api" (in the id)."""
    found = _report(spark, sf)
    hits = lambda text: vw.endpoint_filter(found.endpoints, text, values=found.values, params=found.params).select(F.lit(text).alias("query"), "scan_id", "id")
    return hits("segment").unionByName(hits("post /api"))


@query
def endpoint_filters(spark: SparkSession, sf: str) -> DataFrame:
    endpoints = _report(spark, sf).endpoints
    by_status = vw.endpoint_filter(endpoints, status=500).select(F.lit("status 500").alias("filter"), "scan_id", "id")
    by_kind = vw.endpoint_filter(endpoints, category="mutations", method="POST").select(F.lit("post mutations").alias("filter"), "scan_id", "id")
    return by_status.unionByName(by_kind)


@query
def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    endpoints = _report(spark, sf).endpoints
    by_category = vw.group_counts(endpoints, "category").withColumn("by", F.lit("category"))
    by_resource = vw.group_counts(resource_of(endpoints, group_resources(endpoints)), "resource").withColumn("by", F.lit("resource"))
    return by_category.unionByName(by_resource).select("by", "scan_id", "group", "rows", F.col("first.id").alias("first_id"))


@query
def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The current scan's rows and the removed ones, each with what happened to it."""
    changes = _changes(spark, sf)
    _, after = _snapshots(spark, sf, "params")
    current = after.endpoints.select(F.lit(AFTER).alias("scan_id"), "id", "category")
    rows = vw.annotate_changes(vw.all_rows(current, vw.removed_rows(changes, AFTER)), changes)
    return rows.select("id", "category", "change", "change_breaking")


@query
def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    pages = found.values.where(F.col("kind") == "page").select("scan_id", "value").distinct()
    technologies = web.detect_technologies(_evidence(spark, sf))
    card = vw.scorecard(found.seeds, found.endpoints, found.resources, technologies, found.findings, pages)
    return card.select("scan_id", "endpoints", "resources", "technologies", "findings", "high", "medium", "low", "pages")


@query
def signals(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    return sg.signals(found.endpoints, found.values)


@query
def signal_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a payload somebody sent: which of its fields are not allowed."""
    payload = F.concat(
        F.lit('{"version":1,"endpointCount":1,"signals":[{"category":"'),
        "event_type",
        F.lit('","host":'),
        F.col("user_id").cast("string"),
        F.lit(',"method":"GET"}],"props":'),
        "props",
        F.lit("}"),
    )
    rows = table(spark, sf, "events").select("event_id", payload.alias("payload"))
    return sg.payload_violations(rows)


@query
def share_view(spark: SparkSession, sf: str) -> DataFrame:
    endpoints = _report(spark, sf).endpoints
    shared = vw.share_safe({"endpoints": endpoints})["endpoints"]
    return shared.select(
        "scan_id", "method", "url_pattern", "category", tx.describe_statuses("status_codes").alias("statuses"), F.col("count").alias("calls"), _joined("path_params").alias("path_params")
    )


@query
def rendered_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents", spread=True).select(
        "doc_id",
        tx.format_bytes(F.col("n_chars") * 97).alias("bytes"),
        tx.format_duration(F.col("n_chars") * 13).alias("duration"),
        tx.truncate_text("text", 40).alias("short"),
    )


@query
def has_contract(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    kept = vw.has_contract(found.endpoints, found.params, found.shapes, found.errors)
    return kept.select("scan_id", "id")


# --- stored pages --------------------------------------------------------------


def _robots(spark: SparkSession, sf: str) -> DataFrame:
    """The same rules for the origin of every page."""
    raw = "# rules\nUser-agent: *\nDisallow: /en/\nAllow: /en/1\nCrawl-delay: 2\nDisallow: /th\n\nUser-agent: probe\nDisallow: /de/\nSitemap: /map.xml"
    return table(spark, sf, "pages").select(urls.url_origin("url").alias("origin")).distinct().withColumn("raw", F.lit(raw))


@query
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = web.robots_rules(_robots(spark, sf))
    return rules.select(
        "origin", _big("group_id").alias("group_id"), _joined("agents").alias("agents"), _joined(F.transform("rules", lambda r: F.concat(F.when(r["allow"], F.lit("+")).otherwise(F.lit("-")), r["prefix"]))).alias("rules")
    )


@query
def robots_settings(spark: SparkSession, sf: str) -> DataFrame:
    settings = web.robots_settings(_robots(spark, sf))
    return settings.select("origin", _big("crawl_delay_seconds").alias("crawl_delay_seconds"), _joined("sitemaps").alias("sitemaps"))


@query
def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    links = web.extract_links(samples.captured_pages(spark, sf)).select(F.col("link").alias("url"))
    rows = links.unionByName(table(spark, sf, "pages").select("url")).distinct()
    plain = web.robots_filter(rows, _robots(spark, sf)).select("url", F.lit("*").alias("agent"), "allowed")
    probe = web.robots_filter(rows, _robots(spark, sf), "Probe/1.0").select("url", F.lit("probe").alias("agent"), "allowed")
    return plain.unionByName(probe)


def _page_seeds(pages: DataFrame) -> DataFrame:
    """Every page starts a scan of its own."""
    return pages.select(F.col("page_id").cast("string").alias("scan_id"), F.col("url").alias("seed_url"))


@query
def reachable_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = samples.captured_pages(spark, sf)
    seeds = _page_seeds(pages)
    own_site = seeds.select(
        "scan_id", "seed_url", F.array().cast("array<string>").alias("include_hosts"), F.array(F.lit("/En")).alias("exclude_paths"), F.lit(False).alias("include_third_party")
    )
    visited, _ = web.reachable_pages(seeds, web.link_table(pages), max_depth=2, max_pages=None, scope=own_site)
    return visited.select("scan_id", "url", _big("depth").alias("depth"))


@query
def crawl_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The first four pages a crawl of every seed would visit, minding robots.txt."""
    pages = samples.captured_pages(spark, sf)
    visited, _ = web.reachable_pages(_page_seeds(pages), web.link_table(pages), max_depth=1, max_pages=4, robots=_robots(spark, sf))
    return visited.select("scan_id", "url", _big("depth").alias("depth"))


@query
def crawl_blocked(spark: SparkSession, sf: str) -> DataFrame:
    pages = samples.captured_pages(spark, sf)
    _, blocked = web.reachable_pages(_page_seeds(pages), web.link_table(pages), max_depth=1, max_pages=4, robots=_robots(spark, sf))
    return blocked


@query
def unvisited_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets no stored page covers."""
    pages = samples.captured_pages(spark, sf)
    links = web.link_table(pages).select(F.lit("all").alias("scan_id"), F.col("target").alias("url")).distinct()
    visited = pages.select(F.lit("all").alias("scan_id"), urls.normalize_url("url").alias("url"))
    return web.unvisited(links, visited).select("url")


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pages as evidence; headers and cookies follow from the page number."""
    pages = table(spark, sf, "pages")
    n = F.col("page_id")
    return pages.select(
        F.when(n % 2 == 0, F.lit(BEFORE)).otherwise(F.lit(AFTER)).alias("scan_id"),
        n.alias("page_seq"),
        "url",
        F.create_map(
            F.lit("server"),
            F.when(n % 3 == 0, F.lit("nginx/1.2")).otherwise(F.lit("Apache")),
            F.lit("x-powered-by"),
            F.when(n % 5 == 0, F.lit("Express")).otherwise(F.lit("")),
        ).alias("headers"),
        "html",
        F.when(n % 7 == 0, F.array(F.lit("connect.sid"))).otherwise(F.array(F.lit("lang"))).alias("cookies"),
        F.when(n % 11 == 0, F.array(F.lit("https://cdn.segment.com/a.js"))).otherwise(F.array().cast("array<string>")).alias("scripts"),
    )


@query
def technologies(spark: SparkSession, sf: str) -> DataFrame:
    return web.detect_technologies(_evidence(spark, sf))


@query
def row_digests(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "documents", spread=True).select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return manifest.file_digests(texts)


@query
def verify_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest over all documents, checked against an edited copy that lost some of them."""
    texts = table(spark, sf, "documents", spread=True).select("doc_id", "lang", F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    edited = F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    current = texts.where(F.col("lang") != "fr").withColumn("content", edited)
    return manifest.verify_manifest(manifest.file_digests(texts), manifest.file_digests(current))


# --- GraphQL -------------------------------------------------------------------


@query
def graphql_operations(spark: SparkSession, sf: str) -> DataFrame:
    ops = _report(spark, sf).operations
    return ops.select(*KEY, "type", F.coalesce("name", F.lit("")).alias("name"), _joined("selections").alias("selections"), _joined("arguments").alias("arguments"))


@query
def graphql_introspection(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).introspection


# --- streams -------------------------------------------------------------------


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A sample table as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _drained(rows: DataFrame, mode: str = "append") -> str:
    """Run a stream over all there is and return the folder of its batches."""
    folder = f"{checkpoint_folder(rows.sparkSession)}/stream-{uuid.uuid4().hex}"
    live.start_batches(rows, f"{folder}/out", f"{folder}/state", mode).awaitTermination()
    return f"{folder}/out"


@query
def stream_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    calls = samples.calls_of(_stream(spark, sf, "events"), table(spark, sf, "pages"))
    path = _drained(live.live_endpoints(report.keyed(calls)), "update")
    return live.read_live_endpoints(spark, path)


@query
def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Live percentiles per endpoint, from batches that were put together on the way."""
    events, pages = table(spark, sf, "events"), table(spark, sf, "pages")
    folder = f"{checkpoint_folder(spark)}/latency-{uuid.uuid4().hex}"
    for rest in range(3):
        events.where(F.col("event_id") % 3 == rest).write.mode("append").parquet(f"{folder}/in")
        calls = samples.calls_of(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), pages)
        rows = live.live_latency(report.keyed(calls))
        live.start_batches(rows, f"{folder}/out", f"{folder}/state", "update").awaitTermination()
        live.compact_batches(spark, f"{folder}/out", live.latest_latency, keep=1)
    found = live.latency_percentiles(live.latest_latency(live.read_batches(spark, f"{folder}/out")))
    return found.select(*KEY, "p50", "p95", "max")


@query
def stream_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The live endpoint list of a stream that stopped after the first part of a capture and was started again."""
    folder = f"{checkpoint_folder(spark)}/resumed-{uuid.uuid4().hex}"
    events, pages = table(spark, sf, "events"), table(spark, sf, "pages")
    for part in (events.where("event_id % 7 < 3"), events.where("event_id % 7 >= 3")):
        part.write.mode("append").parquet(f"{folder}/in")
        calls = samples.calls_of(spark.readStream.schema(events.schema).parquet(f"{folder}/in"), pages)
        rows = live.live_endpoints(report.keyed(calls))
        live.start_batches(rows, f"{folder}/out", f"{folder}/state", "update").awaitTermination()
    return live.read_live_endpoints(spark, f"{folder}/out")


@query
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The progress lines after the last micro-batch, from the live endpoint list."""
    calls = samples.calls_of(_stream(spark, sf, "events"), table(spark, sf, "pages"))
    found = live.read_live_endpoints(spark, _drained(live.live_endpoints(report.keyed(calls)), "update"))
    totals = found.groupBy("scan_id").agg(F.sum("count").alias("calls"), F.count(F.lit(1)).alias("endpoints"))
    return live.progress_lines(totals, "done")


def _arriving(rows: DataFrame, at: str) -> DataFrame:
    """Rows as a stream that brings them in no order, in several batches, and then a row much later than all."""
    spark, folder = rows.sparkSession, f"{checkpoint_folder(rows.sparkSession)}/arrivals-{uuid.uuid4().hex}"
    spark.conf.set(prefix.STORE, prefix.ROCKSDB)
    rows.repartition(8, F.xxhash64(*rows.columns)).write.parquet(folder)
    late = [F.lit(100 * prefix.YEAR_MS).cast("long").alias(c) if c == at else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]
    spark.range(1).select(*late).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)


@query
def stream_capped_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The frames that the limit of a connection keeps, from a stream that brings them in no order."""
    kept = prefix.first_frames(_arriving(samples.frames(spark, sf), "at"), limit=5)
    return spark.read.parquet(_drained(kept)).select("conn_seq", "frame_seq", "direction", "payload")


@query
def stream_body_budget(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies that the budget of a scan keeps, from a stream that brings them in no order."""
    calls = samples.calls(spark, sf)
    payloads = caps.call_payloads(calls).withColumn("at", F.col("call_seq"))
    kept = prefix.budgeted_bodies(_arriving(payloads, "at"), "at", max_chars=60, total_chars=150_000)
    return spark.read.parquet(_drained(kept)).select("scan_id", "call_seq", "kind", "truncated", "body")


def _pairs(spark: SparkSession, sf: str, wait_ms: int) -> str:
    """Every event asked at its time and answered after its duration; events with an odd property never are."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("asked"),
        F.round(F.col("value") * 100).cast("bigint").alias("wait_ms"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2).alias("odd"),
    )
    stream = _arriving(events.withColumn("at", F.unix_millis("asked")), "at")
    asked = F.timestamp_millis("at")
    requests = stream.select("request_id", asked.alias("requested_at"))
    # The last row of the stream is no event: it comes much later than all, on both sides.
    answered = F.timestamp_millis(F.col("at") + F.coalesce("wait_ms", F.lit(0)))
    responses = stream.where("odd = 0 or request_id is null").select("request_id", answered.alias("answered_at"))
    folder = f"{checkpoint_folder(spark)}/pairs-{uuid.uuid4().hex}"
    pairs = live.paired_calls(requests, responses, wait_ms, delay_ms=prefix.YEAR_MS)
    live.start_pairs(pairs, folder, f"{folder}/state").awaitTermination()
    return folder


@query
def stream_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{_pairs(spark, sf, 3_600_000)}/pairs")
    duration = F.expr("div(unix_micros(answered_at) - unix_micros(requested_at), 1000)")
    return rows.select("request_id", duration.cast("bigint").alias("duration_ms"))


@query
def stream_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    """Requests without an answer, and answers that came too late, where a request waits for five seconds."""
    rows = spark.read.parquet(f"{_pairs(spark, sf, 5_000)}/unpaired")
    return rows.where("request_id is not null").select("request_id", "outcome")


# --- stored and masked captures ------------------------------------------------


def _masked(spark: SparkSession, sf: str) -> report.Report:
    """A report whose calls are masked before any table sees them."""
    key = (f"{spark.sparkContext.applicationId} masked", sf)
    if key not in _REPORTS:
        rules = capture.Rules(max_calls=1_000_000_000, total_chars=1 << 50)
        _REPORTS[key] = report.Report(samples.calls(spark, sf), samples.seeds(spark), rules=rules)
    return _REPORTS[key]


@query
def captured_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Scope, gate, budget, masking and the limit of calls, in their order."""
    rules = capture.Rules(scope=_scope(spark), max_calls=1_500, max_chars=60, total_chars=60_000)
    stored = capture.captured(samples.calls(spark, sf), rules)
    return stored.select(
        "scan_id", "call_seq", "request_body", "response_body", "response_body_truncated",
        F.try_element_at("request_headers", F.lit("cookie")).alias("cookie"), F.size("secrets").alias("secrets"),
    )


@query
def masked_endpoint_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(spark, sf).endpoints.select(*KEY, "request_body_sample", "response_body_sample")


@query
def masked_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(_masked(spark, sf).calls)


@query
def masked_schema_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_shape(_masked(spark, sf).shapes, [*KEY, "side"])


# --- cases the sample capture lacks, made from its rows --------------------------


def _turn(column: str, values: list[str | None]) -> Column:
    """One of the values by the remainder of an id."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(column) % len(values) + 1).cast("int"))


#: Scan targets of every kind; null stands for the page's own URL.
TARGETS = [
    None, "http://127.0.0.1/a", "http://192.168.1.5/", "http://172.16.0.9:8080/x", "http://172.32.0.9/x", "https://printer.local/",
    "ftp://files.example.com/", "no url at all", "http://LOCALHOST:3000/", "https://db.internal/", "http://10.1.2.3/", "https://host.local.example.com/",
]


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.coalesce(_turn("page_id", TARGETS), F.col("url")).alias("seed_url"))


@query
def target_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return scope.target_check(_targets(spark, sf)).select("page_id", F.coalesce("refused", F.lit("accepted")).alias("verdict"))


@query
def private_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _targets(spark, sf).select("page_id", F.coalesce(urls.is_private_host("seed_url"), F.lit(False)).alias("private_host"))


MIMES = ["application/json", "Image/PNG; q=1", "application/pdf", "text/html", "", None, "application/octet-stream"]
BODIES = ['{"a":1}', None, "plain text", "[1, 2]", '{"cut":']


@query
def body_gap_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Why a body has no shape, for every kind of MIME type, body and cut."""
    rows = table(spark, sf, "events").select(
        "event_id", _turn("event_id", MIMES).alias("mime"), _turn("event_id", BODIES).alias("body"), (F.col("event_id") % 11 == 0).alias("cut")
    )
    return rows.select(
        "event_id",
        F.coalesce(tx.response_gap("body", "cut", "mime"), F.lit("")).alias("reason"),
        F.coalesce(tx.is_binary_mime("mime"), F.lit(False)).alias("binary"),
    )


@query
def masked_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies with sensitive keys, written in several ways and nested."""
    uid = F.col("user_id").cast("string")
    body = F.when(
        F.col("event_id") % 3 == 0, F.concat(F.lit('{"Pass-Word":"p'), uid, F.lit('","note":"x'), uid, F.lit('","n":1}'))
    ).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit('{"user":{"api_key":["k'), uid, F.lit('",7,{"deep":"d"}],"id":"i'), uid, F.lit('"}}'))
    ).otherwise(F.concat(F.lit('[{"clientSecret":null,"list":["a'), uid, F.lit('"]},{"token":"t'), uid, F.lit('"}]')))
    masked = table(spark, sf, "events").select("event_id", redaction.redact_body(body).alias("m"))
    return masked.select("event_id", "m.body", F.size("m.secrets").alias("secrets"))


@query
def endpoints_with_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Where nothing is known but of the endpoints themselves, logins and users have nothing to say."""
    found = _report(spark, sf)
    nothing = lambda rows: rows.where(F.lit(False))
    shapes = found.shapes.where(~F.col("url_pattern").rlike("/(login|users|products)"))
    return vw.has_contract(found.endpoints, nothing(found.params), shapes, nothing(found.errors)).select("scan_id", "id")


def _drifted(spark: SparkSession, sf: str, *names: str) -> tuple[diff.Snapshot, diff.Snapshot]:
    """The second scan with other statuses of users, another category of carts and other vendors of tracking calls."""
    before, after = _snapshots(spark, sf, *names)
    of = lambda noun: F.col("id").contains(f"/api/{noun}")
    codes = F.when(of("users"), F.array(F.lit(500), F.lit(503))).when(of("products"), F.array(F.lit(200), F.lit(304))).otherwise(F.col("status_codes"))
    endpoints = after.endpoints.withColumns(
        {"status_codes": codes, "category": F.when(of("login"), F.lit("payments")).otherwise(F.col("category"))}
    )
    return before, replace(after, endpoints=endpoints)


@query
def drifted_statuses(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _drifted(spark, sf, "params")
    return _details(diff.diff_statuses(before.endpoints, after.endpoints))


@query
def drifted_categories(spark: SparkSession, sf: str) -> DataFrame:
    before, after = _drifted(spark, sf, "params")
    return _details(diff.diff_category(before.endpoints, after.endpoints))


@query
def drifted_vendors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vendor of the second scan is renamed, moved, or sends other keys, by the length of the endpoint's id."""
    before, after = _snapshots(spark, sf, "vendors")
    kind = F.length("id") % 3
    vendors = after.vendors.withColumns(
        {
            "vendor": F.when(kind == 0, F.lit("Other")).otherwise(F.col("vendor")),
            "vendor_category": F.when(kind == 1, F.lit("ads")).otherwise(F.col("vendor_category")),
            "payload_keys": F.when(kind == 2, F.array(F.lit("page"), F.lit("user"))).otherwise(F.col("payload_keys")),
        }
    )
    return _details(diff.diff_vendors(before, replace(after, vendors=vendors)))


@query
def contract_breaches(spark: SparkSession, sf: str) -> DataFrame:
    """A report with some endpoints broken: every breach with its path, over all tables."""
    found = _report(spark, sf)
    of = lambda noun: F.col("id").contains(f"/api/{noun}")
    broken = found.endpoints.withColumns(
        {
            "category": F.when(of("orders"), F.lit("unknown")).otherwise(F.col("category")),
            "status_codes": F.when(of("users"), F.array(F.lit(200), F.lit(999), F.lit(200))).otherwise(F.col("status_codes")),
            "count": F.when(of("login"), F.lit(0)).otherwise(F.col("count")),
            "timing": F.when(
                of("track"), F.struct(F.lit(9).cast("bigint").alias("p50"), F.lit(5).cast("bigint").alias("p95"), F.lit(None).cast("bigint").alias("max"))
            ).otherwise(F.col("timing")),
        }
    )
    rows = contract.report_violations(found.tables() | {"endpoints": broken})
    return rows.select("table", F.get_json_object("row", "$.scan_id").alias("scan_id"), F.get_json_object("row", "$.id").alias("id"), "path", "problem")


def _positions(ordered: DataFrame) -> DataFrame:
    """The place of every row of a sorted table, from 1: partitions are in order, and rows within them."""
    marked = settle(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.call_function("shiftright", "_id", F.lit(33)), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_before"))
    placed = marked.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn("position", F.col("_before") + row + 1).drop("_id", "_part", "_before")


@query
def sorted_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    ordered = vw.sort_endpoints(_report(spark, sf).endpoints.select("scan_id", "category", "id"))
    return _positions(ordered).select("scan_id", "id", "position")


@query
def endpoints_by_count(spark: SparkSession, sf: str) -> DataFrame:
    rows = _report(spark, sf).endpoints.where(F.col("scan_id") == AFTER).select("id", "category", "count")
    return _positions(vw.endpoint_sort(rows, "count", descending=True)).select("id", "position")


@query
def endpoints_by_pages(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    rows = found.endpoints.where(F.col("scan_id") == BEFORE).select(*KEY, "id", "category")
    return _positions(vw.endpoint_sort(rows, "pages", pages=vw.page_counts(found.values))).select("id", "position")


# --- what is written is read back ------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def read_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls as a capture writes them, read and normalised."""
    path = _folder(spark, "calls")
    raw = samples.calls(spark, sf).withColumns(
        {"method": F.lower("method"), "mime_type": F.when(F.col("mime_type") != "", F.concat("mime_type", F.lit(" ; charset=utf-8"))), "status": F.nullif("status", F.lit(0))}
    )
    raw.write.parquet(path)
    return capture_source.read_calls(spark, path).select("scan_id", "call_seq", "method", "mime_type", "status", "triggered_by", "request_body")


@query
def read_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Calls without a response, read and put beside the others."""
    path = _folder(spark, "failures")
    columns = [part.split()[0] for part in schemas.FAILED_CALLS.split(", ") if part.split()]
    failed = samples.calls(spark, sf).where(F.col("status") == 0).select(*[c for c in columns if c in samples.calls(spark, sf).columns])
    failed.withColumn("method", F.lower("method")).write.json(path)
    rows = capture_source.read_failed_calls(spark, path, "json")
    return rows.select("scan_id", "call_seq", "method", "status", "mime_type", "duration_ms", F.size("response_headers").alias("headers"))


@query
def read_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Socket frames read from text and bytes."""
    path, frames = _folder(spark, "frames"), samples.frames(spark, sf)
    binary = F.col("frame_seq") % 3 == 1
    raw = frames.select(
        "scan_id", "conn_seq", "frame_seq", "direction",
        F.when(~binary, F.col("payload")).alias("text"), F.when(binary, F.encode("payload", "utf-8")).alias("data"), "at",
    )
    raw.write.parquet(path)
    return capture_source.read_frames(spark, path).select("conn_seq", "frame_seq", "type", "payload", "size")


@query
def report_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The endpoint table of a report that was written, read from its folder."""
    path = _folder(spark, "report")
    tables.write_report({"endpoints": _report(spark, sf).endpoints.select(*KEY, "count", "status_codes")}, path)
    rows = spark.read.parquet(f"{path}/endpoints")
    return rows.select(*KEY, F.col("count").alias("calls"), _joined("status_codes").alias("statuses"))


@query
def snapshot_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Of three stored snapshots, the newest is read."""
    path, found = _folder(spark, "snapshot"), _report(spark, sf).endpoints.select(*KEY, "count")
    for name, rows in (("2024-01", found.limit(0)), ("2024-03", found), ("2024-02", found.withColumn("count", F.lit(0).cast("bigint")))):
        tables.write_snapshot({"endpoints": rows}, path, name)
    return tables.read_snapshot_tables(spark, path, ["endpoints"])["endpoints"].select(*KEY, F.col("count").alias("calls"))


@query
def signals_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as they are written, one JSON line each in the folder of their scan."""
    path, found = _folder(spark, "signals"), signals(spark, sf)
    tables.write_signals(found, path)
    return spark.read.schema(found.schema).json(path).select(*found.columns)


@query
def payloads_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The side table of oversized bodies, written by two parts of a capture and read as one."""
    path, calls = _folder(spark, "payloads"), samples.calls(spark, sf)
    masked = redaction.redact_body("body")["body"]
    spilled = settle(caps.spilled_payloads(caps.call_payloads(calls), masked, max_chars=60, total_chars=150_000))
    for part in (0, 1):
        tables.write_payloads(spilled.where(F.col("part") == part), path)
    rows = spark.read.parquet(path)
    return rows.select("scan_id", "call_seq", "payload_key", F.sha2("body", 256).alias("digest"))


# --- OpenAPI -------------------------------------------------------------------


@query
def openapi_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return openapi.openapi_schemas(_report(spark, sf).shapes, [*KEY, "side"])


@query
def openapi_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = _report(spark, sf)
    operations = openapi.openapi_operations(found.endpoints, found.params, found.shapes, found.errors, found.vendors)
    return openapi.openapi_paths(operations)
