"""Capture tables derived from the sample tables (``events``, ``pages``, ``conversations``).

The samples hold no recorded traffic, so each event stands for one call: its
type, user, value and ``k`` property decide method, URL, status, headers and
bodies. Only integer arithmetic and text concatenation are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.functions.memo import reused

SEED_URL = "https://shop.example.com/"
BEFORE, AFTER = "before", "after"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A sample table. ``spread`` hands one stored in fewer files than there are cores to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and len(rows.inputFiles()) < cores else rows


def seeds(spark: SparkSession) -> DataFrame:
    """One seed URL per scan (a fixed two-row table)."""
    return spark.createDataFrame([(BEFORE, SEED_URL), (AFTER, SEED_URL)], "scan_id string, seed_url string")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@reused
def _call_columns() -> list[Column]:
    """Columns of a call over the columns of an event."""
    etype = F.col("event_type")
    k, c, uid, eid = F.col("k"), F.col("c"), F.col("user_id"), F.col("event_id")
    after = F.col("scan_id") == AFTER
    graphql = (etype == "view") & (k % 10 == 4)
    failed = (etype == "view") & (k == 13)

    noun = (
        F.when(graphql, F.lit("graphql"))
        .when(etype == "view", F.lit("products"))
        .when((etype == "click") & (k % 3 == 1), F.lit("assets"))
        .when(etype == "click", F.lit("track"))
        .when((etype == "signup") & (k % 5 == 0), F.lit("login"))
        .when(etype == "signup", F.lit("users"))
        .when((etype == "purchase") & (k % 4 == 3) & after, F.lit("invoices"))
        .when((etype == "purchase") & (k % 4 == 3), F.lit("carts"))
        .otherwise(F.lit("orders"))
    )
    host = (
        F.when((etype == "click") & (k % 3 == 0), F.lit("api.segment.io"))
        .when((etype == "click") & (k % 3 == 1), F.lit("cdn.other.example.net"))
        .otherwise(F.lit("shop.example.com"))
    )
    item = (
        F.when(graphql | (eid % 2 == 1), F.lit(""))
        .when(etype == "purchase", _text("/", uid, "/items/", eid))
        .otherwise(_text("/", uid))
    )
    method = (
        F.when(graphql, F.lit("POST"))
        .when(etype.isin("view", "click"), F.lit("GET"))
        .when(etype.isin("signup", "purchase"), F.lit("POST"))
        .when(k % 2 == 0, F.lit("GET"))
        .otherwise(F.lit("DELETE"))
    )
    status = (
        F.when(failed, F.lit(0))
        .when(etype == "error", F.element_at(F.array(*[F.lit(s) for s in (400, 401, 404, 500)]), k % 4 + 1))
        .when(etype == "signup", F.lit(201))
        .otherwise(F.lit(200))
    )
    state = F.element_at(F.array(F.lit("new"), F.lit("paid"), F.lit("sent")), k % 3 + 1)
    request_body = (
        F.when(
            graphql & (k % 20 == 4),
            _text(
                '{"query":"query Product($id: ID!) { item: product(id: $id) { name } reviews(first: 3) @include(if: true)'
                ' { id ...Stars } } fragment Stars on Review { stars }","operationName":"Product","variables":{"id":"',
                uid,
                '"}}',
            ),
        )
        .when(graphql & after, _text('{"query":"mutation AddItem { addItem(sku: \\"s{1}\\", qty: ', k, ') { total } }"}'))
        .when(graphql, _text('{"query":"{ viewer { id } __schema { types { name } } }","user":', uid, "}"))
        .when(
            etype.isin("signup", "purchase"),
            _text('{"user":', uid, ',"email":"u', uid, '@example.com","amount":', c, "}"),
        )
    )
    total_field = F.when(k == 8, F.lit("")).when(k == 7, _text(',"total":"', c, '"')).otherwise(_text(',"total":', c))
    response_body = (
        F.when(failed | (etype == "click"), F.lit(None).cast("string"))
        .when(
            (etype == "error") & (k % 4 == 3) & after,
            _text('{"error":"e', k % 3, '","trace":"stack trace ', F.repeat(F.lit("x"), 6000), '"}'),
        )
        .when(etype == "error", _text('{"error":"e', k % 3, '"}'))
        .when(graphql, _text('{"data":{"product":{"name":"p', k % 7, '"}}}'))
        .when(
            (etype == "view") & after,
            _text('{"id":', eid, total_field, ',"currency":"EUR","lines":[null,{"sku":"s', k % 3, '","qty":', k % 5, "}]}"),
        )
        .when(
            etype == "view",
            _text('{"id":', eid, ',"state":"', state, '"', total_field, ',"lines":[{"sku":"s', k % 3, '","qty":', k % 5, "}]}"),
        )
        .when(k == 18, F.lit("not available"))
        .otherwise(_text('{"id":', eid, ',"state":"', state, '"', total_field, "}"))
    )
    mime = F.when(failed | (etype == "click"), F.lit("")).otherwise(F.lit("application/json"))

    def headers(*pairs: tuple[str, Column]) -> Column:
        """Map of the pairs whose value is not null."""
        full = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs]))
        return F.map_filter(full, lambda _, value: value.isNotNull())

    request_headers = headers(
        ("accept", F.lit("*/*")),
        ("content-type", F.when(request_body.isNotNull(), F.lit("application/json"))),
        ("cookie", F.when((k % 2 == 0) & (etype != "signup"), _text("sid=", uid))),
        ("x-contact", F.when(k % 10 == 1, _text("ops", k, "@example.com"))),
    )
    response_headers = headers(
        ("Content-Type", F.when(mime != "", mime)),
        ("X-Cache", F.when(~failed, F.when(k % 2 == 0, F.lit("HIT")).otherwise(F.lit("MISS")))),
        ("Cache-Control", F.when((eid % 2 == 0) & ~failed, F.lit("max-age=60"))),
        ("Age", F.when((eid % 2 == 0) & ~failed, k.cast("string"))),
        ("X-Content-Type-Options", F.when(etype == "signup", F.lit("nosniff"))),
    )
    return [
        "scan_id",
        eid.alias("call_seq"),
        method.alias("method"),
        _text("https://", host, "/api/", noun, item, "?page=", k % 5, "&utm_source=x&token=t", k, "#top").alias("url"),
        status.cast("int").alias("status"),
        mime.alias("mime_type"),
        F.when(k % 10 == 9, F.lit("image")).when(k % 2 == 1, F.lit("xhr")).otherwise(F.lit("fetch")).alias("resource_type"),
        request_headers.alias("request_headers"),
        request_body.alias("request_body"),
        response_headers.alias("response_headers"),
        response_body.alias("response_body"),
        F.lit(False).alias("response_body_truncated"),
        F.lit(None).cast("string").alias("request_body_file"),
        F.lit(None).cast("string").alias("response_body_file"),
        F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").alias("started_at"),
        c.alias("duration_ms"),
        "triggered_by",
    ]


def calls_of(events: DataFrame, pages: DataFrame) -> DataFrame:
    """The ``calls`` table of an events table (batch or stream) and its triggering pages."""
    rows = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit(BEFORE)).otherwise(F.lit(AFTER)).alias("scan_id"),
    )
    total = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    triggers = pages.select(F.col("page_id").alias("trigger_id"), F.col("url").alias("triggered_by"))
    rows = rows.withColumn("trigger_id", F.col("event_id") % total).join(triggers, "trigger_id")

    return rows.select(*_call_columns())


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_of(table(spark, sf_dir, "events", spread=True), table(spark, sf_dir, "pages"))


def frames_of(conversations: DataFrame) -> DataFrame:
    """Conversation turns (batch or stream) as socket frames; their payload is a small JSON message."""
    role = F.col("role")
    size = F.length("text")
    payload = (
        F.when(role == "system", F.lit("hello"))
        .when(F.col("turn") % 5 == 4, _text('{"type":"note","turn":', F.col("turn"), ',"chars":"', size, '"}'))
        .otherwise(_text('{"type":"message","turn":', F.col("turn"), ',"chars":', size, "}"))
    )
    return conversations.select(
        F.lit(AFTER).alias("scan_id"),
        F.col("conv_id").alias("conn_seq"),
        F.col("turn").cast("bigint").alias("frame_seq"),
        F.when(role == "user", F.lit("sent")).otherwise(F.lit("received")).alias("direction"),
        F.lit("text").alias("type"),
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("size"),
        F.lit(False).alias("truncated"),
        F.col("turn").cast("bigint").alias("at"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(table(spark, sf_dir, "conversations"))


def captured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages with their URL and HTML."""
    return table(spark, sf_dir, "pages", spread=True).select("page_id", "url", "html")
