"""Retention limits: how much of a scan is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.operators.running import with_pace, with_running


def cap_calls(calls: DataFrame, limit: int = fv.MAX_CALLS, start: DataFrame | None = None) -> DataFrame:
    """The first calls of every scan, in capture order. ``start`` counts earlier ones (``scan_id, _nth``)."""
    counted = with_running(calls, ["scan_id"], ["call_seq"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, start=start)
    return counted.where(F.col("_nth") <= limit).drop("_nth")


def dropped(rows: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """How many rows a limit leaves out per key."""
    over = F.count(F.lit(1)) - limit
    return rows.groupBy(*keys).agg(F.greatest(over, F.lit(0)).alias("dropped"))


def cap_sockets(sockets: DataFrame, limit: int = fv.MAX_SOCKETS, start: DataFrame | None = None) -> DataFrame:
    """The first connections of every scan. ``start`` counts earlier ones (``scan_id, _nth``)."""
    if start is None:
        return _first_rows(sockets, ["scan_id"], ["conn_seq"], limit)
    counted = with_running(sockets, ["scan_id"], ["conn_seq"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, start=start)
    return counted.where(F.col("_nth") <= limit).drop("_nth")


def cap_frames(frames: DataFrame, limit: int = fv.MAX_FRAMES) -> DataFrame:
    """The first frames of every connection."""
    return _first_rows(frames, ["scan_id", "conn_seq"], ["frame_seq"], limit)


def _first_rows(rows: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    # Spark applies a row_number limit of this size before the shuffle, so a hot key stays small.
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_nth") <= limit).drop("_nth")


def frame_counters(frames: DataFrame, limit: int = fv.MAX_FRAMES) -> DataFrame:
    """Frames per connection and direction, counting those the limit leaves out."""
    return frames.groupBy("scan_id", "conn_seq").agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.count_if(F.col("direction") == "sent").alias("sent_count"),
        F.count_if(F.col("direction") == "received").alias("received_count"),
        (F.count(F.lit(1)) > limit).alias("frames_truncated"),
    )


def stored_chars(body: str | Column, max_chars: int = fv.MAX_BODY_CHARS) -> Column:
    """What a payload takes of the total budget."""
    length = F.coalesce(F.length(body), F.lit(0))  # first: ``least`` passes over nulls
    return F.least(length, F.lit(max_chars)).cast("bigint")


def body_budget(
    payloads: DataFrame,
    keys: list[str],
    order: list[str],
    body: str,
    max_chars: int = fv.MAX_BODY_CHARS,
    total_chars: int = fv.TOTAL_BODY_CHARS,
    start: DataFrame | None = None,
) -> DataFrame:
    """Cut payloads to the per-payload limit and drop all from the one that breaks the total budget.

    The budget is sticky: the running total never shrinks, so "over budget" holds from the first
    payload that breaks it to the last. ``start`` (the keys and ``_stored``) is what earlier payloads took.
    """
    running = with_running(payloads, keys, order, {"_stored": ("sum", stored_chars(body, max_chars))}, start=start)
    fits = F.col("_stored") <= total_chars
    return running.withColumns(
        {
            "truncated": fits & F.coalesce(F.length(body) > max_chars, F.lit(False)),
            body: F.when(fits, F.left(F.col(body), F.lit(max_chars))),
        }
    ).drop("_stored")


def call_payloads(calls: DataFrame) -> DataFrame:
    """Request and response bodies as one ordered table: the request of a call precedes its response."""
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("request").alias("kind"), F.col("request_body").alias("body")),
        F.struct(F.lit(1).alias("part"), F.lit("response").alias("kind"), F.col("response_body").alias("body")),
    )
    return (
        calls.select("scan_id", "call_seq", F.explode(parts).alias("p"))
        .select("scan_id", "call_seq", "p.part", "p.kind", "p.body")
        .where("body is not null")
    )


def spilled_payloads(
    payloads: DataFrame, masked: Column, max_chars: int = fv.MAX_BODY_CHARS, total_chars: int = fv.SPILL_CHARS
) -> DataFrame:
    """The side table of oversized bodies, written in full and masked while the spill budget lasts.

    Expects the columns of :func:`call_payloads`. Adds ``payload_key``, what a call stores instead.
    """
    oversized = payloads.where(F.length("body") > max_chars)
    running = with_running(
        oversized, ["scan_id"], ["call_seq", "part"], {"_spilled": ("sum", F.length("body").cast("bigint"))}
    )
    key = F.concat(F.lit("payloads/"), F.col("kind"), F.lit("-body-"), F.col("call_seq").cast("string"))
    return (
        running.where(F.col("_spilled") <= total_chars)
        .drop("_spilled")
        .withColumns({"payload_key": key, "body": masked})
    )


def recent_rows(rows: DataFrame, keys: list[str], order: str, limit: int = 3) -> DataFrame:
    """The newest rows per key, newest first in ``position``."""
    newest = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """One row per scan and normalised URL: the earliest visit."""
    first = pages.groupBy("scan_id", "normalized_url").agg(F.min("page_seq").alias("page_seq"))
    return pages.join(first, ["scan_id", "normalized_url", "page_seq"], "left_semi")


# A minute of one origin's requests is ordered at a time.
PACING_BUCKET_MS = 60_000


def request_pacing(starts: DataFrame, delay_ms: int) -> DataFrame:
    """Per origin: gap to the previous start, whether it was too short, and the earliest paced start.

    ``starts`` has ``origin, started_at, call_seq``. The paced start of the i-th request is
    ``i*d + max(t_j - j*d)`` over the requests up to it.
    """
    paced = with_pace(starts, ["origin"], "started_at", "call_seq", delay_ms, width=PACING_BUCKET_MS)
    gap = F.col("started_at") - F.col("previous_at")
    return paced.select(
        "origin", "call_seq", "started_at", gap.alias("gap_ms"), F.coalesce(gap < delay_ms, F.lit(False)).alias("too_soon"), "paced_at"
    )
