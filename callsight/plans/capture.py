"""What of the calls met is stored, in the order a capture decides it.

Calls that are no API traffic or out of scope leave first. A response body is read if its type and declared
length allow it; bodies are charged to the budget of their scan, masked and cut; and the first calls of a
scan are kept. Budget and limit are sticky, so each comes down to one place per
scan: these places are found from lengths alone, and the calls themselves are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import header_value
from callsight.operators.caps import stored_chars
from callsight.operators.redaction import redact_calls
from callsight.operators.running import bucket_totals, running_in
from callsight.operators.scope import capture_scope
from callsight.operators.sizing import settle
from callsight.sources.capture import api_only, gated_response_body


@dataclass(frozen=True)
class Rules:
    """How a capture is stored. ``scope`` is a table of :data:`callsight.schemas.SCOPE`; without it every host counts."""

    scope: DataFrame | None = None
    mask: bool = True
    max_calls: int = fv.MAX_CALLS
    max_chars: int = fv.MAX_BODY_CHARS
    total_chars: int = fv.TOTAL_BODY_CHARS


def limit_places(calls: DataFrame, rules: Rules, state: DataFrame | None = None) -> DataFrame:
    """Per scan: the last call that is kept, the call that breaks the budget, and whether its request still fits.

    ``state`` (``scan_id, calls, stored_chars``) is what an earlier part of the scan amounted to.
    """
    sizes = calls.select(
        "scan_id",
        "call_seq",
        stored_chars("request_body", rules.max_chars).alias("_request"),
        stored_chars("response_body", rules.max_chars).alias("_response"),
    )
    measures = {"_nth": ("sum", F.lit(1).cast("bigint")), "_charged": ("sum", F.col("_request") + F.col("_response"))}
    start = None if state is None else state.select("scan_id", F.col("calls").alias("_nth"), F.col("stored_chars").alias("_charged"))
    buckets = settle(bucket_totals(sizes, ["scan_id"], "call_seq", measures, start=start))
    upto = lambda name: F.col(f"_carry_{name}") + F.col(f"_all_{name}")
    whole = buckets.groupBy("scan_id").agg(F.max(F.when(upto("_nth") <= rules.max_calls, F.col("_until"))).alias("_last"))
    # Only buckets in which a limit may break are read row by row: one for each limit and scan.
    broken = F.min(F.when(upto("_charged") > rules.total_chars, F.col("_bucket"))).over(Window.partitionBy("scan_id"))
    at_limit = (F.col("_carry__nth") < rules.max_calls) & (upto("_nth") > rules.max_calls)
    near = settle(buckets.withColumn("_broken", broken).where(at_limit | (F.col("_bucket") == F.col("_broken"))).drop("_broken"))
    running = running_in(sizes, near, ["scan_id"], ["call_seq"], measures)
    fits = F.col("_charged") - F.col("_response") <= rules.total_chars
    over = F.when(F.col("_charged") > rules.total_chars, F.struct("call_seq", fits.alias("request")))
    inside = running.groupBy("scan_id").agg(
        F.max(F.when(F.col("_nth") <= rules.max_calls, F.col("call_seq"))).alias("_within"), F.min(over).alias("_broke")
    )
    return whole.join(inside, "scan_id", "left").select("scan_id", F.greatest("_last", "_within").alias("_last"), "_broke")


def captured(calls: DataFrame, rules: Rules, state: DataFrame | None = None) -> DataFrame:
    """The calls as they are stored; ``secrets`` holds the originals of what was masked."""
    met = api_only(calls)
    if rules.scope is not None:
        met = capture_scope(met, rules.scope)
    declared = header_value("response_headers", "content-length")
    met = met.withColumn("response_body", gated_response_body(F.col("response_body"), F.col("mime_type"), declared, rules.max_chars))
    places = settle(limit_places(met, rules, state))
    before = F.col("_broke").isNull() | (F.col("call_seq") < F.col("_broke.call_seq"))
    last_request = (F.col("call_seq") == F.col("_broke.call_seq")) & F.col("_broke.request")
    kept = met.join(places, "scan_id").where(F.col("call_seq") <= F.col("_last"))
    long = F.coalesce(F.length("response_body") > rules.max_chars, F.lit(False))
    stored = kept.withColumns(
        {
            "response_body_truncated": before & long,
            "request_body": F.when(before | last_request, F.col("request_body")),
            "response_body": F.when(before, F.col("response_body")),
        }
    ).drop("_last", "_broke")
    # Masked whole, then cut: a body cut first might no longer be JSON, and show what its end would have masked.
    masked = redact_calls(stored) if rules.mask else stored.withColumn("secrets", F.array().cast("array<string>"))
    return masked.withColumns({name: F.left(name, F.lit(rules.max_chars)) for name in ("request_body", "response_body")})
