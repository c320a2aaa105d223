"""Scans that stopped and go on: what a stored capture amounts to, and the limits of what follows it.

All that a limit needs of earlier rows is a sum per scan: calls seen, sockets seen, characters charged to
the budgets, and the last place. Sums add up, so the state of a scan is the sum of the states of its
parts, and a scan cut anywhere and resumed keeps the same rows as one that ran through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.urls import normalize_url
from callsight.operators import caps

STATE = """
  scan_id STRING, version INT, seed_url STRING, started_at BIGINT, calls BIGINT, last_seq BIGINT,
  stored_chars BIGINT, spilled_chars BIGINT, sockets BIGINT
"""


class WrongState(ValueError):
    """A stored state that does not belong to the scan, or that this version cannot read."""


def scan_state(
    calls: DataFrame,
    seeds: DataFrame,
    sockets: DataFrame | None = None,
    earlier: DataFrame | None = None,
    max_chars: int = fv.MAX_BODY_CHARS,
) -> DataFrame:
    """The state of every scan of ``seeds`` (``scan_id, seed_url``) after these calls and sockets.

    ``calls`` are those met, before any limit; ``earlier`` is the state they follow.
    """
    sizes = [F.col(name) for name in ("request_body", "response_body")]
    stored = sum((caps.stored_chars(size, max_chars) for size in sizes), F.lit(0))
    over = sum((F.when(F.length(size) > max_chars, F.length(size)).otherwise(0) for size in sizes), F.lit(0))
    seen = calls.groupBy("scan_id").agg(
        F.min("started_at").alias("started_at"),
        F.count(F.lit(1)).alias("calls"),
        F.max("call_seq").alias("last_seq"),
        F.sum(stored).alias("stored_chars"),
        F.sum(over).cast("bigint").alias("spilled_chars"),
    )
    state = seeds.select("scan_id", F.lit(fv.SCAN_STATE_VERSION).alias("version"), "seed_url").join(seen, "scan_id", "left")
    if sockets is None:
        state = state.withColumn("sockets", F.lit(0).cast("bigint"))
    else:
        state = state.join(sockets.groupBy("scan_id").agg(F.count(F.lit(1)).alias("sockets")), "scan_id", "left")
    counts = ["calls", "stored_chars", "spilled_chars", "sockets"]
    state = state.withColumns({name: F.coalesce(name, F.lit(0)) for name in counts})
    return state if earlier is None else added(earlier, state)


def added(*states: DataFrame) -> DataFrame:
    """One state per scan: counts add up, the first start and the last place stay."""
    rows = states[0]
    for state in states[1:]:
        rows = rows.unionByName(state)
    return rows.groupBy("scan_id").agg(
        F.max("version").alias("version"),
        F.min("seed_url").alias("seed_url"),
        F.min("started_at").alias("started_at"),
        F.sum("calls").alias("calls"),
        F.max("last_seq").alias("last_seq"),
        *[F.sum(name).alias(name) for name in ("stored_chars", "spilled_chars", "sockets")],
    )


def write_state(state: DataFrame, path: str, mode: str = "overwrite") -> None:
    state.select("scan_id", "version", "seed_url", "started_at", "calls", "last_seq", "stored_chars", "spilled_chars", "sockets").write.mode(mode).parquet(path)


def read_state(spark: SparkSession, path: str, seeds: DataFrame) -> DataFrame:
    """The stored state of the scans of ``seeds``; a wrong version or another seed is refused before anything runs."""
    state = spark.read.schema(STATE).parquet(path).join(seeds.select("scan_id", F.col("seed_url").alias("asked")), "scan_id", "left")
    wrong = (
        F.when(F.col("version").isNull() | (F.col("version") != fv.SCAN_STATE_VERSION), F.lit("is of another version"))
        .when(F.coalesce("seed_url", F.lit("")) == "", F.lit("does not name a seed URL"))
        .when(F.col("asked").isNull(), F.lit("is of a scan that is not asked for"))
        .when(normalize_url("seed_url") != normalize_url("asked"), F.concat(F.lit("is for "), "seed_url", F.lit(", not "), "asked"))
    )
    for row in state.select("scan_id", wrong.alias("wrong")).where("wrong is not null").orderBy("scan_id").limit(1).collect():
        raise WrongState(f"the state of scan {row.scan_id} {row.wrong}")
    return state.drop("asked")


def resumed_calls(calls: DataFrame, state: DataFrame, limit: int = fv.MAX_CALLS) -> DataFrame:
    """Of later calls, those that the limit of their scan still keeps."""
    return caps.cap_calls(calls, limit, start=state.select("scan_id", F.col("calls").alias("_nth")))


def resumed_bodies(
    payloads: DataFrame, state: DataFrame, max_chars: int = fv.MAX_BODY_CHARS, total_chars: int = fv.TOTAL_BODY_CHARS
) -> DataFrame:
    """Later payloads under what is left of the budget of their scan."""
    start = state.select("scan_id", F.col("stored_chars").alias("_stored"))
    return caps.body_budget(payloads, ["scan_id"], ["call_seq", "part"], "body", max_chars, total_chars, start=start)


def resumed_sockets(sockets: DataFrame, state: DataFrame, limit: int = fv.MAX_SOCKETS) -> DataFrame:
    """Of later sockets, those that the limit of their scan still keeps."""
    return caps.cap_sockets(sockets, limit, start=state.select("scan_id", F.col("sockets").alias("_nth")))


def restore(stored: dict[str, DataFrame], later: dict[str, DataFrame], state: DataFrame, max_calls: int = fv.MAX_CALLS, max_sockets: int = fv.MAX_SOCKETS) -> dict[str, DataFrame]:
    """The tables of a stored capture continued by those of its later part, which the state's limits cut.

    Rows of scans without a state are not taken up; other tables than calls and sockets are only put together.
    """
    limits = {"calls": (resumed_calls, max_calls), "sockets": (resumed_sockets, max_sockets)}
    known = state.select("scan_id")
    out = {}
    for name in stored.keys() | later.keys():
        parts = []
        if name in stored:
            parts.append(stored[name].join(known, "scan_id", "left_semi"))
        if name in later:
            rows = later[name].join(known, "scan_id", "left_semi")
            parts.append(limits[name][0](rows, state, limits[name][1]) if name in limits else rows)
        out[name] = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out
