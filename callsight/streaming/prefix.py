"""Limits of a capture on a stream: the rows a batch limit would keep, whatever the order they arrive in.

A limit keeps the first rows of a key in capture order while a running total stays within it, and is
sticky: the first row that breaks it ends what is kept, smaller rows after it included. A row that
arrives late can push others out. State therefore holds, per key, the rows kept so far in capture order
and the place where the limit broke, never more than the limit allows; a row beyond that place is
forgotten at once. When a key has been silent for a while of event time, its rows are handed out and its
state is released.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from callsight import fixed_values as fv

_WEIGHT, _AT = "_weight", "_at"
#: Where a row without a place stands.
_FIRST = -(1 << 63)


#: What a session needs for processors with list state and timers.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000
YEAR_MS = 365 * 24 * HOUR_MS


def within(rows: list[tuple], limit: int) -> tuple[list[tuple], tuple | None]:
    """Of (place, weight, ...) rows sorted by place, those within the limit, and the place that breaks it."""
    total = 0
    for at, row in enumerate(rows):
        total += row[1]
        if total > limit:
            return rows[:at], row[0]
    return rows, None


class OrderedPrefix(StatefulProcessor):
    """Keeps per key the rows within a limit, ordered; hands them out when the key has been silent for ``idle_ms``."""

    def __init__(self, schema: StructType, order: list[str], limit: int, idle_ms: int):
        self.schema, self.order, self.limit, self.idle_ms = schema, order, limit, idle_ms
        names = schema.fieldNames()
        self.places, self.weight, self.time = [names.index(name) for name in order], names.index(_WEIGHT), names.index(_AT)

    def _placed(self, row: tuple) -> tuple:
        return tuple(_FIRST if row[at] is None else row[at] for at in self.places), row[self.weight], row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.schema)
        places = [StructField(name, LongType()) for name in self.order]
        self.broke = handle.getValueState("broke", StructType(places))
        self.until = handle.getValueState("until", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        broke = tuple(self.broke.get()) if self.broke.exists() else None
        until = self.until.get()[0] if self.until.exists() else None
        latest, fresh = until, []
        for row in rows:
            latest = max(latest or 0, row[self.time] + self.idle_ms)
            placed = self._placed(tuple(row))
            if broke is None or placed[0] < broke:
                fresh.append(placed)
        if fresh:
            held = [self._placed(tuple(row)) for row in self.kept.get()] if self.kept.exists() else []
            kept, now = within(sorted(held + fresh, key=lambda row: row[0]), self.limit)
            if kept:
                self.kept.put([row for _, _, row in kept])
            else:
                self.kept.clear()
            if now is not None:
                self.broke.update(now)
        if latest != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
            self.until.update((latest,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rows = list(self.kept.get()) if self.kept.exists() else []
        for state in (self.kept, self.broke, self.until):
            state.clear()
        yield from (Row(*self.schema.fieldNames())(*row) for row in rows)

    def close(self) -> None:
        pass


def _trimmed(keys: list[str], order: list[str], limit: int):
    """Drop, batch by batch, what cannot be kept: a limit broken within a batch is broken in all."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([*keys, *order, _WEIGHT]).to_pandas().sort_values(keys + order, kind="stable", na_position="first")
            before = rows.groupby(keys, dropna=False, sort=False)[_WEIGHT].cumsum() - rows[_WEIGHT]
            # The row that breaks the limit goes along: it tells the others where the limit broke.
            yield batch.filter(pa.array((before <= limit).sort_index().to_numpy()))

    return trim


def first_rows(
    rows: DataFrame, keys: list[str], order: list[str], weight: Column, limit: int, at: str, delay_ms: int = HOUR_MS, idle_ms: int = HOUR_MS
) -> DataFrame:
    """Of a stream, the rows per key that a sticky limit keeps, in the order of the long columns ``order``.

    ``weight`` is what a row adds to the running total (null: nothing); rows of weight 0 are not bounded by it. ``at`` is the
    event time in milliseconds. Rows may arrive in any order, up to ``delay_ms`` behind the newest; a key is
    complete once the watermark is ``idle_ms`` past its newest row. Rows of a key at equal places keep their
    order of arrival. The session's state store is to be RocksDB (:data:`STORE`).
    """
    shaped = rows.withColumns({_WEIGHT: F.coalesce(weight.cast("long"), F.lit(0)), _AT: F.col(at).cast("long")})
    trimmed = shaped.mapInArrow(_trimmed(keys, order, limit), shaped.schema)
    # A stream begins with its watermark at 0, and what is not newer is late: time 0 itself counts as 1.
    timed = trimmed.withColumn("_time", F.timestamp_millis(F.col(_AT) + 1)).withWatermark("_time", f"{delay_ms} milliseconds")
    processor = OrderedPrefix(timed.schema, order, limit, idle_ms)
    kept = timed.groupBy(*keys).transformWithState(processor, timed.schema, "append", "eventTime")
    return kept.drop(_WEIGHT, _AT, "_time")


def first_frames(frames: DataFrame, limit: int = fv.MAX_FRAMES, at: str = "at", delay_ms: int = HOUR_MS, idle_ms: int = HOUR_MS) -> DataFrame:
    """The first frames of every connection, on a stream."""
    return first_rows(frames, ["scan_id", "conn_seq"], ["frame_seq"], F.lit(1), limit, at, delay_ms, idle_ms)


def budgeted_bodies(
    payloads: DataFrame,
    at: str,
    max_chars: int = fv.MAX_BODY_CHARS,
    total_chars: int = fv.TOTAL_BODY_CHARS,
    delay_ms: int = HOUR_MS,
    idle_ms: int = HOUR_MS,
) -> DataFrame:
    """The payloads of a stream that fit the budget of their scan, cut to the limit of one payload.

    The batch rule of :func:`callsight.operators.caps.body_budget`: what it drops has no row here.
    """
    cut = payloads.withColumns({"truncated": F.length("body") > max_chars, "body": F.left("body", F.lit(max_chars)), "part": F.col("part").cast("long")})
    return first_rows(cut, ["scan_id"], ["call_seq", "part"], F.length("body"), total_chars, at, delay_ms, idle_ms)
