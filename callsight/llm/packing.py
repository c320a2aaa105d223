"""Best-fit packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share a sequence. The program asks for the
fewest configurations that cover the histogram; multiplicative weights solve it: lengths weigh less
the better they are covered, and the configuration of the greatest weight is priced by dynamic
programming over a knapsack of one sequence. Multiplicities are rounded down, what is left is packed
by best fit, longest first.

Only the histogram (at most ``capacity`` numbers) and the plan built from it reach the driver.
Texts are encoded once, in the executors.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.bpe import END, coder
from callsight.llm.common import column, settle, shuffle_width, table

CAPACITY = 2048
ROUNDS = 500

Run = tuple[int, dict[int, int]]  # so many sequences, each with so many pieces of each length


def _priced(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration of the greatest total weight that fits."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = upto[room]
        if n:
            values = best[room - lengths[:n]] + weights[:n]
            at = int(values.argmax())
            best[room], last[room] = values[at], lengths[at]
    found: dict[int, int] = {}
    room = capacity
    while room and last[room]:
        found[int(last[room])] = found.get(int(last[room]), 0) + 1
        room -= int(last[room])
    return found


def _fractional(histogram: dict[int, int], capacity: int, rounds: int, step: float, rate: float) -> list[tuple[float, dict[int, int]]]:
    """Multiplicative weights: configurations and how often to use each, not yet whole numbers."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    wanted = np.array([histogram[n] for n in lengths.tolist()], dtype=np.float64)
    covered = np.zeros(len(lengths))
    place = {n: at for at, n in enumerate(lengths.tolist())}
    used: list[tuple[float, dict[int, int]]] = []
    for _ in range(rounds):
        open_ = covered < wanted - 0.5
        if not open_.any():
            break
        weights = lengths[open_] * np.exp(-rate * covered[open_] / wanted[open_])
        pattern = _priced(lengths[open_], weights, capacity)
        at = np.array([place[n] for n in pattern])
        count = np.array(list(pattern.values()), dtype=np.float64)
        left = (wanted[at] - covered[at]) / count
        size = max(1.0, step * left.min())
        if left.min() < 1:  # more pieces than there are: take what there is, once
            count = np.minimum(count, np.maximum(np.floor(wanted[at] - covered[at] + 0.5), 1))
            pattern = {n: int(c) for n, c in zip(pattern, count)}
            size = 1.0
        covered[at] += size * count
        used.append((size, pattern))
    return used


def _best_fit(left: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, longest first, equal sequences at once."""
    lengths = sorted(n for n, count in left.items() if count)
    runs: list[Run] = []
    while lengths:
        pattern: dict[int, int] = {}
        room = capacity
        while True:
            at = bisect_right(lengths, room) - 1
            while at >= 0 and left[lengths[at]] <= pattern.get(lengths[at], 0):
                at -= 1
            if at < 0:
                break
            length = lengths[at]
            count = min(room // length, left[length] - pattern.get(length, 0))
            pattern[length] = pattern.get(length, 0) + count
            room -= count * length
        times = min(left[n] // count for n, count in pattern.items())
        for n, count in pattern.items():
            left[n] -= times * count
        lengths = [n for n in lengths if left[n]]
        runs.append((times, pattern))
    return runs


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Run]:
    """Sequences that hold every piece of the histogram exactly once."""
    left = {n: count for n, count in histogram.items() if count}
    runs: list[Run] = []
    if left.get(capacity):
        runs.append((left.pop(capacity), {capacity: 1}))
    used = _fractional(left, capacity, rounds, step=0.5, rate=2.0) if left else []
    merged: dict[tuple, float] = {}
    for size, pattern in used:
        key = tuple(sorted(pattern.items()))
        merged[key] = merged.get(key, 0.0) + size
    fullest = sorted(merged, key=lambda key: (-sum(n * c for n, c in key), key))
    for key in fullest:
        times = min(int(merged[key]), *(left[n] // count for n, count in key))
        if times > 0 and sum(n * c for n, c in key) >= capacity * 0.995:
            for n, count in key:
                left[n] -= times * count
            runs.append((times, dict(key)))
    return runs + _best_fit(left, capacity)


def placements(runs: list[Run]) -> dict[int, np.ndarray]:
    """For each length rows (first ordinal, first sequence, pieces per sequence, offset), by first ordinal."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, pattern in runs:
        offset = 0
        for length, count in pattern.items():
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, count, offset))
            taken[length] = taken.get(length, 0) + times * count
            offset += length * count
        sequence += times
    return {length: np.array(found, dtype=np.int64) for length, found in rows.items()}


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every row; a null text is empty.

    Of a text longer than a sequence the first piece takes what full pieces leave over.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(path)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(column(batch, "text").to_pylist()):
                ids = np.append(encoder.encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (start, end) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(row)
                    out.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            piece, start, length, crc = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(values, pa.int64()) for values in (start, length, crc)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        encode, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def packed(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of all rows with ``sequence_id`` and ``offset``.

    Rows of any doc_id, null and repeated ones too, are packed each for itself. A length that most
    pieces share is numbered in hash buckets, so no length is gathered in one task.
    """
    spark = documents.sparkSession
    buckets = 4 * shuffle_width(spark)
    found = settle(
        pieces(documents, capacity, path).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
        )
    )
    counts = settle(found.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(placements(plan(histogram, capacity)))  # grows with capacity and rounds only
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    numbered = (
        found.withColumn("number", number)
        .join(begins, ["length", "bucket"])
        .withColumn("ordinal", F.col("begin") + F.col("number") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "ordinal")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length, ordinal = column(batch, "length").to_numpy(), column(batch, "ordinal").to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                rows = where[int(value)]
                run = rows[np.searchsorted(rows[:, 0], ordinal[at], side="right") - 1]
                step = ordinal[at] - run[:, 0]
                sequence[at] = run[:, 1] + step // run[:, 2]
                offset[at] = run[:, 3] + step % run[:, 2] * value
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packed(docs)
