"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.operators.sizing import settle

__all__ = ["column", "connected", "groups", "settle", "shuffle_width", "small", "table"]

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(settled: DataFrame, rows: int) -> DataFrame:
    """Mark a settled table for broadcast if it was counted and has ``rows`` rows or fewer; beyond, Spark shuffles."""
    return F.broadcast(settled) if settled.count() <= rows else settled


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over arrays: well spread, the same on every machine."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64(0x9E3779B97F4A7C15) * U64(salt + 1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream of rows sorted by ``keys`` into one table for each key.

    Only the key at hand is held: callers bound the rows of a key beforehand. Keys are never null.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, dtype=bool) if batch.num_rows > 1 else np.zeros(0, dtype=bool)
        for key in keys:
            values = column(batch, key)
            if batch.num_rows > 1:
                changed |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:]):
            key = tuple(column(batch, name)[begin].as_py() for name in keys) if begin == 0 else None
            if begin == 0 and key == last or not held:
                pass
            else:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
        last = tuple(column(batch, name)[batch.num_rows - 1].as_py() for name in keys)
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges`` (two longs, no nulls).

    Alternates large and small stars until nothing moves: each round every node points its
    neighbours at the least it knows, so the rounds grow with the logarithm of a component, and
    no component is gathered in one place. Every round is written to the shared folder.
    """
    current = settle(
        edges.select(F.greatest(left, right).alias("v"), F.least(left, right).alias("u")).where("u < v").distinct()
    )
    before = None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select("v", F.col("m").alias("u")).where("u < v").distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        met = large.join(lower, "v")
        star = met.select("v", F.col("m").alias("u")).union(met.select(F.col("u").alias("v"), F.col("m").alias("u")))
        current = settle(star.where("u < v").distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    joined = current.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return settle(joined.union(current.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))
