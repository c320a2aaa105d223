"""Exact nearest-rank percentiles that never bring a whole group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.operators.sizing import settle

PERCENTILES = {"p50": 0.5, "p95": 0.95}


def _magnitude_bin(value: Column) -> Column:
    """A bin that grows with the value: its bit length and its ten leading bits.

    There are at most 64 x 1024 bins on either side of zero. A bin of values below 2^31
    spans at most 2^20 of them, so both steps below sort bounded groups.
    """
    size = F.abs(value)
    bits = F.length(F.bin(size))
    leading = F.call_function("shiftright", size, F.greatest(bits - 11, F.lit(0)))
    return F.signum(value).cast("bigint") * (bits.cast("bigint") * 4096 + leading)


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, percentiles: dict[str, float] | None = None
) -> DataFrame:
    """One row per key: the value at rank ``ceil(p * n)`` for every percentile, and the maximum.

    Values are first counted per (key, value). Bin totals then tell which bin holds each
    rank, and only the counted values of that bin are ranked. A key that holds a third of
    all rows is therefore spread over its values, and no group is collected. The counts are used
    twice, so they are settled; the input is read once.
    """
    percentiles = percentiles or PERCENTILES
    counted = settle(
        df.groupBy(*keys, F.col(value).cast("bigint").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_value").isNotNull())
        .withColumn("_bin", _magnitude_bin(F.col("_value")))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bin_n"), F.max("_value").alias("_max"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.ceil(F.lit(float(p)) * F.col("_total")).alias("rank"))
            for name, p in percentiles.items()
        ]
    )
    wanted = (
        bins.select(
            *keys,
            "_bin",
            (F.sum("_bin_n").over(upto) - F.col("_bin_n")).alias("_before"),
            "_bin_n",
            F.sum("_bin_n").over(per_key).alias("_total"),
            F.max("_max").over(per_key).alias("_top"),
        )
        .withColumn(
            "_ranks",
            F.filter(ranks, lambda r: (r["rank"] > F.col("_before")) & (r["rank"] <= F.col("_before") + F.col("_bin_n"))),
        )
        .where(F.size("_ranks") > 0)
    )
    within = (
        Window.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = (
        counted.join(wanted, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(within) + F.col("_before"))
        .withColumn(
            "_ranks",
            F.filter("_ranks", lambda r: (r["rank"] > F.col("_upto") - F.col("_n")) & (r["rank"] <= F.col("_upto"))),
        )
        .where(F.size("_ranks") > 0)
    )
    hit = lambda name: F.exists("_ranks", lambda r: r["name"] == name)
    return reached.groupBy(*keys).agg(
        *[F.max(F.when(hit(name), F.col("_value"))).alias(name) for name in percentiles],
        F.max("_top").alias("max"),
    )
