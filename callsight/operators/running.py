"""Running aggregates over long ordered histories.

A plain window would sort a whole history in one task. These functions cut it
into buckets of the order column, aggregate the buckets, carry the aggregate of
the earlier buckets forward, and finish inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight.operators.sizing import settle

BUCKET = 65_536
#: The bucket of what was counted before a table begins.
_BEFORE = -(1 << 62)


def _inside(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, "_bucket").orderBy(*order)


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, Column]],
    width: int = BUCKET,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates per key, including the current row.

    ``measures`` maps an output column to ``("sum" | "max", expression)``. The first
    column of ``order`` is an integer; ``width`` of its values share a bucket.
    ``start`` (the keys and the measures) holds what earlier rows amounted to.
    """
    combine = {"sum": F.sum, "max": F.max}
    named = df.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width)))
    # Summed before the shuffle, and from the few columns that are needed.
    totals = named.groupBy(*keys, "_bucket").agg(
        *[combine[how](expression).alias(f"_all_{name}") for name, (how, expression) in measures.items()]
    )
    if start is not None:
        before = [F.col(name).alias(f"_all_{name}") for name in measures]
        totals = totals.unionByName(start.select(*keys, F.lit(_BEFORE).cast("bigint").alias("_bucket"), *before))
    carried = totals.select(
        *keys,
        "_bucket",
        *[combine[how](f"_all_{name}").over(_earlier(keys)).alias(f"_carry_{name}") for name, (how, _) in measures.items()],
    )
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = named.join(carried, [*keys, "_bucket"])
    for name, (how, expression) in measures.items():
        here, carry = combine[how](expression).over(upto), F.col(f"_carry_{name}")
        joined = here + F.coalesce(carry, F.lit(0)) if how == "sum" else F.greatest(here, carry)
        out = out.withColumn(name, joined)
    return out.drop("_bucket", *[f"_carry_{name}" for name in measures])


def bucket_totals(
    df: DataFrame, keys: list[str], order: str, measures: dict[str, tuple[str, Column]], width: int = BUCKET, start: DataFrame | None = None
) -> DataFrame:
    """Per key and bucket of ``order``: its greatest ``order`` (``_until``), its sums, and the sums of the earlier buckets.

    The first half of :func:`with_running`, for those who need few of its rows. All measures are sums.
    """
    totals = df.groupBy(*keys, F.floor(F.col(order) / F.lit(width)).alias("_bucket")).agg(
        F.max(order).alias("_until"), *[F.sum(expression).alias(f"_all_{name}") for name, (_, expression) in measures.items()]
    )
    if start is not None:
        before = [F.col(name).alias(f"_all_{name}") for name in measures]
        first = [F.lit(_BEFORE).cast("bigint").alias("_bucket"), F.lit(None).cast("bigint").alias("_until")]
        totals = totals.unionByName(start.select(*keys, *first, *before))
    carried = {f"_carry_{name}": F.coalesce(F.sum(f"_all_{name}").over(_earlier(keys)), F.lit(0)) for name in measures}
    known = F.col("_bucket") != _BEFORE
    for key in keys:
        known &= F.col(key).isNotNull()
    return totals.withColumns(carried).where(known)


def running_in(df: DataFrame, buckets: DataFrame, keys: list[str], order: list[str], measures: dict[str, tuple[str, Column]], width: int = BUCKET) -> DataFrame:
    """The rows of the given buckets (see :func:`bucket_totals`) with the running sums of the whole history."""
    carries = [f"_carry_{name}" for name in measures]
    out = df.withColumn("_bucket", F.floor(F.col(order[0]) / F.lit(width))).join(buckets.select(*keys, "_bucket", *carries), [*keys, "_bucket"])
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.sum(expression).over(upto) + F.col(f"_carry_{name}") for name, (_, expression) in measures.items()}
    return out.withColumns(sums).drop("_bucket", *carries)


def with_pace(df: DataFrame, keys: list[str], at: str, tie: str, step: int, width: int = BUCKET) -> DataFrame:
    """Add, per key in the order of ``at`` and ``tie``: ``previous_at``, and ``paced_at`` at steps of ``step`` or more.

    The i-th row is paced at ``i * step + max(t_j - j * step)`` over the rows up to it. A bucket passes on its
    number of rows and its greatest ``t_j - j * step``, counted from its own first row; after C earlier rows the
    latter is less by ``C * step``. Both are associative, so all measures take one pass: the rows are read and
    shuffled once, and settled with what holds inside their bucket; totals and results come from there.
    """
    inside = _inside(keys, [at, tie])
    rows = df.withColumn("_bucket", F.floor(F.col(at) / F.lit(width))).withColumn("_i", F.row_number().over(inside).cast("bigint"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"_slack": F.max(F.col(at) - F.col("_i") * step).over(upto), "_before": F.lag(at).over(inside)}
    )
    rows = settle(rows)
    totals = rows.groupBy(*keys, "_bucket").agg(
        F.max("_i").alias("_n"), F.max("_slack").alias("_most"), F.max(at).alias("_latest")
    )
    counted = totals.withColumn("_count", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)))
    carried = counted.select(
        *keys,
        "_bucket",
        "_count",
        F.max(F.col("_most") - F.col("_count") * step).over(_earlier(keys)).alias("_carry"),
        F.max("_latest").over(_earlier(keys)).alias("_last"),
    )
    slack = F.greatest(F.col("_slack") - F.col("_count") * step, F.col("_carry"))
    return (
        rows.join(carried, [*keys, "_bucket"])
        .withColumns(
            {
                "previous_at": F.coalesce("_before", "_last"),
                "paced_at": (F.col("_count") + F.col("_i")) * step + slack,
            }
        )
        .drop("_bucket", "_i", "_slack", "_before", "_count", "_carry", "_last")
    )
