"""The same operators on live streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callsight.operators.endpoints import KEY
from callsight.operators.selection import PERCENTILES


def live_endpoints(keyed: DataFrame) -> DataFrame:
    """Running endpoint list: calls, failures, first and last position per endpoint.

    All state is a few numbers per endpoint; see :func:`live_latency` for its percentiles.
    """
    return keyed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("status") == 0).alias("failed"),
        F.count_if(F.col("status") >= 400).alias("errors"),
        F.min("call_seq").alias("first_seq"),
        F.max("call_seq").alias("last_seq"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def start_batches(
    rows: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True
) -> StreamingQuery:
    """Keep the rows of every micro-batch in ``path``; a repeated batch replaces itself.

    ``checkpoint`` holds offsets and state, so a restarted query goes on where it stopped.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _folders(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    """Number and path of the finished folders ``name=number`` below a path, in order."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in files.listStatus(root) if files.exists(root) else []:
        folder = status.getPath()
        if folder.getName().startswith(f"{name}=") and files.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append((int(folder.getName().split("=")[1]), folder.toString()))
    return sorted(found)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What a stream has written: the newest compacted table, if any, and the batches after it."""
    bases = _folders(spark, path, "base")
    upto = bases[-1][0] if bases else -1
    parts = [folder for _, folder in bases[-1:]] + [folder for batch, folder in _folders(spark, path, "batch") if batch > upto]
    if not parts:
        raise FileNotFoundError(f"no finished batch below {path}")
    return spark.read.parquet(*parts)


def compact_batches(spark: SparkSession, path: str, latest: Callable[[DataFrame], DataFrame], keep: int = 0) -> None:
    """Put all batches but the newest ``keep`` into one table, as ``latest`` sums them up, and remove what it replaces.

    The table is finished before anything is removed, and readers skip what it covers, so a failure in
    between leaves a readable folder, and the next call removes the rest.
    """
    batches = _folders(spark, path, "batch")
    done = batches[: len(batches) - keep]
    bases = _folders(spark, path, "base")
    if done and (not bases or done[-1][0] > bases[-1][0]):
        upto = bases[-1][0] if bases else -1
        parts = [folder for _, folder in bases[-1:]] + [folder for batch, folder in done if batch > upto]
        latest(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{path}/base={done[-1][0]}")
        bases = _folders(spark, path, "base")
    if not bases:
        return
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for number, folder in [*bases[:-1], *batches]:
        if (number, folder) in bases[:-1] or number <= bases[-1][0]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def latest_endpoints(rows: DataFrame) -> DataFrame:
    """Latest state per endpoint. Every measure but ``first_seq`` only grows, so the maximum is the latest."""
    return rows.groupBy(*KEY).agg(
        *[F.max(name).alias(name) for name in ("count", "failed", "errors", "last_seq", "duration_ms")],
        F.min("first_seq").alias("first_seq"),
    )


def read_live_endpoints(spark: SparkSession, path: str) -> DataFrame:
    return latest_endpoints(read_batches(spark, path))


# --- latency -------------------------------------------------------------------

#: Leading binary digits that a live percentile keeps: it is off by 1/256 of its value at most.
DIGITS = 8


def _bits(value: Column) -> Column:
    return F.length(F.bin(value))


def _width(low: Column) -> Column:
    """How many values share a bin, from its lowest value."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(_bits(low) - DIGITS, F.lit(0)))


def latency_bin(value: Column) -> Column:
    """The lowest of the values that share a bin: those of as many binary digits whose leading ones agree."""
    at_least = F.greatest(value.cast("bigint"), F.lit(0).cast("bigint"))
    shift = F.greatest(_bits(at_least) - DIGITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", at_least, shift), shift)


def live_latency(keyed: DataFrame) -> DataFrame:
    """Calls per endpoint and bin of duration: a sketch of every endpoint whose parts add up.

    State is a number per bin, 64 x 128 bins of an endpoint at most, however many calls it has.
    """
    timed = keyed.where(F.col("duration_ms").isNotNull())
    return timed.groupBy(*KEY, latency_bin(F.col("duration_ms")).alias("low")).agg(
        F.count(F.lit(1)).alias("n"), F.max("duration_ms").alias("top")
    )


def latest_latency(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "low").agg(F.max("n").alias("n"), F.max("top").alias("top"))


def latency_percentiles(bins: DataFrame, percentiles: dict[str, float] | None = None) -> DataFrame:
    """Per endpoint the middle of the bin that holds each percentile's nearest rank, and the exact maximum.

    A value of d binary digits lies in a bin of 2^(d - 8) values, so the middle is off by 1/256 of it at most;
    values below 256 are exact.
    """
    upto = Window.partitionBy(*KEY).orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*KEY))})
    middle = F.col("low") + F.floor(_width(F.col("low")) / 2)
    found = [
        F.min(F.when(F.col("_upto") >= F.ceil(F.lit(float(p)) * F.col("_all")), middle)).alias(name)
        for name, p in (percentiles or PERCENTILES).items()
    ]
    return ranked.groupBy(*KEY).agg(*found, F.max("top").alias("max"))


PAIRED, UNANSWERED, LATE = "paired", "unanswered", "late"


def paired_calls(requests: DataFrame, responses: DataFrame, wait_ms: int = 3_600_000, delay_ms: int = 3_600_000) -> DataFrame:
    """Every request and every response of two streams, with what became of it (``outcome``).

    ``requests`` has ``request_id, requested_at``, ``responses`` has ``request_id, answered_at``, besides columns
    of their own. A response that comes within ``wait_ms`` of its request makes a ``paired`` row of both.
    A request that has none by then is given out as ``unanswered``, a response that no request waited for as
    ``late``; both wait in state until the watermark, ``delay_ms`` behind the newest row of either side, decides.
    """
    delay = f"{delay_ms} milliseconds"
    asked = requests.withWatermark("requested_at", delay)
    answered = responses.withWatermark("answered_at", delay).withColumnRenamed("request_id", "_id")
    matched = (
        (F.col("request_id") == F.col("_id"))
        & F.col("request_id").isNotNull()  # the join's state takes null keys for equal
        & (F.col("answered_at") >= F.col("requested_at"))
        & (F.col("answered_at") <= F.col("requested_at") + F.expr(f"make_dt_interval(0, 0, 0, {wait_ms / 1000})"))
    )
    outcome = (
        F.when(F.col("answered_at").isNull(), F.lit(UNANSWERED)).when(F.col("requested_at").isNull(), F.lit(LATE)).otherwise(F.lit(PAIRED))
    )
    joined = asked.join(answered, matched, "full_outer").withColumn("outcome", outcome)
    return joined.withColumn("request_id", F.coalesce("request_id", "_id")).drop("_id")


def start_pairs(pairs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the pairs below ``path/pairs`` and all that found no partner below ``path/unpaired``, batch by batch."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        held.where(F.col("outcome") == PAIRED).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")
        held.where(F.col("outcome") != PAIRED).write.mode("overwrite").parquet(f"{path}/unpaired/batch={batch_id}")
        held.unpersist()

    writer = pairs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(keep)
    return writer.trigger(availableNow=True).start()


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows by outcome so far. Requests in = paired + unanswered + those still waiting; responses likewise with ``late``."""
    tables = [spark.read.parquet(f"{path}/{name}").select("outcome") for name in ("pairs", "unpaired")]
    return tables[0].union(tables[1]).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


def progress_lines(snapshot: DataFrame, event: str = "progress") -> DataFrame:
    """One JSON text per row of a progress snapshot."""
    return snapshot.select(
        F.to_json(F.struct(F.lit(event).alias("event"), *snapshot.columns)).alias("value")
    )


def progress_snapshot(keyed: DataFrame) -> DataFrame:
    """Calls and distinct endpoints per scan so far (batch, or inside ``foreachBatch``)."""
    per_endpoint = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_endpoint.groupBy("scan_id").agg(F.sum("n").alias("calls"), F.count(F.lit(1)).alias("endpoints"))
