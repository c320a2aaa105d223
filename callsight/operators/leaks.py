"""Looking for masked originals that survived somewhere in the output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.operators.sizing import settle

#: Sizes of an aligned block. Where a secret of 2b - 1 characters or more stands, it covers a whole block of b.
BLOCKS = (3, 6, 12)
#: Characters of a segment of a text; a multiple of every block.
SEGMENT = 12 * 4096


def _block_for(length: Column) -> Column:
    sizes = [F.when(length >= 2 * size - 1, F.lit(size)) for size in sorted(BLOCKS, reverse=True)]
    return F.coalesce(*sizes)


def block_index(secrets: DataFrame) -> DataFrame:
    """``block, gram, shift, length``: the gram that a secret shows in the first block it covers, for every shift.

    Of secrets that share a gram, only the lengths count, so a gram has few rows, however many secrets do.
    """
    sized = secrets.where(F.length("value") >= fv.LEDGER_MIN_LENGTH).withColumn("block", _block_for(F.length("value")))
    return (
        sized.select("value", "block", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("shift"))
        .select("block", F.xxhash64(F.substr("value", F.col("shift") + 1, F.col("block"))).alias("gram"), "shift", F.length("value").alias("length"))
        .distinct()
    )


def _segments(leaves: DataFrame, ids: list[str], text: str, beyond: int = 0) -> DataFrame:
    """``ids, segment, chunk``: a text in segments, each with ``beyond`` characters of what follows."""
    pattern = f"(?s)(?=(.{{1,{SEGMENT + beyond}}})).{{1,{SEGMENT}}}"  # one pass; counts code points
    return leaves.select(*ids, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("segment", "chunk"))


def text_blocks(leaves: DataFrame, ids: list[str], text: str, size: int) -> DataFrame:
    """``ids, begin, gram``: the aligned blocks of ``size`` characters, one row for as many characters of a text."""
    blocks = F.regexp_extract_all("chunk", F.lit(f"(?s).{{{size}}}"), F.lit(0))
    rows = _segments(leaves, ids, text).select(*ids, "segment", F.posexplode(blocks).alias("at", "gram"))
    begin = F.col("segment").cast("long") * SEGMENT + F.col("at") * size
    return rows.select(*ids, begin.alias("begin"), F.xxhash64("gram").alias("gram"))


def leaking_leaves(leaves: DataFrame, ids: list[str], text: str, secrets: DataFrame) -> DataFrame:
    """Ids of the leaves whose text contains any secret. ``secrets`` is a ledger (column ``value``).

    The same exact search for every ledger and text. A text gives one gram for each aligned block, not one for each
    character; a secret, wherever it stands, covers a block, and its ledger row lists the gram it shows there for
    every shift. Where a gram is known, the place and length of a secret that would show it follow; what
    stands there is looked up among the secrets by a semi join. No step pairs secrets with leaves, nothing
    is collected, and blocks of a size that no secret needs are not cut.
    """
    index = settle(block_index(secrets))
    longest = index.agg(F.max("length")).first()[0]
    if longest is None:
        return leaves.select(*ids).limit(0)
    places = None
    for row in index.select("block").distinct().orderBy("block").collect():  # as many as there are sizes
        size = row["block"]
        met = text_blocks(leaves, ids, text, size).join(index.where(F.col("block") == size).drop("block"), "gram")
        met = met.select(*ids, (F.col("begin") - F.col("shift")).alias("begin"), "length").where("begin >= 0")
        places = met if places is None else places.union(met)
    within = F.substr("chunk", (F.col("begin") % SEGMENT + 1).cast("int"), F.col("length"))
    placed = places.withColumn("segment", F.floor(F.col("begin") / SEGMENT).cast("int"))
    found = _segments(leaves, ids, text, longest - 1).join(placed, [*ids, "segment"]).select(*ids, within.alias("value"))
    return found.join(secrets.select("value"), "value", "left_semi").select(*ids).distinct()


def leak_summary(hits: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Number of leaking fields per key, and the first few paths. The secrets themselves are never shown."""
    first = Window.partitionBy(*keys).orderBy(path)
    shown = (
        hits.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= fv.LEAK_PATHS_SHOWN)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(path)).alias("paths"))
    )
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).join(shown, keys)
