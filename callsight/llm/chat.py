"""Chat formatting by perspective rotation.

Every participant of a dialogue is the assistant once: its turns carry the loss mask, the other
speakers appear as named users. A rendering stays cut into its turns, each with its place in the whole,
so the length of a dialogue does not matter; joined by turn order, the segments are the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import settle, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Speakers that set the scene and are nobody's perspective.
CONTEXT = ("system",)
#: Turns whose lengths are added up in one window.
RUN = 1024


def rotated(conversations: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """One row per dialogue, participant and turn: the segment, its place, and its mask.

    ``conversations`` holds conv_id, turn, role, text. Returned are conv_id, perspective, turn, at (rank of
    the row in the dialogue, from 0), speaker, segment, start (characters before it in the rendering),
    mask_start and mask_end (the characters to learn, end mark included; equal if none).

    A null role is the speaker "unknown", a null text is empty, rows without conv_id are one dialogue
    together. Turns are ordered by turn (nulls first), then role and text; repeated rows are turns of
    their own. A dialogue of context alone has no perspective and no rows. A marker inside a text or a
    speaker's name is written with a blank after ``<``, and a line break of a name as a blank, so neither
    can open or close a turn.
    """
    rows = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|im_", "< |im_").alias("said"),
        F.col("role").isNotNull().alias("__named"),
        F.col("text").isNotNull().alias("__spoken"),
    )
    rows = settle(_ranked(rows))
    voices = rows.where(~F.col("speaker").isin(*context)).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    mine, scene = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*context)
    shown = F.regexp_replace(F.regexp_replace("speaker", r"<\|im_", "< |im_"), r"[\r\n]", " ")
    head = F.when(mine, F.lit("assistant")).when(scene, shown).otherwise(F.concat(F.lit("user name="), shown))
    voices = voices.withColumnRenamed("conv_id", "__conv")
    each = rows.join(voices, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    each = each.withColumn("__head", F.concat(F.lit(OPEN), head, F.lit("\n"))).withColumn(
        "segment", F.concat("__head", "said", F.lit(CLOSE))
    )
    placed = _running(each, F.length("segment").cast("long"))
    begin = F.col("start") + F.length("__head")
    return placed.select(
        "conv_id",
        "perspective",
        "turn",
        "at",
        "speaker",
        "segment",
        "start",
        F.when(mine, begin).otherwise(F.col("start")).cast("long").alias("mask_start"),
        F.when(mine, F.col("start") + F.length("segment")).otherwise(F.col("start")).cast("long").alias("mask_end"),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    """``at``, the rank of a row in its dialogue: by runs of turns, so that a long dialogue is spread."""
    rows = rows.withColumn("__run", F.floor(F.col("turn") / RUN))
    sizes = rows.groupBy("conv_id", "__run").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("conv_id").alias("__c"), F.col("__run").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy("conv_id", "__run").orderBy("turn", "__named", "speaker", "__spoken", "said")
    return (
        rows.withColumn("__at", F.row_number().over(inside) - 1)
        .join(sizes, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("__run").eqNullSafe(F.col("__r")))
        .select("conv_id", "turn", "speaker", "said", (F.col("__base") + F.col("__at")).cast("long").alias("at"))
    )


def _running(rows: DataFrame, size: Column) -> DataFrame:
    """``start``: the sizes before a row of its rendering, added up by runs."""
    rows = rows.withColumn("__size", size).withColumn("__run", F.floor(F.col("at") / RUN))
    sums = rows.groupBy("conv_id", "perspective", "__run").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("__run").alias("__r"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"),
    )
    inside = Window.partitionBy("conv_id", "perspective", "__run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
        .join(
            sums,
            F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("__run") == F.col("__r")),
        )
        .withColumn("start", (F.col("__base") + F.col("__before")).cast("long"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))
