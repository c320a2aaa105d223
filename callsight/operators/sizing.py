"""Reusing small results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from callsight.session import checkpoint_folder


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregated result once, so several branches can read it.

    The table goes to the shared checkpoint folder: it survives lost executors, ends the lineage,
    and has a known size, from which Spark decides whether a join broadcasts or shuffles it.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
