"""A corpus pipeline: documents are judged, cleaned, thinned of near copies and packed.

Each stage takes the documents its predecessor kept, written as Parquet and read again, so a lost
executor repeats at most one stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsight.llm import line_templates, near_duplicates, packing, quality, rules
from callsight.llm.common import settle, table

STAGES = [
    ("quality_classifier", quality.stage),
    ("quality_rules", rules.stage),
    ("line_templates", line_templates.stage),
    ("near_duplicates", near_duplicates.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the classifier nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
