"""Resources: endpoints grouped by collection root, with the verbs they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.urls import collection_root, has_param, is_item


def group_resources(endpoints: DataFrame) -> DataFrame:
    """One row per scan, resource and path: observed verbs, and missing ones where an item path exists."""
    rooted = endpoints.withColumn("resource", collection_root("url_pattern"))
    crud = rooted.groupBy("scan_id", "resource").agg(
        F.bool_or(has_param("url_pattern")).alias("crud"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )
    paths = rooted.groupBy("scan_id", "resource", "url_pattern").agg(
        F.array_sort(F.collect_set(F.upper("method"))).alias("methods")
    )
    literal = lambda verbs: F.array(*[F.lit(v) for v in verbs])
    expected = F.when(is_item("url_pattern"), literal(fv.ITEM_VERBS)).otherwise(literal(fv.COLLECTION_VERBS))
    missing = F.when(F.col("crud"), F.array_except(expected, "methods")).otherwise(F.array().cast("array<string>"))
    return paths.join(crud, ["scan_id", "resource"]).select(
        "scan_id",
        "resource",
        "categories",
        F.col("url_pattern").alias("path"),
        "methods",
        missing.alias("missing_methods"),
    )


def resource_of(endpoints: DataFrame, resources: DataFrame) -> DataFrame:
    """Endpoints with the resource their path belongs to, ``Other endpoints`` when none does."""
    lookup = resources.select("scan_id", F.col("path").alias("url_pattern"), "resource").distinct()
    return endpoints.join(lookup, ["scan_id", "url_pattern"], "left").withColumn(
        "resource", F.coalesce("resource", F.lit("Other endpoints"))
    )
