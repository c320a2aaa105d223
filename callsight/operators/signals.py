"""Anonymous categorisation signals, and the check that they carry nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.operators.endpoints import KEY


def signals(endpoints: DataFrame, values: DataFrame) -> DataFrame:
    """One row per endpoint: category, heuristic, method, and whether it answered JSON."""
    is_json = (
        values.where(F.col("kind") == "mime")
        .groupBy(*KEY)
        .agg(F.bool_or(F.lower("value").contains("json")).alias("json"))
    )
    return (
        endpoints.join(is_json, KEY, "left")
        .select("scan_id", "category", "heuristic", "method", F.coalesce("json", F.lit(False)).alias("json"))
        .orderBy("scan_id", "category", "heuristic", "method")
    )


def schema_violations(payload: DataFrame, allowed: list[str] | None = None) -> list[str]:
    """Columns of a signal table that widen its boundary: unexpected or nested ones."""
    allowed = allowed or ["scan_id", *fv.SIGNAL_FIELDS]
    unexpected = [f'unexpected field "{f.name}"' for f in payload.schema if f.name not in allowed]
    nested = [
        f"{f.name}: must be a scalar, not a nested value"
        for f in payload.schema
        if f.dataType.typeName() in ("array", "map", "struct", "variant")
    ]
    return unexpected + nested


def payload_violations(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per way a JSON payload widens the boundary: its id columns and ``problem``."""
    ids = [c for c in payloads.columns if c != payload]
    doc = payloads.withColumn("_v", F.try_parse_json(payload))
    kind = F.schema_of_variant("_v")
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    structural = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False))
    broken = doc.where(~is_object).select(*ids, F.lit("$: the payload must be a JSON object").alias("problem"))
    objects = doc.where(is_object)

    def field_problems(entries: Column, path: Column, known: list[str], exempt: str | None) -> Column:
        unexpected = F.transform(
            F.filter(entries, lambda e: ~e["key"].isin(known)),
            lambda e: F.concat(path, F.lit(': unexpected field "'), e["key"], F.lit('"')),
        )
        nested = F.transform(
            F.filter(entries, lambda e: structural(e["value"]) & (e["key"] != F.lit(exempt or ""))),
            lambda e: F.concat(path, F.lit("."), e["key"], F.lit(": must be a scalar, not a nested value")),
        )
        return F.concat(unexpected, nested)

    fields = F.map_entries(F.col("_v").cast("map<string,variant>"))
    top = objects.select(*ids, F.explode(field_problems(fields, F.lit("$"), fv.SIGNAL_PAYLOAD_FIELDS, "signals")).alias("problem"))
    listed = F.try_variant_get("_v", "$.signals", "variant")
    is_list = F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False))
    missing = objects.where(~is_list).select(*ids, F.lit("$.signals: must be an array").alias("problem"))
    items = (
        objects.where(is_list)
        .withColumn("_list", listed)
        .select(*ids, F.posexplode(F.col("_list").cast("array<variant>")).alias("_i", "_s"))
        .withColumn("_path", F.concat(F.lit("$.signals["), F.col("_i").cast("string"), F.lit("]")))
    )
    item_is_object = F.coalesce(F.schema_of_variant("_s").startswith("OBJECT"), F.lit(False))
    scalars = items.where(~item_is_object).select(*ids, F.concat("_path", F.lit(": must be an object")).alias("problem"))
    inner_fields = F.map_entries(F.col("_s").cast("map<string,variant>"))
    inner = items.where(item_is_object).select(
        *ids, F.explode(field_problems(inner_fields, F.col("_path"), fv.SIGNAL_FIELDS, None)).alias("problem")
    )
    return broken.unionByName(top).unionByName(missing).unionByName(scalars).unionByName(inner)
