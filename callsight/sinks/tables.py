"""Writers: report tables, documents, snapshots, signals, payloads, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight.operators.manifest import file_digests, read_artifacts


def write_report(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One folder per table, partitioned by scan where the table has one."""
    for name, rows in tables.items():
        writer = rows.write.mode(mode)
        if "scan_id" in rows.columns:
            writer = writer.partitionBy("scan_id")
        writer.parquet(f"{path}/{name}")


def write_json_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table as JSON lines, one document per row, partitioned by scan."""
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "scan_id"]))
    rows.select("scan_id", body.alias("value")).write.mode(mode).partitionBy("scan_id").text(path)


def write_fragments(fragments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ordered text fragments (``scan_id, part, at, text``); a scan's files in name order form its document."""
    ordered = fragments.repartitionByRange("scan_id", "part", "at").sortWithinPartitions("scan_id", "part", "at")
    ordered.select("scan_id", F.col("text").alias("value")).write.mode(mode).partitionBy("scan_id").text(path)


def write_signals(signals: DataFrame, path: str, mode: str = "overwrite") -> None:
    signals.write.mode(mode).partitionBy("scan_id").json(path)


def write_snapshot(tables: dict[str, DataFrame], path: str, snapshot_id: str) -> None:
    """Store the report tables under a snapshot id; other snapshots stay."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/snapshot_id={snapshot_id}")


def read_snapshot_tables(spark: SparkSession, path: str, names: list[str], snapshot_id: str = "latest") -> dict[str, DataFrame]:
    """The report tables of a stored snapshot; ``latest`` is the greatest id."""
    if snapshot_id == "latest":
        stored = spark.read.option("mergeSchema", "false").parquet(f"{path}/{names[0]}")
        snapshot_id = stored.agg(F.max(F.col("snapshot_id").cast("string"))).first()[0]
    return {name: spark.read.parquet(f"{path}/{name}/snapshot_id={snapshot_id}") for name in names}


def write_payloads(payloads: DataFrame, path: str, mode: str = "append") -> None:
    """The side table of oversized bodies; calls keep ``payload_key``."""
    payloads.write.mode(mode).partitionBy("scan_id").parquet(path)


def write_manifest(spark: SparkSession, folder: str, path: str, algorithm: str = "sha256") -> None:
    """Digests of every file below a folder. Keep ``path`` outside of it: a manifest never covers itself."""
    file_digests(read_artifacts(spark, folder), algorithm).orderBy("file").write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file STRING, digest STRING").json(path)
