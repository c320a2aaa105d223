"""Readers and normalisers of the capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight import schemas
from callsight.functions.text import json_container  # noqa: F401  (re-exported for readers)
from callsight.functions.urls import normalize_url, url_parts


def _read(spark: SparkSession, path: str | list[str], schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def read_calls(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Recorded calls, normalised by :func:`normalize_calls`."""
    return normalize_calls(_read(spark, path, schemas.CALLS, fmt))


def normalize_calls(calls: DataFrame) -> DataFrame:
    """Upper-case method, normalised URLs, MIME type without its parameters."""
    parsed = calls.withColumn("_url", url_parts("url")).withColumn("_page", url_parts("triggered_by"))
    return parsed.withColumns(
        {
            "method": F.upper("method"),
            "url": normalize_url("url", F.col("_url")),
            "mime_type": F.trim(F.substring_index(F.coalesce("mime_type", F.lit("")), ";", 1)),
            "status": F.coalesce("status", F.lit(0)),
            "triggered_by": F.coalesce(normalize_url("triggered_by", F.col("_page")), F.lit("")),
        }
    ).drop("_url", "_page")


def read_failed_calls(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Calls that never got a response, shaped like ``calls``."""
    return failed_calls(_read(spark, path, schemas.FAILED_CALLS, fmt))


def failed_calls(failures: DataFrame) -> DataFrame:
    """Status 0, no MIME type, no bodies; the triggering page is kept as recorded."""
    no_text = F.lit(None).cast("string")
    return failures.select(
        "scan_id",
        "call_seq",
        F.upper("method").alias("method"),
        normalize_url("url").alias("url"),
        F.lit(0).alias("status"),
        F.lit("").alias("mime_type"),
        "resource_type",
        "request_headers",
        no_text.alias("request_body"),
        F.create_map().cast("map<string,string>").alias("response_headers"),
        no_text.alias("response_body"),
        F.lit(False).alias("response_body_truncated"),
        no_text.alias("request_body_file"),
        no_text.alias("response_body_file"),
        "started_at",
        "duration_ms",
        "triggered_by",
    )


def read_frames(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Recorded socket frames; see :func:`frames_from_raw`."""
    return frames_from_raw(_read(spark, path, schemas.RAW_FRAMES, fmt))


def frames_from_raw(raw: DataFrame) -> DataFrame:
    """Text frames keep their text, binary ones are base64; the size counts the original bytes."""
    is_text = F.col("text").isNotNull()
    return raw.select(
        "scan_id",
        "conn_seq",
        "frame_seq",
        "direction",
        F.when(is_text, F.lit("text")).otherwise(F.lit("binary")).alias("type"),
        F.when(is_text, F.col("text")).otherwise(F.base64("data")).alias("payload"),
        F.when(is_text, F.octet_length("text")).otherwise(F.octet_length("data")).cast("bigint").alias("size"),
        F.lit(False).alias("truncated"),
        "at",
    )


def read_sockets(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, schemas.SOCKETS, fmt).withColumn("url", normalize_url("url"))


def read_pages(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    pages = _read(spark, path, schemas.PAGES, fmt)
    return pages.withColumn("normalized_url", F.coalesce("normalized_url", normalize_url("url")))


def read_page_evidence(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    return with_scripts(_read(spark, path, schemas.PAGE_EVIDENCE, fmt))


def with_scripts(evidence: DataFrame) -> DataFrame:
    """Script URLs are read from the page where the capture did not list them."""
    found = F.regexp_extract_all("html", F.lit(fv.SCRIPT_SRC), F.lit(1))
    return evidence.withColumn("scripts", F.coalesce("scripts", found))


def gated_response_body(body: Column, mime: Column, content_length: Column, limit: int) -> Column:
    """Response text is kept for JSON answers whose declared length is within the limit."""
    declared = F.coalesce(content_length.try_cast("double"), F.lit(0.0))
    return F.when(mime.contains("json") & (declared <= limit), body)


def api_only(calls: DataFrame) -> DataFrame:
    return calls.where(F.col("resource_type").isin("xhr", "fetch"))
