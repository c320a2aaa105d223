"""File digests and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALGORITHMS = {"sha256": 256, "sha512": 512}
MANIFEST_FILE = "integrity.json"


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of every file below a folder: (file, content); a manifest at its top is left out.

    ``file`` is the path below the folder, so files called alike in two folders stay apart. Spark's
    readers do not list files and folders whose names begin with ``_`` or ``.``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    whole = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    below = F.substr("path", F.lit(len(whole.rstrip("/")) + 2))
    return files.select(below.alias("file"), "content").where(F.col("file") != MANIFEST_FILE)


def file_digests(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Lower-case hexadecimal digest per file."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown checksum algorithm {algorithm!r}; valid: {', '.join(ALGORITHMS)}")
    return files.select("file", F.sha2("content", ALGORITHMS[algorithm]).alias("digest"))


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Every file of the manifest with its status: ``ok``, ``mismatch`` or ``missing``. Other files are ignored."""
    actual = digests.select("file", F.col("digest").alias("actual"))
    status = (
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.lower("digest") != F.col("actual"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return manifest.join(actual, "file", "left").select("file", status.alias("status"))
