"""Files as rows, and cleaned copies as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.functions import formats


def read(spark: SparkSession, path: str, pattern: str = "*", largest: int = 100 * formats.MIB) -> DataFrame:
    """file_id, path, file_name, length, format, status, content. Files that are too large are told by their length, without being read; Spark's reader leaves out empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = found.where(F.col("length") <= largest).select("path", "length", "content")
    large = found.where(F.col("length") > largest).select("path", "length", F.lit(None).cast("binary").alias("content"))  # their bytes aren't read
    rows = small.union(large).select(F.sha2("path", 256).alias("file_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")
    rows = rows.withColumn("format", formats.detect(F.col("content")))
    return rows.withColumn("status", formats.gate(F.col("format"), F.col("length")))


def write_copies(copies: DataFrame, path: str) -> None:
    """Cleaned copies with their digest, as Parquet."""
    copies.withColumn("clean_sha256", F.sha2(F.col("clean").cast("binary"), 256)).write.mode("overwrite").parquet(path)
