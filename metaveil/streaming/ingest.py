"""New files scanned as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metaveil.functions import formats


def stream(spark: SparkSession, path: str, largest: int = 100 * formats.MIB) -> DataFrame:
    """path, length, format, status of files that come into a folder; those that are too large are told by their length."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).load(path)
    small = found.where(F.col("length") <= largest)
    large = found.where(F.col("length") > largest).withColumn("content", F.lit(None).cast("binary"))  # their bytes aren't read
    detected = small.union(large).withColumn("format", formats.detect(F.col("content")))
    return detected.select("path", "modificationTime", "length", "format", formats.gate(F.col("format"), F.col("length")).alias("status"))


def start(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    return stream(spark, path).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
