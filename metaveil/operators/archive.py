"""Gates over the entries of archives (file_id, entry_pos, path, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_BYTES, MOST_RATIO = 10_000, 250 * 1024 * 1024, 200


def _parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def leaves_folder(path: Column) -> Column:
    normal = F.replace(path, F.lit("\\"), F.lit("/"))
    return normal.rlike("(?i)^[a-z]:/") | F.startswith(normal, F.lit("/")) | F.array_contains(_parts(path), "..")


def canonical(path: Column) -> Column:
    """The path without empty and dot parts, or null if it is absolute or leaves the archive's folder."""
    return F.when(~leaves_folder(path), F.array_join(F.filter(_parts(path), lambda p: (p != "") & (p != ".")), "/"))


def extension(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.element_at(F.split(base, r"\."), -1))).otherwise("")


def over_limits(n: Column, size: Column, length: Column) -> Column:
    """The limit that an archive of n entries and so many bytes unpacked and packed is over, or null."""
    return F.when(n > MOST_ENTRIES, "too-many-entries").when(size > MOST_BYTES, "too-large").when((length > 0) & (size / length > MOST_RATIO), "zip-bomb")


def gates(entries: DataFrame) -> DataFrame:
    """file_id, reason: the first reason to refuse an archive (null: none). entries: file_id, file_length, entry_pos, path, size.

    Traversal and duplicates come first, by entry, then too many entries, too many bytes, and bytes against the archive's own.
    """
    own = Window.partitionBy("file_id", F.lower("path_in")).orderBy("entry_pos")
    marked = entries.withColumn("path_in", canonical(F.col("path"))).withColumn("again", F.row_number().over(own) > 1)
    problem = F.when(F.col("path_in").isNull(), "path-traversal").when(F.col("again"), "duplicate-path")
    total = marked.groupBy("file_id").agg(
        F.min_by(problem, F.when(problem.isNotNull(), F.col("entry_pos"))).alias("by_entry"), F.count("*").alias("n"), F.sum("size").alias("size"), F.max("file_length").alias("length")
    )
    return total.select("file_id", F.coalesce("by_entry", over_limits(F.col("n"), F.col("size"), F.col("length"))).alias("reason"))
