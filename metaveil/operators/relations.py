"""Joins, set operations and windows that scans, copies and reports share, over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def looked_up(rows: DataFrame, table: DataFrame, key: str, required: bool = False) -> DataFrame:
    """rows with the columns of a small table: unknown keys are dropped (required) or get nulls."""
    return rows.join(F.broadcast(table), key, "inner" if required else "left")


def kept(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pieces whose kind is in the table of kinds."""
    return pieces.join(F.broadcast(kinds), "kind", "left_semi")


def removed(pieces: DataFrame, kinds: DataFrame) -> DataFrame:
    return pieces.join(F.broadcast(kinds), "kind", "left_anti")


def offsets(pieces: DataFrame, first: int = 0) -> DataFrame:
    """pieces (file_id, idx, size) with begins, the sum of the sizes before, is_last and next_begins (0 behind the last)."""
    order = Window.partitionBy("file_id").orderBy("idx")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("begins", F.coalesce(before, F.lit(0)) + first)
    return placed.withColumn("is_last", F.lead("idx").over(order).isNull()).withColumn("next_begins", F.coalesce(F.lead("begins").over(order), F.lit(0)))


def joined_bytes(pieces: DataFrame) -> DataFrame:
    """file_id, content: the bytes of each file's pieces (idx, bytes) in their order; a file is bounded by its format's size."""
    parts = pieces.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "bytes"))).alias("parts"))
    digits = F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")  # bytes can't be joined, and one by one they would be copied again and again
    return parts.select("file_id", F.unhex(digits).alias("content"))


def first_match(rows: DataFrame, condition: Column, value: str, order: str) -> DataFrame:
    """file_id, first: the value of each file's first row that meets the condition."""
    return rows.where(condition).groupBy("file_id").agg(F.min_by(value, order).alias("first"))


def largest(images: DataFrame) -> DataFrame:
    """file_id, width, height of the image with the largest area, the first of equal ones; images: file_id, pos, width, height."""
    best = F.max_by(F.struct("width", "height"), F.struct(F.col("width").cast("bigint") * F.col("height"), -F.col("pos")))
    return images.groupBy("file_id").agg(best.alias("best")).select("file_id", "best.*")


def too_large(images: DataFrame, most: int = 40_000_000) -> DataFrame:
    """file_id, status: malformed without dimensions, resource-limit beyond that many pixels, else ok."""
    pixels = F.col("width").cast("bigint") * F.col("height")
    return images.select("file_id", F.when(pixels.isNull() | (pixels <= 0), "malformed").when(pixels > most, "resource-limit").otherwise("ok").alias("status"))


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """Dimensions as shown: orientations 5 to 8 swap them."""
    swap = orientation.between(5, 8)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def decimal_degrees(direction: Column, degrees: Column, minutes: Column, seconds: Column) -> Column:
    """Rounded to four places, halves upwards; null without a direction."""
    value = degrees + minutes / 60 + seconds / 3600
    value = F.when(direction.isin("S", "W"), -value).otherwise(value)
    return F.when(direction != "", F.floor(value * 10_000 + 0.5) / 10_000)


def some_of(rows: DataFrame, condition: Column) -> DataFrame:
    """file_id, told: how many of a file's rows meet the condition, as "k of n"; files without any are left out."""
    counted = rows.groupBy("file_id").agg(F.count_if(condition).alias("k"), F.count("*").alias("n")).where("k > 0")
    return counted.select("file_id", F.concat_ws(" of ", "k", "n").alias("told"))


def distinct_in_order(rows: DataFrame, value: str, placeholder: str = "Anonymous") -> DataFrame:
    """file_id, values: distinct values in order of their first place, without the placeholder, comma-joined."""
    firsts = rows.where((F.col(value) != placeholder) & (F.trim(value) != "")).groupBy("file_id", value).agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("value"))))
    return firsts.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["value"]), ", ").alias("values"))


def unknown(seen: Column, known: Column) -> Column:
    """What is seen and not known, once each, in order."""
    return F.array_except(seen, known)


def same_geometry(a: Column, b: Column, tolerance: float = 0.5) -> Column:
    """Whether two lists of pages (width, height) agree one by one within a tolerance."""
    near = F.zip_with(a, b, lambda x, y: (F.abs(x["width"] - y["width"]) <= tolerance) & (F.abs(x["height"] - y["height"]) <= tolerance))
    return (F.size(a) == F.size(b)) & F.coalesce(F.forall(near, lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def messages(codes: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, pos, message: codes by their text, unknown ones as they are, blank ones dropped. texts: code, message."""
    found = codes.join(F.broadcast(texts), "code", "left").select("file_id", "pos", F.coalesce("message", "code").alias("message"))
    return found.where(F.trim("message") != "")


def localised(keys: DataFrame, texts: DataFrame, locale: str, fallbacks: tuple[str, ...] = ("uk", "en")) -> DataFrame:
    """key, value: in the locale, or else the first fallback that has one. texts: locale, key, value."""
    order = [locale, *fallbacks]
    wanted = texts.where(F.col("locale").isin(*order)).groupBy("key").pivot("locale", list(dict.fromkeys(order))).agg(F.first("value"))
    return keys.join(F.broadcast(wanted), "key", "left").select("key", F.coalesce(*[F.col(f"`{o}`") for o in dict.fromkeys(order)]).alias("value"))


def resolved(risks: Column, code: str, new: Column) -> Column:
    """The list of risks without the one that was dealt with, and with new ones, each once."""
    return F.array_distinct(F.concat(F.filter(risks, lambda r: r != code), new))


def last_operation(responses: DataFrame) -> DataFrame:
    """job, response: of each job the response of its latest request; earlier ones are ignored. responses: job, request, response."""
    return responses.groupBy("job").agg(F.max_by("response", F.struct("request", "response")).alias("response"))


def outermost(spans: DataFrame) -> DataFrame:
    """spans (file_id, start, stop) that lie within no earlier one; spans may be nested, but don't overlap otherwise."""
    before = Window.partitionBy("file_id").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("stop").over(before)).where("reach IS NULL OR start >= reach").drop("reach")


def all_hold(checks: DataFrame) -> DataFrame:
    """file_id, passed: whether every check of a file holds. checks: file_id, name, holds."""
    return checks.groupBy("file_id").agg(F.bool_and(F.coalesce("holds", F.lit(False))).alias("passed"))


def entry_states(entries: DataFrame) -> DataFrame:
    """file_id, verified, failed, unchanged: how many entries of each state an archive has. entries: file_id, supported, passed."""
    return entries.groupBy("file_id").agg(
        F.count_if(F.col("supported") & F.col("passed")).alias("verified"), F.count_if(F.col("supported") & ~F.col("passed")).alias("failed"), F.count_if(~F.col("supported")).alias("unchanged")
    )


def flat_values(rows: DataFrame, least: int = 3) -> DataFrame:
    """file_id, value: the single values of lists (values) that are long enough to search for, once each."""
    return rows.select("file_id", F.explode("values").alias("value")).where(F.length(F.trim("value")) >= least).distinct()
