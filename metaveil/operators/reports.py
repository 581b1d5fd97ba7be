"""What is told of a scan or a cleaned copy: sizes, words, risks, and the record of a certificate, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.formats import first_match

#: Formats told of as documents, and how some formats are called.
DOCUMENTS = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "odg", "epub", "rtf", "eml")
NAMES = {"jpeg": "JPEG", "png": "PNG", "webp": "WebP", "heic": "HEIC / HEIF"}
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "odg")


def file_size(n: Column) -> Column:
    mib = F.format_string("%.1f MB", n / F.lit(1024.0 * 1024))
    return F.when(n >= 1 << 20, mib).when(n >= 1024, F.format_string("%d KB", F.greatest(F.lit(1), F.floor(n / 1024 + 0.5)).cast("bigint"))).otherwise(F.format_string("%d B", n.cast("bigint")))


def format_name(format_id: Column) -> Column:
    return F.coalesce(first_match({name: format_id == k for k, name in NAMES.items()}), F.upper(format_id))


def plural(n: Column) -> Column:
    """one, few or many, as Slavic languages count."""
    tens, hundreds = n % 10, n % 100
    return F.when((tens == 1) & (hundreds != 11), "one").when(tens.between(2, 4) & ~hundreds.between(12, 14), "few").otherwise("many")


def risk(format_id: Column) -> Column:
    """Which text sums up the risk of a format."""
    return F.when(format_id.isin("zip", "heic", "pdf"), format_id).when(format_id.isin(*DOCUMENTS), "office").otherwise("image")


def support(format_id: Column, unsupported: Column) -> Column:
    return F.when((format_id == "zip") & (unsupported > 0), "partially-supported").otherwise("supported")


def limitations(format_id: Column, unsupported: Column) -> Column:
    items = F.array(
        F.lit("base"), F.when((format_id == "zip") & (unsupported > 0), "zip"), F.when(format_id == "heic", "heic"), F.when(format_id.isin(*OFFICE), "office")
    )
    return F.filter(items, lambda x: x.isNotNull())


def before_after(scans: DataFrame) -> DataFrame:
    """file_id, before, after of scans (file_id, format, found, files, supported, unsupported, remaining)."""
    zipped = F.col("format") == "zip"
    before = F.when(zipped, F.array(F.format_string("%d files", "files"), F.format_string("%d traces", "found"))).otherwise(F.array(F.format_string("%d traces", "found")))
    after = F.when(zipped, F.array(F.format_string("%d cleaned", "supported"), F.format_string("%d unchanged", "unsupported"))).otherwise(F.array(F.format_string("%d remaining", "remaining")))
    return scans.select("file_id", F.array_join(before, " | ").alias("before"), F.array_join(after, " | ").alias("after"))


def certificates(verified: DataFrame) -> DataFrame:
    """A record for each copy, of counts, flags and its digest only, never of values.

    verified: file_id, format, clean_sha256, found_before, remaining, passed, icc_description.
    """
    return verified.select(
        "file_id", format_name(F.col("format")).alias("file_type"), F.col("found_before").alias("metadata_found"),
        F.greatest(F.lit(0), F.col("found_before") - F.col("remaining")).alias("metadata_removed"), F.col("remaining").alias("metadata_remaining"),
        F.col("passed").alias("verification_passed"), F.when(~F.col("format").isin("pdf", "heic") & (F.col("icc_description") != ""), F.col("icc_description")).alias("colour_profile"),
        F.col("clean_sha256").alias("clean_hash"), F.concat(F.substring("clean_sha256", 1, 16), F.lit("…")).alias("short_hash"),
    )


def interpolated(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {key} replaced that has a value."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{" + key + "}"), value.cast("string"))
    return template


def language_tag(locale: Column) -> Column:
    return F.when(locale == "hy", "hy-AM").otherwise(locale)
