"""Photographs of the HEIF family: whether they may be looked into, and what their container tells. They have no copies: no decoder is at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.functions.bytes import number
from metaveil.operators.binary import MOST_PIXELS, found
from metaveil.operators.svg import FINDING, let
from metaveil.sources.pieces import with_pieces

#: Brands of sequences, boxes of metadata with their names, names of colour profiles, and orientations by quarter turns.
MOVING = ("msf1", "heics", "heifs", "avis")
CONTAINERS = {"Exif": "EXIF", "mime": "MIME metadata", "xml ": "XML/XMP metadata", "uri ": "URI metadata"}
PROFILES = {"nclx": "NCLX colour profile", "rICC": "ICC colour profile", "prof": "ICC colour profile"}
TURNS = (1, 6, 3, 8)


def _has(pieces: Column, *kinds: str) -> Column:
    return F.exists(pieces, lambda p: p["kind"].isin(*kinds))


def _size(pieces: Column) -> Column:
    """width and height of the largest image, the first of equal ones; null if none states both."""
    stated = F.filter(pieces, lambda p: (p["kind"] == "ispe") & (p["stop"] - p["body"] >= 12) & (number(p["head"], 4, 4) > 0) & (number(p["head"], 8, 4) > 0))
    sized = F.transform(stated, lambda p, i: F.struct((-number(p["head"], 4, 4).cast("double") * number(p["head"], 8, 4)).alias("area"), i.alias("i"), number(p["head"], 4, 4).alias("width"), number(p["head"], 8, 4).alias("height")))
    return let(F.try_element_at(F.array_sort(sized), F.lit(1)), lambda s: F.when(s.isNotNull(), F.struct(s["width"].alias("width"), s["height"].alias("height"))))


def _containers(pieces: Column) -> Column:
    """Names of metadata and profiles, each once, in their order."""

    def name(p: Column) -> Column:
        told = F.lit(None).cast("string")
        for kind, label in CONTAINERS.items():
            told = F.when(p["kind"] == kind, label).otherwise(told)
        profile = F.lit("Colour profile")
        for kind, label in PROFILES.items():
            profile = F.when(F.substring(p["head"], 1, 4) == F.lit(kind).cast("binary"), label).otherwise(profile)
        return F.when((p["kind"] == "colr") & (p["stop"] - p["body"] >= 4), profile).otherwise(told)

    return F.array_distinct(F.filter(F.transform(pieces, name), lambda n: n.isNotNull()))


def _orientation(pieces: Column) -> Column:
    """What the tags state, else the last quarter turns of the container; null if neither does."""
    tags = F.try_element_at(F.filter(pieces, lambda p: p["depth"] == 99), F.lit(1))["kind"]
    turn = F.try_element_at(F.filter(pieces, lambda p: (p["kind"] == "irot") & (p["stop"] > p["body"])), F.lit(-1))
    turned = F.try_element_at(F.array(*map(F.lit, TURNS)), (number(turn["head"], 0, 1).bitwiseAND(F.lit(3)) + 1).cast("int"))
    return F.coalesce(F.substring(tags, 13, 9).try_cast("int"), turned)


def preflight(files: DataFrame) -> DataFrame:
    """files (content and others) with reason (null: it may be looked into), width, height, images, containers, alpha, orientation, output.

    The gates stand in the order in which they are asked: bytes, brands, motion, main image, depth, auxiliary images, several
    images, size, pixels.
    """
    rows = with_pieces(files, "heic")
    pieces, content = F.col("pieces"), F.col("content")
    rows = rows.withColumn("size", _size(pieces)).withColumn("images", F.size(F.filter(pieces, lambda p: p["kind"] == "infe")))
    brands = F.filter(formats.brands(content), lambda b: b.rlike(r"^[\x20-\x7e]{4}$"))
    pixels = F.col("size.width").cast("double") * F.col("size.height")
    reason = (
        F.when(F.length(content) > 50 * formats.MIB, "too-large").when(F.coalesce(F.size(brands), F.lit(0)) == 0, "malformed")
        .when(F.arrays_overlap(brands, F.array(*map(F.lit, MOVING))), "animation").when(~_has(pieces, "pitm"), "no-primary-image").when(_has(pieces, "dimg"), "depth-map")
        .when(_has(pieces, "auxC", "auxl"), "auxiliary-image").when(F.col("images") > 1, "too-many-images").when(F.col("size").isNull(), "malformed").when(pixels > MOST_PIXELS, "resource-limit")
    )
    alpha = _has(pieces, "pixi")
    return rows.select(
        *files.columns, reason.alias("reason"), F.col("size.width").alias("width"), F.col("size.height").alias("height"), F.greatest("images", F.lit(1)).alias("images"), _containers(pieces).alias("containers"),
        alpha.alias("alpha"), _orientation(pieces).alias("orientation"), F.when(alpha, "png").otherwise("jpeg").alias("output"),
    )


def scan(files: DataFrame) -> DataFrame:
    """preflight with findings; none for files that are refused."""
    none = F.array().cast(f"array<{FINDING}>")
    one = lambda test, finding: F.when(test, F.array(finding)).otherwise(none)
    told = F.concat(
        one(F.size("containers") > 0, found("containers", "HEIC:MetadataContainer", "HEIC metadata container", F.array_join("containers", ", "), "high")),
        one((F.col("orientation") != 1) & (F.col("orientation") != 0), found("other", "HEIC:Orientation", "Image orientation", F.format_string("Value %d", "orientation"), "medium")),
        one(F.exists("containers", lambda c: c.rlike("(?i)ICC|colour|color|NCLX")), found("other", "HEIC:ColourProfile", "HEIC colour profile", "Present", "low")),
    )
    return preflight(files).withColumn("findings", F.when(F.col("reason").isNull(), told).otherwise(none))
