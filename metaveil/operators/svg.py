"""Vector images as text: gate, findings, cleaned copy and its verification, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.formats import first_match

#: Active content in the order in which it is reported.
ACTIVE = (
    ("script", r"(?i)<script\b"),
    ("event-handlers", r"(?i)\bon[a-z]+\s*="),
    ("javascript-link", r"(?i)javascript:"),
    ("foreign-object", r"(?i)<foreignObject\b"),
    ("dtd-entities", r"(?i)<!ENTITY"),
    ("external-links", r"(?i)\b(?:href|src)\s*=\s*[\"'](?:https?|file|ftp):"),
    ("external-styles", r"(?i)url\(\s*[\"']?(?:https?|file|ftp):"),
    ("style-import", r"(?i)@import"),
)
#: What a cleaned copy loses, in this order.
REMOVED = (
    r"(?s)<!--.*?-->",
    r"(?is)<!DOCTYPE.*?>",
    r"(?is)<metadata\b.*?</metadata>",
    r"(?i)<metadata\b[^>]*/>",
    r"(?is)<title\b.*?</title>",
    r"(?is)<desc\b.*?</desc>",
    r"(?is)<sodipodi:[\w-]+\b.*?(?:/>|</sodipodi:[\w-]+>)",
    r"(?is)<inkscape:[\w-]+\b.*?(?:/>|</inkscape:[\w-]+>)",
    r"(?i)\s+(?:inkscape|sodipodi|dc|cc|rdf):[\w-]+\s*=\s*\"[^\"]*\"",
    r"(?i)\s+(?:inkscape|sodipodi|dc|cc|rdf):[\w-]+\s*=\s*'[^']*'",
    r"(?i)\s+xmlns:(?:inkscape|sodipodi|dc|cc|rdf)\s*=\s*[\"'][^\"']*[\"']",
)
FINDING = "struct<category:string,field:string,label:string,value:string,severity:string>"


def blocked(text: Column) -> Column:
    """The first kind of active content, or null."""
    return first_match({label: text.rlike(pattern) for label, pattern in ACTIVE})


def is_svg(text: Column) -> Column:
    return F.substring(text, 1, 4096).rlike(r"(?i)<svg[\s>]")


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def element(text: Column, tag: str) -> Column:
    """The text of the first such element of up to 300 characters, or null."""
    return _filled(F.regexp_replace(F.regexp_extract(text, f"(?is)<{tag}[^>]*>(.{{0,300}}?)</{tag}>", 1), "<[^>]+>", ""))


def finding(category: str, field: str, label: Column, value: Column, severity: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(field).alias("field"), label.alias("label"), value.cast("string").alias("value"), F.lit(severity).alias("severity"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def findings(text: Column) -> Column:
    """An array of findings, in the order of the rules; empty if the text is no image."""
    told = let(text, lambda t: let(F.regexp_extract_all(t, F.lit("(?s)<!--.*?-->"), 0), lambda c: let(element(t, "title"), lambda title: let(element(t, "desc"), lambda desc: _told(t, c, title, desc)))))
    return F.when(is_svg(text), told).otherwise(F.array().cast(f"array<{FINDING}>"))


def dimensions(text: Column) -> Column:
    """width and height by the view box, or else by the attributes; null if there are none."""
    tag = F.regexp_extract(text, r"(?i)<svg\b[^>]*>", 0)
    box = r"(?i)viewBox\s*=\s*[\"']\s*[\d.-]+[\s,]+[\d.-]+[\s,]+([\d.]+)[\s,]+([\d.]+)"

    def sized(width: Column, height: Column) -> Column:
        w, h = (F.floor(F.try_to_number(F.regexp_extract(x, r"^\d*\.?\d*", 0), F.lit("9999999999.9999999999")).cast("double") + 0.5).cast("bigint") for x in (width, height))
        return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))

    by_box = sized(F.regexp_extract(tag, box, 1), F.regexp_extract(tag, box, 2))
    return F.coalesce(by_box, sized(F.regexp_extract(tag, r"(?i)\bwidth\s*=\s*[\"']([\d.]+)", 1), F.regexp_extract(tag, r"(?i)\bheight\s*=\s*[\"']([\d.]+)", 1)))


def _told(text: Column, comments: Column, title: Column, desc: Column) -> Column:
    first = _filled(F.substring(F.trim(F.regexp_replace(F.element_at(comments, 1), "^<!--|-->$", "")), 1, 180))
    creator = _filled(F.regexp_replace(F.regexp_extract(text, r"(?is)<dc:creator>.*?<dc:title>|<dc:creator[^>]*>(.{0,200}?)</dc:creator>", 1), "<[^>]+>", ""))
    rules = [
        (F.size(comments) > 0, finding("other", "SVG:Comments", F.format_string("XML comments (%d)", F.size(comments)), F.when(F.size(comments) > 0, first), "medium")),
        (text.rlike(r"(?i)<metadata\b"), finding("containers", "SVG:Metadata", F.lit("Metadata element (RDF/Dublin Core)"), creator, "high")),
    ]
    for space in ("inkscape", "sodipodi"):
        n = F.regexp_count(text, F.lit(rf"(?i)\b{space}:[\w-]+"))
        rules.append((n > 0, finding("software", f"SVG:Editor:{space}", F.lit(f"Editor metadata ({space})"), n, "medium")))
    for value, field, label in ((title, "SVG:Title", "Title"), (desc, "SVG:Desc", "Description")):
        rules.append((value.isNotNull(), finding("other", field, F.lit(label), value, "medium")))
    rules.append((text.rlike("(?i)<!DOCTYPE"), finding("other", "SVG:Doctype", F.lit("DOCTYPE declaration"), F.lit("Present"), "low")))
    found = F.array(*[F.when(condition, value) for condition, value in rules])
    return F.filter(found, lambda f: f.isNotNull())


def cleaned(text: Column) -> Column:
    for pattern in REMOVED:
        text = F.regexp_replace(text, pattern, "")
    return text


def scan(files: DataFrame) -> DataFrame:
    """files (file_id, text) with status (ok, error), reason and findings."""
    told = let(F.col("text"), lambda t: let(F.when(is_svg(t), blocked(t)), lambda r: F.struct(t.alias("text"), r.alias("reason"), F.when(r.isNull(), findings(t)).alias("findings"))))
    rows = files.select("file_id", F.explode(F.array(told)).alias("told"))  # a generator: what stands behind it isn't computed again
    return rows.select("file_id", "told.text", F.when(F.col("told.reason").isNull(), "ok").otherwise("error").alias("status"), "told.reason", "told.findings")


def clean_and_verify(files: DataFrame) -> DataFrame:
    """file_id, status, clean, found_before, remaining, passed: the copy is scanned anew, and nothing of the cleaner is trusted."""
    scanned = scan(files)
    ok = (F.col("status") == "ok") & is_svg(F.col("text"))
    copies = scanned.withColumn("clean", F.when(ok, cleaned(F.col("text")))).withColumn("again", findings(F.col("clean")))
    whole = F.col("clean").rlike(r"(?i)<svg[\s>]") & F.col("clean").rlike("(?i)</svg>")
    return copies.select(
        "file_id",
        F.when(F.col("clean").isNull(), "error").otherwise("ok").alias("status"),
        "clean",
        F.size("findings").cast("bigint").alias("found_before"),
        F.when(F.col("clean").isNotNull(), F.size("again").cast("bigint")).alias("remaining"),
        F.coalesce((F.size("again") == 0) & whole, F.lit(False)).alias("passed"),
    )
