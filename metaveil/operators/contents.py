"""What the entries of archives and packages hold: each is told, scanned, cleaned and scanned again by its own format, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.functions.bytes import utf8
from metaveil.operators import archive, binary, leaks, mail, svg
from metaveil.operators.svg import let
from metaveil.sources.archives import entries
from metaveil.sources.tables import written

#: Extensions of images, of which packages are searched, and of documents within archives.
IMAGES = ("png", "jpg", "jpeg", "webp", "tif", "tiff", "gif", "bmp")
OFFICE = ("docx", "xlsx", "pptx")
#: Kinds of image that are told by their content.
IMAGE_FORMATS = ("png", "jpeg", "webp", "tiff", "gif", "bmp")
#: Formats of which there are copies.
CLEANED = (*binary.FORMATS, "svg", "eml")
OUTCOME = "struct<clean:binary,found:bigint,raw:array<string>,passed:boolean>"


def nested_format(path: Column, content: Column) -> Column:
    """What an entry of an archive is: zip, office (an archive with the name of a document), another format, or null (kept as it is)."""
    kind = formats.detect(content)
    return F.when(kind == "zip", F.when(archive.extension(path).isin(*OFFICE), "office").otherwise("zip")).when(~kind.isin("heic", "docx"), kind)


def image_format(path: Column, content: Column, folder: str) -> Column:
    """What an image of a package is, told by its content; unreadable if that is none; null for other entries. folder: a pattern of paths."""
    kind = formats.detect(content)
    return F.when(path.rlike(folder) & archive.extension(path).isin(*IMAGES), F.when(kind.isin(*IMAGE_FORMATS), kind).otherwise("unreadable"))


def _outcome(clean: Column, before: Column, after: Column) -> Column:
    raw = F.filter(F.transform(before, lambda f: f["value"]), lambda v: v.isNotNull())
    return F.struct(clean.alias("clean"), F.size(before).cast("bigint").alias("found"), raw.alias("raw"), F.coalesce(clean.isNotNull() & (F.size(after) == 0), F.lit(False)).alias("passed"))


def _image_text(content: Column) -> Column:
    def told(text: Column, before: Column) -> Column:
        clean = F.when(svg.blocked(text).isNull(), svg.cleaned(text))
        return let(clean, lambda c: _outcome(F.encode(c, "UTF-8"), before, svg.findings(c)))

    return let(utf8(content), lambda text: let(svg.findings(text), lambda before: told(text, before)))


def _mail(content: Column) -> Column:
    def told(parsed: Column) -> Column:
        clean = F.encode(mail.cleaned(parsed), "UTF-8")
        return let(clean, lambda c: _outcome(c, mail.findings(parsed), mail.findings(mail.parse(c))))

    return let(mail.parse(content), told)


def told(files: DataFrame, format_: Column, name: str = "parts", searched: bool = False) -> DataFrame:
    """A written table of the entries of files, with their format (format_ looks at path and content).

    searched: with leaks (those values of the column raw that stand in an entry) in place of raw, told in the same pass.
    """
    rows = entries(files)
    rows = leaks.search(rows).drop("raw") if searched else rows
    return written(rows.withColumn("format", format_), name)


def opened(rows: DataFrame) -> DataFrame:
    """rows of a written table (format, content and others) with clean (the copy, or null), found (traces), raw (their values) and passed (what holds of the copy).

    What is of no format has nothing to be found, no copy, and passes as it is; what is of a format without copies doesn't pass.
    The formats that occur are asked for first, a few names: only their rules are in the plan, each for its rows alone.
    """
    names = sorted(r[0] for r in rows.select("format").distinct().collect() if r[0] in CLEANED)
    plain = F.struct(
        F.lit(None).cast("binary").alias("clean"), F.lit(0).cast("bigint").alias("found"), F.array().cast("array<string>").alias("raw"), F.col("format").isNull().alias("passed"),
    )
    done = rows.where(~F.coalesce(F.col("format").isin(names), F.lit(False))).select("*", plain.alias("_o"))
    for name in names:
        own = rows.where(F.col("format") == name)
        if name in ("svg", "eml"):
            outcome = (_image_text if name == "svg" else _mail)(F.col("content")).cast(OUTCOME)
            done = done.union(own.select("*", F.explode(F.array(outcome)).alias("_o")))  # a generator: what stands behind it isn't computed again
        else:
            packed = own.select(F.struct(*rows.columns).alias("_entry"), "content")  # no names of theirs clash
            checked = binary.clean_and_verify(packed, name, gated=False)
            done = done.union(checked.select("_entry.*", F.struct("clean", F.coalesce("found_before", F.lit(0)).alias("found"), "raw", "passed").alias("_o")))
    return done.select(*rows.columns, "_o.*")
