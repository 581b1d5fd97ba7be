"""What a file is, told from its first bytes: one ordered CASE over binary content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.functions.bytes import number

MIB = 1024 * 1024
#: Id, largest size in MiB, extensions.
FORMATS = (
    ("jpeg", 50, "jpg jpeg"), ("png", 50, "png"), ("webp", 50, "webp"), ("tiff", 50, "tif tiff"), ("gif", 50, "gif"), ("bmp", 50, "bmp"),
    ("avif", 50, "avif"), ("heic", 50, "heic heif"), ("ico", 50, "ico"), ("svg", 50, "svg"), ("flac", 100, "flac"), ("ogg", 100, "ogg opus"),
    ("mkv", 100, "mkv webm"), ("avi", 100, "avi"), ("psd", 50, "psd"), ("rtf", 100, "rtf"), ("wav", 100, "wav"), ("mp4", 100, "mp4 mov m4a"),
    ("pdf", 100, "pdf"), ("zip", 100, "zip"), ("mp3", 100, "mp3"), ("eml", 100, "eml"), ("docx", 100, "docx"),
)
#: Major or compatible brands of the HEIF family, header sizes of bitmaps, and headers one of which a mail has.
HEIC_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1", "heif", "avif", "avis")
BMP_HEADERS = (12, 40, 52, 56, 108, 124)
MAIL_HEADERS = ("from", "to", "subject", "received", "return-path", "mime-version", "date")


def starts(content: Column, *hexes: str) -> Column:
    found = F.lit(False)
    for h in hexes:
        found = found | F.startswith(content, F.unhex(F.lit(h)))
    return found


def at(content: Column, offset: int, text: str) -> Column:
    return F.substring(content, offset + 1, len(text)) == F.lit(text).cast("binary")


def latin(content: Column, size: int) -> Column:
    """The first bytes as text, one character for each byte."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def first_match(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, or null: one flat CASE."""
    (name, rule), *others = rules.items()
    found = F.when(rule, F.lit(name))
    for name, rule in others:
        found = found.when(rule, F.lit(name))
    return found


def brands(content: Column) -> Column:
    """The major and compatible brands of an ISO base media file; none if its first box doesn't fit."""
    size = number(content, 0, 4)
    fits = (F.length(content) >= 16) & at(content, 4, "ftyp") & (size >= 16) & (size <= F.length(content))
    # a header of brands alone is short; more than 250 of them are of no use
    places = F.sequence(F.lit(12), F.least(size - 4, F.lit(1024)).cast("int"), F.lit(4))
    all_ = F.transform(places, lambda p: F.decode(F.substring(content, F.when(p == 12, 8).otherwise(p) + 1, F.lit(4)), "ISO-8859-1"))
    return F.when(fits, all_).otherwise(F.array().cast("array<string>"))


def _icon(content: Column) -> Column:
    """A directory of 1 to 64 images, the first of which lies within the file."""
    count, size, place = number(content, 4, 2, "little"), number(content, 14, 4, "little"), number(content, 18, 4, "little")
    directory = 6 + 16 * count
    return starts(content, "00000100", "00000200") & (F.length(content) >= 22) & count.between(1, 64) & (directory <= F.length(content)) & (size > 0) & (place >= directory) & (place + size <= F.length(content))


def detect(content: Column) -> Column:
    """The format id, or null: the first rule that holds."""
    head, long_head = latin(content, 1024), latin(content, 2048)
    plain, plain_mail = ~F.contains(head, F.lit("\0")), ~F.contains(long_head, F.lit("\0"))
    size = F.length(content)
    brand = F.decode(F.substring(content, 9, 4), "ISO-8859-1")
    dib = F.hex(F.substring(content, 15, 4)).isin([b.to_bytes(4, "little").hex().upper() for b in BMP_HEADERS])
    ftyp = at(content, 4, "ftyp") & (size >= 12)
    mail_lines = F.regexp_count(long_head, F.lit(r"(?m)^[!-9;-~]+:[ \t]"))
    known = long_head.rlike(rf"(?im)^({'|'.join(MAIL_HEADERS)}):")
    sync = number(content, 0, 3)
    audio = (
        (size >= 4)
        & (F.shiftright(sync, 13) == 0x7FF)
        & (F.shiftright(sync, 11).bitwiseAND(F.lit(3)) != 1)
        & (F.shiftright(sync, 9).bitwiseAND(F.lit(3)) != 0)
        & (~F.shiftright(sync, 4).bitwiseAND(F.lit(15)).isin(0, 15))
        & (F.shiftright(sync, 2).bitwiseAND(F.lit(3)) != 3)
    )
    rules = {
        "jpeg": starts(content, "FFD8FF"),
        "png": starts(content, "89504E470D0A1A0A"),
        "webp": at(content, 0, "RIFF") & at(content, 8, "WEBP"),
        "tiff": starts(content, "49492A00", "4D4D002A"),
        "gif": at(content, 0, "GIF87a") | at(content, 0, "GIF89a"),
        "bmp": at(content, 0, "BM") & (size >= 18) & dib,
        "avif": ftyp & brand.isin("avif", "avis"),
        "heic": ftyp & F.arrays_overlap(brands(content), F.array(*map(F.lit, HEIC_BRANDS))),
        "ico": _icon(content),
        "svg": plain & (head.rlike(r"(?i)<svg[\s>]") | (head.rlike(r"(?i)^\s*<\?xml") & F.contains(F.lower(head), F.lit("<svg")))),
        "flac": at(content, 0, "fLaC"),
        "ogg": at(content, 0, "OggS"),
        "mkv": starts(content, "1A45DFA3"),
        "avi": at(content, 0, "RIFF") & at(content, 8, "AVI "),
        "psd": at(content, 0, "8BPS"),
        "rtf": at(content, 0, "{\\rtf"),
        "wav": at(content, 0, "RIFF") & at(content, 8, "WAVE"),
        "mp4": ftyp,
        "pdf": at(content, 0, "%PDF-"),
        "zip": starts(content, "504B03", "504B05", "504B07"),
        "mp3": (size >= 4) & at(content, 0, "ID3") | audio,
        "eml": plain_mail & (mail_lines >= 3) & known,
        # a compound file: an old or encrypted office document, told apart by its stream names later
        "docx": starts(content, "D0CF11E0A1B11AE1"),
    }
    return first_match(rules)


def size_limit(format_id: Column) -> Column:
    """Bytes that a file of that format may have."""
    large = [name for name, mib, _ in FORMATS if mib == 100]
    return F.when(format_id.isin(large), 100 * MIB).otherwise(50 * MIB)


def gate(format_id: Column, length: Column) -> Column:
    """ok, too-large or unsupported-format."""
    unknown = F.when(length > 50 * MIB, "too-large").otherwise("unsupported-format")
    return F.when(length == 0, "unsupported-format").when(length > 100 * MIB, "too-large").when(format_id.isNull(), unknown).when(length > size_limit(format_id), "too-large").otherwise("ok")


def registry(spark: SparkSession) -> DataFrame:
    """id, priority, max_bytes, extensions of every format: the table that lookups join."""
    rows = [(name, k, mib * MIB, extensions.split()) for k, (name, mib, extensions) in enumerate(FORMATS)]
    return spark.createDataFrame(rows, "id string, priority int, max_bytes bigint, extensions array<string>")


def accepted_extensions(spark: SparkSession) -> DataFrame:
    """extension, id: what a file may be called."""
    return registry(spark).select(F.explode("extensions").alias("extension"), "id")
