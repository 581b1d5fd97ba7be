"""Findings, cleaned copies and their verification for binary formats, as column expressions over their pieces.

Each format is a Format: what a piece says (a finding or nothing), which pieces a copy keeps (the copy is cut from the content
at once, neighbours together) or which places it overwrites, and what must hold of a copy besides its having no findings.
Verification lists the pieces of the copy anew. Nothing is shuffled or joined: what was found before travels with the copy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.bytes import cp1252, cstring, little, number, stripped, utf8
from metaveil.operators.findings import TECHNICAL
from metaveil.operators.svg import FINDING, let
from metaveil.sources.pieces import BMP_EMBEDDED, LISTERS, with_pieces

Found = Callable[[Column], Column]


def found(category, name, label, value, severity) -> Column:
    columns = zip(("category", "field", "label", "value", "severity"), (category, name, label, value, severity))
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("string").alias(k) for k, c in columns])


def listed(table: dict[str, tuple[str, str, str]], key: Column) -> Column:
    """(label, category, severity) of a key, or null."""

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    # one text to parse is much quicker to make than a call for each literal
    rows = [f"{text(k)}, named_struct('label', {text(a)}, 'category', {text(b)}, 'severity', {text(c)})" for k, (a, b, c) in table.items()]
    return F.try_element_at(F.expr(f"map({', '.join(rows)})"), key)


def known(table: dict[str, tuple[str, str, str]], key: Column, prefix: str, otherwise: str, value: Column) -> Column:
    """The finding of a field with a label in the table, or a general one."""
    info = listed(table, key)
    label = F.coalesce(info["label"], F.format_string(f"{otherwise} (%s)", key))
    return found(F.coalesce(info["category"], F.lit("other")), F.concat(F.lit(prefix), key), label, value, F.coalesce(info["severity"], F.lit("medium")))


def size_of(p: Column) -> Column:
    return F.format_string("%d bytes", p["stop"] - p["body"])


def filled(text: Column) -> Column:
    return F.when(text != "", text)


# --- PNG
#: Chunks that a copy keeps, other chunks that are reported, and names of rendering intents.
PNG_KEPT = ("IHDR", "PLTE", "IDAT", "IEND", "iCCP", "sRGB", "gAMA", "cHRM", "tRNS", "pHYs")
PNG_OTHERS = ("vpAg", "offS", "pCAL", "sCAL", "gIFg", "gIFx", "sTER")
INTENTS = ("Perceptual", "Relative colorimetric", "Saturation", "Absolute colorimetric")
#: Parts of a keyword, in order, and the category they lead to.
KEYWORDS = (
    ("author", "author creator artist copyright owner"), ("dates", "date time create modif"),
    ("software", "software editor generator producer photoshop gimp"), ("device", "camera device model make"), ("geolocation", "location gps"),
)


def keyword_class(keyword: Column) -> Column:
    low, out = F.lower(keyword), F.lit("other")
    for category, words in reversed(KEYWORDS):
        out = F.when(low.rlike(words.replace(" ", "|")), category).otherwise(out)
    return out


def _png(p: Column) -> Column:
    kind, head = p["kind"], p["head"]
    # a PNG piece's tail is its checksum: it is no part of the text
    text = F.substring(head, F.lit(1), F.least(p["stop"] - p["body"] - 4, F.lit(1024)))
    plain = F.decode(text, "ISO-8859-1")
    at = F.instr(plain, "\0")
    keyword = F.when(at > 0, utf8(F.substring(text, F.lit(1), at - 1))).otherwise("")
    value = F.substring(utf8(F.substring(text, at + 1, F.lit(1024))), 1, 200)
    category = keyword_class(keyword)
    severity = F.when(category.isin("author", "dates"), "high").otherwise("medium")

    def text_finding(name: str, label: Column, value: Column | str) -> Column:
        return found(category, F.concat(F.lit(f"PNG:{name}:"), keyword), label, value, severity)

    def titled(otherwise: str) -> Column:
        return F.coalesce(filled(keyword), F.lit(otherwise))

    intent = number(head, 0, 1)
    parts = [number(head, k, 1) for k in range(2, 7)]
    stamp = F.format_string("%d-%02d-%02d %02d:%02d:%02d", number(head, 0, 2), *parts)
    return (
        F.when(kind == "iCCP", found("other", "PNG:iCCP", "ICC profile", titled("ICC profile"), "low"))
        .when(kind == "sRGB", found("other", "PNG:sRGB", "sRGB profile", F.coalesce(F.try_element_at(F.array(*map(F.lit, INTENTS)), intent.cast("int") + 1), F.format_string("Mode %d", intent)), "low"))
        .when((kind == "gAMA") & (p["stop"] - p["body"] >= 8), found("other", "PNG:gAMA", "Gamma", F.format_string("%.1f", number(head, 0, 4) / 100000), "low"))
        .when(kind == "cHRM", found("other", "PNG:cHRM", "Chromaticity (cHRM)", "Present", "low"))
        .when(kind == "eXIf", found("containers", "PNG:eXIf", "EXIF in PNG (eXIf)", F.format_string("%d bytes", p["stop"] - p["body"] - 4), "high"))
        .when(kind == "tEXt", text_finding("tEXt", titled("Text field"), value))
        .when(kind == "zTXt", text_finding("zTXt", F.concat(titled("Compressed text field"), F.lit(" (compressed)")), "[compressed data]"))
        .when(kind == "iTXt", text_finding("iTXt", titled("International text field"), value))
        .when((kind == "tIME") & (p["stop"] - p["body"] >= 11), found("dates", "PNG:tIME", "Last modification time", stamp, "high"))
        .when(kind.isin(*PNG_OTHERS), found("other", F.concat(F.lit("PNG:"), kind), F.concat(F.lit("Ancillary chunk "), kind), F.format_string("%d bytes", p["stop"] - p["body"] - 4), "low"))
    )


# --- WAV and AVI
#: Chunks that a copy keeps, and labels of list entries.
WAV_KEPT = ("fmt ", "data", "fact", "cue ", "smpl", "inst", "plst", "ds64")
INFO = {
    "IART": ("Artist", "author", "high"), "INAM": ("Title", "other", "medium"), "ICMT": ("Comment", "other", "medium"), "ISFT": ("Software", "software", "medium"),
    "ICRD": ("Creation date", "dates", "high"), "IENG": ("Engineer", "author", "high"), "ICOP": ("Copyright", "author", "medium"), "IGNR": ("Genre", "other", "low"),
    "ITCH": ("Technician", "author", "high"), "ISRC": ("Source", "other", "medium"),
}
WAV_INFO = INFO | {"IPRD": ("Product/album", "other", "medium"), "ISBJ": ("Subject", "other", "medium")}
AVI_INFO = INFO | {"IDIT": ("Capture date", "dates", "high")}


def _latin(p: Column, at: int, most: int) -> Column:
    return stripped(F.replace(cp1252(F.substring(p["head"], at + 1, most)), F.lit("\0"), F.lit("")))


def _info(p: Column, table: dict, prefix: str) -> Column:
    return known(table, F.substring(p["kind"], 6, 4), prefix, "INFO field", filled(_latin(p, 0, 256)))


def _wav(p: Column) -> Column:
    kind = p["kind"]
    list_type = F.decode(F.substring(p["head"], 1, 4), "ISO-8859-1")
    data_size = p["stop"] - p["body"]
    date = F.when(data_size >= 330, _latin(p, 320, 10))
    broadcast = F.array_join(F.filter(F.array(_latin(p, 0, 256), _latin(p, 256, 32), date), lambda t: t != ""), " — ")
    is_list = (kind == "LIST") & (p["depth"] == 0)
    return (
        F.when(kind.isin(*WAV_KEPT), None)
        .when(p["depth"] == 1, _info(p, WAV_INFO, "WAV:"))
        .when(is_list & (list_type == "INFO"), None)
        .when(is_list, found("containers", F.concat(F.lit("WAV:LIST:"), list_type), F.format_string("LIST chunk (%s)", F.coalesce(filled(F.trim(list_type)), F.lit("unknown"))), "Present", "medium"))
        .when(kind == "bext", found("containers", "WAV:bext", "Broadcast WAV metadata", F.coalesce(filled(broadcast), F.lit("Present")), "high"))
        .when(kind.isin("id3 ", "ID3 "), found("containers", "WAV:id3", "ID3 tag", "Present", "medium"))
        .when(kind == "iXML", found("containers", "WAV:iXML", "iXML production metadata", "Present", "high"))
        .when(kind == "_PMX", found("containers", "WAV:xmp", "XMP metadata", "Present", "medium"))
        .otherwise(found("other", F.concat(F.lit("WAV:"), kind), F.format_string("Chunk (%s)", F.trim(kind)), size_of(p), "medium"))
    )


def _avi(p: Column) -> Column:
    date = filled(_latin(p, 0, 64))
    return F.when((p["kind"] == "IDIT") & date.isNotNull(), found("dates", "AVI:IDIT", "Capture date", date, "high")).when(p["depth"] == 1, _info(p, AVI_INFO, "AVI:"))


def _avi_edits(p: Column) -> Column:
    metadata = (p["depth"] == 0) & ((p["kind"] == "IDIT") | (p["kind"] == "LIST") & (F.substring(p["head"], 1, 4) == F.lit("INFO").cast("binary")))
    return F.when(metadata, F.array(edit(p["start"], F.lit("JUNK").cast("binary")), edit(p["body"], zeros(p["stop"] - p["body"]))))


# --- FLAC
#: Block types that a copy keeps, and labels of comments.
FLAC_KEPT = ("0", "1", "3", "5")
COMMENTS = {
    "TITLE": ("Title", "other", "medium"), "ARTIST": ("Artist", "author", "medium"), "ALBUM": ("Album", "other", "medium"), "DATE": ("Date", "dates", "medium"),
    "COMMENT": ("Comment", "other", "medium"), "ENCODER": ("Encoder", "software", "medium"), "ENCODED_BY": ("Encoded by", "author", "high"),
    "COPYRIGHT": ("Copyright", "author", "medium"), "CONTACT": ("Contact", "author", "high"), "LOCATION": ("Location", "geolocation", "high"),
}


def _commented(p: Column, prefix: str, table: dict) -> Column:
    """Vendor and entries of a comment block."""
    entry, vendor = utf8(F.substring(p["head"], 1, 512)), stripped(utf8(F.substring(p["head"], 1, 256)))
    at = F.instr(entry, "=")
    name = F.upper(F.substring(entry, F.lit(1), at - 1))
    value = filled(stripped(F.substring(entry, at + 1, F.lit(512))))
    told = F.when((p["kind"] == "vendor") & (vendor != ""), found("software", f"{prefix}vendor", "Encoder vendor", vendor, "medium"))
    return told.when((p["kind"] == "comment") & (at > 1), known(table, name, prefix, "Tag", value))


def _flac(p: Column) -> Column:
    return (
        F.when(p["kind"] == "6", found("thumbnails", "FLAC:picture", "Cover art image", "Present", "medium"))
        .when(p["kind"] == "2", found("containers", "FLAC:application", "Application data block", "Present", "medium"))
        .otherwise(_commented(p, "FLAC:", COMMENTS))
    )


def _ogg(p: Column) -> Column:
    table = {k: v for k, v in COMMENTS.items() if k != "COPYRIGHT"}
    return F.when(p["kind"] == "spanning", found("containers", "OGG:comments", "Comment header (spans pages)", "Present", "medium")).otherwise(_commented(p, "OGG:", table))


def page_checksum(page: Column) -> Column:
    """CRC-32 with the polynomial 04C11DB7, the highest bit first, from 0 and not inverted: Spark's own counts bits the other way round and from ones.

    So the bits of each byte are turned round (digits swapped and mapped), what the ones contribute is taken out again, and the
    result is turned round.
    """
    turned = F.unhex(F.regexp_replace(F.translate(F.hex(page), "0123456789ABCDEF", "084C2A6E195D3B7F"), "(.)(.)", "$2$1"))
    plain = F.crc32(turned).bitwiseXOR(F.crc32(zeros(F.length(page))))
    return F.conv(F.reverse(F.lpad(F.bin(plain), 32, "0")), 2, 10).cast("bigint")


def _ogg_page(content: Column, page: Column, packets: Column) -> Column:
    """The page with an empty comment packet, laced anew; a packet that goes on behind it stays open. Null if it has too many laces."""
    empty = lambda p: F.concat(F.substring(content, p["start"] + 1, p["body"] - p["start"]), zeros(F.lit(8)), F.when(p["body"] - p["start"] == 7, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit(""))))
    bodies = F.transform(packets, lambda p: F.struct(F.hex(F.when(p["kind"] == "comments", empty(p)).otherwise(F.substring(content, p["start"] + 1, p["stop"] - p["start"]))).alias("digits"), (p["kind"] == "open packet").alias("open")))

    def lacing(b: Column) -> Column:
        size = F.length(b["digits"]) / 2
        return F.concat(F.repeat(F.lit("FF"), F.floor(size / 255).cast("int")), F.when(b["open"], "").otherwise(F.lpad(F.hex((size % 255).cast("int")), 2, "0")))

    def made(laces: Column) -> Column:
        count = (F.length(laces) / 2).cast("int")
        before, behind = F.hex(F.substring(content, page["start"] + 1, F.lit(22))), F.concat(F.lpad(F.hex(count), 2, "0"), laces, F.array_join(F.transform(bodies, lambda b: b["digits"]), ""))
        unsummed = F.unhex(F.concat(before, F.lit("00000000"), behind))
        return F.when(count <= 255, let(unsummed, lambda u: F.overlay(u, little(page_checksum(u), 4), F.lit(23))))

    return let(F.array_join(F.transform(bodies, lacing), ""), made)


def _ogg_copy(content: Column, pieces: Column) -> Column:
    page = F.try_element_at(F.filter(pieces, lambda p: p["kind"] == "comment page"), F.lit(1))
    packets = F.filter(pieces, lambda p: p["depth"] == 3)

    def around(p: Column) -> Column:
        return F.concat(F.substring(content, F.lit(1), p["start"]), _ogg_page(content, p, packets), F.substring(content, p["stop"] + 1, F.length(content) - p["stop"]))

    spans = F.exists(pieces, lambda p: p["kind"] == "spanning")
    return F.when(page.isNull(), content).when(~spans, let(page, around))


def _flac_copy(content: Column, pieces: Column) -> Column:
    """Kept blocks one by one: only the last of them has the last flag."""
    kept = F.filter(pieces, lambda p: (p["depth"] == 0) & p["kind"].isin(*FLAC_KEPT))
    first = F.transform(kept, lambda p, i: F.unhex(F.lpad(F.hex(p["kind"].cast("int") + F.when(i == F.size(kept) - 1, 128).otherwise(0)), 2, "0")))
    blocks = F.zip_with(first, kept, lambda flag, p: F.concat(flag, F.substring(content, p["start"] + 2, p["stop"] - p["start"] - 1)))
    body = F.aggregate(blocks, F.substring(content, 1, 4), lambda acc, b: F.concat(acc, b))
    return F.concat(body, _bytes_of(content, pieces, "audio"))


# --- GIF
#: Application extensions that a copy keeps.
GIF_KEPT = ("NETSCAPE2.0", "ANIMEXTS1.0", "ICCRGBG1012")


def _application(p: Column) -> Column:
    return F.when(p["kind"] == "application", F.decode(F.substring(p["head"], F.lit(2), F.least(number(p["head"], 0, 1), F.lit(11)).cast("int")), "ISO-8859-1")).when(F.startswith(p["kind"], F.lit("label ")), p["kind"])


def _block_text(head: Column) -> Column:
    """The text of data blocks of up to 255 bytes, each after its length."""
    digits = F.hex(head)

    def step(acc: Column, _: Column) -> Column:
        size = F.conv(F.substring(digits, acc["at"] * 2 + 1, F.lit(2)), 16, 10).cast("int")
        more = (size > 0) & acc["more"]
        part = F.when(more, F.substring(head, acc["at"] + 2, size)).otherwise(F.unhex(F.lit("")))
        return F.struct((acc["at"] + 1 + F.coalesce(size, F.lit(0))).alias("at"), F.coalesce(more, F.lit(False)).alias("more"), F.concat(acc["text"], part).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("more"), F.unhex(F.lit("")).alias("text"))
    bytes_ = F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, step)["text"]
    return F.regexp_replace(F.substring(F.decode(bytes_, "ISO-8859-1"), 1, 180), "[^ -~]", "·")


def _gif(p: Column) -> Column:
    name = _application(p)
    xmp = F.startswith(name, F.lit("XMP Data"))
    label = F.format_string("Application extension (%s)", F.coalesce(filled(F.trim(name)), F.lit("unknown")))
    extension = found(
        F.when(xmp, "containers").otherwise("software"), F.when(xmp, "GIF:XMP").otherwise(F.concat(F.lit("GIF:App:"), name)), F.when(xmp, "XMP metadata").otherwise(label), "Present", "medium"
    )
    return F.when(p["kind"] == "comment", found("other", "GIF:Comment", "GIF comment", filled(_block_text(p["head"])), "medium")).when((name != "") & ~name.isin(*GIF_KEPT), extension)


def _gif_kept(p: Column) -> Column:
    name = _application(p)
    return (p["kind"] != "comment") & F.coalesce((name == "") | name.isin(*GIF_KEPT), F.lit(True))


def _gif_copy(content: Column, pieces: Column) -> Column:
    ended = F.exists(pieces, lambda p: p["kind"] == "trailer")
    return F.concat(cut(content, pieces, _gif_kept), F.when(ended, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("3B"))))


# --- JPEG
#: Tags of photographs, by their number: label, category, severity.
EXIF = {
    0x010E: ("Image description", "other", "low"), 0x010F: ("Camera manufacturer", "device", "medium"), 0x0110: ("Camera model", "device", "medium"),
    0x011A: ("X resolution", "other", "low"), 0x011B: ("Y resolution", "other", "low"), 0x0128: ("Resolution unit", "other", "low"),
    0x0131: ("Software", "software", "medium"), 0x0132: ("Date/time", "dates", "high"), 0x013B: ("Artist", "author", "high"), 0x013E: ("White point", "other", "low"),
    0x0213: ("YCbCr positioning", "other", "low"), 0x8298: ("Copyright", "author", "high"), 0x8769: ("EXIF IFD pointer", "containers", "medium"),
    0x8825: ("GPS IFD pointer", "containers", "high"), 0x829A: ("Exposure time", "device", "low"), 0x829D: ("F-number", "device", "low"),
    0x8822: ("Exposure program", "device", "low"), 0x8827: ("ISO speed", "device", "low"), 0x9000: ("EXIF version", "other", "low"),
    0x9003: ("Date/time original", "dates", "high"), 0x9004: ("Date/time digitised", "dates", "high"), 0x9201: ("Shutter speed value", "device", "low"),
    0x9202: ("Aperture value", "device", "low"), 0x9204: ("Exposure compensation", "device", "low"), 0x9207: ("Metering mode", "device", "low"),
    0x9209: ("Flash", "device", "low"), 0x920A: ("Focal length", "device", "low"), 0x927C: ("MakerNote", "device", "medium"), 0x9286: ("User comment", "other", "medium"),
    0xA002: ("Pixel X dimension", "other", "low"), 0xA003: ("Pixel Y dimension", "other", "low"), 0xA004: ("Lens model", "device", "medium"),
    0xA005: ("Interop IFD pointer", "containers", "low"), 0xA420: ("Image unique ID", "device", "medium"), 0xA430: ("Camera owner name", "author", "high"),
    0xA431: ("Camera serial number", "device", "high"), 0xA432: ("Lens specification", "device", "medium"), 0xA433: ("Lens make", "device", "high"),
    0xA434: ("Lens model (Exif)", "device", "medium"), 0xA435: ("Lens serial number", "device", "high"),
    0x0000: ("GPS version", "geolocation", "low"), 0x0001: ("GPS latitude ref", "geolocation", "high"), 0x0002: ("GPS latitude", "geolocation", "high"),
    0x0003: ("GPS longitude ref", "geolocation", "high"), 0x0004: ("GPS longitude", "geolocation", "high"), 0x0005: ("GPS altitude ref", "geolocation", "high"),
    0x0006: ("GPS altitude", "geolocation", "high"), 0x0007: ("GPS timestamp", "geolocation", "high"), 0x0012: ("GPS measure mode", "geolocation", "medium"),
    0x001D: ("GPS date", "geolocation", "high"),
}


def _quotient(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def ratio(a: Column, b: Column) -> Column:
    return F.regexp_replace(_quotient(a, b).cast("string"), r"\.0$", "")


def tag_value(p: Column) -> Column:
    """The value of a tag as text: its first 256 characters, a single number, or how many there are."""
    parts = F.split(p["kind"], ":")
    kind, count, little = parts[3].cast("int"), parts[4].cast("bigint"), parts[5] == "little"
    head = p["head"]

    def unsigned(at: int, size: int) -> Column:
        return F.when(little, number(head, at, size, "little")).otherwise(number(head, at, size))

    def signed(at: int) -> Column:
        n = unsigned(at, 4)
        return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)

    one = (
        F.when(kind == 3, unsigned(0, 2).cast("string"))
        .when(kind == 4, unsigned(0, 4).cast("string"))
        .when(kind == 5, ratio(unsigned(0, 4), unsigned(4, 4)))
        .when(kind == 9, signed(0).cast("string"))
        .when(kind == 10, ratio(signed(0), signed(4)))
    )
    return (
        F.when(kind.isin(1, 7), F.when(count > 256, "[data]").otherwise(F.format_string("[%d bytes]", count)))
        .when(kind == 2, cstring(F.substring(head, F.lit(1), F.least(count, F.lit(256)).cast("int"))))
        .when(kind.isin(3, 4, 5, 9, 10), F.when(count == 1, one).otherwise(F.format_string("[%d values]", count)))
        .otherwise(F.format_string("[type %d]", kind))
    )


def _begins(p: Column, text: str) -> Column:
    return F.startswith(p["head"], F.lit(text).cast("binary"))


def _tag(p: Column, prefix: str) -> Column:
    """The finding of a tag that is known; within the directory of places, of any."""

    def told(parts: Column, info: Column) -> Column:
        label = F.coalesce(info["label"], F.concat(F.lit("GPS tag 0x"), F.lower(F.hex(parts[2].cast("bigint")))))
        finding = found(F.coalesce(info["category"], F.lit("geolocation")), F.concat(F.lit(prefix), label), label, tag_value(p), F.coalesce(info["severity"], F.lit("medium")))
        return F.when(info.isNotNull() | (parts[1] == "GPS"), finding)

    return let(F.split(p["kind"], ":"), lambda parts: let(listed({str(k): v for k, v in EXIF.items()}, parts[2]), lambda info: told(parts, info)))


def _gps(pieces: Column, tag: str) -> Column:
    """The last tag of the directory of places whose number, type and count begin so."""
    return F.try_element_at(F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit(f"tag:GPS:{tag}"))), F.lit(-1))


def _whole(p: Column, at: int) -> Column:
    return F.when(F.endswith(p["kind"], F.lit(":little")), number(p["head"], at, 4, "little")).otherwise(number(p["head"], at, 4))


def _place(pieces: Column, prefix: str) -> Column:
    """What the tags of a place tell together: coordinates, and with these the altitude."""

    def direction(tag: str) -> Column:
        return F.regexp_replace(F.decode(F.substring(_gps(pieces, f"{tag}:")["head"], 1, 2), "ISO-8859-1"), "(?s)\0.*", "")

    def text(towards: Column, p: Column) -> Column:
        degrees, minutes, seconds = (_quotient(_whole(p, k), _whole(p, k + 4)) for k in (0, 8, 16))
        sign = F.when(towards.isin("S", "W"), -1).otherwise(1)
        rounded = F.floor(sign * (degrees + minutes / 60 + seconds / 3600) * 10_000 + 0.5)
        return F.when(towards != "", F.regexp_replace((rounded / F.lit(10_000)).cast("decimal(14,4)").cast("string"), r"\.?0+$", ""))

    def decimal(ref: str, value: str) -> Column:
        return let(direction(ref), lambda d: let(_gps(pieces, f"{value}:5:3:"), lambda p: text(d, p)))

    def told(both: Column, height: Column) -> Column:
        altitude = found("geolocation", f"{prefix}GPS altitude", "GPS altitude", F.concat(ratio(_whole(height, 0), _whole(height, 4)), F.lit(" m")), "high")
        return F.array(F.when(both.isNotNull(), found("geolocation", f"{prefix}GPS coordinates", "GPS coordinates", both, "high")), F.when(both.isNotNull() & height.isNotNull(), altitude))

    return let(F.concat(decimal("1", "2"), F.lit(", "), decimal("3", "4")), lambda both: let(_gps(pieces, "6:5:"), lambda height: told(both, height)))


def tag_findings(pieces: Column, prefix: str) -> Column:
    """Tags in their order, and behind those of a place what they tell together."""

    def told(p: Column) -> Column:
        return F.when(p["kind"] == "gps", _place(pieces, prefix)).otherwise(F.array(_tag(p, prefix)))

    return F.filter(F.flatten(F.transform(F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit("tag:")) | (p["kind"] == "gps")), told)), lambda f: f.isNotNull())


def _jpeg_findings(pieces: Column) -> Column:
    """Tags, then XMP and IPTC once, comments, and images within segments; also of segments behind the scans."""

    def is_xmp(p: Column) -> Column:
        head = F.decode(F.substring(p["head"], 1, 64), "ISO-8859-1")
        return (p["kind"] == "e1") & (p["stop"] - p["body"] > 28) & (F.contains(head, F.lit("http://ns.adobe.com/xap/1.0/")) | F.contains(head, F.lit("<?xpacket")))

    def once(test: Found, finding: Column) -> Column:
        return F.when(F.exists(pieces, test), F.array(finding)).otherwise(F.array().cast(f"array<{FINDING}>"))

    def comment(p: Column) -> Column:
        return found("other", "JPEG:Comment", "JPEG comment", F.coalesce(filled(utf8(F.substring(p["head"], 1, 500))), F.lit("[binary data]")), "medium")

    def thumbnail(p: Column) -> Column:
        return found("thumbnails", "EXIF:Thumbnail", "Embedded thumbnail", F.format_string("~%d KB", F.floor((p["stop"] - p["body"]) / 1024 + 0.5)), "medium")

    return F.concat(
        tag_findings(pieces, "EXIF:"),
        once(is_xmp, found("containers", "XMP", "XMP metadata", "Present", "medium")),
        once(lambda p: (p["kind"] == "ed") & _begins(p, "Photoshop"), found("containers", "IPTC", "IPTC metadata", "Present", "medium")),
        F.transform(F.filter(pieces, lambda p: p["kind"] == "fe"), comment),
        F.transform(F.filter(pieces, lambda p: p["kind"] == "thumbnail"), thumbnail),
    )


def _jpeg_kept(p: Column) -> Column:
    removable = (p["kind"] == "fe") | p["kind"].between("e1", "ef")
    return (p["depth"] == 0) & (~removable | (p["kind"] == "e2") & F.startswith(p["head"], F.lit("ICC_PROFILE\0").cast("binary")))


#: Fixed value: a segment of tags that states nothing but an orientation, up to that and behind it.
ORIENTATION = ("FFE1002245786966000049492A000800000001001201030001000000", "00000000000000")


def _jpeg_copy(content: Column, pieces: Column) -> Column:
    return F.when(F.exists(pieces, lambda p: p["kind"] == "unfinished"), content).otherwise(cut(content, pieces, _jpeg_kept))


def _oriented_copy(content: Column, pieces: Column) -> Column:
    """The copy with the orientation that the first tags state, if the image isn't upright."""

    def turned(tag: Column, copy: Column) -> Column:
        little = F.endswith(tag["kind"], F.lit(":little"))
        value = F.when(little, number(tag["head"], 0, 2, "little")).otherwise(number(tag["head"], 0, 2))
        segment = F.unhex(F.concat(F.lit(ORIENTATION[0]), F.lpad(F.hex(value), 2, "0"), F.lit(ORIENTATION[1])))
        return F.when(value.between(2, 8) & (copy != content), F.concat(F.substring(copy, 1, 2), segment, F.substring(copy, F.lit(3), F.length(copy)))).otherwise(copy)

    tag = F.try_element_at(F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit("tag:IFD0:274:3:"))), F.lit(1))
    return let(tag, lambda t: let(_jpeg_copy(content, pieces), lambda copy: turned(t, copy)))


# --- MP3
#: Frames of ID3 tags, their short names of version 2.2, and frames whose value isn't shown.
FRAMES = {
    "TIT2": ("Title", "other", "medium"), "TPE1": ("Artist", "author", "medium"), "TPE2": ("Album artist", "author", "medium"), "TALB": ("Album", "other", "medium"),
    "TYER": ("Year", "dates", "medium"), "TDRC": ("Recording date", "dates", "high"), "TDEN": ("Encoding date", "dates", "medium"), "TCON": ("Genre", "other", "low"),
    "TENC": ("Encoded by", "author", "high"), "TSSE": ("Encoder settings", "software", "medium"), "TCOM": ("Composer", "author", "medium"),
    "TCOP": ("Copyright", "author", "medium"), "TPUB": ("Publisher", "other", "medium"), "TOFN": ("Original filename", "other", "high"),
    "COMM": ("Comment", "other", "medium"), "USLT": ("Lyrics", "other", "low"), "TXXX": ("Custom text field", "other", "medium"), "WXXX": ("Custom URL", "other", "medium"),
    "POPM": ("Popularimeter (rater e-mail)", "author", "high"), "UFID": ("Unique file identifier", "other", "high"), "PRIV": ("Private application data", "other", "medium"),
    "GEOB": ("Embedded object", "containers", "medium"), "APIC": ("Cover art image", "thumbnails", "medium"),
}
SHORT_FRAMES = {
    "TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TYE": "TYER", "TCO": "TCON", "TEN": "TENC", "TSS": "TSSE", "TCM": "TCOM", "TCR": "TCOP",
    "COM": "COMM", "ULT": "USLT", "TXX": "TXXX", "WXX": "WXXX", "POP": "POPM", "UFI": "UFID", "GEO": "GEOB", "PIC": "APIC",
}
FRAMES_HIDDEN = ("APIC", "GEOB", "PRIV", "UFID")


def _frame_text(p: Column) -> Column:
    """By the encoding that the first byte names."""
    body, code = F.substring(p["head"], 2, 511), number(p["head"], 0, 1)
    text = F.when(code == 1, F.decode(body, "UTF-16")).when(code == 2, F.decode(body, "UTF-16BE")).when(code == 3, utf8(body)).otherwise(cp1252(body))
    return filled(stripped(F.replace(text, F.lit("\0"), F.lit(""))))


def _mp3(p: Column) -> Column:
    raw = F.substring(p["kind"], 7, 4)
    short = [x for k, v in SHORT_FRAMES.items() for x in (F.lit(k), F.lit(v))]
    name = F.coalesce(F.try_element_at(F.create_map(*short), raw), raw)
    info = listed(FRAMES, name)
    value = F.when(name.isin(*FRAMES_HIDDEN), "Present").otherwise(_frame_text(p))
    frame = F.when(info.isNotNull(), found(info["category"], F.concat(F.lit("MP3:"), name), info["label"], value, info["severity"])).when(
        ~raw.isin("TLEN", "TRCK", "TPOS"), found("other", F.concat(F.lit("MP3:"), name), F.format_string("ID3 frame (%s)", name), F.lit(None), "low")
    )
    old = F.array_join(F.filter(F.array(_latin(p, 3, 30), _latin(p, 33, 30)), lambda t: t != ""), " — ")
    return (
        F.when(F.startswith(p["kind"], F.lit("frame:")), frame)
        .when(p["kind"] == "id3v1", found("containers", "MP3:ID3v1", "ID3v1 tag", F.coalesce(filled(old), F.lit("Present")), "medium"))
        .when(p["kind"] == "ape", found("containers", "MP3:APE", "APE tag", "Present", "medium"))
        .when(p["kind"] == "lyrics3", found("containers", "MP3:Lyrics3", "Lyrics3 tag", "Present", "medium"))
    )


# --- PSD
#: Image resources that are metadata.
RESOURCES = {
    0x0404: ("IPTC metadata", "containers", "high"), 0x0409: ("Thumbnail (Photoshop 4)", "thumbnails", "medium"), 0x040B: ("URL", "other", "high"),
    0x040C: ("Thumbnail", "thumbnails", "medium"), 0x0421: ("Version info (writer)", "software", "medium"), 0x0422: ("EXIF data", "containers", "high"),
    0x0423: ("EXIF data (3)", "containers", "high"), 0x0424: ("XMP metadata", "containers", "high"), 0x0425: ("Caption digest", "other", "low"),
    0x043A: ("URL list", "other", "high"),
}


def _resource(p: Column) -> Column:
    return listed({f"8BIM:{k}": v for k, v in RESOURCES.items()}, p["kind"])


def _psd(p: Column) -> Column:
    info = _resource(p)
    name = F.format_string("PSD:0x%x", F.split(p["kind"], ":")[1].cast("int"))
    return F.when(info.isNotNull(), found(info["category"], name, info["label"], "Present", info["severity"]))


def _bytes_of(content: Column, pieces: Column, kind: str) -> Column:
    """The bytes of the first piece of a kind."""
    p = F.element_at(F.filter(pieces, lambda p: p["kind"] == kind), 1)
    return F.substring(content, p["start"] + 1, p["stop"] - p["start"])


def _psd_copy(content: Column, pieces: Column) -> Column:
    kept = F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit("8BIM")) & _resource(p).isNull())
    size = F.aggregate(kept, F.lit(0), lambda acc, p: acc + p["stop"] - p["start"])
    length = F.unhex(F.lpad(F.hex(size), 8, "0"))
    before, after = (_bytes_of(content, pieces, name) for name in ("before", "after"))
    return F.concat(before, length, cut(content, kept, lambda p: F.lit(True)), after)


# --- MP4
#: Atoms with a label.
ATOMS = {
    "©xyz": ("GPS coordinates", "geolocation", "high"), "©nam": ("Title", "other", "medium"), "©ART": ("Artist", "author", "medium"), "©alb": ("Album", "other", "medium"),
    "©day": ("Date", "dates", "high"), "©too": ("Encoding tool", "software", "medium"), "©cmt": ("Comment", "other", "medium"), "©aut": ("Author", "author", "high"),
    "©cpy": ("Copyright", "author", "medium"), "©mak": ("Device make", "device", "high"), "©mod": ("Device model", "device", "high"), "©swr": ("Software", "software", "medium"),
    "©enc": ("Encoded by", "author", "high"), "aART": ("Album artist", "author", "medium"), "cprt": ("Copyright", "author", "medium"), "desc": ("Description", "other", "medium"),
    "ldes": ("Long description", "other", "medium"), "keyw": ("Keywords", "other", "medium"), "auth": ("Author", "author", "high"),
}
EPOCH_1904 = 2082844800


def _atom_text(p: Column) -> Column:
    head, size = p["head"], p["stop"] - p["body"]
    inner, short = F.substring(head, 5, 4) == F.lit("data").cast("binary"), number(head, 0, 2).cast("int")
    text = F.when(inner, F.substring(head, F.lit(17), F.least(number(head, 0, 4) - 16, F.lit(256)).cast("int"))).when(
        (size >= 4) & (short > 0) & (short + 4 <= size), F.substring(head, F.lit(5), F.least(short, F.lit(256)))
    )
    return filled(stripped(F.replace(utf8(text), F.lit("\0"), F.lit(""))))


def _apple(p: Column, which: int) -> Column:
    """The time of a header box (0: created, 1: changed), or null."""
    long = number(p["head"], 0, 1) == 1
    seconds = F.when(long, number(p["head"], 4 + 8 * which, 8)).otherwise(number(p["head"], 4 + 4 * which, 4))
    return F.when(seconds > 0, seconds)


def _iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds - EPOCH_1904), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _mp4_findings(pieces: Column) -> Column:
    """Of each metadata box what it holds, or that it is there; then the times."""

    def inside(box: Column) -> Column:
        held = F.filter(pieces, lambda p: (p["depth"] == 99) & (p["start"] >= box["body"]) & (p["stop"] <= box["stop"]))
        atoms = F.transform(held, lambda p: F.struct(listed(ATOMS, F.substring(p["kind"], 4, 4)).alias("info"), F.substring(p["kind"], 4, 4).alias("kind"), _atom_text(p).alias("text")))
        told = F.transform(
            F.filter(atoms, lambda a: a["info"].isNotNull()),
            lambda a: found(a["info"]["category"], F.concat(F.lit("MP4:"), F.replace(a["kind"], F.lit("©"), F.lit("c"))), a["info"]["label"], a["text"], a["info"]["severity"]),
        )
        general = F.array(found("containers", "MP4:udta", "User data container (udta/meta)", "Present", "medium"))
        private = F.array(found("containers", "MP4:uuid", "XMP / private metadata (uuid box)", "Present", "medium"))
        return F.when(box["kind"] == "uuid", private).when(F.size(told) > 0, told).otherwise(general)

    boxes = F.flatten(F.transform(F.filter(pieces, _is_metadata), inside))
    movies = F.filter(pieces, lambda p: p["kind"] == "mvhd")
    created = F.try_element_at(F.filter(F.transform(movies, lambda p: _apple(p, 0)), lambda t: t.isNotNull()), F.lit(1))
    changed = F.try_element_at(F.filter(F.transform(movies, lambda p: _apple(p, 1)), lambda t: t.isNotNull()), F.lit(1))
    tracks = F.size(F.filter(pieces, lambda p: p["kind"].isin("tkhd", "mdhd") & F.coalesce(_apple(p, 0), _apple(p, 1)).isNotNull()))
    times = F.array(
        F.when(created.isNotNull(), found("dates", "MP4:created", "Creation date", _iso(created), "high")),
        F.when(changed.isNotNull() & ~changed.eqNullSafe(created), found("dates", "MP4:modified", "Modification date", _iso(changed), "medium")),
        F.when(tracks > 0, found("dates", "MP4:trackDates", "Track timestamps", tracks, "low")),
    )
    return F.concat(boxes, F.filter(times, lambda f: f.isNotNull()))


def _is_metadata(p: Column) -> Column:
    return (p["depth"] < 99) & p["kind"].isin("udta", "meta", "uuid", "Xtra")


def _mp4_edits(p: Column) -> Column:
    free = F.array(edit(p["start"] + 4, F.lit("free").cast("binary")), edit(p["body"], zeros(p["stop"] - p["body"])))
    times = F.array(edit(p["body"] + 4, zeros(F.when(number(p["head"], 0, 1) == 1, 16).otherwise(8))))
    return F.when(_is_metadata(p), free).when(p["kind"].isin("mvhd", "tkhd", "mdhd"), times)


# --- RTF
#: Fields of the information group, and its dates.
RTF_FIELDS = {
    "author": ("Author", "author", "high"), "operator": ("Operator", "author", "high"), "company": ("Company", "author", "high"), "manager": ("Manager", "author", "high"),
    "title": ("Title", "other", "medium"), "subject": ("Subject", "other", "medium"), "keywords": ("Keywords", "other", "medium"), "comment": ("Comment", "other", "medium"),
    "doccomm": ("Document comment", "other", "medium"), "category": ("Category", "other", "low"),
}
RTF_DATES = {"creatim": "Creation date", "revtim": "Revision date", "printim": "Last printed date"}


def _rtf_told(kind: Column, body: Column) -> Column:
    """All findings of a group."""

    def extract(pattern: str, group: int = 1) -> Column:
        return filled(F.regexp_extract(body, pattern, group))

    told = []
    for name, (label, category, severity) in RTF_FIELDS.items():
        pattern = rf"\{{\\{name} ([^{{}}]{{1,200}})\}}"
        told.append(F.when(body.rlike(pattern), found(category, f"RTF:{name}", label, filled(stripped(F.regexp_extract(body, pattern, 1))), severity)))
    for name, label in RTF_DATES.items():
        pattern = rf"\{{\\{name}([^{{}}]*)\}}"
        date = F.regexp_extract(body, pattern, 1)
        year, month, day = (filled(F.regexp_extract(date, rf"\\{part}(\d+)", 1)) for part in ("yr", "mo", "dy"))
        padded = [F.lpad(part, F.greatest(F.length(part), F.lit(2)), "0") for part in (month, day)]
        told.append(F.when(body.rlike(pattern), found("dates", f"RTF:{name}", label, F.when(year.isNotNull(), F.concat_ws("-", year, *padded)), "high")))
    minutes = extract(r"\\edmins(\d+)")
    told.append(F.when(minutes.isNotNull(), found("dates", "RTF:edmins", "Total editing time (minutes)", minutes, "low")))
    program = extract(r"\\generator\s+([^;{}]{1,120})")
    generator = F.array(found("software", "RTF:generator", "Generator application", F.when(program.isNotNull(), stripped(program)), "medium"))
    return F.when(kind == "generator", generator).otherwise(F.filter(F.array(*told), lambda f: f.isNotNull()))


def _rtf_findings(pieces: Column) -> Column:
    return F.flatten(F.transform(F.filter(pieces, lambda p: p["depth"] == 1), lambda p: let(cp1252(p["head"]), lambda body: _rtf_told(p["kind"], body))))


# --- BMP


def _bmp(p: Column) -> Column:
    linked = found("other", "BMP:LinkedProfile", "Linked colour profile path", filled(F.decode(p["head"], "ISO-8859-1")), "high")
    return F.when(p["kind"] == "linked", linked).when(p["kind"] == "trailing", found("other", "BMP:TrailingData", "Trailing data after pixel data", size_of(p), "medium"))


def _bmp_copy(content: Column, pieces: Column) -> Column:
    """The image alone, with its size; a linked profile becomes the standard one, and its path is zeroed."""
    body = cut(content, pieces, lambda p: p["kind"] == "body")
    sized = F.overlay(body, little(F.length(body), 4), F.lit(3))
    header = number(content, 14, 4, "little")
    standard = F.overlay(sized, F.lit("BGRs").cast("binary"), F.lit(71))
    standard = F.when(header >= 124, F.overlay(standard, F.unhex(F.lit("00" * 8)), F.lit(127))).otherwise(standard)
    blank = overwritten(standard, pieces, lambda p: F.when(p["kind"] == "path", F.array(edit(p["start"], zeros(p["stop"] - p["start"])))))
    return F.when(F.exists(pieces, lambda p: p["kind"] == "linked"), blank).otherwise(sized)


# --- WebP
#: Chunks within the extended header that a copy keeps, and its flags of a profile, of transparency and of motion.
WEBP_KEPT, WEBP_FLAGS = ("ICCP", "ALPH", "ANIM", "ANMF"), 0x20 | 0x10 | 0x02
WEBP_CREATOR = r"(?s)<dc:creator>\s*<rdf:Seq>\s*<rdf:li>(.*?)</rdf:li>"


def _webp_findings(pieces: Column) -> Column:
    """Of the first chunk of each kind, whether it stands within the extended header or behind it."""

    def first(kind: str, told: Callable[[Column], Column]) -> Column:
        return let(F.try_element_at(F.filter(pieces, lambda p: F.trim(p["kind"]) == kind), F.lit(1)), lambda p: F.when(p.isNotNull(), told(p)))

    creator = lambda p: filled(stripped(F.regexp_extract(utf8(F.substring(p["head"], F.lit(1), F.least(p["stop"] - p["body"], F.lit(500)))), WEBP_CREATOR, 1)))
    told = F.array(
        first("EXIF", lambda p: found("containers", "WebP:EXIF", "EXIF metadata", size_of(p), "high")), first("XMP", lambda p: found("containers", "WebP:XMP", "XMP metadata", size_of(p), "medium")),
        first("XMP", lambda p: let(creator(p), lambda c: F.when(c.isNotNull(), found("author", "WebP:XMP:Creator", "Author (XMP)", c, "high")))),
        first("ICCP", lambda p: found("other", "WebP:ICCP", "ICC profile", "ICC profile (WebP)", "low")),
    )
    return F.filter(told, lambda f: f.isNotNull())


def _webp_size(content: Column, pieces: Column) -> Column:
    """From the extended header, or else from the frame."""

    def extended(p: Column) -> Column:
        return F.when(p["stop"] - p["body"] >= 10, size_struct(number(p["head"], 4, 3, "little") + 1, number(p["head"], 7, 3, "little") + 1))

    def lossy(p: Column) -> Column:
        side = lambda at: number(p["head"], at, 2, "little").bitwiseAND(F.lit(0x3FFF))
        return F.when(F.substring(p["head"], 4, 3) == F.unhex(F.lit("9D012A")), size_struct(side(6), side(8)))

    def lossless(p: Column) -> Column:
        bits = number(p["head"], 1, 4, "little")
        side = lambda by: F.shiftrightunsigned(bits, by).bitwiseAND(F.lit(0x3FFF)) + 1
        return F.when(number(p["head"], 0, 1) == 0x2F, size_struct(side(0), side(14)))

    one = lambda kind, make: let(F.try_element_at(F.filter(pieces, lambda p: (p["depth"] == 0) & (F.trim(p["kind"]) == kind)), F.lit(1)), make)
    return F.coalesce(one("VP8X", extended), one("VP8", lossy), one("VP8L", lossless))


def _webp_copy(content: Column, pieces: Column) -> Column:
    """Without EXIF and XMP, within the extended header and behind it, and with its flags cleared; files without either as they are."""
    padded = lambda p: F.concat(F.hex(F.substring(content, p["start"] + 1, p["stop"] - p["start"])), F.when((p["stop"] - p["start"]) % 2 == 1, "00").otherwise(""))
    inner = F.array_join(F.transform(F.filter(pieces, lambda p: (p["depth"] == 1) & F.trim(p["kind"]).isin(*WEBP_KEPT)), padded), "")

    def header(p: Column) -> Column:
        flags = number(p["head"], 0, 1).bitwiseAND(F.lit(WEBP_FLAGS))
        data = F.concat(F.lpad(F.hex(flags), 2, "0"), F.hex(F.substring(p["head"], 2, 9)), inner)
        return let(data, lambda d: F.concat(F.hex(F.lit(b"VP8X")), F.hex(little(F.length(d) / 2, 4)), d))

    chunks = F.transform(F.filter(pieces, lambda p: (p["depth"] == 0) & ~F.trim(p["kind"]).isin("EXIF", "XMP")), lambda p: F.when((p["kind"] == "VP8X") & (p["stop"] - p["body"] >= 10), header(p)).otherwise(padded(p)))
    dirty = F.exists(pieces, lambda p: F.trim(p["kind"]).isin("EXIF", "XMP"))
    rebuilt = let(F.array_join(chunks, ""), lambda d: F.unhex(F.concat(F.hex(F.lit(b"RIFF")), F.hex(little(F.length(d) / 2 + 4, 4)), F.hex(F.lit(b"WEBP")), d)))
    return F.when(dirty, rebuilt).otherwise(content)


# --- images of items


def _named(p: Column, k: int) -> Column:
    return F.get(F.split(p["kind"], ":"), F.lit(k))


def _is_item(p: Column) -> Column:
    """Whether an item is metadata."""
    return F.startswith(p["kind"], F.lit("item:")) & ((_named(p, 2) == "Exif") | (_named(p, 2) == "mime") & _named(p, 3).rlike("(?i)xmp"))


def _item_findings(pieces: Column) -> Column:
    told = lambda kind, finding: F.transform(F.filter(pieces, lambda p: _is_item(p) & (_named(p, 2) == kind)), lambda p: finding)
    return F.concat(
        told("Exif", found("containers", "AVIF:Exif", "EXIF data", "Present", "medium")), tag_findings(pieces, "AVIF:"), told("mime", found("containers", "AVIF:XMP", "XMP metadata", "Present", "medium"))
    )


def _item_size(content: Column, pieces: Column) -> Column:
    """The largest size, the first of equal ones."""
    sizes = F.transform(F.filter(pieces, lambda p: p["kind"] == "size"), lambda p, i: F.struct((-number(p["head"], 0, 4).cast("double") * number(p["head"], 4, 4)).alias("area"), i.alias("i"), number(p["head"], 0, 4).alias("width"), number(p["head"], 4, 4).alias("height")))
    return let(F.try_element_at(F.array_sort(sizes), F.lit(1)), lambda s: size_struct(s["width"], s["height"]))


def _item_copy(content: Column, pieces: Column) -> Column:
    """In place: bytes of metadata items zeroed, their records taken out of the description, and the room that is left made free.

    Null if such an item isn't stored in the file by offset, lies beyond its end, or leaves room that no box fits.
    """
    cut_out = lambda start, stop: F.hex(F.substring(content, start + 1, stop - start))

    def built(gone: Column, meta: Column) -> Column:
        stays = lambda p: ~F.array_contains(gone, _named(p, 1))
        records = lambda kind: F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit(f"{kind}:")) & (p["depth"] == 2))

        def box(child: Column, kind: str, count_at: int, wide: Column) -> Column:
            """The box with the records that stay; its number of them has wide digits, at that place (0: it has none)."""

            def made(own: Column) -> Column:
                kept = F.filter(own, stays)
                first = F.coalesce(F.try_element_at(own, F.lit(1))["start"], child["stop"])
                counted = F.concat(cut_out(child["body"], child["body"] + count_at), F.when(wide == 4, F.lpad(F.hex(F.size(kept)), 4, "0")).otherwise(F.lpad(F.hex(F.size(kept)), 8, "0")))
                head = cut_out(child["body"], first) if not count_at else counted
                data = F.concat(head, F.array_join(F.transform(kept, lambda p: cut_out(p["start"], p["stop"])), ""))
                return F.concat(F.lpad(F.hex((F.length(data) / 2 + 8).cast("bigint")), 8, "0"), F.hex(F.substring(child["kind"], 7, 4).cast("binary")), data)

            return let(records(kind), made)

        def rebuilt(child: Column) -> Column:
            version = F.hex(F.substring(content, child["body"] + 1, F.lit(1)))
            return (
                F.when(child["kind"] == "child:iinf", box(child, "item", 4, F.when(version == "00", 4).otherwise(8)))
                .when(child["kind"] == "child:iloc", box(child, "place", 6, F.when(version < "02", 4).otherwise(8)))
                .when(child["kind"] == "child:iref", box(child, "ref", 0, F.lit(0))).otherwise(cut_out(child["start"], child["stop"]))
            )

        def fitted(digits: Column) -> tuple[Column, Column]:
            slack = ((meta["stop"] - meta["body"]) - F.length(digits) / 2).cast("bigint")
            free = F.concat(F.lpad(F.hex(slack), 8, "0"), F.hex(F.lit(b"free")), F.repeat(F.lit("00"), (slack - 8).cast("int")))
            return F.unhex(F.concat(digits, F.when(slack >= 8, free).otherwise(""))), (slack == 0) | (slack >= 8)

        def placed(digits: Column) -> Column:
            new, fits = fitted(digits)
            own = F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit("extent:")) & F.array_contains(gone, _named(p, 1)))
            sound = F.forall(own, lambda p: p["stop"] <= F.length(content)) & ~F.exists(pieces, lambda p: F.startswith(p["kind"], F.lit("place:")) & F.array_contains(gone, _named(p, 1)) & (_named(p, 2) != "0"))
            blank = F.aggregate(own, content, lambda acc, p: F.overlay(acc, zeros(p["stop"] - p["start"]), p["start"] + 1))
            return F.when(fits & sound, F.overlay(blank, new, meta["body"] + 1))

        children = F.filter(pieces, lambda p: F.startswith(p["kind"], F.lit("child:")))
        return let(F.array_join(F.transform(children, rebuilt), ""), placed)

    gone = F.transform(F.filter(pieces, _is_item), lambda p: _named(p, 1))
    return let(gone, lambda g: F.when(F.size(g) == 0, content).otherwise(let(F.element_at(F.filter(pieces, lambda p: p["kind"] == "meta"), 1), lambda meta: built(g, meta))))


# --- films of elements
#: Elements that tell something: id, field, label, category, severity, whether its text is the value; in the order of findings.
FILM = (
    ("7ba9", "Title", "Title", "other", "medium", True), ("4461", "DateUTC", "Creation date", "dates", "high", False), ("4d80", "MuxingApp", "Muxing application", "software", "medium", True),
    ("5741", "WritingApp", "Writing application", "software", "medium", True), ("1254c367", "Tags", "Tags element", "containers", "medium", False), ("1941a469", "Attachments", "Attached files", "containers", "high", False),
)
VOIDED, ZEROED = ("7ba9", "4461", "1254c367", "1941a469"), ("4d80", "5741")


def _film_text(p: Column) -> Column:
    return filled(stripped(F.replace(utf8(F.substring(p["head"], F.lit(1), F.least(p["stop"] - p["body"], F.lit(256)))), F.lit("\0"), F.lit(""))))


def _film_findings(pieces: Column) -> Column:
    """Of the last element of each kind its text, or that it is there."""

    def told(rule: tuple) -> Column:
        kind, field, label, category, severity, shown = rule
        last = F.try_element_at(F.filter(pieces, lambda p: (p["kind"] == kind) & (p["depth"] > 0)), F.lit(-1))
        value = lambda p: _film_text(p) if shown else F.when(p.isNotNull(), "Present")
        return let(let(last, value), lambda v: F.when(v.isNotNull(), found(category, f"MKV:{field}", label, v, severity)))

    return F.filter(F.array(*map(told, FILM)), lambda f: f.isNotNull())


def _void(size: Column) -> Column:
    """An element of nothing, of so many bytes: its size in as few bytes as it takes."""
    out = zeros(size)
    for length in reversed(range(1, 9)):
        content = size - 1 - length
        head = F.concat(F.lit("EC"), F.lpad(F.hex((content + (1 << 7 * length)).cast("bigint")), 2 * length, "0"))
        out = F.when((content >= 0) & (content <= (1 << 7 * length) - 2), F.concat(F.unhex(head), zeros(content))).otherwise(out)
    return out


def _film_edits(p: Column) -> Column:
    void = F.array(edit(p["start"], _void((p["stop"] - p["start"]).cast("bigint"))))
    blank = F.array(edit(p["body"], zeros(p["stop"] - p["body"])))
    return F.when(p["depth"] > 0, F.when(p["kind"].isin(*VOIDED), void).when(p["kind"].isin(*ZEROED) & _film_text(p).isNotNull(), blank))


# --- icons


def _of_chunk(p: Column) -> Column:
    """A chunk of an icon's image as one of an image of its own."""
    return F.struct(F.split(p["kind"], ":")[2].alias("kind"), *[p[c].alias(c) for c in ("depth", "start", "body", "stop", "head")])


def _icon_findings(pieces: Column) -> Column:
    """Personal findings of images that are PNG, each with the number of its image; and trailing bytes."""

    def of_image(p: Column) -> Column:
        n = F.split(p["kind"], ":")[1]
        named = lambda f: found(f["category"], F.concat(F.lit("ICO:"), n, F.lit(":"), f["field"]), F.concat(f["label"], F.lit(" (icon "), (n.cast("int") + 1).cast("string"), F.lit(")")), f["value"], f["severity"])
        return let(_png(_of_chunk(p)), lambda f: F.when(f.isNotNull() & ~f["field"].isin(*TECHNICAL), named(f)))

    images = F.transform(F.filter(pieces, lambda p: p["depth"] == 1), of_image)
    trailing = F.transform(F.filter(pieces, lambda p: p["kind"] == "trailing"), lambda p: found("other", "ICO:TrailingData", "Trailing data after icon payloads", size_of(p), "medium"))
    return F.filter(F.concat(images, trailing), lambda f: f.isNotNull())


def _icon_size(content: Column, pieces: Column) -> Column:
    """That of the largest image, the first of equal ones."""
    images = F.filter(pieces, lambda p: p["depth"] == 0)
    side = lambda p, at: let(F.conv(F.hex(F.substring(content, p["start"] + at, F.lit(1))), 16, 10).cast("bigint"), lambda n: F.when(n == 0, 256).otherwise(n))
    sized = F.transform(images, lambda p, i: let(F.struct(side(p, 1).alias("width"), side(p, 2).alias("height")), lambda s: F.struct((-s["width"] * s["height"]).alias("area"), i.alias("i"), s.alias("s"))))
    return F.try_element_at(F.array_sort(sized), F.lit(1))["s"]


def _icon_copy(content: Column, pieces: Column) -> Column:
    """The directory with new sizes and places, and the images, those that are PNG without what their copies lose."""
    images = F.filter(pieces, lambda p: p["depth"] == 0)
    part = lambda p: F.hex(F.substring(content, p["start"] + 1, p["stop"] - p["start"]))

    def data(image: Column) -> Column:
        own = F.filter(pieces, lambda p: (p["depth"] == 1) & (p["start"] >= image["body"]) & (p["stop"] <= image["stop"]) & F.split(p["kind"], ":")[2].isin(*PNG_KEPT))
        png = F.concat(F.hex(F.substring(content, image["body"] + 1, F.lit(8))), F.array_join(F.transform(own, part), ""))
        return F.when(F.endswith(image["kind"], F.lit("png")), png).otherwise(F.hex(F.substring(content, image["body"] + 1, image["stop"] - image["body"])))

    def laid_out(parts: Column) -> Column:
        sizes = F.transform(parts, lambda d: (F.length(d) / 2).cast("bigint"))
        places = F.aggregate(sizes, F.array((6 + 16 * F.size(images)).cast("bigint")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        entries = F.transform(images, lambda p, i: F.concat(F.hex(F.substring(content, p["start"] + 1, F.lit(8))), F.hex(little(F.get(sizes, i), 4)), F.hex(little(F.get(places, i), 4))))
        return F.unhex(F.concat(F.hex(F.substring(content, 1, 6)), F.array_join(entries, ""), F.array_join(parts, "")))

    return let(F.transform(images, data), laid_out)


# --- copies


def edit(at: Column, with_: Column) -> Column:
    return F.struct(at.alias("at"), with_.alias("with"))


def zeros(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))


def cut(content: Column, pieces: Column, kept: Found) -> Column:
    """The kept pieces of the top level, neighbours taken together."""
    places = F.transform(F.filter(pieces, lambda p: (p["depth"] == 0) & kept(p)), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))

    def join(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), p["stop"].alias("stop"))))
        return F.when(last["stop"] == p["start"], longer).otherwise(F.concat(acc, F.array(p)))

    runs = F.aggregate(places, F.array().cast("array<struct<start:int,stop:int>>"), join)
    return F.aggregate(runs, F.unhex(F.lit("")), lambda acc, r: F.concat(acc, F.substring(content, r["start"] + 1, r["stop"] - r["start"])))


def overwritten(content: Column, pieces: Column, edits: Found) -> Column:
    """The content with bytes of the same number in the places of edits."""
    all_ = F.flatten(F.filter(F.transform(pieces, edits), lambda e: e.isNotNull()))
    return F.aggregate(all_, content, lambda acc, e: F.overlay(acc, e["with"], e["at"] + 1))


def _riff_copy(kept: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    def copy(content: Column, pieces: Column) -> Column:
        body = cut(content, pieces, lambda p: p["kind"].isin(*kept))
        size = F.hex(F.length(body) + 4)
        digits = F.lpad(size, 8, "0")
        little = F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)])
        return F.concat(F.substring(content, 1, 4), F.unhex(little), F.substring(content, 9, 4), body)

    return copy


#: Fixed value: the most pixels of an image.
MOST_PIXELS = 40_000_000


def size_struct(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.struct(width.cast("bigint").alias("width"), height.cast("bigint").alias("height")))


def _first_head(pieces: Column, test: Found) -> Column:
    p = F.try_element_at(F.filter(pieces, test), F.lit(1))
    return F.substring(p["head"], F.lit(1), p["stop"] - p["body"])


def _png_size(content: Column, pieces: Column) -> Column:
    head = _first_head(pieces, lambda p: (p["kind"] == "IHDR") & (p["stop"] - p["body"] >= 12))
    return size_struct(number(head, 0, 4), number(head, 4, 4))


def _jpeg_size(content: Column, pieces: Column) -> Column:
    head = _first_head(pieces, lambda p: p["kind"].isin("c0", "c2"))
    return size_struct(number(head, 3, 2), number(head, 1, 2))


def _gif_size(content: Column, pieces: Column) -> Column:
    return size_struct(number(content, 6, 2, "little"), number(content, 8, 2, "little"))


def _bmp_size(content: Column, pieces: Column) -> Column:
    width, height = (number(content, at, 4, "little") for at in (18, 22))
    return size_struct(*(F.when(n >= 1 << 31, (1 << 32) - n).otherwise(n) for n in (width, height)))


def _psd_size(content: Column, pieces: Column) -> Column:
    width, height = number(content, 18, 4), number(content, 14, 4)
    return F.when((width > 0) & (height > 0), size_struct(width, height))


@dataclass(frozen=True)
class Format:
    piece: Found | None  # the finding of a piece
    copy: Callable[[Column, Column], Column]
    findings: Callable[[Column], Column] | None = None  # of all pieces, where one by one doesn't do
    size: Callable[[Column, Column], Column] | None = None  # width and height, from content and pieces
    sized: bool = False  # a file without width and height is malformed
    same_size: bool = False  # a copy must have those of the original
    holds: Callable[[Column, Column], Column] = field(default=lambda content, pieces: F.lit(0))  # what a copy must hold as the original does
    needs: Callable[[Column, Column], Column] = field(default=lambda content, pieces: F.lit(True))  # what any copy must hold

    def found(self, pieces: Column) -> Column:
        told = self.findings(pieces) if self.findings else F.filter(F.transform(pieces, self.piece), lambda f: f.isNotNull())
        return F.coalesce(told, F.array().cast(f"array<{FINDING}>"))

    def dimensions(self, content: Column, pieces: Column) -> Column:
        return self.size(content, pieces) if self.size else F.lit(None).cast("struct<width:bigint,height:bigint>")


def _png_copy(content: Column, pieces: Column) -> Column:
    return F.concat(F.substring(content, 1, 8), cut(content, pieces, lambda p: p["kind"].isin(*PNG_KEPT)))


def _tiff(name: str) -> Callable:
    """From the module for directories of images, which needs what stands here."""

    def made(*columns: Column) -> Column:
        from metaveil.operators import tiff

        return getattr(tiff, name)(*columns)

    return made


FORMATS = {
    "webp": Format(None, _webp_copy, findings=_webp_findings, size=_webp_size, sized=True),
    "avif": Format(None, _item_copy, findings=_item_findings, size=_item_size, sized=True, needs=lambda c, p: F.exists(p, lambda x: F.startswith(x["kind"], F.lit("primary:")))),
    "ico": Format(None, _icon_copy, findings=_icon_findings, size=_icon_size),
    "mkv": Format(None, lambda c, p: overwritten(c, p, _film_edits), findings=_film_findings),
    "tiff": Format(None, _tiff("copy"), findings=_tiff("findings"), size=_tiff("size"), sized=True, same_size=True, holds=_tiff("has_profile")),
    "png": Format(_png, _png_copy, size=_png_size, sized=True),
    "wav": Format(_wav, _riff_copy(WAV_KEPT)),
    "avi": Format(_avi, lambda c, p: overwritten(c, p, _avi_edits)),
    "flac": Format(_flac, _flac_copy),
    "gif": Format(_gif, _gif_copy, size=_gif_size, sized=True, same_size=True),
    "jpeg": Format(None, _jpeg_copy, findings=_jpeg_findings, size=_jpeg_size, sized=True),
    # an option: the orientation stays
    "jpeg-oriented": Format(None, _oriented_copy, findings=_jpeg_findings, size=_jpeg_size, sized=True),
    "mp3": Format(_mp3, lambda c, p: cut(c, p, lambda x: x["kind"] == "audio")),
    "psd": Format(_psd, _psd_copy, size=_psd_size, same_size=True, holds=lambda c, p: F.exists(p, lambda x: x["kind"] == PSD_PROFILE)),
    "bmp": Format(_bmp, _bmp_copy, size=_bmp_size, sized=True, same_size=True),
    "ogg": Format(_ogg, _ogg_copy),
    # the copy is text again: bytes beyond ASCII become UTF-8
    "rtf": Format(None, lambda c, p: F.encode(cp1252(cut(c, p, lambda x: x["kind"] == "text")), "UTF-8"), findings=_rtf_findings),
    "mp4": Format(None, lambda c, p: overwritten(c, p, _mp4_edits), findings=_mp4_findings),
}


#: Chunks of a PNG that are about colour, and what a profile without a name is called.
COLOUR_CHUNKS, PROFILE = ("iCCP", "sRGB", "gAMA", "cHRM"), "ICC profile"
#: Fixed value: the resource of a layered image that is its profile.
PSD_PROFILE = "8BIM:1039"
PRESERVED = "struct<has_profile:boolean,profile:string,transparent:boolean,colours:array<string>>"


def _preserved(profile: Column, transparent: Column, colours: Column) -> Column:
    return F.struct(profile.isNotNull().alias("has_profile"), profile.alias("profile"), F.coalesce(transparent, F.lit(False)).alias("transparent"), colours.alias("colours"))


def _png_preserved(pieces: Column) -> Column:
    first = F.try_element_at(F.filter(pieces, lambda p: p["kind"] == "iCCP"), F.lit(1))
    name = let(first, lambda p: F.when(p.isNotNull(), F.coalesce(filled(F.regexp_extract(F.decode(F.substring(p["head"], 1, 128), "ISO-8859-1"), "(?s)^([^\0]*)\0", 1)), F.lit(PROFILE))))
    colours = F.transform(F.filter(pieces, lambda p: p["kind"].isin(*COLOUR_CHUNKS)), lambda p: p["kind"])
    return _preserved(name, F.exists(pieces, lambda p: p["kind"] == "tRNS"), colours)


def _jpeg_preserved(pieces: Column) -> Column:
    first = F.try_element_at(F.filter(pieces, lambda p: (p["kind"] == "e2") & (p["stop"] - p["body"] > 12)), F.lit(1))
    return let(first, lambda p: let(F.when(_begins(p, "ICC_PROFILE"), PROFILE), lambda name: _preserved(name, F.lit(False), F.when(name.isNotNull(), F.array(F.lit("ICC Profile (APP2)"))).otherwise(F.array().cast("array<string>")))))


def _webp_preserved(pieces: Column) -> Column:
    header = F.try_element_at(F.filter(pieces, lambda p: p["kind"] == "VP8X"), F.lit(1))
    name = F.when(F.exists(pieces, lambda p: p["kind"] == "ICCP"), "ICC profile (WebP)")
    return _preserved(name, number(header["head"], 0, 1).bitwiseAND(F.lit(0x10)) > 0, F.when(name.isNotNull(), F.array(F.lit("ICCP"))).otherwise(F.array().cast("array<string>")))


def _tiff_preserved(pieces: Column) -> Column:
    return _titled(F.exists(pieces, lambda p: F.startswith(p["kind"], F.lit("entry:")) & (F.split(p["kind"], ":")[2] == "34675")))


def _titled(present: Column) -> Column:
    """What is kept of a profile without a name of its own."""
    return let(F.when(present, PROFILE), lambda name: _preserved(name, F.lit(False), F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))))


def _psd_preserved(pieces: Column) -> Column:
    return _titled(F.exists(pieces, lambda p: p["kind"] == PSD_PROFILE))


def _bmp_preserved(pieces: Column) -> Column:
    body = F.element_at(pieces, 1)["head"]
    return _titled((number(body, 14, 4, "little") >= 108) & (F.substring(body, 71, 4) == F.lit(BMP_EMBEDDED)))


KEEPING = {"png": _png_preserved, "jpeg": _jpeg_preserved, "webp": _webp_preserved, "tiff": _tiff_preserved, "psd": _psd_preserved, "bmp": _bmp_preserved}


def preserved(files: DataFrame, format_id: str) -> DataFrame:
    """files without content, with width, height, has_profile, profile, transparent, colours: what a copy keeps; the same columns for all formats."""
    rows = with_pieces(files, format_id)
    pieces = F.col("pieces")
    nothing = _preserved(F.lit(None).cast("string"), F.lit(format_id == "ico"), F.array().cast("array<string>"))
    told = F.coalesce(F.when(pieces.isNotNull(), KEEPING[format_id](pieces)) if format_id in KEEPING else F.lit(None).cast(PRESERVED), nothing)
    rows = rows.withColumn("_size", FORMATS[format_id].dimensions(F.col("content"), pieces)).withColumn("_kept", told)
    return rows.select(*[c for c in files.columns if c != "content"], F.col("_size.width").alias("width"), F.col("_size.height").alias("height"), "_kept.*")


def register(format_id: str, lister: Callable[[bytes], list], rules: Format) -> None:
    """A format of one's own: lister gives the pieces of a file (kind, depth, start, body, stop) and raises Broken for what is none; rules say what they mean."""
    if format_id in FORMATS:
        raise ValueError(f"{format_id} is there")
    LISTERS[format_id], FORMATS[format_id] = lister, rules


#: The pieces that are the sound, film or image itself, and where in them it begins; the chunk of a WAV is as long as its header says.
MEDIA: dict[str, tuple[Found, Found]] = {
    "mp3": (lambda p: p["kind"] == "audio", lambda p: p["body"]),
    "flac": (lambda p: p["kind"] == "audio", lambda p: p["body"]),
    "wav": (lambda p: (p["kind"] == "data") & (p["depth"] == 0), lambda p: p["body"]),
    "avi": (lambda p: (p["kind"] == "LIST") & _begins(p, "movi"), lambda p: p["body"] + 4),
    "mp4": (lambda p: (p["kind"] == "mdat") & (p["depth"] == 0), lambda p: p["body"]),
    "psd": (lambda p: p["kind"] == "after", lambda p: p["body"]),
    "tiff": (lambda p: p["depth"] == 3, lambda p: p["body"]),
}


def _media(format_id: str) -> Column:
    chosen, begins = MEDIA[format_id]

    def part(p: Column) -> Column:
        stated = number(F.substring(F.col("content"), p["start"] + 5, F.lit(4)), 0, 4, "little")
        stop = F.least(p["stop"].cast("bigint"), p["body"] + stated) if format_id == "wav" else p["stop"]
        return F.hex(F.substring(F.col("content"), begins(p) + 1, (stop - begins(p)).cast("int")))

    digits = F.array_join(F.transform(F.filter("pieces", chosen), part), "")
    return F.sha2(F.unhex(digits), 256)


def media(files: DataFrame, format_id: str) -> DataFrame:
    """files without content, with media_sha256: a digest of what a copy must hold byte for byte; null for files that are broken."""
    others = [c for c in files.columns if c != "content"]
    return with_pieces(files, format_id).select(*others, _media(format_id).alias("media_sha256"))


def media_kept(files: DataFrame, format_id: str) -> DataFrame:
    """files without content, with media_sha256 and copy: a row for the file (copy false) and one for its copy. A file's pieces are listed once for both."""
    others = [c for c in files.columns if c != "content"]
    copies = _cleaned(scan(files, format_id), [F.struct(*others, _media(format_id).alias("sha256")).alias("_own")], format_id).select("_own", "content")
    digest = lambda sha256, copy: F.struct(sha256.alias("media_sha256"), F.lit(copy).alias("copy"))
    both = F.explode(F.array(digest(F.col("_own.sha256"), False), digest(_media(format_id), True))).alias("_m")
    return with_pieces(copies, format_id).select("_own", both).select(*[F.col("_own")[c].alias(c) for c in others], "_m.*")


def of_format(format_id: str | None, make: Callable[[Format], Column]) -> Column:
    """The column that a format makes; without an id, by the column format of each row."""
    if format_id:
        return make(FORMATS[format_id])
    (name, first), *others = FORMATS.items()
    chosen = F.when(F.col("format") == name, make(first))
    for name, other in others:
        chosen = chosen.when(F.col("format") == name, make(other))
    return chosen


def scan(files: DataFrame, format_id: str | None = None, gated: bool = True) -> DataFrame:
    """files (content and others) with pieces, dimensions, reason (malformed, resource-limit or null), status (ok, error) and findings.

    Without an id, the format of each row is in its column format; rows of formats without pieces are malformed. gated: images
    without a size or with too many pixels are refused; images within other files are not.
    """
    content, pieces = F.col("content"), F.col("pieces")
    rows = with_pieces(files, format_id).withColumn("dimensions", of_format(format_id, lambda f: f.dimensions(content, pieces)))
    pixels = F.col("dimensions.width").cast("double") * F.col("dimensions.height")
    missing = of_format(format_id, lambda f: F.lit(f.sized)) & F.col("dimensions").isNull()
    reason = F.when(pieces.isNull() | (missing & gated), "malformed").when((pixels > MOST_PIXELS) & gated, "resource-limit")
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("error"))
    return rows.withColumn("findings", F.coalesce(of_format(format_id, lambda f: f.found(pieces)), F.array().cast(f"array<{FINDING}>")))


def clean(files: DataFrame, format_id: str | None = None, gated: bool = True) -> DataFrame:
    """files with content (the copy, null where there is none), found_before, and dimensions, holds and raw (values) of the original."""
    return _cleaned(scan(files, format_id, gated), [c for c in files.columns if c != "content"], format_id)


def _cleaned(scanned: DataFrame, others: list, format_id: str | None) -> DataFrame:
    content, pieces = F.col("content"), F.col("pieces")
    copy = F.when(F.col("status") == "ok", of_format(format_id, lambda f: f.copy(content, pieces)))
    told = personal(F.col("findings"))
    return scanned.select(
        *others, copy.alias("content"), F.size(told).cast("bigint").alias("found_before"), "dimensions", "reason",
        of_format(format_id, lambda f: f.holds(content, pieces).cast("int")).alias("holds"), F.filter(F.transform(told, lambda f: f["value"]), lambda v: v.isNotNull()).alias("raw"),
    )


def personal(findings: Column) -> Column:
    return F.filter(findings, lambda f: ~f["field"].isin(*TECHNICAL))


def clean_and_verify(files: DataFrame, format_id: str | None = None, gated: bool = True) -> DataFrame:
    """files without content, with status, reason, clean, found_before, raw, remaining, passed: the copy's pieces are listed anew.

    A copy passes if nothing personal is found in it, its pieces are whole, and it has the size and profile that its format must keep.
    """
    content, pieces = F.col("content"), F.col("pieces")
    again = with_pieces(clean(files, format_id, gated), format_id)
    remaining = F.when(content.isNotNull(), F.size(personal(of_format(format_id, lambda f: f.found(pieces)))).cast("bigint"))
    same = of_format(format_id, lambda f: F.coalesce(f.dimensions(content, pieces) == F.col("dimensions"), F.col("dimensions").isNull()) if f.same_size else F.lit(True))
    held = of_format(format_id, lambda f: f.holds(content, pieces).cast("int")) >= F.col("holds")
    whole = of_format(format_id, lambda f: f.needs(content, pieces))
    passed = content.isNotNull() & pieces.isNotNull() & (remaining == 0) & same & held & whole
    others = [c for c in files.columns if c not in ("content", "reason")]
    return again.select(
        *others, F.when(content.isNull(), "error").otherwise("ok").alias("status"), "reason", content.alias("clean"), "found_before", "raw", remaining.alias("remaining"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )
