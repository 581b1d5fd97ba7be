"""Queries over binary formats: pages as files of each kind, their findings and cleaned copies, and DuckDB SQL for both.

A sample says how a file is put together: SQL text that both engines run over the bytes' hexadecimal digits. The SQL for DuckDB
puts the copy together from the parts that must stay, and states the findings from the page's columns; it parses nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import binary, findings
from metaveil.operators.findings import TECHNICAL


class Digits:
    """Hexadecimal digits as SQL text of one engine."""

    def __init__(self, encoded: str, length: str):
        self.encoded, self.length = encoded, length

    def of(self, column: str) -> str:
        return f"hex({self.encoded.format(column)})"

    def size(self, column: str, plus: int = 0) -> str:
        return f"({self.length.format(column)} + {plus})"

    @staticmethod
    def text(text: str) -> str:
        return "'" + text.encode("latin-1").hex().upper() + "'"

    @staticmethod
    def big(number: str | int, size: int = 4) -> str:
        return f"lpad(hex(CAST({number} AS BIGINT)), {2 * size}, '0')"

    @classmethod
    def little(cls, number: str | int, size: int = 4) -> str:
        return "(" + " || ".join(f"substr({cls.big(number, size)}, {2 * k - 1}, 2)" for k in range(size, 0, -1)) + ")"


SPARK = Digits("encode({}, 'UTF-8')", "octet_length({})")
DUCK = Digits("encode({})", "strlen({})")
Parts = Callable[[Digits], list[str]]


@dataclass(frozen=True)
class Sample:
    file: Parts
    copy: Parts | None  # None: the format is scanned only
    #: category, field, label, value (SQL), severity
    findings: tuple[tuple[str, str, str, str, str], ...]


def _chunk(d: Digits, name: str, body: str, size: str | int) -> str:
    return f"{d.big(size)} || {d.text(name)} || {body} || '00000000'"


PNG_START = "'89504E470D0A1A0A' || '0000000D4948445200000001000000020802000000' || '00000000'"
PNG_END = "'0000000049454E44AE426082'"


def _png_image(d: Digits) -> str:
    return _chunk(d, "IDAT", d.of("html"), d.size("html"))


def _riff(d: Digits, kind: str, parts: list[tuple[str, str]]) -> list[str]:
    """parts: digits and number of bytes."""
    return [d.text("RIFF"), d.little(" + ".join(["4", *(n for _, n in parts)])), d.text(kind), *(p for p, _ in parts)]


def _even(d: Digits, name: str, column: str) -> tuple[str, str]:
    """A chunk of a column's bytes, padded."""
    n = d.size(column)
    return f"{d.text(name)} || {d.little(n)} || {d.of(column)} || (CASE WHEN {n} % 2 = 1 THEN '00' ELSE '' END)", f"8 + {n} + {n} % 2"


def _list(d: Digits) -> tuple[str, str]:
    inner, n = _even(d, "IART", "url")
    return f"{d.text('LIST')} || {d.little(f'4 + {n}')} || {d.text('INFO')} || {inner}", f"12 + {n}"


def _fmt(d: Digits) -> tuple[str, str]:
    return f"{d.text('fmt ')} || {d.little(16)} || repeat('01', 16)", "24"


def _flac_info(last: bool) -> str:
    return f"'{'80' if last else '00'}000022' || repeat('00', 34)"


def _flac_comments(d: Digits) -> str:
    return f"'84' || {d.big(f'4 + 3 + 4 + 4 + 7 + {d.size("url")}', 3)} || {d.little(3)} || {d.text('enc')} || {d.little(1)} || {d.little(d.size('url', 7))} || {d.text('ARTIST=')} || {d.of('url')}"


GIF_START = "'474946383961' || '01000100000000'"
GIF_IMAGE = "'2C00000000010001000002' || '0144' || '00'"


def _segment(d: Digits, marker: str, body: str, size: str | int) -> str:
    return f"'{marker}' || {d.big(f'{size} + 2', 2)} || {body}"


def _exif(d: Digits) -> str:
    tag = f"'3B010200' || {d.little(d.size('url', 1))} || {d.little(26)}"
    return _segment(d, "FFE1", f"{d.text('Exif')} || '0000' || '49492A0008000000' || '0100' || {tag} || '00000000' || {d.of('url')} || '00'", d.size("url", 6 + 26 + 1))


def _jpeg_image(d: Digits) -> str:
    return f"{_segment(d, 'FFDB', "'00' || repeat('01', 64)", 65)} || 'FFC0000B080001000101011100' || 'FFDA0002' || {d.of('html')}"


def _id3(d: Digits) -> str:
    n = d.size("url", 11)  # well below 128 * 128
    frame = f"{d.text('TPE1')} || {d.big(d.size('url', 1))} || '0000' || '03' || {d.of('url')}"
    return f"{d.text('ID3')} || '030000' || '0000' || lpad(hex(CAST(floor({n} / 128) AS BIGINT)), 2, '0') || lpad(hex(CAST({n} % 128 AS BIGINT)), 2, '0') || {frame}"


PSD_START = "'384250530001' || repeat('00', 6) || '0003000000010000000200080003' || '00000000'"
PSD_PROFILE = "'3842494D040F0000' || '00000002' || 'AABB'"


def _iptc(d: Digits) -> tuple[str, str]:
    n = d.size("url")
    return f"'3842494D04040000' || {d.big(n)} || {d.of('url')} || (CASE WHEN {n} % 2 = 1 THEN '00' ELSE '' END)", f"12 + {n} + {n} % 2"


def _box(d: Digits, name: str, body: str, size: str | int) -> str:
    return f"{d.big(f'8 + {size}')} || {d.text(name)} || {body}"


def _movie(d: Digits, cleaned: bool) -> str:
    stamp = "00000000" if cleaned else f"{2082844800 + 1704164645:08X}"
    header = _box(d, "mvhd", f"'00000000{stamp}{stamp}' || repeat('00', 12)", 24)
    atom = _box(d, "\xa9nam", f"{d.big(d.size('url'), 2)} || '0000' || {d.of('url')}", d.size("url", 4))
    user = f"{d.big(d.size('url', 20))} || {d.text('free')} || repeat('00', CAST({d.size('url', 12)} AS INT))" if cleaned else _box(d, "udta", atom, d.size("url", 12))
    return _box(d, "moov", f"{header} || {user}", d.size("url", 32 + 20))


def _bitmap(d: Digits, space: str, place: int, size: int) -> list[str]:
    """A header of one pixel, from its width on."""
    return [d.little(1), d.little(1), "'01001800'", d.little(0), d.little(0), "repeat('00', 16)", "repeat('00', 16)", d.text(space), "repeat('00', 36)", "repeat('00', 12)", d.little(0), d.little(place), d.little(size), d.little(0)]


MP4_START = "'0000001066747970' || '69736F6D00000000'"

def _tiff_entry(d: Digits, tag: int, kind: int, count: int | str, value: str) -> str:
    return f"{d.little(tag, 2)} || {d.little(kind, 2)} || {d.little(count)} || {value}"


def _tiff_image(d: Digits, at: int | str) -> list[str]:
    return [_tiff_entry(d, 256, 3, 1, d.little(1)), _tiff_entry(d, 257, 3, 1, d.little(1)), _tiff_entry(d, 273, 4, 1, d.little(at)), _tiff_entry(d, 278, 3, 1, d.little(1)), _tiff_entry(d, 279, 4, 1, d.little(d.size("html")))]


def _checksum(page: bytes) -> str:
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc.to_bytes(4, "little").hex().upper()


OGG_CHECKSUM = _checksum(b"OggS" + bytes(22) + b"\x01\x10OpusTags" + bytes(8))
def _element(d: Digits, ident: str, body: str, size: int | str) -> str:
    """An element whose size has eight bytes."""
    return f"'{ident}01' || {d.big(size, 7)} || {body}"


def _film(d: Digits, cleaned: bool) -> list[str]:
    blank = lambda size: f"repeat('00', CAST({size} AS INT))"
    # an element of ten bytes of header and a text becomes one of nothing: two bytes of header up to 127, else more
    url, short = d.size("url", 10), d.size("url", 8)
    void = f"'EC' || (CASE WHEN {short} <= 126 THEN {d.big(f'{short} + 128', 1)} || {blank(short)} ELSE {d.big(f'{short} - 1 + 16384', 2)} || {blank(f'{short} - 1')} END)"
    info = [void if cleaned else _element(d, "7BA9", d.of("url"), d.size("url")), _element(d, "5741", "'00000000'" if cleaned else d.text("Edit"), 4), _element(d, "2AD7B1", "'0F4240'", 3)]
    tags = "'EC91' || repeat('00', 17)" if cleaned else _element(d, "1254C367", d.text("tagtags"), 7)
    inner = f"{_element(d, '1549A966', ' || '.join(info), f'{url} + 14 + 14')} || {tags} || {_element(d, '1F43B675', d.of('html'), d.size('html'))}"
    return [_element(d, "1A45DFA3", _element(d, "4282", d.text("webm"), 4), 14), _element(d, "18538067", inner, f"12 + {url} + 28 + 19 + 12 + {d.size('html')}")]


def _webp(d: Digits, cleaned: bool) -> list[str]:
    """An extended header with a profile, then the image, then what describes it."""
    packet = f"{d.text('<dc:creator> <rdf:Seq><rdf:li>')} || {d.of('url')} || {d.text('</rdf:li>')}"
    n = d.size("url", 30 + 9)
    pad = lambda n: f"(CASE WHEN {n} % 2 = 1 THEN '00' ELSE '' END)"
    parts = [(f"{d.text('VP8X')} || {d.little(10)} || '{'20' if cleaned else '2C'}000000' || '630000' || 'C70000'", "18"), (f"{d.text('ICCP')} || {d.little(3)} || '01020300'", "12"), _even(d, "VP8 ", "html")]
    if not cleaned:
        parts += [(f"{d.text('EXIF')} || {d.little(9)} || repeat('41', 9) || '00'", "18"), (f"{d.text('XMP ')} || {d.little(n)} || {packet} || {pad(n)}", f"8 + {n} + {n} % 2")]
    return _riff(d, "WEBP", parts)


def _icon(d: Digits, cleaned: bool) -> list[str]:
    """A PNG image with its author, a bitmap, and bytes behind both."""
    author = "" if cleaned else _chunk(d, "tEXt", f"{d.text('Author')} || '00' || {d.of('url')}", d.size("url", 7)) + " || "
    size = d.size("html", 8 + 25 + 12 + 12) if cleaned else f"({d.size('html', 8 + 25 + 12 + 12)} + {d.size('url', 7 + 12)})"
    png = f"{PNG_START} || {author}{_png_image(d)} || {PNG_END}"
    return ["'000001000200'", "'1010000001002000'", d.little(size), d.little(38), "'0000000001002000'", d.little(4), d.little(f"38 + {size}"), png, "'28000000'", "''" if cleaned else d.text("tail")]


def _photograph(d: Digits) -> tuple[str, str]:
    """A directory of tags with the author, and how long it is."""
    return f"'49492A0008000000' || '0100' || {_tiff_entry(d, 315, 2, d.size('url', 1), d.little(26))} || '00000000' || {d.of('url')} || '00'", d.size("url", 27)


def _items(d: Digits, cleaned: bool) -> list[str]:
    """An image, its tags and its XMP as items: 243 bytes of description, then the data, from byte 271 on."""
    exif, packet, mime = _photograph(d), d.text("<x:xmpmeta/>"), d.text("application/xmp+xml")
    full = lambda name, body, size: _box(d, name, f"'00000000' || {body}", f"4 + {size}")
    item = lambda ident, kind: _box(d, "infe", f"'02000000' || {d.big(ident, 2)} || '0000' || {d.text(kind)} || '00'", 13)
    place = lambda ident, at, size: f"{d.big(ident, 2)} || '0000' || '0001' || {d.big(at)} || {d.big(size)}"
    described = _box(d, "infe", f"'02000000' || {d.big(3, 2)} || '0000' || {d.text('mime')} || '00' || {mime} || '00'", 33)
    at = d.size("html", 271)
    places = [place(1, 271, d.size("html")), place(2, at, f"4 + {exif[1]}"), place(3, f"{at} + 4 + {exif[1]}", 12)]
    size = _box(d, "iprp", _box(d, "ipco", full("ispe", f"{d.big(64)} || {d.big(48)}", 8), 20), 28)
    if cleaned:
        boxes = [full("pitm", d.big(1, 2), 2), full("iinf", f"{d.big(1, 2)} || {item(1, 'av01')}", 23), full("iloc", f"'4400' || {d.big(1, 2)} || {places[0]}", 18), full("iref", "''", 0), size, _box(d, "free", "repeat('00', 96)", 96)]
    else:
        refs = _box(d, "cdsc", "'000200010001'", 6)
        boxes = [
            full("pitm", d.big(1, 2), 2), full("iinf", f"{d.big(3, 2)} || {item(1, 'av01')} || {item(2, 'Exif')} || {described}", 85), full("iloc", f"'4400' || {d.big(3, 2)} || {' || '.join(places)}", 46),
            full("iref", refs, 14), size,
        ]
    data = f"repeat('00', CAST(4 + {exif[1]} + 12 AS INT))" if cleaned else f"'00000000' || {exif[0]} || {packet}"
    return [_box(d, "ftyp", f"{d.text('avif')} || '00000000' || {d.text('mif1')}", 12), full("meta", " || ".join(boxes), 231), _box(d, "mdat", f"{d.of('html')} || {data}", f"{d.size('html')} + 4 + {exif[1]} + 12")]


TIFF_START = "'49492A0008000000'"

SAMPLES = {
    "avif": Sample(
        lambda d: _items(d, False), lambda d: _items(d, True),
        (("containers", "AVIF:Exif", "EXIF data", "'Present'", "medium"), ("author", "AVIF:Artist", "Artist", "url", "high"), ("containers", "AVIF:XMP", "XMP metadata", "'Present'", "medium")),
    ),
    "webp": Sample(
        lambda d: _webp(d, False), lambda d: _webp(d, True),
        (
            ("containers", "WebP:EXIF", "EXIF metadata", "'9 bytes'", "high"), ("containers", "WebP:XMP", "XMP metadata", "strlen(url) + 39 || ' bytes'", "medium"), ("author", "WebP:XMP:Creator", "Author (XMP)", "url", "high"),
            ("other", "WebP:ICCP", "ICC profile", "'ICC profile (WebP)'", "low"),
        ),
    ),
    "ico": Sample(
        lambda d: _icon(d, False), lambda d: _icon(d, True),
        (("author", "ICO:0:PNG:tEXt:Author", "Author (icon 1)", "left(url, 200)", "high"), ("other", "ICO:TrailingData", "Trailing data after icon payloads", "'4 bytes'", "medium")),
    ),
    "mkv": Sample(
        lambda d: _film(d, False), lambda d: _film(d, True),
        (("other", "MKV:Title", "Title", "url", "medium"), ("software", "MKV:WritingApp", "Writing application", "'Edit'", "medium"), ("containers", "MKV:Tags", "Tags element", "'Present'", "medium")),
    ),
    "tiff": Sample(
        lambda d: [
            TIFF_START, d.little(9, 2), *_tiff_image(d, d.size("url", 123)), _tiff_entry(d, 315, 2, d.size("url", 1), d.little(122)), _tiff_entry(d, 316, 2, 4, "'6D616300'"),
            _tiff_entry(d, 700, 1, 4, "'3C782F3E'"), _tiff_entry(d, 65000, 4, 1, d.little(5)), d.little(0), d.of("url"), "'00'", d.of("html"),
        ],
        lambda d: [TIFF_START, d.little(5, 2), *_tiff_image(d, 74), d.little(0), d.of("html"), f"(CASE WHEN {d.size('html')} % 2 = 1 THEN '00' ELSE '' END)"],
        (
            ("author", "TIFF:Artist", "Artist", "url", "high"), ("device", "TIFF:Host computer", "Host computer", "'mac'", "high"),
            ("containers", "TIFF:XMP metadata", "XMP metadata", "'Present'", "medium"), ("other", "TIFF:UnknownTags", "Private/unknown TIFF tags", "'1'", "medium"),
        ),
    ),
    "png": Sample(
        lambda d: [PNG_START, _chunk(d, "tEXt", f"{d.text('Author')} || '00' || {d.of('url')}", d.size("url", 7)), _chunk(d, "tIME", "'07E80102030405'", 7), _png_image(d), PNG_END],
        lambda d: [PNG_START, _png_image(d), PNG_END],
        (("author", "PNG:tEXt:Author", "Author", "left(url, 200)", "high"), ("dates", "PNG:tIME", "Last modification time", "'2024-01-02 03:04:05'", "high")),
    ),
    "wav": Sample(
        lambda d: _riff(d, "WAVE", [_fmt(d), _list(d), _even(d, "data", "html")]),
        lambda d: _riff(d, "WAVE", [_fmt(d), _even(d, "data", "html")]),
        (("author", "WAV:IART", "Artist", "url", "high"),),
    ),
    "avi": Sample(
        lambda d: _riff(d, "AVI ", [_list(d), _even(d, "movi", "html")]),
        lambda d: _riff(d, "AVI ", [(f"{d.text('JUNK')} || {d.little(f'4 + {_even(d, "IART", "url")[1]}')} || repeat('00', CAST(4 + {_even(d, 'IART', 'url')[1]} AS INT))", _list(d)[1]), _even(d, "movi", "html")]),
        (("author", "AVI:IART", "Artist", "url", "high"),),
    ),
    "flac": Sample(
        lambda d: [d.text("fLaC"), _flac_info(False), _flac_comments(d), d.of("html")],
        lambda d: [d.text("fLaC"), _flac_info(True), d.of("html")],
        (("software", "FLAC:vendor", "Encoder vendor", "'enc'", "medium"), ("author", "FLAC:ARTIST", "Artist", "url", "medium")),
    ),
    "gif": Sample(
        lambda d: [GIF_START, f"'21FE' || {d.big(d.size('url'), 1)} || {d.of('url')} || '00'", "'21FF0B' || " + d.text("MGK8BIM0000") + " || '03010000' || '00'", GIF_IMAGE, "'3B'"],
        lambda d: [GIF_START, GIF_IMAGE, "'3B'"],
        (("other", "GIF:Comment", "GIF comment", "left(url, 180)", "medium"), ("software", "GIF:App:MGK8BIM0000", "Application extension (MGK8BIM0000)", "'Present'", "medium")),
    ),
    "jpeg": Sample(
        lambda d: ["'FFD8'", _exif(d), _segment(d, "FFFE", d.of("url"), d.size("url")), _jpeg_image(d), "'FFD9'"],
        lambda d: ["'FFD8'", _jpeg_image(d), "'FFD9'"],
        (("author", "EXIF:Artist", "Artist", "url", "high"), ("other", "JPEG:Comment", "JPEG comment", "url", "medium")),
    ),
    "mp3": Sample(
        lambda d: [_id3(d), "'FFFB9000'", d.of("html"), d.text("TAG") + " || '41' || repeat('00', 124)"],
        lambda d: ["'FFFB9000'", d.of("html")],
        (("author", "MP3:TPE1", "Artist", "url", "medium"), ("containers", "MP3:ID3v1", "ID3v1 tag", "'A'", "medium")),
    ),
    "psd": Sample(
        lambda d: [PSD_START, d.big(f"14 + {_iptc(d)[1]}"), _iptc(d)[0], PSD_PROFILE, d.of("html")],
        lambda d: [PSD_START, d.big(14), PSD_PROFILE, d.of("html")],
        (("containers", "PSD:0x404", "IPTC metadata", "'Present'", "high"),),
    ),
    "bmp": Sample(
        lambda d: [d.text("BM"), d.little(0), "'00000000'", d.little(147), d.little(124), *_bitmap(d, "KNIL", 124, 9), d.text("/a/prof"), "'0000'", "repeat('11', 4)", d.of("html")],
        lambda d: [d.text("BM"), d.little(147 + 4), "'00000000'", d.little(147), d.little(124), *_bitmap(d, "BGRs", 0, 0), "repeat('00', 9)", "repeat('11', 4)"],
        (("other", "BMP:LinkedProfile", "Linked colour profile path", "'/a/prof'", "high"), ("other", "BMP:TrailingData", "Trailing data after pixel data", "strlen(html) || ' bytes'", "medium")),
    ),
    "ogg": Sample(
        lambda d: [
            d.text("OggS"), "repeat('00', 22)", "'01'", "'13'", d.text("OpusHead"), "repeat('00', 11)",
            d.text("OggS"), "repeat('00', 22)", "'01'", d.big(d.size("url", 8 + 4 + 3 + 4 + 4 + 8), 1), d.text("OpusTags"), d.little(3), d.text("enc"), d.little(1), d.little(d.size("url", 8)), d.text("contact="), d.of("url"),
            d.text("OggS"), "repeat('00', 22)", "'01'", "'05'", d.text("audio"),
        ],
        lambda d: [
            d.text("OggS"), "repeat('00', 22)", "'01'", "'13'", d.text("OpusHead"), "repeat('00', 11)",
            # the checksum of the page with an empty comment packet
            d.text("OggS"), "repeat('00', 18)", f"'{OGG_CHECKSUM}'", "'01'", "'10'", d.text("OpusTags"), "repeat('00', 8)",
            d.text("OggS"), "repeat('00', 22)", "'01'", "'05'", d.text("audio"),
        ],
        (("software", "OGG:vendor", "Encoder vendor", "'enc'", "medium"), ("author", "OGG:CONTACT", "Contact", "url", "high")),
    ),
    "rtf": Sample(
        lambda d: [d.text("{\\rtf1 "), d.text("{\\info{\\author "), d.of("url"), d.text("}{\\creatim\\yr2024\\mo3\\dy7}\\edmins12}"), d.text("{\\*\\generator Msftedit 5;}"), d.of("page_id_text"), d.text("}")],
        lambda d: [d.text("{\\rtf1 "), d.of("page_id_text"), d.text("}")],
        (
            ("author", "RTF:author", "Author", "url", "high"), ("dates", "RTF:creatim", "Creation date", "'2024-03-07'", "high"),
            ("dates", "RTF:edmins", "Total editing time (minutes)", "'12'", "low"), ("software", "RTF:generator", "Generator application", "'Msftedit 5'", "medium"),
        ),
    ),
    "mp4": Sample(
        lambda d: [MP4_START, _movie(d, False), _box(d, "mdat", d.of("html"), d.size("html"))],
        lambda d: [MP4_START, _movie(d, True), _box(d, "mdat", d.of("html"), d.size("html"))],
        (("other", "MP4:cnam", "Title", "url", "medium"), ("dates", "MP4:created", "Creation date", "'2024-01-02T03:04:05Z'", "high")),
    ),
}


def files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    digits = " || ".join(SAMPLES[kind].file(SPARK))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("page_id_text", F.col("page_id").cast("string"))
    return pages.select(F.col("page_id").alias("file_id"), F.unhex(F.expr(digits)).alias("content"))


def _findings(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings.explode(binary.scan(files(spark, sf_dir, kind), kind)).select("file_id", "pos", "category", "field", "label", "value", "severity")

    query.__name__ = f"{kind}_findings"
    return query


def _verified(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = binary.clean_and_verify(files(spark, sf_dir, kind), kind)
        return done.select("file_id", "status", F.sha2("clean", 256).alias("clean_sha256"), "found_before", "remaining", "passed")

    query.__name__ = f"{kind}_clean_verify"
    return query


def _findings_sql(sample: Sample) -> str:
    rows = [f"SELECT page_id AS file_id, CAST({k} AS INTEGER) AS pos, '{c}' AS category, '{f}' AS field, '{n}' AS label, {v} AS value, '{s}' AS severity FROM pages" for k, (c, f, n, v, s) in enumerate(sample.findings)]
    return " UNION ALL ".join(rows)


def _verified_sql(sample: Sample) -> str:
    digits = " || ".join(sample.copy(DUCK))
    return f"SELECT page_id AS file_id, 'ok' AS status, sha256(unhex({digits})) AS clean_sha256, CAST({sum(f[1] not in TECHNICAL for f in sample.findings)} AS BIGINT) AS found_before, CAST(0 AS BIGINT) AS remaining, true AS passed FROM (SELECT *, CAST(page_id AS VARCHAR) AS page_id_text FROM pages)"


CLEANED = [kind for kind, sample in SAMPLES.items() if sample.copy]
QUERIES = {f.__name__: f for f in (*map(_findings, SAMPLES), *map(_verified, CLEANED))}
ORACLE = {f"{kind}_findings": _findings_sql(s) for kind, s in SAMPLES.items()} | {f"{kind}_clean_verify": _verified_sql(SAMPLES[kind]) for kind in CLEANED}
