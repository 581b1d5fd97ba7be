"""The pieces that a binary file consists of: one array of (kind, depth, start, body, stop, head) for each file.

A container is described by a Layout, and one walker goes through all of them; images with other structures have a lister of
their own. Tasks only list places here: what a piece means, and whether it stays, is decided by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a piece's body that its head holds.
HEAD = 1024
#: Pieces that are read whole: groups of text.
WHOLE = {"info", "generator"}
PIECE = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("start", T.IntegerType()),
        T.StructField("body", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("head", T.BinaryType()),
    ]
)
Piece = tuple[str, int, int, int, int]
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of content that a task goes through at a time, if a file isn't larger: what it makes of them is several times as large.
PART = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Tasks get batches of two parts, unless the session says otherwise."""
    if spark.conf.get(BATCH) == "67108864b":  # as Spark has it
        spark.conf.set(BATCH, str(2 * PART))


def in_parts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut behind every PART bytes of their column at: memory doesn't grow with what a session puts in a batch."""
    for batch in batches:
        first = size = 0
        for k, length in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
            size += length or 0
            if size >= PART:
                yield batch.slice(first, k + 1 - first)
                first, size = k + 1, 0
        if first < batch.num_rows:
            yield batch.slice(first)


class Broken(Exception):
    """The bytes don't have the structure of their format."""


@dataclass(frozen=True)
class Layout:
    """A sequence of pieces with a name and a size in their header."""

    first: int  # where the first piece starts
    name: tuple[int, int]  # place and length in the header
    size: tuple[int, int, str]  # place, length, byte order
    header: int
    tail: int = 0  # bytes after the body that the size leaves out
    even: bool = False  # odd bodies are padded
    whole: bool = False  # the size counts the header
    last: str = ""  # the kind after which nothing is read
    strict: bool = True  # a piece that is too long breaks the file; else it ends the list


LAYOUTS = {
    "png": Layout(8, (4, 4), (0, 4, "big"), 8, tail=4, last="IEND", strict=False),
    "wav": Layout(12, (0, 4), (4, 4, "little"), 8, even=True),
    "avi": Layout(12, (0, 4), (4, 4, "little"), 8, even=True, strict=False),
    "webp": Layout(12, (0, 4), (4, 4, "little"), 8, even=True, strict=False),
    "mp4": Layout(0, (4, 4), (0, 4, "big"), 8, whole=True, strict=False),
}


def walk(data: bytes, layout: Layout, first: int | None = None, end: int | None = None, depth: int = 0) -> list[Piece]:
    found, at, end = [], layout.first if first is None else first, len(data) if end is None else end
    while at + layout.header + layout.tail <= end:
        place, length, order = layout.size
        size = int.from_bytes(data[at + place : at + place + length], order)
        name = data[at + layout.name[0] : at + sum(layout.name)].decode("latin-1")
        body = at + layout.header
        if layout.whole and size == 1:  # the size stands behind the name
            if body + 8 > end:
                break
            size, body = int.from_bytes(data[body : body + 8], "big"), body + 8
        if layout.whole and size == 0:  # to the end of the file
            stop = end
        else:
            stop = at + size if layout.whole else body + size + layout.tail
        if stop > end or stop < body:
            if layout.strict:
                raise Broken(name)
            break
        found.append((name, depth, at, body, stop))
        at = stop + 1 if layout.even and stop % 2 and stop < end else stop
        found[-1] = (*found[-1][:4], at)
        if name == layout.last:
            break
    return found


def _png(data: bytes) -> list[Piece]:
    return [("signature", 1, 0, 0, 8), *((k, d, s, b, e) for k, d, s, b, e in walk(data, LAYOUTS["png"]))]


def _riff(name: str) -> Callable[[bytes], list[Piece]]:
    def pieces(data: bytes) -> list[Piece]:
        found = []
        for piece in walk(data, LAYOUTS[name]):
            kind, _, start, body, stop = piece
            found.append(piece)
            if kind == "LIST":
                inner = Layout(0, (0, 4), (4, 4, "little"), 8, even=True, strict=False)
                size = int.from_bytes(data[start + 4 : start + 8], "little")
                if data[body : body + 4] == b"INFO":
                    found += [(f"INFO:{k}", 1, s, b, min(e, b + int.from_bytes(data[s + 4 : s + 8], "little"))) for k, _, s, b, e in walk(data, inner, body + 4, body + size)]
        return found

    return pieces


def _wav(data: bytes) -> list[Piece]:
    found = _riff("wav")(data)
    if not {"fmt ", "data"} <= {p[0] for p in found}:
        raise Broken("no sound")
    return found


def _comments(data: bytes, at: int, stop: int) -> Iterator[Piece]:
    """Vendor and entries of a comment block: each a length and its text."""
    left = 1
    for n in range(1 << 31):
        if at + 4 > stop or not left:
            return
        size = int.from_bytes(data[at : at + 4], "little")
        if n == 1:
            left, at = size + 1, at + 4
        else:
            if n and at + 4 + size > stop:
                return
            yield "comment" if n else "vendor", 1, at, at + 4, min(at + 4 + size, stop)
            at += 4 + size
        left -= n > 1


def _flac(data: bytes) -> list[Piece]:
    found, at, more = [], 4, True
    while more:
        if at + 4 > len(data):
            raise Broken("block header")
        stop = at + 4 + int.from_bytes(data[at + 1 : at + 4], "big")
        if stop > len(data):
            raise Broken("block")
        kind, more = str(data[at] & 127), data[at] < 128
        found.append((kind, 0, at, at + 4, stop))
        if kind == "4":
            found += _comments(data, at + 4, stop)
        at = stop
    if found[0][0] != "0":
        raise Broken("no stream information")
    return [*found, ("audio", 0, at, at, len(data))]


def _after_blocks(data: bytes, at: int) -> int:
    while at < len(data):
        size = data[at]
        at += 1 + size
        if not size:
            break
    return at


def _gif(data: bytes) -> list[Piece]:
    def table(flags: int) -> int:
        return 6 << (flags & 7) if flags & 128 else 0

    if len(data) < 13 or 13 + table(data[10]) > len(data):
        raise Broken("header")
    at = 13 + table(data[10])
    found: list[Piece] = [("prefix", 0, 0, 6, at)]
    kinds = {0xFE: "comment", 0xF9: "graphic-control", 0x01: "plain-text"}
    while at < len(data):
        start = at
        if data[at] == 0x3B:
            return [*found, ("trailer", 0, at, at, at + 1)]
        if data[at] == 0x2C and at + 10 <= len(data):
            at = _after_blocks(data, at + 11 + table(data[at + 9]))
            found.append(("image", 0, start, start + 10, at))
        elif data[at] == 0x21 and at + 2 <= len(data):
            label, at = data[at + 1], _after_blocks(data, at + 2)
            kind = kinds.get(label, "application" if label == 0xFF else f"label 0x{label:x}")
            found.append((kind, 0, start, start + 2, at))
        else:
            raise Broken("introducer")
    return found


def _jpeg(data: bytes) -> list[Piece]:
    """Header segments by their marker's hexadecimal digits; from the first scan on, all is one piece (depth 0) and, for the scanner alone, segments (depth 2)."""
    found: list[Piece] = [("soi", 0, 0, 2, 2)]
    at = 2
    while at < len(data) - 1:
        if data[at] != 0xFF:
            at += 1
            continue
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at == len(data):
            break
        marker, at = data[at], at + 1
        if marker == 0:
            continue
        if marker == 0xDA:
            return [*found, ("da", 0, start, at, len(data)), *_behind_scans(data, at)]
        if marker == 0xD9:
            return [*found, ("d9", 0, start, at, at)]
        if 0xD0 <= marker <= 0xD8 or marker == 1:
            found.append((f"{marker:02x}", 0, start, at, at))
            continue
        stop = at + int.from_bytes(data[at : at + 2], "big")
        if at + 2 > len(data) or stop < at + 2 or stop > len(data):
            break
        found.append((f"{marker:02x}", 0, start, at + 2, stop))
        at = stop
    return [*found, ("unfinished", 0, at, at, len(data))]


#: Where coded image data end: a marker that neither is a stuffed byte, nor restarts it, nor fills.
_CODED_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


def _behind_scans(data: bytes, at: int) -> Iterator[Piece]:
    """Segments that follow the coded data of scans, up to the end of the image. at: behind the marker of the first scan."""
    while at + 2 <= len(data):
        size = int.from_bytes(data[at : at + 2], "big")
        coded = _CODED_END.search(data, at + size) if size >= 2 else None
        while coded and coded[0][1] != 0xDA:
            start, marker = coded.start(), coded[0][1]
            if marker == 0xD9:
                return
            if marker == 0xD8:
                coded = _CODED_END.search(data, start + 2)
                continue
            stop = start + 2 + int.from_bytes(data[start + 2 : start + 4], "big")
            if stop < start + 4 or stop > len(data):
                return
            yield f"{marker:02x}", 2, start, start + 4, stop
            coded = re.compile(rb"\xff[^\xd0-\xd7]", re.S).search(data, stop)
        if not coded:
            return
        at = coded.start() + 2


#: Bytes of one value of each TIFF type.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tags(data: bytes, tiff: int, at: int, order: str, folder: str = "IFD0") -> Iterator[Piece]:
    """The entries of a TIFF directory and, after their pointers, of those inside: tag:directory:number:type:count:byte order."""

    def number(place: int, size: int) -> int:
        return int.from_bytes(data[place : place + size], order)

    if at < 0 or at >= len(data) - 2 or at + 2 + 12 * number(at, 2) > len(data):
        return
    for entry in range(at + 2, at + 2 + 12 * number(at, 2), 12):
        tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
        size = TYPE_SIZES.get(kind, 0) * count
        body = entry + 8 if size <= 4 else tiff + number(entry + 8, 4)
        if folder == "GPS" and body >= len(data):
            continue
        yield f"tag:{folder}:{tag}:{kind}:{count}:{order}", 1, entry, min(body, len(data)), min(body + size, len(data))
        inner = {0x8769: "EXIF", 0x8825: "GPS"}.get(tag)
        if inner and kind == 4 and folder == "IFD0":
            yield from tags(data, tiff, tiff + number(entry + 8, 4), order, inner)
    if folder == "GPS":  # where what the directory tells together stands
        yield "gps", 1, at, at, at


def _jpeg_with_tags(data: bytes) -> list[Piece]:
    """Segments, the tags of the first APP1 and, of each APP1, the place of an image within it."""
    found = []
    for piece in _jpeg(data):
        found.append(piece)
        kind, _, _, body, stop = piece
        if kind != "e1":
            continue
        if not any(k == "e1" for k, *_ in found[:-1]) and data[body : body + 4] == b"Exif" and body + 14 <= len(data):
            order = "little" if data[body + 6 : body + 8] == b"II" else "big"
            found += tags(data, body + 6, body + 6 + int.from_bytes(data[body + 10 : body + 14], order), order)
        inner = data.find(b"\xff\xd8", body + 6, stop)
        if inner >= 0:
            found.append(("thumbnail", 1, inner, inner, stop))
    return found


def _mp3(data: bytes) -> list[Piece]:
    """Tags before and after the sound, from both ends inwards, and frames of the first tag."""
    found: list[Piece] = []
    start, stop = 0, len(data)

    def safe(b: bytes) -> int:
        return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127

    if data[:3] == b"ID3" and len(data) >= 10:
        version, at = data[3], 10
        start = min(10 + safe(data[6:10]) + (10 if data[5] & 16 else 0), len(data))
        found.append(("id3v2", 0, 0, at, start))
        if data[5] & 64 and version >= 3 and start >= 14:
            at += safe(data[10:14]) if version == 4 else int.from_bytes(data[10:14], "big") + 4
        name, head = (3, 6) if version == 2 else (4, 10)
        while at + head <= start and re.fullmatch(rb"[A-Z0-9]+", data[at : at + name]):
            raw = data[at + name : at + 2 * name]
            length = safe(raw) if version == 4 else int.from_bytes(raw, "big")
            if not length or at + head + length > start:
                break
            found.append((f"frame:{data[at : at + name].decode()}", 1, at, at + head, at + head + length))
            at += head + length
    while True:
        if stop - 128 >= start and data[stop - 128 : stop - 125] == b"TAG":
            kind, begin = "id3v1", stop - 128
        elif stop - 32 >= start and data[stop - 32 : stop - 24] == b"APETAGEX":
            size = int.from_bytes(data[stop - 20 : stop - 16], "little") + (32 if data[stop - 9] & 128 else 0)
            kind, begin = "ape", stop - size
        elif stop - 15 >= start and data[stop - 9 : stop] == b"LYRICS200" and data[stop - 15 : stop - 9].isdigit():
            kind, begin = "lyrics3", stop - 15 - int(data[stop - 15 : stop - 9])
        else:
            break
        if begin < start:
            break
        found.append((kind, 0, begin, begin, stop))
        stop = begin
    if start >= stop:
        raise Broken("no sound")
    return sorted([*found, ("audio", 0, start, start, stop)], key=lambda p: (p[2], p[1]))


def _psd(data: bytes) -> list[Piece]:
    if len(data) < 34:
        raise Broken("header")
    colours = 30 + int.from_bytes(data[26:30], "big")
    at, stop = colours + 4, colours + 4 + int.from_bytes(data[colours : colours + 4], "big")
    if stop > len(data):
        raise Broken("resources")
    found: list[Piece] = [("before", 0, 0, 0, colours), ("length", 0, colours, colours, at)]
    while at + 12 <= stop and data[at : at + 4] == b"8BIM":
        body = at + 6 + (data[at + 6] + 2) // 2 * 2
        size = int.from_bytes(data[body : body + 4], "big")
        end = body + 4 + size + size % 2
        if end > stop:
            raise Broken("resource")
        found.append((f"8BIM:{int.from_bytes(data[at + 4 : at + 6], 'big')}", 0, at, body + 4, end))
        at = end
    return [*found, ("after", 0, stop, stop, len(data))]


#: Boxes that hold others, and those that are nothing but metadata.
MP4_HOLDERS = {"moov", "trak", "mdia", "minf", "stbl", "edts", "udta"}
MP4_METADATA = {"udta", "meta", "uuid", "Xtra"}


def _mp4(data: bytes) -> list[Piece]:
    """Boxes, holders before what they hold; "in:" stands before the kind of what a metadata box holds, and at depth 99."""
    found: list[Piece] = []

    def go(first: int, end: int, depth: int, inside: bool) -> None:
        for kind, _, start, body, stop in walk(data, LAYOUTS["mp4"], first, end):
            found.append((f"in:{kind}", 99, start, body, stop) if inside else (kind, depth, start, body, stop))
            metadata = inside or kind in MP4_METADATA and kind != "uuid"
            if depth < 8 and (kind in MP4_HOLDERS if not metadata else kind in ("udta", "meta", "ilst")):
                go(body + (4 if kind == "meta" else 0), stop, depth + 1, metadata)

    go(0, len(data), 0, False)
    top = [p[0] for p in found if p[1] == 0]
    if not top or top[0] != "ftyp" or "moov" not in top:
        raise Broken("no movie")
    return found


_RTF = re.compile(rb"\\\\.|[{}]", re.S)
_RTF_GROUPS = {"info": re.compile(rb"\{\\info[\s{\\]"), "generator": re.compile(rb"\{\\\*\\generator[\s;]")}


def _rtf(data: bytes) -> list[Piece]:
    """The groups that describe the document (depth 1), and the text outside of them."""
    if not data.startswith(b"{\\rtf"):
        raise Broken("start")
    wanted = {m.start(): kind for kind, pattern in _RTF_GROUPS.items() for m in pattern.finditer(data)}
    opened: list[int] = []
    groups: list[Piece] = []
    for m in _RTF.finditer(data):
        if m[0] == b"{":
            opened.append(m.start())
        elif m[0] == b"}" and opened:
            start = opened.pop()
            if start in wanted:
                groups.append((wanted[start], 1, start, start, m.end()))
    found, at = [], 0
    for group in sorted(groups, key=lambda g: g[2]):
        found.append(group)
        if group[2] >= at:
            found.append(("text", 0, at, at, group[2]))
            at = group[4]
    return [*found, ("text", 0, at, at, len(data))]


#: Header sizes of bitmaps, and names of colour profiles in their headers, as they are stored.
BMP_HEADERS = {12, 40, 52, 56, 108, 124}
BMP_LINKED, BMP_EMBEDDED = b"KNIL", b"DEBM"


def _bmp(data: bytes) -> list[Piece]:
    """The image up to the end of its pixels or profile, what trails behind it, and a linked profile's path (depth 1)."""

    def number(at: int, size: int = 4, signed: bool = False) -> int:
        return int.from_bytes(data[at : at + size], "little", signed=signed)

    header, pixels = number(14), number(10)
    if len(data) < 54 or data[:2] != b"BM" or header not in BMP_HEADERS or 14 + header > len(data) or pixels > len(data):
        raise Broken("header")
    size = number(34) if header >= 40 else 0
    if not size or not (number(30) if header >= 40 else 0):
        size = (number(28, 2) * abs(number(18, signed=True)) + 31) // 32 * 4 * abs(number(22, signed=True))
    end = min(pixels + size, len(data))
    space = data[70:74] if header >= 108 else b""
    place = number(126) if header >= 124 else 0
    if space == BMP_EMBEDDED and place:
        end = max(end, min(14 + place + number(130), len(data)))
    found: list[Piece] = [("body", 0, 0, 0, end)]
    if space == BMP_LINKED:
        path = 14 + place if place else end
        stop = data.find(b"\0", path, path + 260) if place else end
        found.append(("linked", 1, path, path, stop if stop >= 0 else min(path + 260, len(data))))
        if place and path < pixels:
            found.append(("path", 1, path, path, min(path + 260, pixels)))
    return [*found, ("trailing", 1, end, end, len(data))] if end < len(data) else found


def _packets(laces: bytes, at: int) -> Iterator[tuple[int, int, bool]]:
    """Start, stop and whether it ends there, of the packets of a page."""
    start = at
    for k, lace in enumerate(laces):
        at += lace
        if lace < 255 or k + 1 == len(laces):
            yield start, at, lace < 255
            start = at


def _ogg(data: bytes) -> list[Piece]:
    """Pages, and what the comment packet of the first four pages holds; spanning, if it goes on behind its page. Of its page, the packets too (depth 3)."""
    found: list[Piece] = []
    at, pages, told = 0, 0, False
    while at + 27 <= len(data):
        laces = data[at + 27 : at + 27 + data[at + 26]]
        body = at + 27 + data[at + 26]
        stop = body + sum(laces)
        if data[at : at + 4] != b"OggS" or stop > len(data):
            raise Broken("page")
        found.append(("page", 0, at, body, stop))
        pages += 1
        packets = [] if told or pages > 4 else [(a, b, whole, 8 if data[a : a + 8] == b"OpusTags" else 7 if data[a : a + 7] == b"\x03vorbis" else 0) for a, b, whole in _packets(laces, body)]
        for start, end, whole, skip in packets:
            if skip and not told:
                told = True
                found += _comments(data, start + skip, end) if whole else [("spanning", 1, start, start, end)]
                found.append(("comment page", 2, at, body, stop))
                found += [("comments" if a == start else "packet" if ends else "open packet", 3, a, a + skip_, b) for a, b, ends, skip_ in packets]
        at = stop
    if not found:
        raise Broken("no page")
    return found


#: Bytes of one value of each type that a directory may hold, and the most directories of a file.
ENTRY_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MOST_DIRECTORIES = 32
PIXEL_TAGS = ((273, 279), (324, 325))


def _tiff(data: bytes) -> list[Piece]:
    """Each directory of the chain (depth 0), the tags that a photograph's may have (1), its entries with their values (2), and strips or tiles (3)."""
    order = {b"II": "little", b"MM": "big"}.get(data[:2])

    def number(at: int, size: int) -> int:
        return int.from_bytes(data[at : at + size], order)

    if len(data) < 8 or not order or number(2, 2) != 42:
        raise Broken("header")
    found: list[Piece] = []
    seen, at = set(), number(4, 4)
    while at and len(seen) < MOST_DIRECTORIES:
        count = number(at, 2)
        if at in seen or at + 2 > len(data) or at + 2 + 12 * count + 4 > len(data):
            raise Broken("directory")
        page, values, reduced = len(seen), {}, False
        seen.add(at)
        entries: list[Piece] = []
        for entry in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, n = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            size = ENTRY_SIZES.get(kind, 0) * n
            body = entry + 8 if size <= 4 else number(entry + 8, 4)
            if kind not in ENTRY_SIZES or n > 0x0FFFFFFF or body + size > len(data):
                continue
            entries.append((f"entry:{page}:{tag}:{kind}:{n}:{order}", 2, entry, body, body + size))
            if tag not in values:
                step = {3: 2, 4: 4}.get(kind, 0)
                values[tag] = (body, step, n)
            if tag == 254 and n and kind in (3, 4):
                reduced = reduced or bool(number(body, ENTRY_SIZES[kind]) & 1)
        found.append((f"directory:{page}:{'reduced' if reduced else 'page'}:{order}", 0, at, at + 2, at + 2 + 12 * count))
        found += tags(data, 0, at, order)
        found += entries
        pair = next(((a, b) for a, b in PIXEL_TAGS if a in values and b in values), None)
        if pair and not reduced:
            (places, step, n), (sizes, other, m) = values[pair[0]], values[pair[1]]
            for k in range(min(n, m)):
                start = number(places + k * step, step) if step else 0
                found.append((f"strip:{page}:{pair[0]}", 3, start, start, start + (number(sizes + k * other, other) if other else 0)))
        at = number(at + 2 + 12 * count, 4)
    raw = len(data) >= 11 and data[8:11] == b"CR\2" or any(p[0].split(":")[2] == "50706" for p in found if p[1] == 2)
    if not found or raw:  # of a camera: its directories can't be written anew
        raise Broken("raw" if raw else "no directory")
    return found


def _items(data: bytes) -> list[Piece]:
    """An image of items: its description (meta, depth 0) and the boxes in it (child:, 1); items (item:id:kind:type), where they are (place:id:method)
    and what refers to them (ref:id), as records (2); the bytes of an item (extent:id, 3); the primary one, sizes (4), and tags (1)."""
    boxes = LAYOUTS["mp4"]

    def number(at: int, size: int) -> int:
        if at + size > len(data):
            raise Broken("end")
        return int.from_bytes(data[at : at + size], "big")

    top = walk(data, boxes)
    meta = next((p for p in top if p[0] == "meta"), None)
    if meta is None or not any(p[0] == "ftyp" for p in top):
        raise Broken("meta")
    children = walk(data, boxes, meta[3] + 4, meta[4])
    by_kind = {p[0]: p for p in reversed(children)}
    if not {"iinf", "iloc"} <= by_kind.keys():
        raise Broken("items")
    found: list[Piece] = [("meta", 0, meta[2], meta[3] + 4, meta[4]), *((f"child:{k}", 1, s, b, e) for k, _, s, b, e in children)]

    _, _, _, at, end = by_kind["iloc"]
    version, sizes = data[at], number(at + 4, 2)
    wide, places = 2 if version < 2 else 4, {}
    at, count = at + 6 + wide, number(at + 6, wide)
    for _ in range(count):
        start, ident, method = at, number(at, wide), 0
        at += wide
        if version in (1, 2):
            method, at = number(at, 2) & 15, at + 2
        base, at = number(at + 2, sizes >> 4 & 15), at + 2 + (sizes >> 4 & 15)
        extents, at = number(at, 2), at + 2
        for _ in range(extents):
            at += sizes & 15 if version in (1, 2) else 0
            offset, at = base + number(at, sizes >> 12), at + (sizes >> 12)
            length, at = number(at, sizes >> 8 & 15), at + (sizes >> 8 & 15)
            places.setdefault(ident, []).append((offset, offset + length))
            found.append((f"extent:{ident}:{method}", 3, min(offset, len(data)), min(offset, len(data)), offset + length))
        if at > end:
            raise Broken("places")
        found.append((f"place:{ident}:{method}", 2, start, start, at))

    _, _, _, at, end = by_kind["iinf"]
    wide = 2 if data[at] == 0 else 4
    at, count = at + 4 + wide, number(at + 4, wide)
    for _ in range(count):
        if at + 8 > end:
            break
        item = next(iter(walk(data, boxes, at, end)), None)
        if item is None or item[0] != "infe" or data[item[3]] < 2:
            raise Broken("item")
        wide = 2 if data[item[3]] == 2 else 4
        ident, kind = number(item[3] + 4, wide), data[item[3] + 6 + wide : item[3] + 10 + wide].decode("latin-1")
        words = data[item[3] + 10 + wide : item[4]].split(b"\0")
        mime = words[1].decode("latin-1") if kind == "mime" and len(words) > 1 else ""
        found.append((f"item:{ident}:{kind}:{mime}", 2, item[2], item[2], item[4]))
        extent = places.get(ident, [(0, 0)])[0]
        if kind == "Exif" and extent[1] - extent[0] > 12 and extent[1] <= len(data):
            tiff = extent[0] + 4 + number(extent[0], 4)
            if tiff + 8 < len(data):
                order = "little" if data[tiff : tiff + 2] == b"II" else "big"
                found += tags(data, tiff, tiff + int.from_bytes(data[tiff + 4 : tiff + 8], order), order)
        at = item[4]

    if "iref" in by_kind:
        _, _, _, body, end = by_kind["iref"]
        found += [(f"ref:{number(b, 2 if data[body] == 0 else 4)}", 2, s, b, e) for _, _, s, b, e in walk(data, boxes, body + 4, end)]
    if "pitm" in by_kind:
        body = by_kind["pitm"][3]
        found.append((f"primary:{number(body + 4, 2 if data[body] == 0 else 4)}", 4, body, body, body))
    for kind, _, _, body, stop in walk(data, boxes, *by_kind["iprp"][3:5]) if "iprp" in by_kind else ():
        if kind == "ipco":
            found += [("size", 4, s, b + 4, e) for k, _, s, b, e in walk(data, boxes, body, stop) if k == "ispe"]
    return found


#: Boxes of a photograph's container that hold others.
PHOTO_HOLDERS = {"meta", "iprp", "ipco", "iinf", "iref", "trak", "moov", "mdia", "minf", "stbl"}


def _photo(data: bytes) -> list[Piece]:
    """All boxes, holders before what they hold, and the orientation that the first tags with one state (depth 99: orientation:value)."""
    found: list[Piece] = []

    def turned(body: int, stop: int) -> int | None:
        start = re.compile(rb"II\x2a|MM.\x2a", re.S).search(data, body, stop)
        if not start or start.start() + 12 >= stop:
            return None
        tiff, order = start.start(), "little" if start[0][:1] == b"I" else "big"
        at = tiff + int.from_bytes(data[tiff + 4 : tiff + 8], order)
        for k in range(int.from_bytes(data[at : at + 2], order) if at + 2 <= stop else 0):
            entry = at + 2 + 12 * k
            if entry + 12 > stop:
                break
            tag, kind, value = (int.from_bytes(data[entry + p : entry + p + 2], order) for p in (0, 2, 8))
            if (tag, kind) == (0x0112, 3):
                return value
        return None

    def go(first: int, end: int, depth: int) -> None:
        for piece in walk(data, LAYOUTS["mp4"], first, end, depth):
            found.append(piece)
            kind, _, _, body, stop = piece
            if kind in PHOTO_HOLDERS and depth < 8:
                go(body + 4 * (kind == "meta"), stop, depth + 1)
            if kind == "Exif" and not any(p[1] == 99 for p in found) and (value := turned(body, stop)) is not None:
                found.append((f"orientation:{value}", 99, body, body, body))

    go(0, len(data), 0)
    return found


def _webp(data: bytes) -> list[Piece]:
    """Chunks of the file (depth 0, without their padding), and those that stand within the extended header (depth 1)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("header")

    def exact(pieces: list[Piece], depth: int) -> Iterator[Piece]:
        for kind, _, start, body, stop in pieces:
            yield kind, depth, start, body, min(stop, body + int.from_bytes(data[start + 4 : start + 8], "little"))

    found: list[Piece] = []
    for piece in exact(walk(data, LAYOUTS["webp"]), 0):
        found.append(piece)
        if piece[0] == "VP8X" and piece[4] - piece[3] > 10:
            found += exact(walk(data, LAYOUTS["webp"], piece[3] + 10, piece[4]), 1)
    return found


#: Ids of elements of a film, and those that hold others.
EBML, SEGMENT, FILM_INFO = 0x1A45DFA3, 0x18538067, 0x1549A966


def _film(data: bytes) -> list[Piece]:
    """Elements by the digits of their id: the header, the segment and its elements (depth 1), and what describes it (depth 2)."""

    def element(at: int, end: int) -> Piece | None:
        """Numbers have as many bytes as the first has zero bits before its first one, and one more."""
        numbers, place = [], at
        for keep in (True, False):
            first = data[place] if place < len(data) else 0
            length = 9 - first.bit_length()
            if not first or place + length > len(data):
                return None
            raw, ones = int.from_bytes(data[place : place + length], "big"), (1 << 7 * length) - 1
            numbers.append(raw if keep else raw & ones if raw & ones != ones else None)  # all ones: of unknown size
            place += length
        stop = end if numbers[1] is None else place + numbers[1]
        return (f"{numbers[0]:x}", 0, at, place, stop) if stop <= end else None

    def inside(first: int, end: int, depth: int) -> Iterator[Piece]:
        at = first
        while at < end and (found := element(at, end)):
            yield (found[0], depth, *found[2:])
            at = found[4]

    header = element(0, len(data))
    segment = element(header[4], len(data)) if header and header[0] == f"{EBML:x}" else None
    if not segment or segment[0] != f"{SEGMENT:x}":
        raise Broken("segment")
    found = [header, segment]
    for child in inside(segment[3], segment[4], 1):
        found.append(child)
        if child[0] == f"{FILM_INFO:x}":
            found += inside(child[3], child[4], 2)
    return found


def _icon(data: bytes) -> list[Piece]:
    """Images of a directory (depth 0: image:number:png or bitmap; the entry as start, the image as body to stop), chunks of those that are PNG (1), and what trails."""
    count = int.from_bytes(data[4:6], "little")
    if data[:2] != b"\0\0" or data[2:4] not in (b"\1\0", b"\2\0") or not 1 <= count <= 64 or 6 + 16 * count > len(data):
        raise Broken("directory")
    found: list[Piece] = []
    for k in range(count):
        at = 6 + 16 * k
        size, body = (int.from_bytes(data[at + p : at + p + 4], "little") for p in (8, 12))
        if not size or body + size > len(data):
            raise Broken("image")
        is_png = data[body : body + 4] == b"\x89PNG"
        found.append((f"image:{k}:{'png' if is_png else 'bitmap'}", 0, at, body, body + size))
        if is_png:
            found += [(f"chunk:{k}:{kind}", 1, s, b, e) for kind, _, s, b, e in walk(data, LAYOUTS["png"], body + 8, body + size)]
    end = max(p[4] for p in found if p[1] == 0)
    return [*found, ("trailing", 2, end, end, len(data))] if end < len(data) else found


LISTERS: dict[str, Callable[[bytes], list[Piece]]] = {
    "png": _png, "wav": _wav, "avi": _riff("avi"), "webp": _webp, "heic": _photo, "avif": _items, "mkv": _film, "ico": _icon, "flac": _flac, "gif": _gif, "jpeg": _jpeg_with_tags, "jpeg-oriented": _jpeg_with_tags, "mp3": _mp3, "psd": _psd, "mp4": _mp4, "rtf": _rtf, "ogg": _ogg, "bmp": _bmp, "tiff": _tiff,
}


def with_pieces(files: DataFrame, format_id: str | None = None) -> DataFrame:
    """files (content and others) with the column pieces; null where it is broken (no content is an empty one). No shuffle.

    Without a format, that in the column format counts for each row.
    """
    small_batches(files.sparkSession)
    out = T.StructType([*files.schema.fields, T.StructField("pieces", T.ArrayType(PIECE))])
    at, by = files.columns.index("content"), None if format_id else files.columns.index("format")

    listers = {format_id: LISTERS[format_id]} if format_id else dict(LISTERS)  # with those that were registered here

    def listed(data: bytes, kind: str | None) -> list[dict] | None:
        if kind not in listers:
            return None
        try:
            pieces = listers[kind](data)
        except Broken:
            return None
        return [dict(kind=k, depth=d, start=s, body=b, stop=e, head=data[b : e if k in WHOLE else min(e, b + HEAD)]) for k, d, s, b, e in pieces]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        for batch in in_parts(batches, at):
            kinds = [format_id] * batch.num_rows if by is None else batch.column(by).to_pylist()
            found = [listed(data.as_py() or b"", kind) for data, kind in zip(batch.column(at), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, schema.field(len(schema) - 1).type)], schema=schema)

    return files.mapInArrow(run, out)
