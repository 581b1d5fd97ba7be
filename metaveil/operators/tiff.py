"""Images made of directories: what their entries tell, and copies with the entries, strips and tiles that show the image.

A copy is laid out anew, page after page: the directory, then the values that don't fit into it and the strips. Where each of
them stands is a running sum over the sizes of all before, in arrays of one row; pixel data are cut from the original as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaveil.functions.bytes import cstring, number
from metaveil.operators.binary import found, listed, size_struct, tag_findings
from metaveil.operators.svg import FINDING, let

#: Entries that a copy keeps.
KEPT = (
    254, 255, 256, 257, 258, 259, 262, 263, 264, 265, 266, 273, 274, 277, 278, 279, 280, 281, 282, 283, 284, 296, 297, 301, 317, 318, 319, 320, 321, 322, 323, 324, 325,
    338, 339, 340, 341, 347, 529, 530, 531, 532, 34675,
)
#: Tags that are about the display, tags that photographs have too, containers (those with a tag finding of their own last), and texts.
TECHNICAL = ("Orientation", "X resolution", "Y resolution", "Resolution unit", "White point", "YCbCr positioning")
SHARED = (0x010E, 0x010F, 0x0110, 0x0131, 0x0132, 0x013B, 0x8298, 0x0112, 0x011A, 0x011B, 0x0128, 0x013E, 0x0213)
CONTAINERS = {700: "XMP metadata", 33723: "IPTC metadata", 34377: "Photoshop image resources", 330: "Sub-IFD (embedded preview)"}
POINTERS = (34665, 34853)
TEXTS = {269: ("Document name", "other", "medium"), 285: ("Page name", "other", "medium"), 316: ("Host computer", "device", "high"), 337: ("Target printer", "other", "medium")}
PROFILE, COMPRESSION, OLD_JPEG = 34675, 259, 6


def _entries(pieces: Column) -> Column:
    """tag (first, to sort by), start, page, kind, count, body, stop, head of all entries."""

    def entry(p: Column) -> Column:
        parts = F.split(p["kind"], ":")
        return F.struct(
            parts[2].cast("int").alias("tag"), p["start"].alias("start"), parts[1].cast("int").alias("page"), parts[3].cast("int").alias("kind"), parts[4].cast("bigint").alias("count"),
            p["body"].alias("body"), p["stop"].alias("stop"), p["head"].alias("head"), (parts[5] == "little").alias("little"),
        )

    return F.transform(F.filter(pieces, lambda p: p["depth"] == 2), entry)


def _pages(pieces: Column) -> Column:
    """Numbers of the directories that aren't reduced images."""
    return F.transform(F.filter(pieces, lambda p: p["kind"].rlike("^directory:[0-9]+:page")), lambda p: F.split(p["kind"], ":")[1].cast("int"))


def _first_number(e: Column) -> Column:
    at = lambda size: F.when(e["little"], number(e["head"], 0, size, "little")).otherwise(number(e["head"], 0, size))
    return F.when(e["kind"] == 3, at(2)).when(e["kind"] == 4, at(4))


def _value(pieces: Column, tag: int, page: int = 0) -> Column:
    """The number of an entry of a directory, or null."""
    return let(F.try_element_at(F.filter(_entries(pieces), lambda e: (e["tag"] == tag) & (e["page"] == page)), F.lit(1)), _first_number)


def size(content: Column, pieces: Column) -> Column:
    width, height = _value(pieces, 256), _value(pieces, 257)
    return let(size_struct(width, height), lambda s: F.when((s["width"] > 0) & (s["height"] > 0), s))


def has_profile(content: Column, pieces: Column) -> Column:
    return F.exists(_entries(pieces), lambda e: e["tag"] == PROFILE)


def findings(pieces: Column) -> Column:
    """Of each directory its tags, then containers and texts; then reduced images and how many entries are unknown."""
    none = F.array().cast(f"array<{FINDING}>")

    def of_entry(p: Column) -> Column:
        parts = F.split(p["kind"], ":")
        box, text = listed({str(k): (v, "containers", "medium") for k, v in CONTAINERS.items()}, parts[2]), listed({str(k): v for k, v in TEXTS.items()}, parts[2])
        words = F.when((text["label"].isNotNull()) & (parts[3] == "2"), found(text["category"], F.concat(F.lit("TIFF:"), text["label"]), text["label"], cstring(F.substring(p["head"], 1, 256)), text["severity"]))
        return F.when(box["label"].isNotNull(), found("containers", F.concat(F.lit("TIFF:"), box["label"]), box["label"], "Present", "medium")).otherwise(words)

    def of_directory(own: Column) -> Column:
        told = F.filter(tag_findings(own, "TIFF:"), lambda f: ~f["label"].isin(*TECHNICAL))
        return F.concat(told, F.filter(F.transform(F.filter(own, lambda p: p["depth"] == 2), of_entry), lambda f: f.isNotNull()))

    def of_all(starts: Column) -> Column:
        return F.flatten(F.transform(starts, lambda at, k: of_directory(F.slice(pieces, at + 1, F.coalesce(F.get(starts, k + 1), F.size(pieces)) - at))))

    known = (*KEPT, *CONTAINERS, *POINTERS, *SHARED, *TEXTS)
    reduced = F.size(F.filter(pieces, lambda p: p["kind"].rlike("^directory:[0-9]+:reduced")))
    unknown = F.size(F.filter(_entries(pieces), lambda e: ~e["tag"].isin(*known)))
    counted = F.array(
        F.when(reduced > 0, found("thumbnails", "TIFF:ReducedPages", "Embedded preview/thumbnail pages", reduced, "medium")),
        F.when(unknown > 0, found("other", "TIFF:UnknownTags", "Private/unknown TIFF tags", unknown, "medium")),
    )
    places = F.filter(F.transform(pieces, lambda p, i: F.when(p["depth"] == 0, i)), lambda i: i.isNotNull())
    return F.when(pieces.isNull(), none).otherwise(F.concat(let(places, of_all), F.filter(counted, lambda f: f.isNotNull())))


def _even(n: Column) -> Column:
    return n + n % 2


def _digits(value: Column, size: int, little: Column) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.when(little, F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])).otherwise(digits)


def _part(content: Column, start: Column, stop: Column) -> Column:
    """Digits of a part, padded to an even number of bytes."""
    size = stop - start
    return F.concat(F.hex(F.substring(content, start + 1, size)), F.when(size % 2 == 1, "00").otherwise(""))


def _running(sizes: Column, first: Column) -> Column:
    """Where each part begins, and at the end where the last one ends."""
    start = F.array(first.cast("bigint"))
    return F.aggregate(sizes, start, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def _page(content: Column, entries: Column, strips: Column, base: Column, last: Column) -> Column:
    """stop and digits of a page whose directory begins at base."""
    n = F.size(entries)
    little = entries[0]["little"]
    place_tag = strips[0]["tag"]
    strip_sizes = F.transform(strips, lambda s: _even(s["stop"] - s["start"]).cast("bigint"))
    all_strips = F.aggregate(strip_sizes, F.lit(0).cast("bigint"), lambda a, b: a + b)
    many = F.size(strips)

    def own_size(e: Column) -> Column:
        inline = e["stop"] - e["body"] <= 4
        return F.when(e["tag"] == place_tag, all_strips + F.when(many > 1, 4 * many).otherwise(0)).when(inline, 0).otherwise(_even(e["stop"] - e["body"])).cast("bigint")

    def laid_out(places: Column) -> Column:
        def entry(e: Column, i: Column) -> Column:
            at = F.get(places, i)
            placed = e["tag"] == place_tag
            inline = e["stop"] - e["body"] <= 4
            value = (
                F.when(placed & (many > 1), _digits(at + all_strips, 4, little)).when(placed, _digits(at, 4, little))
                .when(inline, F.hex(F.substring(content, e["start"] + 9, F.lit(4)))).otherwise(_digits(at, 4, little))
            )
            return F.concat(_digits(e["tag"], 2, little), _digits(F.when(placed, 4).otherwise(e["kind"]), 2, little), _digits(F.when(placed, many).otherwise(e["count"]), 4, little), value)

        def data(e: Column, i: Column) -> Column:
            offsets = F.slice(_running(strip_sizes, F.get(places, i)), F.lit(1), many)
            array = F.when(many > 1, F.array_join(F.transform(offsets, lambda o: _digits(o, 4, little)), "")).otherwise("")
            pixels = F.concat(F.array_join(F.transform(strips, lambda s: _part(content, s["start"], s["stop"])), ""), array)
            return F.when(e["tag"] == place_tag, pixels).when(e["stop"] - e["body"] <= 4, "").otherwise(_part(content, e["body"], e["stop"]))

        stop = F.element_at(places, -1)
        following = F.when(last, F.lit(0).cast("bigint")).otherwise(stop)
        digits = F.concat(
            _digits(n, 2, little), F.array_join(F.transform(entries, entry), ""), _digits(following, 4, little), F.array_join(F.transform(entries, data), "")
        )
        return F.struct(stop.alias("stop"), digits.alias("digits"))

    return let(_running(F.transform(entries, own_size), base + 2 + 12 * n + 4), laid_out)


def copy(content: Column, pieces: Column) -> Column:
    """The copy, or null: without an image, with pixels out of bounds, or with the old kind of JPEG in it."""

    def strips_of(page: Column) -> Column:
        own = F.filter(pieces, lambda p: F.startswith(p["kind"], F.concat(F.lit("strip:"), page.cast("string"), F.lit(":"))))
        return F.transform(own, lambda p: F.struct(F.split(p["kind"], ":")[2].cast("int").alias("tag"), p["start"].alias("start"), p["stop"].alias("stop")))

    def built(entries: Column, pages: Column) -> Column:
        def of_page(page: Column) -> Column:
            return F.array_sort(F.filter(entries, lambda e: (e["page"] == page) & e["tag"].isin(*KEPT)))

        def add(acc: Column, page: Column) -> Column:
            made = _page(content, of_page(page), strips_of(page), acc["stop"], page == F.element_at(pages, -1))
            return let(made, lambda m: F.struct(m["stop"].alias("stop"), F.concat(acc["digits"], F.array(m["digits"])).alias("digits")))

        start = F.struct(F.lit(8).cast("bigint").alias("stop"), F.array().cast("array<string>").alias("digits"))
        little = F.startswith(content, F.lit(b"II"))
        header = F.concat(F.hex(F.substring(content, 1, 4)), _digits(F.lit(8), 4, little))
        old = F.exists(entries, lambda e: (e["tag"] == COMPRESSION) & F.array_contains(pages, e["page"]) & (_first_number(e) == OLD_JPEG))
        whole = F.forall(pages, lambda page: F.size(strips_of(page)) > 0) & F.forall(pieces, lambda p: (p["depth"] != 3) | (p["stop"] <= F.length(content)))
        digits = F.aggregate(pages, start, add)["digits"]
        return F.when((F.size(pages) > 0) & ~old & whole, F.unhex(F.concat(header, F.array_join(digits, ""))))

    return let(_entries(pieces), lambda entries: let(_pages(pieces), lambda pages: built(entries, pages)))
