import struct

from metaveil.operators import binary

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 7: "B"}


def built(order, pages):
    """A file of pages: each a list of (tag, kind, values) and of strips; tag 273 stands for the strips' places."""
    out, patches = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)), []
    for entries, strips in pages:
        if patches:
            out[patches[-1] : patches[-1] + 4] = struct.pack(order + "I", len(out))
        data, base = bytearray(), len(out) + 2 + 12 * len(entries) + 4
        out += struct.pack(order + "H", len(entries))
        places = []
        for strip in strips:
            places.append(base + len(data))
            data += strip
        for tag, kind, values in entries:
            values = places if tag == 273 else values
            raw = struct.pack(f"{order}{len(values)}{KINDS[kind]}", *values)
            if len(raw) > 4:
                at, data = base + len(data), data + raw
                raw = struct.pack(order + "I", at)
            out += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        patches.append(len(out))
        out += bytes(4) + data
    return bytes(out)


def parsed(data):
    """Pages as {tag: values} with their strips."""
    order = "<" if data[:2] == b"II" else ">"
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n, tags = struct.unpack_from(order + "H", data, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = SIZES[kind] * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, place)
        tags["strips"] = [data[a : a + b] for a, b in zip(tags.get(273, ()), tags.get(279, ()), strict=False)]
        pages.append(tags)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages


def page(strips, *more, width=3):
    entries = [(256, 3, [width]), (257, 3, [2]), (258, 3, [8, 8, 8]), (273, 4, [0] * len(strips)), (279, 3, [len(s) for s in strips]), *more]
    return sorted(entries), strips


AUTHOR = (315, 2, list(b"Ann Boe\0"))


def cleaned(spark, *contents):
    rows = binary.clean_and_verify(spark.createDataFrame(list(enumerate(contents)), "file_id int, content binary"), "tiff").collect()
    return [r for r in sorted(rows, key=lambda r: r.file_id)]


def test_pages_are_written_anew_with_the_same_pixels(spark):
    for order in "<>":
        pages = [page([b"abc", b"defgh", b"i"], AUTHOR, (34675, 7, list(range(9)))), page([b"thumb"], (254, 4, [1])), page([b"xyz"], (269, 2, list(b"plan\0")))]
        (row,) = cleaned(spark, built(order, pages))
        assert (row.status, row.passed, row.remaining, row.found_before) == ("ok", True, 0, 3)  # author, document name, reduced page
        got = parsed(row.clean)
        assert [p["strips"] for p in got] == [[b"abc", b"defgh", b"i"], [b"xyz"]]
        assert got[0].keys() == {256, 257, 258, 273, 279, 34675, "strips"} and got[1].keys() == {256, 257, 258, 273, 279, "strips"}
        assert got[0][34675] == tuple(range(9)) and got[0][258] == (8, 8, 8)
        assert row.clean[:2] == (b"II" if order == "<" else b"MM") and all(p % 2 == 0 for p in got[0][273])


def test_what_cannot_be_written_anew_is_refused(spark):
    one = built("<", [page([b"abc"], AUTHOR)])
    loop = bytearray(one)
    entries = struct.unpack_from("<H", one, 8)[0]
    loop[10 + 12 * entries : 14 + 12 * entries] = struct.pack("<I", 8)
    camera = built("<", [page([b"abc"], (50706, 1, [1, 4, 0, 0]))])
    old = built("<", [page([b"abc"], (259, 3, [6]))])
    beyond = built("<", [page([b"abc"])]).replace(struct.pack("<HHIHH", 279, 3, 1, 3, 0), struct.pack("<HHIHH", 279, 3, 1, 9999, 0))
    bare = built("<", [([(256, 3, [1]), (257, 3, [1])], [])])
    unsized = built("<", [([(273, 4, [0]), (279, 4, [3])], [b"abc"])])
    rows = cleaned(spark, bytes(loop), camera, old, beyond, bare, unsized, one[:20], b"", one)
    assert [r.status for r in rows] == ["error"] * 8 + ["ok"]
    assert [r.passed for r in rows] == [False] * 8 + [True]


def test_places_of_a_page(spark):
    gps = built("<", [page([b"abc"], (34853, 4, [0]))])
    at = len(gps)
    data = bytearray(gps.replace(struct.pack("<HHII", 34853, 4, 1, 0), struct.pack("<HHII", 34853, 4, 1, at)))
    data += struct.pack("<HHHI4sI", 1, 1, 2, 2, b"N\0\0\0", 0)
    found = binary.scan(spark.createDataFrame([(1, bytes(data))], "file_id int, content binary"), "tiff").first().findings
    assert [(f.field, f.value) for f in found] == [("TIFF:GPS IFD pointer", str(at)), ("TIFF:GPS latitude ref", "N")]
