import io
import zipfile

import pytest
from pyspark.sql import functions as F

from metaveil.operators import binary, findings, mail, packages, relations
from metaveil.plans import binary as samples
from metaveil.plans import odd_files
from metaveil.sources.archives import entries, rebuilt

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", samples.SAMPLES)
def test_broken_files_never_fail_a_job(spark, kind):
    files = samples.files(spark, SF, kind).where("file_id < 5")
    content = F.col("content")
    changes = {
        "cut": F.expr("substring(content, 1, length(content) - 12)"),
        "flipped": F.overlay(content, F.unhex(F.lit("FFFFFFFFFF")), F.lit(9)),
        "long": F.overlay(content, F.unhex(F.lit("7FFFFFFF")), F.lit(5)),
        "other": F.concat(F.lit("PK").cast("binary"), content),
        "short": F.expr("substring(content, 1, 5)"),
        "empty": F.unhex(F.lit("")),
        "null": F.lit(None).cast("binary"),
    }
    rows = None
    for k, change in enumerate(changes.values()):
        more = files.select((F.col("file_id") * 10 + k).alias("file_id"), change.alias("content"))
        rows = more if rows is None else rows.union(more)
    got = binary.clean_and_verify(rows, kind).collect()
    assert len(got) == 5 * len(changes) and {r.status for r in got} <= {"ok", "error"}
    assert all(r.clean is not None for r in got if r.status == "ok")


def test_cleaned_copies_have_no_findings(spark):
    for kind in samples.CLEANED:
        assert binary.clean_and_verify(samples.files(spark, SF, kind), kind).where("NOT passed OR remaining > 0 OR found_before = 0").count() == 0, kind


def test_truncated_jpeg_is_left_as_it_is(spark):
    data = bytes.fromhex("FFD8FFC00007080001000102FFE1000845786966") + b"ab"
    row = binary.clean_and_verify(spark.createDataFrame([(1, data)], "file_id int, content binary"), "jpeg").first()
    assert row.clean == data


def test_mail_without_headers(spark):
    texts = [b"no mail", b"", None, b"From: a\nno header here\n\nbody", b" folded: first\nFrom: x\n\n", b"X-Mailer: m\nDate: d\r\n\r\nbody\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id int, content binary")
    got = {r.file_id: r for r in mail.clean_and_verify(rows).collect()}
    assert [got[i].status for i in range(6)] == ["error", "error", "error", "ok", "error", "ok"]
    assert got[5].clean == "Date: d\r\n\r\nbody\n" and got[5].passed and got[5].found_before == 1
    assert got[3].clean == "From: a\n\n\nbody"


def archive(parts, comment=b"", date=(2024, 5, 6, 7, 8, 10), system=3):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, data in parts:
            info = zipfile.ZipInfo(path, date)
            info.create_system, info.external_attr = system, 0o644 << 16
            info.extra = b"\x99\x99\x02\x00ab"
            z.writestr(info, data)
        z.comment = comment
    return out.getvalue()


def test_containers_and_their_copies(spark):
    rows = [(1, archive([("a.txt", b"x"), ("b/", b""), ("b/c", b"y" * 1000)], b"by me")), (2, b"PK\x03\x04broken"), (3, archive([]))]
    read = entries(spark.createDataFrame(rows, "file_id int, content binary"))
    told = {r.file_id: r for r in packages.container(read).collect()}
    assert told[1].timestamps == 3 and told[1].extra_fields == 3 and told[1].attributes == 3 and told[1].has_comment and told[1].folders == 1
    assert {r.field for r in packages.container_findings(read).where("file_id = 1").collect()} == {"zip:timestamps", "zip:comment", "zip:externalAttributes", "zip:extraFields"}
    copies = entries(rebuilt(read.where("status = 'ok'")))
    assert packages.container_findings(copies).count() == 0
    same = packages.compared(read.where("status = 'ok'"), copies).first()
    assert (same.same, same.changed, same.lost, same.added, same.names_in_order, same.timestamps_neutral) == (2, 0, 0, 0, True, True)
    assert dict(packages.gated(spark.createDataFrame(rows, "file_id int, content binary")).collect()) == {1: None, 2: "malformed", 3: None}


def test_encrypted_entries_are_told(spark):
    data = bytearray(archive([("a.txt", b"x" * 50)]))
    at = data.find(b"PK\x01\x02")
    data[6] |= 1
    data[at + 8] |= 1
    read = entries(spark.createDataFrame([(1, bytes(data))], "file_id int, content binary"))
    assert [r.status for r in read.collect()] == ["encrypted"] and packages.routed(read).first().reason == "encrypted"


def test_geometry_of_other_lengths(spark):
    rows = spark.sql("SELECT array(struct(1.0 AS width, 2.0 AS height)) AS a, array(struct(1.0 AS width, 2.0 AS height), struct(1.0 AS width, 2.0 AS height)) AS b")
    assert not rows.select(relations.same_geometry(F.col("a"), F.col("b")).alias("same")).first().same
    assert rows.select(relations.same_geometry(F.col("b"), F.col("b")).alias("same")).first().same


def test_comments_that_span_pages(spark):
    page = b"OggS" + bytes(22) + b"\x01\xff" + b"OpusTags" + bytes(247)
    got = binary.scan(spark.createDataFrame([(1, page), (2, page[:30]), (3, b"")], "file_id int, content binary"), "ogg").collect()
    assert {r.file_id: (r.status, [f.field for f in r.findings]) for r in got} == {1: ("ok", ["OGG:comments"]), 2: ("error", []), 3: ("error", [])}


def ogg_page(packets, kind=0, number=0, open_=False):
    laces = b"".join(b"\xff" * (len(p) // 255) + (b"" if open_ and k == len(packets) - 1 else bytes([len(p) % 255])) for k, p in enumerate(packets))
    page = bytearray(b"OggS\0" + bytes([kind]) + bytes(8) + b"\1\2\3\4" + number.to_bytes(4, "little") + bytes(4) + bytes([len(laces)]) + laces + b"".join(packets))
    page[22:26] = bytes.fromhex(samples._checksum(bytes(page)))
    return bytes(page)


def test_comment_packets_are_emptied_and_pages_summed_anew(spark):
    def comments(magic, vendor, *entries):
        sized = lambda b: len(b).to_bytes(4, "little") + b
        return magic + sized(vendor) + len(entries).to_bytes(4, "little") + b"".join(map(sized, entries))

    vorbis = comments(b"\x03vorbis", b"enc", b"ARTIST=Ann", b"long=" + b"x" * 900) + b"\1"
    empty, setup, part = b"\x03vorbis" + bytes(8) + b"\1", b"\x05vorbis" + b"s" * 600, b"\x05vorbis" + b"s" * 503
    first, last = ogg_page([b"\x01vorbis" + bytes(23)], 2), ogg_page([b"sound"], 4, 2)
    cases = [
        (first + ogg_page([vorbis, setup], 0, 1) + last, first + ogg_page([empty, setup], 0, 1) + last),
        (first + ogg_page([vorbis, part], 0, 1, True) + last, first + ogg_page([empty, part], 0, 1, True) + last),  # the second packet goes on
        (first + ogg_page([b"p" * 255, comments(b"OpusTags", b"v")], 0, 1), first + ogg_page([b"p" * 255, b"OpusTags" + bytes(8)], 0, 1)),
        (first + last, first + last),
        (first + ogg_page([b"OpusTags" + bytes(247)], 0, 1, True), None),
    ]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "file_id int, content binary")
    got = {r.file_id: r for r in binary.clean_and_verify(rows, "ogg").collect()}
    assert [got[k].clean for k in range(5)] == [b for _, b in cases]
    assert [got[k].passed for k in range(5)] == [True, True, True, True, False] and got[0].found_before == 3


def one(spark, kind, *contents):
    rows = spark.createDataFrame(list(enumerate(contents)), "file_id int, content binary")
    return [r for r in sorted(binary.clean_and_verify(rows, kind).collect(), key=lambda r: r.file_id)]


def chunk(name, body):
    return name + len(body).to_bytes(4, "little") + body + bytes(len(body) % 2)


def riff(*chunks):
    body = b"WEBP" + b"".join(chunks)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def test_chunks_within_and_behind_the_extended_header(spark):
    size = bytes([9, 0, 0, 19, 0, 0])
    within = riff(chunk(b"VP8X", b"\x3e\0\0\0" + size + chunk(b"ICCP", b"icc") + chunk(b"EXIF", b"Ann Boe") + chunk(b"XMP ", b"<x/>") + chunk(b"ANMF", b"frame")))
    behind = riff(chunk(b"VP8X", b"\x0c\0\0\0" + size), chunk(b"VP8L", b"\x2f" + bytes(5)), chunk(b"EXIF", b"Ann Boe"))
    lossy = riff(chunk(b"VP8 ", b"\0\0\0\x9d\x01\x2a\x0a\0\x14\0" + b"data"))
    lossless, bare = riff(chunk(b"VP8L", b"\x2f" + (9 | 19 << 14).to_bytes(4, "little") + b"x")), riff(chunk(b"ALPH", b"x"))
    rows = one(spark, "webp", within, behind, lossy, lossless, bare, b"RIFF")
    assert [r.reason for r in rows] == [None, None, None, None, "malformed", "malformed"]
    assert rows[0].clean == riff(chunk(b"VP8X", b"\x32\0\0\0" + size + chunk(b"ICCP", b"icc") + chunk(b"ANMF", b"frame"))) and rows[0].found_before == 2
    assert rows[1].clean == riff(chunk(b"VP8X", bytes(4) + size), chunk(b"VP8L", b"\x2f" + bytes(5))) and rows[2].clean == lossy and rows[3].clean == lossless
    assert [r.passed for r in rows] == [True] * 4 + [False] * 2
    sizes = binary.scan(spark.createDataFrame([(0, within), (1, lossy), (2, lossless)], "file_id int, content binary"), "webp").select("dimensions.*").collect()
    assert {tuple(r) for r in sizes} == {(10, 20)}


def test_films_of_unknown_size(spark):
    header, info = bytes.fromhex("1A45DFA3") + b"\x84" + bytes.fromhex("4282") + b"\x81x", bytes.fromhex("1549A966")
    title, date = bytes.fromhex("7BA9") + b"\x87Ann Boe", bytes.fromhex("4461") + b"\x88" + bytes(8)
    long_title = bytes.fromhex("7BA9") + b"\x41\x00" + b"x" * 256
    cluster = bytes.fromhex("1F43B675") + b"\xff" + b"sound " * 5
    film = header + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + info + bytes([0x80 | len(title + date)]) + title + date + cluster
    large = header + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + info + (len(long_title) | 0x4000).to_bytes(2, "big") + long_title + cluster
    rows = one(spark, "mkv", film, large, header, b"", header + bytes.fromhex("18538067") + b"\xff")
    assert [r.status for r in rows] == ["ok", "ok", "error", "error", "ok"] and [r.found_before for r in rows] == [2, 1, 0, 0, 0]
    assert rows[0].clean == film.replace(title, b"\xec\x88" + bytes(8)).replace(date, b"\xec\x89" + bytes(9)) and rows[0].passed
    assert rows[1].clean == large.replace(long_title, b"\xec" + (257 | 0x4000).to_bytes(2, "big") + bytes(257)) and rows[1].passed


def test_icons_of_several_images(spark):
    rows = one(spark, "ico", samples_icon(), samples_icon()[:30], b"\0\0\1\0\0\0" + bytes(30), b"")
    assert [r.status for r in rows] == ["ok", "error", "error", "error"] and rows[0].passed and rows[0].found_before == 1
    assert len(rows[0].clean) == len(samples_icon()) - 12 - len(b"Author\0Ann")


def samples_icon():
    text = b"Author\0Ann"
    png = bytes.fromhex("89504E470D0A1A0A") + len(text).to_bytes(4, "big") + b"tEXt" + text + bytes(4) + bytes(4) + b"IEND" + bytes(4)
    images = [b"bitmap", png]
    out, at = b"\0\0\1\0\2\0", 6 + 32
    for image in images:
        out += bytes([16, 16]) + bytes(6) + len(image).to_bytes(4, "little") + at.to_bytes(4, "little")
        at += len(image)
    return out + b"".join(images)


def test_items_that_cannot_be_cleaned_in_place(spark):
    data = samples.files(spark, SF, "avif").orderBy("file_id").first().content
    data = bytes(data)
    at = data.index(b"\0\3\0\0\0\1") + 10  # how long the third item is
    beyond = data[:at] + b"\0\xff\xff\xff" + data[at + 4 :]
    plain = data.replace(b"\0Exif\0", b"\0abcd\0").replace(b"application/xmp+xml", b"application/abc+xml")
    nameless = data.replace(b"pitm", b"xxxx")
    many = data.replace(b"\x44\0\0\3", b"\x44\0\xff\xff")  # more places than their box holds
    rows = one(spark, "avif", beyond, plain, nameless, many, data[:100], data)
    assert [r.status for r in rows] == ["error", "ok", "ok", "error", "error", "ok"]
    assert rows[1].clean == plain and rows[1].passed and rows[1].found_before == 0
    assert [r.passed for r in rows] == [False, True, False, False, False, True]


@pytest.mark.parametrize("kind", binary.MEDIA)
def test_media_stay_as_they_are(spark, kind):
    files = samples.files(spark, SF, kind).where("file_id < 4")
    copies = binary.clean(files, kind).select("file_id", "content")
    before, after = (dict(binary.media(rows, kind).collect()) for rows in (files, copies))
    assert before == after and len(before) == 4 and None not in before.values()


def test_originals_are_listed_once_for_their_media(spark):
    plan = odd_files.media_kept(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 * len(odd_files.MEDIA)
    files = samples.files(spark, SF, "psd").where("file_id < 2").union(spark.createDataFrame([(7, b"none"), (8, None)], "file_id long, content binary"))
    got = {(r.file_id, r.copy): r.media_sha256 for r in binary.media_kept(files, "psd").collect()}
    assert len(got) == 8 and all(got[k, False] == got[k, True] for k in (0, 1, 7, 8))
    assert got[0, True] and got[1, True] != got[0, True] and got[7, True] is None and got[8, True] is None


def test_descriptions_of_findings(spark):
    rows = [("EXIF:Artist", "high"), ("EXIF:Flash", "low"), ("PNG:tEXt:a:b", "medium"), ("PNG:iTXt:", "medium"), ("PNG:vpAg", "medium"), ("GIF:Comment", "high"), (None, None)]
    frame = spark.createDataFrame(rows, "field string, severity string")
    told = [r[0] for r in frame.select(findings.description(F.col("field"), F.col("severity"))).collect()]
    assert told[:2] == [findings.SEVERITIES["high"], findings.SEVERITIES["low"]]
    assert told[2:4] == ["Текстовые метаданные PNG (a:b).", "Международные текстовые метаданные PNG (без названия)."]
    assert told[4:] == [findings.OTHER_CHUNK, "", ""]
