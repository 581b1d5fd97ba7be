import io
import random
import zipfile

import pytest

from metaveil.operators import contents, documents, leaks, nested, packages
from metaveil.sources.archives import entries, rebuilt

PNG_START = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000001000000020802000000") + bytes(4)
PNG_END = bytes.fromhex("0000000049454E44AE426082")


def chunk(name, body):
    return len(body).to_bytes(4, "big") + name + body + bytes(4)


def png(*texts):
    return PNG_START + b"".join(chunk(b"tEXt", t) for t in texts) + chunk(b"IDAT", b"pixels") + PNG_END


def packed(parts, comment=b"", method=zipfile.ZIP_DEFLATED, date=(2024, 5, 6, 7, 8, 10)):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for path, data in parts:
            info = zipfile.ZipInfo(path, date)
            info.external_attr, info.compress_type = 0o644 << 16, method
            z.writestr(info, data)
        z.comment = comment
    return out.getvalue()


def frame(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents, 1)), "file_id long, content binary")


def held(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


def docx(author, *more):
    core = f"<cp:coreProperties><dc:creator>{author}</dc:creator></cp:coreProperties>"
    return packed([("[Content_Types].xml", "<Types/>"), ("docProps/core.xml", core), *more, ("word/document.xml", "<w:p>text</w:p>")])


def test_values_that_stay_anywhere_in_a_document_are_leaks(spark):
    name = "Zelda Quill"
    files = frame(
        spark,
        docx(name),
        docx(name, ("word/settings.xml", f"<w:x>{name}</w:x>")),
        docx(name, ("word/styles.xml", f'<w:style w:name="{name}"/>')),
        docx(name, ("word/media/a.png", PNG_START + chunk(b"IDAT", name.encode()) + PNG_END)),
        docx(name, ("word/media/a.png", png(b"Author\0Zelda Quill", b"Software\0Brush 7"))),
        docx("Zel", ("word/settings.xml", "<w:x>Zel</w:x>")),
    )
    got = {r.file_id: r for r in documents.clean_and_verify(files, "office").collect()}
    assert [(got[i].leaked, got[i].passed) for i in range(1, 7)] == [(0, True), (1, False), (1, False), (1, False), (0, True), (0, True)]
    assert got[5].found_before == 3 and held(got[5].content)["word/media/a.png"] == png()  # author, images, dates
    assert all(r.remaining == 0 for r in got.values())


def test_images_that_are_none_do_not_pass(spark):
    files = frame(spark, docx("Ann Boe", ("word/media/a.png", b"no image")), docx("Ann Boe", ("word/media/a.txt", b"no image")))
    assert [r.passed for r in documents.clean_and_verify(files, "office").orderBy("file_id").collect()] == [False, True]


def test_copies_of_documents_are_searched_once(spark):
    """What stands in copies is told before they are written: no task of Python is left to whatever asks for the result."""
    done = documents.clean_and_verify(frame(spark, docx("Zelda Quill", ("word/settings.xml", "<w:x>Zelda Quill</w:x>")), docx("Ann Boe")), "office")
    assert "InArrow" not in done._jdf.queryExecution().executedPlan().toString()
    assert [(r.leaked, r.passed) for r in done.orderBy("file_id").collect()] == [(1, False), (0, True)]


def test_what_is_read_of_nested_copies_is_not_written(spark, monkeypatch):
    names, write = [], contents.written
    monkeypatch.setattr(contents, "written", lambda df, name: names.append(name) or write(df, name))
    done = nested.clean_and_verify(frame(spark, packed([("a.txt", b"x"), ("p.png", png(b"Author\0PRIVATE_PNG"))]), b"not zip")).collect()
    assert names == ["level0"] and {r.file_id: (r.leaked, r.passed) for r in done} == {1: (0, True), 2: (None, False)}


@pytest.mark.parametrize("kind", ["office", "odf", "book"])
def test_documents_with_a_locked_entry_have_no_copy(spark, kind):
    data = bytearray(docx("Ann Boe") if kind == "office" else packed([("mimetype", "application/epub+zip" if kind == "book" else "application/vnd.oasis.opendocument.text"), ("content.xml", "<x/>")]))
    data[data.find(b"PK\x01\x02") + 8] |= 1
    row = documents.clean_and_verify(frame(spark, bytes(data)), kind).first()
    assert (row.reason, row.content, row.passed) == ("encrypted", None, False)
    copies = documents.COPIES[kind](entries(frame(spark, bytes(data))))
    assert copies.first().content is None


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_broken_entries_of_every_method(spark, method):
    good = packed([("a.txt", random.Random(1).randbytes(500))], method=method)
    bad = bytearray(good)
    bad[60:100] = bytes(40)
    read = entries(frame(spark, good, bytes(bad))).orderBy("file_id").collect()
    assert [r.status for r in read] == ["ok", "encrypted"]
    assert dict(packages.routed(entries(frame(spark, bytes(bad)))).select("file_id", "reason").collect()) == {1: "encrypted"}


def test_one_id_of_two_archives(spark):
    files = spark.createDataFrame([(1, packed([("a.txt", b"x")])), (1, packed([("a.txt", b"y")]))], "file_id long, content binary")
    assert rebuilt(entries(files)).first().content is None
    assert packages.routed(entries(files)).first().reason == "repeated-id"
    assert [(r.reason, r.passed) for r in nested.clean_and_verify(files).collect()] == [("repeated-id", False)]


def test_mixed_nested_and_deep_archives(spark):
    inner = packed([("inner/photo.png", png(b"Author\0PRIVATE_PNG"))], b"INNER_COMMENT")
    deeper = packed([("too-deep.txt", b"x")])
    files = frame(
        spark,
        packed([("docs/readme.txt", b"visible text stays"), ("bin/app.bin", bytes(5)), ("images/photo.png", png(b"Author\0PRIVATE_PNG"))], b"PRIVATE_COMMENT"),
        packed([("nested/archive.zip", inner)], b"OUTER_COMMENT"),
        packed([("nested/archive.zip", packed([("deep.zip", deeper)]))]),
        packed([("a.zip", packed([("../evil.txt", b"x")]))]),
        b"not zip",
        packed([]),
        packed([("a.txt", b"x"), ("report.docx", docx("Ann Boe")), ("old.docx", bytes.fromhex("D0CF11E0A1B11AE1") + bytes(50))]),
        packed([("bad.docx", docx("Ann Boe", ("word/vbaProject.bin", b"x")))]),
    )
    got = {r.file_id: r for r in nested.clean_and_verify(files).collect()}
    reasons = {3: "too-deep", 4: "path-traversal", 5: "malformed", 6: "empty", 8: "nested-clean-failed"}
    assert {i: r.reason for i, r in got.items() if r.reason} == reasons
    assert {i for i, r in got.items() if r.passed} == {1, 2, 7} and all(got[i].content is None for i in reasons)
    assert held(got[1].content) == {"docs/readme.txt": b"visible text stays", "bin/app.bin": bytes(5), "images/photo.png": png()}
    assert held(held(got[2].content)["nested/archive.zip"]) == {"inner/photo.png": png()}
    assert (got[1].found, got[1].traces, got[1].supported, got[1].unsupported) == (4, 1, 1, 2)  # dates, comment, attributes, traces
    assert (got[2].traces, got[2].nested) == (4, 1)  # those that the inner container tells
    assert set(held(held(got[7].content)["report.docx"])) == {"[Content_Types].xml", "word/document.xml"}


def test_leaks_are_found_in_one_pass(spark):
    rows = [(1, "ein Wort: Müller & Söhne".encode(), ["Müller", "Söhne", "Wort", "ein", "abcd"]), (2, None, ["abcd"]), (3, b"abcd", None), (4, b"abab" * 3, ["abab", "baba"])]
    found = leaks.search(spark.createDataFrame(rows, "file_id int, content binary, raw array<string>"))
    assert {r.file_id: r.leaks for r in found.collect()} == {1: ["Müller", "Söhne", "Wort"], 2: [], 3: [], 4: ["abab", "baba"]}
    assert dict(leaks.leaked(found).collect()) == {1: 3, 2: 0, 3: 0, 4: 2}
