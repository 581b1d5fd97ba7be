import re
import zlib

from metaveil.operators import nested, pdf
from tests.test_nested import frame, held, packed


def document(*bodies, trailer="/Root 1 0 R", version="1.5", more=b""):
    """Objects numbered from 1; bodies are texts, or (dictionary, stream)."""
    out = f"%PDF-{version}\n".encode()
    for number, body in enumerate(bodies, 1):
        text = body if isinstance(body, str) else f"{body[0][:-2]} /Length {len(body[1])}>>"
        stream = b"" if isinstance(body, str) else b"\nstream\n" + body[1] + b"\nendstream"
        out += f"{number} 0 obj\n{text}".encode("latin-1") + stream + b"\nendobj\n"
    return out + more + (f"trailer\n<<{trailer}>>\nstartxref\n0\n%%EOF\n".encode() if trailer else b"")


CATALOG, ONE = "<</Type /Catalog /Pages 2 0 R>>", "<</Type /Pages /Kids [3 0 R] /MediaBox [0 0 10 20]>>"
PAGE = "<</Type /Page /Parent 2 0 R>>"


def told(spark, *contents):
    return {r.file_id: r for r in pdf.scan(frame(spark, *contents)).collect()}


def cleaned(spark, *contents):
    return {r.file_id: r for r in pdf.clean_and_verify(frame(spark, *contents)).collect()}


def readable(data):
    """Whether every line of the cross-reference table points at its object."""
    at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n\Z", data)[1])
    assert data[at : at + 4] == b"xref"
    for number, offset in re.findall(rb"\n(\d+) 1\n(\d{10}) 00000 n ", data[at:]):
        assert data[int(offset) :].startswith(number + b" 0 obj\n")
    return True


def test_trees_of_pages(spark):
    tree = [
        CATALOG, "<</Type /Pages /Kids 5 0 R /MediaBox 9 0 R>>", "<</Type /Page /Parent 2 0 R>>", "<</Type /Pages /Kids [6 0 R 2 0 R 7 0 R] /MediaBox [0 0 5 6]>>",
        "[3 0 R % a comment ]\n 4 0 R 8 0 R]", "<</Type /Page>>", "<</Type /Page /MediaBox [10 10 110.5 20]>>", "<</Type /Page>>", "[0 0 100 200]",
    ]
    (row,) = told(spark, document(*tree)).values()
    assert row.reason is None and [(p.width, p.height) for p in row.geometry] == [(100.0, 200.0), (5.0, 6.0), (100.5, 10.0), (100.0, 200.0)]


def test_text_of_strings(spark):
    info = "<</Title (a\\(b\\)\\\\ \\101\\\n(c)) /Author <FEFF00C400420020> /Subject <41 4> /Key#20word /Na#6de /Trapped /True /Creator ()>>"
    (row,) = told(spark, document(CATALOG, ONE, PAGE, info, trailer="/Root 1 0 R /Info 4 0 R")).values()
    assert [(f.field, f.value) for f in row.findings] == [("Info:Title", "a(b)\\ A(c)"), ("Info:Author", "ÄB "), ("Info:Subject", "A@"), ("Info:Key word", "Name"), ("Info:Creator", "")]
    assert set(row.raw) == {"a(b)\\ A(c)", "ÄB ", "A@", "Name", "Key word"}


def test_objects_in_streams_and_later_definitions(spark):
    inner = b"4 0 5 33 <</Title (Packed title) /Mod (x)>> <</Type /Annot /T (Ann Boe)>>"
    first = inner.index(b"<<")
    heads = f"4 0 5 {inner.index(b'<</Type') - first} ".encode()
    stream = zlib.compress(heads.ljust(first) + inner[first:])
    more = f"6 0 obj\n<</Type /ObjStm /N 2 /First {first} /Filter /FlateDecode /Length {len(stream)}>>\nstream\r\n".encode() + stream + b"\r\nendstream\nendobj\n"
    more += b"7 0 obj\n<</Type /XRef /Root 1 0 R /Info 4 0 R /ID [<00><00>] /Length 3>>\nstream\nabc\nendstream\nendobj\n"
    page = "<</Type /Page /Annots [5 0 R]>>"
    data = document(CATALOG, ONE, page, trailer="", more=more)
    later = data + b"3 0 obj\n<</Type /Page /Annots [5 0 R] /Rotate 90>>\nendobj\ntrailer\n<</Prev 1>>\n"
    for k, row in cleaned(spark, data, later).items():
        assert (row.reason, row.found_before, row.passed, row.leaked) == (None, 4, True, 0) and readable(row.content)
        assert b"/Rotate" in row.content if k == 2 else b"/Rotate" not in row.content
        assert b"Ann Boe" not in row.content and b"ObjStm" not in row.content and b"XRef" not in row.content and b"/Info" not in row.content


def test_metadata_of_any_object_goes(spark):
    packet = "<x:xmpmeta><rdf:RDF><xmp:CreatorTool>Brush 7</xmp:CreatorTool></rdf:RDF></x:xmpmeta>"
    data = document(
        CATALOG, ONE, "<</Type /Page /Resources <</XObject <</A 4 0 R>>>> >>", ("<</Type /XObject /Metadata 5 0 R>>", b"\0pixels endobj 9 0 obj"), ("<</Type /Metadata>>", packet.encode()), "<</Orphan (Old Name)>>",
    )
    (row,) = cleaned(spark, data).values()
    assert row.passed and b"rdf:RDF" not in row.content and b"Old Name" not in row.content and b"\0pixels endobj 9 0 obj\nendstream" in row.content
    catalog = document(CATALOG.replace("2 0 R", "2 0 R /Metadata 4 0 R"), ONE, PAGE, ("<</Type /Metadata>>", packet.encode()))
    assert [(f.field, f.value) for f in told(spark, catalog)[1].findings] == [("XMP:xmp:CreatorTool", "Brush 7")]


def test_what_is_refused(spark):
    loop = document(CATALOG, "<</Type /Pages /Kids [2 0 R]>>")
    files = [
        b"", b"%PDF-1.4\nno objects", document(CATALOG, ONE, PAGE, trailer="/Root 9 0 R"), loop, document(CATALOG, ONE, PAGE)[:-40] + b"(", document(CATALOG, ONE, PAGE, trailer="/Root 1 0 R /Encrypt 4 0 R"),
        document(CATALOG, ONE, "<</Type /Page /Annots [<</T (Ann Boe)>>]>>"), document(CATALOG, "<</Type /Pages /Kids [" + "3 0 R " * 501 + "]>>", PAGE), document(CATALOG, ONE, PAGE),
    ]
    got = cleaned(spark, *files)
    assert [got[k].reason for k in range(1, 10)] == ["malformed", "malformed", "malformed", "malformed", "malformed", "encrypted", "annotations-in-page", "too-many-pages", None]
    assert [got[k].passed for k in range(1, 10)] == [False] * 8 + [True]


def test_documents_within_archives(spark):
    good = document(CATALOG, ONE, PAGE, "<</Author (Ann Boe)>>", trailer="/Root 1 0 R /Info 4 0 R")
    locked = document(CATALOG, ONE, PAGE, trailer="/Root 1 0 R /Encrypt 4 0 R")
    got = {r.file_id: r for r in nested.clean_and_verify(frame(spark, packed([("a.pdf", good)]), packed([("a.pdf", locked)]))).collect()}
    assert (got[1].reason, got[1].traces, got[1].passed) == (None, 1, True) and b"Ann Boe" not in held(got[1].content)["a.pdf"]
    assert got[2].reason == "nested-clean-failed"
