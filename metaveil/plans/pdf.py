"""Queries over portable documents that are put together from pages, and DuckDB SQL: the findings from the page's columns, the copies from the objects that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import findings, pdf
from metaveil.plans.binary import DUCK, SPARK, Digits

#: What a document is, by page_id modulo four: as it is; changed later, by an addition; with its address in the text; locked.
KINDS = 4
HEAD = "%PDF-1.7\n"
CATALOG = "<</Type /Catalog /Pages 2 0 R /Metadata 5 0 R /PieceInfo <</App <</Private (x)>>>>>>"
TREE, PAGE = "<</Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 612 792.5]>>", "<</Type /Page /Parent 2 0 R /Contents 4 0 R /Annots 8 0 R>>"
NOTE = "<</Type /Annot /Subtype /Text /T (Ann \\(B\\) \\103) /M (D:2024) /NM (n1) /Contents (note)>>"
PACKET = ("<?xpacket?><rdf:RDF><dc:creator><rdf:li>", "</rdf:li></dc:creator><ex:Mark/></rdf:RDF>")
TRAILER = "trailer\n<</Size 9 /Root 1 0 R /Info 7 0 R /ID [<00><01>]>>\nstartxref\n0\n%%EOF\n"


def _q(text: str) -> str:
    return "'" + text.encode("latin-1").hex().upper() + "'"


def _object(number: int, body: str) -> str:
    return _q(f"{number} 0 obj\n{body}\nendobj\n")


def _content(d: Digits) -> tuple[str, str]:
    """Digits and number of bytes of what the page shows."""
    seen = "CASE WHEN page_id % 4 = 2 THEN {} ELSE {} END"
    return seen.format(f"{d.of('html')} || {d.of('url')}", d.of("html")), seen.format(f"{d.size('html')} + {d.size('url')}", d.size("html"))


def _number(d: Digits, number: str) -> str:
    return f"hex(encode(CAST({number} AS {'STRING' if d is SPARK else 'VARCHAR'}){", 'UTF-8'" if d is SPARK else ''}))"


def _file(d: Digits) -> list[str]:
    shown, size = _content(d)
    packet = f"{_q(PACKET[0])} || {d.of('url')} || {_q(PACKET[1])}"
    length = d.size("url", sum(map(len, PACKET)))
    return [
        _q(HEAD), _object(1, CATALOG), _object(2, TREE), _object(3, PAGE), _object(8, "[6 0 R]"),
        f"{_q('4 0 obj' + chr(10) + '<</Length ')} || {_number(d, size)} || {_q('>>' + chr(10) + 'stream' + chr(10))} || {shown} || {_q(chr(10) + 'endstream' + chr(10) + 'endobj' + chr(10))}",
        f"{_q('5 0 obj' + chr(10) + '<</Type /Metadata /Length ')} || {_number(d, length)} || {_q('>>' + chr(10) + 'stream' + chr(10))} || {packet} || {_q(chr(10) + 'endstream' + chr(10) + 'endobj' + chr(10))}",
        _object(6, NOTE), f"{_q('7 0 obj' + chr(10) + '<</Author (')} || {d.of('url')} || {_q(') /Project (Plan 9) /Trapped /False>>' + chr(10) + 'endobj' + chr(10))}",
        f"CASE WHEN page_id % 4 = 3 THEN {_q(TRAILER.replace('/Size', '/Encrypt 9 0 R /Size'))} ELSE {_q(TRAILER)} END",
        f"CASE WHEN page_id % 4 = 1 THEN {_object(7, '<</Author (New Hand)>>')} || {_q(TRAILER.replace('/ID [<00><01>]', ''))} ELSE '' END",
    ]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("file_id"), F.unhex(F.expr(" || ".join(f"({x})" for x in _file(SPARK)))).alias("content"))


def pdf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.explode(pdf.scan(_files(spark, sf_dir)).where("reason IS NULL")).select("file_id", "pos", "category", "field", "label", "value", "severity")


def pdf_clean_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pdf.clean_and_verify(_files(spark, sf_dir))
    return done.select("file_id", "reason", F.sha2("content", 256).alias("clean_sha256"), "found_before", "pages", "remaining", "leaked", "passed")


def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many definitions, objects and references each document has, and which object describes it."""
    rows, defined, trailer, _, _ = pdf.read(_files(spark, sf_dir))
    counted = rows.where("kind = 'object'").groupBy("file_id").agg(F.count("*").alias("definitions"))
    return counted.join(defined.groupBy("file_id").agg(F.count("*").alias("objects")), "file_id").join(trailer, "file_id")


QUERIES = {f.__name__: f for f in (pdf_findings, pdf_clean_verify, pdf_objects)}

#: category, field, label, value (SQL), severity, and of which kinds (SQL)
TOLD = (
    ("pdf-author", "Info:Author", "Document author", "CASE page_id % 4 WHEN 1 THEN 'New Hand' ELSE url END", "high", "true"),
    ("pdf-custom", "Info:Project", 'Property "Project"', "'Plan 9'", "medium", "page_id % 4 <> 1"),
    ("pdf-xmp", "XMP:dc:creator", "XMP author (Dublin Core)", "url", "high", "true"), ("pdf-xmp", "XMP:custom-namespaces", "XMP custom namespaces", "'ex'", "medium", "true"),
    ("pdf-identifiers", "Trailer:ID", "Document identifier (trailer /ID)", "'Present'", "low", "true"),
    ("pdf-custom", "PieceInfo", "Private application data (PieceInfo)", "'Present'", "medium", "true"), ("pdf-annotations", "Annot:T", "Comment authors", "'1'", "high", "true"),
)


def _copy_sql() -> str:
    """The objects that stay, in the order of their numbers, and the table of their places."""
    shown, size = _content(DUCK)
    before = [HEAD + "%âãÏÓ\n", "1 0 obj\n<</Type /Catalog\n/Pages 2 0 R>>\nendobj\n", "2 0 obj\n<</Type /Pages\n/Kids [3 0 R]\n/Count 1\n/MediaBox [0 0 612 792.5]>>\nendobj\n", "3 0 obj\n<</Type /Page\n/Parent 2 0 R\n/Contents 4 0 R\n/Annots 8 0 R>>\nendobj\n"]
    start, end = "4 0 obj\n<</Length ", "\nendstream\nendobj\n"
    after = ["6 0 obj\n<</Type /Annot\n/Subtype /Text\n/Contents (note)>>\nendobj\n", "8 0 obj\n[6 0 R]\nendobj\n"]
    places = [sum(map(len, before[:k])) for k in range(1, len(before) + 1)]
    behind = f"({places[-1]} + {len(start)} + strlen(CAST({size} AS VARCHAR)) + {len('>>' + chr(10) + 'stream' + chr(10))} + {size} + {len(end)})"
    line = lambda n, at: f"printf('{n} 1' || chr(10) || '%010d 00000 n ' || chr(10), CAST({at} AS BIGINT))"
    lines = [line(n, at) for n, at in zip((1, 2, 3, 4), places, strict=True)] + [line(6, behind), line(8, f"{behind} + {len(after[0])}")]
    table = " || ".join(["'xref' || chr(10) || '0 1' || chr(10) || '0000000000 65535 f ' || chr(10)", *lines])
    last = f"'trailer' || chr(10) || '<</Size 9/Root 1 0 R>>' || chr(10) || 'startxref' || chr(10) || CAST({behind} + {sum(map(len, after))} AS VARCHAR) || chr(10) || '%%EOF' || chr(10)"
    digits = [_q("".join(before)), _q(start), _number(DUCK, size), _q(">>\nstream\n"), f"({shown})", _q(end), _q("".join(after)), f"hex(encode({table} || {last}))"]
    return " || ".join(digits)


_N = " + ".join(f"CAST({test} AS INT)" for *_, test in TOLD)
ORACLE = {
    "pdf_findings": " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({' + '.join([f'CAST({t[5]} AS INT)' for t in TOLD[:k]] or ['0'])} AS INTEGER) AS pos, '{c}' AS category, '{f}' AS field, '{n}' AS label, {v} AS value, '{s}' AS severity FROM pages WHERE page_id % 4 <> 3 AND {test}"
        for k, (c, f, n, v, s, test) in enumerate(TOLD)
    ),
    "pdf_clean_verify": f"""SELECT page_id AS file_id, CASE page_id % 4 WHEN 3 THEN 'encrypted' END AS reason, CASE WHEN page_id % 4 <> 3 THEN sha256(unhex({_copy_sql()})) END AS clean_sha256,
        CAST({_N} AS BIGINT) AS found_before, CAST(1 AS BIGINT) AS pages, CASE WHEN page_id % 4 <> 3 THEN CAST(0 AS BIGINT) END AS remaining,
        CASE page_id % 4 WHEN 2 THEN CAST(1 AS BIGINT) WHEN 3 THEN NULL ELSE CAST(0 AS BIGINT) END AS leaked, page_id % 4 < 2 AS passed FROM pages""",
    "pdf_objects": "SELECT page_id AS file_id, CAST(CASE page_id % 4 WHEN 1 THEN 9 ELSE 8 END AS BIGINT) AS definitions, CAST(8 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS root, CAST(7 AS BIGINT) AS info, true AS has_id FROM pages",
}
