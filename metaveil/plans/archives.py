"""Queries over archives that are put together from pages, and DuckDB SQL over the entries that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import documents, findings, packages
from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.tables import written

#: Ten kinds of package: paths of their entries, and contents other than the page.
KINDS = (
    (("word/document.xml", None), ("docProps/core.xml", None), ("word/comments.xml", None)),
    (("xl/other.xml", None), ("xl/media/a.png", None)),
    (("ppt/presentation.xml", None), ("ppt/media/x.HEIC", None)),
    (("mimetype", "application/vnd.oasis.opendocument.text"), ("content.xml", None)),
    (("mimetype", " application/vnd.oasis.opendocument.graphics-template "), ("META-INF/manifest.xml", "<manifest:encryption-data/>")),
    (("mimetype", "application/epub+zip"), ("META-INF/container.xml", None)),
    (("mimetype", "application/epub+zip"), ("META-INF/encryption.xml", "x")),
    (("a.txt", None), ("b/c.html", None)),
    (("word/document.xml", None), ("word/vbaProject.bin", None), ("_xmlsignatures/sig1.xml", "x")),
    (("xl/workbook.xml", None), ("customXml/item1.xml", None), ("xl/persons/person.xml", "x")),
)
_ROWS = [(k, pos, path, text) for k, kind in enumerate(KINDS) for pos, (path, text) in enumerate(kind)]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(_ROWS, "kind int, entry_pos int, path string, text string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("file_id"), (F.col("page_id") % len(KINDS)).cast("int").alias("kind"), "html", "url")
    author = F.concat(F.lit('<w:ins w:author="'), "url", F.lit('"/><w:ins w:author="Anonymous"/>'))
    content = F.coalesce("text", F.when(F.col("path") == "word/comments.xml", author).otherwise(F.col("html")))
    return pages.join(F.broadcast(kinds), "kind").select(
        "file_id", "entry_pos", "path", F.lit(False).alias("is_folder"), (F.col("path") == "mimetype").alias("stored"), content.cast("binary").alias("content")
    )


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt(_parts(spark, sf_dir))


def package_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.routed(entries(_archives(spark, sf_dir)))


def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of each entry."""
    rows = entries(_archives(spark, sf_dir))
    return rows.select("file_id", "entry_pos", "path", "size", "stored", F.sha2("content", 256).alias("sha256"), packages.neutral(F.col("at")).alias("neutral"), "status")


def archive_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.container(entries(_archives(spark, sf_dir))).select("file_id", "entries", "folders", "timestamps", "extra_fields", "attributes", "has_comment", "size")


def archive_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies lose their properties and get another document; both archives' entries are compared."""
    before = written(entries(_archives(spark, sf_dir)), "before")
    drop = before.where("path = 'docProps/core.xml'").select("file_id", "path")
    replace = before.where("path LIKE '%/document.xml'").select("file_id", "path", F.lit("<clean/>").cast("binary").alias("new"))
    return packages.compared(before, entries(packages.cleaned(before, drop, replace)))


def package_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.authors(entries(_archives(spark, sf_dir)))


def archive_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _archives(spark, sf_dir)
    changed = F.when(F.col("file_id") % 7 == 0, F.concat(F.unhex(F.lit("504B0708")), F.expr("substring(content, 5)"))).when(F.col("file_id") % 7 == 1, F.expr("substring(content, 1, 20)"))
    return packages.gated(written(files.withColumn("content", F.coalesce(changed, "content")), "files"))


def entry_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    image = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), "content")
    changed = parts.withColumn("content", F.when(F.col("path").rlike("(?i)png$"), image).when(F.col("path").rlike("(?i)heic$"), F.concat(F.unhex(F.lit("00000014667479706D696631000000006D696631")), "content")).otherwise(F.col("content")))
    return packages.nested_formats(entries(rebuilt(changed)))


def archive_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages that still stand in what their archive holds."""
    values = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("file_id"), F.col("url").alias("value"))
    return findings.leaks(values, packages.latin_corpus(entries(_archives(spark, sf_dir))))


#: Documents with everything to tell: kind, path and content, as SQL that both engines run over pages.
DOCUMENTS = (
    ("office", "[Content_Types].xml", "'<Types><Override PartName=\"/docProps/core.xml\" ContentType=\"x\"/> <Override PartName=\"/word/document.xml\" ContentType=\"y\"/></Types>'"),
    ("office", "_rels/.rels", "'<Relationships><Relationship Id=\"1\" Target=\"docProps/core.xml\"/><Relationship Id=\"2\" Target=\"word/document.xml\"/></Relationships>'"),
    ("office", "docProps/core.xml", "'<cp:coreProperties><dc:creator>' || page_id || ' &amp; Co</dc:creator><x:title> A title </x:title><cp:revision></cp:revision></cp:coreProperties>'"),
    ("office", "docProps/app.xml", "'<Properties><Company>Firm ' || page_id % 3 || '</Company><Pages>7</Pages></Properties>'"),
    ("office", "docProps/custom.xml", "'<Properties><property fmtid=\"1\" name=\"Client\"><vt:lpwstr>' || url || '</vt:lpwstr></property></Properties>'"),
    ("office", "word/document.xml", "'<w:p w:rsidR=\"00A1\" w:rsidP=\"00A2\"><w:ins w:author=\"Ann\" w:date=\"2024-01-01\"/><w:ins w:author=\"Bob\"/><w:ins w:author=\"Ann\"/>text</w:p>'"),
    ("office", "word/comments.xml", "'<w:comment w:author=\"Cy\" w:initials=\"C\">note</w:comment><w:comment w:author=\"Anonymous\"/>'"),
    ("odf", "mimetype", "'application/vnd.oasis.opendocument.text'"),
    ("odf", "meta.xml", "'<office:meta><dc:creator>' || page_id || '</dc:creator><meta:keyword>k1</meta:keyword><meta:keyword>k2</meta:keyword><meta:user-defined meta:name=\"Case\">' || url || '</meta:user-defined><meta:document-statistic a=\"1\"/></office:meta>'"),
    ("odf", "settings.xml", "'<s><config:config-item config:name=\"PrinterName\" t=\"s\">Laser 5</config:config-item></s>'"),
    ("odf", "content.xml", "'<office:annotation><dc:creator>Dee</dc:creator><dc:date>2024-05-05</dc:date>note</office:annotation>'"),
    ("odf", "Thumbnails/thumbnail.png", "'x'"),
    ("odf", "META-INF/manifest.xml", "'<m><manifest:file-entry manifest:full-path=\"Thumbnails/thumbnail.png\" a=\"b\"/> <manifest:file-entry manifest:full-path=\"content.xml\"/></m>'"),
    ("book", "mimetype", "'application/epub+zip'"),
    ("book", "META-INF/container.xml", "'<rootfile full-path=\"OPS/package.opf\"/>'"),
    ("book", "OPS/package.opf", "'<metadata><dc:title>T</dc:title> <meta name=\"calibre:rating\" content=\"' || page_id || '\"/> <meta property=\"dcterms:modified\">2024-02-02</meta><dc:contributor opf:role=\"bkp\">tool [1.0]</dc:contributor></metadata>'"),
)
TOLD, COPIED = documents.FINDINGS, documents.COPIES


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = [(path, sql) for k, path, sql in DOCUMENTS if k == kind]
    parts = F.explode(F.array(*[F.struct(F.lit(n).alias("entry_pos"), F.lit(path).alias("path"), F.expr(sql).cast("binary").alias("content")) for n, (path, sql) in enumerate(own)])).alias("p")
    rows = pages.select(F.col("page_id").alias("file_id"), parts).select("file_id", "p.*")
    return rebuilt(rows.withColumn("is_folder", F.lit(False)).withColumn("stored", F.col("path") == "mimetype"))


def _told(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings.explode(TOLD[kind](entries(_files(spark, sf_dir, kind)))).select("file_id", "pos", "category", "field", "label", "value", "severity")

    query.__name__ = f"{kind}_findings"
    return query


def _checked(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents.clean_and_verify(_files(spark, sf_dir, kind), kind).select("file_id", "reason", "found_before", "remaining", "leaked", "passed")

    query.__name__ = f"{kind}_clean_verify"
    return query


def _copied(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = entries(COPIED[kind](written(entries(_files(spark, sf_dir, kind)), "before")))
        return rows.select("file_id", "path", F.sha2("content", 256).alias("sha256"))

    query.__name__ = f"{kind}_copies"
    return query


#: What is put into pages, by page_id modulo their number, for the gates of documents.
PDF_MARKS = ("", "/Encrypt 5 0 R", "/Encrypted", "/ByteRange [0 1]", "/SubFilter /adbe.pkcs7.detached", "/SigFlags 3", "/SigFlags 4", "/Type /Sig ", "/XFA 1", "/Collection", "/EmbeddedFiles", "/Type/EmbeddedFile ", "/XFA /Encrypt")
CFB_NAMES = ("EncryptedPackage", "WordDocument", "Workbook", "PowerPoint Document", "Other", "EncryptionInfo")


def pdf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, PDF_MARKS)), (F.col("page_id") % len(PDF_MARKS) + 1).cast("int"))
    content = F.concat(F.lit("%PDF-1.7 "), mark, F.lit(" "), F.col("html")).cast("binary")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", packages.pdf_blocked(content).alias("reason"))


def compound_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.unhex(F.lit(n.encode("utf-16-le").hex())) for n in CFB_NAMES]), (F.col("page_id") % len(CFB_NAMES) + 1).cast("int"))
    content = F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode("html", "UTF-8"), name)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", packages.compound_kind(content).alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (package_routes, archive_contents, archive_containers, archive_copies, package_authors, archive_gated, entry_formats, archive_leaks, pdf_gate, compound_kinds, *(make(kind) for kind in TOLD for make in (_told, _checked, _copied)))
}


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_ENTRIES = f"""k(kind, entry_pos, path, text) AS (VALUES {", ".join(f"({k}, {p}, {_literal(n)}, {_literal(t)})" for k, p, n, t in _ROWS)}),
    e AS (SELECT page_id AS file_id, CAST(entry_pos AS INTEGER) AS entry_pos, path, url,
        coalesce(text, CASE WHEN path = 'word/comments.xml' THEN '<w:ins w:author="' || url || '"/><w:ins w:author="Anonymous"/>' ELSE html END) AS content
        FROM pages JOIN k ON page_id % {len(KINDS)} = kind)"""
_BLOCKED = " ".join(f"WHEN bool_or(regexp_matches(path, {_literal(p)})) THEN '{r}'" for r, p in packages.BLOCKED)
_MARKS = ", ".join(_literal(m) for m in PDF_MARKS)
_PDF = " ".join(f"WHEN regexp_matches(t, {_literal(p)}) THEN '{r}'" for r, p in packages.PDF)
ORACLE = {
    "package_routes": f"""WITH {_ENTRIES}, m AS (SELECT file_id, CASE
            WHEN bool_or(path = 'word/document.xml') THEN 'docx' WHEN bool_or(path = 'xl/workbook.xml') THEN 'xlsx' WHEN bool_or(path = 'ppt/presentation.xml') THEN 'pptx'
            WHEN bool_or(path LIKE 'word/%') THEN 'docx' WHEN bool_or(path LIKE 'xl/%') THEN 'xlsx' WHEN bool_or(path LIKE 'ppt/%') THEN 'pptx'
            WHEN bool_or(path = 'mimetype' AND trim(content) IN ('application/vnd.oasis.opendocument.text', 'application/vnd.oasis.opendocument.text-template')) THEN 'odt'
            WHEN bool_or(path = 'mimetype' AND trim(content) IN ('application/vnd.oasis.opendocument.graphics', 'application/vnd.oasis.opendocument.graphics-template')) THEN 'odg'
            WHEN bool_or(path = 'mimetype' AND trim(content) = 'application/epub+zip') THEN 'epub' ELSE 'zip' END AS format,
            CASE {_BLOCKED} END AS office, bool_or(path = 'META-INF/manifest.xml' AND contains(content, 'manifest:encryption-data')) AS secret, bool_or(path = 'META-INF/encryption.xml') AS locked
            FROM e GROUP BY file_id)
        SELECT file_id, format, CASE WHEN format IN ('docx', 'xlsx', 'pptx') THEN office WHEN format IN ('odt', 'odg') AND secret OR format = 'epub' AND locked THEN 'encrypted' END AS reason FROM m""",
    "archive_contents": f"WITH {_ENTRIES} SELECT file_id, entry_pos, path, CAST(strlen(content) AS BIGINT) AS size, path = 'mimetype' AS stored, sha256(content) AS sha256, true AS neutral, 'ok' AS status FROM e",
    "archive_containers": f"WITH {_ENTRIES} SELECT file_id, count(*) AS entries, CAST(0 AS BIGINT) AS folders, CAST(0 AS BIGINT) AS timestamps, CAST(0 AS BIGINT) AS extra_fields, CAST(0 AS BIGINT) AS attributes, false AS has_comment, CAST(sum(strlen(content)) AS BIGINT) AS size FROM e GROUP BY file_id",
    "archive_copies": f"""WITH {_ENTRIES} SELECT file_id, count(*) FILTER (path <> 'docProps/core.xml' AND path NOT LIKE '%/document.xml') AS same, count(*) FILTER (path LIKE '%/document.xml') AS changed,
        count(*) FILTER (path = 'docProps/core.xml') AS lost, CAST(0 AS BIGINT) AS added, NOT bool_or(path = 'docProps/core.xml') AS names_in_order, true AS timestamps_neutral FROM e GROUP BY file_id""",
    "package_authors": f"WITH {_ENTRIES} SELECT file_id, url AS authors FROM e WHERE path = 'word/comments.xml'",
    "archive_gated": "SELECT page_id AS file_id, CASE page_id % 7 WHEN 0 THEN 'multi-volume' WHEN 1 THEN 'malformed' END AS reason FROM pages",
    "entry_formats": f"WITH {_ENTRIES} SELECT file_id, path, CASE WHEN path LIKE '%.png' THEN 'png' END AS format FROM e",
    "archive_leaks": f"WITH {_ENTRIES} SELECT file_id, CAST(1 AS BIGINT) AS leaked FROM e GROUP BY file_id, url HAVING contains(string_agg(content, chr(10)), url)",
    "pdf_gate": f"WITH t AS (SELECT page_id, '%PDF-1.7 ' || list_extract([{_MARKS}], CAST(page_id % {len(PDF_MARKS)} + 1 AS INT)) || ' ' || html AS t FROM pages) SELECT page_id, CASE {_PDF} END AS reason FROM t",
    "compound_kinds": f"SELECT page_id, ['encrypted', 'legacy-office', 'legacy-office', 'legacy-office', 'unknown', 'encrypted'][CAST(page_id % {len(CFB_NAMES)} + 1 AS INT)] AS kind FROM pages",
}
#: category, field, label, value (SQL), severity of each finding, and what a copy's changed parts hold (None: they are gone).
EXPECTED = {
    "office": (
        ("office-author", "core:dc:creator", "Document author", "page_id || ' & Co'", "high"), ("office-custom", "core:dc:title", "Document title", "'A title'", "medium"),
        ("office-app", "app:Company", "Company", "'Firm ' || page_id % 3", "high"), ("office-custom", "app:Pages", "Pages", "'7'", "low"),
        ("office-custom", "custom:Client", 'Property "Client"', "url", "medium"), ("office-comment-authors", "docx:commentAuthor", "Comment author", "'Cy'", "high"),
        ("office-revisions", "docx:revisionAuthor", "Revision author (tracked changes)", "'Ann, Bob'", "high"), ("office-revisions", "docx:rsid", "Edit session IDs (rsid)", "'2'", "medium"),
    ),
    "odf": (
        ("author", "ODF:dc:creator", "Document author", "CAST(page_id AS VARCHAR)", "high"), ("other", "ODF:meta:keyword", "Keyword", "'k1'", "medium"), ("other", "ODF:meta:keyword", "Keyword", "'k2'", "medium"),
        ("other", "ODF:user:Case", 'Property "Case"', "url", "medium"), ("other", "ODF:statistics", "Document statistics", "'Present'", "low"),
        ("thumbnails", "ODF:thumbnail", "Document preview thumbnail", "'Present'", "medium"), ("device", "ODF:printer", "Printer name", "'Laser 5'", "high"),
        ("author", "ODF:annotationAuthor", "Annotation author", "'Dee'", "high"),
    ),
    "book": (
        ("software", "EPUB:calibre:rating", "Calibre field (rating)", "CAST(page_id AS VARCHAR)", "medium"), ("dates", "EPUB:modified", "Last modified date", "'2024-02-02'", "medium"),
        ("software", "EPUB:producer", "Producing tool", "'tool [1.0]'", "medium"),
    ),
}
CHANGED = {
    "[Content_Types].xml": "'<Types><Override PartName=\"/word/document.xml\" ContentType=\"y\"/></Types>'",
    "_rels/.rels": "'<Relationships><Relationship Id=\"2\" Target=\"word/document.xml\"/></Relationships>'",
    "docProps/core.xml": None, "docProps/app.xml": None, "docProps/custom.xml": None, "Thumbnails/thumbnail.png": None,
    "word/document.xml": "'<w:p><w:ins w:author=\"Anonymous\"/><w:ins w:author=\"Anonymous\"/><w:ins w:author=\"Anonymous\"/>text</w:p>'",
    "word/comments.xml": "'<w:comment w:author=\"Anonymous\">note</w:comment><w:comment w:author=\"Anonymous\"/>'",
    "meta.xml": _literal(documents.EMPTY_META).replace("\n", "' || chr(10) || '"), "settings.xml": "'<s></s>'", "content.xml": "'<office:annotation><dc:creator>Anonymous</dc:creator>note</office:annotation>'",
    "META-INF/manifest.xml": "'<m><manifest:file-entry manifest:full-path=\"content.xml\"/></m>'", "OPS/package.opf": "'<metadata><dc:title>T</dc:title></metadata>'",
}
for _kind, _rows in EXPECTED.items():
    ORACLE[f"{_kind}_findings"] = " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({k} AS INTEGER) AS pos, '{c}' AS category, '{f}' AS field, '{n}' AS label, {v} AS value, '{s}' AS severity FROM pages" for k, (c, f, n, v, s) in enumerate(_rows)
    )
    ORACLE[f"{_kind}_clean_verify"] = f"SELECT page_id AS file_id, CAST(NULL AS VARCHAR) AS reason, CAST({len(_rows)} AS BIGINT) AS found_before, CAST(0 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS leaked, true AS passed FROM pages"
    ORACLE[f"{_kind}_copies"] = " UNION ALL ".join(
        f"SELECT page_id AS file_id, '{path}' AS path, sha256({CHANGED.get(path, sql)}) AS sha256 FROM pages" for kind, path, sql in DOCUMENTS if kind == _kind and CHANGED.get(path, sql) is not None
    )
