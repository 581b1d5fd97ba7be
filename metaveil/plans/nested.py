"""Queries over archives within archives, documents with images, and files that must not pass: pages as their parts, and what becomes of each, in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import documents, nested
from metaveil.plans.archives import CHANGED, DOCUMENTS, EXPECTED
from metaveil.plans.binary import DUCK, PNG_END, PNG_START, SPARK, Digits, _chunk, _jpeg_image, _png_image, _segment
from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.tables import written


def _photo(d: Digits) -> str:
    return " || ".join([PNG_START, _chunk(d, "tEXt", f"{d.text('Author')} || '00' || {d.of('url')}", d.size("url", 7)), _png_image(d), PNG_END])


def _photo_copy(d: Digits) -> str:
    return " || ".join([PNG_START, _png_image(d), PNG_END])


def _commented(d: Digits) -> str:
    """A comment behind the coded image: no copy of it passes."""
    return " || ".join(["'FFD8'", _jpeg_image(d), _segment(d, "FFFE", d.of("url"), d.size("url")), "'FFD9'"])


def _text(d: Digits, text: str) -> str:
    return f"hex(encode({text}{", 'UTF-8'" if d is SPARK else ''}))"


VISIBLE = "'visible text of ' || page_id"
SVG, SVG_COPY = "'<svg><title>Plan of ' || page_id || '</title></svg>'", "'<svg></svg>'"
MAIL, MAIL_COPY = "'From: a@b.c' || chr(10) || 'X-Mailer: Mailer ' || page_id || chr(10) || 'To: d@e.f' || chr(10) || chr(10) || 'body'", "'From: a@b.c' || chr(10) || 'To: d@e.f' || chr(10) || chr(10) || 'body'"


@dataclass(frozen=True)
class Archive:
    #: path, digits of an entry, and of its copy (None: as it was); "!" stands between an inner archive's path and that of its entry
    entries: tuple
    supported: int
    unsupported: int
    nested: int = 0
    traces: int = 0
    reason: str | None = None
    leaked: int = 0

    @property
    def passed(self) -> bool:
        return self.reason is None and not self.leaked


_DOCX = tuple((f"report.docx!{path}", lambda d, sql=sql: _text(d, sql), (lambda d, sql=CHANGED.get(path, sql): _text(d, sql)) if CHANGED.get(path, sql) is not None else "gone") for kind, path, sql in DOCUMENTS if kind == "office")
ARCHIVES = (
    Archive((("docs/readme.txt", lambda d: _text(d, VISIBLE), None), ("bin/app.bin", lambda d: "'0102030405'", None), ("images/photo.png", _photo, _photo_copy)), 1, 2, traces=1),
    Archive((("b.txt", lambda d: _text(d, VISIBLE), None), ("a/inner.zip!photo.png", _photo, _photo_copy), ("a/inner.zip!note.txt", lambda d: _text(d, VISIBLE), None)), 1, 1, 1, 1),
    Archive((("b.txt", lambda d: _text(d, VISIBLE), None), ("a/inner.zip!note.txt", lambda d: _text(d, VISIBLE), None), ("a/inner.zip!deep.zip", lambda d: "'504B0506' || repeat('00', 18)", None)), 1, 1, 1, reason="too-deep"),
    # the value that the image loses stands in a text, which stays
    Archive((("docs/readme.txt", lambda d: _text(d, "'see ' || url"), None), ("images/photo.png", _photo, _photo_copy)), 1, 1, traces=1, leaked=1),
    Archive((*_DOCX, ("x.svg", lambda d: _text(d, SVG), lambda d: _text(d, SVG_COPY)), ("m.eml", lambda d: _text(d, MAIL), lambda d: _text(d, MAIL_COPY))), 3, 0, traces=len(EXPECTED["office"]) + 2),
    Archive((("a.txt", lambda d: _text(d, VISIBLE), None), ("p.jpg", _commented, None)), 1, 1, traces=1, reason="verification-failed"),
    Archive((("a/inner.zip!x.svg", lambda d: _text(d, "'<svg><script/></svg>'"), None), ("b.txt", lambda d: _text(d, VISIBLE), None)), 1, 1, 1, reason="nested-clean-failed"),
)


def _put_together(rows: DataFrame) -> DataFrame:
    return rebuilt(rows.withColumn("is_folder", F.lit(False)).withColumn("stored", F.lit(False)))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archives; what stands in inner ones is put together first."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("kind", F.col("page_id") % len(ARCHIVES))
    level = None
    for k, kind in enumerate(ARCHIVES):
        parts = [F.struct(F.lit(n).alias("entry_pos"), F.lit(path).alias("path"), F.unhex(F.expr(make(SPARK))).alias("content")) for n, (path, make, _) in enumerate(kind.entries)]
        rows = pages.where(F.col("kind") == k).select(F.col("page_id").alias("file_id"), F.explode(F.array(*parts)).alias("p")).select("file_id", "p.*")
        level = rows if level is None else level.union(rows)
    split = F.split("path", "!")
    inner = level.where(F.contains("path", F.lit("!"))).select(F.struct("file_id", split[0].alias("path")).alias("file_id"), "entry_pos", split[1].alias("path"), "content")
    first = inner.groupBy("file_id").agg(F.min("entry_pos").alias("entry_pos"))
    inner = _put_together(inner).join(first, "file_id").select("file_id.file_id", "entry_pos", "file_id.path", "content")
    return _put_together(level.where(~F.contains("path", F.lit("!"))).unionByName(inner))


def nested_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in archives on all levels, and whether their copies pass."""
    return nested.clean_and_verify(written(_archives(spark, sf_dir), "files")).select("file_id", "reason", "found", "traces", "supported", "unsupported", "nested", "leaked", "passed")


def nested_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the copies hold, on both levels."""
    done = nested.clean_and_verify(written(_archives(spark, sf_dir), "files"))
    rows = written(entries(done.where("content IS NOT NULL").select("file_id", "content")), "copies")
    inside = rows.where(F.col("path").rlike("(zip|docx)$")).select(F.struct("file_id", "path").alias("file_id"), "content")
    own = rows.where(~F.col("path").rlike("(zip|docx)$")).select("file_id", "path", F.sha2("content", 256).alias("sha256"))
    return own.union(entries(inside).select("file_id.file_id", F.concat("file_id.path", F.lit("!"), "path"), F.sha2("content", 256)))


def nested_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries with their formats."""
    return nested.tree(_archives(spark, sf_dir))


def _office(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0: as it is. 1: with images, one of which has traces. 2: the author's name stands in the text. 3: an entry is encrypted."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    own = [(path, _text(SPARK, sql), "true") for kind, path, sql in DOCUMENTS if kind == "office"]
    own += [("word/media/image1.png", _photo(SPARK), "page_id % 4 = 1"), ("word/media/image2.PNG", _photo_copy(SPARK), "page_id % 4 = 1")]
    own += [("word/footer1.xml", _text(SPARK, "'<w:t>' || page_id || ' & Co, ' || url || '</w:t>'"), "page_id % 4 = 2")]
    parts = F.array(*[F.when(F.expr(test), F.struct(F.lit(n).alias("entry_pos"), F.lit(path).alias("path"), F.unhex(F.expr(digits)).alias("content"))) for n, (path, digits, test) in enumerate(own)])
    rows = pages.select(F.col("page_id").alias("file_id"), F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("file_id", "p.*")
    files = _put_together(rows)
    digits = F.hex("content")
    at = (F.instr(digits, "504B010214") + 1) / 2 + 8  # the flags of the first entry in the directory
    locked = F.overlay(F.col("content"), F.unhex(F.lit("01")), at.cast("int"))
    return files.withColumn("content", F.when(F.col("file_id") % 4 == 3, locked).otherwise(F.col("content")))


def office_odd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = documents.clean_and_verify(_office(spark, sf_dir), "office")
    return done.select("file_id", "format", "reason", "found_before", F.col("content").isNotNull().alias("has_copy"), "remaining", "leaked", "passed")


def office_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of documents, as copies have them."""
    done = documents.clean_and_verify(_office(spark, sf_dir), "office")
    rows = entries(done.where("content IS NOT NULL").select("file_id", "content")).where(F.contains("path", F.lit("/media/")))
    return rows.select("file_id", "path", F.sha2("content", 256).alias("sha256"))


def office_custom_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copies hold once parts of one's own XML are removed, with what refers to them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    parts = F.array(*[F.struct(F.lit(n).alias("entry_pos"), F.lit(path).alias("path"), F.unhex(F.expr(_text(SPARK, sql))).alias("content")) for n, (path, sql, _) in enumerate(CUSTOM)])
    files = _put_together(pages.select(F.col("page_id").alias("file_id"), F.explode(parts).alias("p")).select("file_id", "p.*"))
    done = documents.clean_and_verify(files, "office", remove_custom_xml=True)
    rows = entries(done.where("passed").select("file_id", "content"))
    return rows.select("file_id", "path", F.sha2("content", 256).alias("sha256"))


#: Parts of a document with XML of its own: path, content as SQL, and that of the copy (None: it is gone).
CUSTOM = (
    ("[Content_Types].xml", "'<Types><Override PartName=\"/customXml/item1.xml\" ContentType=\"x\"/><Override PartName=\"/word/document.xml\" ContentType=\"y\"/></Types>'", "'<Types><Override PartName=\"/word/document.xml\" ContentType=\"y\"/></Types>'"),
    ("word/document.xml", "'<w:p>' || page_id || '</w:p>'", "'<w:p>' || page_id || '</w:p>'"),
    ("word/_rels/document.xml.rels", "'<R><Relationship Id=\"1\" Target=\"../customXml/item1.xml\"/> <Relationship Id=\"2\" Target=\"styles.xml\"/></R>'", "'<R><Relationship Id=\"2\" Target=\"styles.xml\"/></R>'"),
    ("customXml/item1.xml", "'<secret>' || url || '</secret>'", None),
)


QUERIES = {f.__name__: f for f in (nested_archives, nested_copies, nested_tree, office_odd_documents, office_images, office_custom_xml)}


def _case(value) -> str:
    return f"CASE page_id % {len(ARCHIVES)} " + " ".join(f"WHEN {k} THEN {value(a)}" for k, a in enumerate(ARCHIVES)) + " END"


def _copied_rows() -> list[str]:
    rows = []
    for k, kind in enumerate(ARCHIVES):
        for path, make, copy in kind.entries if kind.reason is None else ():
            if copy != "gone":
                rows.append(f"SELECT page_id AS file_id, '{path}' AS path, sha256(unhex({(copy or make)(DUCK)})) AS sha256 FROM pages WHERE page_id % {len(ARCHIVES)} = {k}")
    return rows


def _tree_rows() -> list[str]:
    kinds, rows = {"png": "png", "jpg": "jpeg", "svg": "svg", "eml": "eml", "zip": "zip"}, []
    for k, kind in enumerate(ARCHIVES):
        paths = [p for p, *_ in kind.entries if not p.startswith("report.docx!")]
        told = [(p, kinds.get(p.rpartition(".")[2])) for p in paths] + [(p, f) for p, f in (("report.docx", "office"),) if len(paths) < len(kind.entries)]
        told += [(p, "zip") for p in {p.split("!")[0] for p in paths if "!" in p}]
        rows += [f"SELECT page_id AS file_id, CAST({int('!' in p)} AS INTEGER) AS level, '{p}' AS path, {f"'{f}'" if f else "CAST(NULL AS VARCHAR)"} AS format FROM pages WHERE page_id % {len(ARCHIVES)} = {k}" for p, f in told]
    return rows


_TOLD = len(EXPECTED["office"])
ORACLE = {
    "nested_archives": f"""SELECT page_id AS file_id, {_case(lambda a: f"'{a.reason}'" if a.reason else "CAST(NULL AS VARCHAR)")} AS reason, CAST({_case(lambda a: int(a.traces > 0))} AS BIGINT) AS found,
        CAST({_case(lambda a: a.traces)} AS BIGINT) AS traces, CAST({_case(lambda a: a.supported)} AS BIGINT) AS supported, CAST({_case(lambda a: a.unsupported)} AS BIGINT) AS unsupported,
        CAST({_case(lambda a: a.nested)} AS BIGINT) AS nested, {_case(lambda a: "CAST(NULL AS BIGINT)" if a.reason else f"CAST({a.leaked} AS BIGINT)")} AS leaked, {_case(lambda a: str(a.passed).lower())} AS passed FROM pages""",
    "nested_copies": " UNION ALL ".join(_copied_rows()),
    "nested_tree": " UNION ALL ".join(_tree_rows()),
    "office_odd_documents": f"""SELECT page_id AS file_id, 'docx' AS format, CASE page_id % 4 WHEN 3 THEN 'encrypted' END AS reason, CAST(CASE page_id % 4 WHEN 1 THEN {_TOLD + 1} ELSE {_TOLD} END AS BIGINT) AS found_before,
        page_id % 4 <> 3 AS has_copy, CASE WHEN page_id % 4 <> 3 THEN CAST(0 AS BIGINT) END AS remaining, CASE page_id % 4 WHEN 2 THEN CAST(2 AS BIGINT) WHEN 3 THEN NULL ELSE CAST(0 AS BIGINT) END AS leaked, page_id % 4 < 2 AS passed FROM pages""",
    "office_custom_xml": " UNION ALL ".join(f"SELECT page_id AS file_id, '{path}' AS path, sha256({copy}) AS sha256 FROM pages" for path, _, copy in CUSTOM if copy),
    "office_images": " UNION ALL ".join(f"SELECT page_id AS file_id, 'word/media/{name}' AS path, sha256(unhex({_photo_copy(DUCK)})) AS sha256 FROM pages WHERE page_id % 4 = 1" for name in ("image1.png", "image2.PNG")),
}
