"""What an archive is, whether it may be changed, what its container tells, and its cleaned copy: joins and aggregations over entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.functions.bytes import cp1252, stripped, utf8
from metaveil.operators import archive
from metaveil.operators.binary import filled, found
from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.tables import written

#: Parts that tell an office format, then folders that do; types of open documents.
OFFICE_PARTS = (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml"))
OFFICE_FOLDERS = (("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/"))
ODF_TYPES = {"odt": "text", "ods": "spreadsheet", "odp": "presentation", "odg": "graphics"}
ODF = "application/vnd.oasis.opendocument."
#: What blocks a package of an office format, in this order, as patterns of paths.
BLOCKED = (
    ("macro", r"(?i)(^|/)vbaProject\.bin$|vbaData\.xml$"),
    ("signed", "^_xmlsignatures/|^_signatures/"),
    ("embedded-object", r"(?i)/embeddings/|oleObject\d*\.bin$|/activeX/|\.(ole|emf\.bin)$"),
    ("custom-xml", "^customXml/"),
    ("threaded-comments", r"^word/(commentsExtended|people|commentsIds)\.xml$|^xl/(threadedComments|persons)/"),
    ("unsupported-media", r"/media/(.*\.)?(?i:heic|heif|jp2|j2k)$"),
)
#: Names in the directory of compound files.
CFB = (("encrypted", ("EncryptionInfo", "EncryptedPackage")), ("legacy-office", ("WordDocument", "Workbook", "Book", "PowerPoint Document")))
#: What blocks a PDF, in this order.
PDF = (
    ("encrypted", r"/Encrypt\b"),
    ("signed", r"/ByteRange\s*\[|/SubFilter\s*/(adbe\.pkcs7|ETSI\.CAdES)|/SigFlags\s+[123]|/Type\s*/Sig\b"),
    ("xfa", r"/XFA\b"),
    ("portfolio", r"/Collection\b"),
    ("attachments", r"/EmbeddedFiles\b|/Type\s*/EmbeddedFile\b"),
)
NEUTRAL = "1980-01-01 00:00:00"


def pdf_blocked(content: Column) -> Column:
    text = F.decode(content, "ISO-8859-1")
    return formats.first_match({reason: text.rlike(pattern) for reason, pattern in PDF})


def compound_kind(content: Column) -> Column:
    """encrypted, legacy-office or unknown, by the names of streams in UTF-16."""
    kinds = {}
    for kind, names in CFB:
        held = F.lit(False)
        for name in names:
            held = held | F.contains(content, F.unhex(F.lit(name.encode("utf-16-le").hex())))
        kinds[kind] = held
    return F.coalesce(formats.first_match(kinds), F.lit("unknown"))


def neutral(at: Column) -> Column:
    """Whether a time of day tells nothing: within 2.5 seconds of the date that copies have."""
    return F.abs(F.unix_millis(F.to_timestamp(at)) - F.unix_millis(F.to_timestamp(F.lit(NEUTRAL)))) < 2500


def odf_kind(mimetype: Column) -> Column:
    trimmed = stripped(mimetype)
    return formats.first_match({k: trimmed.isin(ODF + name, f"{ODF}{name}-template") for k, name in ODF_TYPES.items()})


def routed(rows: DataFrame, custom_xml: bool = False) -> DataFrame:
    """file_id, format, reason of archives given by their entries: what each is by its content, and what refuses it (null: nothing).

    An entry that can't be read refuses an archive of any kind, and so does a file_id that several archives have. custom_xml:
    parts of one's own XML don't refuse a package.
    """
    path = F.col("path")
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    mimetype = F.max(F.when(path == "mimetype", utf8(F.col("content"))))
    manifest = F.max(F.when(path == "META-INF/manifest.xml", utf8(F.col("content"))))
    files_only = F.when(~F.col("is_folder"), path)
    told = rows.groupBy("file_id").agg(
        *[has(files_only == part).alias(f"part_{k}") for k, part in OFFICE_PARTS],
        *[has(F.startswith(files_only, F.lit(folder))).alias(f"in_{k}") for k, folder in OFFICE_FOLDERS],
        *[has(files_only.rlike(pattern)).alias(f"has_{reason}") for reason, pattern in BLOCKED],
        mimetype.alias("mimetype"), manifest.alias("manifest"),
        has(files_only.rlike("(?i)^(Basic|Scripts)/")).alias("scripts"), has(files_only == "META-INF/encryption.xml").alias("locked"),
        has(F.col("status") == "malformed").alias("malformed"), has(F.col("status") == "encrypted").alias("unreadable"),
        (F.count("entry_pos") > F.count_distinct("entry_pos")).alias("several"),
    )
    office = formats.first_match({k: F.col(f"part_{k}") for k, _ in OFFICE_PARTS})
    office = F.coalesce(office, formats.first_match({k: F.col(f"in_{k}") for k, _ in OFFICE_FOLDERS}))
    open_document = F.when(F.startswith(stripped(F.col("mimetype")), F.lit(ODF.rstrip("."))), F.coalesce(odf_kind(F.col("mimetype")), F.lit("odf")))
    book = F.when(stripped(F.col("mimetype")) == "application/epub+zip", "epub")
    kind = F.when(F.col("malformed"), "zip").otherwise(F.coalesce(office, open_document, book, F.lit("zip")))
    by_office = formats.first_match({reason: F.col(f"has_{reason}") for reason, _ in BLOCKED if reason != "custom-xml" or not custom_xml})
    by_document = formats.first_match(
        {"unsupported-package": F.col("format") == "odf", "encrypted": F.coalesce(F.col("manifest").rlike("(?i)manifest:encryption-data"), F.lit(False)), "macro": F.col("scripts")}
    )
    reason = (
        F.when(F.col("malformed"), "malformed")
        .when(F.col("several"), "repeated-id")
        .when(F.col("unreadable"), "encrypted")
        .when(F.col("format").isin("docx", "xlsx", "pptx"), by_office)
        .when(F.col("format").isin("odt", "ods", "odp", "odg", "odf"), by_document)
        .when(F.col("format") == "epub", F.when(F.col("locked"), "encrypted"))
    )
    return told.withColumn("format", kind).select("file_id", "format", reason.alias("reason"))


def limits(rows: DataFrame) -> DataFrame:
    """file_id, reason: packages of too many or too large parts; their paths don't matter."""
    total = rows.where("NOT is_folder").groupBy("file_id").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("file_length").alias("length"))
    return total.select("file_id", archive.over_limits(F.col("n"), F.col("size"), F.col("length")).alias("reason"))


def container(rows: DataFrame) -> DataFrame:
    """file_id, entries, folders, timestamps, extra_fields, attributes, has_comment, size, packed: what each archive's container tells."""
    return rows.where("status <> 'malformed'").groupBy("file_id").agg(
        F.count("*").alias("entries"), F.count_if(F.col("is_folder")).alias("folders"), F.count_if(~neutral(F.col("at"))).alias("timestamps"),
        F.sum("extra_fields").alias("extra_fields"), F.count_if(F.col("attributes")).alias("attributes"), F.bool_or(F.col("comment") != "").alias("has_comment"),
        F.sum("size").alias("size"), F.sum("packed").alias("packed"),
    )


def xml_text(content: Column, tag: str) -> Column:
    """The text of the first element of that name, whatever its prefix; entities decoded, null if empty."""
    text = F.regexp_extract(utf8(content), rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1)
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return filled(stripped(text))


def authors(rows: DataFrame) -> DataFrame:
    """file_id, authors: who commented or revised a text document, in order, without the placeholder; null if nobody."""
    parts = rows.where(F.col("path").rlike(r"^word/.*\.xml$")).withColumn("name", F.explode(F.regexp_extract_all(utf8(F.col("content")), F.lit(r'w:author="([^"]*)"'), 1)))
    named = parts.where("name <> '' AND name <> 'Anonymous'").groupBy("file_id", "name").agg(F.min("entry_pos").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "name")))
    return named.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ", ").alias("authors"))


def cleaned(rows: DataFrame, drop: DataFrame, replace: DataFrame) -> DataFrame:
    """file_id, content: archives without the entries of drop (file_id, path), with the contents of replace (file_id, path, new)."""
    kept = rows.where("status = 'ok'").join(drop, ["file_id", "path"], "left_anti").join(replace, ["file_id", "path"], "left")
    return rebuilt(kept.withColumn("content", F.coalesce("new", "content")).withColumn("stored", F.col("path") == "mimetype"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, same, changed, lost, added, names_in_order, timestamps_neutral: the entries of archives and of their copies."""
    a = before.where("NOT is_folder").select("file_id", "path", F.sha2("content", 256).alias("old"), F.col("entry_pos").alias("old_pos"))
    b = after.where("NOT is_folder").select("file_id", "path", F.sha2("content", 256).alias("copy"), F.col("entry_pos").alias("new_pos"), neutral(F.col("at")).alias("neutral"))
    joined = a.join(b, ["file_id", "path"], "full")
    names = lambda place: F.transform(F.array_sort(F.collect_list(F.when(F.col(place).isNotNull(), F.struct(place, "path")))), lambda x: x["path"])
    return joined.groupBy("file_id").agg(
        F.count_if(F.col("old") == F.col("copy")).alias("same"), F.count_if(F.col("old") != F.col("copy")).alias("changed"), F.count_if(F.col("copy").isNull()).alias("lost"),
        F.count_if(F.col("old").isNull()).alias("added"), (names("old_pos") == names("new_pos")).alias("names_in_order"),
        F.bool_and(F.coalesce("neutral", F.lit(True))).alias("timestamps_neutral"),
    )


def gated(files: DataFrame) -> DataFrame:
    """file_id, reason: multi-volume archives first, then those that can't be read, then the gates over entries.

    What is told of entries is written, so that archives are unpacked once; their contents aren't.
    """
    rows = written(entries(files).drop("content"), "gated")
    split_ = files.select(F.col("file_id").cast("bigint").alias("file_id"), formats.starts(F.col("content"), "504B0708").alias("split"))
    refused = archive.gates(rows.where("status <> 'malformed'")).withColumnRenamed("reason", "gate")
    bad = rows.where("status = 'malformed'").select("file_id", F.lit("malformed").alias("bad"))
    joined = split_.join(bad, "file_id", "left").join(refused, "file_id", "left")
    return joined.select("file_id", F.coalesce(F.when(F.col("split"), "multi-volume"), "bad", "gate").alias("reason"))


def nested_formats(rows: DataFrame) -> DataFrame:
    """file_id, path, format: what each entry is by its content; photographs of the HEIF family are not looked into."""
    kind = formats.detect(F.col("content"))
    return rows.where("NOT is_folder AND status = 'ok'").select("file_id", "path", F.when(kind != "heic", kind).alias("format"))


def container_findings(rows: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """file_id, category, field, label, value, severity of archives; traces (file_id, traces): what was found in their entries."""
    told = container(rows)
    told = told.join(traces, "file_id", "left") if traces is not None else told.withColumn("traces", F.lit(0))
    rules = [
        (F.col("timestamps") > 0, found("zip-container", "zip:timestamps", "ZIP entry timestamps", F.col("timestamps"), "low")),
        (F.col("has_comment"), found("zip-container", "zip:comment", "ZIP comment", "Present", "medium")),
        (F.col("attributes") > 0, found("zip-container", "zip:externalAttributes", "ZIP external attributes", F.col("attributes"), "low")),
        (F.col("extra_fields") > 0, found("zip-container", "zip:extraFields", "ZIP extra fields", F.col("extra_fields"), "medium")),
        (F.col("traces") > 0, found("zip-container", "zip:nestedFindings", "Metadata traces in archived files", F.col("traces"), "medium")),
    ]
    one = F.explode(F.filter(F.array(*[F.when(c, f) for c, f in rules]), lambda f: f.isNotNull())).alias("f")
    return told.select("file_id", one).select("file_id", "f.*")


def latin_corpus(rows: DataFrame) -> DataFrame:
    """file_id, clean: all that an archive's entries hold, as one text, for the search for leaks."""
    parts = rows.where("NOT is_folder").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("entry_pos", cp1252(F.col("content")).alias("text")))).alias("parts"))
    return parts.select("file_id", F.array_join(F.col("parts.text"), "\n").alias("clean"))
