"""Office packages, open documents and books: findings, cleaned copies and their verification, over the entries of their archives.

Each file's parts meet in one row (a file is bounded by its archive's limits); what they tell, and what a copy holds instead,
are column expressions. Rows of entries are those of sources.archives.entries, opened (operators.contents) so that images within
are scanned and cleaned by their own formats. A copy passes if it is read anew and nothing is found in it, none of the values
found before stands in any of its parts, its images pass, its dates tell nothing, and it has all parts that it must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.bytes import stripped, utf8
from metaveil.operators import contents
from metaveil.operators.binary import filled, found
from metaveil.operators.packages import limits, neutral, odf_kind, routed
from metaveil.operators.svg import FINDING
from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.tables import written

#: Elements of the property parts: name, label, category, severity.
CORE = (
    ("dc:creator", "Document author", "office-author", "high"), ("cp:lastModifiedBy", "Last modified by", "office-author", "high"), ("dc:title", "Document title", "office-custom", "medium"),
    ("dc:subject", "Document subject", "office-custom", "medium"), ("cp:keywords", "Keywords", "office-custom", "medium"), ("dc:description", "Description", "office-custom", "low"),
    ("cp:category", "Category", "office-custom", "low"), ("cp:revision", "Revision number", "office-dates", "low"), ("dcterms:created", "Creation date", "office-dates", "low"),
    ("dcterms:modified", "Modification date", "office-dates", "low"), ("cp:lastPrinted", "Last printed date", "office-dates", "low"),
)
APP = (
    ("Company", "Company", "office-app", "high"), ("Manager", "Manager", "office-app", "high"), ("Application", "Application", "office-app", "medium"),
    ("AppVersion", "Application version", "office-app", "low"), ("Template", "Template", "office-app", "medium"), ("TotalTime", "Total editing time (minutes)", "office-dates", "low"),
    ("Pages", "Pages", "office-custom", "low"), ("Words", "Words", "office-custom", "low"), ("Characters", "Characters", "office-custom", "low"),
    ("CharactersWithSpaces", "Characters (with spaces)", "office-custom", "low"), ("Lines", "Lines", "office-custom", "low"), ("Paragraphs", "Paragraphs", "office-custom", "low"),
    ("DocSecurity", "Document security setting", "office-custom", "low"), ("HyperlinksChanged", "Hyperlinks changed", "office-custom", "low"),
    ("SharedDoc", "Shared document", "office-custom", "low"), ("ScaleCrop", "Scale crop", "office-custom", "low"),
)
META = (
    ("dc:creator", "Document author", "author", "high"), ("meta:initial-creator", "Initial author", "author", "high"), ("meta:printed-by", "Printed by", "author", "high"),
    ("dc:title", "Document title", "other", "medium"), ("dc:subject", "Document subject", "other", "medium"), ("dc:description", "Description", "other", "low"),
    ("meta:keyword", "Keyword", "other", "medium"), ("meta:generator", "Generator application", "software", "medium"), ("meta:creation-date", "Creation date", "dates", "high"),
    ("dc:date", "Modification date", "dates", "high"), ("meta:print-date", "Last printed date", "dates", "medium"), ("meta:editing-cycles", "Editing cycles", "dates", "low"),
    ("meta:editing-duration", "Editing duration", "dates", "low"),
)
#: The name that copies carry in place of authors, parts that they lose, and attributes that their text parts lose.
ANONYMOUS, INITIALS = "Anonymous", "A"
PROPERTIES = ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml")
LOST = ("w:initials", "w:date", "w:dateUtc", "w:rsid", "w:rsidR", "w:rsidRPr", "w:rsidP", "w:rsidRDefault", "w:rsidTr", "w:rsidDel", "w:rsidSect")
TYPES, RELATIONS = "[Content_Types].xml", "_rels/.rels"
#: What a copy's parts lose, as patterns that take in the white space behind.
OVERRIDE, RELATION = r'(?i)<Override\s+PartName="/{}"[^>]*/>\s*', r'(?i)<Relationship\b[^>]*\bTarget="[^"]*{}"[^>]*/>\s*'
CUSTOM_OVERRIDE, CUSTOM_RELATION = r'(?i)<Override\b[^>]*\bPartName="/customXml/[^"]*"[^>]*/>\s*', r'(?i)<Relationship\b[^>]*\bTarget="[^"]*customXml/[^"]*"[^>]*/>\s*'
SESSIONS = (r"(?is)<w:rsids(\s[^>]*)?>.*?</w:rsids>", r"(?i)<w:rsids(\s[^>]*)?/>")
PREVIEW_ENTRY = r'(?i)<manifest:file-entry\b[^>]*manifest:full-path="Thumbnails/[^"]*"[^>]*/>\s*'
PRINTER = r'(?is)<config:config-item\b[^>]*config:name="Printer(?:Name|Setup)"[^>]*>.*?</config:config-item>\s*'
NOTE_AUTHOR, NOTE_DATE = r"(?is)(<dc:creator(?:\s[^>]*)?>).*?(</dc:creator>)", r"(?is)<dc:date(?:\s[^>]*)?>.*?</dc:date>\s*"
BOOK_MARKS = (
    r'(?i)\s*<meta\b[^>]*name="calibre:[^"]*"[^>]*/?>(?:</meta>)?', r'(?is)\s*<meta\b[^>]*property="dcterms:modified"[^>]*>.*?</meta>',
    r'(?is)\s*<dc:contributor\b[^>]*opf:role="bkp"[^>]*>.*?</dc:contributor>',
)
#: Folders of images, parts that a copy must have, and parts that are searched for values.
IMAGE_FOLDERS = {"office": "/media/", "odf": r"(?i)(^|/)(Pictures|media)/", "book": ""}
MAIN_PARTS = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
#: The category of images with traces, its field's prefix, and the category and field of dates.
IMAGE_TRACES = {"office": ("office-embedded-images", "office"), "odf": ("containers", "ODF"), "book": ("containers", "EPUB")}


def decoded(text: Column) -> Column:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def _element(xml: Column, name: str) -> Column:
    """What the first such element holds, under any prefix, as it stands there."""
    local = rf"(?:[A-Za-z_][\w.-]*:)?{name.rpartition(':')[2]}"
    return F.regexp_extract(xml, rf"(?is)<{local}\b[^>]*>(.*?)</{local}\s*>", 1)


def element(xml: Column, name: str) -> Column:
    """The text of the first such element; null if it is empty or not there."""
    return filled(decoded(stripped(_element(xml, name))))


def elements(xml: Column, name: str) -> Column:
    """The texts of all such elements, without markup and empty ones."""
    texts = F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), 1), lambda t: stripped(F.regexp_replace(t, "<[^>]+>", "")))
    return F.filter(texts, lambda t: t != "")


def attributes(xml: Column, name: str) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(rf'(?i)\b{name}="([^"]*)"'), 1), decoded)


def _people(names: Column) -> Column:
    return F.filter(F.array_distinct(names), lambda n: (n != ANONYMOUS) & (n != ""))


def _listed(condition: Column, finding: Column) -> Column:
    return F.when(condition, F.array(finding)).otherwise(F.array().cast(f"array<{FINDING}>"))


def _named(xml: Column, table: tuple, prefix: str) -> Column:
    texts = F.array(*[_element(xml, name) for name, *_ in table])
    rows = ", ".join(f"named_struct('category', '{category}', 'field', '{prefix}:{name}', 'label', '{label}', 'severity', '{severity}')" for name, label, category, severity in table)
    told = F.zip_with(texts, F.expr(f"array({rows})"), lambda text, info: found(info["category"], info["field"], info["label"], filled(decoded(stripped(text))), info["severity"]))
    return F.coalesce(F.filter(told, lambda f: f["value"].isNotNull()), F.array().cast(f"array<{FINDING}>"))


def _traces(rows: DataFrame) -> list[Column]:
    """Of a file's images: how many there are, how many have traces, and the values of these; and whether dates tell something."""
    times = F.bool_or(~neutral(F.col("at"))).alias("times")
    if "format" not in rows.columns:  # not opened
        return [F.lit(0).alias("images"), F.lit(0).alias("traced"), F.lit(None).cast("array<string>").alias("image_values"), times]
    image = F.col("format").isNotNull()
    return [F.count_if(image).alias("images"), F.count_if(image & (F.col("found") > 0)).alias("traced"), F.flatten(F.collect_list(F.when(image, F.col("raw")))).alias("image_values"), times]


def _image_finding(kind: str) -> Column:
    category, prefix = IMAGE_TRACES[kind]
    return _listed(F.col("traced") > 0, found(category, f"{prefix}:embeddedImages", "Embedded images with metadata", F.format_string("%d of %d", "traced", "images"), "medium"))


def _time_finding(kind: str) -> Column:
    category = "office-container" if kind == "office" else "containers"
    return _listed(F.coalesce("times", F.lit(False)), found(category, f"{IMAGE_TRACES[kind][1]}:zipTimestamps", "ZIP container timestamps", "Present", "low"))


def _values(*arrays: Column) -> Column:
    """All values that must not stand in a copy."""
    none = F.array().cast("array<string>")
    all_ = F.concat(*[F.coalesce(a, none) for a in (*arrays, F.col("image_values"))])
    return F.filter(F.array_distinct(all_), lambda v: F.length(stripped(v)) >= 3)


def _found_values(findings: Column) -> Column:
    return F.transform(findings, lambda f: f["value"])


def _part(path: Column | str) -> Column:
    condition = F.col("path") == path if isinstance(path, str) else path
    return F.max(F.when(condition, utf8(F.col("content"))))


def _parts(pattern: str, but: str = "") -> Column:
    """The texts of all parts of that pattern, in their order."""
    rows = F.collect_list(F.when(F.col("path").rlike(pattern) & (F.col("path") != but), F.struct("entry_pos", utf8(F.col("content")).alias("text"))))
    return F.transform(F.array_sort(rows), lambda r: r["text"])


def office_findings(entries: DataFrame) -> DataFrame:
    """file_id, findings, raw (values that a copy must not hold) of office packages: properties first, then comments, revisions and images."""
    rows = entries.where("NOT is_folder").groupBy("file_id").agg(
        _part(PROPERTIES[0]).alias("core"), _part(PROPERTIES[1]).alias("app"), _part(PROPERTIES[2]).alias("custom"), _part("word/comments.xml").alias("comments"),
        _parts(r"(?i)^word/.*\.xml$", "word/comments.xml").alias("words"), _parts(r"(?i)^xl/comments\d*\.xml$").alias("sheets"), _part("ppt/commentAuthors.xml").alias("slides"), _parts("^ppt/comments/").alias("notes"),
        *_traces(entries),
    )
    own = F.regexp_extract_all("custom", F.lit(r'(?is)<property\b[^>]*\bname="([^"]*)"[^>]*>(.*?)</property>'), 0)

    def custom(entry: Column) -> Column:
        name, inner = F.regexp_extract(entry, r'(?is)\bname="([^"]*)"', 1), F.regexp_extract(entry, r"(?is)^<property\b[^>]*>(.*)</property>$", 1)
        value = F.coalesce(element(inner, "vt:lpwstr"), filled(stripped(F.regexp_replace(inner, "<[^>]+>", ""))))
        return found("office-custom", F.concat(F.lit("custom:"), name), F.format_string('Property "%s"', name), value, "medium")

    none = F.array().cast(f"array<{FINDING}>")
    properties = F.when(F.size(own) > 0, F.transform(own, custom)).when(F.col("custom").isNotNull(), F.array(found("office-custom", "custom:present", "Custom properties", "Present", "medium")))
    commented = _people(attributes(F.coalesce("comments", F.lit("")), "w:author"))
    revised = _people(F.flatten(F.transform("words", lambda x: attributes(x, "w:author"))))
    sessions = F.aggregate(F.transform("words", lambda x: F.regexp_count(x, F.lit(r'(?i)\bw:rsid\w*="[^"]*"')) + F.regexp_count(x, F.lit("(?i)<w:rsids>"))), F.lit(0), lambda a, b: a + b)
    authors = F.flatten(F.transform("sheets", lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, "(?is)<authors>(.*?)</authors>", 1), F.lit("(?is)<author>(.*?)</author>"), 1), lambda t: decoded(stripped(t)))))
    cells, slides = _people(authors), _people(attributes(F.coalesce("slides", F.lit("")), "name"))

    def people(names: Column, field: str, label: str, category: str = "office-comment-authors") -> Column:
        return _listed(F.size(names) > 0, found(category, field, label, F.array_join(names, ", "), "high"))

    core, app = _named(F.col("core"), CORE, "core"), _named(F.col("app"), APP, "app")
    names = F.transform(own, lambda entry: F.regexp_extract(entry, r'(?is)\bname="([^"]*)"', 1))
    each = lambda parts, name: F.flatten(F.transform(F.coalesce(parts, none_text), lambda x: attributes(x, name)))
    none_text = F.array().cast("array<string>")
    comment_parts = F.array(F.coalesce("comments", F.lit("")))
    raw = _values(
        _found_values(core), _found_values(app), _found_values(F.coalesce(properties, none)), names, commented, revised, cells, slides, each(comment_parts, "w:initials"),
        each(comment_parts, "w:date"), each(F.col("words"), "w:date"), each(F.array(F.coalesce("slides", F.lit(""))), "initials"), each(F.col("notes"), "dt"),
    )
    told = F.concat(
        core, app, F.coalesce(properties, none), people(commented, "docx:commentAuthor", "Comment author"),
        people(revised, "docx:revisionAuthor", "Revision author (tracked changes)", "office-revisions"), _listed(sessions > 0, found("office-revisions", "docx:rsid", "Edit session IDs (rsid)", sessions, "medium")),
        people(cells, "xlsx:commentAuthor", "Comment authors"), people(slides, "pptx:commentAuthor", "Comment authors"),
        _image_finding("office"), _time_finding("office"),
    )
    return rows.select("file_id", told.alias("findings"), raw.alias("raw"))


def office_copies(entries: DataFrame, remove_custom_xml: bool = False) -> DataFrame:
    """file_id, content: packages without properties, with one name for all authors, and without marks of revisions."""
    path, text = F.col("path"), utf8(F.col("content"))
    drop = path.isin(*PROPERTIES) | path.rlike(r"(?i)^docProps/thumbnail\.")
    types, relations, others = text, text, text
    for part in PROPERTIES:
        types = F.regexp_replace(types, OVERRIDE.format(part.replace(".", "[.]")), "")
    for target in (*PROPERTIES, "docProps/thumbnail"):
        relations = F.regexp_replace(relations, RELATION.format(target.replace(".", "[.]")), "")
    if remove_custom_xml:
        drop = drop | F.startswith(path, F.lit("customXml/"))
        types = F.regexp_replace(types, CUSTOM_OVERRIDE, "")
        relations, others = F.regexp_replace(relations, CUSTOM_RELATION, ""), F.regexp_replace(others, CUSTOM_RELATION, "")
    words = F.regexp_replace(text, r'(?i)(\bw:author=")[^"]*(")', f"$1{ANONYMOUS}$2")
    for name in LOST:
        words = F.regexp_replace(words, rf'(?i)\s+{name}="[^"]*"', "")
    for pattern in SESSIONS:
        words = F.regexp_replace(words, pattern, "")
    sheets = F.regexp_replace(text, "(?is)<authors>.*?</authors>", f"<authors><author>{ANONYMOUS}</author></authors>")
    sheets = F.regexp_replace(sheets, r'(?i)\bauthorId="[^"]*"', 'authorId="0"')
    slides = F.regexp_replace(F.regexp_replace(text, r'(?i)(\bname=")[^"]*(")', f"$1{ANONYMOUS}$2"), r'(?i)(\binitials=")[^"]*(")', f"$1{INITIALS}$2")
    new = (
        F.when(path == TYPES, types).when(path == RELATIONS, relations).when(path.rlike(r"(?i)^word/.*\.xml$"), words).when(path.rlike(r"(?i)^xl/comments\d*\.xml$"), sheets)
        .when(path == "ppt/commentAuthors.xml", slides).when(path.rlike("^ppt/comments/"), F.regexp_replace(text, r'(?i)\s+dt="[^"]*"', ""))
    )
    new = new.when(path.rlike(r"(?i)\.rels$"), others) if remove_custom_xml else new
    return _copied(entries, F.when(new != text, new), drop)


def odf_findings(entries: DataFrame) -> DataFrame:
    """file_id, format, findings, raw of open documents."""
    rows = entries.where("NOT is_folder").groupBy("file_id").agg(
        _part("mimetype").alias("mimetype"), _part("meta.xml").alias("meta"), _part("settings.xml").alias("settings"), _part("content.xml").alias("content"),
        F.bool_or(F.col("path").rlike("(?i)^Thumbnails/")).alias("preview"), *_traces(entries),
    )
    rows = rows.na.fill("", ["meta", "settings", "content", "mimetype"])
    named = [F.transform(elements(F.col("meta"), name), _said(name, label, category, severity)) for name, label, category, severity in META]
    own = F.regexp_extract_all("meta", F.lit(r'(?is)<meta:user-defined\b[^>]*meta:name="[^"]*"[^>]*>.*?</meta:user-defined>'), 0)

    def custom(entry: Column) -> Column:
        name, value = F.regexp_extract(entry, 'meta:name="([^"]*)"', 1), filled(stripped(F.regexp_extract(entry, '(?s)meta:name="[^"]*"[^>]*>(.*?)<', 1)))
        return found("other", F.concat(F.lit("ODF:user:"), name), F.format_string('Property "%s"', name), value, "medium")

    printer = filled(stripped(F.regexp_extract("settings", '(?is)config:name="PrinterName"[^>]*>(.*?)<', 1)))
    notes = _people(elements(F.col("content"), "dc:creator"))
    told = F.concat(
        F.flatten(F.array(*named)), F.transform(own, custom), _listed(F.col("meta").rlike(r"(?i)<meta:document-statistic\b"), found("other", "ODF:statistics", "Document statistics", "Present", "low")),
        _listed(F.col("preview"), found("thumbnails", "ODF:thumbnail", "Document preview thumbnail", "Present", "medium")),
        _listed(printer.isNotNull(), found("device", "ODF:printer", "Printer name", printer, "high")),
        _listed(F.col("settings").rlike('(?i)config:name="PrinterSetup"'), found("device", "ODF:printerSetup", "Printer configuration data", "Present", "medium")),
        _listed(F.size(notes) > 0, found("author", "ODF:annotationAuthor", "Annotation author", F.array_join(notes, ", "), "high")),
        _image_finding("odf"), _time_finding("odf"),
    )
    users = F.transform(own, lambda entry: F.regexp_extract(entry, 'meta:name="([^"]*)"', 1))
    raw = _values(_found_values(F.flatten(F.array(*named))), users, _found_values(F.transform(own, custom)), F.array(printer), notes)
    return rows.select("file_id", odf_kind(F.col("mimetype")).alias("format"), told.alias("findings"), raw.alias("raw"))


def _said(name: str, label: str, category: str, severity: str):
    return lambda value: found(category, f"ODF:{name}", label, value, severity)


def book_findings(entries: DataFrame) -> DataFrame:
    """file_id, findings, raw of books: marks of libraries and tools in the package document."""
    containers = entries.where("path = 'META-INF/container.xml'").select("file_id", filled(F.regexp_extract(utf8(F.col("content")), r'(?i)full-path="([^"]+\.opf)"', 1)).alias("opf"))
    parts = entries.join(containers, "file_id", "left").groupBy("file_id").agg(_part(F.col("path") == F.col("opf")).alias("opf"), *_traces(entries)).na.fill("", ["opf"])

    def library(entry: Column) -> Column:
        name = F.regexp_extract(entry, '(?i)name="calibre:([^"]*)"', 1)
        value = F.when(entry.rlike('(?i)content="'), F.regexp_extract(entry, '(?i)content="([^"]*)"', 1))
        return found("software", F.concat(F.lit("EPUB:calibre:"), name), F.format_string("Calibre field (%s)", name), value, "medium")

    changed = r'(?is)<meta\b[^>]*property="dcterms:modified"[^>]*>(.*?)</meta>'
    tools = F.regexp_extract_all("opf", F.lit(r'(?is)<dc:contributor\b[^>]*opf:role="bkp"[^>]*>.*?</dc:contributor>'), 0)
    told = F.concat(
        F.transform(F.regexp_extract_all("opf", F.lit(r'(?i)<meta\b[^>]*name="calibre:[^"]*"[^>]*/?>'), 0), library),
        _listed(F.col("opf").rlike(changed), found("dates", "EPUB:modified", "Last modified date", filled(stripped(F.regexp_extract("opf", changed, 1))), "medium")),
        F.transform(tools, lambda t: found("software", "EPUB:producer", "Producing tool", filled(stripped(F.regexp_replace(t, "<[^>]+>", ""))), "medium")),
        _image_finding("book"), _time_finding("book"),
    )
    marks = F.filter(told, lambda f: ~f["field"].isin("EPUB:embeddedImages", "EPUB:zipTimestamps"))
    return parts.select("file_id", told.alias("findings"), _values(_found_values(marks)).alias("raw"))


#: What stands in place of an open document's description.
EMPTY_META = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<office:document-meta xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" office:version="1.2"><office:meta/></office:document-meta>'
)


def _copied(entries: DataFrame, new: Column, drop: Column | None = None) -> DataFrame:
    """file_id, content: archives with the new texts where there are any, else the copies of images, without the entries to drop.

    With the column before (values), copies carry it. A file with an entry that can't be read has no copy (content null).
    """
    drop = F.lit(False) if drop is None else drop
    images = "clean" if "clean" in entries.columns else "content"
    kept = entries.withColumn("dropped", F.coalesce(drop, F.lit(False))).withColumn("content", F.coalesce(new.cast("binary"), F.col(images), "content"))
    return rebuilt(kept.withColumn("stored", F.col("path") == "mimetype"), ("before",) if "before" in entries.columns else ())


def odf_copies(entries: DataFrame) -> DataFrame:
    """file_id, content: open documents without description, preview and printer, with one name for all who annotated."""
    path, text = F.col("path"), utf8(F.col("content"))
    manifest, settings = F.regexp_replace(text, PREVIEW_ENTRY, ""), F.regexp_replace(text, PRINTER, "")
    content = F.regexp_replace(F.regexp_replace(text, NOTE_AUTHOR, f"$1{ANONYMOUS}$2"), NOTE_DATE, "")
    new = F.when(path == "META-INF/manifest.xml", manifest).when(path == "meta.xml", EMPTY_META).when(path == "settings.xml", settings).when(path == "content.xml", content)
    return _copied(entries, new, path.rlike("(?i)^Thumbnails/"))


def book_copies(entries: DataFrame) -> DataFrame:
    """file_id, content: books without marks of libraries and tools."""
    containers = entries.where("path = 'META-INF/container.xml'").select("file_id", filled(F.regexp_extract(utf8(F.col("content")), r'(?i)full-path="([^"]+\.opf)"', 1)).alias("opf"))
    text = utf8(F.col("content"))
    for pattern in BOOK_MARKS:
        text = F.regexp_replace(text, pattern, "")
    return _copied(entries.join(containers, "file_id", "left"), F.when(F.col("path") == F.col("opf"), text))


FINDINGS = {"office": office_findings, "odf": lambda rows: odf_findings(rows).drop("format"), "book": book_findings}
COPIES = {"office": office_copies, "odf": odf_copies, "book": book_copies}


def parts(files: DataFrame, kind: str, searched: bool = False) -> DataFrame:
    """A written table of the entries of files (file_id, content and others), with the formats of their images; searched: see contents.told."""
    return contents.told(files, contents.image_format(F.col("path"), F.col("content"), IMAGE_FOLDERS[kind]), searched=searched)


def _main() -> Column:
    """The format that a package's main part tells, of its parts an aggregate."""
    return F.max(F.coalesce(*[F.when(F.col("path") == part, F.lit(f)) for f, part in MAIN_PARTS.items()]))


def _sound(kind: str) -> Column:
    """What else must hold of a copy's parts, of which this is an aggregate."""
    path, text = F.col("path"), utf8(F.col("content"))
    has = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    first = F.min_by("path", "entry_pos") == "mimetype"
    if kind == "book":
        return first & has((path == "META-INF/container.xml") & text.rlike(r'(?i)full-path="[^"]+\.opf"'))
    if kind == "odf":
        odf = has((path == "mimetype") & odf_kind(text).isNotNull())
        return first & odf & has(path == "content.xml")
    named = F.lit(False)
    for part in PROPERTIES:
        named = named | (path == part) | (path == TYPES) & F.contains(text, F.lit("/" + part)) | (path == RELATIONS) & F.contains(text, F.lit(part))
    dated = path.rlike(r"(?i)^word/.*\.xml$") & text.rlike(r'(?i)\bw:date="')
    return ~has(named) & ~has(dated)


def verified(before: DataFrame, after: DataFrame, entries_after: DataFrame, kind: str) -> DataFrame:
    """file_id, found_before, remaining, leaked, passed of copies.

    before, after: file_id, findings of originals (with format) and copies. entries_after: what the copies hold, with passed of
    their images and leaks (values of the original in a part); they are told before anything is joined, so no content is shuffled.
    """
    told = before.select("file_id", "format", F.size("findings").cast("bigint").alias("found_before"))
    rest = after.select("file_id", F.size("findings").cast("bigint").alias("remaining"))
    whole = F.bool_and((F.col("status") == "ok") & F.coalesce(neutral(F.col("at")), F.lit(False)) & F.coalesce("passed", F.lit(False)))
    leaked = F.size(F.array_distinct(F.flatten(F.collect_list("leaks")))).cast("bigint")
    checks = entries_after.groupBy("file_id").agg((whole & _sound(kind)).alias("sound"), _main().alias("main"), leaked.alias("leaked"))
    main = F.col("main") == F.col("format") if kind == "office" else F.lit(True)
    passed = F.coalesce((F.col("remaining") == 0) & (F.col("leaked") == 0) & F.col("sound") & main, F.lit(False))
    return told.join(rest, "file_id", "left").join(checks, "file_id", "left").select("file_id", "found_before", "remaining", "leaked", passed.alias("passed"))


def clean_and_verify(files: DataFrame, kind: str, remove_custom_xml: bool = False) -> DataFrame:
    """file_id, format, reason, content (the copy, or null), found_before, raw, remaining, leaked, passed of files (file_id, content) of a kind.

    Files that are refused (reason) have no copy. What is read of originals and copies is written once each, of copies with the
    values that still stand there. Parts of one's own XML in office packages stay, or go with remove_custom_xml.
    """
    held = parts(files.select("file_id", "content"), kind)
    before = contents.opened(held)
    gate = limits(held).withColumnRenamed("reason", "gate")
    route = routed(held, custom_xml=True).join(gate, "file_id", "left").select("file_id", "format", F.coalesce("reason", "gate").alias("reason"))
    told = written(FINDINGS[kind](before).join(route, "file_id"), "told")
    allowed = told.where("reason IS NULL").select("file_id", F.col("raw").alias("before"))
    options = {"remove_custom_xml": True} if remove_custom_xml and kind == "office" else {}
    copies = written(COPIES[kind](before.join(allowed, "file_id"), **options), "copies")
    after = contents.opened(parts(copies.where("content IS NOT NULL").select("file_id", "content", F.col("before").alias("raw")), kind, searched=True))
    checked = verified(told, FINDINGS[kind](after), after, kind)
    return told.select("file_id", "format", "reason", "raw").join(checked, "file_id").join(copies.select("file_id", "content"), "file_id", "left")
