"""Portable documents: findings, copies and verification by joins over their objects.

Of each object the last definition counts, and of the trailers, key by key, the last that has it. References are edges of a
graph: pages are found from the catalog downwards, and a copy has the objects that can be reached from it once descriptions,
private data and the names of who annotated are cut off. Both go in rounds, one join for each step of depth. The offsets of the
copy's cross-reference table are running sums over its objects.

Files are refused (reason) if they are locked, signed or hold forms or files of others (packages.pdf_blocked), if their objects
can't be told apart, if they have too many pages, and if annotations stand within a page's own dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.bytes import stripped, utf8
from metaveil.operators import leaks, packages
from metaveil.operators.binary import filled, found, listed
from metaveil.operators.relations import joined_bytes, offsets, same_geometry
from metaveil.operators.svg import FINDING
from metaveil.sources.pdf import objects
from metaveil.sources.tables import written

MOST_PAGES = 500
#: Keys of the description, with label, category and severity; a key that tells nothing personal.
INFO = {
    "Title": ("Document title", "pdf-title", "medium"), "Author": ("Document author", "pdf-author", "high"), "Subject": ("Document subject", "pdf-title", "medium"),
    "Keywords": ("Keywords", "pdf-title", "medium"), "Creator": ("Creator application", "pdf-software", "medium"), "Producer": ("PDF producer", "pdf-software", "low"),
    "CreationDate": ("Creation date", "pdf-dates", "low"), "ModDate": ("Modification date", "pdf-dates", "low"),
}
TRAPPED = "Trapped"
#: Fields of XMP: field, label, severity, and the patterns of which the first that matches counts.
XMP = (
    ("dc:creator", "XMP author (Dublin Core)", "high", (r"(?is)<dc:creator>.*?<rdf:li[^>]*>(.*?)</rdf:li>", r"(?is)<dc:creator>(.*?)</dc:creator>")),
    ("dc:title", "XMP title", "medium", (r"(?is)<dc:title>.*?<rdf:li[^>]*>(.*?)</rdf:li>", r"(?is)<dc:title>(.*?)</dc:title>")),
    ("dc:description", "XMP description", "medium", (r"(?is)<dc:description>.*?<rdf:li[^>]*>(.*?)</rdf:li>", r"(?is)<dc:description>(.*?)</dc:description>")),
    ("dc:rights", "XMP rights (copyright)", "medium", (r"(?is)<dc:rights>.*?<rdf:li[^>]*>(.*?)</rdf:li>", r"(?is)<dc:rights>(.*?)</dc:rights>")),
    ("xmp:CreatorTool", "XMP creator tool", "medium", (r"(?is)<xmp:CreatorTool>(.*?)</xmp:CreatorTool>", r'(?i)xmp:CreatorTool="([^"]*)"')),
    ("pdf:Producer", "XMP PDF producer", "low", (r"(?is)<pdf:Producer>(.*?)</pdf:Producer>", r'(?i)pdf:Producer="([^"]*)"')),
    ("xmp:CreateDate", "XMP create date", "low", (r"(?is)<xmp:CreateDate>(.*?)</xmp:CreateDate>",)),
    ("xmp:ModifyDate", "XMP modify date", "low", (r"(?is)<xmp:ModifyDate>(.*?)</xmp:ModifyDate>",)),
    ("xmp:MetadataDate", "XMP metadata date", "low", (r"(?is)<xmp:MetadataDate>(.*?)</xmp:MetadataDate>",)),
    ("Company", "XMP company", "high", (r"(?is)<\w+:Company>(.*?)</\w+:Company>",)),
    ("xmpMM:DocumentID", "XMP document ID", "low", (r"(?is)<xmpMM:DocumentID>(.*?)</xmpMM:DocumentID>",)),
)
NAMESPACES = ("dc", "xmp", "pdf", "xmpMM", "rdf", "x", "xml", "xmpTPg", "stEvt", "stRef", "photoshop")
#: Keys that a copy's dictionaries lose, and those that its annotations lose too.
LOST, OF_ANNOTATIONS = ("Metadata", "PieceInfo"), ("T", "M", "NM")
REFERENCE = r"(\d+)\s+\d+\s+R"
RESIDUE = r"(?i)<\?xpacket|<x:xmpmeta|rdf:RDF"


def _value(key: str, field: str = "value", entries: str = "entries") -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))[field]


def _reference(value: Column) -> Column:
    """The number that a single reference names, or null."""
    return F.regexp_extract(value, rf"^{REFERENCE}$", 1).try_cast("bigint")


def _references(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(REFERENCE), 1), lambda n: n.try_cast("bigint"))


def current(rows: DataFrame) -> DataFrame:
    """The last definition of each object: file_id, number, generation, entries, body, stream."""
    last = F.max_by(F.struct("generation", "entries", "body", "stream"), F.struct("generation", "pos"))
    return rows.where("kind = 'object'").groupBy("file_id", "number").agg(last.alias("o")).select("file_id", "number", "o.*")


def trailers(rows: DataFrame) -> DataFrame:
    """file_id, root, info (numbers of objects), has_id: of each key the last value."""
    keys = {"root": _value("Root"), "info": _value("Info"), "id": _value("ID")}
    last = [F.max_by(value, F.when(value.isNotNull(), F.col("pos"))).alias(k) for k, value in keys.items()]
    return rows.where("kind = 'trailer'").groupBy("file_id").agg(*last).select("file_id", _reference(F.col("root")).alias("root"), _reference(F.col("info")).alias("info"), F.col("id").isNotNull().alias("has_id"))


def _resolved(rows: DataFrame, column: str, defined: DataFrame) -> DataFrame:
    """rows with the value of column, or, if it is a reference, the body of the object it names."""
    bodies = defined.where("body IS NOT NULL").select("file_id", F.col("number").alias("_n"), F.decode("body", "ISO-8859-1").alias("_body"))
    named = rows.withColumn("_n", _reference(F.col(column)))
    return named.join(bodies, ["file_id", "_n"], "left").withColumn(column, F.coalesce("_body", column)).drop("_n", "_body")


def pages(defined: DataFrame, trailer: DataFrame) -> DataFrame:
    """file_id, place (of the page among all), number, width, height, annotations (their value): from the catalog down, level by level."""
    roots = defined.select("file_id", F.col("number").alias("root"), _reference(_value("Pages")).alias("number"))
    level = trailer.select("file_id", "root").join(roots, ["file_id", "root"]).select("file_id", "number", F.array().cast("array<int>").alias("place"), F.lit(None).cast("string").alias("box"), F.array().cast("array<bigint>").alias("above"))
    nodes = defined.select("file_id", "number", _value("Kids").alias("kids"), _value("MediaBox").alias("own_box"), _value("Annots").alias("annotations"))
    leaves, level = None, written(level, "level")
    while not level.isEmpty():
        told = _resolved(_resolved(level.join(nodes, ["file_id", "number"]), "kids", defined), "own_box", defined).withColumn("box", F.coalesce("own_box", "box"))
        own = told.where("kids IS NULL").select("file_id", "place", "number", "box", "annotations")
        leaves = own if leaves is None else leaves.union(own)
        inner = told.where("kids IS NOT NULL").select("file_id", "place", "box", F.concat("above", F.array("number")).alias("above"), F.posexplode(_references(F.col("kids"))).alias("k", "kid"))
        # a page that is above itself is left out: it would have no end
        level = written(inner.where(~F.array_contains("above", F.col("kid"))).select("file_id", F.col("kid").alias("number"), F.concat("place", F.array("k")).alias("place"), "box", "above"), "level")
    if leaves is None:
        return defined.sparkSession.createDataFrame([], defined.select("file_id", F.array().cast("array<int>").alias("place"), "number", F.lit(0.0).alias("width"), F.lit(0.0).alias("height"), F.lit("").alias("annotations")).schema)
    box = F.transform(F.regexp_extract_all("box", F.lit(r"[-+]?\d*\.?\d+"), 0), lambda x: x.try_cast("double"))
    side = lambda a, b: F.round(F.abs(F.get("b", F.lit(b)) - F.get("b", F.lit(a))), 2)
    return leaves.withColumn("b", box).select("file_id", "place", "number", side(0, 2).alias("width"), side(1, 3).alias("height"), "annotations")


def annotations(defined: DataFrame, leaves: DataFrame) -> DataFrame:
    """file_id, number, author (or null): what pages refer to as annotations, once for each page that does."""
    named = _resolved(leaves.where("annotations IS NOT NULL"), "annotations", defined).select("file_id", F.explode(_references(F.col("annotations"))).alias("number"))
    return named.join(defined.where("entries IS NOT NULL").select("file_id", "number", filled(_value("T", "text")).alias("author")), ["file_id", "number"])


def _xmp(text: Column) -> Column:
    """Findings of a packet, or one that it is there; none if there is none."""

    def first(patterns: tuple) -> Column:
        return F.coalesce(*[filled(stripped(F.regexp_replace(F.regexp_extract(text, p, 1), "<[^>]+>", ""))) for p in patterns])

    told = F.filter(F.array(*[found("pdf-xmp", f"XMP:{field}", label, first(patterns), severity) for field, label, severity, patterns in XMP]), lambda f: f["value"].isNotNull())
    others = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"<(\w+):[\w-]+"), 1)), lambda n: ~n.isin(*NAMESPACES))
    none = F.array().cast(f"array<{FINDING}>")
    all_ = F.concat(told, F.when(F.size(others) > 0, F.array(found("pdf-xmp", "XMP:custom-namespaces", "XMP custom namespaces", F.array_join(others, ", "), "medium"))).otherwise(none))
    present = F.when(F.size(all_) > 0, all_).otherwise(F.array(found("pdf-xmp", "XMP:present", "XMP metadata", "Present", "medium")))
    return F.when(text.rlike(r"(?i)<\?xpacket|xmpmeta|rdf:RDF"), present).otherwise(none)


def _description(entry: Column) -> Column:
    info = listed(INFO, entry["key"])
    label = F.coalesce(info["label"], F.format_string('Property "%s"', entry["key"]))
    return found(F.coalesce(info["category"], F.lit("pdf-custom")), F.concat(F.lit("Info:"), entry["key"]), label, entry["text"], F.coalesce(info["severity"], F.lit("medium")))


def findings(defined: DataFrame, trailer: DataFrame, authors: DataFrame) -> DataFrame:
    """file_id, findings, raw (values that a copy must not hold): description, XMP, identifier, private data, annotations."""
    none = F.array().cast(f"array<{FINDING}>")
    own = F.filter("entries", lambda e: e["key"] != TRAPPED)
    custom = F.transform(F.filter(own, lambda e: ~e["key"].isin(*INFO)), lambda e: e["key"])
    info = defined.where("entries IS NOT NULL").select("file_id", F.col("number").alias("info"), F.transform(own, _description).alias("told"), custom.alias("names"))
    catalog = defined.select("file_id", F.col("number").alias("root"), _reference(_value("Metadata")).alias("packet"), _value("PieceInfo").isNotNull().alias("private"))
    packets = defined.where("stream IS NOT NULL").select("file_id", F.col("number").alias("packet"), _xmp(utf8(F.col("stream"))).alias("xmp"))
    people = authors.where("author IS NOT NULL").groupBy("file_id").agg(F.count("*").alias("n"), F.collect_set("author").alias("people"))
    rows = trailer.join(info, ["file_id", "info"], "left").join(catalog, ["file_id", "root"], "left").join(packets, ["file_id", "packet"], "left").join(people, "file_id", "left")
    one = lambda test, finding: F.when(test, F.array(finding)).otherwise(none)
    told = F.concat(
        F.coalesce("told", none), F.coalesce("xmp", none), one(F.col("has_id"), found("pdf-identifiers", "Trailer:ID", "Document identifier (trailer /ID)", "Present", "low")),
        one(F.coalesce("private", F.lit(False)), found("pdf-custom", "PieceInfo", "Private application data (PieceInfo)", "Present", "medium")),
        one(F.col("n") > 0, found("pdf-annotations", "Annot:T", "Comment authors", F.col("n"), "high")),
    )
    texts = F.array().cast("array<string>")
    values = F.transform(F.filter(F.concat(F.coalesce("told", none), F.coalesce("xmp", none)), lambda f: ~f["field"].isin("XMP:custom-namespaces", "XMP:present")), lambda f: f["value"])
    raw = F.filter(F.array_distinct(F.concat(values, F.coalesce("names", texts), F.coalesce("people", texts))), lambda v: F.length(stripped(v)) >= 2)
    return rows.select("file_id", told.alias("findings"), raw.alias("raw"))


def _reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, number of what can be reached from roots (file_id, number) over edges (file_id, number, to), in rounds."""
    seen = step = written(roots, "reached")
    while True:
        more = step.join(edges, ["file_id", "number"]).select("file_id", F.col("to").alias("number")).distinct().join(seen, ["file_id", "number"], "left_anti")
        step = written(more, "reached")
        if step.isEmpty():
            return seen
        seen = seen.union(step)  # of written tables, one for each step


def copies(rows: DataFrame, defined: DataFrame, trailer: DataFrame, authors: DataFrame) -> DataFrame:
    """file_id, content: the objects that are needed, without what tells of people, under a new cross-reference table."""
    annotated = authors.select("file_id", "number").distinct().withColumn("annotation", F.lit(True))
    marked = defined.join(annotated, ["file_id", "number"], "left").join(trailer.select("file_id", "root"), "file_id")
    lost = lambda e: e["key"].isin(*LOST) | F.coalesce(F.col("annotation"), F.lit(False)) & e["key"].isin(*OF_ANNOTATIONS)
    size = F.octet_length("stream").cast("string")
    kept = F.transform(F.filter("entries", lambda e: ~lost(e)), lambda e: F.concat(e["raw"], F.lit(" "), F.when((e["key"] == "Length") & size.isNotNull(), size).otherwise(e["value"])))
    text = F.concat(F.lit("<<"), F.array_join(kept, "\n"), F.lit(">>"))
    cleaned = written(marked.select("file_id", "number", "generation", "root", F.encode(text, "ISO-8859-1").alias("dictionary"), "body", "stream"), "objects")
    edges = cleaned.select("file_id", "number", F.explode(_references(F.coalesce(F.decode("dictionary", "ISO-8859-1"), F.decode("body", "ISO-8859-1")))).alias("to")).distinct()
    needed = _reached(written(edges, "edges"), cleaned.where("number = root").select("file_id", "number"))

    begin = F.encode(F.format_string("%d %d obj\n", "number", "generation"), "ISO-8859-1")
    stream = F.when(F.col("stream").isNotNull(), F.concat(F.lit(b"\nstream\n"), F.col("stream"), F.lit(b"\nendstream"))).otherwise(F.lit(b""))
    data = F.concat(begin, F.coalesce("dictionary", "body"), stream, F.lit(b"\nendobj\n"))
    parts = cleaned.join(needed, ["file_id", "number"]).select("file_id", F.col("number").alias("idx"), "generation", "root", data.alias("bytes"))
    head = rows.where("kind = 'header'").select("file_id", F.concat("body", F.lit(b"\n%\xe2\xe3\xcf\xd3\n")).alias("bytes"))
    head = head.join(parts.select("file_id", "root").distinct(), "file_id").select("file_id", F.lit(-1).cast("bigint").alias("idx"), F.lit(0).cast("bigint").alias("generation"), "root", "bytes")
    placed = offsets(head.union(parts.select(*head.columns)).withColumn("size", F.octet_length("bytes").cast("bigint")))
    placed = written(placed.select("file_id", "idx", "generation", "root", "bytes", "begins", "size"), "placed")
    line = F.when(F.col("idx") >= 0, F.struct("idx", F.format_string("%d 1\n%010d %05d n \n", "idx", "begins", "generation").alias("line")))
    table = placed.groupBy("file_id", "root").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.max("idx").alias("last"), F.sum("size").alias("at"))
    own = F.concat(
        F.lit("xref\n0 1\n0000000000 65535 f \n"), F.array_join(F.col("lines.line"), ""), F.format_string("trailer\n<</Size %d/Root %d 0 R>>\nstartxref\n%d\n%%%%EOF\n", F.col("last") + 1, "root", "at")
    )
    ending = table.select("file_id", (F.col("last") + 1).alias("idx"), F.encode(own, "ISO-8859-1").alias("bytes"))
    return joined_bytes(placed.select("file_id", "idx", "bytes").union(ending))


def read(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables of files (file_id, content): rows, objects that count, trailers, pages and annotations."""
    rows = written(objects(files), "rows")
    defined, trailer = written(current(rows), "objects"), written(trailers(rows), "trailers")
    leaves = written(pages(defined, trailer), "pages")
    return rows, defined, trailer, leaves, written(annotations(defined, leaves), "annotations")


def _geometry(leaves: DataFrame) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct("place", F.struct("width", "height").alias("size"))))
    within = F.bool_or(F.contains("annotations", F.lit("<<")))
    return leaves.groupBy("file_id").agg(F.count("*").alias("pages"), F.transform(sorted_, lambda p: p["size"]).alias("geometry"), within.alias("within"))


def scan(files: DataFrame) -> DataFrame:
    """file_id, reason, findings, raw, pages, geometry."""
    return _scanned(files, *read(files))


def _scanned(files: DataFrame, rows: DataFrame, defined: DataFrame, trailer: DataFrame, leaves: DataFrame, authors: DataFrame) -> DataFrame:
    blocked = files.groupBy("file_id").agg(F.max(packages.pdf_blocked(F.col("content"))).alias("blocked"), F.count("*").alias("files"))
    bad = rows.groupBy("file_id").agg(F.bool_or(F.col("kind") == "malformed").alias("bad"))
    joined = blocked.join(bad, "file_id", "left").join(findings(defined, trailer, authors), "file_id", "left").join(_geometry(leaves), "file_id", "left")
    no_pages = F.coalesce("pages", F.lit(0)) == 0
    reason = (
        F.when(F.col("files") > 1, "repeated-id").when(F.col("blocked").isNotNull(), F.col("blocked")).when(F.col("bad") | no_pages, "malformed")
        .when(F.col("pages") > MOST_PAGES, "too-many-pages").when(F.coalesce("within", F.lit(False)), "annotations-in-page")
    )
    none = F.array().cast(f"array<{FINDING}>")
    return joined.select("file_id", reason.alias("reason"), F.coalesce("findings", none).alias("findings"), F.coalesce("raw", F.array().cast("array<string>")).alias("raw"), F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"), "geometry")


def clean_and_verify(files: DataFrame) -> DataFrame:
    """file_id, reason, content (the copy, or null), found_before, raw, remaining, leaked, passed of files (file_id, content)."""
    files = files.select("file_id", "content")
    tables = read(files)
    told = written(_scanned(files, *tables), "told")
    allowed = told.where("reason IS NULL").select("file_id")
    clean = written(copies(*(t.join(allowed, "file_id") for t in (tables[0], tables[1], tables[2], tables[4]))), "copies")
    again = written(scan(clean), "again").select("file_id", F.col("reason").alias("why"), F.size("findings").cast("bigint").alias("remaining"), F.col("geometry").alias("copied"))
    searched = leaks.search(clean.join(told.select("file_id", "raw"), "file_id"))
    held = searched.select("file_id", F.size("leaks").cast("bigint").alias("leaked"), F.decode("content", "ISO-8859-1").rlike(RESIDUE).alias("residue"))
    joined = told.join(clean, "file_id", "left").join(again, "file_id", "left").join(held, "file_id", "left")
    passed = F.col("why").isNull() & (F.col("remaining") == 0) & (F.col("leaked") == 0) & ~F.col("residue") & same_geometry(F.col("geometry"), F.col("copied"))
    return joined.select("file_id", "reason", "content", F.size("findings").cast("bigint").alias("found_before"), "raw", "pages", "remaining", "leaked", F.coalesce(passed, F.lit(False)).alias("passed"))
