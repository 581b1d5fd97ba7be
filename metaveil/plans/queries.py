"""Queries over the operators, and DuckDB SQL with the same results. Pages and documents stand in for files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.operators import archive, findings, svg
from metaveil.plans import archives as archive_queries
from metaveil.plans import binary as binary_queries
from metaveil.plans import heic as heic_queries
from metaveil.plans import mail as mail_queries
from metaveil.plans import nested as nested_queries
from metaveil.plans import odd_files as odd_queries
from metaveil.plans import pdf as pdf_queries
from metaveil.plans import relations as relation_queries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: First bytes that stand before a page's text, by page_id modulo their number; each rule has heads that meet it, and some that just don't.
HEADS = (
    "FFD8FFE0", "FFD8FEE0", "89504E470D0A1A0A", "89504E470D0A1A0B", "524946460000000057454250", "49492A00", "4D4D002A", "49492A01", "474946383961", "474946383861",
    "424D0000000000000000000000002800000000", "424D0000000000000000000000002900000000", "0000002066747970617669660000", "00000014667479706D696631000000006D696631",
    "000000186674797069736F6D0000000069736F6D68656963", "000000186674797069736F6D0000000069736F6D68656962", "00000100010010100000010020000A00000016000000",
    "00000100C80010100000010020000A00000016000000", "000001000100101000000100200000000000160000FF", "664C6143", "4F676753", "1A45DFA3", "524946460000000041564920",
    "38425053", "7B5C72746631", "524946460000000057415645", "255044462D312E37", "504B0304", "504B0705", "504B0104", "494433", "FFFB9064", "FFE80000", "FFFBF064", "FFFB0064", "FFFB9C64",
    "D0CF11E0A1B11AE1", "D0CF11E0A1B11AE2", "00",
)
#: And first characters.
TEXT_HEADS = (
    "<svg ", "hello <svg >", "<svgs", " <?xml version='1.0'?><a/><SVGx", "<a/><SVGx", "From: a@b\nTo: c@d\nSubject: x\n\n", "From:a@b\nTo:c@d\nSubject:x\n\n",
    "X-One: 1\nX-Two: 2\nX-Three: 3\n\n", "Received: by x\nX-Two: 2\n\n", "Received: by x\nX-Two: 2\nMIME-Version: 1.0\n\n",
)


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = [*HEADS, *(h.encode().hex().upper() for h in TEXT_HEADS)]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % len(heads) + 1).cast("int"))
    files = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.unhex(head), F.encode("html", "UTF-8")).alias("content"))
    kind = formats.detect(F.col("content"))
    return files.select("page_id", kind.alias("format"), formats.gate(kind, F.length("content")).alias("status"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as vector images: titles, comments and paragraphs stay what they are."""
    body = F.regexp_replace(F.regexp_replace("html", "(?is)<script.*?</script>", ""), "(?i)href=", "data=")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.concat(F.lit("<svg inkscape:version='1'>"), body, F.lit("</svg>")).alias("text"))


def svg_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", svg.blocked(F.col("html")).alias("reason"))


def svg_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.explode(svg.scan(_images(spark, sf_dir)))
    return found.select("file_id", "category", "field", "label", "value", "severity")


def svg_clean_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = svg.clean_and_verify(_images(spark, sf_dir))
    return done.select("file_id", "status", F.sha2("clean", 256).alias("clean_sha256"), "found_before", "remaining", "passed")


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.personal_count(findings.explode(svg.scan(_images(spark, sf_dir))))


def finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.concrete(findings.explode(svg.scan(_images(spark, sf_dir)))).drop("first")


def finding_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.categories(findings.explode(svg.scan(_images(spark, sf_dir))))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as entries of fifty archives: of some, paths leave the folder or stand twice, or entries are too many or too large."""
    pages = _table(spark, sf_dir, "pages")
    group = F.col("page_id") % 50
    path = F.regexp_replace("url", "^https?://", "")
    path = F.when(group < 10, F.regexp_replace(path, r"/(\d)\d*$", "/../$1")).when(group < 20, F.concat(F.lit("a/./B//x"), (F.col("page_id") % 4).cast("string"))).otherwise(path)
    size = F.when(group.between(20, 24), 100_000_000).when(group.between(25, 29), 100 * F.length("html")).otherwise(F.length("html"))
    length = F.when(group.between(20, 24), 1_000_000_000).when(group.between(25, 29), 50).otherwise(1_000_000)
    more = F.explode(F.sequence(F.lit(0), F.when(group.between(30, 34), 2499).otherwise(0))).alias("more")
    rows = pages.select(group.alias("file_id"), "page_id", path.alias("path"), size.cast("bigint").alias("size"), length.cast("bigint").alias("file_length"), more)
    shown = F.when(F.col("more") > 0, F.concat("path", F.lit("."), F.col("more"))).otherwise(F.col("path"))
    return rows.select("file_id", (F.col("page_id") * 10_000 + F.col("more")).alias("entry_pos"), shown.alias("path"), "size", "file_length")


def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _entries(spark, sf_dir).select("entry_pos", archive.canonical(path).alias("canonical"), archive.leaves_folder(path).alias("leaves"), archive.extension(path).alias("extension"))


def archive_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.gates(_entries(spark, sf_dir))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return _table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"), F.concat(F.substring(digest, 1, 16), F.lit("…")).alias("short_hash"))


QUERIES = {
    f.__name__: f
    for f in (detect_format, svg_gate, svg_findings, svg_clean_verify, finding_summary, finding_groups, finding_categories, archive_paths, archive_gates, content_hash)
}

_GATE = " ".join(f"WHEN regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in svg.ACTIVE)
_IMAGES = """images AS (SELECT page_id AS file_id, '<svg inkscape:version=''1''>' || regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?i)href=', 'data=', 'g') || '</svg>' AS text FROM pages)"""
_FOUND = (
    _IMAGES
    + r""", found AS (
    SELECT file_id, 0 AS pos, 'other' AS category, 'SVG:Comments' AS field, 'XML comments (' || len(c) || ')' AS label, nullif(trim(left(trim(regexp_replace(c[1], '^<!--|-->$', '', 'g')), 180)), '') AS value, 'medium' AS severity
        FROM (SELECT file_id, regexp_extract_all(text, '(?s)<!--.*?-->') AS c FROM images) WHERE len(c) > 0
    UNION ALL SELECT file_id, 1, 'containers', 'SVG:Metadata', 'Metadata element (RDF/Dublin Core)', nullif(trim(regexp_replace(regexp_extract(text, '(?is)<dc:creator>.*?<dc:title>|<dc:creator[^>]*>(.{0,200}?)</dc:creator>', 1), '<[^>]+>', '', 'g')), ''), 'high' FROM images WHERE regexp_matches(text, '(?i)<metadata\b')
    UNION ALL SELECT file_id, 2, 'software', 'SVG:Editor:inkscape', 'Editor metadata (inkscape)', CAST(len(regexp_extract_all(text, '(?i)\binkscape:[\w-]+')) AS VARCHAR), 'medium' FROM images WHERE regexp_matches(text, '(?i)\binkscape:[\w-]+')
    UNION ALL SELECT file_id, 3, 'software', 'SVG:Editor:sodipodi', 'Editor metadata (sodipodi)', CAST(len(regexp_extract_all(text, '(?i)\bsodipodi:[\w-]+')) AS VARCHAR), 'medium' FROM images WHERE regexp_matches(text, '(?i)\bsodipodi:[\w-]+')
    UNION ALL SELECT file_id, 4, 'other', 'SVG:Title', 'Title', v, 'medium' FROM (SELECT file_id, nullif(trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.{0,300}?)</title>', 1), '<[^>]+>', '', 'g')), '') AS v FROM images) WHERE v IS NOT NULL
    UNION ALL SELECT file_id, 5, 'other', 'SVG:Desc', 'Description', v, 'medium' FROM (SELECT file_id, nullif(trim(regexp_replace(regexp_extract(text, '(?is)<desc[^>]*>(.{0,300}?)</desc>', 1), '<[^>]+>', '', 'g')), '') AS v FROM images) WHERE v IS NOT NULL
    UNION ALL SELECT file_id, 6, 'other', 'SVG:Doctype', 'DOCTYPE declaration', 'Present', 'low' FROM images WHERE regexp_matches(text, '(?i)<!DOCTYPE'))"""
)
_ENTRIES = r"""p AS (SELECT page_id, page_id % 50 AS g, regexp_replace(url, '^https?://', '') AS u, length(html) AS n FROM pages),
    q AS (SELECT page_id, g, CASE WHEN g < 10 THEN regexp_replace(u, '/(\d)\d*$', '/../\1') WHEN g < 20 THEN 'a/./B//x' || (page_id % 4) ELSE u END AS u,
        CASE WHEN g BETWEEN 20 AND 24 THEN 100000000 WHEN g BETWEEN 25 AND 29 THEN 100 * n ELSE n END AS size,
        CASE WHEN g BETWEEN 20 AND 24 THEN 1000000000 WHEN g BETWEEN 25 AND 29 THEN 50 ELSE 1000000 END AS file_length,
        unnest(range(CASE WHEN g BETWEEN 30 AND 34 THEN 2500 ELSE 1 END)) AS more FROM p),
    e AS (SELECT g AS file_id, page_id * 10000 + more AS entry_pos, u || CASE WHEN more > 0 THEN '.' || more ELSE '' END AS path, size, file_length FROM q)"""
_CLEAN = "text"
for _p in svg.REMOVED:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p.replace(chr(39), chr(39) * 2)}', '', 'g')"

_LITERAL = ", ".join("'" + h + "'" for h in HEADS)
_TEXTS = ", ".join("'" + h.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for h in TEXT_HEADS)
_N, _M = len(HEADS), len(HEADS) + len(TEXT_HEADS)
#: The rules once more, over hexadecimal digits (x) and, for files that begin with text, characters (t).
_DETECT = rf"""
    WITH h AS (SELECT page_id, html, CASE WHEN page_id % {_M} >= {_N} THEN list_extract([{_TEXTS}], CAST(page_id % {_M} - {_N} + 1 AS INT)) || html END AS t,
        list_extract([{_LITERAL}], CAST(page_id % {_M} + 1 AS INT)) AS head FROM pages),
    f AS (SELECT page_id, t, CASE WHEN t IS NULL THEN head || hex(encode(html)) ELSE hex(encode(t)) END AS x FROM h),
    n AS (SELECT *, CAST('0x' || left(x, 8) AS BIGINT) AS box, CAST('0x' || substr(x, 11, 2) || substr(x, 9, 2) AS BIGINT) AS icons,
        CAST('0x' || left(x, 6) AS BIGINT) AS sync, CAST('0x' || substr(x, 35, 2) || substr(x, 33, 2) || substr(x, 31, 2) || substr(x, 29, 2) AS BIGINT) AS isize,
        CAST('0x' || substr(x, 43, 2) || substr(x, 41, 2) || substr(x, 39, 2) || substr(x, 37, 2) AS BIGINT) AS ioff, len(x) // 2 AS size FROM f),
    k AS (SELECT page_id, size, CASE
        WHEN x LIKE 'FFD8FF%' THEN 'jpeg' WHEN x LIKE '89504E470D0A1A0A%' THEN 'png' WHEN x LIKE '52494646________57454250%' THEN 'webp'
        WHEN x LIKE '49492A00%' OR x LIKE '4D4D002A%' THEN 'tiff' WHEN x LIKE '474946383761%' OR x LIKE '474946383961%' THEN 'gif'
        WHEN x LIKE '424D%' AND substr(x, 29, 8) IN ('0C000000', '28000000', '34000000', '38000000', '6C000000', '7C000000') THEN 'bmp'
        WHEN substr(x, 9, 8) = '66747970' AND substr(x, 17, 8) IN ('61766966', '61766973') THEN 'avif'
        WHEN substr(x, 9, 8) = '66747970' AND box >= 16 AND box <= size AND len(list_intersect(
            list_append(list_transform(range(16, least(box, 1028) - 3, 4), lambda p: substr(x, 2 * p + 1, 8)), substr(x, 17, 8)),
            ['68656963', '68656978', '68657663', '68657678', '6865696D', '68656973', '6865766D', '68657673', '6D696631', '6D736631', '68656966', '61766966', '61766973'])) > 0 THEN 'heic'
        WHEN (x LIKE '00000100%' OR x LIKE '00000200%') AND icons BETWEEN 1 AND 64 AND 6 + 16 * icons <= size AND isize > 0 AND ioff >= 6 + 16 * icons AND ioff + isize <= size THEN 'ico'
        WHEN regexp_matches(left(t, 1024), '(?i)<svg[\s>]') OR regexp_matches(left(t, 1024), '(?i)^\s*<\?xml') AND contains(lower(left(t, 1024)), '<svg') THEN 'svg'
        WHEN x LIKE '664C6143%' THEN 'flac' WHEN x LIKE '4F676753%' THEN 'ogg' WHEN x LIKE '1A45DFA3%' THEN 'mkv' WHEN x LIKE '52494646________41564920%' THEN 'avi'
        WHEN x LIKE '38425053%' THEN 'psd' WHEN x LIKE '7B5C727466%' THEN 'rtf' WHEN x LIKE '52494646________57415645%' THEN 'wav'
        WHEN substr(x, 9, 8) = '66747970' THEN 'mp4' WHEN x LIKE '255044462D%' THEN 'pdf' WHEN x LIKE '504B03%' OR x LIKE '504B05%' OR x LIKE '504B07%' THEN 'zip'
        WHEN x LIKE '494433%' OR sync >> 13 = 2047 AND (sync >> 11) & 3 <> 1 AND (sync >> 9) & 3 <> 0 AND (sync >> 4) & 15 NOT IN (0, 15) AND (sync >> 2) & 3 <> 3 THEN 'mp3'
        WHEN len(regexp_extract_all(left(t, 2048), '(?m)^[!-9;-~]+:[ \t]')) >= 3 AND regexp_matches(left(t, 2048), '(?im)^(from|to|subject|received|return-path|mime-version|date):') THEN 'eml'
        WHEN x LIKE 'D0CF11E0A1B11AE1%' THEN 'docx' END AS format FROM n)
    SELECT page_id, format, CASE WHEN format IS NULL THEN 'unsupported-format' ELSE 'ok' END AS status FROM k"""

ORACLE = {
    "detect_format": _DETECT,
    "svg_gate": f"SELECT page_id, CASE {_GATE} END AS reason FROM pages",
    "svg_findings": f"WITH {_FOUND} SELECT file_id, category, field, label, value, severity FROM found",
    "svg_clean_verify": f"WITH {_FOUND}, n AS (SELECT file_id, count(*) AS n FROM found GROUP BY file_id) "
    f"SELECT file_id, 'ok' AS status, sha256({_CLEAN}) AS clean_sha256, n AS found_before, CAST(0 AS BIGINT) AS remaining, true AS passed FROM images JOIN n USING (file_id)",
    "finding_summary": f"WITH {_FOUND} SELECT file_id, count(*) AS traces, CASE max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS worst FROM found GROUP BY file_id",
    "finding_groups": f"""WITH {_FOUND}, g AS (SELECT file_id, pos, CASE WHEN category = 'software' THEN 'app' WHEN category = 'containers' THEN 'containers' WHEN field = 'SVG:Comments' THEN 'comment' ELSE 'other' END AS label,
        CASE WHEN coalesce(trim(value), '') = '' OR value LIKE '[%' OR trim(value) = 'Present' THEN label ELSE value END AS shown, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS r FROM found),
        d AS (SELECT file_id, label, CASE WHEN length(shown) > 180 THEN left(shown, 180) || '…' ELSE shown END AS shown, min(pos) AS pos, max(r) AS r FROM g GROUP BY ALL)
        SELECT file_id, label, CASE max(r) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, string_agg(shown, ' | ' ORDER BY pos) AS found FROM d GROUP BY file_id, label""",
    "finding_categories": f"WITH {_FOUND}, b AS (SELECT file_id, CASE category WHEN 'software' THEN 'app' WHEN 'containers' THEN 'containers' END AS bucket, min(pos) AS pos FROM found GROUP BY ALL) SELECT file_id, string_agg(bucket, ',' ORDER BY pos) AS categories FROM b WHERE bucket IS NOT NULL GROUP BY file_id",
    "archive_paths": rf"""WITH {_ENTRIES}, parted AS (SELECT entry_pos, path, string_split(replace(path, '\', '/'), '/') AS parts, regexp_matches(replace(path, '\', '/'), '(?i)^([a-z]:)?/') OR list_contains(string_split(replace(path, '\', '/'), '/'), '..') AS leaves FROM e)
        SELECT entry_pos, CASE WHEN NOT leaves THEN array_to_string(list_filter(parts, lambda x: x <> '' AND x <> '.'), '/') END AS canonical, leaves,
            CASE WHEN contains(string_split(path, '/')[-1], '.') THEN lower(string_split(string_split(path, '/')[-1], '.')[-1]) ELSE '' END AS extension FROM parted""",
    "archive_gates": rf"""WITH {_ENTRIES}, m AS (SELECT *, CASE WHEN list_contains(string_split(path, '/'), '..') THEN NULL ELSE lower(array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/')) END AS c FROM e),
        k AS (SELECT *, CASE WHEN c IS NULL THEN 'path-traversal' WHEN row_number() OVER (PARTITION BY file_id, c ORDER BY entry_pos) > 1 THEN 'duplicate-path' END AS problem FROM m)
        SELECT file_id, coalesce(arg_min(problem, entry_pos) FILTER (problem IS NOT NULL), CASE WHEN count(*) > 10000 THEN 'too-many-entries' WHEN sum(size) > 262144000 THEN 'too-large' WHEN sum(size) / max(file_length) > 200 THEN 'zip-bomb' END) AS reason FROM k GROUP BY file_id""",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, left(sha256(coalesce(text, '')), 16) || '…' AS short_hash FROM documents",
}
for _more in (archive_queries, binary_queries, heic_queries, mail_queries, nested_queries, odd_queries, pdf_queries, relation_queries):
    QUERIES |= _more.QUERIES
    ORACLE |= _more.ORACLE
