"""Queries over files that must not pass, or only just: pages as images and films with odd structures, and what becomes of each, in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import binary, findings
from metaveil.plans.binary import files as sample_files
from metaveil.plans.binary import DUCK, GIF_IMAGE, MP4_START, PNG_END, PNG_START, SAMPLES, SPARK, Digits, _bitmap, _box, _chunk, _jpeg_image, _movie, _png_image, _segment


@dataclass(frozen=True)
class Case:
    file: Callable[[Digits], list[str]]
    found: int = 0
    remaining: int | None = 0  # None: there is no copy
    reason: str | None = None
    passed: bool = True


def _refused(file: Callable[[Digits], list[str]], reason: str, found: int = 0) -> Case:
    return Case(file, found, None, reason, False)


def _gps(d: Digits) -> str:
    """A directory of places: degrees, minutes and seconds as fractions, an altitude, and a tag without a name."""
    entry = lambda tag, kind, count, value: f"{d.little(tag, 2)} || {d.little(kind, 2)} || {d.little(count)} || {value}"
    north = "(CASE WHEN page_id % 2 = 0 THEN '4E000000' ELSE '53000000' END)"
    entries = [
        entry(1, 2, 2, north), entry(2, 5, 3, d.little(116)), entry(3, 2, 2, "'57000000'"), entry(4, 5, 3, d.little(140)),
        entry(5, 1, 1, "'00000000'"), entry(6, 5, 1, d.little(164)), entry(31, 4, 1, d.little(7)),
    ]
    values = [d.little(x) for x in ("page_id % 90", 1, 30, 1, "page_id % 60", 1, 10, 1, 15, 1, 0, 1, "(page_id % 1000) * 2 + 1", 2)]
    tiff = ["'49492A0008000000'", d.little(1, 2), entry(0x8825, 4, 1, d.little(26)), d.little(0), d.little(len(entries), 2), *entries, d.little(0), *values]
    return _segment(d, "FFE1", f"{d.text('Exif')} || '0000' || {' || '.join(tiff)}", 178)


def _located(d: Digits) -> list[str]:
    return ["'FFD8'", _gps(d), _jpeg_image(d), "'FFD9'"]


def _coloured(d: Digits) -> list[str]:
    return [PNG_START, _chunk(d, "gAMA", d.big(45455), 4), _chunk(d, "cHRM", "repeat('01', 32)", 32), _png_image(d), PNG_END]


def _sized_jpeg(d: Digits, width: int, height: int) -> list[str]:
    return ["'FFD8'", f"'FFC0000B08{height:04X}{width:04X}01011100'", "'FFDA0002'", d.of("html"), "'FFD9'"]


def _png(width: int, height: int) -> str:
    return f"'89504E470D0A1A0A' || '0000000D49484452{width:08X}{height:08X}0802000000' || '00000000'"


def _large_box(d: Digits, name: str, body: str, size: str) -> str:
    return f"'00000001' || {d.text(name)} || {d.big(f'16 + {size}', 8)} || {body}"


CASES = {
    "jpeg": (
        # a comment behind the coded image stays in the copy, and is found there
        Case(lambda d: ["'FFD8'", _jpeg_image(d), _segment(d, "FFFE", d.of("url"), d.size("url")), "'FFD9'"], 1, 1, passed=False),
        _refused(lambda d: ["'FFD8'", _segment(d, "FFFE", d.of("url"), d.size("url")), "'FFDA0002'", d.of("html"), "'FFD9'"], "malformed", 1),
        _refused(lambda d: _sized_jpeg(d, 8000, 5001), "resource-limit"),
        Case(lambda d: _sized_jpeg(d, 8000, 5000)),
        Case(_located, 10),
        # an image within a segment, and a segment between two scans
        Case(lambda d: ["'FFD8'", _segment(d, "FFE1", f"{d.text('Exif')} || '000049492A0008000000' || '0000' || 'FFD8FFD9' || {d.of('url')}", d.size("url", 20)), _jpeg_image(d), "'FFD9'"], 1),
        Case(lambda d: ["'FFD8'", _jpeg_image(d), "'FFD0FF00'", _segment(d, "FFEF", d.of("url"), d.size("url")), _segment(d, "FFED", d.text("Photoshop 3.0"), 13), "'FFDA0002'", d.of("html"), "'FFD9'", _segment(d, "FFFE", d.of("url"), d.size("url"))], 1, 1, passed=False),
    ),
    "png": (
        _refused(lambda d: ["'89504E470D0A1A0A'", _png_image(d), PNG_END], "malformed"),
        _refused(lambda d: [_png(20_000, 20_000), _png_image(d), PNG_END], "resource-limit"),
        Case(_coloured),
        Case(lambda d: [PNG_START, _chunk(d, "eXIf", d.of("url"), d.size("url")), _png_image(d), PNG_END], 1),
    ),
    "gif": (
        _refused(lambda d: ["'474946383961'", d.little(9000, 2), d.little(9000, 2), "'000000'", GIF_IMAGE, "'3B'"], "resource-limit"),
        _refused(lambda d: ["'474946383961'", d.of("html")], "malformed"),
        Case(lambda d: ["'474946383961'", d.little("page_id % 5000 + 1", 2), d.little(3, 2), "'000000'", f"'21FE' || {d.big(d.size('url'), 1)} || {d.of('url')} || '00'", GIF_IMAGE], 1),
    ),
    "mp4": (
        _refused(lambda d: [MP4_START, _box(d, "mdat", d.of("html"), d.size("html"))], "malformed"),
        Case(lambda d: [MP4_START, _movie(d, False), _large_box(d, "mdat", d.of("html"), d.size("html"))], 2),
        Case(lambda d: [MP4_START, _movie(d, False), _large_box(d, "uuid", d.of("html"), d.size("html"))], 3),
        # a box beyond the end ends the list
        Case(lambda d: [MP4_START, _movie(d, False), "'7FFFFFFF'", d.text("mdat"), d.of("html")], 2),
        _refused(lambda d: [_movie(d, False), MP4_START], "malformed"),
    ),
}


def _files(spark: SparkSession, sf_dir: str, makers: list[Callable[[Digits], list[str]]]) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    digits = " ".join(f"WHEN {k} THEN {' || '.join(make(SPARK))}" for k, make in enumerate(makers))
    return pages.select(F.col("page_id").alias("file_id"), F.unhex(F.expr(f"CASE page_id % {len(makers)} {digits} END")).alias("content"))


def _verified(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = binary.clean_and_verify(_files(spark, sf_dir, [c.file for c in CASES[kind]]), kind)
        return done.select("file_id", "status", "reason", "found_before", "remaining", "passed")

    query.__name__ = f"{kind}_odd_files"
    return query


def _told(kind: str, name: str, make: Callable[[Digits], list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return findings.explode(binary.scan(_files(spark, sf_dir, [make]), kind)).select("file_id", "pos", "category", "field", "label", "value", "severity")

    query.__name__ = name
    return query


def _turned(d: Digits) -> list[str]:
    """Tags with an orientation of 0 to 9 and the author."""
    tags = [d.little(2, 2), f"'1201030001000000' || {d.big('page_id % 10', 1)} || '000000'", f"'3B010200' || {d.little(d.size('url', 1))} || {d.little(38)}", d.little(0), d.of("url"), "'00'"]
    return ["'FFD8'", _segment(d, "FFE1", f"{d.text('Exif')} || '0000' || '49492A0008000000' || {' || '.join(tags)}", d.size("url", 6 + 38 + 1)), _jpeg_image(d), "'FFD9'"]


def jpeg_oriented_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that stay turned as they are shown."""
    done = binary.clean_and_verify(_files(spark, sf_dir, [_turned]), "jpeg-oriented")
    return done.select("file_id", F.sha2("clean", 256).alias("clean_sha256"), "found_before", "remaining", "passed")


#: Formats whose samples hold the page as their media, and what stands before it.
MEDIA = {"mp3": "FFFB9000", "flac": "", "wav": "", "mp4": "", "psd": "", "tiff": ""}


def media_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sound, film or image itself, of files and of their copies."""
    told = None
    for kind in MEDIA:
        both = binary.media_kept(sample_files(spark, sf_dir, kind), kind).withColumn("format", F.lit(kind))
        told = both if told is None else told.union(both)
    return told


def _profiled(d: Digits) -> list[str]:
    return ["'FFD8'", _segment(d, "FFE2", f"{d.text('ICC_PROFILE')} || '000101' || {d.of('url')}", d.size("url", 14)), _jpeg_image(d), "'FFD9'"]


def _named_profile(d: Digits) -> list[str]:
    return [PNG_START, _chunk(d, "iCCP", f"{d.text('Wide')} || '0000' || {d.of('url')}", d.size("url", 6)), _chunk(d, "tRNS", "'00'", 1), _png_image(d), PNG_END]


def _embedded_profile(d: Digits) -> list[str]:
    """A bitmap with a profile behind its one pixel."""
    return [d.text("BM"), d.little(0), "'00000000'", d.little(138), d.little(124), *_bitmap(d, "DEBM", 128, d.size("url")), "repeat('11', 4)", d.of("url")]


def preserved_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What copies of images keep: size, profile, transparency, chunks of colour."""
    made = {"jpeg": [_profiled, CASES["jpeg"][3].file], "png": [_coloured, _named_profile], "gif": [CASES["gif"][2].file], "tiff": None, "webp": None, "wav": None, "psd": None, "bmp": [_embedded_profile, SAMPLES["bmp"].file]}
    told = None
    for kind, makers in made.items():
        files = _files(spark, sf_dir, makers) if makers else sample_files(spark, sf_dir, kind)
        rows = binary.preserved(files, kind).withColumn("colours", F.array_join("colours", ",")).withColumn("format", F.lit(kind))
        told = rows if told is None else told.union(rows)
    return told


def _unnamed(d: Digits) -> list[str]:
    """Texts with and without a keyword, a time, and a chunk of another kind."""
    texts = [_chunk(d, "tEXt", f"'00' || {d.of('url')}", d.size("url", 1)), _chunk(d, "zTXt", f"{d.text('Author')} || '0000'", 8), _chunk(d, "iTXt", f"{d.text('Note')} || '0000000000'", 9)]
    return [PNG_START, *texts, _chunk(d, "tIME", "'07E80102030405'", 7), _chunk(d, "sTER", "'00'", 1), _chunk(d, "gAMA", d.big(45455), 4), _png_image(d), PNG_END]


def finding_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of each finding: of photographs with tags and places, of images with texts, of extended headers."""
    made = {"jpeg": _files(spark, sf_dir, [SAMPLES["jpeg"].file, _located]), "png": _files(spark, sf_dir, [_unnamed]), "webp": sample_files(spark, sf_dir, "webp")}
    told = None
    for kind, files in made.items():
        rows = findings.explode(binary.scan(files, kind)).select("file_id", "pos", "field", findings.description(F.col("field"), F.col("severity")).alias("description"))
        told = rows if told is None else told.union(rows)
    return told


def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one id each: every row has its own copy."""
    files = _files(spark, sf_dir, [_coloured, CASES["png"][3].file]).withColumn("file_id", F.floor(F.col("file_id") / 2).cast("bigint"))
    return binary.clean_and_verify(files, "png").select("file_id", F.sha2("clean", 256).alias("clean_sha256"), "found_before", "passed")


def _case_sql(kind: str) -> str:
    def column(value: Callable[[Case], str]) -> str:
        return f"CASE page_id % {len(CASES[kind])} " + " ".join(f"WHEN {k} THEN {value(c)}" for k, c in enumerate(CASES[kind])) + " END"

    number = lambda n: "CAST(NULL AS BIGINT)" if n is None else f"CAST({n} AS BIGINT)"
    return f"""SELECT page_id AS file_id, {column(lambda c: "'ok'" if c.remaining is not None else "'error'")} AS status, {column(lambda c: f"'{c.reason}'" if c.reason else "CAST(NULL AS VARCHAR)")} AS reason,
        {column(lambda c: number(c.found))} AS found_before, {column(lambda c: number(c.remaining))} AS remaining, {column(lambda c: str(c.passed).lower())} AS passed FROM pages"""


_SHORT = r"regexp_replace(printf('%.4f', floor(({}) * 10000 + 0.5) / 10000), '\.?0+$', '')"
_LATITUDE = _SHORT.format("(CASE WHEN page_id % 2 = 0 THEN 1 ELSE -1 END) * (page_id % 90 + 30 / 60 + page_id % 60 / 3600)")
#: category, field after EXIF:, value (SQL), severity
PLACE = (
    ("containers", "GPS IFD pointer", "'26'", "high"), ("geolocation", "GPS latitude ref", "CASE WHEN page_id % 2 = 0 THEN 'N' ELSE 'S' END", "high"), ("geolocation", "GPS latitude", "'[3 values]'", "high"),
    ("geolocation", "GPS longitude ref", "'W'", "high"), ("geolocation", "GPS longitude", "'[3 values]'", "high"), ("geolocation", "GPS altitude ref", "'[1 bytes]'", "high"),
    ("geolocation", "GPS altitude", "page_id % 1000 || '.5'", "high"), ("geolocation", "GPS tag 0x1f", "'7'", "medium"),
    ("geolocation", "GPS coordinates", f"{_LATITUDE} || ', -10.25'", "high"), ("geolocation", "GPS altitude", "page_id % 1000 || '.5 m'", "high"),
)
COLOURS = (("other", "PNG:gAMA", "Gamma", "'0.5'", "low"), ("other", "PNG:cHRM", "Chromaticity (cHRM)", "'Present'", "low"))


def _findings_sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({k} AS INTEGER) AS pos, '{c}' AS category, '{f}' AS field, '{n}' AS label, {v} AS value, '{s}' AS severity FROM pages" for k, (c, f, n, v, s) in enumerate(rows)
    )


_HIGH, _MEDIUM = "Может раскрыть конфиденциальную информацию.", "Может связать файл с источником или устройством."
#: which pages (SQL), field, description
DESCRIBED = (
    *(("page_id % 2 = 0", k, field, text) for k, (field, text) in enumerate((("EXIF:Artist", _HIGH), ("JPEG:Comment", "")))),
    *(("page_id % 2 = 1", k, f"EXIF:{n}", _HIGH if s == "high" else _MEDIUM) for k, (_, n, _, s) in enumerate(PLACE)),
    ("true", 0, "PNG:tEXt:", "Текстовые метаданные PNG (без названия)."), ("true", 1, "PNG:zTXt:Author", "Сжатые текстовые метаданные PNG (Author)."),
    ("true", 2, "PNG:iTXt:Note", "Международные текстовые метаданные PNG (Note)."), ("true", 3, "PNG:tIME", "Временная метка последнего изменения PNG-файла."),
    ("true", 4, "PNG:sTER", "Служебный блок метаданных PNG. Может содержать дополнительную информацию о файле."),
    ("true", 5, "PNG:gAMA", "Технические данные гамма-коррекции. Сохраняются при очистке."),
    ("true", 0, "WebP:EXIF", "EXIF-метаданные в WebP. Могут содержать GPS, данные камеры, автора, дату съёмки."),
    ("true", 1, "WebP:XMP", "Расширяемая платформа метаданных Adobe. Может содержать автора, описание, историю."),
    ("true", 2, "WebP:XMP:Creator", "Имя автора изображения из XMP-метаданных."), ("true", 3, "WebP:ICCP", "Технические данные цветопередачи. Сохраняются при очистке."),
)


QUERIES = {f.__name__: f for f in (*map(_verified, CASES), _told("jpeg", "jpeg_places", _located), _told("png", "png_colours", _coloured), repeated_ids, jpeg_oriented_copies, media_kept, preserved_info, finding_descriptions)}
ORACLE = {f"{kind}_odd_files": _case_sql(kind) for kind in CASES} | {
    "jpeg_places": _findings_sql([(c, f"EXIF:{n}", n, v, s) for c, n, v, s in PLACE]),
    "png_colours": _findings_sql(list(COLOURS)),
    "jpeg_oriented_copies": f"""SELECT page_id AS file_id, sha256(unhex('FFD8' || CASE WHEN page_id % 10 BETWEEN 2 AND 8 THEN '{binary.ORIENTATION[0]}0' || page_id % 10 || '{binary.ORIENTATION[1]}' ELSE '' END || {_jpeg_image(DUCK)} || 'FFD9')) AS clean_sha256,
        CAST(1 AS BIGINT) AS found_before, CAST(0 AS BIGINT) AS remaining, true AS passed FROM pages""",
    "preserved_info": " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({w} AS BIGINT) AS width, CAST({h} AS BIGINT) AS height, {p} IS NOT NULL AS has_profile, {p} AS profile, {t} AS transparent, {c} AS colours, '{kind}' AS format FROM pages"
        for kind, w, h, p, t, c in (
            ("jpeg", "CASE WHEN page_id % 2 = 0 THEN 1 ELSE 8000 END", "CASE WHEN page_id % 2 = 0 THEN 1 ELSE 5000 END", "CASE WHEN page_id % 2 = 0 THEN 'ICC profile' END", "false", "CASE WHEN page_id % 2 = 0 THEN 'ICC Profile (APP2)' ELSE '' END"),
            ("png", "1", "2", "CASE WHEN page_id % 2 = 1 THEN 'Wide' END", "page_id % 2 = 1", "CASE WHEN page_id % 2 = 0 THEN 'gAMA,cHRM' ELSE 'iCCP' END"),
            ("gif", "page_id % 5000 + 1", "3", "CAST(NULL AS VARCHAR)", "false", "''"), ("tiff", "1", "1", "CAST(NULL AS VARCHAR)", "false", "''"),
            ("webp", "100", "200", "'ICC profile (WebP)'", "false", "'ICCP'"), ("wav", "NULL", "NULL", "CAST(NULL AS VARCHAR)", "false", "''"),
            ("psd", "2", "1", "'ICC profile'", "false", "'ICC profile'"), ("bmp", "1", "1", "CASE WHEN page_id % 2 = 0 THEN 'ICC profile' END", "false", "CASE WHEN page_id % 2 = 0 THEN 'ICC profile' ELSE '' END"),
        )
    ),
    "finding_descriptions": " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({k} AS INTEGER) AS pos, '{field}' AS field, '{text}' AS description FROM pages WHERE {pages}" for pages, k, field, text in DESCRIBED
    ),
    "media_kept": " UNION ALL ".join(
        f"SELECT page_id AS file_id, sha256(unhex('{before}' || {DUCK.of('html')})) AS media_sha256, {copy} AS copy, '{kind}' AS format FROM pages" for kind, before in MEDIA.items() for copy in ("false", "true")
    ),
    "repeated_ids": f"""SELECT CAST(floor(page_id / 2) AS BIGINT) AS file_id, sha256(unhex(CASE page_id % 2 WHEN 0 THEN {" || ".join(_coloured(DUCK))} ELSE {" || ".join([PNG_START, _png_image(DUCK), PNG_END])} END)) AS clean_sha256,
        CAST(page_id % 2 AS BIGINT) AS found_before, true AS passed FROM pages""",
}
