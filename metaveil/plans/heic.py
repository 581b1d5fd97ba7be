"""Queries over photographs that are put together from pages, one kind for each gate, and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import findings, heic
from metaveil.plans.binary import SPARK, Digits, _box


def _photo(d: Digits, *, brand: str = "mif1", primary: bool = True, size: tuple[int, int] | None = (400, 300), more: tuple[tuple[str, str, int], ...] = (), metadata: bool = True) -> str:
    """more: name, digits and bytes of further boxes within the properties."""
    props = [(f"{d.text('ispe')} || '00000000' || {d.big(size[0])} || {d.big(size[1])}", 20)] if size else []
    boxes = [f"{d.big(n)} || {body}" for body, n in props] + [_box(d, name, digits, n) for name, digits, n in more]
    total = sum(n for _, n in props) + sum(8 + n for *_, n in more)
    inner = _box(d, "ipco", " || ".join(boxes) or "''", total)
    meta = [_box(d, "pitm", "'000000000001'", 6)] if primary else []
    meta += [_box(d, "iprp", inner, 8 + total)]
    start = _box(d, "ftyp", f"{d.text('heic')} || '00000000' || {d.text(brand)}", 12)
    parts = [start, _box(d, "meta", f"'00000000' || {' || '.join(meta)}", 4 + 14 * primary + 16 + total)]
    if metadata:  # tags with an orientation of six, and XMP
        parts += [_box(d, "Exif", "'000000004D4D002A00000008' || '0001' || '0112000300000001' || '00060000' || '00000000'", 30), _box(d, "xml ", d.of("url"), d.size("url"))]
    return " || ".join([*parts, _box(d, "mdat", d.of("html"), d.size("html"))])


#: Digits of a file and the reason that refuses it, by page_id modulo their number.
CASES = (
    (lambda d: _photo(d), None), (lambda d: _photo(d, more=(("irot", "'03'", 1), ("colr", d.text("nclx"), 4), ("pixi", "'00'", 1)), metadata=False), None), (lambda d: d.of("html"), "malformed"),
    (lambda d: _photo(d, brand="msf1"), "animation"), (lambda d: _photo(d, primary=False), "no-primary-image"), (lambda d: _photo(d, more=(("dimg", "'00'", 1), ("auxC", "'00'", 1))), "depth-map"),
    (lambda d: _photo(d, more=(("auxC", "'00'", 1),)), "auxiliary-image"), (lambda d: _photo(d, more=(("infe", "'00'", 1), ("infe", "'00'", 1))), "too-many-images"), (lambda d: _photo(d, size=None), "malformed"),
    (lambda d: _photo(d, size=(8000, 5001)), "resource-limit"),
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = " ".join(f"WHEN {k} THEN {make(SPARK)}" for k, (make, _) in enumerate(CASES))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("file_id"), F.unhex(F.expr(f"CASE page_id % {len(CASES)} {digits} END")).alias("content"))


def heic_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heic.preflight(_files(spark, sf_dir))
    open_ = F.col("reason").isNull()
    return rows.select("file_id", "reason", *[F.when(open_, F.col(c)).alias(c) for c in ("width", "height", "alpha", "orientation", "output")], F.when(open_, F.array_join("containers", ", ")).alias("containers"))


def heic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.explode(heic.scan(_files(spark, sf_dir))).select("file_id", "pos", "category", "field", "label", "value", "severity")


QUERIES = {f.__name__: f for f in (heic_gates, heic_findings)}

_REASON = "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, reason) in enumerate(CASES) if reason) + " END"
_ROWS = (
    (0, 0, "containers", "HEIC:MetadataContainer", "HEIC metadata container", "EXIF, XML/XMP metadata", "high"), (0, 1, "other", "HEIC:Orientation", "Image orientation", "Value 6", "medium"),
    (1, 0, "containers", "HEIC:MetadataContainer", "HEIC metadata container", "NCLX colour profile", "high"), (1, 1, "other", "HEIC:Orientation", "Image orientation", "Value 8", "medium"),
    (1, 2, "other", "HEIC:ColourProfile", "HEIC colour profile", "Present", "low"),
)
ORACLE = {
    "heic_gates": f"""SELECT page_id AS file_id, {_REASON} AS reason, CASE WHEN page_id % 10 < 2 THEN CAST(400 AS BIGINT) END AS width, CASE WHEN page_id % 10 < 2 THEN CAST(300 AS BIGINT) END AS height,
        CASE page_id % 10 WHEN 0 THEN false WHEN 1 THEN true END AS alpha, CAST(CASE page_id % 10 WHEN 0 THEN 6 WHEN 1 THEN 8 END AS INTEGER) AS orientation, CASE page_id % 10 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' END AS output,
        CASE page_id % 10 WHEN 0 THEN 'EXIF, XML/XMP metadata' WHEN 1 THEN 'NCLX colour profile' END AS containers FROM pages""",
    "heic_findings": " UNION ALL ".join(
        f"SELECT page_id AS file_id, CAST({pos} AS INTEGER) AS pos, '{c}' AS category, '{f}' AS field, '{n}' AS label, '{v}' AS value, '{s}' AS severity FROM pages WHERE page_id % 10 = {k}" for k, pos, c, f, n, v, s in _ROWS
    ),
}
