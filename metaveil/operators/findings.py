"""Questions asked of the long table of findings (file_id, pos, category, field, label, value, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions.formats import first_match

#: Colour information that is no personal trace.
TECHNICAL = ("PNG:iCCP", "PNG:sRGB", "PNG:gAMA", "PNG:cHRM", "WebP:ICCP")
#: Words in a category, in order, and the label or bucket they lead to.
LABELS = (
    ("geolocation", "gps"), ("author", "author"), ("dates", "dates"), ("software", "app"), ("app", "app"), ("device", "device"), ("title", "title"),
    ("identifier", "identifier"), ("custom", "custom"), ("thumbnail", "thumbnail"), ("container", "containers"), ("xmp", "containers"),
)
#: What a finding is said to mean, by its severity, by its field, and by the field before a keyword (%s), or no keyword.
SEVERITIES = {
    "high": "Может раскрыть конфиденциальную информацию.",
    "medium": "Может связать файл с источником или устройством.",
    "low": "Техническая информация, маловероятно раскрытие личных данных.",
}
DESCRIPTIONS = {
    "PNG:iCCP": "Технические данные для точной цветопередачи. Сохраняются при очистке.",
    "PNG:sRGB": "Технические данные цветопередачи sRGB. Сохраняются при очистке.",
    "PNG:gAMA": "Технические данные гамма-коррекции. Сохраняются при очистке.",
    "PNG:cHRM": "Технические данные цветности. Сохраняются при очистке.",
    "PNG:eXIf": "EXIF-метаданные, встроенные в PNG. Могут содержать GPS, данные камеры, автора.",
    "PNG:tIME": "Временная метка последнего изменения PNG-файла.",
    "WebP:EXIF": "EXIF-метаданные в WebP. Могут содержать GPS, данные камеры, автора, дату съёмки.",
    "WebP:XMP": "Расширяемая платформа метаданных Adobe. Может содержать автора, описание, историю.",
    "WebP:XMP:Creator": "Имя автора изображения из XMP-метаданных.",
    "WebP:ICCP": "Технические данные цветопередачи. Сохраняются при очистке.",
}
OTHER_CHUNK = "Служебный блок метаданных PNG. Может содержать дополнительную информацию о файле."
KEYWORDS = {
    "PNG:tEXt:": "Текстовые метаданные PNG (%s).",
    "PNG:zTXt:": "Сжатые текстовые метаданные PNG (%s).",
    "PNG:iTXt:": "Международные текстовые метаданные PNG (%s).",
}
NO_KEYWORD = "без названия"
BUCKETS = (
    ("author", "author"), ("dates", "dates"), ("software", "app"), ("app", "app"), ("geolocation", "gps"), ("device", "device"),
    ("container", "containers"), ("xmp", "containers"),
)


def explode(scanned: DataFrame) -> DataFrame:
    return scanned.select("file_id", F.posexplode("findings").alias("pos", "f")).select("file_id", "pos", "f.*")


def personal(findings: DataFrame) -> DataFrame:
    return findings.where(~F.col("field").isin(*TECHNICAL))


def meaningful(value: Column) -> Column:
    v = F.trim(value)
    return F.coalesce((v != "") & ~F.startswith(v, F.lit("[")) & ~v.isin("Present", "Присутствует"), F.lit(False))


def rank(severity: Column) -> Column:
    return F.when(severity == "high", 2).when(severity == "medium", 1).otherwise(0)


def description(field: Column, severity: Column) -> Column:
    """What a finding means, in words: tags of photographs by their severity, those of other images by their field; empty for other formats."""
    keyed = F.lit(None).cast("string")
    for before, text in KEYWORDS.items():
        keyword = F.substring(field, F.lit(len(before) + 1), F.length(field))
        keyed = F.when(F.startswith(field, F.lit(before)), F.format_string(text, F.when(keyword == "", NO_KEYWORD).otherwise(keyword))).otherwise(keyed)
    told = F.when(F.startswith(field, F.lit("EXIF:")), first_match({text: severity == name for name, text in SEVERITIES.items()}))
    by_field = F.lit(None).cast("string")
    for name, text in DESCRIPTIONS.items():
        by_field = F.when(field == name, text).otherwise(by_field)
    return F.coalesce(told, by_field, keyed, F.when(F.startswith(field, F.lit("PNG:")), OTHER_CHUNK), F.lit(""))


def _first(category: Column, rules: tuple, otherwise: Column) -> Column:
    for word, label in reversed(rules):
        otherwise = F.when(F.contains(category, F.lit(word)), F.lit(label)).otherwise(otherwise)
    return otherwise


def label(category: Column, field: Column) -> Column:
    rest = F.when(F.contains(F.lower(field), F.lit("comment")), "comment").otherwise("other")
    return _first(category, LABELS, rest)


def personal_count(findings: DataFrame) -> DataFrame:
    """file_id, traces, worst (severity)."""
    worst = F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.max(rank(F.col("severity"))) + 1)
    return personal(findings).groupBy("file_id").agg(F.count("*").alias("traces"), worst.alias("worst"))


def concrete(findings: DataFrame) -> DataFrame:
    """file_id, label, severity, found: distinct values of each label in the order of their finding, and the label's place."""
    shown = F.when(meaningful(F.col("value")), F.col("value")).otherwise(F.col("label"))
    cut = F.when(F.length(shown) > 180, F.concat(F.substring(shown, 1, 180), F.lit("…"))).otherwise(shown)
    rows = personal(findings).where("field <> 'EXIF:Orientation'").select("file_id", "pos", label(F.col("category"), F.col("field")).alias("group"), cut.alias("shown"), rank(F.col("severity")).alias("rank"))
    grouped = rows.groupBy("file_id", "group").agg(F.max("rank").alias("rank"), F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("all"))
    return grouped.select("file_id", F.col("group").alias("label"), F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.col("rank") + 1).alias("severity"), F.array_join(F.array_distinct(F.col("all.shown")), " | ").alias("found"), "first")


def categories(findings: DataFrame, most: int = 5) -> DataFrame:
    """file_id, categories: the first few buckets, in the order of their finding."""
    rows = personal(findings).withColumn("bucket", _first(F.col("category"), BUCKETS, F.lit(None))).where("bucket IS NOT NULL")
    firsts = rows.groupBy("file_id", "bucket").agg(F.min("pos").alias("pos")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bucket"))).alias("b"))
    return firsts.select("file_id", F.array_join(F.slice(F.col("b.bucket"), 1, most), ",").alias("categories"))


def leaks(values: DataFrame, copies: DataFrame, least: int = 4) -> DataFrame:
    """file_id, leaked: how many distinct values of at least that many characters still stand in the file's copy (file_id, clean)."""
    long_enough = values.where(F.length("value") >= least).select("file_id", "value").distinct()
    return long_enough.join(copies, "file_id").where(F.contains("clean", F.col("value"))).groupBy("file_id").agg(F.count("*").alias("leaked"))
