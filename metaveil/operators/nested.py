"""Archives within archives: all levels told, refused, cleaned from the inside out, and verified.

A level is a table of entries, each with its format. Images, sound, films, texts and mail are scanned and cleaned where they
stand, in one plan for all that occur; documents go through operators of their own; archives become the files of the next level,
under the key of their entry, up to LEVELS. What comes back (findings, values, copy, refusal) is joined to the entries of the
level above and put into its copy. Entries without a format are kept as they are.

A copy passes if it is read anew and its entries have the names and order of the original and the bytes that were put in, if
every entry with a format passes by itself, if the container tells nothing, and if none of the values found on any level stands
in any entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.operators import archive, contents, documents, leaks, pdf
from metaveil.operators.packages import container_findings, neutral
from metaveil.sources.archives import entries, rebuilt
from metaveil.sources.tables import written

#: Levels of archives: one within another.
LEVELS = 2
OUTCOME = ("file_id", "reason", "content", "found", "raw", "passed")


def _kind(path: Column, content: Column) -> Column:
    return contents.nested_format(path, content)


def _inner(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("format") == kind).select(F.col("key").alias("file_id"), "content")


#: Entries that are files of objects or parts: they go through operators of their own.
WITHIN = {"office": lambda files: documents.clean_and_verify(files, "office"), "pdf": pdf.clean_and_verify}


def _documents(rows: DataFrame, kind: str) -> DataFrame:
    done = WITHIN[kind](_inner(rows, kind))
    return done.select("file_id", F.when(F.col("reason").isNotNull(), "nested-clean-failed").alias("reason"), "content", F.col("found_before").alias("found"), "raw", "passed")


def _with_outcomes(rows: DataFrame, level: int) -> DataFrame:
    """rows of a level with clean, found, raw, passed and blocked (why the archive is refused because of that entry)."""
    rows = rows.withColumn("key", F.concat_ws("/", F.col("file_id").cast("string"), F.col("entry_pos").cast("string")))
    present = {r[0] for r in rows.select("format").distinct().collect()}
    done = contents.opened(rows.where(~F.coalesce(F.col("format").isin("zip", *WITHIN), F.lit(False))))
    broken = F.col("format").isNotNull() & F.col("clean").isNull()
    done = done.withColumn("inner_reason", F.when(broken | ~F.col("passed"), F.when(broken, "nested-clean-failed").otherwise("verification-failed")))
    inner = [_documents(rows, kind) for kind in WITHIN if kind in present]
    if "zip" in present and level + 1 < LEVELS:
        inner.append(clean_and_verify(_inner(rows, "zip"), level + 1).select(*OUTCOME))
    if "zip" in present and level + 1 >= LEVELS:
        deep = rows.where(F.col("format") == "zip").select(F.col("key").alias("file_id"), F.lit("too-deep").alias("reason"))
        inner.append(deep.select("*", F.lit(None).cast("binary").alias("content"), F.lit(0).cast("bigint").alias("found"), F.array().cast("array<string>").alias("raw"), F.lit(False).alias("passed")))
    for outcome in inner:
        told = outcome.select(F.col("file_id").alias("key"), F.col("content").alias("clean"), "found", "raw", "passed", F.col("reason").alias("inner_reason"))
        of_kind = rows.join(told, "key")
        failed = F.coalesce("inner_reason", F.when(F.col("clean").isNull() | ~F.col("passed"), "verification-failed"))
        done = done.unionByName(of_kind.withColumn("inner_reason", failed))
    large = F.col("format").isNotNull() & (F.col("size") > formats.size_limit(F.when(F.col("format") == "office", "docx").otherwise(F.col("format"))))
    blocked = F.when(F.col("status") == "encrypted", "encrypted").when(large & (F.col("format") != "zip"), "entry-too-large").otherwise(F.col("inner_reason"))
    return done.withColumn("blocked", blocked).drop("inner_reason")


def _refused(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_id, reason: what the archive itself is refused for, then its first entry that refuses it (null: nothing). An archive without entries is refused as empty."""
    split = files.groupBy("file_id").agg(F.max(F.when(formats.starts(F.col("content"), "504B0708"), "multi-volume")).alias("split"))
    gate = archive.gates(rows.where("status <> 'malformed'")).withColumnRenamed("reason", "gate")
    first = rows.groupBy("file_id").agg(
        F.bool_or(F.col("status") == "malformed").alias("bad"), F.min_by("blocked", F.when(F.col("blocked").isNotNull(), F.col("entry_pos"))).alias("entry"),
        (F.count("entry_pos") > F.count_distinct("entry_pos")).alias("several"),
    )
    joined = split.join(first, "file_id", "left").join(gate, "file_id", "left")
    return joined.select("file_id", F.coalesce("split", F.when(F.col("bad").isNull(), "empty"), F.when(F.col("bad"), "malformed"), F.when(F.col("several"), "repeated-id"), "gate", "entry").alias("reason"))


def clean_and_verify(files: DataFrame, level: int = 0) -> DataFrame:
    """One row for each file (file_id, content): format counts, findings, copy and verdict.

    file_id, reason, content (the copy, or null), found (findings of the container, nested ones as one), traces (in entries),
    raw (all their values), supported, unsupported, nested (archives), leaked, passed. Both the levels' entries and their copies
    are written, so nothing is unpacked twice; what is read of copies goes on to be compared.
    """
    rows = contents.told(files.select("file_id", "content"), _kind(F.col("path"), F.col("content")), f"level{level}")
    rows = written(_with_outcomes(rows, level), f"level{level}")
    reasons = _refused(files, rows)
    file = F.col("entry_pos").isNotNull() & ~F.coalesce("is_folder", F.lit(False))
    traces = rows.groupBy("file_id").agg(
        F.sum("found").alias("traces"), F.array_distinct(F.flatten(F.collect_list("raw"))).alias("raw"), F.count_if(file & F.col("format").isNotNull()).alias("supported"),
        F.count_if(file & F.col("format").isNull()).alias("unsupported"), F.count_if(F.col("format") == "zip").alias("nested"),
    )
    of_container = container_findings(rows, traces.select("file_id", "traces")).groupBy("file_id").agg(F.count("*").alias("found"))
    told = reasons.join(traces, "file_id", "left").join(of_container, "file_id", "left").na.fill(0, ["found", "traces", "supported", "unsupported", "nested"])
    none = F.array().cast("array<string>")
    told = written(told.withColumn("raw", F.coalesce(F.filter("raw", lambda v: F.length(v) >= 3), none)), "told")

    allowed = told.where("reason IS NULL").select("file_id", F.col("raw").alias("before"))
    filling = rows.join(allowed, "file_id").withColumn("content", F.coalesce("clean", "content")).withColumn("stored", F.lit(False))
    copies = written(rebuilt(filling, ("before",)), "copies")
    read = entries(copies.where("content IS NOT NULL").select("file_id", "content", F.col("before").alias("raw")))
    checked = _compared(rows.join(allowed.select("file_id"), "file_id"), leaks.search(read).where("status <> 'malformed'"))
    result = told.join(copies.select("file_id", "content"), "file_id", "left").join(checked, "file_id", "left")
    return result.withColumn("passed", F.coalesce("passed", F.lit(False))).select(
        "file_id", "reason", "content", "found", "traces", "raw", "supported", "unsupported", "nested", "leaked", "passed"
    )


def _compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, leaked, passed: entry by entry, what was to be put in and what is read back."""
    digest = lambda c: F.sha2(F.coalesce(c, F.lit(b"")), 256)
    a = before.select("file_id", "entry_pos", F.col("path").alias("name"), digest(F.coalesce("clean", "content")).alias("put"), F.col("passed").alias("sound"))
    tells = ~neutral(F.col("at")) | (F.col("comment") != "") | (F.col("extra_fields") > 0) | F.col("attributes") | (F.col("status") != "ok")
    b = after.select("file_id", "entry_pos", "path", digest(F.col("content")).alias("read"), F.coalesce(tells, F.lit(True)).alias("tells"), "leaks")
    same = (F.col("name") == F.col("path")) & (F.col("put") == F.col("read")) & F.col("sound") & ~F.col("tells") & (F.size("leaks") == 0)
    joined = a.join(b, ["file_id", "entry_pos"], "full")
    leaked = F.size(F.array_distinct(F.flatten(F.collect_list("leaks")))).cast("bigint")
    return joined.groupBy("file_id").agg(leaked.alias("leaked"), F.bool_and(F.coalesce(same, F.lit(False))).alias("passed"))


def tree(files: DataFrame) -> DataFrame:
    """file_id, level, path, format of all entries, with those of archives within; null formats are kept as they are."""
    found, level_files = None, files.select("file_id", "content").withColumn("root", F.col("file_id")).withColumn("within", F.lit(""))
    for level in range(LEVELS):
        rows = contents.told(level_files, _kind(F.col("path"), F.col("content")), f"tree{level}").where("status <> 'malformed' AND NOT is_folder")
        told = rows.select(F.col("root").alias("file_id"), F.lit(level).alias("level"), F.concat("within", "path").alias("path"), "format")
        found = told if found is None else found.union(told)
        key = F.concat_ws("/", F.col("file_id").cast("string"), F.col("entry_pos").cast("string")).alias("file_id")
        level_files = rows.where("format = 'zip'").select(key, "content", "root", F.concat("within", "path", F.lit("!")).alias("within"))
    return found
