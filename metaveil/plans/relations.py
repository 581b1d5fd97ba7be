"""Queries over the shared joins, sets and windows, with the star-schema tables in the part of pieces, images and messages, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.functions import formats
from metaveil.operators import findings, relations, reports


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pieces of files, one for each line number."""
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("int").alias("idx"))
    return lines.agg(F.min("l_returnflag").alias("kind"), F.min(F.col("l_quantity").cast("bigint")).alias("size"))


def piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.offsets(_pieces(spark, sf_dir), 8)


def pieces_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("A",), ("N",)], "kind string")
    return relations.offsets(relations.kept(_pieces(spark, sf_dir), kinds)).select("file_id", "idx", "begins")


def pieces_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([("A",), ("N",)], "kind string")
    return relations.removed(_pieces(spark, sf_dir), kinds).groupBy("file_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def piece_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _pieces(spark, sf_dir).withColumn("bytes", F.concat("kind", F.col("idx").cast("string")).cast("binary"))
    return relations.joined_bytes(pieces).select("file_id", F.sha2("content", 256).alias("sha256"))


def first_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.first_match(_pieces(spark, sf_dir), F.col("kind") == "R", "size", "idx")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("int").alias("pos"))
    return lines.agg((F.min(F.col("l_quantity").cast("bigint")) * 200).alias("width"), ((F.min("l_partkey") % 60) * 100).cast("bigint").alias("height"))


def largest_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.largest(_images(spark, sf_dir))


def pixel_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.too_large(_images(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def shown_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir).withColumn("orientation", F.col("file_id") % 9)
    return images.select("file_id", "pos", relations.oriented(F.col("width"), F.col("height"), F.col("orientation")).alias("d"), (~F.col("orientation").isin(0, 1)).alias("turned")).select("file_id", "pos", "d.*", "turned")


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    direction = F.element_at(F.array(*map(F.lit, ("N", "S", "E", "W", ""))), (F.col("l_partkey") % 5 + 1).cast("int"))
    degrees, minutes, seconds = (F.col(c) % m for c, m in (("l_partkey", 180), ("l_suppkey", 60), ("l_orderkey", 60)))
    return lines.select("l_orderkey", "l_linenumber", relations.decimal_degrees(direction, degrees, minutes, seconds).alias("decimal"))


def some_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.some_of(_pieces(spark, sf_dir), F.col("kind") == "R")


def names_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pieces(spark, sf_dir).select("file_id", F.col("idx").alias("pos"), F.when(F.col("kind") == "N", "Anonymous").otherwise(F.concat("kind", (F.col("size") % 3).cast("string"))).alias("name"))
    return relations.distinct_in_order(rows, "name")


def unknown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.split(F.lower("c_mktsegment"), "")
    known = F.array(*map(F.lit, "aeiou"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.filter(relations.unknown(seen, known), lambda x: x != ""), "").alias("unknown"))


def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("width"), F.col("l_discount").cast("double").alias("height"))))
    pages = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(boxes.alias("a"))
    moved = F.transform("a", lambda p: F.struct((p["width"] + F.when(p["l_linenumber"] == 5, 0.6).otherwise(0.4)).alias("width"), p["height"].alias("height")))
    return pages.select("l_orderkey", relations.same_geometry(F.transform("a", lambda p: F.struct(p["width"].alias("width"), p["height"].alias("height"))), moved).alias("same"))


def engine_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _pieces(spark, sf_dir).select("file_id", F.col("idx").alias("pos"), F.when(F.col("size") == 7, " ").otherwise(F.col("kind")).alias("code"))
    texts = spark.createDataFrame([("A", "accepted"), ("N", "none")], "code string, message string")
    return relations.messages(codes, texts)


def localised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string").alias("key")
    texts = nations.select(F.lit("en").alias("locale"), key, F.col("n_name").alias("value"))
    texts = texts.union(nations.where("n_nationkey % 2 = 0").select(F.lit("uk"), key, F.concat(F.lit("uk-"), "n_name"))).union(nations.where("n_nationkey % 3 = 0").select(F.lit("de"), key, F.concat(F.lit("de-"), "n_name")))
    return relations.localised(nations.select(key), texts, "de")


def risks_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("custom-xml"))
    new = F.when(F.col("l_quantity") > 25, F.array(F.lit("F"), F.lit("leak"))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(relations.resolved(risks, "custom-xml", new), ",").alias("risks"))


def last_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return relations.last_operation(orders.select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("response")))


def outermost_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that are nested like the digits of a number: 10 to 20 holds 12 to 13."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_partkey") % 100).alias("at"), (F.col("l_quantity") % 2 == 0).alias("wide")).distinct()
    start = F.when(F.col("wide"), F.floor(F.col("at") / 10) * 10).otherwise(F.col("at")).cast("bigint")
    return relations.outermost(lines.select("file_id", start.alias("start"), (start + F.when(F.col("wide"), 10).otherwise(1)).cast("bigint").alias("stop")).distinct())


def checks_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.all_hold(_pieces(spark, sf_dir).select("file_id", F.col("idx").alias("name"), (F.col("size") < 40).alias("holds")))


def entry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.entry_states(_pieces(spark, sf_dir).select("file_id", (F.col("kind") != "N").alias("supported"), (F.col("size") % 2 == 0).alias("passed")))


def values_to_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.split(F.coalesce("text", F.lit("")), " ").alias("values"))
    return relations.flat_values(rows).groupBy("file_id").agg(F.count("*").alias("n"))


def leaked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of addresses that still stand in the page."""
    pages = _table(spark, sf_dir, "pages")
    values = relations.flat_values(pages.select(F.col("page_id").alias("file_id"), F.split("url", "[/.:]+").alias("values")))
    return findings.leaks(values, pages.select(F.col("page_id").alias("file_id"), F.col("html").alias("clean")))


def known_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.registry(spark).select("id", "priority", "max_bytes", F.array_join("extensions", " ").alias("extensions"))


def formats_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages named by their number and an extension, looked up among the accepted ones."""
    names = _table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, ("jpg", "JPEG", "m4a", "txt", "tif"))), (F.col("page_id") % 5 + 1).cast("int")).alias("extension"))
    names = names.withColumn("extension", F.lower("extension"))
    return relations.looked_up(names, formats.accepted_extensions(spark), "extension").select("page_id", "extension", F.col("id").alias("format"))


def report_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("jpeg", "png", "zip", "heic", "pdf", "docx", "eml", "gif")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % len(kinds) + 1).cast("int"))
    n = F.length("html").cast("bigint") * F.pow(F.lit(10), F.col("page_id") % 4).cast("bigint") - 900 * (F.col("page_id") % 2)
    left_out = F.col("page_id") % 3
    template = reports.interpolated(F.lit("{n} traces in {file}, {other}"), {"n": F.col("page_id"), "file": F.col("url")})
    return _table(spark, sf_dir, "pages").select(
        "page_id", reports.format_name(kind).alias("name"), reports.file_size(n).alias("size"), reports.plural(F.col("page_id")).alias("word"), reports.risk(kind).alias("risk"),
        reports.support(kind, left_out).alias("support"), F.array_join(reports.limitations(kind, left_out), ",").alias("limitations"), template.alias("title"),
        reports.language_tag(F.when(left_out == 0, "hy").otherwise("de")).alias("tag"), formats.size_limit(kind).cast("bigint").alias("largest"),
    )


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("jpeg", "pdf", "heic", "webp"))), (F.col("page_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"), kind.alias("format"), F.sha2("html", 256).alias("clean_sha256"), (F.col("page_id") % 7).alias("found_before"), (F.col("page_id") % 5).alias("remaining"),
        (F.col("page_id") % 5 == 0).alias("passed"), F.when(F.col("page_id") % 3 > 0, "sRGB").otherwise("").alias("icc_description"),
    )


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.certificates(_verified(spark, sf_dir))


def before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "zip").otherwise("png")
    scans = _table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"), kind.alias("format"), (F.col("page_id") % 7).alias("found"), (F.col("page_id") % 5).alias("files"), (F.col("page_id") % 4).alias("supported"),
        (F.col("page_id") % 3).alias("unsupported"), (F.col("page_id") % 2).alias("remaining"),
    )
    return reports.before_after(scans)


QUERIES = {
    f.__name__: f
    for f in (
        piece_offsets, pieces_kept, pieces_removed, piece_bytes, first_returned, largest_image, pixel_limit, shown_dimensions, coordinates, some_returned, names_in_order, unknown_names,
        page_geometry, engine_messages, localised_names, risks_resolved, last_operation, outermost_spans, checks_hold, entry_states, values_to_search, leaked_values, known_formats,
        formats_by_extension, report_words, certificates, before_and_after,
    )
}
_PIECES = "pieces AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS INTEGER) AS idx, min(l_returnflag) AS kind, min(CAST(floor(l_quantity) AS BIGINT)) AS size FROM lineitem GROUP BY ALL)"
_IMAGES = "images AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS INTEGER) AS pos, min(CAST(floor(l_quantity) AS BIGINT)) * 200 AS width, CAST(min(l_partkey) % 60 * 100 AS BIGINT) AS height FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_FORMATS = ", ".join(f"('{n}', {k}, CAST({m} AS BIGINT) * 1048576, '{e}')" for k, (n, m, e) in enumerate(formats.FORMATS))
_REGISTRY = f"registry AS (SELECT * FROM (VALUES {_FORMATS}) AS r(id, priority, max_bytes, extensions))"
ORACLE = {
    "piece_offsets": f"""WITH {_PIECES}, o AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + 8 AS "begins" FROM pieces)
        SELECT file_id, idx, kind, size, "begins", lead(idx) OVER w IS NULL AS is_last, coalesce(lead("begins") OVER w, 0) AS next_begins FROM o WINDOW w AS (PARTITION BY file_id ORDER BY idx)""",
    "pieces_kept": f"""WITH {_PIECES} SELECT file_id, idx, coalesce(CAST(sum(size) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "begins" FROM pieces WHERE kind IN ('A', 'N')""",
    "pieces_removed": f"WITH {_PIECES} SELECT file_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM pieces WHERE kind NOT IN ('A', 'N') GROUP BY file_id",
    "piece_bytes": f"WITH {_PIECES} SELECT file_id, sha256(string_agg(kind || idx, '' ORDER BY idx)) AS sha256 FROM pieces GROUP BY file_id",
    "first_returned": f"WITH {_PIECES} SELECT file_id, arg_min(size, idx) AS first FROM pieces WHERE kind = 'R' GROUP BY file_id",
    "largest_image": f"WITH {_IMAGES} SELECT file_id, width, height FROM images QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY width * height DESC, pos) = 1",
    "pixel_limit": f"WITH {_IMAGES} SELECT CASE WHEN width * height <= 0 THEN 'malformed' WHEN width * height > 40000000 THEN 'resource-limit' ELSE 'ok' END AS status, count(*) AS n FROM images GROUP BY 1",
    "shown_dimensions": f"WITH {_IMAGES} SELECT file_id, pos, CASE WHEN file_id % 9 >= 5 THEN height ELSE width END AS width, CASE WHEN file_id % 9 >= 5 THEN width ELSE height END AS height, file_id % 9 > 1 AS turned FROM images",
    "coordinates": """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS d, l_partkey % 180 + l_suppkey % 60 / 60 + l_orderkey % 60 / 3600 AS x FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN d < 4 THEN floor(CASE WHEN d IN (1, 3) THEN -x ELSE x END * 10000 + 0.5) / 10000 END AS decimal FROM v""",
    "some_returned": f"WITH {_PIECES} SELECT file_id, count(*) FILTER (kind = 'R') || ' of ' || count(*) AS told FROM pieces GROUP BY file_id HAVING count(*) FILTER (kind = 'R') > 0",
    "names_in_order": f"""WITH {_PIECES}, n AS (SELECT file_id, kind || (size % 3) AS name, min(idx) AS pos FROM pieces WHERE kind <> 'N' GROUP BY ALL) SELECT file_id, string_agg(name, ', ' ORDER BY pos) AS "values" FROM n GROUP BY file_id""",
    "unknown_names": """WITH c AS (SELECT c_custkey, unnest(string_split(lower(c_mktsegment), '')) AS x, generate_subscripts(string_split(lower(c_mktsegment), ''), 1) AS i FROM customer),
        f AS (SELECT c_custkey, x, min(i) AS i FROM c WHERE x NOT IN ('a', 'e', 'i', 'o', 'u', '') GROUP BY ALL) SELECT c_custkey, string_agg(x, '' ORDER BY i) AS unknown FROM f GROUP BY c_custkey""",
    "page_geometry": "SELECT l_orderkey, bool_and(l_linenumber <> 5) AS same FROM lineitem GROUP BY l_orderkey",
    "engine_messages": f"WITH {_PIECES} SELECT file_id, idx AS pos, CASE kind WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' ELSE kind END AS message FROM pieces WHERE size <> 7",
    "localised_names": "SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'de-' WHEN n_nationkey % 2 = 0 THEN 'uk-' ELSE '' END || n_name AS value FROM nation",
    "risks_resolved": "SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN l_linestatus <> l_returnflag THEN ',' || l_linestatus ELSE '' END || CASE WHEN l_quantity > 25 THEN CASE WHEN 'F' IN (l_returnflag, l_linestatus) THEN '' ELSE ',F' END || ',leak' ELSE '' END AS risks FROM lineitem",
    "last_operation": "SELECT o_custkey AS job, arg_max(o_orderstatus, o_orderkey) AS response FROM orders GROUP BY o_custkey",
    "outermost_spans": """WITH s AS (SELECT DISTINCT l_suppkey AS file_id, CAST(CASE WHEN l_quantity % 2 = 0 THEN l_partkey % 100 // 10 * 10 ELSE l_partkey % 100 END AS BIGINT) AS start, l_quantity % 2 = 0 AS wide FROM lineitem)
        SELECT file_id, start, start + CASE WHEN wide THEN 10 ELSE 1 END AS stop FROM s WHERE wide OR NOT EXISTS (SELECT 1 FROM s AS o WHERE o.file_id = s.file_id AND o.wide AND o.start = s.start // 10 * 10)""",
    "checks_hold": f"WITH {_PIECES} SELECT file_id, bool_and(size < 40) AS passed FROM pieces GROUP BY file_id",
    "entry_states": f"WITH {_PIECES} SELECT file_id, count(*) FILTER (kind <> 'N' AND size % 2 = 0) AS verified, count(*) FILTER (kind <> 'N' AND size % 2 = 1) AS failed, count(*) FILTER (kind = 'N') AS unchanged FROM pieces GROUP BY file_id",
    "values_to_search": "SELECT file_id, count(*) AS n FROM (SELECT DISTINCT doc_id AS file_id, v FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS v FROM documents) WHERE length(trim(v)) >= 3) GROUP BY file_id",
    "leaked_values": "WITH v AS (SELECT DISTINCT page_id AS file_id, html, unnest(regexp_split_to_array(url, '[/.:]+')) AS v FROM pages) SELECT file_id, count(*) AS leaked FROM v WHERE length(v) >= 4 AND contains(html, v) GROUP BY file_id",
    "known_formats": f"WITH {_REGISTRY} SELECT * FROM registry",
    "formats_by_extension": f"WITH {_REGISTRY}, x AS (SELECT id, unnest(string_split(extensions, ' ')) AS extension FROM registry), p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'm4a' WHEN 3 THEN 'txt' ELSE 'tif' END AS extension FROM pages) SELECT page_id, extension, id AS format FROM p LEFT JOIN x USING (extension)",
    "report_words": """WITH p AS (SELECT page_id, url, page_id % 3 AS u, ['jpeg', 'png', 'zip', 'heic', 'pdf', 'docx', 'eml', 'gif'][CAST(page_id % 8 + 1 AS INT)] AS k, length(html) * CAST(pow(10, page_id % 4) AS BIGINT) - 900 * (page_id % 2) AS n FROM pages)
        SELECT page_id, CASE k WHEN 'heic' THEN 'HEIC / HEIF' ELSE upper(k) END AS name,
            CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE n || ' B' END AS size,
            CASE WHEN page_id % 10 = 1 AND page_id % 100 <> 11 THEN 'one' WHEN page_id % 10 BETWEEN 2 AND 4 AND page_id % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS word,
            CASE WHEN k IN ('zip', 'heic', 'pdf') THEN k WHEN k IN ('docx', 'eml') THEN 'office' ELSE 'image' END AS risk,
            CASE WHEN k = 'zip' AND u > 0 THEN 'partially-supported' ELSE 'supported' END AS support,
            'base' || CASE WHEN k = 'zip' AND u > 0 THEN ',zip' WHEN k = 'heic' THEN ',heic' WHEN k = 'docx' THEN ',office' ELSE '' END AS limitations,
            page_id || ' traces in ' || url || ', {other}' AS title, CASE WHEN u = 0 THEN 'hy-AM' ELSE 'de' END AS tag, CAST(CASE WHEN k IN ('zip', 'pdf', 'docx', 'eml') THEN 100 ELSE 50 END AS BIGINT) * 1048576 AS largest FROM p""",
    "certificates": """SELECT page_id AS file_id, ['JPEG', 'PDF', 'HEIC / HEIF', 'WebP'][CAST(page_id % 4 + 1 AS INT)] AS file_type, page_id % 7 AS metadata_found, greatest(0, page_id % 7 - page_id % 5) AS metadata_removed, page_id % 5 AS metadata_remaining,
        page_id % 5 = 0 AS verification_passed, CASE WHEN page_id % 4 IN (0, 3) AND page_id % 3 > 0 THEN 'sRGB' END AS colour_profile, sha256(html) AS clean_hash, left(sha256(html), 16) || '…' AS short_hash FROM pages""",
    "before_and_after": """SELECT page_id AS file_id, CASE WHEN page_id % 2 = 0 THEN (page_id % 5) || ' files | ' || (page_id % 7) || ' traces' ELSE (page_id % 7) || ' traces' END AS before,
        CASE WHEN page_id % 2 = 0 THEN (page_id % 4) || ' cleaned | ' || (page_id % 3) || ' unchanged' ELSE (page_id % 2) || ' remaining' END AS after FROM pages""",
}
