"""Queries over pages as saved mail, and DuckDB SQL that states the same from the pages' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaveil.operators import findings, mail

#: Parts of a mail as SQL that both engines run, and whether a copy keeps them.
PARTS = (
    ("'Received: from a (10.0.0.' || CAST(page_id % 200 AS STRING) || ')' || chr(13) || chr(10) || chr(9) || 'by b (10.0.0.9)' || chr(13) || chr(10)", False),
    ("'From: x@y' || chr(13) || chr(10)", True),
    ("'RECEIVED:from c 10.1.1.1' || chr(10)", False),
    ("'Subject: ' || url || chr(10) || '  goes on' || chr(10)", True),
    ("'X-Mailer:  M' || CAST(page_id % 7 AS STRING) || '  ' || chr(10)", False),
    ("'Message-ID: <' || url || '@' || chr(10) || ' host>'", False),
    ("chr(10) || chr(10) || html", True),
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(" || ".join(p for p, _ in PARTS))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("file_id"), text.cast("binary").alias("content"))


def mail_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.explode(mail.scan(_files(spark, sf_dir))).select("file_id", "pos", "category", "field", "label", "value", "severity")


def mail_clean_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mail.clean_and_verify(_files(spark, sf_dir))
    return done.select("file_id", "status", F.sha2("clean", 256).alias("clean_sha256"), "found_before", "remaining", "passed")


QUERIES = {f.__name__: f for f in (mail_findings, mail_clean_verify)}
_COPY = " || ".join(p for p, kept in PARTS if kept).replace("AS STRING", "AS VARCHAR")
_ADDRESSES = "array_to_string(list_filter(['10.0.0.' || (page_id % 200), CASE WHEN page_id % 200 <> 9 THEN '10.0.0.9' END, '10.1.1.1'], lambda x: x IS NOT NULL), ', ')"
ORACLE = {
    "mail_findings": f"""
        SELECT page_id AS file_id, 0 AS pos, 'other' AS category, 'EML:received' AS field, 'Received relay chain (2)' AS label, {_ADDRESSES} AS value, 'high' AS severity FROM pages
        UNION ALL SELECT page_id, 1, 'software', 'EML:x-mailer', 'Mail client', 'M' || (page_id % 7), 'medium' FROM pages
        UNION ALL SELECT page_id, 2, 'other', 'EML:message-id', 'Message-ID (correlation handle)', left('<' || url || '@ host>', 180), 'medium' FROM pages""",
    "mail_clean_verify": f"SELECT page_id AS file_id, 'ok' AS status, sha256({_COPY}) AS clean_sha256, CAST(3 AS BIGINT) AS found_before, CAST(0 AS BIGINT) AS remaining, true AS passed FROM pages",
}
