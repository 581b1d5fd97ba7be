"""Exact duplicates, found by combining in three steps that no hot group can overload. DataFrame functions only.

1. Local: rows of one task with the same digest, the same text and the same salt become one (the map-side half of the
   first aggregation).
2. Salted: those partial groups meet by digest, text and salt, so a group of any size is spread over SALTS tasks.
3. Global: the at most SALTS winners of each text meet; the smallest doc_id wins.

The text itself is part of every grouping key, so full contents are compared at every step, not only digests. Each row
then finds its group by digest, a second hash and its own salt, which again spreads a hot group over SALTS keys; rows that
repeat both id and text, which no salt can part, are counted first and told again after that.

Defined cases: a null text counts as empty; texts that differ only in their runs of white space are equal; of equal texts
the smallest doc_id stays; a null doc_id loses to any other and stays only where its group has no other; rows that repeat
a doc_id and a text are copies of one document and share its mark; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaveil.llm.common import SPACE, with_columns

SALTS = 16
#: Rows that are told again at once.
RUN = 10_000


def classify(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs (doc_id, text)."""
    rows = (
        with_columns(docs, doc_id="bigint", text="string")
        .select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " ").alias("text"))
        .select(
            "doc_id",
            "text",
            F.sha2("text", 256).alias("text_sha256"),
            F.xxhash64("text").alias("check"),
            F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    salted = rows.groupBy("text_sha256", "text", "check", "salt").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = salted.groupBy("text_sha256", "text", "check").agg(
        F.min("first").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )
    spread = groups.select("text_sha256", "check", F.explode("salts").alias("salt"), "keep_id", "group_size")
    # rows alike in id and text have one salt: they go through the join as one
    counted = rows.drop("text").groupBy("text_sha256", "check", "salt", "doc_id").agg(F.count("*").alias("copies"))
    return (
        counted.join(spread, ["text_sha256", "check", "salt"])
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("copies") - F.col("turn") * RUN))))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
