"""Small tables with the odd rows that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
#: Extra columns with names that operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, key int, salt int, start bigint"


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts() -> list[tuple[int | None, str | None]]:
    base = " ".join(words(120, 1))
    return [
        (1, base),
        (2, base),
        (3, base.replace(" ", "\t ", 7)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "one"),
        (8, "One two, three."),
        (9, " ".join(words(30_000, 2))),
        (10, "x" * 200_000),
        (11, base + " tail"),
        (11, base + " tail"),
        (12, "a b c d e f g h " * 40),
        (13, "Zeile 1\nZeile 2\n\nZeile 1\r\n  indented  twice\x0b\x0c!"),
        (None, "no id at all"),
        (None, None),
        (20, "😀 emoji 漢字 ÄÖÜ äöü <|endoftext|> it's 12 345"),
    ]


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]], parts: int = 3) -> DataFrame:
    full = [(i, t, "en", None if i == 5 else f"src{(i or 0) % 2}", len(t or ""), 1, 2, 3, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def documents(spark: SparkSession, extra: list[tuple[int | None, str | None]] | None = None) -> DataFrame:
    return frame(spark, odd_texts() + (extra or []))
