import hashlib
import random

import pytest

from metaveil.llm import line_dedup
from tests.llm.cases import frame, odd_texts, words


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    seen, gone = [], {}
    for i in order:
        gone[i] = []
        for number, line in enumerate((rows[i][1] or "").encode().split(b"\n")):
            s = frozenset(line.split())
            if not s:
                continue
            if any(5 * len(s & t) >= 4 * len(s | t) for t in seen):
                gone[i].append(number)
            seen.append(s)
    return sorted(((rows[i][0], len((rows[i][1] or "").split("\n")), len(g), ",".join(map(str, g))) for i, g in gone.items()), key=str)


def near_lines(first):
    rng = random.Random(8)
    pool = [words(rng.randrange(1, 40), 70 + k, 3000) for k in range(30)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 4)):
                line[rng.randrange(len(line))] = f"new{rng.randrange(400)}"
            lines.append(" ".join(line))
        rows.append((first + (i * 31) % 90, "\n".join(lines)))
    return rows


def test_against_brute_force(spark):
    for rows in (odd_texts() + near_lines(1000), near_lines(0)):
        want = brute(rows)
        got = line_dedup.find(frame(spark, rows), keep=1, doubtful=1).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in got), key=str) == want


@pytest.mark.parametrize("exact", [False, True])
def test_split_words(spark, exact):
    rows = near_lines(0)
    got = line_dedup.find(frame(spark, rows), part_rows=10, exact=exact).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in got), key=str) == brute(rows)


def test_many_partitions_repeated_and_null_ids(spark):
    rows = [(None if i % 7 == 0 else i % 11, t) for i, t in near_lines(0)] + odd_texts()
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = line_dedup.find(frame(spark, rows, 300)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in got), key=str) == brute(rows)


def test_copies_known_by_name_and_words_in_other_orders(spark):
    line = " ".join(words(30, 9))
    rows = [(i, f"{line}\n{i}\nb a c\na b c\n{' '.join(reversed(line.split()))}") for i in range(100)]
    got = line_dedup.find(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed) for r in got), key=str) == brute(rows)


def test_lines_across_chunks(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from metaveil.llm import words as module

    texts = ["a b\n\n c d e\nf", "", None, "g h i j k l m n o p\nq", " x" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["place", "text"])
    whole = [np.concatenate(c) for c in zip(*line_dedup.Lines(8).groups(batch))]
    assert whole[0].tolist() == [0, 2, 3, 3 << 8, (3 << 8) + 1, 4 << 8] and whole[1].tolist() == [2, 3, 1, 10, 1, 40]
    monkeypatch.setattr(module, "CHUNK", 5)
    assert all((a == np.concatenate(c)).all() for a, c in zip(whole, zip(*line_dedup.Lines(8).groups(batch))))


def test_empty_table(spark):
    assert line_dedup.find(frame(spark, [])).count() == 0
