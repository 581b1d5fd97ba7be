import math
import random

import pytest
from metaveil.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, key int, rank int, window int, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def brute(rows, every, positives=5, k=5, percent=80):
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(256 * x) for x in r[1]] for r in rows]
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        near = []
        for i, v in enumerate(whole):
            if i != a:
                near.append((-sum(x * y for x, y in zip(whole[a], v, strict=False)), rows[i][0] is None, rows[i][0] or 0, i))
        near.sort()
        for s, _, _, p in [n for n in near if rows[n[3]][2] == label][:positives]:
            fits = [n for n in near if rows[n[3]][2] != label and percent * -s <= 100 * -n[0] and -n[0] <= -s]
            out += [(anchor, rows[p][0], rank, rows[n[3]][0], -s, -n[0]) for rank, n in enumerate(fits[:k], 1)]
    return sorted(out, key=str)


def mined(df, every, **more):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in hard_negatives.mine(df, every, **more).select(*columns).collect()), key=str)


def quarter(rng):
    return rng.randrange(-8, 9) / 4  # exact as a float, and full of ties


def odd(n=300, width=6, seed=1):
    rng = random.Random(seed)
    rows = [(i, [quarter(rng) for _ in range(width)], rng.randrange(4)) for i in range(n)]
    rows += [(n + i, rows[10][1], i % 3) for i in range(150)]  # a hot vector in three labels
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 1), (None, rows[20][1], 2), (None, rows[20][1], 1), (-20, rows[20][1], 0)]
    return rows + [(800, None, 1), (810, [None] * width, 1), (820, [float("nan")] * width, 1), (830, [float("inf")], 1), (840, rows[0][1], None), (850, [1.0, 2.0], 1), (860, [], 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = odd(seed=seed)
    assert mined(frame(spark, rows), 10) == brute(rows, 10)


def test_other_numbers_and_small_turns(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TURN", 3)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    rows = odd(n=120, seed=7)
    assert mined(frame(spark, rows), 7, positives=2, k=9, percent=40) == brute(rows, 7, 2, 9, 40)


def test_scores_of_many_digits(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(-8, 14) for _ in range(3)], rng.randrange(2)) for i in range(400)]
    assert mined(frame(spark, rows), 20) == brute(rows, 20)


def test_empty_and_lonely(spark):
    assert mined(frame(spark, []), 10) == []
    assert mined(frame(spark, [(10, [1.0], 1)]), 10) == []
    assert mined(frame(spark, [(10, [1.0], 1), (11, [1.0], 1)]), 10) == []
    assert mined(frame(spark, [(10, [0.0], 1), (11, [1.0], 1), (12, [2.0], 2)]), 10) == [(10, 11, 1, 12, 0, 0)]
    assert mined(frame(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]), 10) == [(10, 11, 1, 12, 0, 0)]
    assert mined(frame(spark, [(10, [1.0], 1), (11, [-1.0], 1), (12, [-1.0], 2)]), 10) == []  # a negative score has no window


def test_few_counts_leave_a_task():
    """A histogram keeps its best buckets up to the wanted number of rows."""
    import numpy as np

    w = hard_negatives.Windows(np.array([1]), np.array([0]), np.array([[1]]), np.array([0]), np.array([-600]), np.array([1000]), 5)
    holder = type("Shared", (), {"value": w})
    batch = hard_negatives.pa.RecordBatch.from_pydict({"key": [1], "vec_id": [list(range(1000))], "label": [[2] * 1000], "vectors": [np.arange(1000, dtype=np.int16).tobytes()]})
    (counts,) = hard_negatives._counted(holder, False)(iter([batch]))
    assert counts.num_rows <= 5 and sum(counts.column(2).to_pylist()) >= 5
