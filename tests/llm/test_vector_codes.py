import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from metaveil.llm import common, vector_codes
from tests.llm.cases import SF

SCHEMA = "vec_id bigint, embedding array<float>, label int, key int, n int, part int, sums int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd rounds over Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    whole = [[int(np.floor(np.float64(np.float32(x)) * scale)) for x in r[1]] + [0] * (width - len(r[1])) for r in rows]
    cut = [[tuple(v[p * width // parts : (p + 1) * width // parts]) for p in range(parts)] for v in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]

    def far(x, c):
        return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            own = defaultdict(list)
            for v, c in zip(cut, codes, strict=True):
                own[c[p]].append(v[p])
            books[p] = [tuple(sum(x) // len(own[e]) for x in zip(*own[e], strict=True)) if e in own else old for e, old in enumerate(books[p])]
    codes = assign()
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    labels = defaultdict(int)
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((r[0], bytes(c).hex(), e, labels[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)), key=str)


def odd(n=120, width=8, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], None if i % 9 == 0 else i % 4) for i in range(n)]
    rows += [(n + i, rows[3][1], 3) for i in range(60)]  # a hot vector
    rows += [(7, rows[8][1], 1), (7, rows[7][1], 1), (None, rows[5][1], 2), (None, [0.5] * width, None)]
    rows += [(900, None, 1), (901, [None] * width, 1), (902, [float("nan")] * width, 1), (903, [float("inf")] + [0.0] * (width - 1), 1), (904, [-float("inf")], 2)]
    return rows + [(905, [1.5, -2.5, 0.25], 1), (906, [], 1)]


@pytest.mark.parametrize("entries", [16, 256])
def test_against_plain_rounds(spark, entries):
    rows = odd()
    coded, books = vector_codes.compress(frame(spark, rows), entries=entries)
    want = brute(rows, entries=entries)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert books.sha256() == want[0][4]


def test_query_of_the_contract(spark):
    rows = odd(n=400, width=6, seed=2)  # six components are padded to eight
    got = sorted((tuple(r) for r in vector_codes.codes(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_rows_far_apart_and_many_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 4.4) for _ in range(4)], i % 2) for i in range(300)]
    coded, books = vector_codes.compress(frame(spark, rows), entries=20, rounds=9)
    want = brute(rows, entries=20, rounds=9)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert books.sha256() == want[0][4]


def test_empty_tables_and_huge_components(spark):
    assert vector_codes.codes(frame(spark, [])).count() == 0
    assert vector_codes.codes(frame(spark, [(1, None, 1)])).count() == 0
    assert [r["code"] for r in vector_codes.codes(frame(spark, [(1, [], None)])).collect()] == ["00000000"]
    assert vector_codes.codes(frame(spark, [(1, [3e38, -3e38, 1.0, 0.0], 1), (2, [0.0] * 4, 1)])).count() == 2


def test_heaps_pop_only_what_drift_reaches(spark):
    """Parts far from any border stay in their heaps without being looked at."""
    rng = np.random.default_rng(3)
    books = np.array([[[0, 0], [10_000, 0]]])
    x = np.concatenate([rng.integers(-50, 50, (500, 2)), rng.integers(-50, 50, (500, 2)) + [10_000, 0], [[5_000, 3]]])
    sums = vector_codes._Sums(books)
    block = vector_codes._Block.first(list(range(1001)), [0] * 1001, x, books, sums)
    row = {"vec_id": block.vec_id, "label": block.label}
    row |= {k: v[0].as_py() for k, v in zip(("vectors", "codes", "keys", "heaped"), block.batch(vector_codes.to_arrow_schema(vector_codes.STATE)).columns[2:6], strict=True)}
    seen = []
    plain, vector_codes._nearest = vector_codes._nearest, lambda x, book: (seen.append(len(x)), plain(x, book))[1]
    try:
        vector_codes._Block.read(row, books).turn(books + 1, np.array([[3.0, 3.0]]), sums)
    finally:
        vector_codes._nearest = plain
    assert seen == [1]


def test_label_totals_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(common, "LOOKUP_ROWS", 3)
    monkeypatch.setattr(common, "HOT_PART", 7)
    rows = odd(n=150, width=4, seed=8)
    assert sorted((tuple(r) for r in vector_codes.codes(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    coded, books = vector_codes.compress(table, entries=12, rounds=3)
    want = brute(rows, entries=12, rounds=3)
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in coded.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    assert books.sha256() == want[0][4]
