import hashlib
import random

import numpy as np

from metaveil.llm import substring_dedup
from tests.llm.cases import frame, odd_texts, words


def brute(rows):
    split = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for doc, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, w), (doc_id, _) in zip(split, rows):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < doc:
                gone |= set(range(k, k + 50))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(4)
    pool = [words(rng.randrange(40, 160), 1000 + k, 5000) for k in range(12)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += words(rng.randrange(0, 80), 5000 + rng.randrange(10**6), 5000)
            p = list(rng.choice(pool))
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] = "edited"
            a = rng.randrange(0, 20)
            w += p[a : len(p) - rng.randrange(0, 20)]
        rows.append((1000 + (i * 37) % 80, " ".join(w)))
    return rows + [(500, "same word " * 300), (501, "word same " * 200), (502, " ".join(words(49, 9))), (503, " ".join(words(49, 9)))]


def test_against_brute_force(spark):
    rows = odd_texts() + passages()
    got = substring_dedup.dedup(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_smallest():
    values = np.random.default_rng(0).integers(0, 20, 300).astype(np.uint64)
    want = [k + int(values[k : k + 41].argmin()) for k in range(260)]
    assert substring_dedup.smallest(values, 41).tolist() == want


def test_greedy_parse():
    assert substring_dedup.factors([]) == []
    # a copy that goes on in one source is one factor; the one that reaches furthest is taken, from where the last one ends
    assert substring_dedup.factors([(0, 50, 7, 100), (30, 90, 7, 130), (10, 60, 3, 0)]) == [(0, 90, 7, 100)]
    assert substring_dedup.factors([(0, 50, 7, 100), (20, 80, 5, 0), (20, 70, 4, 9), (200, 260, 1, 1)]) == [(0, 50, 7, 100), (50, 80, 5, 30), (200, 260, 1, 1)]


def test_factors_cover_what_matches_cover():
    rng = random.Random(9)
    for _ in range(200):
        matches = []
        for _ in range(rng.randrange(0, 12)):
            start = rng.randrange(0, 200)
            matches.append((start, start + rng.randrange(1, 60), rng.randrange(3), rng.randrange(50)))
        covered = {w for a, b, _, _ in matches for w in range(a, b)}
        parsed = substring_dedup.factors(matches)
        assert {w for a, b, _, _ in parsed for w in range(a, b)} == covered
        assert all(a[1] <= b[0] for a, b in zip(parsed, parsed[1:]))
        assert set(range(300)) - covered == set(substring_dedup._literals(300, parsed))
