import random
import re

import xxhash

from metaveil.llm import simhash
from metaveil.llm.components import components
from tests.llm.cases import documents, frame, odd_texts, words


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [slow_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))), key=str)


def near_copies():
    base = words(300, 5)
    out = []
    for i in range(25):
        copy = list(base)
        copy[i * 7] = f"changed{i}"
        out.append((200 + i, " ".join(copy)))
    return out


def test_fingerprints_and_components(spark):
    rows = odd_texts() + near_copies()
    docs = frame(spark, rows)
    want = brute(rows)
    for shard_size in (2048, 4):  # the second splits shards
        got = simhash.classify(docs, shard_size=shard_size).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    kept = sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())
    assert kept == sorted([str(i) for i in {r[2] for r in want if r[2] is not None}] + ["None"] * (len({r[1] for r in want if r[2] is None})))
    assert simhash.keep_one(docs).columns == docs.columns


def test_links_of_random_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for fp in list(fps)[:200]:
        flipped = fp
        for bit in rng.sample(range(64), rng.randrange(1, 7)):
            flipped ^= 1 << bit
        fps.add(flipped)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    roots = dict(components(links).collect())
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & mask).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {f: roots.get(f, f) for f in signed} == {f: root(f) for f in signed}


def test_empty_tables(spark):
    assert simhash.classify(frame(spark, [])).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert simhash.keep_one(documents(spark).where("doc_id = 4")).count() == 1


def test_keep_one_chooses_rows(spark):
    a, b = (" ".join(words(200, seed)) for seed in (71, 72))
    rows = [(3, a), (5, a), (5, b), (5, b), (None, b), (7, None), (8, "")]
    got = simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, a), (5, b), (7, None)], key=str)


def test_keep_one_without_ids_and_with_clashing_names(spark):
    a, b = (" ".join(words(200, seed)) for seed in (81, 82))
    rows = frame(spark, [(None, a), (None, a + " x"), (None, b), (4, b)]).withColumnsRenamed({"fp": "kept", "salt": "turn"})
    got = simhash.keep_one(rows)
    assert got.columns == rows.columns and sorted((r.doc_id is None, r.text[:20]) for r in got.collect()) == sorted([(True, a[:20]), (False, b[:20])])
