import hashlib
import re

from metaveil.llm import decontaminate
from tests.llm.cases import documents, frame, odd_texts, words


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, items, window=13):
    out = []
    for doc_id, text in rows:
        w, hit, ids = words_of(text), set(), set()
        for item, passage in items:
            p = words_of(passage)
            size = min(window, len(p))
            for k in range(len(p) - size + 1 if p else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == p[k : k + size]:
                        hit |= set(range(at, at + size))
                        ids.add(str(item if item is not None else ""))
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [
    (1, " ".join(words(120, 1)[20:60])),
    (2, " ".join(words(120, 1)[50:63]).upper()),
    (10, "Two THREE"),
    (10, "two three"),
    (3, "one"),
    (4, None),
    (5, " -- "),
    (None, "漢字 ÄÖÜ"),
    (6, "a b c d e f g h a b c d e"),
    (7, "h a"),
]
EXTRA = [(30, "start " + "-".join(words(120, 1)[18:45]) + " end"), (31, " ".join(words(120, 1)[50:62])), (32, "ONE one two three " * 5)]


def test_against_brute_force(spark):
    rows = [r for r in odd_texts() if r[0] != 9] + EXTRA
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = brute(rows, ITEMS)
    for block_words in (30, 10_000):  # several blocks, and one
        got = decontaminate.report(frame(spark, rows), bench, block_words=block_words).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if not r[5])


def test_very_long_and_empty(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontaminate.report(documents(spark), bench).collect()} == {0}
    assert decontaminate.report(frame(spark, []), bench).count() == 0
