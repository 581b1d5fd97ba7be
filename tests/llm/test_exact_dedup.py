import hashlib
import re
from collections import defaultdict

from metaveil.llm import exact_dedup
from tests.llm.cases import documents, frame, odd_texts


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    extra = [(100 + i, "copy of a\nhot  text") for i in range(300)] + [(99, "copy of a hot text")]
    got = exact_dedup.classify(documents(spark, extra)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(odd_texts() + extra)


def test_empty_table(spark):
    assert exact_dedup.classify(frame(spark, [])).count() == 0


def test_rows_alike_in_id_and_text(spark):
    rows = [(7, "same text")] * 25_000 + [(None, "same text")] * 300 + [(None, "other")] * 3
    got = exact_dedup.classify(frame(spark, rows)).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert sorted(map(tuple, got), key=str) == sorted([(7, 7, 25_300, True, 25_000), (None, 7, 25_300, False, 300), (None, None, 3, True, 3)], key=str)
