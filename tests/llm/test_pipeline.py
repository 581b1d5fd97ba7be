import zlib
from array import array
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from metaveil.llm import mixing, quality, token_planes
from tests.llm import test_decontaminate, test_simhash
from tests.llm.cases import frame, odd_texts, words


def tables(spark, folder, rows, items):
    docs = frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, i % 2) for i, _ in rows if i is not None and 1000 <= i < 1200]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    return docs


def kept_near(rows):
    """One row of each group: the smallest id, then the smallest hash; ids beat none."""
    prints = [test_simhash.slow_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(rows[i])
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_against_plain_python(spark, tmp_path):
    good = [(i, " ".join(words(60 + i % 90, i, 5000))) if i % 2 else (i, " !! ".join(words(60 + i % 90, i, 5000)).upper()) for i in range(1000, 1200)]
    passage = " ".join(words(40, 77, 5000))
    rows = good + [r for r in odd_texts() if r[0] != 11] + [(3000, good[1][1]), (3001, good[1][1] + " more"), (3002, passage), (3003, passage + " " + " ".join(words(30, 78, 5000)))]
    folder = f"file://{tmp_path}/sf"
    docs = tables(spark, folder, rows, [(1, passage), (2, None)])
    library = Tokenizer.from_file(token_planes.default_tokenizer())
    network = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    left = [r for r in rows if network.score(None if r[1] is None else r[1].encode()) >= quality.THRESHOLD]
    assert 0 < len(left) < len(rows)
    left = kept_near(left)
    dirty = {r[0] for r in test_decontaminate.brute(left, [(1, passage)]) if r[5]}
    left = [r for r in left if r[0] not in dirty]
    copies = Counter((r.doc_id, r.text) for r in mixing.realise(frame(spark, left)).select("doc_id", "text").collect())
    assert set(copies) == set(left)
    want = Counter()
    for (doc_id, text), n in copies.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id, len(ids), zlib.crc32(array("I", ids).tobytes())] += n
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_stages_keep_the_columns(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    docs = tables(spark, folder, odd_texts(), [(1, None)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}/sf"
    tables(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
