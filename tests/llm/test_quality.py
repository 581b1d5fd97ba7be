import math
import zlib

from metaveil.llm import quality
from tests.llm.cases import documents, frame, odd_texts, words


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, " ".join(words(60 + i, i, 5000))) if i % 2 else (i, " !! ".join(words(60 + i, i, 5000)).upper()) for i in range(1000, 1200)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + odd_texts())
    network = quality.train(docs, labels, epochs=4)
    got = quality.classify(docs, labels, network).collect()
    assert len(got) == len(rows) + len(odd_texts())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    known = [r for r in held if r.doc_id >= 1000]
    assert sum(r.predicted == r.doc_id % 2 for r in known) >= 0.9 * len(known)
    assert quality.accept(docs, labels, network).columns == docs.columns


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(documents(spark), none).collect()} == {0.5}


def brute_score(network, text):
    """Filters at each byte, the largest of each over every two neighbouring segments, and the network's two layers, in plain loops."""
    p, n = network.parts, len(text)
    segments = []
    for at in range(0, max(1, n), quality.SEGMENT):
        best = [0.0] * quality.FILTERS
        for i in range(at, min(at + quality.SEGMENT, max(1, n))):
            for f in range(quality.FILTERS):
                total = sum(p["tables"][k][text[i + k] if i + k < n else 0][f] for k in range(quality.WIDTH))
                best[f] = max(best[f], float(total + p["bias"][f]))
        segments.append(best)
    chunks = [[max(a, b) for a, b in zip(x, y)] for x, y in zip(segments, segments[1:])] or segments
    columns = list(zip(*chunks))
    x = [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns] + [math.log1p(n) / 10]
    hidden = [math.tanh(sum(v * float(p["w1"][i][h]) for i, v in enumerate(x)) + float(p["b1"][h])) for h in range(len(p["b1"]))]
    return 1 / (1 + math.exp(-sum(h * float(w) for h, w in zip(hidden, p["w2"])) - float(p["b2"][0])))


def test_scores_against_brute_force():
    network = quality.Network()
    for text in (b"", b"one", "Ümläute und mehr".encode(), " ".join(words(90, 4)).encode(), b"x" * 256, b"ab" * 400):
        assert abs(network.score(text) - brute_score(network, text)) < 1e-4


def test_empty_table_and_repeated_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.classify(frame(spark, []), labels).count() == 0
    docs = frame(spark, [(1, "a b")] * 5 + [(1, "c d"), (2, "x")])
    assert quality.classify(docs, labels).count() == 7
