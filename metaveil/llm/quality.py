"""A quality classifier: a convolutional network over bytes, in numpy.

The bytes of the whole text are cut into segments of SEGMENT bytes; two neighbouring segments make a chunk, so chunks
overlap by half and cover the document. WIDTH-byte filters are applied at every byte (a filter is a table of one weight for
each offset and byte value, so a convolution is a sum of table rows), rectified and max-pooled over each chunk. The mean,
the largest and the smallest pooled value over the document's chunks, with the logarithm of its size, go through one hidden
layer to one probability.

Training takes a bounded sample: at most `sample` labelled rows of each label that are not held out, in the order of a hash
of their ids, and of each at most TRAIN_BYTES bytes, as evenly spread runs of chunks. Scoring reads every byte of every text.

Defined cases: null and empty texts have a score too (that of no bytes); null doc_ids are not held out and never used for
training; a doc_id with several labels is used with each; without both labels in the sample every score is the share of label
1 in it (0.5 without any label, so `predicted` is 0); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import small_batches, struct, with_columns

WIDTH, FILTERS, HIDDEN = 4, 16, 16
#: Bytes of a segment, and segments that are convolved at once.
SEGMENT, BLOCK = 256, 16
#: Labelled rows of each label in the training sample, and bytes of each that training looks at.
SAMPLE, TRAIN_BYTES = 1500, 96 * SEGMENT
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Weight of label 1 against label 0: above THRESHOLD should be all that is likelier good.
GOOD_WEIGHT = 3.0
THRESHOLD = 0.7

SCORES = struct(doc_id="bigint", held_out="boolean", score="double", predicted="int")


def convolved(data: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each filter's output at each byte (segments x bytes x filters); beyond the data minus infinity."""
    n = max(1, len(data))
    size = -(-n // SEGMENT) * SEGMENT
    padded = np.zeros(size + WIDTH - 1, np.intp)
    padded[: len(data)] = data
    out = np.take(tables[0], padded[:size], axis=0)
    row = np.empty_like(out)
    for k in range(1, WIDTH):
        out += np.take(tables[k], padded[k : k + size], axis=0, out=row, mode="clip")
    out[n:] = -np.inf
    return out.reshape(-1, SEGMENT, tables.shape[2])


def pooled(raw: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The largest rectified output of each filter in each segment (segments x filters)."""
    while raw.shape[1] > 1:  # halves are contiguous, which a maximum over the axis is not
        half = raw.shape[1] // 2
        raw = np.maximum(raw[:, :half], raw[:, half:])
    return np.maximum(raw[:, 0] + bias, 0)


def features(pools: np.ndarray, n: int) -> np.ndarray:
    chunks = np.maximum(pools[:-1], pools[1:]) if len(pools) > 1 else pools
    return np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0), [np.log1p(n) / 10]])


def _crop(data: np.ndarray, good: bool, rng: np.random.Generator) -> np.ndarray:
    """Now and then only a short run of a training text, so that the network learns what short texts look like."""
    least = 15 if good else 150
    if len(data) <= least or rng.random() > (0.4 if good else 0.2):
        return data
    size = int(min(len(data), least * (600 / least) ** rng.random()))
    at = int(rng.integers(0, len(data) - size + 1))
    return data[at : at + size]


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        inputs = 3 * FILTERS + 1
        self.parts = {
            "tables": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, inputs**-0.5, (inputs, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def score(self, text: bytes | None) -> float:
        """The probability of label 1. Holds the filter outputs of one block of the text at a time."""
        if self.constant is not None:
            return self.constant
        p, text = self.parts, text or b""
        step = BLOCK * SEGMENT
        pools = []
        for at in range(0, max(1, len(text)), step):
            part = np.frombuffer(text[at : at + step + WIDTH - 1], np.uint8)
            pools.append(pooled(convolved(part, p["tables"])[:BLOCK], p["bias"]))
        x = features(np.concatenate(pools), len(text))
        hidden = np.tanh(x @ p["w1"] + p["b1"])
        return float(1 / (1 + np.exp(-np.clip(hidden @ p["w2"] + p["b2"][0], -30, 30))))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
        y = np.array(labels, np.float32)
        if len(set(labels)) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng, p = np.random.default_rng(seed), self.parts
        first = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        weight = np.where(y == 1, GOOD_WEIGHT / y.mean(), 1 / (1 - y.mean())) / (1 + GOOD_WEIGHT)
        data, step = [np.frombuffer(t, np.uint8) for t in texts], 0
        for epoch in range(epochs):
            order, rate = rng.permutation(len(data)), RATE * 0.75**epoch
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                grads = {k: np.zeros_like(v) for k, v in p.items()}
                for i in batch:
                    self._backward(_crop(data[i], y[i] == 1, rng), float(y[i]), float(weight[i]) / len(batch), grads)
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _backward(self, data: np.ndarray, y: float, weight: float, grads: dict[str, np.ndarray]) -> None:
        p = self.parts
        raw = convolved(data, p["tables"])
        pools = pooled(raw, p["bias"])
        x = features(pools, len(data))
        hidden = np.tanh(x @ p["w1"] + p["b1"])
        logit = np.clip(hidden @ p["w2"] + p["b2"][0], -30, 30)
        d = (1 / (1 + np.exp(-logit)) - y) * weight
        grads["w2"] += d * hidden
        grads["b2"] += d
        back = d * p["w2"] * (1 - hidden * hidden)
        grads["w1"] += np.outer(x, back)
        grads["b1"] += back
        dx = p["w1"] @ back
        mean, largest, smallest = dx[:FILTERS], dx[FILTERS : 2 * FILTERS], dx[2 * FILTERS : 3 * FILTERS]
        one = len(pools) == 1
        chunks = pools if one else np.maximum(pools[:-1], pools[1:])
        f = np.arange(FILTERS)
        d_chunks = np.repeat(mean[None] / len(chunks), len(chunks), 0)
        d_chunks[chunks.argmax(0), f] += largest
        d_chunks[chunks.argmin(0), f] += smallest
        d_pools = np.zeros_like(pools)
        if one:
            d_pools += d_chunks
        else:
            left = pools[:-1] >= pools[1:]
            d_pools[:-1] += np.where(left, d_chunks, 0)
            d_pools[1:] += np.where(left, 0, d_chunks)
        d_pools *= pools > 0
        grads["bias"] += d_pools.sum(0)
        segment, filters = np.nonzero(d_pools)
        place = segment * SEGMENT + raw.argmax(1)[segment, filters]
        padded = np.concatenate([data, np.zeros(WIDTH + SEGMENT, np.uint8)])
        for k in range(WIDTH):
            np.add.at(grads["tables"][k], (padded[place + k], filters), d_pools[segment, filters])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _spread(most: int):
    """Texts of at most that many bytes: longer ones as eight runs from evenly spread places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            size = most // 8
            cut = [t if len(t) <= most else b"".join(t[k : k + size] for k in range(0, len(t) - size + 1, (len(t) - size) // 7)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], names=["quality", "data"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Network:
    """A network fitted on labels.quality of at most 2 * sample rows."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = with_columns(labels, doc_id="bigint", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [r for q in (0, 1) for r in marked.where(F.col("quality") == q).distinct().orderBy(*order).limit(sample).collect()]
    if not chosen:
        return Network().fit([], [])
    few = spark.createDataFrame(chosen, marked.schema)
    texts = with_columns(docs, doc_id="bigint", text="string").join(F.broadcast(few), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text", "doc_id")  # a repeated doc_id gives one text
    rows = texts.mapInArrow(_spread(TRAIN_BYTES), struct(quality="int", data="binary")).collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["data"])))
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))[: 4 * sample]]
    return Network().fit([bytes(r["data"]) for r in rows], [r["quality"] for r in rows], epochs)


def classify(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SCORES)
        for batch in batches:
            scores = np.array([shared.value.score(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.float64)
            predicted = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), predicted], schema=schema)

    return with_columns(docs, doc_id="bigint", text="string").select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCORES)


def accept(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """The rows of docs that the classifier predicts to have label 1, with all their columns; two are doc_id and text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network or train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.score(t) >= THRESHOLD for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
