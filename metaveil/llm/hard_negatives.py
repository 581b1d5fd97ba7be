"""Hard negatives: rows of another label that are nearly as near to an anchor as a positive is, found by radix selection.

A window is an anchor with an interval of scores and a wanted number k: the k best rows inside. The k-th best score is found
digit by digit: each task counts the scores of its rows in a histogram of BUCKETS equal parts of the window, and of these
counts only the best that hold k rows leave the task; added up, they tell the part that holds the k-th row. That part is the
window of the next digit, until it is a single score. Then one pass gathers the rows above that score, fewer than k, and of
those with that very score each task's k smallest ids. So a window costs a few counts and at most k rows a task, whatever
number of rows lies inside or shares a score.

Positives are chosen likewise: the window of an anchor is all scores, among the rows of its label. Their scores bound the
windows among the rows of other labels; positives of one score share a window.

The anchors are a stated query set (every so manieth id); they meet all rows in blocks: TURN anchors are broadcast at a
time, at most ANCHOR_BYTES, and blocks of rows are read from a written table. Results of a turn are appended to a table.

Defined cases: rows take no part if label or vector is null or a component is null, NaN or infinite; vectors shorter than
others count as padded with zeros; components beyond 2^25 after scaling are held there; rows that repeat an id are rows of
their own, as anchors too (their rows come again), and each is another row to the other; rows without an id are never anchors
and come last among equal scores; an anchor without positives, or a positive whose score is negative, gives no rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import dropped, materialise, scratch, small_batches, struct, with_columns
from metaveil.llm.vectors import inner, integers, packed, rows_of, unpacked, whole_rows

SCALE, MOST = 256, 2**25
DIGIT = 9
BUCKETS = 1 << DIGIT
#: Anchors of a turn, and bytes of their vectors at most.
TURN, ANCHOR_BYTES = 2048, 16 << 20
#: Anchors whose scores of a block are computed at once.
TILE = 128
NO_ID = np.iinfo(np.int64).max

BLOCKS = struct(key="bigint", vec_id="array<bigint>", label="array<bigint>", vectors="binary", longest="bigint")
COUNTS = struct(window="int", bucket="int", n="bigint")
FOUND = struct(window="int", key="bigint", id="bigint", score="bigint")


@dataclass
class Windows:
    """anchor: index, label, key and vector. A window: its anchor, its scores (low to high), the part of them in question (from
    top downwards to bottom), and how many rows are wanted there. Rows over top are sure of their place."""

    labels: np.ndarray
    keys: np.ndarray
    vectors: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wanted: int

    def __post_init__(self) -> None:
        self.top, self.bottom = self.high.copy(), self.low.copy()
        self.need = np.full(len(self.anchor), self.wanted)

    def shifts(self) -> np.ndarray:
        """Bits of a score below the digit that is counted next."""
        return np.array([max(0, int(t - b).bit_length() - DIGIT) for t, b in zip(self.top, self.bottom, strict=True)], np.int64)

    def slots(self) -> Iterator[np.ndarray]:
        """Windows, one of each anchor at a time: an array by anchor, -1 where it has no more."""
        order = np.argsort(self.anchor, kind="stable")
        turn = np.arange(len(order)) - np.searchsorted(self.anchor[order], self.anchor[order])
        for k in range(turn.max(initial=-1) + 1):
            slot = np.full(len(self.labels), -1)
            slot[self.anchor[order[turn == k]]] = order[turn == k]
            yield slot


def _candidates(block: dict, w: Windows, same: bool, floor: np.ndarray, slots: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows, rows and scores that lie in a window, not under its floor; TILE anchors at a time."""
    label, n = np.array(block["label"], np.int64), len(block["vec_id"])
    x, key = unpacked(block["vectors"], n, w.vectors.shape[1]), block["key"] + np.arange(n)
    for t in range(0, len(w.labels), TILE):
        part = slice(t, t + TILE)
        scores = inner(w.vectors[part], x)
        fits = label[None, :] == w.labels[part, None]
        fits = fits & (key[None, :] != w.keys[part, None]) if same else ~fits
        least = np.full(len(scores), NO_ID)
        for slot in slots:
            has = slot[part] >= 0
            least[has] = np.minimum(least[has], floor[slot[part][has]])
        a, r = np.nonzero(fits & (scores >= least[:, None]))
        s = scores[a, r]
        for slot in slots:
            at = slot[part][a]
            inside = (at >= 0) & (s >= floor[at]) & (s <= w.high[at])
            yield at[inside], r[inside], s[inside]


def _counted(w: object, same: bool):
    """Histograms of the windows' open parts; of each the best buckets that hold the wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Windows = w.value
        shifts, slots, counts = it.shifts(), list(it.slots()), np.zeros(len(it.anchor) * BUCKETS, np.int64)
        for block in rows_of(batches):
            for at, _, s in _candidates(block, it, same, it.bottom, slots):
                inside = s <= it.top[at]
                at, s = at[inside], s[inside]
                np.add.at(counts, at * BUCKETS + ((it.top[at] - s) >> shifts[at]), 1)
        counts = counts.reshape(-1, BUCKETS)
        before = counts.cumsum(1) - counts
        window, bucket = np.nonzero((counts > 0) & (before < it.need[:, None]))
        arrays = [pa.array(window.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[window, bucket])]
        yield pa.RecordBatch.from_arrays(arrays, schema=to_arrow_schema(COUNTS))

    return run


def _best(rows: list[np.ndarray], w: Windows) -> list[np.ndarray]:
    """Of rows (window, id, key, score) over top all, and of those at top the smallest ids that are wanted."""
    window, ids, key, score = rows
    order = np.lexsort([ids, -score, window])
    window, ids, key, score = (c[order] for c in rows)
    rank = np.arange(len(window)) - np.searchsorted(window, window)
    keep = (rank < w.wanted) | (score > w.top[window])
    return [window[keep], ids[keep], key[keep], score[keep]]


def _gathered(w: object, same: bool):
    """The rows that a task has for the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Windows = w.value
        slots, have = list(it.slots()), [np.zeros(0, np.int64)] * 4
        floor = np.where(it.need > 0, it.top, it.top + 1)
        for block in rows_of(batches):
            ids = np.array([NO_ID if i is None else i for i in block["vec_id"]], np.int64)
            for at, r, s in _candidates(block, it, same, floor, slots):
                if len(at):
                    have = _best([np.concatenate(x) for x in zip(have, (at, ids[r], block["key"] + r, s), strict=True)], it)
        window, ids, key, score = have
        arrays = [pa.array(window.astype(np.int32)), pa.array(key), pa.array(ids, mask=ids == NO_ID), pa.array(score)]
        yield pa.RecordBatch.from_arrays(arrays, schema=to_arrow_schema(FOUND))

    return run


def select(blocks: DataFrame, w: Windows, same: bool) -> DataFrame:
    """window, key, id, score, rank: the wanted rows of each window, among the anchor's own label or the others."""
    share = blocks.sparkSession.sparkContext.broadcast
    while True:
        open_ = (w.top > w.bottom) & (w.need > 0)
        if not open_.any():
            break
        counts = blocks.mapInArrow(_counted(share(w), same), COUNTS).groupBy("window", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy("window").orderBy("bucket")
        counts = counts.select("window", "bucket", "n", F.sum("n").over(by).alias("reached"))
        need = F.array(*[F.lit(int(n)) for n in np.unique(w.need)])
        ends = counts.where(F.exists(need, lambda k: (F.col("reached") >= k) & (F.col("reached") - F.col("n") < k))).collect()
        _refine(w, open_, ends)
    found = blocks.mapInArrow(_gathered(share(w), same), FOUND)
    order = Window.partitionBy("window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= w.wanted)


def _refine(w: Windows, open_: np.ndarray, ends: list) -> None:
    """The bucket with the last wanted row becomes the part in question; a part that holds fewer rows is taken whole."""
    shifts, chosen = w.shifts(), {}
    for r in ends:
        need = w.need[r["window"]]
        if r["reached"] >= need and r["reached"] - r["n"] < need:
            chosen[r["window"]] = (r["bucket"], r["reached"] - r["n"])
    for i in np.flatnonzero(open_):
        if i in chosen:
            bucket, before = chosen[i]
            top = w.top[i] - (bucket << shifts[i])
            w.bottom[i] = max(w.bottom[i], top - (1 << shifts[i]) + 1)
            w.top[i], w.need[i] = top, w.need[i] - before
        else:
            w.top[i], w.need[i] = w.bottom[i] - 1, 0


def prepare(rows: DataFrame) -> tuple[DataFrame, int]:
    """Blocks of the rows that take part (vec_id, embedding, label), and their vectors' length."""
    small_batches(rows.sparkSession)
    rows = whole_rows(with_columns(rows, vec_id="bigint", embedding="array<double>", label="bigint").where("label IS NOT NULL"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(1), width, SCALE, MOST).astype(np.int64)
                row = [key, batch.column(0).to_pylist(), batch.column(2).to_pylist(), packed(x), int((x * x).sum(1).max())]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, to_arrow_schema(BLOCKS), strict=True)], schema=to_arrow_schema(BLOCKS))
                key += batch.num_rows

    return materialise(rows.mapInArrow(run, BLOCKS), "blocks"), width


ANCHORS = struct(key="bigint", id="bigint", label="bigint", vector="binary")


def _anchors(blocks: DataFrame, width: int, every: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            at = [i for i, v in enumerate(b["vec_id"]) if v is not None and v % every == 0]
            x = unpacked(b["vectors"], len(b["vec_id"]), width)[at].astype(np.int32)
            columns = [[b["key"] + i for i in at], [b["vec_id"][i] for i in at], [b["label"][i] for i in at], [v.tobytes() for v in x]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(ANCHORS), strict=True)], schema=to_arrow_schema(ANCHORS))

    return materialise(blocks.drop("longest").mapInArrow(run, ANCHORS), "anchors")


def mine(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 5, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, embedding, label.

    Anchors are the rows whose id is divisible by every. Negatives of a positive score between percent and 100 % of it.
    """
    spark = rows.sparkSession
    blocks, width = prepare(rows)
    longest = blocks.agg(F.max("longest")).first()[0] or 0
    anchors, path, last = _anchors(blocks, width, every), scratch(spark, "negatives"), -1
    size = max(1, min(TURN, ANCHOR_BYTES // max(1, 8 * width)))
    result = struct(anchor_id="bigint", positive_id="bigint", rank="int", negative_id="bigint", positive_score="bigint", negative_score="bigint")
    spark.createDataFrame([], result).write.parquet(path)
    blocks = blocks.drop("longest")
    while few := anchors.where(F.col("key") > last).orderBy("key").limit(size).collect():
        last = few[-1]["key"]
        labels, keys = (np.array([r[c] for r in few], np.int64) for c in ("label", "key"))
        vectors = np.stack([np.frombuffer(r["vector"], np.int32) for r in few]).astype(np.int64)
        # no score is beyond the product of the norms
        most = np.array([math.isqrt(int((v * v).sum()) * longest) + 1 for v in vectors], np.int64)
        nearest = select(blocks, Windows(labels, keys, vectors, np.arange(len(few)), -most, most, positives), True).collect()
        pairs = sorted({(r["window"], r["score"]) for r in nearest if r["score"] >= 0})
        if pairs:
            anchor, high = np.array(pairs, np.int64).T.copy()
            found = select(blocks, Windows(labels, keys, vectors, anchor, -(-high * percent // 100), high, k), False)
            number = {p: i for i, p in enumerate(pairs)}
            told = [(number[r["window"], r["score"]], few[r["window"]]["id"], r["id"], r["score"]) for r in nearest if r["score"] >= 0]
            told = spark.createDataFrame(told, "window int, anchor_id bigint, positive_id bigint, positive_score bigint")
            rows_ = found.join(F.broadcast(told), "window")  # at most `positives` rows for each anchor of the turn
            rows_.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    dropped(anchors)
    return spark.read.schema(result).parquet(path)
