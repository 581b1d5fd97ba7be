"""Vectors as codes of a few bytes: product quantisation, whose codebooks Lloyd's iteration finds with heaps.

A vector is cut into equal parts; each part position has a codebook. Every part knows its entry, an upper bound of its
distance to that entry and a lower bound of the distance to any other. A round moves the entries, and by how far is known: a
part's slack (lower less upper bound) shrinks by its entry's move and the largest move of another one at most. So each block
of rows keeps a heap of its parts for each entry, keyed by the slack plus what its entry's total drift was then. A round pops
only the parts whose key the total drift has reached; all others have kept their entry without being looked at. Popped parts
are compared with all entries exactly, get new bounds and go into the heap of their entry. What moves between entries changes
their sums; only these changes leave the tasks, added up in each.

All is integer arithmetic but for the bounds, whose comparison leaves a margin far beyond rounding: what is near is compared
exactly, so the result is that of plain Lloyd rounds, with ties to the lower index.

Blocks hold what an Arrow batch does (2 MB): vectors, codes and heaps. They are written to the shared folder after every round, so that
a lost executor costs its tasks only, and the table of the round before goes. Entries and sums alone reach the driver and are
broadcast: parts * entries * components numbers whatever the size of the table.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left out; vectors shorter than others
count as padded with zeros, and so do all if the length isn't a multiple of the parts; components beyond 2^26 after scaling
are held there; codebooks start with the smallest ids (ties by vector, null ids last), fewer rows than entries make fewer
entries; repeated rows are rows of their own; null labels count as one label; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import dropped, lookup, materialise, small_batches, struct, with_columns
from metaveil.llm.vectors import inner, integers, packed, rows_of, unpacked, whole_rows

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 2**26
#: Far more than doubles lose in distances up to 2^32.
MARGIN = 1e-3
#: Parts that are compared with all entries at once.
TILE = 2048

#: A block, or the sums of one entry: exactly one half of the columns is set.
STATE = struct(vec_id="array<bigint>", label="array<bigint>", vectors="binary", codes="binary", keys="binary", heaped="binary", part="int", entry="int", sums="array<bigint>")
CODED = struct(vec_id="bigint", label="bigint", code="string", error="bigint")


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: its entry (ties to the lower one), and the slack between it and the next."""
    code, slack = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (book * book).sum(1)
    for k in range(0, len(x), TILE):
        t = x[k : k + TILE]
        far = (t * t).sum(1)[:, None] + norms[None, :] - 2 * inner(t, book)
        at = far.argmin(1)
        code[k : k + TILE] = at
        own = far[np.arange(len(t)), at]
        far[np.arange(len(t)), at] = np.iinfo(np.int64).max
        slack[k : k + TILE] = np.sqrt(far.min(1)) - np.sqrt(own) if len(book) > 1 else np.inf
    return code, slack


class _Sums:
    """Changes of the entries' sums and counts, added up in a task."""

    def __init__(self, books: np.ndarray) -> None:
        parts, entries, width = books.shape
        self.sums = np.zeros((parts, entries, width + 1), np.int64)

    def add(self, part: int, codes: np.ndarray, x: np.ndarray, sign: int) -> None:
        np.add.at(self.sums[part], codes, sign * np.concatenate([x, np.ones((len(x), 1), np.int64)], 1))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        part, entry = np.nonzero(self.sums.any(2))
        columns = {"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "sums": pa.array(self.sums[part, entry].tolist(), pa.list_(pa.int64()))}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(part), f.type) for f in schema], schema=schema)


class _Block:
    """Rows with their codes, and a heap of parts for each part position and entry."""

    def __init__(self, vec_id: list, label: list, x: np.ndarray, parts: int) -> None:
        self.vec_id, self.label, self.n = vec_id, label, len(vec_id)
        self.x = x.reshape(self.n, parts, -1) if x.size else np.zeros((self.n, parts, 0), np.int64)
        self.codes, self.heaps = np.zeros((parts, self.n), np.int64), []

    @classmethod
    def first(cls, vec_id: list, label: list, x: np.ndarray, books: np.ndarray, sums: _Sums) -> _Block:
        self = cls(vec_id, label, x, len(books))
        for p, book in enumerate(books):
            code, slack = _nearest(self.x[:, p], book)
            order = np.lexsort([slack, code])  # a sorted list is a heap
            ends = np.bincount(code, minlength=len(book)).cumsum()[:-1]
            self.codes[p] = code
            self.heaps.append([list(zip(k.tolist(), r.tolist(), strict=True)) for k, r in zip(np.split(slack[order], ends), np.split(order, ends), strict=True)])
            sums.add(p, code, self.x[:, p], 1)
        return self

    @classmethod
    def read(cls, row: dict, books: np.ndarray) -> _Block:
        parts, entries, width = books.shape
        n = len(row["vec_id"])
        self = cls(row["vec_id"], row["label"], unpacked(row["vectors"], n, parts * width), parts)
        self.codes = np.frombuffer(row["codes"], np.int16).astype(np.int64).reshape(parts, n)
        keys, heaped = np.frombuffer(row["keys"]).reshape(parts, n), np.frombuffer(row["heaped"], np.int32).reshape(parts, n)
        for p in range(parts):
            ends = np.bincount(self.codes[p], minlength=entries).cumsum()[:-1]
            self.heaps.append([list(zip(k.tolist(), r.tolist(), strict=True)) for k, r in zip(np.split(keys[p], ends), np.split(heaped[p], ends), strict=True)])
        return self

    def turn(self, books: np.ndarray, drift: np.ndarray, sums: _Sums) -> None:
        """Pops what the drift has reached, and puts it into the heaps where it belongs now."""
        for p, book in enumerate(books):
            popped: list[int] = []
            for heap, most in zip(self.heaps[p], (drift[p] + MARGIN).tolist(), strict=True):
                while heap and heap[0][0] <= most:
                    popped.append(heappop(heap)[1])
            if not popped:
                continue
            at = np.array(popped)
            x, old = self.x[at, p], self.codes[p, at]
            code, slack = _nearest(x, book)
            for key, row, entry in zip((slack + drift[p, code]).tolist(), popped, code.tolist(), strict=True):
                heappush(self.heaps[p][entry], (key, row))
            moved = code != old
            self.codes[p, at] = code
            sums.add(p, old[moved], x[moved], -1)
            sums.add(p, code[moved], x[moved], 1)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        flat = [[item for heap in heaps for item in heap] for heaps in self.heaps]
        keys = np.array([[k for k, _ in items] for items in flat], np.float64)
        heaped = np.array([[r for _, r in items] for items in flat], np.int32)
        row = {"vec_id": self.vec_id, "label": self.label, "vectors": packed(self.x), "codes": self.codes.astype(np.int16).tobytes(), "keys": keys.tobytes(), "heaped": heaped.tobytes()}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) if f.name in row else pa.nulls(1, f.type) for f in schema], schema=schema)

    def coded(self, books: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        error = np.zeros(self.n, np.int64)
        for p, book in enumerate(books):
            error += ((self.x[:, p] - book[self.codes[p]]) ** 2).sum(1)
        code = [bytes(c).hex() for c in np.ascontiguousarray(self.codes.T.astype(np.uint8))]
        return pa.RecordBatch.from_arrays([pa.array(self.vec_id, pa.int64()), pa.array(self.label, pa.int64()), pa.array(code, pa.string()), pa.array(error)], schema=schema)


class Codebooks:
    """Entries by part position, the sums of what is assigned to them, and their drift so far."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.sums = np.zeros((*entries.shape[:2], entries.shape[2] + 1), np.int64)
        self.drift = np.zeros(entries.shape[:2])

    def move(self, changes: list) -> None:
        """The entries go to the means of their parts; unused ones stay."""
        for r in changes:
            self.sums[r["part"], r["entry"]] += np.array(r["sums"], np.int64)
        sums, counts = self.sums[:, :, :-1], self.sums[:, :, -1:]
        new = np.where(counts > 0, sums // np.maximum(counts, 1), self.entries)
        steps = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(2))
        self.entries = new
        for own, total in zip(steps, self.drift, strict=True):
            largest = own.argmax()
            others = np.full(len(own), own[largest])
            others[largest] = np.delete(own, largest).max(initial=0)
            total += own + others

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[np.ndarray, int]:
    """The first codebooks, and the length to which vectors are padded."""
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    few = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    x = integers(pa.array([r[0] for r in few], pa.list_(pa.float64())), width, scale, MOST).astype(np.int64)
    return x.reshape(len(few), parts, width // parts).transpose(1, 0, 2).copy(), width


def _changes(state: DataFrame, width: int) -> list:
    """The sums that left the tasks, added up: a row for each part position and entry."""
    total = F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)])
    return state.where("part IS NOT NULL").groupBy("part", "entry").agg(total.alias("sums")).collect()


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code, error of each whole row of rows (vec_id, embedding, label); and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is a byte")
    spark = rows.sparkSession
    small_batches(spark)
    rows = whole_rows(with_columns(rows, vec_id="bigint", embedding="array<double>", label="bigint"))
    start, width = _seeds(rows, parts, entries, scale)
    books, share = Codebooks(start), spark.sparkContext.broadcast
    if not start.shape[1]:
        return spark.createDataFrame([], CODED), books

    def begin(batches: Iterator[pa.RecordBatch], first: object = share(start)) -> Iterator[pa.RecordBatch]:
        schema, sums = to_arrow_schema(STATE), _Sums(first.value)
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(1), width, scale, MOST).astype(np.int64)
                yield _Block.first(batch.column(0).to_pylist(), batch.column(2).to_pylist(), x, first.value, sums).batch(schema)
        yield sums.batch(schema)

    state = materialise(rows.mapInArrow(begin, STATE), "blocks")
    for turn in range(1, rounds + 1):
        books.move(_changes(state, width // parts))
        now, last = share((books.entries, books.drift)), turn == rounds

        def go(batches: Iterator[pa.RecordBatch], now: object = now, last: bool = last) -> Iterator[pa.RecordBatch]:
            schema = to_arrow_schema(CODED if last else STATE)
            sums = _Sums(now.value[0])
            for row in rows_of(batches):
                block = _Block.read(row, now.value[0])
                block.turn(*now.value, sums)
                yield block.coded(now.value[0], schema) if last else block.batch(schema)
            if not last:
                yield sums.batch(schema)

        before = state
        blocks = state.where("part IS NULL").select("vec_id", "label", "vectors", "codes", "keys", "heaped")
        state = materialise(blocks.mapInArrow(go, CODED if last else STATE), "codes" if last else "blocks")
        dropped(before)
    return state, books


def codes(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each whole row."""
    coded, books = compress(rows)
    labels = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return lookup(coded, labels, "label", F.col("vec_id")).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
