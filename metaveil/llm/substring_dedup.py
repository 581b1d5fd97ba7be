"""Passages that a document with a smaller doc_id has too, by relative Lempel-Ziv parsing against indexed blocks.

The reference is what all documents hold, cut into blocks at places that their own words choose (the smallest hash among the
ANCHOR-word runs of each WINDOW-word window), so that equal passages are cut alike wherever they stand. A block holds the
windows with one anchor. The index has each distinct block of all documents once, with the place of its earliest owner.

* Every block of a document is looked up in the index by its anchor and hashes. Blocks that an earlier document has are matches.
* Where blocks share their anchor with others but not all their words, a copied passage may begin or end within them: these
  are the boundaries, and the windows there are looked up one by one, each with its earliest owner.
* A document is then parsed from left to right: matches that go on in the same place of the same source are one factor, as
  long as it goes; at each word the factor that reaches furthest is taken, and words that no match covers are literals. All
  factors are at least WINDOW words long; what they cover goes.

As equal windows have equal anchors, that covers every window of WINDOW words which also starts in a document with a smaller
doc_id, and no other. Words, blocks and windows are compared by 128-bit hashes.

Only hashes are shuffled, about one row for 20 words, and of the texts only those with shared anchors.

Defined cases: a null or empty text has no words; texts of fewer than WINDOW words keep them all; a null doc_id comes before
all others; rows with one doc_id don't take words from each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.bitmap import bitmap
from metaveil.llm.common import materialise, small_batches, struct, with_columns

WINDOW, ANCHOR = 50, 10
FIRST_ID = -(1 << 63)

PARSED = struct(
    doc="bigint", n_words="bigint", sha256="string", mark="bigint",
    anchors="array<bigint>", ones="array<bigint>", twos="array<bigint>", starts="array<int>", ends="array<int>",
)
TEXTS = struct(doc="bigint", mark="bigint", text="string")
WINDOWS = struct(doc="bigint", mark="bigint", one="bigint", two="bigint", start="int")
KEPT = struct(doc="bigint", mark="bigint", n_removed="bigint", kept_sha256="string")

#: Odd bases of two polynomial hashes, and their inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hasher:
    """Hashes of any run of a text's words."""

    def __init__(self):
        self.words = _Hashes()
        self.powers = [np.ones(1, np.uint64) for _ in (*BASES, *INVERSES)]

    def load(self, words: list[bytes]) -> None:
        n = len(words)
        if n >= len(self.powers[0]):
            size = max(n + 1, 4096, 2 * len(self.powers[0]))
            for k, base in enumerate((*BASES, *INVERSES)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self.powers[k] = np.multiply.accumulate(steps)
        values = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        self.sums = []
        for k, v in enumerate((values, _mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(v * self.powers[k][:n], out=sums[1:])
            self.sums.append(sums)

    def runs(self, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.sums[k][ends] - self.sums[k][starts]) * self.powers[2 + k][starts])


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost smallest value in each run of that width."""
    index, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = index[:-size], index[size:]
        index = np.where(values[a] <= values[b], a, b)
        size *= 2
    if width > size:
        a, b = index[: -(width - size)], index[width - size :]
        index = np.where(values[a] <= values[b], a, b)
    return index


def blocks(hasher: Hasher, n: int) -> tuple[np.ndarray, ...]:
    """anchor, two hashes of the block, first and last window start: of the text that hasher has loaded."""
    starts = np.arange(n - ANCHOR + 1)
    grams = hasher.runs(starts, starts + ANCHOR, 0)
    chosen = smallest(grams, WINDOW - ANCHOR + 1)
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    first, last = np.concatenate(([0], cuts)), np.concatenate((cuts - 1, [len(chosen) - 1]))
    at = chosen[first]
    shape = ((at - first) * 128 + (last - first)).astype(np.uint64)
    one, two = (_mix(hasher.runs(first, last + WINDOW, k) + shape * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1))
    return grams[at], one, two, first, last


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _mark(sha: str) -> int:
    return int.from_bytes(bytes.fromhex(sha[:16]), "big", signed=True)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, schema = Hasher(), to_arrow_schema(PARSED)
    for batch in batches:
        n_words, shas, parts = [], [], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            words = _words(text)
            n_words.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if len(words) >= WINDOW:
                hasher.load(words)
                parts.append(blocks(hasher, len(words)))
            else:
                parts.append((np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int64),) * 2)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32))
        lists = []
        for k in range(5):
            flat = np.concatenate([p[k] for p in parts])
            flat = flat.astype(np.int32) if k > 2 else flat.view(np.int64)
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(flat)).cast(schema.field(4 + k).type))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(shas), pa.array([_mark(s) for s in shas], pa.int64()), *lists], schema=schema
        )


def _pick(bits):
    """The texts of documents that the bitmap holds: doc, text to doc, mark, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(TEXTS)
        for batch in batches:
            batch = batch.filter(pa.array(bits.holds(batch.column(0).to_numpy())))
            if batch.num_rows:
                texts = [b" ".join(_words(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                marks = [_mark(hashlib.sha256(t).hexdigest()) for t in texts]
                joined = pa.array(texts, pa.binary()).cast(schema.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), joined], schema=schema)

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, text, ranges of window starts to windows."""
    hasher, schema = Hasher(), to_arrow_schema(WINDOWS)
    for batch in batches:
        for doc, mark, text, ranges in zip(*(batch.column(k) for k in range(4))):
            hasher.load(text.as_py().encode().split())
            starts = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in ranges.as_py()]))
            one, two = (hasher.runs(starts, starts + WINDOW, k).view(np.int64) for k in (0, 1))
            same = [pa.array(np.full(len(starts), x.as_py(), np.int64)) for x in (doc, mark)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(one), pa.array(two), pa.array(starts.astype(np.int32))], schema=schema)


def factors(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The greedy parse: (start, end, source, place in the source) from left to right, of matches (start, end, source, place)."""
    runs: dict[tuple[int, int], list[list[int]]] = {}
    for start, end, source, place in sorted(matches):
        own = runs.setdefault((source, place - start), [])
        if own and start <= own[-1][1]:
            own[-1][1] = max(own[-1][1], end)  # the copy goes on
        else:
            own.append([start, end])
    copies = sorted((start, end, source, shift) for (source, shift), own in runs.items() for start, end in own)
    parsed, at, k = [], 0, 0
    best: tuple[int, int, int] | None = None  # end, source, shift of the copy that reaches furthest from here
    while k < len(copies) or best and best[0] > at:
        while k < len(copies) and copies[k][0] <= at:
            start, end, source, shift = copies[k]
            best = max(best or (end, source, shift), (end, source, shift))
            k += 1
        if best and best[0] > at:
            parsed.append((at, best[0], best[1], at + best[2]))
            at = best[0]
        elif k < len(copies):
            at = copies[k][0]  # literals up to the next copy
    return parsed


def _literals(n: int, parsed: list[tuple[int, int, int, int]]) -> list[int]:
    """The words that no factor holds."""
    at, left = 0, []
    for start, end, _, _ in [*parsed, (n, n, 0, 0)]:
        left.extend(range(at, start))
        at = end
    return left


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, text, matches to what the parse keeps."""
    schema = to_arrow_schema(KEPT)
    for batch in batches:
        removed, shas = [], []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = text.encode().split()
            kept = _literals(len(words), factors([(s["start"], s["end"], s["owner"], s["at"]) for s in spans]))
            removed.append(len(words) - len(kept))
            shas.append(hashlib.sha256(b" ".join([words[i] for i in kept])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas)], schema=schema)


def _sources(docs: DataFrame) -> DataFrame:
    return with_columns(docs, doc_id="bigint", text="string").select(F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc"), "text")


def factor(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """parsed (one row for each document), texts (doc, mark, text) and matches (doc, mark, start, end, owner, at) with earlier documents.

    A document is known by doc and mark, a hash of its words: rows alike in both are factored once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parsed = materialise(_sources(docs).mapInArrow(_parse, PARSED), "parsed")
    zipped = F.arrays_zip("anchors", "ones", "twos", "starts", "ends")
    seen = parsed.select("doc", "mark", F.explode(zipped).alias("b")).select(
        "doc", "mark", F.col("b.anchors").alias("anchor"), F.col("b.ones").alias("one"), F.col("b.twos").alias("two"),
        F.col("b.starts").alias("first"), F.col("b.ends").alias("last"),
    )
    reference = seen.groupBy("anchor", "one", "two").agg(F.min("doc").alias("owner"), F.min_by("first", "doc").alias("at"), F.max("doc").alias("latest"))
    shared = reference.groupBy("anchor").agg(F.count("*").alias("variants"), F.min("owner").alias("low"), F.max("latest").alias("high"))
    shared = shared.where("low < high").select("anchor", "variants")
    reference = materialise(reference.join(shared, "anchor").select("anchor", "one", "two", "owner", "at", "variants"), "reference")
    met = seen.join(reference, ["anchor", "one", "two"]).where("doc > owner OR variants > 1")
    met = materialise(met.select("doc", "mark", "first", "last", (F.col("doc") > F.col("owner")).alias("copied"), "owner", "at"), "met")
    bits = bitmap(met, "doc")
    texts = _sources(docs).mapInArrow(_pick(bits), TEXTS)
    texts = materialise(texts, "texts")
    once = texts.dropDuplicates(["doc", "mark"])
    ranges = met.where("NOT copied").groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    windows = once.join(ranges, ["doc", "mark"]).select("doc", "mark", "text", "ranges").mapInArrow(_window_rows, WINDOWS)
    windows = materialise(windows, "windows")
    owners = windows.groupBy("one", "two").agg(F.min("doc").alias("owner"), F.min_by("start", "doc").alias("at"), F.max("doc").alias("latest")).where("owner < latest")
    owners = owners.drop("latest")
    partly = windows.join(owners, ["one", "two"]).where("doc > owner").select("doc", "mark", "start", (F.col("start") + WINDOW).alias("end"), "owner", "at")
    whole = met.where("copied").select("doc", "mark", F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end"), "owner", "at")
    return parsed, once, whole.union(partly)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text)."""
    parsed, texts, spans = factor(docs)
    by_doc = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "end", "owner", "at")).alias("spans"))
    cut = texts.join(by_doc, ["doc", "mark"]).select("doc", "mark", "text", "spans").mapInArrow(_cut, KEPT)
    kept = parsed.select("doc", "mark", "n_words", "sha256").join(cut, ["doc", "mark"], "left")
    return kept.select(
        F.when(F.col("doc") != FIRST_ID, F.col("doc")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )
