"""Benchmark passages in documents, by Wu-Manber search over words.

Every run of 13 words of a benchmark item (or a whole shorter item) is a pattern. Patterns of one length share an automaton:
a table tells for each pair of neighbouring words how far the search may jump (a pair in no pattern: the whole length less
one), patterns are kept in buckets by their last pair and then by their first word, and a direct comparison confirms.

The items are the stated query set: they are read in blocks of at most block_words words, each block is broadcast on its
own, and every document is searched for all blocks. Documents are never shuffled.

Defined cases: a null or empty text has no words and is clean; a null or empty item has no window; items with one id count
once; a null item_id counts as an empty one; documents that repeat a doc_id each get their row; an empty benchmark hits
nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import small_batches, struct, with_columns

WINDOW = 13
#: Words of benchmark items in one broadcast block: some 20 MB with its patterns.
BLOCK_WORDS = 200_000
#: A document is contaminated if at least one in this many of its words is hit.
ONE_IN = 20

RESULT = struct(doc_id="bigint", n_words="bigint", n_hit="bigint", n_items="bigint", items_sha256="string", contaminated="boolean")

#: Lower-cases A-Z and makes a space of every byte that is part of no word; bytes from 0x80 belong to other letters.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WuManber:
    """Searches lists of words for patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}

    def _key(self, words: list[bytes], end: int):
        return (words[end - 1], words[end]) if self.block == 2 else words[end]

    def add(self, pattern: list[bytes], item: str) -> None:
        last = self.length - 1
        for end in range(self.block - 1, self.length):
            key = self._key(pattern, end)
            self.shift[key] = min(self.shift.get(key, self.jump), last - end)
        bucket = self.buckets.setdefault(self._key(pattern, last), {}).setdefault(pattern[0], [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence, in order."""
        shift, jump, length, n = self.shift, self.jump, self.length, len(words)
        pairs, at = self.block == 2, length - 1
        while at < n:
            key = (words[at - 1], words[at]) if pairs else words[at]
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, items in self.buckets[key].get(words[start], ()):
                if words[start : at + 1] == pattern:
                    yield start, items
            at += 1


def automata(items: list[tuple[str, list[bytes]]], window: int) -> list[WuManber]:
    made: dict[int, WuManber] = {}
    for item, words in items:
        length = min(window, len(words))
        if length:
            machine = made.setdefault(length, WuManber(length))
            for i in range(len(words) - length + 1):
                machine.add(words[i : i + length], item)
    return [made[k] for k in sorted(made)]


def search(words: list[bytes], machines: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans of words that are hit, and the items."""
    spans, items = [], set()
    for machine in machines:
        for start, found in machine.find(words):
            items |= found
            if spans and spans[-1][1] >= start >= spans[-1][0]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], start + machine.length))
            else:
                spans.append((start, start + machine.length))
    return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _blocks(benchmark: DataFrame, block_words: int) -> list:
    """Broadcasts of at most block_words words each (or one longer item)."""
    sc, blocks, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in with_columns(benchmark, item_id="string", text="string").toLocalIterator():
        words = words_of((row["text"] or "").encode())
        if block and size + len(words) > block_words:
            blocks.append(sc.broadcast(block))
            block, size = [], 0
        block.append((row["item_id"] or "", words))
        size += len(words)
    return [*blocks, sc.broadcast(block)] if block else blocks


class _Searcher:
    """Holds the automata of one block at a time; with a single block they are built once."""

    def __init__(self, blocks: list, window: int):
        self.blocks, self.window, self.held = blocks, window, None

    def __call__(self, texts: list[bytes | None]) -> list[tuple[int, int, set[str]]]:
        words = [words_of(t) for t in texts]
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        for k, block in enumerate(self.blocks):
            if self.held is None or self.held[0] != k:
                self.held = (k, automata(block.value, self.window))
            for i, w in enumerate(words):
                found, ids = search(w, self.held[1])
                spans[i] += found
                items[i] |= ids
        return [(len(w), covered(s), i) for w, s, i in zip(words, spans, items)]


def _contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and ONE_IN * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, schema = _Searcher(blocks, window), to_arrow_schema(RESULT)
        for batch in batches:
            found = searcher(batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([h for _, h, _ in found], pa.int64()),
                    pa.array([len(i) for _, _, i in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in found], pa.string()),
                    pa.array([_contaminated(n, h) for n, h, _ in found], pa.bool_()),
                ],
                schema=schema,
            )

    return with_columns(docs, doc_id="bigint", text="string").mapInArrow(run, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; one of them is text."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, block_words)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(blocks, window)
        for batch in batches:
            found = searcher(batch.column(at).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array([not _contaminated(n, h) for n, h, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
