"""Lines that are nearly the same as an earlier line, by an exact set-similarity join.

A line is the set of its words; of two lines whose Jaccard similarity is at least 0.8 the later one (by doc_id, then line
number) goes, whether or not the earlier one stays. Lines of the same words in the same order are copies: they meet by a
128-bit hash and need no join. For all others:

* words are ordered by rarity: all words of all lines are counted in a table of fixed size by hash, which is broadcast;
* only a prefix of the rarest words (n - ceil(0.8 n) + 1 of n) can be all that similar lines share, so lines meet by the words
  of their prefixes, shuffled by word; frequent words are split into parts, and every two parts meet in a task of their own;
* there, copies become one, and the length filter, the positional filter and a filter on signatures of 128 or 256 bits drop what can't
  reach 0.8;
* each line keeps the nearest candidates (KEEP, by signature) in each meeting; the word sets of candidates are read from the texts, and a
  join with both sets verifies them exactly. Lines that no verified candidate removes and that had more candidates are joined
  by their prefixes with all lines, without a limit.

Texts are read and tokenised again in each pass (see words.py), for their sets would be larger than they are.

Defined cases: null and empty texts have one empty line; lines without words always stay; rows with one doc_id are ordered by
the MD5 of their text, a null text first; a null doc_id comes first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.bitmap import Bitmap, bitmap
from metaveil.llm.common import dropped, materialise, small_batches, struct, with_columns
from metaveil.llm.words import Tokens, mix

RARITY_BITS = 18
KEEP, DOUBTFUL, PART_ROWS = 2, 64, 20_000
#: Lines of more words have signatures of 256 bits, others of 128; and lines that they are trusted for.
LONG, SURE = 96, 192
PART_BUCKETS = 1024
#: Most words and most copied lines that are known by name in a broadcast. Any other word has at most 1 / MOST of all rows.
MOST = 1 << 18
#: Copies from which on a line is known by name.
COPIES = 64
#: Whether the sets a and b of distinct words reach the similarity.
SAME = "9 * size(array_intersect(a, b)) >= 4 * (size(a) + size(b))"
#: Meetings of up to so many lines are taken together.
SMALL = 256

#: A row for each line; for each document (key -2 - place; one: how many lines); for each thousand buckets (key -1; one: which).
LINES = struct(key="bigint", one="bigint", two="bigint", counts="binary")
SUMS = struct(part="bigint", counts="binary")
COUNTS = struct(word="bigint", n="bigint")
PREFIXES = struct(meeting="bigint", shape="bigint", key="bigint", line="bigint", bits="bigint", bits2="bigint", bits3="bigint", bits4="bigint")
CANDIDATES = struct(later="bigint", earlier="bigint", apart="int", more="boolean")
SETS = struct(key="bigint", words="array<bigint>")
WORD_SETS = struct(word="bigint", key="bigint", words="array<bigint>")


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """place, doc_id, text: place orders documents; and how many bits a line's number takes."""
    rows = with_columns(docs, doc_id="bigint", text="string")
    n, ids, low, high = rows.agg(F.count("*"), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    bits = 31  # no text has more lines
    if n and n == ids and high - low < 1 << 31:
        return rows.select((F.col("doc_id") - low).alias("place"), "doc_id", "text"), bits
    if n >> 31:
        bits = max(1, (rows.agg(F.max(F.octet_length("text"))).first()[0] or 0).bit_length())
    if n >> (62 - bits):
        raise ValueError("documents and their lines can't be numbered in 62 bits")
    ordered = rows.withColumn("digest", F.md5("text")).repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    at = F.monotonically_increasing_id()
    ordered = materialise(ordered.select(F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "doc_id", "text"), "placed")
    offset, offsets = 0, []
    for part, size in sorted(ordered.groupBy("part").count().collect()):  # one row for each partition
        offsets.append((part, offset))
        offset += size
    offsets = rows.sparkSession.createDataFrame(offsets, "part bigint, offset bigint")
    return ordered.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("at")).alias("place"), "doc_id", "text"), bits


class Lines:
    """The lines with words of batches of (place, text)."""

    def __init__(self, bits: int):
        self.bits, self.tokens = bits, Tokens()

    def groups(self, batch: pa.RecordBatch, among: Bitmap | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """keys of lines, the number of words of each, and the words' hashes, in order; of all lines, or of those whose keys are among."""
        places = batch.column(0).to_numpy()
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        first = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])
        joined = b"\n".join(texts)
        keys = np.repeat((places << self.bits) - first[:-1], np.diff(first)) + np.arange(first[-1])
        if among is not None:
            chosen = np.flatnonzero(among.holds(keys))
            lines = joined.split(b"\n")
            joined, keys = b"\n".join([lines[i] for i in chosen.tolist()]), keys[chosen]
        held, before, after = [], 0, 0
        for at, starts, _, hashes in self.tokens.chunks(joined):
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8, self.tokens.read, at) == 10)
            before, after = after, after + len(ends)
            held.append((before + np.searchsorted(ends, starts), hashes))
            if len(ends):  # lines that went on into this chunk end in it
                line, hashes = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(line, after))
                held = [(line[cut:], hashes[cut:])]
                if cut:
                    yield self._counted(keys, line[:cut], hashes[:cut])
        if held:
            line, hashes = (np.concatenate(x) for x in zip(*held))
            if len(line):
                yield self._counted(keys, line, hashes)

    @staticmethod
    def _counted(keys: np.ndarray, line: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        return keys[line[starts]], np.diff(np.append(starts, len(line))), hashes

    def named(self, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line as a sequence of words."""
        starts = np.cumsum(counts) - counts
        at = np.arange(len(hashes)) - np.repeat(starts, counts)
        one, two = (np.add.reduceat(h * p, starts) for h, p in zip((hashes, hashes ^ (hashes >> np.uint64(29))), self.tokens.factors(at)))
        return mix(one + counts.astype(np.uint64)).view(np.int64), mix(two ^ counts.astype(np.uint64)).view(np.int64)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _line_rows(bits: int):
    """key and name of each line, the number of lines of each text, and at the end the counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, schema, total = Lines(bits), to_arrow_schema(LINES), np.zeros(1 << RARITY_BITS, np.int64)

        def rows(keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(one), pa.array(two), pa.nulls(len(keys), pa.binary())], schema=schema)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n_lines = np.array([(t or b"").count(b"\n") + 1 for t in texts], np.int64)
            yield rows(-2 - batch.column(0).to_numpy(), n_lines, n_lines)
            for keys, counts, hashes in lines.groups(batch):
                total += np.bincount(_buckets(hashes), minlength=len(total))
                yield rows(keys, *lines.named(counts, hashes))
        parts = range(len(total) // PART_BUCKETS)
        sums = [total[k * PART_BUCKETS : (k + 1) * PART_BUCKETS].tobytes() for k in parts]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array(parts, pa.int64()), pa.array(sums, pa.binary())], schema=schema)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, counts: the sums of each part's counts."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int64()), pa.array([t.tobytes() for t in total.values()], pa.binary())], schema=to_arrow_schema(SUMS))


class _Order:
    """What tasks know of words and lines: how rare the buckets of words are, frequent words, and lines with many copies."""

    def __init__(self, total: np.ndarray, copied: tuple[np.ndarray, ...], part_rows: int):
        self.rank = np.empty(len(total), np.uint64)
        self.rank[np.argsort(total, kind="stable")] = np.arange(len(total), dtype=np.uint64)
        self.often, self.copied, self.part_rows = total, copied, part_rows
        self.words = self.rows = None

    def parts(self, words: np.ndarray) -> np.ndarray:
        """Into how many parts the rows of each word are split."""
        often = self.often[_buckets(words)]
        if self.words is not None and len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            often = np.where(self.words[at] == words, self.rows[at], 1)
        elif self.words is not None:
            often = np.ones_like(often)
        return -(-often // self.part_rows)

    def needless(self, keys: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which lines are later copies of a line with many."""
        ones, twos, firsts = self.copied
        if not len(ones):
            return np.zeros(len(one), bool)
        at = np.minimum(np.searchsorted(ones, one), len(ones) - 1)
        return (ones[at] == one) & (twos[at] == two) & (firsts[at] != keys)


class _Prefixes:
    """Prefixes of the lines of a group."""

    def __init__(self, order: _Order, bits: int):
        self.order, self.lines = order, Lines(bits)

    def of(self, batch: pa.RecordBatch, only: Bitmap | None = None) -> Iterator[tuple[np.ndarray, ...]]:
        """word, line (index into the others), place in the line's order; key, number of distinct words, name, signature and words of lines."""
        order = self.order
        for keys, counts, hashes in self.lines.groups(batch):
            one, two = self.lines.named(counts, hashes)
            needed = ~order.needless(keys, one, two)
            if only is not None:  # lines without any of these words
                needed &= np.logical_or.reduceat(only.holds(hashes), np.cumsum(counts) - counts)
            hashes, keys, one, counts = hashes[np.repeat(needed, counts)], keys[needed], one[needed], counts[needed]
            if not len(keys):
                continue
            n, line, hashes = _distinct(counts, hashes, order.rank)
            starts = np.cumsum(n) - n
            bit = np.uint64(1) << (hashes >> np.uint64(7) & np.uint64(63))
            word = (hashes >> np.uint64(13)).astype(np.int64) & np.where(n > LONG, 3, 1)[line]
            bits = [np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), starts) for k in range(4)]
            at = np.arange(len(hashes)) - starts[line]
            use = np.flatnonzero((at < (n - (4 * n + 4) // 5 + 1)[line]) & (order.often[_buckets(hashes)] > 1))
            yield hashes[use], line[use], at[use], keys, n, one, bits, hashes


def _distinct(counts: np.ndarray, hashes: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct words each line has, and the words' lines and hashes, rarest first."""
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    if rank is None or len(counts) >> 22:
        key = hashes
        order = np.lexsort((hashes, line)) if rank is None else np.lexsort((hashes, rank[_buckets(hashes)], line))
    else:
        key = line << np.uint64(42) | rank[_buckets(hashes)] << np.uint64(24) | (hashes & np.uint64(0xFFFFFF))
        order = np.argsort(key, kind="stable")
        near = key[order]
        if ((near[1:] == near[:-1]) & (hashes[order[1:]] != hashes[order[:-1]])).any():
            order = np.lexsort((hashes, key))
    hashes, line = hashes[order], line[order].astype(np.int64)
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1]))
    hashes, line = hashes[new], line[new]
    return np.bincount(line, minlength=len(counts)), line, hashes


def _frequent_rows(order, bits: int):
    """How often words of crowded buckets stand in prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _Prefixes(order.value, bits)
        for batch in batches:
            for words, *_ in prefixes.of(batch):
                words, n = np.unique(words[order.value.often[_buckets(words)] > order.value.part_rows], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], schema=to_arrow_schema(COUNTS))

    return run


def _word_sets(keys: np.ndarray, n: np.ndarray, hashes: np.ndarray, words: np.ndarray, line: np.ndarray) -> pa.RecordBatch:
    """A row for each word (of that line), with the line's whole set."""
    schema = to_arrow_schema(WORD_SETS)
    starts = np.cumsum(n) - n
    sizes = n[line]
    offsets = np.append(0, np.cumsum(sizes))
    flat = hashes[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts[line], sizes)]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64))).cast(schema.field(2).type)
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(keys[line]), lists], schema=schema)


def _open_sets(order):
    """Rows (key, words) to a row for each word of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            counts = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(keys):
                continue
            n, line, hashes = _distinct(counts, batch.column(1).flatten().to_numpy().view(np.uint64), order.value.rank)
            use = np.flatnonzero(np.arange(len(hashes)) - (np.cumsum(n) - n)[line] < (n - (4 * n + 4) // 5 + 1)[line])
            yield _word_sets(keys, n, hashes, hashes[use], line[use])

    return run


def _met_sets(order, bits: int, only: Bitmap):
    """The lines with one of some words in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = _Prefixes(order.value, bits)
        for batch in batches:
            for words, line, _, keys, n, _, _, hashes in prefixes.of(batch, only):
                use = only.holds(words)
                yield _word_sets(keys, n, hashes, words[use], line[use])

    return run


def _prefix_rows(order, bits: int):
    """A row for each word of a line's prefix and meeting of that word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, schema = _Prefixes(order.value, bits), to_arrow_schema(PREFIXES)
        for batch in batches:
            for words, line, at, keys, n, one, signature, _ in prefixes.of(batch):
                parts = order.value.parts(words)
                meeting = words
                if (parts > 1).any():
                    row = np.repeat(np.arange(len(words)), parts)
                    other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    words, line, at, parts = words[row], line[row], at[row], parts[row]
                    own = (mix(one.view(np.uint64))[line] % parts.astype(np.uint64)).astype(np.int64)
                    both = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64)
                    meeting = np.where(parts > 1, mix(words + (both + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), words)
                columns = [meeting.view(np.int64), n[line] << 32 | at, keys[line], one[line], *(bits[line].view(np.int64) for bits in signature)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return run


def _apart(n, bits, i, j) -> np.ndarray:
    """At least how many words each pair (i, j) has apart, by signatures; that of a long line is folded where the other is short."""
    same = (n[i] > LONG) == (n[j] > LONG)
    plain = sum(np.bitwise_count(b[i] ^ b[j]).astype(np.int32) for b in bits)
    folded = sum(np.bitwise_count((bits[k][i] | bits[k + 2][i]) ^ (bits[k][j] | bits[k + 2][j])).astype(np.int32) for k in (0, 1)) if not same.all() else plain
    return np.where(same, plain, folded)


def _similar(key, n, at, bits, i, j) -> tuple[np.ndarray, ...]:
    """Those of the pairs (i, j) of rows with one word that may reach the similarity, how far they are apart at least, and if that is little."""
    both = n[i] + n[j]
    need = (4 * both + 8) // 9
    ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (key[i] != key[j])
    ok &= np.minimum(n[i] - at[i], n[j] - at[j]) >= need
    i, j, most = i[ok], j[ok], (both - 2 * need)[ok]
    apart = _apart(n, bits, i, j)
    ok = apart <= most
    i, j, apart, most = i[ok], j[ok], apart[ok], most[ok]
    return i, j, apart, (4 * apart <= most) & (np.maximum(n[i], n[j]) <= SURE)  # signatures of longer lines say little


class _Meeting:
    """Collects pairs (later, earlier) and keeps the nearest few of each later line, more of them if none is really near."""

    def __init__(self, keep: int, doubtful: int):
        self.keep, self.doubtful, self.pairs, self.size = keep, doubtful, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray, near: np.ndarray) -> None:
        later, earlier = np.maximum(a, b), np.minimum(a, b)
        if len(later):
            self.pairs.append(np.stack([later, earlier, apart, np.zeros_like(later), near]))
            self.size += len(later)
            if self.size > 500_000:
                self.pairs = [self.kept()]
                self.size = self.pairs[0].shape[1]

    def kept(self) -> np.ndarray:
        """later, earlier, apart, more, near."""
        if not self.pairs:
            return np.zeros((5, 0), np.int64)
        found = np.concatenate(self.pairs, axis=1)
        found = found[:, np.lexsort((-found[3], found[1], found[2], found[0]))]
        found = found[:, np.append(True, (found[:2, 1:] != found[:2, :-1]).any(0))]
        first = np.append(True, found[0, 1:] != found[0, :-1])
        group = np.cumsum(first) - 1
        rank = np.arange(found.shape[1]) - np.flatnonzero(first)[group]
        near, more = np.logical_or.reduceat(found[4:2:-1] > 0, np.flatnonzero(first), axis=1)
        most = np.where(near, self.keep, self.doubtful)
        found[3] = (more | (np.bincount(group) > most))[group]
        return found[:, rank < most[group]]


def _candidates(keep: int, doubtful: int):
    """Rows ordered by meeting to candidate pairs. Holds one meeting at a time, and a few thousand rows more."""

    def met(meeting: np.ndarray, shape: np.ndarray, key: np.ndarray, one: np.ndarray, *bits: np.ndarray) -> np.ndarray:
        group = np.cumsum(np.append(False, meeting[1:] != meeting[:-1]))
        if len(group) >> 20 or (shape >> 52).any():
            order = np.lexsort((one, shape >> 32, group))
        else:
            order = np.argsort(group << 44 | shape >> 32 << 24 | one & 0xFFFFFF, kind="stable")
        meeting, shape, key, one, *bits = (c[order] for c in (meeting, shape, key, one, *bits))
        new = np.flatnonzero(np.append(True, (meeting[1:] != meeting[:-1]) | (shape[1:] != shape[:-1]) | (one[1:] != one[:-1])))
        key = np.minimum.reduceat(key, new)  # copies are one, by their first line
        meeting, shape, *bits = (c[new] for c in (meeting, shape, *bits))
        n, at, bits = shape >> 32, shape & 0xFFFFFFFF, [b.view(np.uint64) for b in bits]
        starts = np.flatnonzero(np.append(True, meeting[1:] != meeting[:-1]))
        sizes = np.diff(np.append(starts, len(meeting)))
        found = _Meeting(keep, doubtful)
        i, step = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes)), 1
        while len(i):  # rows against the row that is step rows on, as long as that isn't too long
            i = i[i + step < len(meeting)]
            i = i[(meeting[i] == meeting[i + step]) & (5 * n[i] >= 4 * n[i + step])]
            a, b, apart, near = _similar(key, n, at, bits, i, i + step)
            found.add(key[a], key[b], apart, near)
            step += 1
        for k in np.flatnonzero(sizes > SMALL):
            a, end = starts[k], starts[k] + sizes[k]
            while a < end:  # rows a to b against all from a on that aren't too long
                b = min(end, a + 128)
                top = a + np.searchsorted(n[a:end], n[b - 1] * 5 // 4, "right")
                i, j = np.meshgrid(np.arange(a, b), np.arange(a, top), indexing="ij")
                i, j, apart, near = _similar(key, n, at, bits, i[j > i], j[j > i])
                found.add(key[i], key[j], apart, near)
                a = b
        return found.kept()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, rows = to_arrow_schema(CANDIDATES), [], 0

        def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
            later, earlier, apart, more, _ = met(*columns)
            return pa.RecordBatch.from_arrays([pa.array(later), pa.array(earlier), pa.array(apart.astype(np.int32)), pa.array(more.astype(bool))], schema=schema)

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(8)])
            rows += batch.num_rows
            if rows > 100_000:
                columns = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))[-1])
                if cut:
                    yield pairs([c[:cut] for c in columns])
                held, rows = [[c[cut:] for c in columns]], rows - cut
        if rows:
            yield pairs([np.concatenate(c) for c in zip(*held)])

    return run


def _set_rows(bits: int, among: Bitmap):
    """The distinct words of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, schema = Lines(bits), to_arrow_schema(SETS)
        for batch in batches:
            for keys, counts, hashes in lines.groups(batch, among):
                n, _, hashes = _distinct(counts, hashes, None)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64))).cast(schema.field(1).type)
                yield pa.RecordBatch.from_arrays([pa.array(keys), lists], schema=schema)

    return run


def _order(lines: DataFrame, groups: DataFrame, texts: DataFrame, bits: int, part_rows: int, exact: bool | None):
    """The broadcast order of words. exact: count the words of prefixes one by one; done where buckets say little."""
    counts = lines.where("key = -1").select(F.col("one").alias("part"), "counts").repartition("part").mapInArrow(_summed, SUMS).collect()
    total = np.zeros((1 << RARITY_BITS - 10, PART_BUCKETS), np.int64)
    for part, sums in counts:  # 256 rows
        total[part] = np.frombuffer(sums, np.int64)
    total = total.reshape(-1)
    copied = groups.where(F.col("n") >= COPIES).orderBy(F.desc("n")).limit(MOST).select("one", "two", "key").toArrow()
    by_name = np.argsort(copied.column("one").to_numpy(), kind="stable")
    order = _Order(total, tuple(copied.column(k).to_numpy()[by_name] for k in range(3)), part_rows)
    context = lines.sparkSession.sparkContext
    if exact or exact is None and total.sum() >> RARITY_BITS > part_rows // 8:
        found = texts.mapInArrow(_frequent_rows(context.broadcast(order), bits), COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
        found = found.where(F.col("n") > part_rows).orderBy(F.desc("n")).limit(MOST).toArrow()
        words = found.column("word").to_numpy().view(np.uint64)
        by_word = np.argsort(words)
        order.words, order.rows = words[by_word], found.column("n").to_numpy()[by_word]
    return context.broadcast(order)


def _join(texts: DataFrame, order, bits: int, keep: int, doubtful: int) -> DataFrame:
    """Keys of the first lines of their kind that an earlier line of another kind removes."""
    meetings = texts.mapInArrow(_prefix_rows(order, bits), PREFIXES).repartition("meeting").sortWithinPartitions("meeting")
    found = meetings.mapInArrow(_candidates(keep, doubtful), CANDIDATES)
    pairs = materialise(found.groupBy("later", "earlier").agg(F.min("apart").alias("apart"), F.max("more").alias("more")), "candidates")
    needed = pairs.select(F.col("later").alias("key")).union(pairs.select("earlier"))
    sets = materialise(texts.mapInArrow(_set_rows(bits, bitmap(needed, "key")), SETS), "sets")
    left = sets.select(F.col("key").alias("later"), F.col("words").alias("a"))
    right = sets.select(F.col("key").alias("earlier"), F.col("words").alias("b"))

    def similar(some: DataFrame) -> DataFrame:
        same = some.join(left, "later").join(right, "earlier").where(SAME)
        return materialise(same.select(F.col("later").alias("key")).distinct(), "similar")

    # the nearest candidate is tried first, the others where it fails
    first = similar(pairs.groupBy("later").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier")))
    rest = pairs.select("later", "earlier").join(first.withColumnRenamed("key", "later"), "later", "left_anti")
    verified = first.union(similar(rest))
    open_ones = pairs.where("more").select(F.col("later").alias("key")).distinct().join(verified, "key", "left_anti")
    open_ones = materialise(sets.join(open_ones, "key", "left_semi"), "open")
    dropped(pairs)
    dropped(sets)
    if open_ones.isEmpty():
        return verified
    asked = materialise(open_ones.mapInArrow(_open_sets(order), WORD_SETS), "open-words")
    met = texts.mapInArrow(_met_sets(order, bits, bitmap(asked.select("word").distinct(), "word")), WORD_SETS)
    asked = asked.select("word", F.col("key").alias("later"), F.col("words").alias("a"))
    met = met.select("word", F.col("key").alias("earlier"), F.col("words").alias("b"))
    again = asked.join(met, "word").where("earlier < later AND 5 * size(a) >= 4 * size(b) AND 5 * size(b) >= 4 * size(a)").where(SAME)
    return verified.union(materialise(again.select(F.col("later").alias("key")).distinct(), "similar"))


def find(docs: DataFrame, keep: int = KEEP, doubtful: int = KEEP * DOUBTFUL, part_rows: int = PART_ROWS, exact: bool | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_similar, removed for each row of docs (doc_id, text).

    removed: the numbers of the lines that go, from 0, comma-joined; n_similar: how many of them are no copy of an earlier line.
    """
    small_batches(docs.sparkSession)
    placed, bits = _placed(docs)
    texts = placed.select("place", "text")
    read = materialise(texts.mapInArrow(_line_rows(bits), LINES), "lines")
    lines = read.where("key >= 0")
    groups = materialise(lines.groupBy("one", "two").agg(F.min("key").alias("key"), F.count("*").alias("n")), "line-kinds")
    similar = _join(texts, _order(read, groups, texts, bits, part_rows, exact), bits, keep, doubtful)
    copied = groups.where("n > 1").select("one", "two", F.col("key").alias("first"))
    copies = lines.join(copied, ["one", "two"]).where("key <> first").select("key", F.lit(None).cast("int").alias("near"))
    gone = copies.union(similar.select("key", F.lit(1)))
    place, number = F.shiftright("key", bits).alias("place"), F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("number")
    counted = read.where("key < -1").select((-2 - F.col("key")).alias("place"), F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("int").alias("near"), F.col("one").alias("n_lines"))
    by_doc = counted.union(gone.select(place, number, "near", F.lit(0).cast("bigint"))).groupBy("place").agg(
        F.max("n_lines").alias("n_lines"), F.count("number").alias("n_removed"), F.count("near").alias("n_similar"), F.array_join(F.array_sort(F.collect_list("number")), ",").alias("removed")
    )
    return placed.select("place", "doc_id").join(by_doc, "place").select("doc_id", "n_lines", "n_removed", "n_similar", "removed")
