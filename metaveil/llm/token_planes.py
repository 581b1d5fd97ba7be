"""Token ids as shuffled bit or byte planes.

Documents are put in order of doc_id by a range partitioning (no global sort in one task), each partition (a shard) is
tokenised as one stream of ids, the stream is cut into blocks of a fixed number of ids, every block is transposed into
bit or byte planes, and each plane is compressed with zstandard on its own.

The format, under one path:

* ``blocks``: one row for each block: ``shard, block, first`` (ids of the shard before it), ``n_ids, width`` (planes),
  ``kind`` ("bit" or "byte"), ``planes`` (compressed, lowest first), and the pieces of documents in the block as parallel
  arrays ``doc_no, doc_ids, piece_ids``;
* ``index``: one row for each block: ``shard, block, start`` (ids of the whole data set before it), ``n_ids``.

Both are written by Spark's own writer with its commit protocol, so a lost executor's shard is simply written again,
any file system that Spark reaches will do, and nothing passes through the driver. Planes above the highest used bit
are not stored.

Defined cases: a null text is empty, an empty text holds the end id alone, a null doc_id sorts first, rows with the same
doc_id are documents of their own in the order of their texts, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType

from metaveil.llm.common import scratch, small_batches, struct, with_columns

BLOCK_IDS = 1 << 16
END_ID = 0
CACHE_WORDS = 600_000

BLOCKS = struct(
    shard="int", block="int", first="bigint", n_ids="int", width="int", kind="string", planes="array<binary>",
    doc_no="array<bigint>", doc_ids="array<bigint>", piece_ids="array<int>",
)
PIECES = struct(shard="int", doc_no="bigint", doc_id="bigint", first="bigint", n_ids="int", crc="bigint")
IDS = struct(start="bigint", ids="array<bigint>")


#: Bytes of text whose words are looked up together.
TOGETHER = 8 << 20
#: Different runs of punctuation behind words that a worker remembers.
MOST_MARKS = 4096
#: Letters from here on are left to the tokenizer, whose tables of letters may be older or younger than Python's.
PLAIN_END = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it is printable, else the next from U+0100 on."""
    letters, other = {}, 0x100
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            letters[byte] = chr(byte)
        else:
            letters[byte], other = chr(other), other + 1
    return letters


class _Unsplit(Exception):
    """The text can't be encoded word by word."""


class Words(dict):
    """The ids of words with a space (or nothing) before them, made when they are first asked for."""

    def __init__(self, tokenizer, space: str, most: int, longest: int):
        self.encode, self.tokenize = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.space, self.first, self.most, self.longest = space, space.translate(self.letters), most, longest
        self.older: dict[str, bytes] = {}
        self.heads = self
        self.marks = {mark: self.whole(mark) for mark in ".,\n"}

    def mark(self, run: str) -> bytes:
        """The ids of a run of punctuation behind letters, which is a pre-token of its own."""
        ids = self.marks.get(run)
        if ids is None:
            ids = self.whole(run)
            if len(self.marks) < MOST_MARKS:
                self.marks[run] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.encode([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > self.longest:
            raise _Unsplit
        if not word.isalpha():  # made of words that are remembered, if it is plain
            if not word or word[0].isspace():
                raise _Unsplit
            stem = word.rstrip(string.punctuation)
            if stem.isalpha():
                return self[stem] + self.mark(word[len(stem) :])
            line, feed, head = word.partition("\n")
            if feed and self.plain(line) and self.plain(head):
                return self[line] + self.marks[feed] + self.heads[head]
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def made(self, word: str) -> bytes:
        if not word.isalpha() or not word.isascii() and max(word) >= PLAIN_END:
            return self.whole(self.space + word)
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(self.first + word)]).tobytes()

    @staticmethod
    def plain(word: str) -> bool:
        """Letters, perhaps with punctuation behind them."""
        return word.rstrip(string.punctuation).isalpha()


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer; remembers the ids of words, as words don't depend on their neighbours.

    A space followed by anything but white space always starts a new pre-token of this kind of tokenizer, so the text
    between two such spaces can be encoded by itself; so can letters and the run of punctuation or single line feed after them.
    Words of letters go to the tokenizer's model at once, others to the whole tokenizer. Texts with other runs of spaces, or
    with a very long word, are encoded whole. Words are remembered in two generations of at most cache_words each: when the
    younger is full it becomes the older, and words of the older that come again move to the younger, so that frequent words
    stay and memory is bounded.

    special: a special token of the file that stands in a text gets its own id, as the library gives it, and such texts are
    encoded whole; else its letters are encoded like any others.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, longest: int = 128, special: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        added = tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if special or not t.special]
        self.words = Words(tokenizer, " ", cache_words, longest)
        self.words.heads = self.heads = Words(tokenizer, "", cache_words // 8, longest)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if any(token in text for token in self.added):
            return self.words.whole(text)
        head, *words = text.split(" ")
        try:
            return (self.heads[head] if head else b"") + b"".join(map(self.words.__getitem__, words))
        except _Unsplit:
            return self.words.whole(text)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """What encode makes of each text (null: empty). Each different word of all texts is looked up once."""
        if not len(texts):
            return
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        at, coded = split.offsets.to_numpy() - split.offsets[0].as_py(), split.flatten().dictionary_encode()
        which, words = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        first = [words[k] for k in which[at[:-1]]]
        known = pa.array(_known(self.words, words) + [b if word else b"" for b, word in zip(_known(self.heads, first), first)], pa.large_binary())
        which[at[:-1]] = np.arange(len(words), len(known), dtype=which.dtype)  # nothing stands before them
        whole = np.logical_or.reduceat(known.is_null().to_numpy(zero_copy_only=False)[which], at[:-1])
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        laid = known.take(pa.array(which))
        _, ends, data = laid.buffers()
        stops, data = np.frombuffer(ends, np.int64)[at].tolist(), memoryview(data or b"")
        for k, (start, stop) in enumerate(zip(stops, stops[1:])):
            yield self.words.whole(texts[k].as_py()) if whole[k] else bytes(data[start:stop])


def _known(words: Words, asked: list[str]) -> list[bytes | None]:
    """The ids of words; null for those whose text has to be encoded whole."""

    def one(word: str) -> bytes | None:
        try:
            return words[word]
        except _Unsplit:
            return None

    try:
        return list(map(words.__getitem__, asked))
    except _Unsplit:
        return list(map(one, asked))


@lru_cache(maxsize=1)
def encoder_of(path: str, cache_words: int, special: bool) -> Encoder:
    """A worker's encoder: it keeps what it has learned from one task to the next."""
    return Encoder(path, cache_words, special=special)


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """Compressed planes of unsigned 32-bit ids, lowest bit or byte first, up to the highest one used."""
    bits = int(ids.max(initial=0)).bit_length()
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, : (bits + 7) // 8]
    if kind == "byte":
        planes = octets.T
    else:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T[:bits], axis=1)
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    octets = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for i, p in enumerate(raw):
            octets[:, i] = p
    elif raw:
        bits = np.zeros((32, n), np.uint8)
        for i, p in enumerate(raw):
            bits[i] = np.unpackbits(p, count=n)
        octets = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (doc_id, text), small ones joined up to TOGETHER bytes of text, so that their words are looked up once."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def _write_shard(tokenizer: str, kind: str, block_ids: int, end_id: int, cache_words: int, special: bool):
    """Batches of a shard's (doc_id, text), in order, to block rows. Holds one block and TOGETHER bytes of texts (or one larger batch) at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, cache_words, special)
        shard, schema = TaskContext.get().partitionId(), to_arrow_schema(BLOCKS)
        end = array("I", [end_id]).tobytes()
        buffer, pieces = bytearray(), []  # pieces: [doc_no, doc_id, ids in this block]
        doc_no, block, first = 0, 0, 0

        def row(n: int) -> pa.RecordBatch:
            nonlocal block, first, pieces
            ids = np.frombuffer(bytes(buffer[: 4 * n]), "<u4")
            del buffer[: 4 * n]
            planes = to_planes(ids, kind)
            out = dict(shard=shard, block=block, first=first, n_ids=n, width=len(planes), kind=kind, planes=planes)
            out |= dict(doc_no=[p[0] for p in pieces], doc_ids=[p[1] for p in pieces], piece_ids=[p[2] for p in pieces])
            block, first, pieces = block + 1, first + n, []
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in _together(batches):
            for doc_id, data in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                data += end
                at = 0
                while at < len(data):
                    take = min(len(data) - at, 4 * block_ids - len(buffer))
                    buffer += data[at : at + take]
                    pieces.append([doc_no, doc_id, take // 4])
                    at += take
                    if len(buffer) == 4 * block_ids:
                        yield row(block_ids)
                doc_no += 1
        if buffer:
            yield row(len(buffer) // 4)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", block_ids: int = BLOCK_IDS, end_id: int = END_ID, cache_words: int = CACHE_WORDS, special: bool = False) -> None:
    """Encode docs (doc_id, text) and write blocks and index under path.

    tokenizer: a file of the tokenizers library; cache_words: words that a worker remembers, in each of two generations (some
    250 bytes each); special: see Encoder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = with_columns(docs, doc_id="bigint", text="string").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write_shard(tokenizer, kind, block_ids, end_id, cache_words, special), BLOCKS).write.parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = blocks.join(F.broadcast(_bases(blocks)), "shard").select("shard", "block", (F.col("base") + F.col("first")).alias("start"), "n_ids")
    index.write.parquet(f"{path}/index")


def _bases(blocks: DataFrame) -> DataFrame:
    """shard, base: the ids in all shards before it. One row for each written partition, a few thousand at most."""
    from pyspark.sql import Window

    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("bigint").alias("base"))


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(PIECES)
    for batch in batches:
        for b in batch.to_pylist():
            data = from_planes(b["planes"], b["n_ids"], b["kind"]).tobytes()
            rows, at = [], 0
            for no, doc, n in zip(b["doc_no"], b["doc_ids"], b["piece_ids"]):
                crc = zlib.crc32(memoryview(data)[4 * at : 4 * (at + n)])
                rows.append(dict(shard=b["shard"], doc_no=no, doc_id=doc, first=b["first"] + at, n_ids=n, crc=crc))
                at += n
            yield pa.RecordBatch.from_pylist(rows, schema)


def _read_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            ids = from_planes(b["planes"], b["n_ids"], b["kind"])
            yield pa.RecordBatch.from_pydict({"start": [b["start"]], "ids": [ids.astype(np.int64)]}, to_arrow_schema(IDS))


def read_range(spark: SparkSession, path: str, start: int, n_ids: int) -> DataFrame:
    """start, ids: the blocks that hold ids start to start + n_ids, found in the index alone; only those are unpacked."""
    index = spark.read.parquet(f"{path}/index").where((F.col("start") < start + n_ids) & (F.col("start") + F.col("n_ids") > start))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.join(index.select("shard", "block", "start"), ["shard", "block"]).mapInArrow(_read_ids, IDS)


def crc32_join(crc_a: int, crc_b: int, bytes_b: int) -> int:
    """The crc32 of A followed by B from both crc32s and the length of B: crc_a is advanced over that many zero bytes."""
    step = [1 << (k - 1) if k else 0xEDB88320 for k in range(32)]  # what one zero bit makes of each bit

    def apply(matrix: list[int], value: int) -> int:
        out = 0
        for k in range(32):
            if value >> k & 1:
                out ^= matrix[k]
        return out

    bits = 8 * bytes_b
    while bits:
        if bits & 1:
            crc_a = apply(step, crc_a)
        step = [apply(step, column) for column in step]
        bits >>= 1
    return crc_a ^ crc_b


@F.pandas_udf(LongType())
def _join_crcs(parts):
    import pandas as pd

    def one(pieces) -> int | None:
        if pieces is None:
            return None
        crc = int(pieces[0]["crc"])
        for p in pieces[1:]:
            crc = crc32_join(crc, int(p["crc"]), 4 * int(p["n_ids"]))
        return crc

    return pd.Series([one(p) for p in parts], dtype="Int64")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, blocks: read back from the blocks, one row for each document."""
    small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    pieces = blocks.mapInArrow(_read_pieces, PIECES)
    docs = pieces.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("first").alias("first"),
        F.sum("n_ids").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("first", "n_ids", "crc"))).alias("parts"),
    )
    return docs.join(F.broadcast(_bases(blocks)), "shard").select(
        "doc_id",
        (F.col("base") + F.col("first")).alias("start"),
        "n_tokens",
        F.coalesce(_join_crcs(F.when(F.size("parts") > 1, F.col("parts"))), F.col("parts")[0]["crc"]).alias("ids_crc32"),
        "shard",
        F.size("parts").alias("blocks"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_read(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, **options) -> DataFrame:
    """Write docs under path (a new one in the shared folder, if None) and return read_documents of it."""
    path = path or scratch(docs.sparkSession, "token-planes")
    write(docs, path, tokenizer or default_tokenizer(), **options)
    return read_documents(docs.sparkSession, path)
