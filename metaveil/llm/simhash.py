"""Near duplicates by SimHash, linked through BK-trees.

Fingerprints: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of all 4-word shingles.

Links: two fingerprints that differ in at most RADIUS bits agree in at least 2 of 6 groups of bits, so every distinct
fingerprint goes to 15 shards, one for each pair of groups and its bits there. Each shard holds a BK-tree (children keyed by
their distance to the parent) in the task that the shard was shuffled to; a search follows only the edges within the radius
of the distance just measured. A shard gives the links of a spanning forest, at most one for each of its members, never all
pairs. A shard with more members than `shard_size` is split into parts, and every two parts meet in a task of their own.
Links then become components by repeated joins. Trees are not sent through the driver, for the fingerprints of all documents
have no size bound; the shuffle brings the queries to the shard's tree instead.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer than four words are one shingle;
equal fingerprints are linked; a null doc_id stays null and never names a component unless its component has no other;
repeated rows each get their row; an empty table gives no rows; other columns are ignored. keep_one keeps one row of each group,
rows without a doc_id and repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.llm.common import materialise, small_batches, struct, unused, with_columns
from metaveil.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
SHARD_SIZE = 2048
#: First bit and width of each group of bits: one more than RADIUS and one to spare.
GROUPS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))

PRINTS = struct(doc_id="bigint", fp="bigint")
HASHED_PRINTS = struct(doc_id="bigint", fp="bigint", text_hash="bigint")
LINKS = struct(a="bigint", b="bigint")


def fingerprint(text: bytes | None) -> int:
    """As an unsigned 64-bit integer. The text is UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit a byte
            counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        schema = to_arrow_schema(HASHED_PRINTS if batch.num_columns > 2 else PRINTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), *batch.columns[2:]], schema=schema)


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and if hashed, text_hash."""
    small_batches(docs.sparkSession)
    rows = with_columns(docs, doc_id="bigint", text="string")
    if hashed:
        return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_fingerprints, HASHED_PRINTS)
    return rows.mapInArrow(_fingerprints, PRINTS)


class BKTree:
    """Fingerprints by Hamming distance: a node is [fingerprint, {distance: child}]."""

    def __init__(self):
        self.root = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = [fp, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            child = node[1].get(d)
            if child is None:
                if d:
                    node[1][d] = [fp, {}]
                return
            node = child

    def within(self, fp: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join all members that any such links join; fewer than there are members."""
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for fp in members:
        if fp in parent:
            continue
        parent[fp] = fp
        for near in tree.within(fp, radius):
            a, b = root(near), root(fp)
            if a != b:
                parent[b] = a
                links.append((near, fp))
        tree.add(fp)
    return links


def _link_shards(radius: int):
    """Rows (key, part, fp) in order to links. Holds one shard at a time."""
    mask = (1 << 64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, shard, members = to_arrow_schema(LINKS), None, []

        def links() -> list[tuple[int, int]]:
            return forest(members, radius) if len(members) > 1 else []

        for batch in batches:
            keys = (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()
            fps = [x & mask for x in batch.column(2).to_pylist()]
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(fps)]
            out: list[tuple[int, int]] = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] != shard:
                    out += links()
                    shard, members = keys[a], []
                members = members + fps[a:b]
            if out:
                yield _as_links(out, schema)
        if out := links():
            yield _as_links(out, schema)

    return run


def _as_links(pairs: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    both = np.array(pairs, np.uint64).view(np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], schema=schema)


def link(fps: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """a, b: links that join all of fps (fp, distinct) that differ in at most radius (4 or less) bits."""
    if radius > len(GROUPS) - 2:
        raise ValueError(f"the shards find at most {len(GROUPS) - 2} differing bits")
    bits = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for at, width in GROUPS]
    keys = [
        (F.lit(k << 22) + bits[i] * F.lit(1 << 11) + bits[j]).cast("int") for k, (i, j) in enumerate(combinations(range(len(GROUPS)), 2))
    ]
    sharded = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = materialise(sharded.groupBy("key").count().where(F.col("count") > shard_size), "hot-shards")
    n_hot = hot.count()
    if n_hot:
        parts = F.ceil(F.col("count") / shard_size).cast("int")
        hot = hot.select("key", parts.alias("parts"))
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        sharded = (
            sharded.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left")
            .select("key", "fp", own.alias("own"), F.explode(others).alias("other"))
            .select("key", (F.least("own", "other") * 65536 + F.greatest("own", "other")).cast("int").alias("part"), "fp")
        )
    else:
        sharded = sharded.select("key", F.lit(0).alias("part"), "fp")
    return sharded.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_link_shards(radius), LINKS)


def _roots(prints: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """fp, first (its smallest doc_id), root (the same in all of a component), one row for each fingerprint of prints."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(link(firsts.select("fp"), radius, shard_size))
    named = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(named, "classes")


def classify(docs: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable over links)."""
    prints = materialise(fingerprints(docs), "prints")
    named = _roots(prints, radius, shard_size)
    classes = materialise(_spread(named, "first", "component_id").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _spread(named: DataFrame, value: str, least: str, parts: int = 64) -> DataFrame:
    """named with the least value of each root: found in parts first, then together, and dealt back to the parts, so that no component is one task's."""
    parted = named.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int"))
    whole = parted.groupBy("root", "part").agg(F.min(value).alias(least)).groupBy("root").agg(F.min(least).alias(least), F.collect_list("part").alias("parts"))
    return parted.join(whole.select("root", F.explode("parts").alias("part"), least), ["root", "part"])


def keep_one(docs: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest doc_id, then by its text's hash; rows without a doc_id come last."""
    prints = materialise(fingerprints(docs, hashed=True), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = prints.groupBy("fp").agg(F.min(order).alias("least"))
    named = firsts.join(_roots(prints, radius, shard_size), "fp")
    mine, turn = unused(docs, "kept"), unused(docs, "turn")
    parted = named.groupBy("root", F.pmod(F.xxhash64("fp"), F.lit(64)).alias("part")).agg(F.min("least").alias("least"))
    kept = parted.groupBy("root").agg(F.min("least").alias(mine)).select(mine)
    id_, text_hash = docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"].cast("string"))
    joined = docs.join(kept, id_.eqNullSafe(F.col(f"{mine}.doc_id")) & (text_hash == F.col(f"{mine}.text_hash")))
    first = F.row_number().over(Window.partitionBy(f"{mine}.doc_id", f"{mine}.text_hash").orderBy("text"))
    return joined.withColumn(turn, first).where(F.col(turn) == 1).drop(mine, turn)
