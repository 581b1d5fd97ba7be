"""A set of ids as a bitmap of bounded size, for filtering rows where they are read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Powers of two between which a bitmap's bits are chosen, some sixteen for each id: 128 KB to 16 MB. With more ids it lets
#: more rows through, never fewer; whoever uses it has an exact step behind it.
LEAST_BITS, MOST_BITS = 20, 27


#: The primes of XXH64.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)


def xxh64(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of bigints."""
    one, two, three, four, five = map(np.uint64, PRIMES)

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)

    h = turned(values.view(np.uint64) * two, 31) * one ^ (five + np.uint64(42 + 8))
    h = turned(h, 27) * one + four
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


class Bitmap:
    """Packed bits in a broadcast."""

    def __init__(self, shared, size: int):
        self.shared, self.size = shared, size

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Which of the values (64-bit numbers) are among the ids, or fall on the bit of one."""
        slots = xxh64(values) & np.uint64(self.size - 1)
        return (self.shared.value[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(ids: DataFrame, column: str, count: int | None = None) -> Bitmap:
    """Of a bigint column. Only words of 64 bits, or'd by the executors, come to the driver."""
    count = ids.count() if count is None else count
    size = 1 << min(max((16 * count).bit_length(), LEAST_BITS), MOST_BITS)
    slots = ids.select(F.xxhash64(column).bitwiseAND(F.lit(size - 1)).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    found = np.zeros(size >> 6, np.uint64)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return Bitmap(ids.sparkSession.sparkContext.broadcast(found), size)
