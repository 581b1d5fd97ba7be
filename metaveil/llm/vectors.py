"""Integer vectors in blocks: a block holds what one Arrow batch does, as a row of a written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products and sums of doubles that are integers below this are exact.
EXACT = 2.0**53


def whole_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has no null, NaN or infinite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull()).where(~bad)


def integers(column: pa.Array, width: int, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) of the components, held within most; vectors that are shorter than width get zeros at their end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(values * scale), -most, most).astype(np.int32)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), np.int32)
    full[np.arange(width)[None, :] < sizes[:, None]] = values
    return full


def packed(x: np.ndarray) -> bytes:
    """As int16 where that holds all, else as int32."""
    small = not x.size or (x.min() >= -(2**15) and x.max() < 2**15)
    return x.astype(np.int16 if small else np.int32).tobytes()


def unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.int32 if rows * width and len(data) == 4 * rows * width else np.int16
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, width)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b, as int64."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one at a time: a block is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
