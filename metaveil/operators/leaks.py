"""Values that still stand in what a copy holds: many values, one pass over each part."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed value: shorter values aren't searched for.
LEAST = 4


def search(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """parts (content, raw and others) with leaks: those values of raw, of at least so many characters, that stand in the content.

    A file's values make one automaton, which goes over each of its parts once; values and parts are compared as bytes of UTF-8.
    Nothing is shuffled: the values travel with the parts.
    """
    out = T.StructType([*parts.schema.fields, T.StructField("leaks", T.ArrayType(T.StringType()))])
    at, by = parts.columns.index("content"), parts.columns.index("raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, last, machine = to_arrow_schema(out), None, None
        for batch in batches:
            found = []
            for content, raw in zip(batch.column(at), batch.column(by).to_pylist()):
                values = tuple(sorted({v for v in raw or () if v and len(v) >= least}))
                if values != last:
                    last, machine = values, ahocorasick.Automaton()
                    for value in values:
                        machine.add_word(value.encode("utf-8", "replace").decode("latin-1"), value)
                    machine.make_automaton()
                data = content.as_py()
                found.append(sorted({v for _, v in machine.iter(data.decode("latin-1"))}) if values and data else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], schema=schema)

    return parts.mapInArrow(run, out)


def leaked(parts: DataFrame) -> DataFrame:
    """file_id, leaked: how many distinct values of its original a file's parts (file_id, leaks) still hold."""
    one = parts.select("file_id", F.explode_outer("leaks").alias("value")).distinct()
    return one.groupBy("file_id").agg(F.count("value").alias("leaked"))
