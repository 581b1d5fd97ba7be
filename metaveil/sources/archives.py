"""Archives and packages as rows: one for each entry, and archives put together from such rows."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.sources.pieces import PART, in_parts, small_batches

#: status: ok, or malformed (a row without entry), or encrypted (an entry that can't be read). at: when it was changed.
ENTRIES = T.StructType(
    [
        T.StructField("file_id", T.LongType()), T.StructField("file_length", T.LongType()), T.StructField("comment", T.StringType()), T.StructField("entry_pos", T.IntegerType()),
        T.StructField("path", T.StringType()), T.StructField("is_folder", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("packed", T.LongType()),
        T.StructField("at", T.StringType()), T.StructField("stored", T.BooleanType()), T.StructField("extra_fields", T.IntegerType()), T.StructField("attributes", T.BooleanType()),
        T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType()),
    ]
)
#: Entries that are never unpacked: the gates refuse their archive by the sizes it states.
MOST_BYTES = 250 * 1024 * 1024


def _extra_fields(extra: bytes) -> int:
    n, at = 0, 0
    while at + 4 <= len(extra):
        at += 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
        n += 1
    return n


def _entries(data: bytes) -> Iterator[dict]:
    """Nothing is unpacked if the stated sizes are beyond what any gate lets through."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        infos = archive.infolist()
        small = sum(i.file_size for i in infos) <= MOST_BYTES
        for k, info in enumerate(infos):
            row = dict(
                comment=archive.comment.decode("utf-8", "replace"), entry_pos=k, path=info.filename, is_folder=info.is_dir(), size=info.file_size, packed=info.compress_size,
                at="{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}".format(*info.date_time), stored=info.compress_type == zipfile.ZIP_STORED,
                extra_fields=_extra_fields(info.extra), attributes=info.external_attr >> 16 != 0, status="ok", content=None,
            )
            if small and not info.is_dir():
                try:
                    row["content"] = archive.read(info)
                except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, OSError, EOFError):
                    row["status"] = "encrypted"
            yield row


def entries(files: DataFrame) -> DataFrame:
    """A row for each entry of files (file_id, content and others, which every entry carries); for a file that is no archive, one row whose status is malformed.

    A file_id is that of one archive: groups by it would mix those of two. Copies are refused to such (see rebuilt).
    """
    small_batches(files.sparkSession)
    if isinstance(files.schema["file_id"].dataType, T.IntegerType):
        files = files.withColumn("file_id", F.col("file_id").cast("bigint"))
    others = [c for c in files.columns if c not in ("file_id", "content")]
    files = files.select("file_id", "content", *others)
    own = T.StructType(ENTRIES.fields[1:])
    out = T.StructType([files.schema["file_id"], *own.fields, *[files.schema[c] for c in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, inner = to_arrow_schema(out), to_arrow_schema(own)

        def told(batch: pa.RecordBatch, again: list[int], rows: list[dict]) -> pa.RecordBatch:
            own_columns, again = pa.RecordBatch.from_pylist(rows, schema=inner).columns, pa.array(again, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(again), *own_columns, *[batch.column(k).take(again) for k in range(2, batch.num_columns)]], schema=schema)

        for batch in in_parts(batches, 1):
            found, again, size = [], [], 0
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py() or b""
                try:
                    rows = list(_entries(data))
                except (zipfile.BadZipFile, ValueError, NotImplementedError, EOFError):
                    rows = [dict.fromkeys(own.names) | {"status": "malformed"}]
                found += [r | {"file_length": len(data)} for r in rows]
                again += [i] * len(rows)
                size += sum(len(r["content"] or b"") for r in rows)
                if size >= PART:  # unpacked, a part may be much larger
                    yield told(batch, again, found)
                    found, again, size = [], [], 0
            if found:
                yield told(batch, again, found)

    return files.mapInArrow(run, out)


def rebuilt(kept: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """file_id, content and the carried columns: archives of the rows of kept, all of one date, without comments.

    kept: file_id, entry_pos, path, is_folder, stored, content; with dropped, rows of which it holds are left out; with status,
    any row that is not ok leaves the file without a copy (content null), and so do two rows of one place. A window lays the rows
    of an archive side by side, in their order, and tasks go through them: they hold one archive (at most as large as the gates
    let through) and what they have made since the last batch.
    """
    for name, value in (("dropped", F.lit(False)), ("status", F.lit("ok"))):
        if name not in kept.columns:
            kept = kept.withColumn(name, value)
    out = T.StructType([kept.schema["file_id"], T.StructField("content", T.BinaryType()), *[kept.schema[c] for c in carried]])

    def write(rows: list[dict]) -> bytes | None:
        if any(r["status"] != "ok" for r in rows) or len({r["entry_pos"] for r in rows}) < len(rows):
            return None
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
            for row in (r for r in rows if not r["dropped"]):
                info = zipfile.ZipInfo(row["path"], (1980, 1, 1, 0, 0, 0))
                info.create_system = 0
                info.external_attr = 0x10 if row["is_folder"] else 0x20  # of DOS; 0 would be replaced by permissions
                info.compress_type = zipfile.ZIP_STORED if row["stored"] or row["is_folder"] else zipfile.ZIP_DEFLATED
                archive.writestr(info, row["content"] or b"")
        return made.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, rows, done, size = to_arrow_schema(out), [], [], 0

        def finished() -> int:
            content = write(rows)
            done.append({"file_id": rows[0]["file_id"], "content": content, **{c: rows[0][c] for c in carried}})
            rows.clear()
            return len(content or b"") + 1024  # rows without a copy count, too

        for batch in in_parts(batches, at):
            for row in batch.to_pylist():
                if row["_place"] == 1 and rows:
                    size += finished()
                rows.append(row)
                if size >= PART:
                    yield pa.RecordBatch.from_pylist(done, schema=schema)
                    done, size = [], 0
        if rows:
            finished()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    small_batches(kept.sparkSession)
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("entry_pos"))
    laid = kept.select("file_id", "entry_pos", "path", "is_folder", "stored", "content", "dropped", "status", *carried, place.alias("_place"))
    at = laid.columns.index("content")
    return laid.mapInArrow(run, out)
