"""Portable documents as rows: one for each definition of an object, each trailer, and the first line.

Tasks only find where objects are, and cut their dictionaries into keys and values; which definition counts, what refers to
what, and what a copy holds is decided by joins (operators.pdf). Objects within object streams are rows as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metaveil.sources.pieces import PART, Broken, in_parts, small_batches

#: kind: header, object, trailer, or malformed (the only row of a file). pos: the order of definitions. entries: of a dictionary;
#: raw is the key as it is written, text what a string or name says. body: an object that is no dictionary. stream: as it is stored.
OBJECTS = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("number", T.LongType()), T.StructField("generation", T.LongType()),
        T.StructField("entries", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("key", "raw", "value", "text")]))),
        T.StructField("body", T.BinaryType()), T.StructField("stream", T.BinaryType()),
    ]
)
#: Bytes that the object streams of a file may unpack to.
MOST_UNPACKED = 100 << 20

_SPACE = re.compile(rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*")
_REGULAR = re.compile(rb"/?[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
_REFERENCE = re.compile(rb"\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_START = re.compile(rb"(?<![^\x00\t\n\x0c\r ()<>\[\]{}/%])(?:(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![a-z])|trailer)")
_ESCAPED = re.compile(rb"\\(?:([0-7]{1,3})|\r?\n|\r|(.))", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _token(data: bytes, at: int) -> tuple[int, int]:
    at = _SPACE.match(data, at).end()
    first = data[at : at + 1]
    if data[at : at + 2] in (b"<<", b">>"):
        return at, at + 2
    if first in b"[]{})>":
        return at, at + 1
    if first == b"<":
        return at, data.find(b">", at) + 1 or len(data)
    if first != b"(":
        return at, max(_REGULAR.match(data, at).end(), at + 1)
    depth, end = 0, at
    while end < len(data):
        c = data[end]
        end += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
        if not depth:
            break
    return at, end


def _value(data: bytes, at: int) -> tuple[int, int]:
    """Start and end of the object that begins there."""
    start, end = _token(data, at)
    if start >= len(data):
        raise Broken("end")
    reference = _REFERENCE.match(data, start)
    if reference:
        return start, reference.end()
    depth = data[start:end] in (b"<<", b"[")
    while depth:
        at, end = _token(data, end)
        if at >= len(data):
            raise Broken("end")
        depth += (data[at:end] in (b"<<", b"[")) - (data[at:end] in (b">>", b"]"))
    return start, end


def _name(raw: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw[1:]).decode("utf-8", "replace")


def _text(value: bytes) -> str | None:
    """What a string or name says; null for others."""
    if value[:1] == b"/":
        return _name(value)
    if value[:1] == b"(":
        plain = _ESCAPED.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPES.get(m[2], m[2]) if m[2] else b"", value[1:-1])
    elif value[:1] == b"<" and value[:2] != b"<<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", value)
        plain = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        return None
    if plain[:2] == b"\xfe\xff":
        return plain[2:].decode("utf-16-be", "replace")
    return plain.decode("utf-8", "replace") if plain[:3] == b"\xef\xbb\xbf" else plain.decode("cp1252", "replace")


def _dictionary(data: bytes, start: int, end: int) -> list[dict]:
    found, at = [], start + 2
    while True:
        a, b = _token(data, at)
        if b >= end:
            return found
        if data[a : a + 1] != b"/":
            at = b
            continue
        c, at = _value(data, b)
        value = data[c:at]
        found.append({"key": _name(data[a:b]), "raw": data[a:b].decode("latin-1"), "value": value.decode("latin-1"), "text": _text(value)})


def _of(entries: list[dict], key: str) -> str:
    return next((e["value"] for e in reversed(entries) if e["key"] == key), "")


def _stream(data: bytes, at: int, entries: list[dict]) -> tuple[bytes, int] | None:
    """What stands between stream and endstream, and where that ends; null if the object has no stream."""
    start, end = _token(data, at)
    if data[start:end] != b"stream":
        return None
    end += 2 if data[end : end + 2] == b"\r\n" else 1
    size = _of(entries, "Length")
    if size.isdigit() and data[end + int(size) :].lstrip(b"\r\n \t")[:9] == b"endstream":
        return data[end : end + int(size)], end + int(size)
    stop = data.find(b"endstream", end)
    if stop < 0:
        raise Broken("stream")
    return re.sub(rb"\r?\n\Z|\r\Z", b"", data[end:stop]), stop


def _packed(entries: list[dict], stream: bytes, pos: int, left: int) -> Iterator[dict]:
    """The objects of an object stream."""
    if "FlateDecode" in _of(entries, "Filter"):
        machine = zlib.decompressobj()
        try:
            stream = machine.decompress(stream, left)
        except zlib.error as error:
            raise Broken("object stream") from error
        if machine.unconsumed_tail:
            raise Broken("size")
    elif _of(entries, "Filter"):
        raise Broken("filter")
    n, first = int(_of(entries, "N")), int(_of(entries, "First"))
    heads = [int(x) for x in stream[:first].split()[: 2 * n]]
    for k, (number, at) in enumerate(zip(heads[::2], heads[1::2], strict=False)):
        start, end = _value(stream, first + at)
        if stream[start : start + 2] == b"<<":
            yield dict(kind="object", pos=pos + k + 1, number=number, generation=0, entries=_dictionary(stream, start, end), body=None, stream=None)
        else:
            yield dict(kind="object", pos=pos + k + 1, number=number, generation=0, entries=None, body=stream[start:end], stream=None)


def _objects(data: bytes) -> list[dict]:
    if data[:5] != b"%PDF-":
        raise Broken("header")
    nothing = dict.fromkeys(OBJECTS.names)
    found, at, left = [nothing | dict(kind="header", pos=0, body=re.match(rb"[^\r\n]*", data)[0])], 0, MOST_UNPACKED
    while start := _START.search(data, at):
        pos = start.start() << 20
        a, at = _value(data, start.end())
        entries = _dictionary(data, a, at) if data[a : a + 2] == b"<<" else None
        if start[1] is None:
            found.append(nothing | dict(kind="trailer", pos=pos, entries=entries or []))
            continue
        stream = _stream(data, at, entries) if entries is not None else None
        body, kind = (None if entries is not None else data[a:at]), _of(entries or [], "Type")
        if stream and kind == "/XRef":
            found.append(nothing | dict(kind="trailer", pos=pos, entries=entries))
        elif stream and kind == "/ObjStm":
            own = list(_packed(entries, stream[0], pos, left))
            left -= sum(len(str(o["entries"])) for o in own)
            found += own
        else:
            found.append(nothing | dict(kind="object", pos=pos, number=int(start[1]), generation=int(start[2]), entries=entries, body=body, stream=stream[0] if stream else None))
        at = stream[1] if stream else at
    if not any(f["kind"] == "trailer" for f in found):
        raise Broken("trailer")
    return found


def objects(files: DataFrame) -> DataFrame:
    """file_id and OBJECTS of files (file_id, content)."""
    small_batches(files.sparkSession)
    out = T.StructType([files.schema["file_id"], *OBJECTS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, own = to_arrow_schema(out), to_arrow_schema(OBJECTS)

        def told(batch: pa.RecordBatch, again: list[int], rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again, pa.int32())), *pa.RecordBatch.from_pylist(rows, schema=own).columns], schema=schema)

        for batch in in_parts(batches, 1):
            found, again, size = [], [], 0
            for i in range(batch.num_rows):
                try:
                    rows = _objects(batch.column(1)[i].as_py() or b"")
                except (Broken, ValueError, RecursionError):
                    rows = [dict.fromkeys(OBJECTS.names) | {"kind": "malformed", "pos": 0}]
                found += rows
                again += [i] * len(rows)
                size += sum(len(r["stream"] or r["body"] or b"") + 64 * len(r["entries"] or ()) for r in rows)
                if size >= PART:  # unpacked, a part may be much larger
                    yield told(batch, again, found)
                    found, again, size = [], [], 0
            if found:
                yield told(batch, again, found)

    return files.select("file_id", F.col("content")).mapInArrow(run, out)
