"""Numbers and text in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the bytes 80 to 9F are in windows-1252; five of them stay control characters.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
WHITE = " \t\n\x0b\x0c\r\xa0  ﻿"


def number(data: Column, at: int, size: int, order: str = "big") -> Column:
    """An unsigned number of so many bytes, or null past the end."""
    digits = F.hex(F.substring(data, at + 1, size))
    if order == "little":
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(data) >= at + size, F.conv(digits, 16, 10).cast("bigint"))


def big(value: Column, size: int) -> Column:
    """The bytes of a number, the highest first."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def little(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def cp1252(data: Column) -> Column:
    """Text of one character for each byte."""
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)


def utf8(data: Column) -> Column:
    """Text in which what is no UTF-8 is replaced; a leading byte order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "^﻿", "")


def cstring(data: Column) -> Column:
    """Printable text up to a zero byte, or null."""
    text = F.trim(F.regexp_replace(F.decode(data, "ISO-8859-1"), "(?s)\0.*", ""))
    return F.when(text != "", text)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))
