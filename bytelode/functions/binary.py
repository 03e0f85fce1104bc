"""Byte functions as columns.

Content is searched as ISO-8859-1 text, in which a character is a byte: Spark's string functions on BINARY aren't
safe for bytes beyond ASCII.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blob(text: Column) -> Column:
    """The bytes of a text column."""
    return F.encode(text, "UTF-8")


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def slice_bytes(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end)."""
    return F.substring(content, start.cast("int") + 1, (end - start).cast("int"))


def integer(content: Column, at: int, width: int, big: bool = False) -> Column:
    """The unsigned integer of ``width`` bytes at an offset, as DECIMAL(20,0) for 8 bytes and LONG below; null if it isn't whole."""
    digits = F.hex(F.substring(content, at + 1, width))
    ordered = digits if big else F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    value = F.conv(ordered, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")
    return F.when(F.length(digits) == 2 * width, value)


def round_up(x: Column, to: int) -> Column:
    return F.floor((x + (to - 1)) / to) * to if to & (to - 1) else (x + F.lit(to - 1)).bitwiseAND(F.lit(~(to - 1)))


def round_down(x: Column, to: int) -> Column:
    return x - F.pmod(x, F.lit(to))


def without_nulls(text: Column) -> Column:
    """The text without NUL characters at its end."""
    return F.regexp_replace(text, "\\x00+$", "")


def single_byte(content: Column) -> Column:
    """Whether the content is one byte value over and over."""
    text = latin1(content)
    return (F.length(text) > 0) & (F.length(F.replace(text, F.substring(text, 1, 1), F.lit(""))) == 0)


def block_size(size: Column) -> Column:
    """The size of blocks in which content of this size is measured: an 80th, between 1 KiB and 1 MiB."""
    return F.least(F.greatest(F.floor(size / 80), F.lit(1024)), F.lit(1024 * 1024)).cast("long")


UNITS = ("B", "KB", "MB", "GB", "TB")


def human_size(size: Column) -> Column:
    """``1.50 KB``: steps of 1024 up to TB, two decimals.

    The size counts as a double does, and decimals are rounded by whole numbers, half to even: Java's formatting rounds half up.
    """
    step = F.lit(0)
    for i in range(1, len(UNITS)):
        step = step + (size >= 1024**i).cast("int")
    # The largest doubles are beyond a long.
    near = F.coalesce(size.cast("double").try_cast("long"), size.cast("long"))
    unit = F.element_at(F.array(*[F.lit(1024**i) for i in range(len(UNITS))]), step + 1).cast("long")
    whole, rest = F.call_function("div", near, unit), (near % unit) * 100
    cents, over = F.call_function("div", rest, unit), rest % unit * 2
    cents = cents + ((over > unit) | ((over == unit) & (cents % 2 == 1))).cast("long")
    whole = whole + (cents == 100).cast("long")
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in UNITS]), step + 1))


def range_hex(start: Column, end: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(start)), F.lit("-0x"), F.lower(F.hex(end)))


def signature(content: Column, table: dict[str, str], default: str = "data") -> Column:
    """The name of the first hex prefix in ``table`` that the content starts with."""
    head = F.hex(F.substring(content, 1, max(len(h) for h in table) // 2))
    out = None
    for prefix, name in table.items():
        test = head.startswith(prefix.upper())
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def decode_int(text: Column, base: int) -> Column:
    """The number that a text of digits (with blanks or NULs around it) stands for in a base from 2 to 16; null for other texts."""
    digits = "0123456789abcdef"[:base]
    bare = F.lower(F.regexp_replace(text, "^[\\x00\\s]+|[\\x00\\s]+$", ""))
    return F.when(bare.rlike(f"^[{digits}]+$"), F.conv(bare, base, 10).cast("bigint"))


def bits(value: Column, width: int = 8) -> Column:
    """The bits of an integer, the lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", value.cast("bigint"), i).bitwiseAND(F.lit(1)).cast("int"))


def endian(content: Column, big: bytes, little: bytes, at: int = 0) -> Column:
    """``big`` or ``little`` by the bytes at an offset; null for neither."""
    own = F.hex(F.substring(content, at + 1, len(big)))
    return F.when(own == big.hex().upper(), "big").when(own == little.hex().upper(), "little")


def run_length(content: Column, at: int, values: bytes = b"\x00\xff") -> Column:
    """How many bytes from an offset on are among these."""
    chosen = "".join(f"\\x{v:02x}" for v in values)
    return F.length(F.regexp_extract(F.substring(latin1(content), at + 1, 1 << 30), f"(?s)^[{chosen}]*", 0))


@F.pandas_udf(T.LongType())
def adler32(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else zlib.adler32(x)).astype("Int64")


@F.pandas_udf(T.LongType())
def leb128(content: pd.Series) -> pd.Series:
    """The number in groups of 7 bits, the lowest first, that the content starts with; null if it has no end or over 63 bits."""

    def decode(x: bytes | None) -> int | None:
        out = 0
        for i, byte in enumerate((x or b"")[:9]):
            out |= (byte & 0x7F) << 7 * i
            if not byte & 0x80:
                return out
        return None

    return content.map(decode).astype("Int64")
