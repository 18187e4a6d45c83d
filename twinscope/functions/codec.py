"""Numbers and bytes in text: hexadecimal, encoded numbers, little-endian words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_hex(c: Column) -> Column:
    """0x and lower-case digits, as addresses are written."""
    return F.lower(F.concat(F.lit("0x"), F.hex(c)))


def from_hex(c: Column) -> Column:
    """The value of hexadecimal digits, with or without 0x; null for any other text."""
    digits = F.regexp_extract(F.trim(c), r"^(?:0[xX])?([0-9a-fA-F]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def from_decimal_or_hex(c: Column) -> Column:
    return F.coalesce(F.when(F.trim(c).rlike(r"^[0-9]{1,18}$"), F.trim(c).cast("long")), F.when(F.trim(c).rlike(r"^0[xX]"), from_hex(c)))


def encoded_number(c: Column) -> Column:
    """The number in a decorated name: digits A to P stand for 0 to 15, up to an @; a
    single decimal digit stands for one more than itself."""
    text = F.regexp_extract(c, "^([A-P]{1,15})@?$", 1)
    return F.when(c.rlike("^[0-9]$"), c.cast("long") + 1).when(text != "", F.conv(F.translate(text, "ABCDEFGHIJKLMNOP", "0123456789ABCDEF"), 16, 10).cast("long"))


def little_endian(data: Column, offset: Column | int, size: int = 4, signed: bool = False) -> Column:
    """The integer at a place (from 0) in bytes; null beyond the end."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    out = F.lit(0).cast("long")
    for k in range(size):
        byte = F.conv(F.hex(F.substring(data, at + k + 1, F.lit(1))), 16, 10).cast("long")
        out = out + F.shiftleft(byte, 8 * k)
    if signed and size < 8:
        out = F.when(out >= 1 << (8 * size - 1), out - (1 << (8 * size))).otherwise(out)
    return F.when((at >= 0) & (F.octet_length(data) >= at + size), out)


def until_nul(data: Column, offset: Column | int = 0) -> Column:
    """The Latin-1 text from a place up to the next NUL."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.regexp_extract(F.decode(F.substring(data, at + 1, F.octet_length(data)), "ISO-8859-1"), r"^([^\x00]*)", 1)


def init_state(rest: Column, size: Column) -> Column:
    """Whether a variable is left uninitialised, by the bytes that the file still has from
    its address on: NO if any is not zero, YES if they are fewer than it needs, else
    MAYBE, as alignment may have padded them."""
    return F.when(F.hex(rest).rlike("[1-9A-F]"), F.lit("NO")).when(F.octet_length(rest) < size, F.lit("YES")).otherwise(F.lit("MAYBE"))
