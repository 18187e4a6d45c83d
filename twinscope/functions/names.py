"""Names: quoted texts, decorated symbols, and names made fit for other programs.

All are columns; only running a demangler, which is a library of its own, is a Pandas UDF
around the function that is given.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscope.functions.entity import has_text

# Escapes of single characters in quoted texts.
ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\\": "\\\\", '"': '\\"'}
# The form of a string constant's symbol (width, length, hash, text).
STRING_SYMBOL = r"^\?\?_C@_([01])(\d|[A-P]+@)(\w+)@(.+)@"
# What a demangled table's name says beyond the classes, and what replaces it.
TABLE_WORDS = (("<class ", "<"), ("<struct ", "<"), ("const ", ""), ("volatile ", ""))
# Characters that the other program's names may not have, and their substitutes.
FORBIDDEN, SUBSTITUTES = "<>* `", "[]#_'"


def quoted(text: Column, wide: Column | None = None) -> Column:
    """The name of an entity that is a text: in double quotes, an L before wide ones, with
    control characters and all beyond ASCII escaped."""
    def shown(c: Column) -> Column:
        code = F.ascii(c)
        digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
        out = F.when(code < 0x20, F.concat(F.lit("\\x"), digits(2))).when(code < 0x7F, c).when(code < 0x100, F.concat(F.lit("\\x"), digits(2)))
        out = out.when(code < 0x10000, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))
        for char, escape in ESCAPES.items():
            out = F.when(c == char, F.lit(escape)).otherwise(out)
        return out

    plain = F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), shown), ""), F.lit('"'))
    return plain if wide is None else F.when(wide, F.concat(F.lit("L"), plain)).otherwise(plain)


def string_constant(symbol: Column) -> Column:
    """(length, is_wide) of the string that a symbol stands for; null for other symbols."""
    length = F.regexp_extract(symbol, STRING_SYMBOL, 2)
    letters = F.translate(F.regexp_replace(length, "@$", ""), "ABCDEFGHIJKLMNOP", "0123456789ABCDEF")
    number = F.when(length.endswith("@"), F.conv(letters, 16, 10).cast("long")).otherwise(length.cast("long"))
    return F.when(symbol.rlike(STRING_SYMBOL), F.struct(number.alias("length"), (F.regexp_extract(symbol, STRING_SYMBOL, 1) == "1").alias("is_wide")))


def table_name(symbol: Column) -> Column:
    """The name of the table that a decorated symbol (??_7...) stands for, without a
    demangler: a class, a class in another, or a template of a class."""
    parts = F.split(F.substring(symbol, 5, 1 << 30), "@")
    first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    argument = F.when(second.startswith("PA"), F.concat(F.substring(second, 4, 1 << 30), F.lit(" *"))).otherwise(F.substring(second, 2, 1 << 30))
    template = F.concat(F.substring(first, 3, 1 << 30), F.lit("<"), argument, F.lit(">"))
    named = F.when(first.startswith("?$"), template).when(~second.isin("", "6B"), F.concat(second, F.lit("::"), first)).otherwise(first)
    return F.concat(named, F.lit("::`vftable'"))


def demangled(symbol: Column, demangle: Callable[[str], str | None]) -> Column:
    """What a demangler makes of each symbol; null where it makes nothing."""

    @F.pandas_udf("string")
    def run(symbols: pd.Series) -> pd.Series:
        return symbols.map(lambda s: (demangle(s) or None) if s else None)

    return run(symbol)


def arguments(plain: Column) -> Column:
    """The arguments of a demangled function, from the first parenthesis to the last."""
    return F.nullif(F.regexp_extract(plain, r"(?s)(\(.*\))", 1), F.lit(""))


def plain_table(plain: Column) -> Column:
    """A demangled table's name without what only says how it is stored."""
    for word, other in TABLE_WORDS:
        plain = F.replace(plain, F.lit(word), F.lit(other))
    return plain


def adjuster_name(plain: Column) -> Column:
    """The part of a demangled adjuster's name that names it; null for other functions."""
    inner = F.regexp_extract(plain, r"(?s)__thiscall.(.*?}')", 1)
    return F.when(F.contains(plain, F.lit("`vtordisp")), F.when(inner != "", inner).otherwise(plain))


def sanitised(name: Column) -> Column:
    """(namespaces, base) of a name with forbidden characters replaced. Only colons outside
    template arguments separate names; what stands for another function is marked."""
    inner = F.regexp_extract(name, r"(?s)^Thunk of '(.*)'$", 1)
    is_thunk = name.rlike(r"(?s)^Thunk of '.*'$")
    text = F.translate(F.when(is_thunk, inner).otherwise(name), FORBIDDEN, SUBSTITUTES)
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).alias("depth"))

    def step(held: Column, piece: Column) -> Column:
        last = F.concat(F.element_at(held["names"], -1), F.lit("::"), piece)
        joined = F.concat(F.slice(held["names"], 1, F.greatest(F.size(held["names"]) - 1, F.lit(0))), F.array(last))
        count = lambda c: F.length(piece) - F.length(F.translate(piece, c, ""))
        names = F.when(held["depth"] == 0, F.concat(held["names"], F.array(piece))).otherwise(joined)
        return F.struct(names.alias("names"), (held["depth"] + count("[") - count("]")).cast("int").alias("depth"))

    names = F.aggregate(F.split(text, "::"), start, step)["names"]
    base = F.element_at(names, -1)
    return F.when(name.isNotNull(), F.struct(F.slice(names, 1, F.size(names) - 1).alias("namespaces"), F.when(is_thunk, F.concat(F.lit("_thunk_"), base)).otherwise(base).alias("base")))


def substituted(name: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """``name`` after each substitution (pattern, replacement with $1 for a group) in turn."""
    for pattern, other in pairs:
        name = F.regexp_replace(name, pattern, other)
    return name


def identifier(path: Column) -> Column:
    """A path's file name in capitals, without its last suffix and what identifiers may not have."""
    base = F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)
    return F.regexp_replace(F.upper(F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")), "[^0-9a-zA-Z_]", "")


def class_of(name: Column) -> Column:
    return F.substring_index(name, "::", 1)


def shortened(name: Column, most: int = 20) -> Column:
    """A name's class, cut to ``most`` characters and three dots."""
    own = class_of(name)
    return F.when(F.length(own) > most, F.concat(F.substring(own, 1, most), F.lit("..."))).otherwise(own)


def struct_format(characters: Column) -> Column:
    """The format of packed little-endian scalars from the character of each; empty for none."""
    return F.when(F.size(characters) > 0, F.concat(F.lit("<"), F.array_join(characters, ""))).otherwise(F.lit(""))


def with_offset(name: Column, offset: Column) -> Column:
    """A member's name, or the distance into what has none."""
    return F.when(has_text(name), name).otherwise(F.concat(F.lit("+"), offset.cast("string")))
