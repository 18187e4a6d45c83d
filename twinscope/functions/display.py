"""Text that listings show for stacks, variables and dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinscope.functions import codec


def stack_offset_text(register: Column, offset: Column, symbol: Column | None = None) -> Column:
    """A place on the stack: register, distance with two digits at least, and its symbol."""
    digits = F.lower(F.hex(F.abs(offset)))
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    text = F.concat(register, F.when(offset > 0, F.lit(" + 0x")).otherwise(F.lit(" - 0x")), padded)
    return text if symbol is None else F.concat(text, F.coalesce(F.concat(F.lit("  "), symbol), F.lit("")))


def stack_mark(n_partners: Column, same: Column) -> Column:
    """What the listing of stack pairs says: equal, swapped, or not one to one."""
    return F.when(n_partners != 1, "ERROR").when(same, "CHECK").otherwise("SWAP")


def compared_line(offset: Column, name: Column, orig: Column, recomp: Column, equal: Column) -> Column:
    """One compared scalar: its offset, name, and value, or both values if they differ."""
    digits = F.lower(F.hex(offset))
    at = F.concat(F.lit("+ 0x"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    at = F.when(F.length(at) < 10, F.lpad(at, 10, " ")).otherwise(at)
    known = F.coalesce(name, F.lit(""))
    label = F.concat(F.when(known != "", F.lit(": ")).otherwise(F.lit("  ")), F.when(F.length(known) < 30, F.rpad(known, 30, " ")).otherwise(known))
    return F.concat(at, F.lit(" "), label, F.lit(" "), orig, F.when(equal, F.lit("")).otherwise(F.concat(F.lit(" : "), recomp)))


def pointer_text(address: Column, match_name: Column) -> Column:
    """What a pointer is shown as: its target's name if it has one."""
    return F.when(address == 0, "nullptr").when(match_name.isNotNull(), F.concat(F.lit("Pointer to "), match_name)).otherwise(F.concat(F.lit("Unknown pointer "), codec.to_hex(address)))


def dump_line(address: Column, text: Column) -> Column:
    """A line of an assembly dump: its address, if it has one, and the instruction."""
    at = F.when(F.length(address) < 10, F.rpad(address, 10, " ")).otherwise(address)
    return F.concat(F.when(F.coalesce(address, F.lit("")) != "", at).otherwise(F.lit("        ")), F.lit(": "), text)
