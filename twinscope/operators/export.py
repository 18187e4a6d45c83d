"""What other programs are told about matched functions: signatures, and what changes.

``symbols`` are debug symbols of the recompiled image (addr, name, func_type, call_type,
symbols array of stored variables); ``types`` are type records (see symbol_dump.records).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signatures(matches: DataFrame, symbols: DataFrame, types: DataFrame) -> DataFrame:
    """Matched functions with their signature: the type record of the symbol at the
    recompiled address, and of that the list of arguments. Both may be missing."""
    kinds = types.select(F.col("key").alias("func_type"), "return_type", "call_type", "class_type", "this_adjust", F.col("arg_list_type").alias("_args"))
    args = types.select(F.col("key").alias("_args"), F.col("args").alias("arguments"))
    found = matches.join(symbols.withColumnRenamed("addr", "recomp_addr").drop("name"), "recomp_addr", "left")
    return found.join(kinds, "func_type", "left").join(args, "_args", "left").drop("_args")


def parameter_names(parameters: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parameters (function, ordinal, register, stack_offset) with the name of the symbol
    (function, location, name) at their place: a register, in any case of letters, or an
    offset from the frame."""
    place = F.coalesce(F.lower("register"), F.concat(F.lit("["), F.lower(F.hex("stack_offset")), F.lit("]")))
    at = symbols.select("function", F.lower("location").alias("_place"), "name")
    return parameters.withColumn("_place", place).join(at, ["function", "_place"], "left").drop("_place")


def changed(known: DataFrame, wanted: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """The rows of ``wanted`` that are new or differ from the ``known`` row of their key in
    any column, with whether they are new; equal ones need no work."""
    k = known.select(key, F.struct(*columns).alias("_known"), F.lit(True).alias("_is"))
    found = wanted.withColumn("_wanted", F.struct(*columns)).join(k, key, "left")
    same: Column = F.coalesce(F.col("_is"), F.lit(False)) & F.col("_known").eqNullSafe(F.col("_wanted"))
    return found.where(~same).withColumn("is_new", F.col("_is").isNull()).drop("_known", "_wanted", "_is")
