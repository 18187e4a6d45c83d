"""What the tools for variables and stacks show, as lines.

Comparison itself is in :mod:`twinscope.operators.compare`; these put results into the
order and the words of a listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.functions import display
from twinscope.operators import compare
from twinscope.operators.store import State


def variables(pairs: DataFrame, layout: DataFrame, state: State | None = None, all_items: bool = False) -> DataFrame:
    """(orig_addr, name, verdict, n, line): the verdict of each variable, and a line for each
    of its scalars that differs, or for all. ``pairs`` and ``layout`` as compare.variables()."""
    items = compare.variables(pairs, layout, state)
    verdicts = compare.verdicts(items, "orig_addr").select("orig_addr", "verdict")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    line = display.compared_line(F.col("offset").cast("long"), F.col("member"), shown("orig_value"), shown("recomp_value"), F.col("equal"))
    rows = items.select("orig_addr", F.col("offset").alias("n"), line.alias("line"), F.lit(True).alias("_has") if all_items else (~F.col("equal")).alias("_has"))
    named = pairs.select("orig_addr", "name").join(verdicts, "orig_addr", "left")
    return named.join(rows.where("_has").drop("_has"), "orig_addr", "left").select("orig_addr", "name", F.coalesce("verdict", F.lit("MATCH")).alias("verdict"), "n", "line").orderBy("orig_addr", "n")


def stacks(blocks: DataFrame, orig_symbols: DataFrame | None = None, recomp_symbols: DataFrame | None = None, key: str = "orig_addr") -> DataFrame:
    """(key, side, register, offset, mark, line) for each place on either stack of a
    function: its partners on the other one, and whether they are one, and the same place.
    ``blocks`` as compare.stack_pairs(); symbols: key, register, offset, symbol."""
    pairs = compare.stack_pairs(blocks, key)
    out = None
    for side, other, own in (("orig", "recomp", orig_symbols), ("recomp", "orig", recomp_symbols)):
        per = pairs.groupBy(key, F.col(f"{side}.register").alias("register"), F.col(f"{side}.offset").alias("offset")).agg(F.array_sort(F.collect_set(other)).alias("partners"))
        known = per.withColumn("symbol", F.lit(None).cast("string")) if own is None else per.join(own.select(key, "register", "offset", "symbol"), [key, "register", "offset"], "left")
        place = display.stack_offset_text(F.col("register"), F.col("offset"), F.col("symbol"))
        others = F.array_join(F.transform("partners", lambda x: display.stack_offset_text(x["register"], x["offset"])), ", ")
        same = F.get("partners", F.lit(0)) == F.struct("register", "offset")
        mark = display.stack_mark(F.size("partners"), same)
        rows = known.select(key, F.lit(side).alias("side"), "register", "offset", mark.alias("mark"), F.concat(mark, F.lit("  "), place, F.lit(": "), others).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(key, "side", "register", "offset")


def stack_findings(blocks: DataFrame, key: str = "orig_addr") -> DataFrame:
    """(key, finding) of functions whose stacks are not one to one, and of those whose
    listings differ in shape, so that places may be missing."""
    crossed = stacks(blocks, key=key).where("mark = 'ERROR'").select(key).distinct().withColumn("finding", F.lit("NOT_ONE_TO_ONE"))
    shape = compare.structural_mismatches(blocks).select(key).distinct().withColumn("finding", F.lit("STRUCTURE_DIFFERS"))
    return crossed.unionByName(shape)
