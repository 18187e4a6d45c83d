"""Debug lines: places in source files and the addresses of their code.

Rows are (path, line_no, addr, seq), and is_start for the first line of a function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.operators import joins


def mark_starts(debug_lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with is_start: whether a function starts at their address (``starts``: addr)."""
    known = starts.select("addr").distinct().withColumn("is_start", F.lit(True))
    return debug_lines.drop("is_start").join(known, "addr", "left").withColumn("is_start", F.coalesce("is_start", F.lit(False)))


def starts_in_code(nodes: DataFrame, debug_lines: DataFrame) -> DataFrame:
    """The addresses of ``nodes`` that a line has: those of functions."""
    return nodes.select("addr").distinct().join(debug_lines.select("addr"), "addr", "left_semi")


def line_of(debug_lines: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (addr) with the path and line that were given last for their address."""
    last = debug_lines.groupBy("addr").agg(F.max_by(F.struct("path", "line_no"), "seq").alias("_at"))
    return probes.join(last, "addr", "left").select(*probes.columns, "_at.path", "_at.line_no")


def search(debug_lines: DataFrame, ranges: DataFrame, starts_only: bool = False) -> DataFrame:
    """Ranges (path, low, high) with each address that has a line in them."""
    points = debug_lines.where("is_start") if starts_only else debug_lines
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") / 64), F.floor(F.col("high") / 64))))
    near = points.select("path", F.floor(F.col("line_no") / 64).alias("_bucket"), "line_no", "addr")
    return spread.join(near, ["path", "_bucket"]).where(F.col("line_no").between(F.col("low"), F.col("high"))).select(*ranges.columns, "line_no", "addr")


def function_in(debug_lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges (path, low, high) with the one function that starts in them, addr: null if
    none does, or more than one; n_values says how many do."""
    return joins.unique_in_range(ranges, debug_lines.where("is_start"), ("path",), "low", "high", "line_no", "addr")


def with_source(instructions: DataFrame, debug_lines: DataFrame, pinned: DataFrame) -> DataFrame:
    """Instructions (addr, text) followed by where their code comes from, as file:line,
    and whether they are ``pinned`` (addr) to a place of the other text."""
    placed = line_of(debug_lines, instructions).join(pinned.select("addr").distinct().withColumn("_pinned", F.lit(True)), "addr", "left")
    at = F.concat(F.regexp_extract("path", r"([^/\\]*)$", 1), F.lit(":"), F.col("line_no").cast("string"))
    note = F.concat(F.lit(" \t("), at, F.when(F.col("_pinned"), F.lit(", pinned")).otherwise(F.lit("")), F.lit(")"))
    return placed.select(*[c for c in instructions.columns if c != "text"], F.concat("text", F.coalesce(note, F.lit(""))).alias("text"))
