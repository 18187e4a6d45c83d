"""Lints over annotated code: order, repeated offsets, texts, references by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.operators import windows
from twinscope.sources.annotations import ALERTS, KINDS

_HEADER = r"(?i)\.(h|hh|hpp|hxx)$"


def _alerts(rows: DataFrame, name: str, detail: str = "name", target: str | None = "module") -> DataFrame:
    return rows.select(F.lit(ALERTS[name]).alias("code"), "path", "line_number", F.col(detail).cast("string").alias("detail"), (F.col(target) if target else F.lit(None)).cast("string").alias("target"))


def by_name_outside_headers(symbols: DataFrame) -> DataFrame:
    """Functions that a name stands for belong in headers."""
    return _alerts(symbols.where((F.col("kind") == "function") & F.col("lookup_by_name") & ~F.col("path").rlike(_HEADER)), "BYNAME_FUNCTION_IN_CPP")


def function_order(symbols: DataFrame) -> DataFrame:
    """Functions whose address is below that of the one before in the same file."""
    used = symbols.where((F.col("kind") == "function") & ~F.col("lookup_by_name") & ~F.col("is_folded") & ~F.col("path").rlike(_HEADER))
    return _alerts(windows.out_of_order(used, ("path", "module"), "seq", "offset"), "FUNCTION_OUT_OF_ORDER")


def repeated_offsets(symbols: DataFrame) -> DataFrame:
    """Symbols at an address that an earlier one has; folded functions and strings may."""
    exempt = F.col("is_folded") | (F.col("kind") == "string")
    return _alerts(windows.repeated_keys(symbols, ("module", "offset"), ("path", "seq"), exempt), "DUPLICATE_OFFSET")


def changed_strings(symbols: DataFrame) -> DataFrame:
    """Strings that differ from the first one at their address."""
    texts = symbols.where("kind = 'string'")
    return _alerts(windows.differs_from_first(texts, ("module", "offset"), ("path", "seq"), "name"), "WRONG_STRING")


def files(symbols: DataFrame, alerts: DataFrame) -> DataFrame:
    """All alerts: those of reading, of files, and of all files together."""
    found = alerts
    for more in (by_name_outside_headers(symbols), function_order(symbols), repeated_offsets(symbols), changed_strings(symbols)):
        found = found.unionByName(more)
    return found


def aliases(spark, words: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Alerts for aliases that do nothing: those that point to no kind of marker."""
    rows = [(ALERTS["ALIAS_GOES_NOWHERE"], None, 0, f"{word} = {meaning}", target) for target, pairs in words.items() for word, meaning in pairs.items() if meaning.upper() not in KINDS or word.upper() in KINDS]
    return spark.createDataFrame(rows, "code int, path string, line_number int, detail string, target string")


def in_order(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.lower("path"), "path", "line_number", "code")


def counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count_if(F.col("code") >= 200).alias("errors"), F.count_if(F.col("code") < 200).alias("warnings"))


def usable(symbols: DataFrame, valid) -> tuple[DataFrame, DataFrame]:
    """(symbols at valid addresses, the others); ``valid`` is a column."""
    ok = F.coalesce(valid, F.lit(False))
    return symbols.where(ok), symbols.where(~ok)


def first_uses(symbols: DataFrame) -> DataFrame:
    """The first symbol of each address, and folded functions."""
    return windows.first_unless(symbols, ("module", "offset"), ("path", "seq"), F.col("is_folded"))


def failed(alerts: DataFrame, warnings_too: bool = False) -> bool:
    """Whether a run of the linter fails: on errors, or on warnings too if asked for."""
    found = counts(alerts).first()
    return bool(found.errors or (warnings_too and found.warnings))
