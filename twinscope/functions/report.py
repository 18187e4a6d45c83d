"""Columns over compared entities: ranks, ratios, judgements, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accuracy_rank(accuracy: Column, effective: Column, stub: Column) -> Column:
    """How good a result is: stubs below all, exact matches above all, and effective
    matches just below those that are exact."""
    return F.when(stub, -1.0).when((accuracy == 1.0) & ~effective, 1000.0).when(effective, 1.0).otherwise(accuracy)


def effective_accuracy(accuracy: Column, effective: Column) -> Column:
    return F.when(effective, 1.0).otherwise(accuracy)


#: What a pair of reports says about an entity.
JUDGEMENTS = ("NEW", "INCREASE", "DECREASE", "DROPPED", "ENTROPY", "NO_CHANGE")


def judgement(old: str, new: str) -> Column:
    """The change from one report's row to another's; ``old`` and ``new`` are prefixes of
    the columns present, is_stub, is_effective_match, and accuracy. The first rule holds."""
    o, n = (lambda c: F.col(old + c)), (lambda c: F.col(new + c))
    eff_o, eff_n, acc_o, acc_n = o("is_effective_match"), n("is_effective_match"), o("accuracy"), n("accuracy")
    rules = [
        (o("present").isNull(), "NEW"),
        (n("present").isNull(), "DROPPED"),
        (o("is_stub") & n("is_stub"), "NO_CHANGE"),
        (o("is_stub"), "INCREASE"),
        (n("is_stub"), "DECREASE"),
        ((acc_o == 1.0) & eff_n, "ENTROPY"),
        (eff_o & (acc_n == 1.0), "INCREASE"),
        (eff_o & eff_n, "NO_CHANGE"),
        (eff_o, "DECREASE"),
        (eff_n, "INCREASE"),
        (acc_o < acc_n, "INCREASE"),
        (acc_o > acc_n, "DECREASE"),
    ]
    out = F.lit("NO_CHANGE")
    for test, verdict in reversed(rules):
        out = F.when(test, F.lit(verdict)).otherwise(out)
    return out


def rounded(ratio: Column, places: int) -> Column:
    """To so many places, half-way up where the shifted double is half-way; what becomes
    zero keeps its sign. Spark's own function goes by the digits that the number is written
    with, so it rounds 0.0001499.., which is written 0.00015, up, and loses the sign; SQL
    engines that compute in doubles do not."""
    return F.signum(ratio) * F.round(F.abs(ratio) * float(10**places)) / float(10**places)


def percent_text(ratio: Column, effective: Column) -> Column:
    return F.concat(F.format_string("%.2f%%", ratio * 100), F.when(effective, F.lit("*")).otherwise(F.lit("")))


def percent_colour(ratio: Column) -> Column:
    return F.when(ratio == 1.0, "green").when(ratio > 0.8, "yellow").otherwise("red")
