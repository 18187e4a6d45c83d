"""Reports: totals, the best of several samples, and the difference of two.

Rows are as schema.REPORT. A report's addresses are text and sort as text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec, report

VARIOUS = "various"


def from_matches(compared: DataFrame, filename: str, sample_id: int = 0) -> DataFrame:
    """Report rows for compared entities with numbers as addresses."""
    return compared.select(
        F.lit(sample_id).alias("sample_id"), F.lit(filename).alias("filename"), codec.to_hex(F.col("orig_addr")).alias("orig_addr"), codec.to_hex(F.col("recomp_addr")).alias("recomp_addr"),
        "name", F.col("type").cast("int").alias("type"), "accuracy", F.coalesce("is_effective_match", F.lit(False)).alias("is_effective_match"), F.coalesce("is_stub", F.lit(False)).alias("is_stub"),
    )


def same_source(samples: DataFrame) -> bool:
    """Whether all samples are about one file, whatever the case of its name."""
    return samples.select(F.lower("filename")).distinct().limit(2).count() <= 1


def combine(samples: DataFrame) -> DataFrame:
    """The best result of each address over all samples, the earliest of equals; the
    recompiled address stays where all samples agree on it."""
    rank = report.accuracy_rank(F.col("accuracy"), F.col("is_effective_match"), F.col("is_stub"))
    best = F.max_by(F.struct("recomp_addr", "name", "type", "accuracy", "is_effective_match", "is_stub"), F.struct(rank, -F.col("sample_id"))).alias("b")
    # An absent address is a value of its own here, so a plain distinct count, which skips nulls, would not do.
    known = F.concat_ws("", F.when(F.col("recomp_addr").isNull(), "-").otherwise("+"), "recomp_addr")
    each = samples.groupBy("orig_addr").agg(best, F.min(known).alias("lo"), F.max(known).alias("hi"))
    agreed = F.when(F.col("lo") == F.col("hi"), F.col("b.recomp_addr")).otherwise(F.lit(VARIOUS))
    return each.select("orig_addr", agreed.alias("recomp_addr"), *[f"b.{c}" for c in ("name", "type", "accuracy", "is_effective_match", "is_stub")])


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every address of either report with its judgement, and both sides' results."""
    columns = ("recomp_addr", "name", "accuracy", "is_effective_match", "is_stub")
    o = old.select("orig_addr", F.lit(True).alias("old_present"), *[F.col(c).alias(f"old_{c}") for c in columns])
    n = new.select("orig_addr", F.lit(True).alias("new_present"), *[F.col(c).alias(f"new_{c}") for c in columns])
    return o.join(n, "orig_addr", "full").withColumn("judgement", report.judgement("old_", "new_"))


def diff_lines(changes: DataFrame, both_addresses: bool = False) -> DataFrame:
    """The changes as listings show them, without those that say nothing."""
    def side(prefix: str, none: str) -> Column:
        text = report.percent_text(report.effective_accuracy(F.col(f"{prefix}accuracy"), F.col(f"{prefix}is_effective_match")), F.col(f"{prefix}is_effective_match"))
        return F.when(F.col(f"{prefix}present").isNull(), none).when(F.col(f"{prefix}is_stub"), "stub").otherwise(text)

    name = F.when(F.coalesce("new_name", F.lit("")) != "", F.col("new_name")).otherwise(F.col("old_name"))
    addr = F.concat("orig_addr", F.lit(" / "), F.rpad(F.coalesce("new_recomp_addr", F.lit("n/a")), 10, " ")) if both_addresses else F.col("orig_addr")
    text = F.concat(addr, F.lit(" - "), name, F.lit(" ("), side("old_", "new"), F.lit(" -> "), side("new_", "gone"), F.lit(")"))
    return changes.where("judgement <> 'NO_CHANGE'").select("judgement", "orig_addr", text.alias("line"))


def totals(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of functions: how many are not stubs, the sums of accuracy and of effective
    accuracy, and how many kept their address. progress_functions also counts rows
    without a type, which old reports lack."""
    is_function = F.coalesce(F.col("type") == schema.FUNCTION, F.lit(False))
    counted = is_function & ~F.col("is_stub")
    effective = report.effective_accuracy(F.col("accuracy"), F.col("is_effective_match"))
    loose = (F.col("type").isNull() | (F.col("type") == schema.FUNCTION)) & ~F.col("is_stub")
    zero = F.lit(0.0)
    return rows.groupBy(*by).agg(
        F.count_if(counted).alias("functions"),
        F.coalesce(F.sum(F.when(counted, F.col("accuracy"))), zero).alias("accuracy"),
        F.coalesce(F.sum(F.when(counted, effective)), zero).alias("effective_accuracy"),
        F.count_if(is_function & F.coalesce(F.col("orig_addr") == F.col("recomp_addr"), F.lit(False))).alias("aligned"),
        F.count_if(loose).alias("progress_functions"),
        F.coalesce(F.sum(F.when(loose, effective)), zero).alias("progress_accuracy"),
    )


def summary(total: DataFrame, unmatched: int = 0, expected: int = 0) -> DataFrame:
    """Shares of the totals; of all functions there are at least ``expected``."""
    everything = F.greatest(F.col("functions") + unmatched, F.lit(expected))
    share = lambda a, b: a / F.when(b == 0, 1).otherwise(b)
    return total.withColumns({
        "implemented": share(F.col("functions"), everything), "mean_accuracy": share(F.col("effective_accuracy"), F.col("functions")),
        "progress": share(F.col("effective_accuracy"), everything), "alignment": share(F.col("aligned"), F.col("functions")),
    })


def without(rows: DataFrame, names: DataFrame | None = None, libraries: bool = True) -> DataFrame:
    """Leave out ignored names, and library code unless asked for."""
    if names is not None:
        rows = rows.join(names.select("name"), "name", "left_anti")
    return rows if libraries else rows.where(~F.coalesce("library", F.lit(False)))


# What the report browser asks


def search(rows: DataFrame, query: str = "", kind: str = "name", hide_perfect: bool = False, hide_stubs: bool = False) -> DataFrame:
    """Filter rows. ``kind`` is name (or address), code (any line of the diff), or diff
    (lines that differ); rows with a ``diff`` column as schema.DIFF."""
    if hide_perfect:
        rows = rows.where(~(F.col("is_effective_match") | (F.col("accuracy") >= 1)))
    if hide_stubs:
        rows = rows.where(~F.col("is_stub"))
    wanted = query.lower().strip()
    if not wanted:
        return rows
    if kind == "name":
        return rows.where(F.contains("orig_addr", F.lit(wanted)) | F.contains(F.lower("name"), F.lit(wanted)))
    hit = lambda lines: F.exists(F.coalesce(lines, F.array().cast("array<array<string>>")), lambda x: F.contains(F.lower(F.trim(F.get(x, F.lit(1)))), F.lit(wanted)))
    any_of = lambda g: hit(g["orig"]) | hit(g["recomp"]) | (hit(g["both"]) if kind == "code" else F.lit(False))
    return rows.where(F.exists(F.flatten(F.transform("diff", lambda d: d["groups"])), any_of))


def sort_columns(column: str, descending: bool = False) -> list[Column]:
    """Order by one column; accuracy ranks as results do. Equal rows keep their order,
    which is that of addresses; rows without a value or an address come last."""
    key = report.accuracy_rank(F.col("accuracy"), F.col("is_effective_match"), F.col("is_stub")) if column == "accuracy" else F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("orig_addr").asc_nulls_last()]


def page_headings(paged: DataFrame, order: Sequence[Column], shown: str) -> DataFrame:
    """The first and last value of each page, of the rows that have one."""
    key = F.when(F.col(shown).isNotNull(), F.struct("page", "row"))
    return paged.groupBy("page").agg(F.min_by(shown, key).alias("first"), F.max_by(shown, key).alias("last"))


def diff_blocks(diff_: Column) -> Column:
    """How many blocks of a diff differ."""
    return F.size(F.filter(F.flatten(F.transform(diff_, lambda d: d["groups"])), lambda g: g["both"].isNull()))


def shown_diff(stored: Column, whole: Column, grouped: Column) -> Column:
    """The diff that a report shows of a row (type, is_effective_match, accuracy): one that
    it has already; all of a table's; and the differing groups of what is not exact."""
    inexact = F.col("is_effective_match") | (F.col("accuracy") != 1.0)
    return F.coalesce(stored, F.when(F.col("type") == schema.VTABLE, whole).when(inexact, grouped))


def by_address(rows: DataFrame, address: str) -> DataFrame:
    """The row of one address."""
    return rows.where(F.col("orig_addr") == address)


def shown_columns(rows: DataFrame, recomp: bool, sort: str) -> tuple[DataFrame, str]:
    """Rows as a listing shows them, with or without the recompiled address, and the
    column to sort by, which is one that is shown."""
    if recomp:
        return rows, sort
    return rows.drop("recomp_addr"), "orig_addr" if sort == "recomp_addr" else sort


def diff_rows(diffs: DataFrame, key: str = "orig_addr") -> DataFrame:
    """Diffs as rows of a listing: (key, block, n, orig_addr, recomp_addr, mark, text)."""
    none = F.array().cast("array<array<string>>")
    row = lambda lines, o, r, mark, t: F.transform(F.coalesce(lines, none), lambda x: F.struct((F.get(x, F.lit(o)) if o is not None else F.lit("")).alias("orig_line"), (F.get(x, F.lit(r)) if r is not None else F.lit("")).alias("recomp_line"), F.lit(mark).alias("mark"), F.get(x, F.lit(t)).alias("text")))
    blocks = diffs.select(key, F.posexplode(F.flatten(F.transform("diff", lambda d: d["groups"]))).alias("block", "x"))
    all_ = F.concat(row(F.col("x.both"), 0, 2, " ", 1), row(F.col("x.orig"), 0, None, "-", 1), row(F.col("x.recomp"), None, 0, "+", 1))
    return blocks.select(key, "block", F.posexplode(all_).alias("n", "r")).select(key, "block", "n", "r.orig_line", "r.recomp_line", "r.mark", "r.text")


def failure_counts(failures: DataFrame) -> DataFrame:
    """(error, subject, n, first): failures (seq, error, subject) by kind and subject, how
    often each occurred and when first, the most frequent first."""
    return failures.groupBy("error", "subject").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first")


def first_failures(failures: DataFrame, told_once: Sequence[str]) -> DataFrame:
    """The failures worth telling: of the kinds ``told_once`` the first of each subject, and
    all others."""
    once = F.col("error").isin(*told_once)
    first = failures.where(once).groupBy("error", "subject").agg(F.min("seq").alias("seq")).select("seq", "error", "subject")
    return first.unionByName(failures.where(~once).select("seq", "error", "subject"))
