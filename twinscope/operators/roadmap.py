"""Where modules lie in both images, and the order that suggests for a rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.functions import codec, display, entity
from twinscope.operators import joins, windows


def module_prefix(module: Column) -> Column:
    """The first two parts of an object file's path, which name its target."""
    return F.concat(F.substring_index(module, "/", 2), F.lit("/"))


def short_name(module: Column) -> Column:
    """A module without its target's folder and without .obj."""
    return F.regexp_replace(F.substring(module, F.length(module_prefix(module)) + 1, F.length(module)), r"\.obj$", "")


def type_short(type_: Column | str) -> Column:
    return F.substring(F.lower(entity.type_name(type_)), 1, 3)


def modules_of(addresses: DataFrame, contributions: DataFrame, modules: DataFrame) -> DataFrame:
    """``addresses`` (recomp_addr) with the object file that each is from, and its library."""
    ranges = contributions.select("start", "size", F.col("module").alias("module_id"))
    found = joins.interval_join(addresses, ranges, "recomp_addr", columns=("module_id",)).drop("base", "size")
    return found.join(modules.select(F.col("id").cast("long").alias("module_id"), F.col("obj").alias("module"), "lib"), "module_id", "left").drop("module_id")


def rows(matches: DataFrame, sections: DataFrame, contributions: DataFrame, modules: DataFrame) -> DataFrame:
    """A row for each match: both places in their sections, how far it has moved if both
    sections have the same name, and its module. ``sections``: img, start, stop, name."""
    at = matches
    for img, addr, out in ((0, "orig_addr", "orig"), (1, "recomp_addr", "recomp")):
        ranges = sections.where(F.col("img") == img).select("start", (F.col("stop") - F.col("start")).alias("size"), F.col("name").alias(f"{out}_section"), F.col("section_id").alias(f"{out}_id"))
        at = joins.interval_join(at, ranges, addr, columns=(f"{out}_section", f"{out}_id"))
        place = F.concat(F.lpad(F.hex(F.col(f"{out}_id")), 4, "0"), F.lit(":"), F.lpad(F.hex(F.col(addr) - F.col("base")), 8, "0"))
        at = at.withColumn(f"{out}_place", place).drop("base", "size")
    moved = F.when(F.col("orig_section").eqNullSafe(F.col("recomp_section")), F.col("recomp_addr") - F.col("orig_addr"))
    named = modules_of(at.where("recomp_section is not null").withColumn("displacement", moved), contributions, modules)
    return named.select("orig_place", "recomp_place", "orig_addr", "recomp_addr", "displacement", type_short("type").alias("row_type"), "name", "module", "lib")


def module_order(road: DataFrame, row_type: str) -> DataFrame:
    """Modules by the mean of their original addresses without outliers, with the earliest
    one and the mean distance moved."""
    used = road.where((F.col("row_type") == row_type) & F.col("module").isNotNull() & F.col("orig_addr").isNotNull())
    means = windows.mean_without_outliers(used, ("module",), "orig_addr")
    about = used.groupBy("module").agg(F.min("orig_addr").alias("earliest"), F.avg("displacement").cast("long").alias("mean_displacement"), F.max("lib").alias("lib"))
    return means.join(about, "module").orderBy("mean", "module")


def library_order(order: DataFrame) -> DataFrame:
    """Libraries by the lowest mean of their modules."""
    return order.groupBy(F.coalesce("lib", module_prefix(F.col("module"))).alias("library")).agg(F.min("mean").alias("start")).orderBy("start", "library")


def leftover(all_modules: DataFrame, order: DataFrame) -> DataFrame:
    return all_modules.join(order.select("module"), "module", "left_anti")


def as_text(road: DataFrame, matched_only: bool = False) -> DataFrame:
    """Rows as lines of a listing, all or those that both images have."""
    if matched_only:
        road = road.where(F.col("orig_addr").isNotNull() & F.col("recomp_addr").isNotNull())
    address = lambda c: F.coalesce(codec.to_hex(F.col(c)), F.lit(""))
    return road.select(F.concat_ws("  ", F.rpad(F.coalesce("orig_place", F.lit("")), 14, " "), F.rpad(F.coalesce("recomp_place", F.lit("")), 14, " "), F.rpad(address("orig_addr"), 10, " "), F.rpad(address("recomp_addr"), 10, " "), F.lpad(F.coalesce(F.col("displacement").cast("string"), F.lit("")), 8, " "), "row_type", F.coalesce("name", F.lit(""))).alias("line"))


def dumps(rows: DataFrame, by: str) -> DataFrame:
    """The assembly of matched functions as lines in the order of one side's addresses.
    ``rows``: by (the address), name, lines array<struct<addr, text>>."""
    heads = rows.select(F.col(by).alias("at"), F.lit(-1).alias("n"), F.concat(F.lit("; "), "name").alias("line"))
    body = rows.select(F.col(by).alias("at"), F.posexplode("lines").alias("n", "x")).select("at", "n", display.dump_line(F.col("x.addr"), F.col("x.text")).alias("line"))
    return heads.unionByName(body).orderBy("at", "n")


def order_mark(modules: DataFrame) -> DataFrame:
    """Modules with the mark of those that are out of order. Earliest addresses are compared
    with a bound that only a marked module lowers, from 0, so no module is ever marked."""
    return modules.withColumn("mark", F.lit(" "))
