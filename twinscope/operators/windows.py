"""Window operators: sizes from neighbours, numbered names, order lints, outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import entity
from twinscope.operators import joins, lineage


def max_sizes(entities: DataFrame, sections: DataFrame, img: int) -> DataFrame:
    """(addr, max_size) of the measured entities without a size: the distance to the next
    solid entity of their section, or to the section's end."""
    solid = entities.where((F.col("img") == img) & F.col("type").isin(*schema.SOLID)).select("img", "addr", "type", entity.size(img).alias("own"))
    ranges = sections.where(F.col("img") == img).select("img", "start", (F.col("stop") - F.col("start")).alias("size"), "section_id", "stop")
    held = joins.interval_join(solid, ranges, "addr", ("img",), columns=("section_id", "stop")).where("section_id is not null")
    after = F.lead("addr").over(Window.partitionBy("section_id").orderBy("addr"))
    sized = held.withColumn("max_size", F.coalesce(after, "stop") - F.col("addr"))
    return sized.where(F.col("own").isNull() & F.col("type").isin(*schema.MEASURED)).select("addr", "max_size")


def estimated_sizes(symbols: DataFrame, by: Sequence[str], offset: str, end: Column | None = None) -> DataFrame:
    """``symbols`` with the distance to the next offset, or to ``end`` for the last."""
    after = F.lead(offset).over(Window.partitionBy(*by).orderBy(offset))
    return symbols.withColumn("estimated_size", (F.coalesce(after, end) if end is not None else after) - F.col(offset))


def overloaded(merged: DataFrame) -> DataFrame:
    """Functions whose name others have too, with the number of each, in order."""
    named = merged.where((F.col("type") == schema.FUNCTION) & F.col("name").isNotNull())
    by_name = Window.partitionBy("name")
    order = by_name.orderBy(F.col("orig_addr").asc_nulls_last(), "recomp_addr")
    counted = named.withColumns({"nth": F.row_number().over(order), "_n": F.count("*").over(by_name)})
    return counted.where("_n > 1").select("orig_addr", "recomp_addr", "name", "symbol", "nth")


def unique_names(overloads: DataFrame, arguments: Column | None = None) -> DataFrame:
    """A name of its own for each: with its arguments where they are known, else its number."""
    number = F.concat(F.lit("("), F.col("nth").cast("string"), F.lit(")"))
    return overloads.withColumn("computed_name", F.concat("name", number if arguments is None else F.coalesce(arguments, number)))


def out_of_order(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("previous", before).where(F.col(value) < F.col("previous"))


def repeated_keys(rows: DataFrame, keys: Sequence[str], order: Sequence[str], exempt: Column) -> DataFrame:
    """Rows that are not the first of their key, but for exempt ones (which still count
    as firsts)."""
    return joins.numbered(rows, keys, order, "_nth").where((F.col("_nth") > 1) & ~exempt).drop("_nth")


def differs_from_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value is not that of the first row of their key."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("first_value", first).where(~F.col(value).eqNullSafe(F.col("first_value")))


def first_unless(rows: DataFrame, keys: Sequence[str], order: Sequence[str], exempt: Column) -> DataFrame:
    """The first row of each key, and all exempt ones."""
    return joins.numbered(rows, keys, order, "_nth").where((F.col("_nth") == 1) | exempt).drop("_nth")


def rising(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value exceeds that of all kept rows before: since what is kept rises,
    the largest kept value is the largest value so far (and at least 0)."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_most", F.coalesce(F.max(value).over(before), F.lit(0))).where(F.col(value) > F.col("_most")).drop("_most")


def mean_without_outliers(rows: DataFrame, by: Sequence[str], value: str, sigmas: float = 2.0) -> DataFrame:
    """The mean of the values within so many population deviations of the mean, cut to
    a whole number; a value alone is its own mean."""
    w = Window.partitionBy(*by)
    marked = rows.withColumns({"_mean": F.avg(value).over(w), "_dev": F.stddev_pop(value).over(w), "_n": F.count("*").over(w)})
    near = marked.where((F.col("_n") == 1) | (F.abs(F.col(value) - F.col("_mean")) <= sigmas * F.col("_dev")))
    return near.groupBy(*by).agg(F.avg(value).cast("long").alias("mean"))


def filled_down(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Each row with the last value at or before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_number(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows with their number, from 0, in one order over all of them: ranges of the order
    are counted, and each numbers its rows from where the ranges before it end. Only the
    counts, one a range, are ever in one task."""
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = lineage.cut(ranged)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + within - 1).drop("_range", "_offset")


def pages(rows: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """Rows with their page, from 0."""
    return running_number(rows, order, "_row").withColumn("page", F.floor(F.col("_row") / size).cast("int")).drop("_row")
