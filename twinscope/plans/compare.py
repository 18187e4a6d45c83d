"""Whole runs: reconcile two images, compare what matches, aggregate and report.

A run is an ordered list of stages over an immutable state, the surest first. Stages are
lazy plans; the lineage is cut after each in spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import entity
from twinscope.functions import names as symbols
from twinscope.operators import compare, diff, lineage, matchers, naming, reports, store, windows
from twinscope.operators.store import State
from twinscope.sources import annotations, reports_json

Stage = Callable[[State], State]


def sizes(img: int) -> Stage:
    """Give measured entities without a size the room that they have."""
    column = "orig_max_size" if img == schema.ORIG else "recomp_max_size"

    def stage(state: State) -> State:
        found = windows.max_sizes(state.entities, state.sections, img)
        return state.upsert(store.delta(found, {column: F.col("max_size")}, img))

    return stage


def names(state: State, demangle: Callable[[str], str | None] | None = None) -> State:
    """Tell overloaded functions apart, by their arguments where a demangler finds them in
    the symbol and else by number, and name what stands for others after them."""
    arguments = None if demangle is None else symbols.arguments(symbols.demangled(F.col("symbol"), demangle))
    own = lineage.cut(windows.unique_names(windows.overloaded(state.merged()), arguments))
    at = own.select(F.when(F.col("orig_addr").isNotNull(), schema.ORIG).otherwise(schema.RECOMP).alias("img"), F.coalesce("orig_addr", "recomp_addr").alias("addr"), "computed_name")
    state = state.upsert(store.delta(at, {"computed_name": F.col("computed_name")})).cut()
    found = lineage.cut(naming.thunk_names(lineage.cut(state.merged()), eager=True))
    return state.upsert(store.delta(found, {"name": F.col("name")}))


def default_stages(debug_lines: DataFrame | None = None, truncate: bool = False, demangle: Callable[[str], str | None] | None = None) -> list[Stage]:
    """The matchers in the order of confidence, then sizes, references, and names."""
    stages: list[Stage] = [lambda s: matchers.symbols(s, truncate), lambda s: matchers.functions(s, truncate), matchers.vtables, matchers.static_variables, matchers.variables]
    if debug_lines is not None:
        stages.append(lambda s: matchers.lines(s, debug_lines))
    return [*stages, matchers.imports, sizes(schema.ORIG), sizes(schema.RECOMP), matchers.references, lambda s: names(s, demangle), matchers.strings]


def reconcile(state: State, stages: Sequence[Stage]) -> State:
    return matchers.run(state, stages)


def from_annotations(files: DataFrame, module: str, aliases=None) -> DataFrame:
    """Entities (with alerts left aside) that annotated code declares for one module."""
    symbols, _ = annotations.parse(files, aliases)
    own = symbols.where(F.col("module") == module.upper())
    kind = F.col("kind")
    type_ = F.when(kind == "function", schema.FUNCTION).when(kind == "vtable", schema.VTABLE).when(kind == "variable", schema.DATA).when(kind == "line", schema.LINE).when(F.col("is_widechar"), schema.WIDECHAR).otherwise(schema.STRING)
    named = F.when((kind == "function") & (~F.col("lookup_by_name") | F.col("name_is_symbol")), None).otherwise(F.col("name"))
    return own.select(
        F.lit(schema.ORIG).alias("img"), F.col("offset").alias("addr"), type_.alias("type"), named.alias("name"), F.when(F.col("name_is_symbol"), F.col("name")).alias("symbol"), F.when(F.col("marker_type") == "STUB", True).alias("stub"),
        F.when(F.col("marker_type") == "LIBRARY", True).alias("library"), F.when(F.col("is_static"), True).alias("static_var"), "parent_function", "base_class", F.col("path").alias("filename"), F.col("line_number").alias("line"),
    )


def comparable(state: State) -> DataFrame:
    """Matches that are compared: functions, tables and adjusters with a size, not skipped."""
    found = state.get_matches(schema.FUNCTION, schema.VTORDISP, schema.VTABLE)
    return found.where((entity.any_size() != 0) & ~F.coalesce("skip", F.lit(False)))


def functions(state: State, code: DataFrame) -> DataFrame:
    """Compare matched functions. ``code`` has (img, addr, lines array<struct<addr, text>>).

    Equal texts, which are most, are told by comparing arrays in the JVM; the alignment
    sees only the rest."""
    side = lambda img, key, out: code.where(F.col("img") == img).select(F.col("addr").alias(key), F.col("lines").alias(out))
    pairs = comparable(state).where(F.col("type") != schema.VTABLE).join(side(schema.ORIG, "orig_addr", "orig"), "orig_addr").join(side(schema.RECOMP, "recomp_addr", "recomp"), "recomp_addr")
    text = lambda c: F.transform(c, lambda x: x["text"])
    pairs = pairs.select("orig_addr", "recomp_addr", entity.best_name().alias("name"), "type", F.coalesce("stub", F.lit(False)).alias("is_stub"), "orig", "recomp", text("orig").alias("a"), text("recomp").alias("b"))
    equal = pairs.where(F.col("a") == F.col("b")).select("orig_addr", "recomp_addr", "name", "type", "is_stub", F.lit(1.0).alias("accuracy"), F.lit(False).alias("is_effective_match"), F.lit(None).cast(schema.DIFF).alias("diff"))
    keep = ("orig_addr", "recomp_addr", "name", "type", "is_stub", "orig", "recomp")
    rest = diff.sequences(pairs.where(F.col("a") != F.col("b")), keep=keep)
    shown = diff.unified_diffs(rest.withColumnRenamed("effective", "is_effective_match"), keep=("orig_addr", "recomp_addr", "name", "type", "is_stub", "ratio", "is_effective_match"))
    return equal.unionByName(shown.withColumnRenamed("ratio", "accuracy"))


def vtables(state: State, slots: DataFrame) -> DataFrame:
    """Compare matched tables of virtual functions (orig_addr, orig_slots, recomp_slots)."""
    found = comparable(state).where(F.col("type") == schema.VTABLE).select("orig_addr", "recomp_addr", entity.best_name().alias("name"), "type")
    merged = state.merged().withColumn("name", entity.best_name())
    ratio = compare.vtable_ratio(compare.vtables(slots, merged))
    return found.join(ratio, "orig_addr").select("orig_addr", "recomp_addr", "name", "type", F.lit(False).alias("is_stub"), F.col("ratio").alias("accuracy"), F.lit(False).alias("is_effective_match"))


@dataclass(frozen=True)
class Outcome:
    report: DataFrame
    totals: DataFrame
    events: DataFrame


def compare_all(state: State, code: DataFrame, slots: DataFrame, filename: str, expected: int = 0) -> Outcome:
    """The report of a run, its totals, and what went wrong, with severities."""
    compared = functions(state, code).drop("diff").unionByName(vtables(state, slots))
    rows = reports.from_matches(compared, filename)
    total = reports.summary(reports.totals(rows), expected=expected)
    return Outcome(rows, total, state.events.withColumn("severity", matchers.severity(F.col("event"))))


def aggregate(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The best results of several saved reports of one file; at least two must be valid."""
    rows = reports_json.read(spark, paths)
    if rows.select("sample_id").distinct().limit(2).count() < 2:
        raise ValueError("at least two valid reports are needed")
    if not reports.same_source(rows):
        raise ValueError("the reports are about different files")
    return reports.combine(rows)


def compare_reports(spark: SparkSession, old: str, new: str) -> DataFrame:
    rows = reports_json.read(spark, [old, new])
    if not reports.same_source(rows):
        raise ValueError("the reports are about different files")
    return reports.diff(rows.where("sample_id = 0"), rows.where("sample_id = 1"))


def exports_diff(orig: DataFrame, recomp: DataFrame) -> DataFrame:
    """Names of exports that only one image has."""
    side = lambda a, b, mark: a.select("name").distinct().join(b.select("name").distinct(), "name", "left_anti").withColumn("side", F.lit(mark))
    return side(orig, recomp, "-").unionByName(side(recomp, orig, "+")).orderBy("name")
