"""The entity store: two address spaces, matches between them, and the sections.

A state is immutable. An upsert is a merge of a delta whose columns say whether they
were set (struct<is_set, v>), so that a set null differs from an absent value. Matches
are added if neither side has one, and then both sides share attributes: the recompiled
side's value where it has one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import entity
from twinscope.operators import joins, lineage

NAMES = tuple(schema.ATTRIBUTES)


def delta(rows: DataFrame, values: Mapping[str, Column], img: Column | int | None = None, addr: str = "addr", when: Mapping[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A delta that sets ``values`` at the rows' addresses, each where ``when`` says so;
    other attributes stay. Columns in ``keep`` come along."""
    out = [F.col("img") if img is None else (img if isinstance(img, Column) else F.lit(img)).cast("int").alias("img"), F.col(addr).cast("long").alias("addr")]
    for name, kind in schema.ATTRIBUTES.items():
        is_set = (when or {}).get(name, F.lit(name in values))
        v = values[name].cast(kind) if name in values else F.lit(None).cast(kind)
        out.append(F.struct(is_set.alias("is_set"), v.alias("v")).alias(name))
    return rows.select(*out, *keep)


def merge(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert ``changes`` (at most one row an address): insert, or overwrite what is set."""
    c = changes.select("img", "addr", *[F.col(n).alias(f"_{n}") for n in NAMES])
    joined = entities.join(c, ["img", "addr"], "full")
    return joined.select("img", "addr", *[F.when(F.col(f"_{n}.is_set"), F.col(f"_{n}.v")).otherwise(F.col(n)).alias(n) for n in NAMES])


def last_writer(changes: DataFrame, order: str) -> DataFrame:
    """One row an address: of each attribute the value set last."""
    of = lambda n: F.max_by(F.when(F.col(f"{n}.is_set"), F.col(n)), F.when(F.col(f"{n}.is_set"), F.col(order)))
    none = lambda n: F.struct(F.lit(False).alias("is_set"), F.lit(None).cast(schema.ATTRIBUTES[n]).alias("v"))
    return changes.groupBy("img", "addr").agg(*[F.coalesce(of(n), none(n)).alias(n) for n in NAMES])


@dataclass(frozen=True)
class State:
    entities: DataFrame
    matches: DataFrame
    sections: DataFrame
    events: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*[spark.createDataFrame([], s) for s in (schema.ENTITIES, schema.MATCHES, schema.SECTIONS, schema.EVENTS)])

    @staticmethod
    def of(spark: SparkSession, entities: DataFrame, matches: DataFrame | None = None, sections: DataFrame | None = None) -> State:
        start = State.empty(spark)
        rows = start.entities.unionByName(entities, allowMissingColumns=True).select(*schema.ENTITIES.names)
        return replace(start, entities=rows, matches=start.matches if matches is None else matches, sections=start.sections if sections is None else sections)

    # Changes

    def upsert(self, changes: DataFrame) -> State:
        """Apply a delta. Matched sides share attributes, so what one is given both are."""
        if self.matches.isEmpty():
            return replace(self, entities=merge(self.entities, changes))
        pairs = self.matches.select(F.col("orig_addr").alias("o"), F.col("recomp_addr").alias("r"))
        ends = pairs.select(F.lit(schema.ORIG).alias("img"), F.col("o").alias("addr"), F.col("r").alias("other")).unionByName(pairs.select(F.lit(schema.RECOMP).alias("img"), F.col("r").alias("addr"), F.col("o").alias("other")))
        mirror = changes.join(ends, ["img", "addr"]).select((1 - F.col("img")).cast("int").alias("img"), F.col("other").alias("addr"), *NAMES, (F.col("img") + 1).alias("_by"))
        # Of an attribute that both sides set at once, the recompiled side's value stays.
        both = changes.select("*", (F.col("img") + 1).alias("_by")).unionByName(mirror)
        return replace(self, entities=merge(self.entities, last_writer(both, "_by")))

    def match(self, pairs: DataFrame, order: str | None = None) -> State:
        """Add pairs (orig_addr, recomp_addr): first pairs in ``order`` win; a side that
        is matched already keeps its match. Both entities then have the same attributes,
        the recompiled side's where it has one; one that does not exist is made."""
        fresh = pairs.join(self.matches.select("orig_addr"), "orig_addr", "left_anti").join(self.matches.select("recomp_addr"), "recomp_addr", "left_anti")
        if order is not None:
            fresh = joins.first_pairs(fresh, "orig_addr", "recomp_addr", order)
        fresh = fresh.select("orig_addr", "recomp_addr")
        o = self.side(schema.ORIG).select(F.col("addr").alias("orig_addr"), *[F.col(n).alias(f"o_{n}") for n in NAMES])
        r = self.side(schema.RECOMP).select(F.col("addr").alias("recomp_addr"), *[F.col(n).alias(f"r_{n}") for n in NAMES])
        one = fresh.join(o, "orig_addr", "left").join(r, "recomp_addr", "left").select("orig_addr", "recomp_addr", *[F.coalesce(f"r_{n}", f"o_{n}").alias(f"_{n}") for n in NAMES])
        ends = F.array(F.struct(F.lit(schema.ORIG).alias("img"), F.col("orig_addr").alias("addr")), F.struct(F.lit(schema.RECOMP).alias("img"), F.col("recomp_addr").alias("addr")))
        two = one.withColumn("_end", F.explode(ends)).select("_end.img", "_end.addr", F.lit(True).alias("_now"), *[f"_{n}" for n in NAMES])
        joined = self.entities.join(two, ["img", "addr"], "full")
        entities = joined.select("img", "addr", *[F.when(F.col("_now"), F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in NAMES])
        return replace(self, entities=entities, matches=self.matches.unionByName(fresh))

    def report(self, events: DataFrame) -> State:
        return replace(self, events=self.events.unionByName(events.select("event", "orig_addr", "msg")))

    def add_sections(self, sections: DataFrame) -> State:
        return replace(self, sections=self.sections.unionByName(sections))

    def cut(self) -> State:
        """Cut the lineage, in the folder that spark.checkpoint.dir names."""
        return replace(self, entities=lineage.cut(self.entities), matches=lineage.cut(self.matches), events=lineage.cut(self.events))

    # Scans

    def side(self, img: int) -> DataFrame:
        return self.entities.where(F.col("img") == img)

    def all(self, img: int, start: int | None = None, stop: int | None = None) -> DataFrame:
        """One image in the order of addresses, or its range [start, stop)."""
        rows = self.side(img)
        if start is not None:
            rows = rows.where(F.col("addr") >= start)
        if stop is not None:
            rows = rows.where(F.col("addr") < stop)
        return rows.orderBy("addr")

    def unmatched(self, img: int) -> DataFrame:
        key = "orig_addr" if img == schema.ORIG else "recomp_addr"
        taken = self.matches.select(F.col(key).alias("addr"))
        return self.side(img).join(taken, "addr", "left_anti")

    def merged(self) -> DataFrame:
        """A row for each entity of either image, matched ones merged: orig_addr,
        recomp_addr, and the attributes, the recompiled side's first."""
        o = self.side(schema.ORIG).select(F.col("addr").alias("orig_addr"), *[F.col(n).alias(f"o_{n}") for n in NAMES])
        r = self.side(schema.RECOMP).select(F.col("addr").alias("recomp_addr"), *[F.col(n).alias(f"r_{n}") for n in NAMES])
        left = self.matches.join(o, "orig_addr", "full").join(r, "recomp_addr", "full")
        return left.select("orig_addr", "recomp_addr", *[F.coalesce(f"r_{n}", f"o_{n}").alias(n) for n in NAMES])

    def get_all(self) -> DataFrame:
        """Everything: original addresses in order, then what is only recompiled."""
        return self.merged().orderBy(F.col("orig_addr").asc_nulls_last(), "recomp_addr")

    def get_matches(self, *types: int) -> DataFrame:
        rows = self.merged().where(F.col("orig_addr").isNotNull() & F.col("recomp_addr").isNotNull())
        return rows.where(F.col("type").isin(*types)) if types else rows

    def functions(self) -> DataFrame:
        return self.get_matches(schema.FUNCTION, schema.THUNK, schema.VTORDISP)

    # Lookups

    def one_match(self, orig_addr: int) -> DataFrame:
        return self.get_matches().where(F.col("orig_addr") == orig_addr)

    def is_match(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with whether each is a match."""
        known = self.matches.withColumn("is_match", F.lit(True))
        return pairs.join(known, ["orig_addr", "recomp_addr"], "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))

    def exists(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.entities.select("img", "addr"), ["img", "addr"], "left_semi")

    def nearest(self, probes: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
        """Probes (img, addr) with the last entity at or before them, as ``base``."""
        return joins.asof_backward(probes, self.entities, "addr", ("img",), columns)

    def get(self, probes: DataFrame, columns: tuple[str, ...] = NAMES, exact: bool = True) -> DataFrame:
        if not exact:
            return self.nearest(probes, columns)
        return probes.join(self.entities.select("img", "addr", *columns), ["img", "addr"], "left")

    def intersects(self, probes: DataFrame) -> DataFrame:
        """Probes with whether they lie at or inside an entity."""
        sized = self.entities.withColumn("_size", F.when(F.col("img") == schema.ORIG, entity.any_size(schema.ORIG)).otherwise(entity.any_size(schema.RECOMP)))
        found = joins.asof_backward(probes, sized, "addr", ("img",), ("_size",))
        return found.withColumn("intersects", F.coalesce((F.col("addr") == F.col("base")) | (F.col("addr") - F.col("base") < F.col("_size")), F.lit(False))).drop("base", "_size")

    def room(self, probes: DataFrame) -> DataFrame:
        """Probes (img, addr) with ``max_size``: the distance to the next solid entity, or
        to the end of the section that holds the probe; null outside of all sections."""
        held = joins.interval_join(probes, self.sections.withColumn("size", F.col("stop") - F.col("start")), "addr", ("img",), columns=("stop",)).drop("base", "size")
        solid = self.entities.where(F.col("type").isin(*schema.SOLID)).select("img", (-F.col("addr")).alias("back"))
        # The next one after a probe is the last one before it with signs turned.
        turned = held.withColumn("back", -F.col("addr") - 1)
        after = joins.asof_backward(turned, solid, "back", ("img",))
        return after.withColumn("max_size", F.least(-F.col("base"), F.col("stop")) - F.col("addr")).drop("back", "base", "stop")

    def lines_in_range(self, start: int, stop: int) -> DataFrame:
        """Matched line markers whose recompiled address is in [start, stop], both ends."""
        return self.get_matches(schema.LINE).where(F.col("recomp_addr").between(start, stop)).orderBy("orig_addr")

    def counts(self) -> DataFrame:
        """Entities, matches, and original functions without a match."""
        lone = self.unmatched(schema.ORIG).where(F.col("type") == schema.FUNCTION).agg(F.count("*").alias("unmatched_functions"))
        return self.merged().agg(F.count("*").alias("entities"), F.count_if(F.col("orig_addr").isNotNull() & F.col("recomp_addr").isNotNull()).alias("matches")).crossJoin(lone)


def in_order(entities: DataFrame) -> Window:
    """A window over one image's addresses."""
    return Window.partitionBy("img").orderBy("addr")
