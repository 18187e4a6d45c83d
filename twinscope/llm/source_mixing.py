"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule, a straight line
from its first to its last relative weight, whose integral over the run is the
source's share of the tokens. Integrated, it is the source's cumulative demand; a
source's documents, in a fixed pseudo-random order and repeated as often as the demand
asks, are its supply. Inverting the demand at the tokens consumed before a copy gives
the copy's position in training, and a range sort by position is the training order.

Shares are weights over all sources, capped at ``max_repeats`` times a source's size;
what a cap leaves over goes to the other sources by weight until none is above its cap.

Only DataFrame functions are used. Running sums within a source go over two levels
(totals of hash buckets, then within a bucket), so a source with a third of all rows is
spread over as many tasks as its rows need; texts are never shuffled by
:func:`assign`.

Edge cases: a null source is a source of its own, the last; a null text has size 0 and
is never taken; rows repeated in the table are documents of their own; a table without
words has targets 0; extra columns stay out of :func:`assign` unless named in ``keep``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.llm import shared

WEIGHTS = (1.0, 2.0, 3.0)
#: First and last relative weight in the schedule of the n-th source, repeating.
RAMPS = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def size_of(text: Column) -> Column:
    return F.size(shared.words_of(text)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, max_repeats: float = 3.0) -> DataFrame:
    """A row for each source of ``sizes`` (source, source_size): its weight, ramp and
    target, where all targets together are all sizes and none is above its cap."""
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.pmod(F.col("rank") - 1, F.lit(len(values))) + 1)
    ranked = sizes.withColumn("rank", F.row_number().over(in_order))
    ranked = ranked.withColumns({"weight": pick(weights), "ramp_from": pick([r[0] for r in ramps]), "ramp_to": pick([r[1] for r in ramps]), "cap": max_repeats * F.col("source_size")})
    # Sources fill up in the order of cap over weight. With the first k full, the others share the rest by weight.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level)
    # The level is the first one (in this order) that does not fill its own source.
    open_level = levels.withColumn("_open", F.col("level") * F.col("weight") <= F.col("cap"))
    first = F.min(F.when(F.col("_open"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(Window.partitionBy())
    out = open_level.withColumn("_level", F.coalesce(first["level"], F.lit(0.0)))
    return out.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.col("_level"))).select("source", "source_size", "weight", "ramp_from", "ramp_to", "target")


def position_of(consumed: Column, target: Column, ramp_from: Column, ramp_to: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``consumed``: the demand
    is target * (a t + (b - a) t^2 / 2) / ((a + b) / 2), a quadratic in t."""
    a, slope = ramp_from, ramp_to - ramp_from
    need = F.least(F.lit(1.0), F.greatest(F.lit(0.0), consumed / F.when(target > 0, target))) * (ramp_from + ramp_to) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * need))
    return F.least(F.lit(1.0), F.coalesce(2 * need / F.when(root + a > 0, root + a), F.lit(0.0)))


def assign(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = (), whole: bool = False, per_bucket: int = 256, weights=WEIGHTS, ramps=RAMPS, max_repeats: float = 3.0, with_hash: bool = False) -> DataFrame:
    """A row for each row of ``docs``: its key, size, its source's size and target, and
    ``copies``, an array of (position, words) with an entry for each time it is taken.

    Without ``whole`` a source's last copy is cut to the words that its target still
    needs, so a source's words are its target to the nearest word; with ``whole`` a
    copy is taken if at least half of it fits.
    """
    # A column that is a stable order within a source: a hash of the row, then the row itself.
    sized = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), F.xxhash64(F.col(key), F.col(text)).alias("_hash"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    sized = shared.stash(sized, "document-sizes")
    rows = sized.count()
    bits = max(1, math.ceil(math.log2(max(2, rows / per_bucket))))
    sized = sized.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("bucket_size"))
    by_source = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, max_repeats)
    by_source = shared.stash(by_source, "source-targets")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    b = buckets.alias("b")
    s = by_source.alias("s")
    starts = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select(F.col("b.source").alias("_source"), F.col("b._bucket").alias("_b"), "_before", "source_size", "target", "ramp_from", "ramp_to")
    joined = sized.join(starts, sized["source"].eqNullSafe(starts["_source"]) & (sized["_bucket"] == starts["_b"])).drop("_source", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(math.ceil(max_repeats) - 1)),
        lambda k: F.struct(
            position_of(k * F.col("source_size") + F.col("_start"), F.col("target"), F.col("ramp_from"), F.col("ramp_to")).alias("position"),
            F.greatest(F.lit(0), F.least(F.col("size"), goal - k * F.col("source_size") - F.col("_start"))).cast("long").alias("words"),
        ),
    )
    if whole:
        copies = F.transform(copies, lambda c: F.struct(c["position"].alias("position"), F.when(2 * c["words"] >= F.col("size"), F.col("size")).otherwise(0).cast("long").alias("words")))
    placed = placed.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    return placed.select(F.col("_key").alias(key), "source", "size", "source_size", "target", "copies", *[F.col(f"_keep_{c}").alias(c) for c in keep], *(["_hash"] if with_hash else []))


def in_training_order(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix, whole, as often as each is taken, sorted by position.

    The columns are those of ``docs``; a document taken three times has three rows.
    """
    # Places are found without the texts, which move only to join their places and to be sorted.
    taken = assign(docs.select(key, text, source), text, source, key, whole=True, with_hash=True, **options)
    taken = taken.where(F.size("copies") > 0).select(F.col(key).alias("_key"), "_hash", "copies")
    taken = shared.stash(taken, "places")
    rows = docs.withColumn("_of", F.xxhash64(F.col(key), F.col(text)))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_hash"))
    if not taken.groupBy("_key", "_hash").count().where("count > 1").isEmpty():
        # Equal rows share their places, one each.
        nth = F.row_number()
        taken = taken.withColumn("_m", nth.over(Window.partitionBy("_key", "_hash").orderBy(F.col("copies")[0]["position"])))
        rows = rows.withColumn("_n", nth.over(Window.partitionBy(key, "_of").orderBy("_of")))
        on = on & (F.col("_n") == F.col("_m"))
    each = rows.join(shared.if_small(taken, 128), on).select(*docs.columns, "_of", F.explode("copies").alias("_copy"))
    return each.orderBy(F.col("_copy")["position"], "_of").select(*docs.columns)
