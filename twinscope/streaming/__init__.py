"""Results that arrive over time, with Structured Streaming.

Each operator is the batch one applied to what is new and a keyed table of what is known:
bounded state, no replay of the past.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.operators import reports


def first_seen(errors: DataFrame, time: str = "ts", delay: str = "1 hour", keys: tuple[str, ...] = ("error",)) -> DataFrame:
    """Each error the first time within the delay; repeats are dropped."""
    return errors.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def set_once(pairs: DataFrame, left: str = "orig_addr", right: str = "recomp_addr", order: str | None = None) -> DataFrame:
    """Matches that are never taken back: the first partner of each left side stays. Of
    those that arrive together it is the first by ``order``, a whole number, and else the
    smallest."""
    kinds = f"{left} long, {right} long"
    by = order or right

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known, best = state.exists, None
        for pdf in batches:
            if known or not len(pdf):
                continue
            row = pdf.sort_values([by, right]).iloc[0]
            if best is None or (row[by], row[right]) < best:
                best = (row[by], row[right])
        if best is not None:
            state.update((int(best[1]),))
            yield pd.DataFrame({left: [key[0]], right: [int(best[1])]})

    return pairs.groupBy(left).applyInPandasWithState(keep, kinds, f"{right} long", "append", "NoTimeout")


def deferred(waiting: DataFrame, arriving: DataFrame, key: str, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows that wait until what they refer to arrives, or their time is over."""
    w = waiting.withWatermark(time, delay).alias("w")
    a = arriving.withWatermark(time, delay).alias("a")
    near = F.expr(f"a.{key} = w.{key} AND a.{time} BETWEEN w.{time} - INTERVAL {delay} AND w.{time} + INTERVAL {delay}")
    return w.join(a, near, "leftOuter").select("w.*", *[F.col(f"a.{c}").alias(f"found_{c}") for c in arriving.columns if c != key])


def best_of(samples: DataFrame, load: Callable[[], DataFrame | None], save: Callable[[DataFrame], None]):
    """A streaming query that keeps the best result of each address as samples come in;
    ``load`` gives the table so far (None at first) and ``save`` replaces it. Each batch
    is pre-aggregated, so the table meets one row an address."""

    def merge(batch: DataFrame, epoch: int) -> None:
        fresh = reports.combine(batch).select(F.lit(epoch + 1).alias("sample_id"), F.lit(None).cast("string").alias("filename"), "orig_addr", "recomp_addr", "name", "type", "accuracy", "is_effective_match", "is_stub")
        known = load()
        if known is not None:
            before = known.select(F.lit(0).alias("sample_id"), F.lit(None).cast("string").alias("filename"), "orig_addr", "recomp_addr", "name", "type", "accuracy", "is_effective_match", "is_stub")
            fresh = fresh.unionByName(before)
        save(reports.combine(fresh))

    return samples.writeStream.foreachBatch(merge)
