"""Join shapes that Spark has no single operator for.

All are plain DataFrame plans: equi-joins on a key and a rank, or one sorted window
where other engines loop. Address lines are cut into buckets so that no window runs over
all rows in one task.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.operators import lineage


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "nth") -> DataFrame:
    """``df`` with each row's number among the rows of equal keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def nth_occurrence_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str | Column], right_order: Sequence[str | Column], how: str = "inner") -> DataFrame:
    """Pair the n-th row of each key on one side with the n-th on the other.

    That is what first-come-first-served matching in order gives, without a loop. The
    result has the keys, ``nth``, and both sides' other columns.
    """
    return numbered(left, keys, left_order).join(numbered(right, keys, right_order), [*keys, "nth"], how)


def asof_backward(probes: DataFrame, points: DataFrame, on: str, by: Sequence[str] = (), columns: Sequence[str] = (), bucket: int = 1 << 20) -> DataFrame:
    """Each probe with the ``columns`` of the last point at or before it (null if none).

    Probes and points are sorted together within buckets of ``on``; the last point of
    each bucket is carried into the next ones, so the work is spread over buckets
    whatever the spread of the keys. A point's own ``on`` is always among the columns, as
    ``base``.
    """
    take = F.struct(F.col(on).alias("base"), *columns)
    p = points.select(*by, on, F.lit(0).alias("_side"), take.alias("_point"))
    wanted = [c for c in probes.columns if c not in (*by, on)]
    q = probes.select(*by, on, F.lit(1).alias("_side"), F.struct(*wanted).alias("_probe") if wanted else F.lit(True).alias("_probe"))
    both = q.unionByName(p, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col(on) / bucket))
    last = p.withColumn("_bucket", F.floor(F.col(on) / bucket)).groupBy(*by, "_bucket").agg(F.max_by("_point", on).alias("_last"))
    carry = both.select(*by, "_bucket").distinct().join(last, [*by, "_bucket"], "left") if by else both.select("_bucket").distinct().join(last, "_bucket", "left")
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    within = Window.partitionBy(*by, "_bucket").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    # A null in ``by`` or in the bucket meets no point, but its probe stays.
    found = both.join(carry, [*by, "_bucket"], "left").withColumn("_found", F.coalesce(F.last("_point", ignorenulls=True).over(within), F.col("_carried")))
    out = found.where("_side = 1")
    return out.select(*by, on, *([F.col(f"_probe.{c}").alias(c) for c in wanted]), *[F.col(f"_found.{c}").alias(c) for c in ("base", *columns)])


def interval_join(probes: DataFrame, ranges: DataFrame, on: str, by: Sequence[str] = (), start: str = "start", size: str = "size", columns: Sequence[str] = (), bucket: int = 1 << 20) -> DataFrame:
    """Each probe with the ``columns`` of the range [start, start + size) that holds it,
    null if none does. Ranges do not overlap."""
    points = ranges.withColumnRenamed(start, on) if start != on else ranges
    found = asof_backward(probes, points, on, by, (size, *columns), bucket)
    inside = F.col(on) < F.col("base") + F.col(size)
    return found.withColumns({c: F.when(inside, F.col(c)) for c in ("base", size, *columns)})


def unique_in_range(probes: DataFrame, points: DataFrame, by: Sequence[str], low: str, high: str, point: str, value: str, bucket: int = 64) -> DataFrame:
    """Each probe with ``value`` if exactly one distinct value has a point in
    [low, high], else null, and with the number of distinct values, ``n_values``.

    Both sides meet by bucket of the point, so the join is an equi-join."""
    q = probes.withColumn("_id", F.xxhash64(*probes.columns))
    spread = q.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    p = points.withColumn("_bucket", F.floor(F.col(point) / bucket)).select(*by, "_bucket", point, value)
    hits = spread.join(p, [*by, "_bucket"]).where(F.col(point).between(F.col(low), F.col(high)))
    counted = hits.groupBy("_id").agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("_value"))
    return q.join(counted, "_id", "left").select(*probes.columns, F.coalesce("n_values", F.lit(0)).alias("n_values"), F.when(F.col("n_values") == 1, F.col("_value")).alias(value))


def greedy_pairs(candidates: DataFrame, group: Sequence[str], left: str, right: str, schema: str) -> DataFrame:
    """Of the candidate pairs of each group, those that taking each left in order and
    giving it the smallest right still free leaves. Order matters, so a group is one
    task; groups are the connected pieces of the candidates, not all of them."""

    def assign(pdf):
        taken: set = set()
        rows = []
        for key, part in pdf.sort_values([left, right]).groupby(left, sort=True):
            free = part[~part[right].isin(taken)]
            if len(free):
                rows.append(free.iloc[0])
                taken.add(free.iloc[0][right])
        return pdf.iloc[0:0] if not rows else pdf.__class__(rows)[list(pdf.columns)]

    return candidates.groupBy(*group).applyInPandas(assign, schema)


def pieces(links: DataFrame, left: str, right: str) -> DataFrame:
    """The distinct links (left, right) with ``piece``, the smallest left of those that
    are connected with theirs.

    Each round takes the smallest piece across all links and then the piece of that one,
    so the number of rounds grows with the logarithm of the longest chain."""
    at = lineage.cut(links.select(left, right).distinct().withColumn("piece", F.col(left)))
    while True:
        across = at.groupBy(right).agg(F.min("piece").alias("_p"))
        near = lineage.cut(at.join(across, right).groupBy(left).agg(F.min("_p").alias("_p")))
        far = near.join(near.select(F.col(left).alias("_p"), F.col("_p").alias("_q")), "_p").select(left, "_q")
        moved = lineage.cut(at.join(far, left).select(left, right, F.col("_q").alias("piece"), (F.col("_q") < F.col("piece")).alias("_moved")))
        at = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return at


def first_free(lefts: DataFrame, rights: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (left, right): each of the ``lefts`` (kind, left) in order takes the smallest
    of the ``rights`` (form, right) still free whose form ``links`` (kind, form) gives its
    kind. All are long.

    Where a connected piece of the links has all links that it can have, the n-th left
    takes the n-th right. Elsewhere order matters, and a piece is one task; its rows are
    its members and links, never the pairs of members."""
    at = pieces(links, "kind", "form")
    full = at.groupBy("piece").agg((F.count("*") == F.count_distinct("kind") * F.count_distinct("form")).alias("full"))
    l = lefts.join(at.select("kind", "piece").distinct(), "kind").join(full, "piece")
    r = rights.join(at.select("form", "piece").distinct(), "form").join(full, "piece")
    plain = nth_occurrence_join(l.where("full").select("piece", "left"), r.where("full").select("piece", "right"), ["piece"], ["left"], ["right"])

    def row(df: DataFrame, what: int, a: str, b: str) -> DataFrame:
        return df.where("not full").select("piece", F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))

    def assign(pdf):
        of = {what: part[["a", "b"]].sort_values("b").to_numpy().tolist() for what, part in pdf.groupby("what")}
        free, heads, out = defaultdict(deque), defaultdict(list), []
        for form, one in of.get(1, ()):
            free[form].append(one)
        for kind, form in of.get(0, ()):
            if free[form]:
                heads[kind].append((free[form][0], form))
        for heap in heads.values():
            heapq.heapify(heap)
        for kind, one in of.get(2, ()):
            # What a heap holds of a form may be taken by now; then it is below what is free.
            heap = heads[kind]
            while heap:
                head, form = heap[0]
                if not free[form]:
                    heapq.heappop(heap)
                elif free[form][0] != head:
                    heapq.heapreplace(heap, (free[form][0], form))
                else:
                    out.append((one, free[form].popleft()))
                    break
        return pdf.__class__(out, columns=["left", "right"], dtype="int64")

    rows = row(at.join(full, "piece"), 0, "kind", "form").unionByName(row(r, 1, "form", "right")).unionByName(row(l, 2, "kind", "left"))
    return plain.select("left", "right").unionByName(rows.groupBy("piece").applyInPandas(assign, "left long, right long"))


def first_pairs(pairs: DataFrame, left: str, right: str, order: str, rounds: int = 30) -> DataFrame:
    """Of ordered pairs, those that survive when each left and each right may be used
    once and the first pair in order wins.

    A pair is kept if it is the first of both its sides; then pairs that share a side
    with a kept one go, and so on. Each round is two windows; the number of rounds is
    the longest chain of pairs that wait for each other, mostly one or two. What waits
    for longer than ``rounds`` is taken in order, a connected piece a task."""
    left_pairs, kept = pairs, None
    for _ in range(rounds):
        lo = F.min(order).over(Window.partitionBy(left))
        ro = F.min(order).over(Window.partitionBy(right))
        marked = left_pairs.withColumn("_first", (F.col(order) == lo) & (F.col(order) == ro))
        marked = marked if kept is None else lineage.cut(marked)
        won = marked.where("_first").drop("_first")
        kept = won if kept is None else kept.unionByName(won)
        left_pairs = marked.where("not _first").drop("_first").join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti")
        if left_pairs.isEmpty():
            return kept
    left_pairs = lineage.cut(left_pairs)
    in_piece = lineage.cut(numbered(left_pairs.join(pieces(left_pairs, left, right), [left, right]), ["piece"], [order], "_n"))

    def in_order(pdf):
        used, out = (set(), set()), []
        for n, a, b in pdf.sort_values("_n")[["_n", left, right]].itertuples(index=False):
            if a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                out.append(n)
        return pdf[pdf["_n"].isin(out)][["piece", "_n"]]

    kind = left_pairs.schema[left].dataType.simpleString()
    won = in_piece.select("piece", "_n", left, right).groupBy("piece").applyInPandas(in_order, f"piece {kind}, _n int")
    return kept.unionByName(in_piece.join(won, ["piece", "_n"], "left_semi").drop("piece", "_n").select(*kept.columns))
