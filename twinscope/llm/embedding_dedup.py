"""Embedding near-dedup: spherical k-means cells, cosine products by blocks.

Vectors are scaled to length one and equal vectors become one node with a count. Cells
come from spherical k-means on a bounded sample; each vector goes to the cell of its
nearest centre, and cells are dealt into blocks of about ``block`` vectors, which bound
what a task holds: a vector is sent as often as there are blocks of cells near it.

Two vectors with a cosine of at least ``threshold`` are at most r = sqrt(2 - 2 t) apart.
For cells c and d, the plane half way between their centres lies between any x of c and
y of d, so both are at most r from it: x takes part in the pair of cells only if its
distance to the plane is at most r minus the least distance of any y. Pairs of blocks
whose vectors can be near meet in one task, which multiplies them piece by piece in
double precision. No link is lost whatever the cells are; good cells only save work.

A task emits how many links each vector has and the links of a spanning forest, never
the pairs. One vector is kept of each group that links connect.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are kept; vectors of another length than most of the sample's link
only with their own; rows with a null id link with nothing; rows repeated with one id
are vectors of their own, linked with each other; labels are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm import graph, shared


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centres of k cells of the unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-12
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return np.unique(centres, axis=0)


def _floats(column) -> np.ndarray:
    """The vectors of an Arrow list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def block_links(x: np.ndarray, y: np.ndarray | None, n_x: np.ndarray, n_y: np.ndarray | None, threshold: float, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, counting ``n`` copies for a row; a, b): links within ``x`` if
    ``y`` is None, else between the two; a[i] and b[i] number rows of x, then of y, and
    join all that links connect."""
    both = x if y is None else np.vstack([x, y])
    n = n_x if y is None else np.concatenate([n_x, n_y])
    first = 0 if y is None else len(x)
    links, parent = np.zeros(len(both), np.int64), np.arange(len(both))
    for lo in range(0, len(x), step):
        hit = x[lo : lo + step] @ both[first:].T >= threshold
        if y is None:
            own = np.arange(len(hit))
            hit[own, lo + own] = False
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        links[lo + rows] += hit[rows] @ n[first:]
        if y is not None:
            links[first:] += hit[rows].T @ n[lo + rows]
        for i in rows:
            near = np.append(np.flatnonzero(hit[i]) + first, lo + i)
            top = near
            while True:  # roots of all that the row links
                up = parent[top]
                if np.array_equal(up, top):
                    break
                top = np.unique(up)
            parent[top] = top.min()
            parent[near] = top.min()
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    apart = np.flatnonzero(parent != np.arange(len(both)))
    return links, apart, parent[apart]


def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9, block: int = 16_384, max_cells: int = 256, sample: int = 20_000) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Centres are fitted on the ``sample`` vectors (about) with the smallest hashes; there
    are as many cells as blocks, ``max_cells`` at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("ok", usable)
    # Equal vectors are one node, named by its smallest id.
    named = marked.where("ok").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    nodes = shared.stash(named, "vectors")
    n = nodes.count()
    if not n:
        lone = rows.select(F.col("id").alias(key))
        return lone.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept"))
    cells = max(1, min(max_cells, n // block))
    usual = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    near = nodes.where((F.size("v") == usual) & (F.shiftrightunsigned(F.xxhash64("v"), 1) / float(1 << 63) < sample / n)).select("v")
    taken = near.limit(4 * sample).toArrow()["v"].combine_chunks()
    points = normalised(_floats(taken)) if len(taken) else np.zeros((0, usual))
    points = points[np.lexsort(points.T)]  # the same order on every run
    centres = spherical_kmeans(points, cells) if cells > 1 and len(points) >= cells else np.eye(1, usual)
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(size):
                part = np.flatnonzero(size == d)
                take = pa.array(part)
                x = _floats(batch.column(1).take(take))
                # Scaled first, so that huge or tiny components neither overflow nor vanish.
                x = normalised(x / np.abs(x).max(axis=1, keepdims=True))
                cell, far = np.zeros(len(x), np.int32), np.zeros((len(x), 0))
                if d == usual:
                    dots = x @ centres.T
                    cell = np.argmax(dots, axis=1).astype(np.int32)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        far = (dots[np.arange(len(x)), cell][:, None] - dots) / gap[cell]
                    far[np.arange(len(x)), cell] = 0.0
                flat = pa.array(x.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(2).take(take), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d), flat), pa.array(np.full(len(x), d, np.int32)), pa.array(cell), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))],
                    ["node", "n", "x", "d", "cell", "far"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    placed = nodes.select("node", "v", "n").mapInArrow(place, f"node {kind}, n long, x array<double>, d int, cell int, far array<double>")
    placed = shared.stash(placed, "placed-vectors")
    # How many blocks a cell has, and the least distance of its vectors to each plane.
    counts = placed.groupBy("d", "cell").agg(F.count("*").alias("size")).collect()
    least = {(r.d, r.cell, r.other): r.least for r in placed.select("d", "cell", F.posexplode("far").alias("other", "f")).groupBy("d", "cell", "other").agg(F.min("f").alias("least")).collect()}
    parts_of = {(r.d, r.cell): -(-r.size // block) for r in counts}
    first, total = {}, 0
    for c in sorted(parts_of):
        first[c], total = total, total + parts_of[c]

    n_parts = np.array([parts_of.get((usual, c), 0) for c in range(len(centres))], np.int64)
    at_part = np.array([first.get((usual, c), 0) for c in range(len(centres))], np.int64)
    # Of cells c and e: the least distance of any vector of e to the plane between them.
    gaps = np.array([[max(0.0, least.get((usual, e, c), 0.0)) for e in range(len(centres))] for c in range(len(centres))])

    def deal(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ds, cells_ = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            salt = batch.column(6).to_numpy().view(np.uint64)
            rows_, own_, others = [], [], []
            for d in np.unique(ds).tolist():
                part = np.flatnonzero(ds == d)
                c = cells_[part]
                size = n_parts[c] if d == usual else np.array([parts_of[d, x] for x in c.tolist()])
                begin = at_part[c] if d == usual else np.array([first[d, x] for x in c.tolist()])
                own = begin + (salt[part] % size.astype(np.uint64)).astype(np.int64)
                if d == usual:
                    far = batch.column(5).take(pa.array(part)).flatten().to_numpy().reshape(len(part), -1)
                    near = (far + gaps[c] <= reach) & (n_parts > 0)
                    near[np.arange(len(part)), c] = True
                    i, e = np.nonzero(near)
                    many, begin = n_parts[e], at_part[e]
                else:
                    i, many = np.arange(len(part)), size
                # Each row goes to all blocks of the cells that are near, its own among them.
                rows_.append(part[np.repeat(i, many)])
                own_.append(np.repeat(own[i], many))
                others.append(np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum()))
            index, own, other = (np.concatenate(x) for x in (rows_, own_, others))
            take = pa.array(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(own, other).astype(np.int32)), pa.array(np.maximum(own, other).astype(np.int32)), pa.array((own > other).astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take)],
                ["a", "b", "side", "node", "n", "x"],
            )

    dealt = placed.withColumn("salt", F.xxhash64("node")).mapInArrow(deal, f"a int, b int, side int, node {kind}, n long, x array<double>")

    def multiply(pairs):
        import pyarrow as pa

        pairs = pairs.combine_chunks()
        side = pairs["side"].to_numpy()
        x, n_, node = _floats(pairs["x"].combine_chunks()), pairs["n"].to_numpy(), pairs["node"].to_numpy()
        order = np.argsort(side, kind="stable")
        cut = int((side == 0).sum())
        x, n_, node = x[order], n_[order], node[order]
        alone = pairs["a"][0].as_py() == pairs["b"][0].as_py()
        if alone:
            links, p, q = block_links(x, None, n_, None, threshold)
        else:
            links, p, q = block_links(x[:cut], x[cut:], n_[:cut], n_[cut:], threshold)
        shared.trim()
        has = np.flatnonzero(links)
        none = pa.nulls(len(has), pa.int64())
        return pa.table({"node": pa.array(np.concatenate([node[has], node[p]])), "links": pa.concat_arrays([pa.array(links[has]), pa.nulls(len(p), pa.int64())]), "to": pa.concat_arrays([none, pa.array(node[q], pa.int64())])})

    found = dealt.repartition(shared.parts_for(spark, 0, 1), "a", "b").groupBy("a", "b").applyInArrow(multiply, "node long, links long, to long")
    found = shared.stash(found, "vector-links")
    direct = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = graph.components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b")))
    about = nodes.join(direct, "node", "left").join(roots, "node", "left")
    about = about.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    # Written first: both sides of the join are then plain exchanges, of which Spark splits what a common vector fills.
    about = shared.stash(about, "about-vectors")
    known = marked.where("ok").select("id", "v").join(about, "v").select("id", "n_links", "component_id")
    lone = marked.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.unionByName(lone).withColumnRenamed("id", key)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
