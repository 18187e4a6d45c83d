"""SimHash near-duplicates, found with BK-trees.

A text's fingerprint has a bit for each of the 64 bits of its shingles' hashes: 1 if
more than half of the shingles have it. Fingerprints that differ in at most ``radius``
bits link.

Search: 64 bits fall into blocks of which at least some must agree exactly when few bits
differ, so equal block values make shards (more blocks, and narrower shards, the more
fingerprints there are). Each shard's fingerprints form a BK-tree, whose children are
keyed by their Hamming distance to the parent; a query follows only the edges within
the radius of its own distance. Shards meet their queries in one task; a shard above
``shard_rows`` is dealt over blocks, and each block's tree goes to every block of
queries, so no task holds more than two blocks. Trees of many shards are built and
walked together, level by level, in numpy.

A fingerprint of one word says little about texts that are less than nearly equal.
Longer ones (``width`` words) estimate the similarity of two texts' shingles well enough
to link by it: radius_for() gives the radius. No blocks of theirs need agree within such
a radius, so all are one shard, which is dealt over blocks: exact, but quadratic.

Documents with equal fingerprints are one node, so copies are never expanded; a task
emits the links of a spanning forest, at most one a node.

Edge cases: null and empty texts and texts without words have fingerprint zero and link
like others; fewer words than a shingle make one shingle; rows with a null key get a
fingerprint and a component named by the smallest non-null key in it (null if none);
repeated rows share a fingerprint; an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.llm import graph, shared

SEED = 42


def shingle_bounds(data: np.ndarray, rows: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text, starts, ends, row) of the shingles: texts with A-Z in lower case and their
    words one space apart, and the span of each shingle in that."""
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    starts, ends, before = shared.word_spans(low, rows)
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    text = np.full(at[-1], 32, np.uint8)
    inside = np.repeat(at[:-1] - starts, size)
    where = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
    text[where + inside] = low[where]
    n_words = np.diff(before)
    count = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    row = np.repeat(np.arange(len(n_words)), count)
    first = before[:-1][row] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + words, before[1:][row]) - 1
    return text.tobytes(), at[first], at[last] + size[last], row


def fingerprint(data: np.ndarray, rows: np.ndarray, words: int, width: int = 1) -> np.ndarray:
    """The fingerprint of each text of a piece: ``width`` unsigned 64-bit numbers a row,
    the first from the shingles' XXH64, the others from that hash mixed anew."""
    from xxhash import xxh64_intdigest

    text, starts, ends, row = shingle_bounds(data, rows, words)
    h = np.fromiter((xxh64_intdigest(text[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    return bits_of(h, row, len(rows) - 1, width)


def bits_of(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> np.ndarray:
    """The fingerprints of rows whose shingles have the hashes ``h``; ``row`` is ascending."""
    out = np.zeros((n_rows, width), np.uint64)
    if not len(h):
        return out
    has, first = np.unique(row, return_index=True)
    n = np.diff(np.append(first, len(row)))
    step = 1 << 16
    for w in range(width):
        own = h if w == 0 else shared.mix(h + np.uint64(w * 0x9E3779B97F4A7C15 % (1 << 64)))
        bits = np.zeros((len(has), 64), np.int64)
        for lo in range(0, len(h), step):  # 4 MB of bits at a time
            part = np.unpackbits(own[lo : lo + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            of = np.searchsorted(first, np.arange(lo, min(lo + step, len(h))), side="right") - 1
            which, cut = np.unique(of, return_index=True)
            bits[which] += np.add.reduceat(part, cut, axis=0, dtype=np.int64)
        out[has, w] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, width: int = 1) -> DataFrame:
    """(key, fp, f): the fingerprint of each row's whole text as ``width`` signed longs,
    f, and a long that stands for it, fp (the fingerprint itself if it is one)."""
    shared.text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, at in shared.text_steps(batch.column(1)):
                f = fingerprint(data, at, words, width).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * width), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["_key", "f"])

    made = rows.mapInArrow(work, f"_key {kind}, f array<long>")
    return made.select(F.col("_key").alias(key), (F.get("f", F.lit(0)) if width == 1 else F.xxhash64("f")).alias("fp"), "f")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The differing bits of fingerprints given as rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over distinct fingerprints, one for each group of rows."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        """``group`` is ascending."""
        self.fp = fp
        self.groups, self.roots = np.unique(group, return_index=True)
        self.sizes = np.diff(np.append(self.roots, len(group)))
        self.most = 64 * fp.shape[1]
        item = np.setdiff1d(np.arange(len(fp)), self.roots)
        at = self.roots[np.searchsorted(self.groups, group[item])]
        codes, children = [], []
        while len(item):
            d = _apart(fp[item], fp[at])
            item, at, d = item[d > 0], at[d > 0], d[d > 0]
            code = at * (self.most + 1) + d
            kinds, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            codes.append(kinds)
            children.append(item[first])
            rest = np.ones(len(item), bool)
            rest[first] = False
            at, item = item[first][inverse][rest], item[rest]
        order = np.argsort(np.concatenate(codes or [np.zeros(0, np.int64)]), kind="stable")
        self.codes = np.concatenate(codes or [np.zeros(0, np.int64)])[order]
        self.children = np.concatenate(children or [np.zeros(0, np.int64)])[order]

    def within(self, group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs at most ``radius`` bits apart in the same group."""
        slot = np.searchsorted(self.groups, group)
        query = np.flatnonzero((slot < len(self.groups)) & (self.groups[np.minimum(slot, len(self.groups) - 1)] == group))
        node = self.roots[slot[query]]
        found_q, found_n = [], []
        while len(query):
            d = _apart(fp[query], self.fp[node])
            hit = d <= radius
            found_q.append(query[hit])
            found_n.append(node[hit])
            lo = np.searchsorted(self.codes, node * (self.most + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.codes, node * (self.most + 1) + np.minimum(d + radius, self.most), side="right")
            n = hi - lo
            query = np.repeat(query, n)
            node = self.children[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.concatenate(found_q or [query]), np.concatenate(found_n or [query])


def shard_links(group: np.ndarray, fp: np.ndarray, is_tree: np.ndarray, is_query: np.ndarray, radius: int, pairs: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) of a spanning forest within each group; ``pairs`` bounds the
    words of fingerprints that are compared at once."""
    tree, query = np.flatnonzero(is_tree), np.flatnonzero(is_query)
    parent = np.arange(len(fp))
    if len(tree) and len(query):
        forest = Forest(group[tree], fp[tree])
        slot = np.minimum(np.searchsorted(forest.groups, group[query]), len(forest.groups) - 1)
        load = np.cumsum(forest.sizes[slot] * fp.shape[1])
        lo = 0
        while lo < len(query):
            hi = max(lo + 1, int(np.searchsorted(load, (load[lo - 1] if lo else 0) + pairs, side="right")))
            q, n = forest.within(group[query[lo:hi]], fp[query[lo:hi]], radius)
            graph.unite(parent, query[lo:hi][q], tree[n])
            lo = hi
    linked = np.flatnonzero(parent != np.arange(len(fp)))
    return linked, parent[linked]


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of 64 bits such that two numbers at most ``radius`` bits apart agree under
    at least one of them: all choices of ``blocks - radius`` of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(each[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def dealt(placed: DataFrame, shard_rows: int, share: Column | None = None) -> DataFrame:
    """Rows (fp, f, shard) with the group g in which they meet others of their shard,
    once with each row at least; crowded shards are dealt over blocks, which meet
    pairwise, as trees, queries or both. A block holds ``shard_rows`` rows, or less, if
    the rows' ``share`` says how much of a block they fill."""
    blocks = F.count("*") / shard_rows if share is None else F.greatest(F.count("*") / shard_rows, F.sum(share))
    crowded = placed.groupBy("shard").agg(F.ceil(blocks).cast("int").alias("parts")).where("parts > 1")
    # Written first: few shards are, and a join that knows how few need not gather a shard's rows.
    placed = placed.join(shared.if_small(shared.stash(crowded, "crowded-shards"), 32), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    # A row is in the tree of its own block for all later blocks of queries, and queries the trees of all earlier ones.
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "fp", "f", (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query")
    )


def links(nodes: DataFrame, radius: int = 4, shard_rows: int = 2048, width: int = 1) -> DataFrame:
    """Links (a, b) that connect the fingerprints of ``nodes`` (columns fp, distinct, and
    f) which are at most ``radius`` bits apart, directly or through others. Fingerprints
    of more than one word are compared all with all, which takes time in proportion to
    the square of their number."""
    n = nodes.count()
    if width == 1:
        # As few keys a fingerprint as keep the average shard at a block, which its tree prunes.
        blocks = radius + 1
        while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > shard_rows:
            blocks += 1
        masks = [[m] for m in block_masks(blocks, radius)]
    else:
        masks = [[0] * width]  # no bits need agree: one shard, dealt over blocks
    signed = [[m - (1 << 64) if m >> 63 else m for m in mask] for mask in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.get("f", F.lit(w)).bitwiseAND(F.lit(m)) for w, m in enumerate(mask) if m]) for i, mask in enumerate(signed)])
    placed = nodes.select("fp", "f", F.explode(keys).alias("shard"))
    return search(dealt(placed, shard_rows), radius, width, shared.parts_for(nodes.sparkSession, n * len(signed), 1_000_000))


def search(each: DataFrame, radius: int, width: int, parts: int) -> DataFrame:
    """Links (a, b) that connect what is within ``radius`` of each other in a group of
    dealt(), directly or through others: a BK-tree for each group, and its queries."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[list[np.ndarray]] = []

        def links_of(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            g, fp, f, tree, query = [np.concatenate(x) for x in zip(*parts)]
            a, b = shard_links(g, f, tree, query, radius)
            out = pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])
            shared.trim()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            g, fp, tree, query = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 3, 4))
            f = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, width)
            held.append([g, fp, f, tree, query])
            if sum(x[2].size for x in held) >= 1 << 17:
                g = np.concatenate([x[0] for x in held])
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                if cut:
                    whole = [np.concatenate(x) for x in zip(*held)]
                    yield links_of([[x[:cut] for x in whole]])
                    held = [[x[cut:] for x in whole]]
        if held:
            yield links_of(held)

    return each.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(work, "a long, b long")


def cluster(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, radius: int = 4, shard_rows: int = 2048, width: int = 1) -> DataFrame:
    """(key, fp, component_id, root) for every row: its fingerprint (see fingerprints) and
    the smallest key among the rows it is linked to, directly or through others."""
    printed = shared.stash(fingerprints(docs, text, key, words, width), "fingerprints")
    classes = shared.stash(printed.groupBy("fp").agg(F.min(key).alias("least"), F.min("f").alias("f")), "fingerprint-classes")
    return named(printed, classes, links(classes.select("fp", "f"), radius, shard_rows, width), key)


def named(printed: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, fp, component_id, root) for the rows of ``printed``, by the links ``found``
    between the distinct fp of ``classes``, whose smallest key is ``least``; the root is
    one fp of a component, and tells components apart that a repeated key names."""
    roots = graph.components(found)
    rooted = classes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(names, "root").select("fp", "component_id", "root")
    return printed.join(by_print, "fp").select(key, "fp", "component_id", "root")


def radius_for(similarity: float, width: int) -> int:
    """The differing bits to expect of two sets of shingles of equal size with the given
    Jaccard similarity (the angle between them, as a share of the bits), rounded up."""
    cosine = 2 * similarity / (1 + similarity)
    return int(np.ceil(64 * width * np.arccos(cosine) / np.pi))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, radius: int = 4, width: int = 1) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest key.
    Rows with a null key stay only where no row of their group has a key. A key that
    occurs more than once has a row for each group that it is the smallest key of."""
    grouped = shared.stash(cluster(docs.select(key, text), text, key, words, radius, width=width), "near-duplicates")
    return keep_of(docs, grouped, lambda lone: fingerprints(lone, text, "_th", words, width), text, key)


def keep_of(docs: DataFrame, grouped: DataFrame, prints: Callable[[DataFrame], DataFrame], text: str, key: str) -> DataFrame:
    """keep_one() for the groups of ``grouped`` (key, fp, component_id, root); ``prints`` gives
    the fp of rows (_th, text)."""
    kept = shared.stash(grouped.where(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept"), "fp", "root").distinct(), "kept-keys")
    named = docs.where(F.col(key).isNotNull()).join(shared.if_small(kept.select("_kept").distinct()), F.col(key) == F.col("_kept"), "left_semi")
    twice = grouped.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_kept")).count().where("count > 1").select("_kept")
    if not twice.isEmpty():  # rows of one key and group are one; rows of other groups are none of it
        again = named.join(twice, F.col(key) == F.col("_kept"), "left_semi").withColumn("_th", F.xxhash64(text))
        of = prints(again.select("_th", text)).select("_th", F.col("fp").alias("_fp")).distinct()
        roots = kept.select("_kept", F.col("fp").alias("_fp"), F.col("root").alias("_root"))
        again = again.join(of, "_th").join(roots.withColumnRenamed("_kept", "_key_kept"), ["_fp"]).where(F.col(key) == F.col("_key_kept")).dropDuplicates([key, "_root"])
        named = named.join(twice, F.col(key) == F.col("_kept"), "left_anti").unionByName(again.select(*docs.columns))
    if kept.where("_kept is null").isEmpty():
        return named
    lone = docs.where(F.col(key).isNull())
    alone = prints(lone.select(F.xxhash64(text).alias("_th"), text)).join(kept.where("_kept is null"), "fp").select("_th").distinct()
    lone = lone.withColumn("_th", F.xxhash64(text)).join(alone, "_th", "left_semi").dropDuplicates(["_th"]).drop("_th")
    return named.unionByName(lone.select(*docs.columns))
