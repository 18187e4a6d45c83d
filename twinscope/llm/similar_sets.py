"""Near-duplicates by the similarity of whole shingle sets: texts link if their sets of
shingles have a Jaccard similarity of at least a given value. SimHash fingerprints in
BK-trees find the pairs (see simhash), and every pair found is checked by its sets.

Shards: fingerprints alone cannot be dealt into shards at such a similarity, since no bits
of two of them need agree. Sets can: let a set of n shingles need a = ceil(similarity * n)
of them in common with a partner. In any one order of all shingles, the first n - a + 1
of both sets then share one, and the first n - a + k of both share k. So a set lives on
only if enough of its first shingles occur in other sets that live on, which leaves few
but near-duplicates; and those that share one of the first n - a + 1 are a shard.
Shingles that the same sets share are one shard; those that more than ``shard_rows`` sets
share make one with all such that they share sets with.

Search: each shard has a BK-tree over fingerprints of WIDTH words, and a query follows
the edges within the radius, six standard deviations above the bits in which two sets at
the limit of the similarity are expected to differ (see radius_for): one pair in a
billion is further apart. What this links, directly or through others, meets with whole
sets, once, and every link that counts is checked by them. A crowd of more than a block
is dealt over blocks that meet pairwise; sets that links have joined need no queries of
their own, so near copies are searched in a few.

Order: shingles that very many texts have come last, so that texts which share but a
common passage do not meet; where they do count, they are dealt over HOT_PARTS. They are
known from a sample, which decides the order of work, never which sets are similar.

Edge cases: shingles as in ``simhash``, told apart by 64 bits of hash; texts without words
have one set, the empty one, and link with nothing but each other, by being equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.llm import graph, shared, simhash

#: Keeps products of similarities and counts on the side that loses no pair.
EPS = 1e-9
#: Words of 64 bits in a fingerprint.
WIDTH = 8
#: Shingles of candidates that are compared at once.
LISTED = 1 << 18
#: Shingles of all sets of a block, and of the groups that are searched together.
BLOCK_SHINGLES, STEP_SHINGLES = 1 << 20, 1 << 19
#: Texts of the sample that a shingle is in to be hot; the most that are; parts that they are dealt over.
HOT_ROWS, HOT_MOST, HOT_PARTS = 12, 100_000, 64
#: The sample: bytes of text at least, and one in so many texts at least.
SAMPLE_BYTES, SAMPLE_SHARE = 16 << 20, 1000
#: Fingerprints of copies that a task remembers, to send their shingles once.
SEEN = 1 << 17


def _need(n, similarity: float):
    """How many of its n shingles a set shares with a partner, at least."""
    if isinstance(n, Column):
        return F.ceil(n * F.lit(similarity) - F.lit(EPS)).cast("int")
    return np.ceil(n * similarity - EPS).astype(np.int64)


def radius_for(similarity: float, width: int = WIDTH) -> int:
    """Bits in which fingerprints of sets at the limit may differ: six deviations above
    what is expected. Majorities of few shingles differ more often than the angle
    between long sets says, by a quarter at most."""
    cosine = 2 * similarity / (1 + similarity)
    share = 1.25 * np.arccos(cosine) / np.pi
    bits = 64 * width
    return int(np.ceil(bits * share + 6 * np.sqrt(bits * share * (1 - share))))


def sets_of(data: np.ndarray, rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets into them): each text's distinct shingles in ascending order."""
    from xxhash import xxh64_intdigest

    text, starts, ends, row = simhash.shingle_bounds(data, rows, words)
    h = np.fromiter((xxh64_intdigest(text[s:e], simhash.SEED) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(rows)))


def _hot_last(h: np.ndarray, off: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Each row's hashes in ascending order, those that are ``hot`` (ascending) last."""
    if not len(hot) or not len(h):
        return h
    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
    return h[np.lexsort((is_hot, np.repeat(np.arange(len(off) - 1), np.diff(off))))]


def _fp(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A long for each set that stands for it."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(h[a:b].tobytes(), simhash.SEED) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64).view(np.int64)


def _first(n, similarity: float):
    """How many of its first shingles tell whether a set may have a partner."""
    spare = n - _need(n, similarity)
    if isinstance(n, Column):
        return F.least(n, spare + F.greatest(spare, F.lit(1)))
    return np.minimum(n, spare + np.maximum(spare, 1))


def prints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5) -> DataFrame:
    """(key, fp, n) for each row: a long that stands for its set, and the set's size."""
    shared.text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, at in shared.text_steps(batch.column(1)):
                h, off = sets_of(data, at, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(_fp(h, off)), pa.array(np.diff(off).astype(np.int32))], ["_key", "fp", "n"])

    return rows.mapInArrow(work, f"_key {kind}, fp long, n int").withColumnRenamed("_key", key)


def first_shingles(texts: DataFrame, words: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """(fp, n, t): the first shingles of the sets of ``texts`` (one column), or all of them
    for a similarity of 0. Copies in one task are sent once."""
    shared.text_batches(texts.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for _, _, data, at in shared.text_steps(batch.column(0)):
                h, off = sets_of(data, at, words)
                fp, n = _fp(h, off), np.diff(off)
                fresh = np.ones(len(fp), bool)
                for i, x in enumerate(fp.tolist()):
                    fresh[i] = x not in seen
                    seen.add(x)
                if len(seen) > SEEN:
                    seen.clear()
                most = np.where(fresh, _first(n, similarity) if similarity else n, 0)
                t = _hot_last(h, off, hot)[np.arange(len(h)) - np.repeat(off[:-1], n) < np.repeat(most, n)].view(np.int64)
                if len(t):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, most)), pa.array(np.repeat(n, most).astype(np.int32)), pa.array(t)], ["fp", "n", "t"])

    return texts.mapInArrow(work, "fp long, n int, t long")


def whole_sets(texts: DataFrame, words: int, hot: np.ndarray) -> DataFrame:
    """(fp, n, f): the sets of ``texts`` (one column), each as its fingerprint's WIDTH words
    and then all its shingles in order."""
    shared.text_batches(texts.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, data, at in shared.text_steps(batch.column(0)):
                h, off = sets_of(data, at, words)
                n = np.diff(off)
                wide = simhash.bits_of(h, np.repeat(np.arange(len(n)), n), len(n), WIDTH)
                ends = np.cumsum(n + WIDTH)
                f = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
                head = (ends - n - WIDTH)[:, None] + np.arange(WIDTH)
                f[head] = wide
                f[np.arange(len(h)) + np.repeat(np.arange(1, len(n) + 1) * WIDTH, n)] = _hot_last(h, off, hot)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(f.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_fp(h, off)), pa.array(n.astype(np.int32)), lists], ["fp", "n", "f"])

    return texts.mapInArrow(work, "fp long, n int, f array<long>")


def group_links(group: np.ndarray, off: np.ndarray, f: np.ndarray, similarity: float) -> np.ndarray:
    """The parents of a forest that joins the sets (WIDTH words of fingerprint, then
    shingles, from off[i] on) of one group which are similar, directly or through others.
    ``group`` is ascending."""
    n = len(group)
    size = np.diff(off) - WIDTH
    prints_ = f[off[:-1][:, None] + np.arange(WIDTH)].view(np.uint64)
    # Sets with one fingerprint are one node of the tree.
    order = np.lexsort((*prints_.T, group))
    new = np.append(True, (prints_[order][1:] != prints_[order][:-1]).any(axis=1) | (group[order][1:] != group[order][:-1]))[:n]
    node = np.empty(n, np.int64)
    node[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    members = np.append(first, n)
    forest = simhash.Forest(group[order][first], prints_[order][first])
    radius = radius_for(similarity)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    parent, done, quota = np.arange(n), np.zeros(n, bool), 4
    while True:
        # Of two sets that are not joined yet, one at least is outside the largest tree of the group.
        count = np.bincount(parent, minlength=n)[parent]
        most = np.maximum.reduceat(count, starts)
        at_most = np.flatnonzero(count == most[own])
        largest = np.empty(len(starts), np.int64)
        largest[own[at_most][::-1]] = parent[at_most][::-1]
        todo = np.flatnonzero(~done & (parent != largest[own]))
        if not len(todo):
            return parent
        begin = np.searchsorted(own[todo], np.arange(len(starts)))
        todo = todo[np.arange(len(todo)) - begin[own[todo]] < quota]
        quota *= 2
        done[todo] = True
        for lo in range(0, len(todo), 64):
            part = todo[lo : lo + 64]
            q, found = forest.within(group[part], prints_[part], radius)
            # All sets of the nodes found, but those that the query has joined before.
            many = members[found + 1] - members[found]
            q = np.repeat(part[q], many)
            other = order[np.repeat(members[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            apart = parent[q] != parent[other]
            q, other = q[apart], other[apart]
            by = np.argsort(q, kind="stable")
            q, other = q[by], other[by]
            total = np.cumsum(size[other])
            a = 0
            while a < len(q):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + LISTED, side="right")))
                b = min(b, int(np.searchsorted(q, q[a], side="right")))  # one query at a time
                i, js = q[a], other[a:b]
                js = js[parent[js] != parent[i]]
                if len(js):
                    mine, m = np.sort(f[off[i] + WIDTH : off[i + 1]]), size[js]
                    theirs = f[np.repeat(off[js] + WIDTH - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                    place = np.minimum(np.searchsorted(mine, theirs), max(0, len(mine) - 1))
                    common = np.bincount(np.repeat(np.arange(len(js)), m)[mine[place] == theirs] if len(mine) else np.zeros(0, np.int64), minlength=len(js))
                    hit = js[(common > 0) & (common >= similarity * (size[i] + m - common) - EPS)]
                    graph.unite(parent, np.full(len(hit), i), hit)
                a = b


def _alive(first: DataFrame, hot: DataFrame, similarity: float) -> DataFrame:
    """(fp): the sets of ``first`` (fp, n, t) with which others share enough first shingles."""
    salted = first.join(F.broadcast(hot), "t", "left").withColumn("part", F.when(F.col("hot"), 1 + F.pmod("fp", F.lit(HOT_PARTS))).otherwise(0))
    by = Window.partitionBy("t", "part")
    common = salted.withColumn("others", (F.col("part") > 0) | (F.min("fp").over(by) != F.max("fp").over(by))).where("others")
    have = common.groupBy("fp", "n").agg(F.count_distinct("t").alias("have"))
    least = _need(F.col("n"), similarity)
    return have.where(F.col("have") >= F.greatest(least - _need(least, similarity), F.lit(1))).select("fp")


def hot_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles that very many sets have, by a sample of the texts, ascending; HOT_MOST
    at most, by which they may be sent to all tasks."""
    text = texts.columns[0]
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    one_in = max(1, min(size // SAMPLE_BYTES, SAMPLE_SHARE))
    some = first_shingles(texts.where(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0), words, 0.0, np.zeros(0, np.uint64))
    often = some.groupBy("t").count().where(F.col("count") >= HOT_ROWS).orderBy(F.desc("count"), "t").limit(HOT_MOST)
    return np.sort(often.toArrow()["t"].to_numpy().view(np.uint64))


def _shards(nodes: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """(fp, shard): the sets of ``nodes`` (fp, n, f) that meet. Sets that share one of
    their first shingles share a shard."""
    first = F.slice("f", F.lit(WIDTH + 1), F.col("n") - _need(F.col("n"), similarity) + 1)
    first = shared.stash(nodes.select("fp", F.explode(first).alias("t")), "first-shingles")
    # Who shares a shingle, told by hashes over all of them, which tasks combine.
    who = first.groupBy("t").agg(F.count("*").alias("sets"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"), F.min("fp").alias("least"))
    who = shared.stash(who.where("sets > 1"), "shared-shingles")
    few, many = (who.where(F.col("sets") <= shard_rows), who.where(F.col("sets") > shard_rows))
    placed = first.join(shared.if_small(few.select("t", F.xxhash64("sets", "x", "y").alias("shard")), 32), "t").select("fp", "shard").distinct()
    if many.isEmpty():
        return placed
    stars = first.join(shared.if_small(many.select("t", "least"), 32), "t").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    roots = graph.components(stars)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return placed.unionByName(roots.select(F.col("node").alias("fp"), F.xxhash64(F.lit("crowd"), "root").alias("shard")))


def links(docs: DataFrame, printed: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8, shard_rows: int = 2048) -> DataFrame:
    """Links (a, b) that connect the sets of ``docs`` which are similar, directly or
    through others; ``printed`` are the rows of prints()."""
    spark = docs.sparkSession
    texts = docs.select(text)
    last = hot_shingles(texts, words)
    hot = spark.createDataFrame([(t, True) for t in last.view(np.int64).tolist()], "t long, hot boolean")
    alive = shared.stash(_alive(first_shingles(texts, words, similarity, last), hot, similarity), "alive-keys")
    shared.free_shuffles(spark)
    # One text for each set that lives on; a key may have more than one, of which the others go again.
    named = printed.join(shared.if_small(alive), "fp", "left_semi").groupBy("fp").agg(F.min(key).alias("_key")).select("_key").distinct()
    named = shared.if_small(shared.stash(named, "alive-rows"))
    chosen = docs.join(named, F.col(key) == F.col("_key"), "left_semi").unionByName(docs.where(F.col(key).isNull()))
    nodes = whole_sets(chosen.select(text), words, last).join(shared.if_small(alive), "fp", "left_semi").dropDuplicates(["fp"])
    nodes = shared.stash(nodes, "alive-sets")
    shared.free_shuffles(spark)
    before = nodes.count()
    while before:  # fewer sets share fewer shingles
        first = F.explode(F.slice("f", F.lit(WIDTH + 1), _first(F.col("n"), similarity)))
        again = shared.stash(_alive(nodes.select("fp", "n", first.alias("t")), hot, similarity), "alive-keys")
        left = again.count()
        nodes = nodes.join(shared.if_small(again, rows=left), "fp", "left_semi")
        if left > 0.9 * before:
            break
        before = left
    # By fingerprints alone, which are small, to what may be similar; then by whole sets.
    prints_ = nodes.select("fp", F.slice("f", 1, WIDTH).alias("f"))
    placed = _shards(nodes, similarity, shard_rows).join(shared.if_small(prints_, 100, before), "fp")
    near = simhash.search(simhash.dealt(placed, shard_rows), radius_for(similarity), WIDTH, shared.parts_for(spark, before, 20_000))
    roots = graph.components(near).withColumnRenamed("node", "fp").withColumnRenamed("root", "shard")
    shared.free_shuffles(spark)
    shards = shared.stash(roots.unionByName(roots.select(F.col("shard").alias("fp"), "shard").distinct()), "set-shards")
    total = shards.count()
    placed = nodes.join(shared.if_small(shards, rows=total), "fp")
    each = simhash.dealt(placed, shard_rows, F.size("f") / BLOCK_SHINGLES).select("g", "fp", "f")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def links_of(g: np.ndarray, fp: np.ndarray, size: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            parent = group_links(g, np.append(0, np.cumsum(size)), f, similarity)
            linked = np.flatnonzero(parent != np.arange(len(fp)))
            shared.trim()
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[parent[linked]])], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column(2)
            size = np.diff(more.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
            held.append([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), size, more.flatten().to_numpy(zero_copy_only=False)])
            if sum(len(x[3]) for x in held) < STEP_SHINGLES:
                continue
            g, fp, size, f = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            held = [[g, fp, size, f]]
            if cut:
                to = int(size[:cut].sum())
                yield links_of(g[:cut], fp[:cut], size[:cut], f[:to])
                held = [[g[cut:], fp[cut:], size[cut:], f[to:]]]
        if held:
            yield links_of(*(np.concatenate(x) for x in zip(*held)))

    parts = shared.parts_for(spark, total, 20_000)
    return each.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(work, "a long, b long")


def cluster(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8, shard_rows: int = 2048) -> DataFrame:
    """(key, fp, component_id, root) for every row: what stands for its set (see prints)
    and the smallest key among the rows it is linked to, directly or through others."""
    docs = docs.select(key, text)
    printed = shared.stash(prints(docs, text, key, words), "set-prints")
    classes = printed.groupBy("fp").agg(F.min(key).alias("least"))
    return simhash.named(printed.select(key, "fp"), classes, links(docs, printed, text, key, words, similarity, shard_rows), key)


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest key.
    Rows with a null key stay only where no row of their group has a key. A key that
    occurs more than once has a row for each group that it is the smallest key of."""
    grouped = shared.stash(cluster(docs, text, key, words, similarity), "near-duplicates")
    shared.free_shuffles(docs.sparkSession)
    return simhash.keep_of(docs, grouped, lambda lone: prints(lone, text, "_th", words), text, key)
