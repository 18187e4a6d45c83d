"""Substring dedup over words with fixed-block anchors.

A window of ``window`` words holds a whole block of ``block`` words of any grid of such
blocks if window >= 2 * block - 1. So it is enough to index the blocks at every
block-th word of each document and to probe them with every rolling span of ``block``
words. Hits with a document of a smaller key are extended to the windows around them
on both sides; a window is repeated if the same words start in a smaller key. The union
of repeated windows is what the maximal exact repeats cover.

Both exchanges send packed numpy arrays, keyed by bucket: a probe is its hash, the number
of its document in the piece of the table that it comes from, and its place, 7 bytes,
however many buckets there are; only what is indexed carries the document's key. A
bucket's task reads the index first (distinct hashes, least key), then streams the
probes, so a block or window that very many documents share costs one entry and is never
gathered. It returns the least key that has a probe's hash; whether that is smaller than
the document's is decided where the hits of a piece meet. A hash that was indexed once
needs no answer for that one itself. Blocks are found by 32 bits of hash and the bucket,
which may only add candidates; windows are decided by 64 bits.

A block or window that very many texts have would bring all its probes to one bucket.
Such spans are known from a sample, and what decides them, the least and the largest key
that has each, is aggregated in their tasks first; with that small table every task finds
their hits itself. The sample decides where a span is looked up, never whether it counts.

Edge cases: null and empty texts have no words; texts shorter than a window lose
nothing; a null key counts as larger than all others; rows repeated with the same key
do not remove each other, since neither key is smaller; extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared

NULL_KEY = (1 << 63) - 1
#: Bytes of text that one bucket stands for: about two million words.
BUCKET_BYTES = 12 << 20
#: Bytes of text whose payloads are made together.
STEP_BYTES = 2 << 20
#: The sample for hot spans: bytes of text at least, and the share of all text at least.
SAMPLE_BYTES, SAMPLE_SHARE = 32 << 20, 2000
#: How often a span occurs, by the sample, to be hot, and in it; the most spans of a kind that are.
HOT_COUNT, HOT_LEAST, HOT_MOST = 50_000, 32, 50_000


def rolling(hashes: np.ndarray, before: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, place in the row) of all spans of ``width`` words within a row."""
    count = np.maximum(np.diff(before) - width + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = before[:-1][row] + place
    if not len(hashes) or len(hashes) < width:
        return np.zeros(0, np.uint64), row, place
    total = np.zeros(len(hashes) - width + 1, np.uint64)
    factor = 1
    for j in range(width):
        factor = factor * (0xD6E8FEB86659FD93 + 2 * seed) % (1 << 64)
        total += hashes[j : j + len(total)] * np.uint64(factor)
    return shared.mix(total[at]), row, place


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, the numbers) in the narrowest unsigned type that holds them."""
    width = next(w for w in (1, 2, 4) if not len(x) or x.max() < 1 << (8 * w))
    return width, x.astype(f"<u{width}").tobytes()


def _cuts(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that hashes fall into, with the numbers of the hashes in order."""
    bucket = _bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        yield b, order[cut[b] : cut[b + 1]]


def pack_places(kind: int, h: np.ndarray, row: np.ndarray, place: np.ndarray, buckets: int, width: str) -> Iterator[tuple[int, int, bytes]]:
    """A payload for each bucket: hashes, rows (ascending, as steps) and places."""
    for b, part in _cuts(h, buckets):
        (w_row, rows), (w_place, places) = _narrow(np.diff(row[part], prepend=0)), _narrow(place[part])
        yield b, kind, struct.pack("<IBB", len(part), w_row, w_place) + h[part].astype(width).tobytes() + rows + places


def unpack_places(payload: bytes, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, places) of a payload."""
    n, w_row, w_place = struct.unpack_from("<IBB", payload)
    at = struct.calcsize("<IBB")
    h = np.frombuffer(payload, width, n, at)
    at += h.nbytes
    rows = np.frombuffer(payload, f"<u{w_row}", n, at)
    return h, np.cumsum(rows.astype(np.int64)), np.frombuffer(payload, f"<u{w_place}", n, at + rows.nbytes)


def pack_index(h: np.ndarray, key: np.ndarray, buckets: int, width: str) -> Iterator[tuple[int, int, bytes]]:
    """A payload for each bucket: hashes and the key that has each."""
    for b, part in _cuts(h, buckets):
        yield b, INDEX, struct.pack("<I", len(part)) + h[part].astype(width).tobytes() + key[part].astype("<i8").tobytes()


class Index:
    """Distinct hashes with the least key that has each, how many entries were made of it,
    and how many probes asked for it."""

    def __init__(self, width: str):
        self.width = width
        self.h, self.least, self.entries = np.zeros(0, width), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._waiting = 0

    def add(self, payload: bytes) -> None:
        (n,) = struct.unpack_from("<I", payload)
        h = np.frombuffer(payload, self.width, n, 4)
        self._new.append((h, np.frombuffer(payload, "<i8", n, 4 + h.nbytes)))
        self._waiting += n
        if self._waiting > max(500_000, len(self.h)):
            self.settle()

    def settle(self) -> None:
        if self._new:
            h = np.concatenate([self.h, *[x[0] for x in self._new]])
            key = np.concatenate([self.least, *[x[1] for x in self._new]])
            entries = np.concatenate([self.entries, np.ones(len(h) - len(self.h), np.int64)])
            order = np.argsort(h, kind="stable")
            h, key, entries = h[order], key[order], entries[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            self.h, self.least, self.entries = h[first], np.minimum.reduceat(key, first), np.add.reduceat(entries, first)
            self._new, self._waiting = [], 0
        self.asked = np.zeros(len(self.h), np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the known ones of ``h`` are, which are known)."""
        if not len(self.h):
            return np.zeros(0, np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        known = self.h[at] == h
        return at[known], known


#: Kinds of payloads, in the order in which a bucket reads them.
INDEX, PROBE, BACK, FOUND, KEYS = 0, 1, 2, 3, 4
#: The least key of hits that need no comparison.
SURE = np.iinfo(np.int64).min
#: Kinds of spans.
BLOCK, WINDOW = 0, 1


class Hot:
    """Hashes of hot spans, ascending, with the least and the largest key that has each."""

    def __init__(self, h: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None):
        self.h, self.least, self.most = h, least, most

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are hot, where)."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return self.h[at] == h, at


def pack_hits(row: np.ndarray, place: np.ndarray, least: np.ndarray) -> bytes:
    """Rows of a piece, their places, and the least key that has what is there."""
    return struct.pack("<I", len(row)) + least.astype("<i8").tobytes() + row.astype("<u4").tobytes() + place.astype("<u4").tobytes()


def unpack_hits(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", payload)
    return np.frombuffer(payload, "<u4", n, 4 + 8 * n), np.frombuffer(payload, "<u4", n, 4 + 12 * n), np.frombuffer(payload, "<i8", n, 4)


def exchange(payloads: DataFrame, buckets: int, width: str, grid: int) -> DataFrame:
    """(key, th, places): the items of PROBE payloads whose hash the index has with a smaller
    key, those of BACK payloads whose hash others have asked for, and all of FOUND ones.
    Probes at multiples of ``grid`` were indexed themselves.

    Hits go back packed, a row a payload, to where those of one piece of the table meet
    with its documents' keys; there each document gets one row.
    """

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, bucket, settled = Index(width), None, False
        for batch in batches:
            chunks, kinds, found = [], [], []
            for b, kind, chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b != bucket:
                    index, bucket, settled = Index(width), b, False
                if kind in (FOUND, KEYS):
                    chunks.append(chunk)
                    kinds.append(kind)
                    found.append(payload.as_buffer().to_pybytes())
                    continue
                if kind == INDEX:
                    index.add(payload.as_buffer())
                    continue
                if not settled:
                    index.settle()
                    settled = True
                h, row, place = unpack_places(payload.as_buffer(), width)
                at, known = index.find(h)
                if kind == PROBE:
                    np.add.at(index.asked, at, 1)
                    hit = (index.entries[at] > 1) | (place[known] % grid != 0)
                    least = index.least[at][hit]
                else:
                    hit = index.asked[at] > 1
                    least = np.full(int(hit.sum()), SURE)
                if hit.any():
                    chunks.append(chunk)
                    kinds.append(FOUND)
                    found.append(pack_hits(row[known][hit], place[known][hit], least))
            shared.trim()
            if chunks:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(found, pa.binary())], ["chunk", "kind", "found"])

    def gather(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chunk, keys, hits = None, None, []

        def rows():
            row, place, least = (np.concatenate(x) for x in zip(*hits))
            use = least < keys[row, 0]
            key, place = keys[row[use]], place[use]
            order = np.lexsort((place, key[:, 1], key[:, 0]))
            key, place = key[order], place[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))[: len(key)])
            lists = [x.tobytes() for x in np.split(place, first[1:])] if len(first) else []
            return pa.RecordBatch.from_arrays([pa.array(key[first, 0]), pa.array(key[first, 1]), pa.array(lists, pa.binary())], ["key", "th", "places"])

        for batch in batches:
            for c, kind, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if c != chunk:
                    if hits:
                        yield rows()
                    chunk, keys, hits = c, None, []
                if kind == KEYS:
                    keys = np.frombuffer(found.as_buffer(), "<i8").reshape(-1, 2)
                else:
                    hits.append(unpack_hits(found.as_buffer()))
        if hits:
            yield rows()

    # Buckets are partitions: hashing them once more would put several into one task.
    dealt = payloads.repartitionById(max(1, buckets), "bucket").sortWithinPartitions("bucket", "kind")
    hits = dealt.mapInArrow(ask, "chunk long, kind int, found binary")
    return hits.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gather, "key long, th long, places binary")


def _batch(rows: list, keys: np.ndarray, buckets: int) -> object:
    """The payloads of a piece of the table, and the keys of its rows. The piece's number
    only brings its hits together."""
    import pyarrow as pa

    chunk = int(shared.mix(shared.mix(keys.ravel().view(np.uint64)).sum(keepdims=True).ravel()).view(np.int64)[0])
    b, kind, payload = zip(*rows, (chunk % buckets, KEYS, np.ascontiguousarray(keys, "<i8").tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([chunk % buckets if k == FOUND else x for x, k in zip(b, kind)], pa.int32()), pa.array(kind, pa.int32()), pa.array([chunk] * len(b), pa.int64()), pa.array(payload, pa.binary())], ["bucket", "kind", "chunk", "payload"])


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (shared.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(buckets)).astype(np.int64)


def _found(row: np.ndarray, place: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A payload of hits that are known already; it passes through any bucket."""
    return [(0, FOUND, pack_hits(row, place, np.full(len(row), SURE)))] if len(row) else []


def _positions(lists) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in lists])).astype(np.int64) if lists else np.zeros(0, np.int64)


def _spans(column, keys: np.ndarray, window: int, block: int) -> Iterator[tuple]:
    """For pieces of a batch's texts: (their keys, and hash, row and place of the blocks
    that a window can hold and of the windows)."""
    for lo, _, data, at in shared.text_steps(column, STEP_BYTES):
        starts, ends, before = shared.word_spans(data, at)
        words = shared.Spans(data).of(starts, ends)
        h, row, place = rolling(words, before, block, 1)
        long = np.diff(before)[row] >= window
        yield keys[lo : lo + len(at) - 1], (h[long], row[long], place[long]), rolling(words, before, window, 2)


def hot_spans(rows: DataFrame, size: int, window: int, block: int) -> tuple[Hot, Hot]:
    """The hot blocks and windows of ``rows`` (_key, _th, _text): known from a sample, with
    keys from all rows. HOT_MOST of each at most reach the driver."""
    one_in = max(1, min(size // SAMPLE_BYTES, SAMPLE_SHARE))
    keys_of = lambda batch: np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, blocks, windows in _spans(batch.column(2), keys_of(batch), window, block):
                for kind, (h, _, _) in ((BLOCK, blocks), (WINDOW, windows)):
                    each, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), kind, np.int32)), pa.array(each.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

    some = rows.where(F.pmod(F.col("_th"), F.lit(one_in)) == 0).mapInArrow(count, "kind int, h long, n long")
    often = some.groupBy("kind", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, HOT_COUNT // one_in))
    taken = [often.where(F.col("kind") == kind).orderBy(F.desc("n"), "h").limit(HOT_MOST).toArrow()["h"].to_numpy().view(np.uint64) for kind in (BLOCK, WINDOW)]
    hot = [Hot(np.sort(h)) for h in taken]
    if not any(len(x.h) for x in hot):
        return hot[0], hot[1]

    def decide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for keys, blocks, windows in _spans(batch.column(2), keys_of(batch), window, block):
                for kind, (h, row, place) in ((BLOCK, blocks), (WINDOW, windows)):
                    is_hot, at = hot[kind].find(h)
                    at, key = at[is_hot], keys[row[is_hot], 0]
                    least, most = np.full(len(hot[kind].h), NULL_KEY), np.full(len(hot[kind].h), np.iinfo(np.int64).min)
                    indexed = place[is_hot] % block == 0 if kind == BLOCK else np.ones(len(at), bool)
                    np.minimum.at(least, at[indexed], key[indexed])
                    np.maximum.at(most, at, key)
                    some = np.unique(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(hot[kind].h[some].view(np.int64)), pa.array(least[some]), pa.array(most[some])], ["kind", "h", "least", "most"])

    known = rows.mapInArrow(decide, "kind int, h long, least long, most long").groupBy("kind", "h").agg(F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
    out = []
    for kind in (BLOCK, WINDOW):
        own = known["kind"].to_numpy() == kind
        h, least, most = (known[c].to_numpy()[own] for c in ("h", "least", "most"))
        order = np.argsort(h.view(np.uint64))
        out.append(Hot(h.view(np.uint64)[order], least[order], most[order]))
    return out[0], out[1]


def repeated_windows(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 13, block: int | None = None) -> DataFrame:
    """(key, th, places): starts of the windows, in words, whose words also start in a row
    with a smaller key; several rows a document. A null key is NULL_KEY here, and th, a
    hash of the text, tells rows with one key apart."""
    block = block or (window + 1) // 2
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block of the grid")
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{key} must be an integer, as keys are compared by size")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("_key"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = shared.parts_for(docs.sparkSession, size, BUCKET_BYTES)
    hot_blocks, hot_windows = hot_spans(rows, size, window, block)

    def blocks(batches: Iterator) -> Iterator:
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for lo, _, data, at in shared.text_steps(batch.column(2), STEP_BYTES):
                starts, ends, before = shared.word_spans(data, at)
                h, row, place = rolling(shared.Spans(data).of(starts, ends), before, block, 1)
                long = np.diff(before)[row] >= window
                h, row, place = h[long], row[long], place[long]
                own, out = keys[lo : lo + len(at) - 1], []
                hot, where = hot_blocks.find(h)
                if hot.any():
                    k = own[row[hot], 0]
                    hit = (hot_blocks.least[where[hot]] < k) | ((place[hot] % block == 0) & (hot_blocks.most[where[hot]] > k))
                    out += _found(row[hot][hit], place[hot][hit])
                    h, row, place = h[~hot], row[~hot], place[~hot]
                grid = place % block == 0
                out += pack_places(PROBE, h, row, place, buckets, "<u4")
                out += pack_index(h[grid], own[row[grid], 0], buckets, "<u4")
                out += pack_places(BACK, h[grid], row[grid], place[grid], buckets, "<u4")
                if out:
                    yield _batch(out, own, buckets)

    payload = "bucket int, kind int, chunk long, payload binary"
    hits = exchange(rows.mapInArrow(blocks, payload), buckets, "<u4", block)
    hits = shared.stash(hits.groupBy("key", "th").agg(F.collect_list("places").alias("places")), "block-hits")
    shared.free_shuffles(docs.sparkSession)
    near = rows.join(hits, (rows["_key"] == hits["key"]) & (rows["_th"] == hits["th"])).select("_key", "_th", "_text", "places")

    def windows(batches: Iterator) -> Iterator:
        for batch in batches:
            keys, lists = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), batch.column(3).to_pylist()
            for lo, _, data, at in shared.text_steps(batch.column(2), STEP_BYTES):
                starts, ends, before = shared.word_spans(data, at)
                h, row, place = rolling(shared.Spans(data).of(starts, ends), before, window, 2)
                near = np.zeros(int(before[-1]) + 1, np.int64)  # how far hits reach, as steps up and down
                for i in range(len(at) - 1):
                    n, p = int(before[i + 1] - before[i]), _positions(lists[lo + i])
                    p = p[p < n]
                    np.add.at(near, before[i] + np.maximum(p - (window - block), 0), 1)
                    np.add.at(near, before[i] + np.minimum(p + 1, n), -1)
                use = np.cumsum(near)[before[:-1][row] + place] > 0
                h, row, place = h[use], row[use], place[use]
                own, out = keys[lo : lo + len(at) - 1], []
                hot, where = hot_windows.find(h)
                if hot.any():
                    hit = hot_windows.least[where[hot]] < own[row[hot], 0]
                    out += _found(row[hot][hit], place[hot][hit])
                    h, row, place = h[~hot], row[~hot], place[~hot]
                # Each hash is indexed once, with its least key here; rows with larger ones have their answer.
                key = own[row, 0]
                order = np.lexsort((key, h))
                once = order[np.append(True, h[order][1:] != h[order][:-1])[: len(h)]]
                least = np.empty(len(h), np.int64)
                least[order] = np.repeat(key[once], np.diff(np.append(np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])[: len(h)]), len(h))))
                later = key > least
                out += _found(row[later], place[later])
                out += pack_places(PROBE, h[~later], row[~later], place[~later], buckets, "<u8")
                out += pack_index(h[once], key[once], buckets, "<u8")
                if out:
                    yield _batch(out, own, buckets)

    found = exchange(near.mapInArrow(windows, payload), buckets, "<u8", 1)
    found = shared.stash(found, "repeated-windows")
    shared.free_shuffles(docs.sparkSession)
    return found


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 13, block: int | None = None) -> DataFrame:
    """(key, n_words, spans, kept) for every row: its words, the maximal runs of removed
    words as (start, end), and the words that stay, joined by one space."""
    shared.text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_name"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("_key"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    found = repeated_windows(docs, text, key, window, block).groupBy("key", "th").agg(F.collect_list("places").alias("places"))
    joined = rows.join(found, (rows["_key"] == found["key"]) & (rows["_th"] == found["th"]), "left").select("_name", "_text", "places")
    kind = rows.schema["_name"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2).to_pylist()
            for lo, hi, data, at in shared.text_steps(batch.column(1)):
                starts, ends, before = shared.word_spans(data, at)
                whole = data.tobytes()
                n_words, spans, kept = np.diff(before), [], []
                for i in range(hi - lo):
                    n, first = int(n_words[i]), int(before[i])
                    steps = np.zeros(n + 1, np.int64)
                    p = _positions(lists[lo + i])
                    steps[p] += 1
                    np.add.at(steps, p + window, -1)
                    gone = np.cumsum(steps)[:n] > 0
                    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                    stay = np.flatnonzero(~gone) + first
                    kept.append(b" ".join([whole[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]).decode())
                struct_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n_words.astype(np.int64)), pa.array(spans, struct_type), pa.array(kept, pa.string())], ["_name", "n_words", "spans", "kept"])

    out = joined.mapInArrow(cut, f"_name {kind}, n_words long, spans array<struct<start: long, end: long>>, kept string")
    return out.withColumnRenamed("_name", key)
