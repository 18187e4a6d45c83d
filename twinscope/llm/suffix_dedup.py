"""Suffix-array dedup: remove every byte that lies in a repeated ``length``-byte string.

Equal strings must meet in one task. The smallest hash of a ``gram``-byte span inside a
string (its minimiser) is the same wherever the string occurs, so a text falls into
regions, the runs of windows with one minimiser, and regions meet by the minimiser's
hash. Hashes and positions of regions are exchanged first: a minimiser that occurs once
repeats nothing unless its region holds it twice, and regions with the same bytes (128
bits of hash) repeat all their windows; only one of each kind of region, and only where kinds differ, is fetched as text
and sorted.

Sorting: a region's bytes are cut where its content says so (by its next four bytes), the
pieces, each with the four bytes that end it, become symbols ranked by their bytes, and
the symbols' suffix array (linear grouping, see suffix_array) is the order of the
suffixes at the cuts, since no whole piece is a prefix of another. Common prefixes of
neighbours in that order, in bytes, follow by Kasai's scan. The order of all other
windows is induced from it, byte by byte away from the cuts: first the byte, then the
order of what follows. Two neighbours are equal windows if the bytes up to the cut have
one name and the common prefix from there covers the rest. Windows without a cut (runs
of few bytes) are decided by the suffix array of their regions' single bytes.

A minimiser whose kinds of regions come to more than ``crowd`` bytes (a passage that very
many texts share between different neighbours) is too much for one task. Its regions are
split again by the minimisers of longer spans: inside the passage the parts are equal
then, and few differ at its ends. The longest spans are whole strings, which need no
order to be found equal.

Edge cases: null and empty texts are empty; texts shorter than ``length`` lose nothing;
rows repeated in the table repeat each other; rows with null keys take part like others;
a text that is one long run of a byte has a region for each ``RUN`` windows; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared
from twinscope.llm.suffix_array import suffix_array

TOP = np.uint64(0xFFFFFFFF00000000)
LOOK = 4
#: Bytes of regions that are sorted together.
SORT_BYTES = 128 << 10
#: Windows of one region at most; longer runs of one minimiser are cut, which splits no window.
RUN = 4096


def minimisers(data: np.ndarray, rows: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, gram hash, region hashes, again) of the regions of
    a piece of texts; windows count within their row, a region has two hashes, and again
    says that it holds its minimiser more than once."""
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.int64), np.zeros(0, bool))
    if len(data) < length:
        return none
    spans = shared.Spans(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans.of(at, at + gram)
    # 32 bits of hash, then the position: the least is the leftmost of the least hashes.
    value = (grams & TOP) | at.astype(np.uint64)
    wide, reach = length - gram + 1, 1
    least = value
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    row = np.searchsorted(rows, np.arange(len(least)), side="right") - 1
    whole = np.arange(len(least)) + length <= rows[row + 1]
    where = (least & ~TOP).astype(np.int64)
    start = np.flatnonzero(whole)
    if not len(start):
        return none
    row, where = row[start], where[start]
    least = grams[where]
    fresh = np.append(True, (row[1:] != row[:-1]) | (least[1:] != least[:-1]))
    head = start[np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))]
    fresh |= (start - head) % RUN == 0
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, of = start[first], start[last], row[first]
    raw = data.tobytes()
    again = where[first] != where[last]
    return of, lo - rows[of], hi - rows[of], least[first], _hashes([raw[a:b] for a, b in zip(lo.tolist(), (hi + length).tolist())]), again


def _hashes(texts: list[bytes]) -> np.ndarray:
    """128 bits of hash of each text, as two signed numbers."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join([xxh3_128_digest(t) for t in texts]), np.int64).reshape(-1, 2)


def neighbours(symbols: list[int], sizes: list[int], pieces: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes): in bytes, of each suffix with the one before it in
    the order, ``most`` at most. A symbol s > 0 stands for pieces[s - 1], of whose bytes
    ``sizes`` says how many lie before the next symbol; 0 stands for none."""
    order = suffix_array(symbols)
    n = len(symbols)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    to = np.append(0, np.cumsum(np.array(sizes, np.int64))).tolist()
    common = np.zeros(n, np.int64)
    h = 0
    for i in range(n):
        if rank[i] == 0:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < n and j + h < n and symbols[i + h] == symbols[j + h]:
            h += 1
        length = to[i + h] - to[i]
        if length < most and i + h < n and j + h < n and symbols[i + h] and symbols[j + h]:
            p, q = pieces[symbols[i + h] - 1], pieces[symbols[j + h] - 1]
            k, end = 0, min(len(p), len(q))
            while k < end and p[k] == q[k]:
                k += 1
            length += k
        common[rank[i]] = min(length, most)
        if h:
            h -= 1
    return np.array(order, np.int64), common


def _same(name: np.ndarray, rank: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Which of the windows in the order of (name, rank) equal a neighbour: one name, and
    one class, which changes where a common prefix is too short."""
    order = np.lexsort((rank, name))
    n, c = name[order], cls[rank[order]]
    same = (n[1:] == n[:-1]) & (c[1:] == c[:-1])
    hit = np.zeros(len(order), bool)
    hit[order[np.append(same, False) | np.append(False, same)]] = True
    return hit


def repeated(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(region, window) of each window that equals another one; ``texts[i]`` holds the
    ``windows[i]`` windows of region i."""
    raw = b"".join(texts)
    data = np.frombuffer(raw, np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size) - size
    region = np.repeat(np.arange(len(texts)), size)
    end = (start + size)[region]
    at = np.arange(len(data))
    # Cuts: places whose next bytes, all inside the region, hash to zero.
    ahead = np.zeros(len(data), np.uint64)
    for k in range(LOOK):
        ahead[: len(data) - k] = ahead[: len(data) - k] * np.uint64(257) + data[k:].astype(np.uint64)
    cuts = np.flatnonzero((shared.mix(ahead + np.uint64(1)) & np.uint64(31) == 0) & (at + LOOK <= end))
    # The next cut of each byte, in its region, and how far it is (-1: none).
    k = np.searchsorted(cuts, at)
    far = np.append(cuts, len(data))[k] - at
    far[np.append(region[cuts], -1)[k] != region] = -1
    is_window = at - start[region] < windows[region]
    hit = np.zeros(len(data), bool)
    if len(cuts):
        of = region[cuts]
        alone = np.append(of[1:] != of[:-1], True)
        stop = np.where(alone, end[cuts], np.append(cuts[1:], 0) + LOOK)
        pieces = [raw[a:b] for a, b in zip(cuts.tolist(), stop.tolist())]
        kinds = sorted(set(pieces))
        rank_of = {p: i + 1 for i, p in enumerate(kinds)}
        # Symbols of all regions in a row, a zero after each region.
        place = np.arange(len(cuts)) + np.cumsum(alone) - alone
        symbols, sizes = np.zeros(len(cuts) + int(alone.sum()), np.int64), np.zeros(len(cuts) + int(alone.sum()), np.int64)
        symbols[place] = [rank_of[p] for p in pieces]
        sizes[place] = np.where(alone, stop, np.append(cuts[1:], 0)) - cuts
        order, common = neighbours(symbols.tolist(), sizes.tolist(), kinds, length)
        rank = np.zeros(len(symbols), np.int64)
        rank[order] = np.arange(len(order))
        rank = rank[place]
        # Away from the cuts: a byte and the name of what follows it, up to the cut, make a name in their order.
        name = np.zeros(len(data), np.int64)
        by_far = np.argsort(far, kind="stable")
        edge = np.searchsorted(far[by_far], np.arange(length - LOOK + 2))
        for d in range(length - LOOK + 1):
            q = by_far[edge[d] : edge[d + 1]]
            if not len(q):
                break
            if d:
                code = data[q].astype(np.int64) * (len(data) + 1) + name[q + 1]
                name[q] = np.unique(code, return_inverse=True)[1]
            q = q[is_window[q]]
            if len(q) > 1:
                hit[q] = _same(name[q], rank[k[q]], np.cumsum(common < length - d))
    # Windows without a cut that their bytes decide.
    bare = is_window & ((far < 0) | (far > length - LOOK))
    if bare.any():
        own = np.unique(region[bare])
        symbols, places = [], {}
        for r in own.tolist():
            places[r] = len(symbols)
            symbols += [b + 1 for b in texts[r]]
            symbols.append(0)
        order, common = neighbours(symbols, [1 if x else 0 for x in symbols], [bytes([b]) for b in range(256)], length)
        rank = np.zeros(len(symbols), np.int64)
        rank[order] = np.arange(len(order))
        q = np.flatnonzero(bare)
        at_byte = np.array([places[r] for r in region[q].tolist()], np.int64) + q - start[region[q]]
        hit[q] = _same(np.zeros(len(q), np.int64), rank[at_byte], np.cumsum(common < length))
    found = np.flatnonzero(hit)
    return region[found], found - start[region[found]]


def _regions(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The regions of ``rows`` (name, th, base, raw); windows count from ``base`` on, and
    equal regions have equal r and s: or equal windows, if a span is a whole string."""
    kind = rows.schema["name"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["name", "th", "base", "lo", "hi", "g", "r", "s", "again"]
        for batch in batches:
            for lo, hi, data, at in shared.text_steps(batch.column(3)):
                row, first, last, g, same, again = minimisers(data, at, length, gram)
                if not len(row):
                    continue
                take = pa.array(row + lo)
                base = batch.column(2).take(take).to_numpy()
                if gram == length:
                    raw = data.tobytes()
                    same = _hashes([raw[x : x + length] for x in (at[row] + first).tolist()])
                columns = [base + first, base + last, g.view(np.int64), same[:, 0], same[:, 1], again]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(take) for i in range(3)], *[pa.array(c) for c in columns]], names)

    return rows.mapInArrow(work, f"name {kind}, th long, base long, lo long, hi long, g long, r long, s long, again boolean")


def _pieces(rows: DataFrame, wanted: DataFrame, length: int, small: int) -> DataFrame:
    """(name, th, base, raw, g, crowded) for the ``wanted`` regions of ``rows``: base is a
    region's first window and raw its bytes."""
    kind = rows.schema["name"].dataType.simpleString()
    by_row = wanted.groupBy("name", "th", "base").agg(F.collect_list(F.struct("lo", "hi", "g", "crowded")).alias("want"))
    by_row = shared.if_small(by_row, rows=wanted.count(), most=small) if small else by_row
    a, b = rows.alias("a"), by_row.alias("b")
    same = F.col("a.name").eqNullSafe(F.col("b.name")) & (F.col("a.th") == F.col("b.th")) & (F.col("a.base") == F.col("b.base"))
    # Rows repeated with the same name and text are one here: any of them has the region.
    fetched = a.join(b, same).select("a.name", "a.th", "a.base", "a.raw", "b.want")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["name", "th", "base", "raw", "g", "crowded"]
        for batch in batches:
            for i in range(batch.num_rows):
                raw, base = batch.column(3)[i].as_buffer().to_pybytes(), batch.column(2)[i].as_py()
                want = batch.column(4)[i].as_py()
                take = pa.array([i] * len(want), pa.int64())
                texts = [raw[x["lo"] - base : x["hi"] - base + length] for x in want]
                columns = [([x["lo"] for x in want], pa.int64()), (texts, pa.binary()), ([x["g"] for x in want], pa.int64()), ([x["crowded"] for x in want], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, t) for c, t in columns]], names)

    return fetched.mapInArrow(cut, f"name {kind}, th long, base long, raw binary, g long, crowded boolean")


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """(name, th, lo, hi): the ranges of windows of ``pieces`` that equal others with their g."""
    kind = pieces.schema["name"].dataType.simpleString()
    parts = shared.parts_for(pieces.sparkSession, 0, 1)
    dealt = pieces.select("name", "th", "base", "raw", "g").repartition(parts, "g").sortWithinPartitions("g")

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []  # (name, th, base, raw, g) up to a border between groups
        waiting, name_type = 0, pa.null()

        def solve(items: list):
            name, th, base, texts, _ = zip(*items)
            which, w = repeated(list(texts), np.array([len(t) - length + 1 for t in texts], np.int64), length)
            edge = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (w[1:] != w[:-1] + 1))) if len(which) else which
            last = np.append(edge[1:], len(which)) - 1 if len(which) else which
            shared.trim()
            of = which[edge].tolist()
            first = np.array(base, np.int64)[which[edge]]
            columns = [pa.array([name[i] for i in of], name_type), pa.array([th[i] for i in of], pa.int64()), pa.array(first + w[edge]), pa.array(first + w[last])]
            return pa.RecordBatch.from_arrays(columns, ["name", "th", "lo", "hi"])

        for batch in batches:
            name_type = batch.column(0).type
            for item in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if waiting >= SORT_BYTES and held[-1][4] != item[4]:
                    yield solve(held)
                    held, waiting = [], 0
                held.append(item)
                waiting += len(item[3])
        if held:
            yield solve(held)

    return dealt.mapInArrow(sort, f"name {kind}, th long, lo long, hi long")


def spans_of_repeats(rows: DataFrame, length: int, gram: int, crowd: int, small: int) -> DataFrame:
    """(name, th, lo, hi): ranges of repeated windows in ``rows`` (name, th, base, raw),
    where name and a hash of the text, th, tell rows apart."""
    spread = length - gram
    ranges, sort = [], []
    for depth, span in enumerate((gram, length - spread // 8, length - spread // 64, length)):
        found = shared.stash(_regions(rows, length, span), "regions")
        whole = span == length
        number = F.sum(F.col("hi") - F.col("lo") + 1) if whole else F.count("*")
        kinds = found.groupBy("g", "r", "s").agg(number.alias("n"), F.min(F.struct("name", "th", "base", "lo", "hi")).alias("one"), F.max("again").alias("again"))
        if not whole:
            size = F.sum(F.col("one.hi") - F.col("one.lo") + length)
            # Both sides of the join are written first, so that Spark can split what a common minimiser fills.
            kinds = shared.stash(kinds, "all-kinds")
            sizes = kinds.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), size.alias("bytes"), F.max("again").alias("self")).where("total > 1 or self")
            kinds = kinds.join(shared.stash(sizes, "minimisers"), "g")
        kinds = shared.stash(kinds, "region-kinds")
        equal = kinds.where("n > 1").select("g", "r", "s")
        ranges.append(found.join(equal, ["g", "r", "s"]).select("name", "th", "lo", "hi"))
        if whole:
            break
        # One region of each kind, where there are more kinds or it may repeat itself: fetched as text by the row that has it.
        wanted = kinds.where("kinds > 1 or (again and n = 1)").select("one.*", "g", (F.col("bytes") > crowd).alias("crowded"))
        pieces = shared.stash(_pieces(rows, wanted, length, small if depth == 0 else 0), "region-texts")
        shared.free_shuffles(rows.sparkSession)
        sort.append(pieces.where("not crowded"))
        rows = pieces.where("crowded").select("name", "th", "base", "raw")
        if rows.isEmpty():
            break
    todo = sort[0]
    for more in sort[1:]:
        todo = todo.unionByName(more)
    out = shared.stash(_sorted(todo, length), "repeated-windows")
    for more in ranges:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 400, gram: int = 64, crowd: int = 384 << 10, keep: tuple[str, ...] = (), as_text: bool = False, small: int = 0) -> DataFrame:
    """(key, n_bytes, spans, kept, and the columns named in ``keep``) for every row: the
    UTF-8 bytes of its text, the maximal runs of removed bytes as (start, end), and the
    bytes that stay; with ``as_text`` as a string, without characters that a cut left
    incomplete. Where few rows repeat anything, ``small`` says up to how many bytes the
    lists of regions and of repeats are broadcast rather than texts shuffled."""
    if gram >= length:
        raise ValueError("gram must be shorter than length")
    shared.text_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("name"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.lit(0).cast("long").alias("base"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    repeats = spans_of_repeats(rows, length, gram, crowd, small)
    kind = rows.schema["name"].dataType.simpleString()
    shared.free_shuffles(docs.sparkSession)
    by_row = repeats.groupBy("name", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    by_row = shared.stash(by_row, "repeats-by-row")
    shared.free_shuffles(docs.sparkSession)
    rows = docs.select(F.col(key).alias("name"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    if small:
        runs = by_row.agg(F.sum(F.size("runs")), F.count("*")).first()
        by_row = shared.if_small(by_row, rows=(runs[0] or 0) + runs[1], most=small)
    a, b = rows.alias("a"), by_row.alias("b")
    joined = a.join(b, F.col("a.name").eqNullSafe(F.col("b.name")) & (F.col("a.th") == F.col("b.th")), "left").select("a.name", "a.raw", "b.runs", *[f"a.keep_{i}" for i in range(len(keep))])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for raw, runs in zip(batch.column(1), batch.column(2)):
                data = raw.as_buffer().to_pybytes()
                gone: list[dict] = []
                for r in sorted((x["lo"], x["hi"]) for x in runs.as_py() or ()):
                    if gone and r[0] <= gone[-1]["end"]:
                        gone[-1]["end"] = max(gone[-1]["end"], r[1] + length)
                    else:
                        gone.append({"start": r[0], "end": r[1] + length})
                edge = [0, *[e for g in gone for e in (g["start"], g["end"])], len(data)]
                n_bytes.append(len(data))
                spans.append(gone)
                stay = b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2]))
                kept.append(stay.decode(errors="ignore") if as_text else stay)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, pair), pa.array(kept, pa.string() if as_text else pa.binary()), *[batch.column(i) for i in range(3, batch.num_columns)]], ["name", "n_bytes", "spans", "kept", *[f"keep_{i}" for i in range(len(keep))]])

    extra = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = joined.mapInArrow(cut, f"name {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}{extra}")
    return out.select(F.col("name").alias(key), "n_bytes", "spans", "kept", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])
