"""WARC archives: written and read through Spark's own files, so any store that Spark
knows will do.

Writing: a record a row, as text lines that end with the blank line which ends a record.
A payload of ``min_bytes`` or more that another row has too is stored once, with the row
of the smallest id; the others become revisit records that refer to it.

Reading: tasks take any splits of the files and find each place that looks like a record
header and the offset of its successor, which its Content-Length tells. They follow the
successors to where they leave the split, and emit that offset for each candidate. A
candidate can only be where a chain enters a split if another chain leaves to it, so few
are left; per file, pointer jumping from offset 0 over those marks the true entry of each
split. Headers that are only text inside a payload are on no chain from there. Rows stay
in their splits: a second pass starts at each split's entry and puts records together,
one in memory at a time; only the pieces of records that cross into the next split, one
record a split, are exchanged.

Edge cases: a null text is an empty payload; control characters in URLs are dropped; rows
with a null id are written with an empty one and read back as null; equal payloads of
rows with equal ids are all responses; an archive that is cut off yields the records
before the cut; an empty table yields no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope.llm import shared

END = "\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_FIELD = re.compile(rb"([!#-'*+\-.^-z|~0-9A-Z]+):[ \t]*([^\r\n]*)(?:\r\n|$)")
URN = "urn:twinscope:page:"
#: A split's mark when broadcast, and what all marks may come to: 160,000 splits, some 20 TB.
MARK_BYTES, MARKS_BYTES = 400, 64 << 20


def with_references(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """``pages`` with payload_digest, payload_bytes, and refers_to: the smallest key of
    the rows with an equal payload, where that is another row's."""
    known = pages.withColumns({
        payload: F.coalesce(F.col(payload), F.lit("")),
    }).withColumns({"payload_digest": F.sha2(F.encode(payload, "UTF-8"), 256), "payload_bytes": F.octet_length(payload).cast("long")})
    shared_by = known.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min(key).alias("_first")).where("_n > 1").drop("_n")
    # Written first: the join then knows its size, and splits a digest that very many rows have.
    joined = known.join(shared.if_small(shared.stash(shared_by, "shared-payloads"), row_bytes=120), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("_first").eqNullSafe(F.col(key)), F.col("_first"))).drop("_first")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100, compression: str = "gzip") -> None:
    """Write one record for each row of ``pages`` to WARC files in the folder ``path``."""
    rows = with_references(pages.select(key, url, payload), key, payload, min_bytes)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col(payload)))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", page(F.col(key))),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace(F.col(url), r"[\x00-\x20\x7f]", ""), F.lit(""))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", page(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("_block", block).select(F.concat(head, F.col("_block")).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).text(path)


def _header(data: bytes, at: int, end: int) -> dict[bytes, bytes] | None:
    """The fields of a header whose fields start at ``at`` and that ends at ``end``."""
    fields: dict[bytes, bytes] = {}
    while at < end:
        m = _FIELD.match(data, at, end)
        if m is None:
            return None
        fields[m[1].lower()] = m[2].strip()
        at = m.end()
    return fields if fields.get(b"content-length", b"").isdigit() and b"warc-type" in fields else None


_LOOK = "path string, block long, kind int, at long, exit long"


def leaves(at: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Where the chain from each record (``at`` ascending) leaves those given."""
    n = len(at)
    slot = np.minimum(np.searchsorted(at, succ), n - 1)
    jump = np.where(at[slot] == succ, slot, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return succ[jump]
        jump = further


def _looks(lines: DataFrame) -> DataFrame:
    """For each split a row of kind 1 with its size in ``at``, and for each place in it
    that looks like a header a row of kind 0 with its offset and where the chain of
    successors from it leaves the split. Offsets count from the split's first row."""
    width = len(END)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place, offset = None, 0
        found: list[tuple[int, int]] = []

        def done():
            at, succ = (np.array(x, np.int64) for x in (zip(*found) if found else ((), ())))
            out = leaves(at, succ) if len(at) else succ
            n = len(at) + 1
            columns = [pa.array([place[0]] * n, pa.string()), pa.array([place[1]] * n, pa.int64()), pa.array([1] + [0] * (n - 1), pa.int32()), pa.array(np.append(offset, at)), pa.array(np.append(offset, out))]
            return pa.RecordBatch.from_arrays(columns, ["path", "block", "kind", "at", "exit"])

        for batch in batches:
            paths, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi, data, rows in shared.text_steps(batch.column(2)):
                whole = data.tobytes()
                heads: dict[int, list] = {}
                for m in _MAGIC.finditer(whole):
                    i = int(np.searchsorted(rows, m.start(), side="right")) - 1
                    if (m.start() == rows[i] or whole[m.start() - 1] == 10) and m.end() <= rows[i + 1]:
                        fields = _header(whole, m.end(), int(rows[i + 1]))
                        if fields is not None:
                            heads.setdefault(i, []).append((m.start() - int(rows[i]), int(fields[b"content-length"])))
                for i in range(hi - lo):
                    here = (paths[lo + i], blocks[lo + i])
                    if here != place:
                        if place is not None:
                            yield done()
                        place, offset, found = here, 0, []
                    size = int(rows[i + 1] - rows[i])
                    for at, length in heads.get(i, ()):
                        found.append((offset + at, offset + size + width + length + width))
                    offset += size + width
        if place is not None:
            yield done()

    return lines.mapInArrow(work, _LOOK)


def reachable(at: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """Which records (``at`` ascending and distinct) the chain from offset 0 reaches."""
    n = len(at)
    slot = np.minimum(np.searchsorted(at, succ), max(0, n - 1))
    jump = np.where(at[slot] == succ, slot, -1) if n else slot
    seen = at == 0
    for _ in range(max(1, n).bit_length() + 1):
        more = jump[seen]
        seen[more[more >= 0]] = True
        jump = np.where(jump >= 0, jump[jump], -1)
    return seen


def _entries(looks: DataFrame) -> DataFrame:
    """For each split (path, block): its base, the offset of its first row in the file;
    its entry, where the first verified record starts in it; and how many of its first
    bytes are owed to a record that starts before it, named by where that one ends."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = looks.where("kind = 1").select("path", "block", F.col("at").alias("size")).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    splits = shared.stash(splits, "warc-splits")
    n = splits.count()
    heads = looks.where("kind = 0").join(shared.if_small(splits.select("path", "block", "base"), 200, n), ["path", "block"])
    heads = heads.select("path", "block", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("exit"))
    exits = heads.select("path", F.col("exit").alias("at")).unionByName(splits.select("path", F.lit(0).cast("long").alias("at"))).distinct()
    entered = heads.join(exits, ["path", "at"], "left_semi")
    both = splits.select("path", "block", "base", "size", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("exit"))
    both = both.unionByName(entered, allowMissingColumns=True)

    def chain(pdf):
        own = pdf[pdf["at"].isna()].sort_values("block")
        base, size = own["base"].to_numpy(np.int64), own["size"].to_numpy(np.int64)
        heads = pdf[pdf["at"].notna()]
        at, order = np.unique(heads["at"].to_numpy(np.int64), return_index=True)
        exit_ = heads["exit"].to_numpy(np.int64)[order]
        seen = reachable(at, exit_)
        at, exit_ = at[seen], exit_[seen]
        first = np.searchsorted(at, base)
        inside = first < len(at)
        inside[inside] = at[first[inside]] < (base + size)[inside]
        entry = np.full(len(base), -1)
        entry[inside] = at[first[inside]] - base[inside]
        ends = np.where(first > 0, exit_[np.maximum(first, 1) - 1], 0) if len(at) else np.zeros(len(base), np.int64)
        owed = np.clip(ends - base, 0, size)
        return pdf.__class__({"path": own["path"].to_numpy(), "block": own["block"].to_numpy(), "base": base, "entry": entry, "owed": owed, "owner": ends, "exit": np.where(inside, exit_[np.minimum(first, len(at) - 1)] if len(at) else 0, 0), "size": size})

    found = both.groupBy("path").applyInPandas(chain, "path string, block long, base long, entry long, owed long, owner long, exit long, size long")
    return shared.stash(found, "warc-entries")


_NAMES = ["file", "id", "record_type", "refers_to", "digest", "payload", "payload_bytes"]
_RECORD = "file string, id string, record_type string, refers_to string, digest string, payload binary, payload_bytes long"
_PIECE = "file string, owner long, block long, at long, id string, record_type string, refers_to string, digest string, length long, value binary"


def _finished(file: str, said: tuple, length: int, got: list[bytes]) -> tuple:
    """The row of a record with fields (id, type, refers, digest) and these bytes."""
    head, _, payload = b"".join(got)[:length].partition(END.encode())
    revisit = said[1] == "revisit"
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
    return (file, *said, None if revisit else payload, int(size[1]) if revisit and size else len(payload))


def _record_batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [*[pa.string()] * 5, pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _NAMES)


def _build(lines: DataFrame, crossing: bool) -> DataFrame:
    """The records that lie within one split; with ``crossing`` instead the pieces of those
    that do not. ``lines``: path, block, value, base, entry, owed, owner, in file order."""
    width, sep = len(END), END.encode()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 4, pa.int64(), pa.binary()]
        names = [x.split()[0] for x in _PIECE.split(", ")]
        place, offset, expected, base = None, 0, -1, 0
        record, got, need = None, [], 0  # (fields, length, start), the bytes so far, and how many are missing

        def left_over() -> list[tuple]:
            if record is None or not crossing:
                return []
            return [(place[0], base + expected, place[1], record[2], *record[0], record[1], b"".join(got))]

        def pieces(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for path, block, value, base_, entry, owed, owner in zip(*columns):
                if (path, block) != place:
                    out += left_over()
                    place, offset, expected, base, record = (path, block), 0, entry, base_, None
                size = len(value)
                if record is not None:
                    got += (value, sep)
                    need -= size + width
                    if need <= 0:
                        if not crossing:
                            out.append(_finished(path, record[0], record[1], got))
                        record = None
                elif offset <= expected < offset + size:
                    m = _MAGIC.match(value, expected - offset)
                    f = _header(value, m.end(), size)
                    length = int(f[b"content-length"])
                    said = tuple(f[k].decode(errors="replace") if k in f else None for k in (b"warc-record-id", b"warc-type", b"warc-refers-to", b"warc-payload-digest"))
                    record, got, need = (said, length, offset), [], length
                    expected = offset + size + width + length + width
                if crossing and offset < owed:
                    out.append((path, owner, block, offset, *[None] * 5, value + sep))
                offset += size + width
            if out:
                yield pieces(out) if crossing else _record_batch(out)
        if out := left_over():
            yield pieces(out)

    return lines.mapInArrow(work, _PIECE if crossing else _RECORD)


def _joined(pieces: DataFrame) -> DataFrame:
    """The records whose pieces are all there."""

    def work(batches: Iterator) -> Iterator:
        whose, said, length, got = None, None, 0, []

        def done() -> list[tuple]:
            return [_finished(whose[0], said, length, got)] if said is not None and sum(map(len, got)) >= length else []

        for batch in batches:
            out: list[tuple] = []
            for file, owner, _, _, id_, type_, refers, digest, n, value in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
                if (file, owner) != whose:
                    out += done()
                    whose, said, length, got = (file, owner), None, 0, []
                if n is not None:
                    said, length = (id_, type_, refers, digest), n
                got.append(value)
            if out:
                yield _record_batch(out)
        if out := done():
            yield _record_batch(out)

    return pieces.repartition("file", "owner").sortWithinPartitions("file", "owner", "block", "at").mapInArrow(work, _RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in the folder ``path``: file, id, record_type,
    refers_to (ids as written), digest, payload (null for revisits) and payload_bytes."""
    shared.text_batches(spark)
    text = spark.read.option("lineSep", END).text(path)
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    entries = _entries(shared.stash(_looks(lines), "warc-looks"))
    splits = entries.count()
    marks = entries.select("path", "block", "base", "entry", "owed", "owner")
    small = splits * MARK_BYTES <= MARKS_BYTES
    # Beyond the bound rows are sent to where the mark of their split is, and put in order there.
    numbered = lines if small else lines.withColumn("_at", F.monotonically_increasing_id())
    marked = numbered.join(F.broadcast(marks) if small else marks.hint("merge"), ["path", "block"])
    if not small:
        marked = marked.sortWithinPartitions("path", "block", "_at")
    marked = marked.select("path", "block", "value", "base", "entry", "owed", "owner")
    records = _build(marked, crossing=False)
    if entries.where("owed > 0").isEmpty():
        return records
    return records.unionByName(_joined(_build(marked, crossing=True)))
