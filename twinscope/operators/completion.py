"""Entities that are known without their data: floats and strings are read from memory.

``memory`` has a row for each section: img, section_id, start, size (virtual), data (the
bytes that the file has; what is beyond them reads as zero).
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import entity, names
from twinscope.operators import joins, store
from twinscope.operators.store import State

#: Why a value could not be read.
READ_FAILED, DECODE_FAILED = "READ_FAILED", "DECODE_FAILED"


def uninitialised_ranges(headers: DataFrame) -> DataFrame:
    """(start, stop) of what a file leaves uninitialised: whole sections that say so, and
    of others what lies beyond the bytes that the file has. ``headers``: start,
    virtual_size, raw_size, uninitialised."""
    start = F.when(F.col("uninitialised"), F.col("start")).otherwise(F.col("start") + F.col("raw_size"))
    return headers.where(F.col("uninitialised") | (F.col("virtual_size") > F.col("raw_size"))).select(start.alias("start"), (F.col("start") + F.col("virtual_size")).alias("stop"))


def in_ranges(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Probes (addr) with whether a range holds them; ranges do not overlap."""
    sized = ranges.select("start", (F.col("stop") - F.col("start")).alias("size"))
    held = joins.interval_join(probes, sized, "addr")
    return held.select(*probes.columns, F.col("base").isNotNull().alias("inside"))


def floats_without_data(entities: DataFrame, img: int) -> DataFrame:
    """(addr, is_double) of floats of known size without a value."""
    size = entity.any_size(img)
    rows = entities.where((F.col("img") == img) & (F.col("type") == schema.FLOAT) & F.col("name").isNull() & size.isin(4, 8))
    return rows.select("addr", (size == 8).alias("is_double"))


def strings_without_data(entities: DataFrame, img: int) -> DataFrame:
    """(addr, size, is_wide) of strings without a text; a null size goes up to the NUL."""
    rows = entities.where((F.col("img") == img) & F.col("type").isin(schema.STRING, schema.WIDECHAR) & F.col("name").isNull())
    return rows.select("addr", entity.size(img).alias("size"), (F.col("type") == schema.WIDECHAR).alias("is_wide"))


_VALUES = "addr long, kind string, number string, text string, size long, error string"


def read_values(wanted: DataFrame, memory: DataFrame, encoding: str = "latin1") -> DataFrame:
    """The values at ``wanted`` (addr, kind, size; kind float, double, string or wide) in the
    sections of one image. A section's bytes meet its addresses once, in one task."""
    ranges = memory.select("section_id", "start", F.col("size").alias("length"))
    held = joins.interval_join(wanted, ranges, "addr", start="start", size="length", columns=("section_id",)).select("addr", "kind", "size", F.coalesce("section_id", F.lit(-1)).alias("section_id"))

    def work(key, rows: pd.DataFrame, sections: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = None if sections.empty else sections.iloc[0]
        for r in rows.itertuples():
            width = 2 if r.kind == "wide" else 1
            text = number = error = None
            size = None if pd.isna(r.size) else int(r.size)
            if r.kind in ("float", "double"):
                size = 8 if r.kind == "double" else 4
            if known is None:
                out.append((r.addr, r.kind, None, None, size, READ_FAILED))
                continue
            data, at, end = bytes(known["data"] or b""), int(r.addr - known["start"]), int(known["size"])
            if size is None:  # up to the terminator, which must be in the section
                stop = at
                while stop + width <= end and any(data[stop : stop + width]):
                    stop += width
                size = stop + width - at if stop + width <= end else None
            if size is None or at + size > end:
                out.append((r.addr, r.kind, None, None, size, READ_FAILED))
                continue
            raw = data[at : at + size].ljust(size, b"\0")
            if r.kind in ("float", "double"):
                number = str(struct.unpack("<d" if r.kind == "double" else "<f", raw)[0])
            else:
                try:
                    text = raw[: max(0, size - width)].decode("utf-16-le" if r.kind == "wide" else encoding)
                except UnicodeDecodeError:
                    error = DECODE_FAILED
            out.append((r.addr, r.kind, number, text, size, error))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _VALUES.split(", ")])

    return held.groupBy("section_id").cogroup(memory.select("section_id", "start", "size", "data").groupBy("section_id")).applyInPandas(work, _VALUES).where("addr is not null")


def complete(state: State, memory: DataFrame, img: int, encoding: str = "latin1") -> State:
    """``state`` with the values of floats and the texts and sizes of strings that were
    known without; what cannot be read is reported."""
    own = memory.where(F.col("img") == img)
    number = floats_without_data(state.entities, img).select("addr", F.when(F.col("is_double"), "double").otherwise("float").alias("kind"), F.lit(None).cast("long").alias("size"))
    text = strings_without_data(state.entities, img).select("addr", F.when(F.col("is_wide"), "wide").otherwise("string").alias("kind"), "size")
    found = read_values(number.unionByName(text), own, encoding)
    is_text = F.col("kind").isin("string", "wide")
    size = "orig_size" if img == schema.ORIG else "recomp_size"
    name = F.when(is_text, names.quoted(F.col("text"), F.col("kind") == "wide")).otherwise(F.col("number"))
    done = found.where("error is null").select("addr", name.alias("_name"), F.col("size").alias("_size"), is_text.alias("_text"))
    change = store.delta(done, {"name": F.col("_name"), size: F.col("_size")}, img, when={"name": F.lit(True), size: F.col("_text")})
    failed = found.where("error is not null")
    events = failed.select(F.col("error").alias("event"), F.col("addr").alias("orig_addr"), F.concat(F.lit("Cannot read "), "kind").alias("msg"))
    return state.upsert(change).report(events)


def members_in_order(members: DataFrame, by: str) -> DataFrame:
    """Members by offset, those at one offset as they were declared."""
    return members.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("offset", "ordinal")) - 1)

