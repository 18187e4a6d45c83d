"""Positional comparison of matched pairs: pointer tables, typed variables, stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec
from twinscope.operators import joins, lineage
from twinscope.operators.store import State


def words(data: Column) -> Column:
    """The little-endian 32-bit words of bytes, as longs; a short tail is left out."""
    n = F.floor(F.octet_length(data) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: codec.little_endian(data, i * 4))).otherwise(F.array().cast("array<bigint>"))


def vtables(tables: DataFrame, entities: DataFrame, key: str = "orig_addr") -> DataFrame:
    """Pointer tables slot by slot. ``tables``: key, orig_slots, recomp_slots;
    ``entities``: orig_addr, recomp_addr, name, merged. A slot is equal if both pointers
    are known and belong to one match. Returns a row for each slot."""
    n = F.least(F.size("orig_slots"), F.size("recomp_slots"))
    slots = tables.select(key, F.posexplode(F.slice(F.arrays_zip("orig_slots", "recomp_slots"), F.lit(1), n)).alias("index", "slot"))
    flat = slots.select(key, "index", F.col("slot.orig_slots").alias("o"), F.col("slot.recomp_slots").alias("r"))
    # Looked up twice: what the table is made from need not be made twice.
    entities = lineage.cut(entities.select("orig_addr", "recomp_addr", "name"))
    by_orig = entities.where("orig_addr is not null").select(F.col("orig_addr").alias("o"), F.struct("orig_addr", "recomp_addr", "name").alias("oe"))
    by_recomp = entities.where("recomp_addr is not null").select(F.col("recomp_addr").alias("r"), F.struct("orig_addr", "recomp_addr", "name").alias("re"))
    found = flat.join(by_orig, "o", "left").join(by_recomp, "r", "left")
    shown = lambda e: F.concat(F.lit("("), F.coalesce(codec.to_hex(F.col(f"{e}.orig_addr")), F.lit("no orig")), F.lit(" / "), F.coalesce(codec.to_hex(F.col(f"{e}.recomp_addr")), F.lit("no recomp")), F.lit(")  :  "), F.coalesce(f"{e}.name", F.lit("None")))
    return found.select(
        key, "index",
        (F.col("oe").isNotNull() & F.col("re").isNotNull() & F.col("oe.recomp_addr").eqNullSafe(F.col("re.recomp_addr"))).alias("equal"),
        F.coalesce(F.when(F.col("oe").isNotNull(), shown("oe")), F.concat(codec.to_hex(F.col("o")), F.lit(" from orig not annotated."))).alias("orig_text"),
        F.when(F.col("re").isNotNull(), shown("re")).otherwise(F.lit("(no match)")).alias("recomp_text"),
    )


def vtable_ratio(slots: DataFrame, key: str = "orig_addr") -> DataFrame:
    return slots.groupBy(key).agg(F.avg(F.col("equal").cast("double")).alias("ratio"), F.count("*").alias("n_slots"), F.count_if(~F.col("equal")).alias("problems"))


def oversized_vtables(tables: DataFrame) -> DataFrame:
    """Tables (size, orig_max_size, orig_slots) that run into what follows: longer than
    their room, or with a null pointer inside."""
    return tables.where((F.col("orig_max_size") < F.col("size")) | F.exists("orig_slots", lambda x: x == 0))


def pointers_equal(pairs: DataFrame, state: State, orig: str = "orig_value", recomp: str = "recomp_value") -> DataFrame:
    """``pairs`` with whether both pointers mean the same: both null, a match, or the
    same distance into the two sides of a match."""
    match_of = lambda img, out: state.matches.select(F.lit(img).alias("img"), F.col("orig_addr" if img == schema.ORIG else "recomp_addr").alias("addr"), F.col("orig_addr").alias(out))
    rows = pairs
    for img, column, out in ((schema.ORIG, orig, "o"), (schema.RECOMP, recomp, "r")):
        probes = pairs.select(F.lit(img).alias("img"), F.col(column).alias("addr")).distinct()
        held = joins.asof_backward(probes, state.side(img).join(match_of(img, "_m").drop("img"), "addr", "left").select("img", "addr", "_m"), "addr", ("img",), ("_m",))
        rows = rows.join(held.select(F.col("addr").alias(column), F.col("_m").alias(f"_{out}"), (F.col("addr") - F.col("base")).alias(f"_{out}d")), column, "left")
    same = F.coalesce((F.col("_o") == F.col("_r")) & (F.col("_od") == F.col("_rd")), F.lit(False))
    return rows.withColumn("pointer_equal", ((F.col(orig) == 0) & (F.col(recomp) == 0)) | same).drop("_o", "_r", "_od", "_rd")


def verdicts(items: DataFrame, key: str) -> DataFrame:
    """The verdict of each variable from its compared items (equal, error, raw_only)."""
    per = items.groupBy(key).agg(F.bool_or(F.col("error").isNotNull()).alias("_error"), F.coalesce(F.bool_and("equal"), F.lit(True)).alias("_equal"), F.bool_or("raw_only").alias("_raw"), F.count("*").alias("n_items"), F.count_if(~F.col("equal")).alias("n_different"))
    verdict = F.when(F.col("_error"), "ERROR").when(F.col("_equal"), "MATCH").when(F.col("_raw"), "WARN").otherwise("DIFF")
    return per.select(key, verdict.alias("verdict"), "n_items", "n_different")


def variables(pairs: DataFrame, layout: DataFrame, state: State | None = None) -> DataFrame:
    """Compare variables scalar by scalar.

    ``pairs``: orig_addr, name, data_type, size, orig_block, recomp_block, orig_bss,
    recomp_bss. ``layout``: type_key, offset, size, signed, name, is_pointer. A variable
    whose type has no layout is compared byte by byte. Initialised on one side and
    surely not on the other is a difference whatever the values.
    """
    typed = pairs.join(layout.select(F.col("type_key").alias("data_type"), F.struct("offset", F.col("size").alias("width"), "signed", F.col("name").alias("member"), "is_pointer").alias("f")), "data_type", "left")
    byte = F.transform(F.sequence(F.lit(0), F.greatest(F.col("size"), F.lit(1)).cast("int") - 1), lambda i: F.struct(i.alias("offset"), F.lit(1).alias("width"), F.lit(False).alias("signed"), F.lit("").alias("member"), F.lit(False).alias("is_pointer")))
    raw = typed.where("f is null and size > 0").withColumn("f", F.explode(byte)).withColumn("raw_only", F.lit(True))
    each = typed.where("f is not null").withColumn("raw_only", F.lit(False)).unionByName(raw.select(*typed.columns, "raw_only"))
    value = lambda block: F.reverse(F.substring(F.hex(block), 2 * F.col("f.offset") + 1, 2 * F.col("f.width")))
    number = lambda block: F.coalesce(*[F.when(F.col("f.width") == w, codec.little_endian(F.col(block), F.col("f.offset"), w)) for w in (1, 2, 4)])
    out = each.withColumns({"orig_value": number("orig_block"), "recomp_value": number("recomp_block")})
    equal = value(F.col("orig_block")).eqNullSafe(value(F.col("recomp_block")))
    if state is not None:
        out = pointers_equal(out, state)
        equal = F.when(F.col("f.is_pointer"), F.col("pointer_equal")).otherwise(equal)
    conflict = F.array_sort(F.array("orig_bss", "recomp_bss")) == F.array(F.lit("NO"), F.lit("YES"))
    short = F.octet_length("orig_block") < F.col("size")
    return out.select("orig_addr", "name", "f.offset", F.col("f.member").alias("member"), (equal & ~F.coalesce(conflict, F.lit(False))).alias("equal"), F.when(short, F.lit("block is shorter than the variable")).alias("error"), "raw_only", "orig_value", "recomp_value")


#: An offset from a frame register, as instructions write it: "ebp - 0x8]".
STACK_OFFSET = r"(?<![a-z])e[bs]p [+-] 0x[0-9a-f]+\]"


def _place(found: Column) -> Column:
    """The register and offset in a text as STACK_OFFSET finds it."""
    digits = F.substring(found, F.lit(9), F.length(found) - 9)
    offset = F.conv(digits, 16, 10).cast("long") * F.when(F.substring(found, 5, 1) == "-", -1).otherwise(1)
    return F.struct(F.substring(found, 1, 3).alias("register"), offset.alias("offset"))


def stack_offset(text: Column) -> Column:
    """The frame register and offset that an instruction uses; null if none."""
    found = F.regexp_extract(text, STACK_OFFSET, 0)
    return F.when(found != "", _place(found))


def stack_pairs(blocks: DataFrame, key: str = "orig_addr") -> DataFrame:
    """(key, orig, recomp) distinct pairs of stack offsets at the same place.

    ``blocks``: key, block, orig array<string>, recomp array<string>. A block whose sides
    differ in length, or where one side's instruction has no offset, says nothing. A
    block is decided where it is; only distinct pairs are exchanged.
    """
    usable = blocks.where(F.size("orig") == F.size("recomp"))
    # One search a line; the rest works on what it has found.
    found = lambda c: F.transform(c, lambda x: F.regexp_extract(x, STACK_OFFSET, 0))
    both = usable.select(key, F.arrays_zip(found("orig").alias("o"), found("recomp").alias("r")).alias("z"))
    broken = F.exists("z", lambda x: (x["o"] != "") & (x["r"] == ""))
    none = F.array().cast("array<struct<o:string,r:string>>")
    said = both.select(key, F.explode(F.when(broken, none).otherwise(F.filter("z", lambda x: x["o"] != ""))).alias("x"))
    return said.select(key, _place(F.col("x.o")).alias("orig"), _place(F.col("x.r")).alias("recomp")).distinct()


def structural_mismatches(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.size("orig") != F.size("recomp"))


def partners(pairs: DataFrame, by: tuple[str, ...], side: str, other: str) -> DataFrame:
    """Each value of one side with its distinct partners; a mapping is one to one where
    there is a single partner on both sides."""
    return pairs.groupBy(*by, side).agg(F.count_distinct(other).alias("n_partners"), F.min(other).alias("partner"))
