"""Memory layouts of types: resolving, flattening, and padding.

Types nest as deep as code nests them, so recursion is a join on the table of type
records for each level until none is left; the table is small next to what is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinscope.operators import joins, lineage

#: Primitive types below this key.
FIRST_RECORD = 0x1000
#: Modes of pointers to primitive types, with the size of the pointer.
_POINTERS = {0x100: 2, 0x200: 4, 0x300: 4, 0x400: 4, 0x500: 6, 0x600: 8}
#: A pointer type without a size, in each mode.
_CREATED = 0xF0

# Keys of primitive types, with size and whether they are signed.
PRIMITIVES = {
    0x10: (1, True), 0x11: (2, True), 0x12: (4, True), 0x13: (8, True), 0x14: (16, False), 0x20: (1, False), 0x21: (2, False), 0x22: (4, False), 0x23: (8, False), 0x24: (16, False),
    0x30: (1, False), 0x31: (2, False), 0x32: (4, False), 0x33: (8, False), 0x40: (4, True), 0x41: (8, True), 0x42: (10, False), 0x43: (16, False), 0x44: (6, False), 0x45: (4, False), 0x46: (2, False),
    0x50: (4, False), 0x51: (8, False), 0x52: (10, False), 0x53: (16, False), 0x68: (1, True), 0x69: (1, False), 0x70: (1, True), 0x71: (2, False), 0x72: (2, True), 0x73: (2, False), 0x74: (4, True), 0x75: (4, False),
    0x76: (8, True), 0x77: (8, False), 0x78: (16, False), 0x79: (16, False), 0x7A: (2, False), 0x7B: (4, False), 0x7C: (1, False),
}
#: Those that have no pointers in all modes, or no size.
_SPECIAL = {**dict.fromkeys((0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x60, 0x61), (0, False)), 0x08: (4, False), 0x62: (4, True)}


def primitives(spark) -> DataFrame:
    """(key, size, signed, is_pointer): pointers to primitives have a mode in their key."""
    rows = [(k, size, signed, False) for k, (size, signed) in (PRIMITIVES | _SPECIAL).items()]
    rows += [(mode | k, size, False, True) for mode, size in _POINTERS.items() for k in (0x03, *PRIMITIVES)]
    rows += [(0x408, 4, False, True), (0x608, 8, False, True)]
    rows += [(mode | _CREATED, 0, False, True) for mode in _POINTERS]
    return spark.createDataFrame(rows, "key int, size int, signed boolean, is_pointer boolean")


def resolve(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(key, final): each type followed through modifiers, forward references, enums and
    bit fields to what holds its data. More than ``depth`` steps, or steps in a circle,
    are an error."""
    nxt = F.coalesce("modifies", F.when(F.col("leaf") == "LF_ENUM", F.col("underlying_type")), F.when(F.col("is_forward_ref"), F.col("udt")), F.col("bit_type"))
    step = records.select(F.col("key").alias("final"), nxt.alias("_next")).where("_next is not null and _next <> final")
    at = records.select("key", F.col("key").alias("final"))
    most = records.count() if depth is None else depth
    for _ in range(most + 1):
        moved = lineage.cut(at.join(step, "final", "left"))
        if moved.where("_next is not null").isEmpty():
            return moved.select("key", "final")
        at = moved.select("key", F.coalesce("_next", "final").alias("final"))
    raise ValueError(f"types refer to others over more than {most} steps")


def scalars(records: DataFrame, depth: int | None = None) -> DataFrame:
    """(type_key, offset, size, signed, name, is_pointer) of all primitive parts of each
    class, structure, union and array. Inherited members come with their own offsets;
    of members at one offset the last one counts. An unknown type, more than ``depth``
    levels, or a type within itself is an error."""
    spark = records.sparkSession
    prim = primitives(spark)
    final = resolve(records, depth)
    shape = records.select("key", "leaf", "field_list", "array_type", F.col("size").alias("_size"), "members", "supers")
    lists = shape.where("leaf = 'LF_FIELDLIST'").select(F.col("key").alias("field_list"), F.col("members").alias("_members"), F.col("supers").alias("_supers"))
    own = shape.join(lists, "field_list", "left").select("key", "leaf", "array_type", "_size", F.col("_members").alias("members"), F.col("_supers").alias("supers"))
    at = final.join(own.select(F.col("key").alias("final"), "leaf", "array_type", "_size", "members", "supers"), "final").where(F.col("leaf").isin("LF_CLASS", "LF_STRUCTURE", "LF_UNION", "LF_ARRAY"))
    parts = at.select(F.col("key").alias("type_key"), F.lit(0).alias("offset"), F.lit("").alias("name"), F.col("key").alias("of"))
    sizes = prim.select(F.col("key").alias("of"), F.col("size").alias("_width"), "signed", "is_pointer")
    pointers = records.where("leaf = 'LF_POINTER'").select(F.col("key").alias("of"), F.lit(4).alias("_pw"))
    one = final.withColumnRenamed("key", "of").join(own.withColumnRenamed("key", "final"), "final")
    widths = one.select("of", F.col("_size").alias("_cw"), "leaf", "array_type", "members", "supers", "final")
    done = None
    most = records.count() + 1 if depth is None else depth
    for _ in range(most):
        here = parts.join(final.withColumnRenamed("key", "of"), "of", "left").withColumn("of", F.coalesce("final", "of")).drop("final")
        known = here.join(sizes, "of", "left").join(pointers, "of", "left")
        ready = known.where("_width is not null or _pw is not null").select("type_key", "offset", F.coalesce("_width", "_pw").alias("size"), F.coalesce("signed", F.lit(False)).alias("signed"), "name", F.coalesce("is_pointer", F.lit(True)).alias("is_pointer"))
        done = ready if done is None else done.unionByName(ready)
        rest = known.where("_width is null and _pw is null").select("type_key", "offset", "name", "of").join(widths, "of", "left")
        unknown = rest.where("final is null").select("of").distinct().limit(5).collect()
        if unknown:
            raise ValueError(f"unknown types: {[r.of for r in unknown]}")
        dot = F.when(F.col("name") == "", F.lit("")).otherwise(F.concat("name", F.lit(".")))
        member = rest.select("type_key", F.col("offset").alias("_o"), dot.alias("_d"), F.explode("members").alias("m")).select("type_key", (F.col("_o") + F.col("m.offset")).alias("offset"), F.concat("_d", "m.name").alias("name"), F.col("m.type").alias("of"))
        base = rest.select("type_key", "offset", "name", F.explode("supers").alias("s")).select("type_key", "offset", "name", F.col("s.type").alias("of"))
        arrays = rest.where("leaf = 'LF_ARRAY'").select("type_key", "offset", "name", F.col("array_type").alias("of"), F.col("_cw").alias("_total"))
        element = arrays.join(final.withColumnRenamed("key", "of"), "of", "left").withColumn("of", F.coalesce("final", "of")).drop("final").join(sizes.select("of", "_width"), "of", "left").join(pointers, "of", "left").join(widths.select("of", F.col("_cw"), "final"), "of", "left")
        unknown = element.where("_width is null and _pw is null and final is null").select("of").distinct().limit(5).collect()
        if unknown:
            raise ValueError(f"unknown types: {[r.of for r in unknown]}")
        element = element.withColumn("_step", F.coalesce("_width", "_pw", "_cw").cast("int")).where("_step > 0 and _total >= _step")
        element = element.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_total") / F.col("_step")).cast("int") - 1)))
        element = element.select("type_key", (F.col("offset") + F.col("_k") * F.col("_step")).alias("offset"), F.concat("name", F.lit("["), F.col("_k").cast("string"), F.lit("]")).alias("name"), "of")
        # Types nest a few levels deep: each level is written once and read by the next.
        parts = lineage.cut(member.unionByName(base).unionByName(element))
        if parts.isEmpty():
            return last_at_offset(done)
    raise ValueError(f"types nest over more than {most} levels")


def last_at_offset(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("type_key", "offset").orderBy(F.desc("name"))
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_overlaps(found: DataFrame) -> DataFrame:
    """Scalars that do not start inside an earlier kept one, the larger of those at one
    offset first: one fold over each type's scalars, in order."""
    each = F.struct(F.col("offset").alias("offset"), (-F.col("size")).alias("neg"), "size", "signed", "name", "is_pointer")
    keep = F.aggregate(
        F.col("_all"),
        F.struct(F.lit(0).cast("int").alias("end"), F.slice("_all", 1, 0).alias("kept")),
        lambda s, x: F.when(x["offset"] >= s["end"], F.struct((x["offset"] + x["size"]).cast("int").alias("end"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    all_ = found.withColumns({"offset": F.col("offset").cast("int"), "size": F.col("size").cast("int")}).groupBy("type_key").agg(F.array_sort(F.collect_list(each)).alias("_all"))
    return all_.select("type_key", F.explode(keep).alias("x")).select("type_key", "x.offset", "x.size", "x.signed", "x.name", "x.is_pointer")


def padded(found: DataFrame, total: DataFrame) -> DataFrame:
    """Scalars with a one-byte filler for each byte between a scalar and what follows, or
    the type's end (``total``: type_key, type_size)."""
    w = Window.partitionBy("type_key").orderBy("offset")
    after = found.join(total, "type_key", "left").withColumn("_next", F.coalesce(F.lead("offset").over(w), "type_size"))
    end = F.col("offset") + F.col("size")
    gaps = after.where(F.col("_next") > end).select("type_key", F.explode(F.sequence(end.cast("int"), F.col("_next").cast("int") - 1)).alias("offset"), F.lit(1).alias("size"), F.lit(False).alias("signed"), F.lit("(padding)").alias("name"), F.lit(False).alias("is_pointer"))
    return found.unionByName(gaps)


def member_at(members: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (type_key, offset) with the name of the last member at or before them, and
    the distance into it; the first of members at one offset."""
    first = members.groupBy("type_key", "offset").agg(F.min_by("name", "ordinal").alias("member"))
    found = joins.asof_backward(probes.select("type_key", "offset").distinct(), first, "offset", ("type_key",), ("member",))
    return found.select("type_key", "offset", "member", (F.col("offset") - F.col("base")).alias("into"))
