"""Text dumps of debug symbols, section by section.

A dump is read as numbered lines. Each record type is a filter and a regular expression
in the JVM; where a record needs a heading above it, an as-of join finds that by line
number. Windows run within a module or a function, never over a whole dump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope.functions import codec
from twinscope.operators import joins

# The formats of the lines.
SECTION = r"^\*\*\* ([A-Z][A-Z ]*[A-Z])\s*$"
LINES_HEAD = r"^\s*(.+?) \((?:None|\w+: [0-9A-F]+)\), ([0-9A-F]{4}):([0-9A-F]{8})-([0-9A-F]{8}), line/addr pairs = (\d+)"
LINE_PAIR = r"\s+(\d+) ([0-9A-F]{8})"
PUBLIC = r"^(\w+): \[(\w{4}):(\w{8})\], Flags: (\w{8}), (\S+)"
CONTRIBUTION = r"^\s*(\w{4,})  (\w{4}):(\w{8})  (\w{8})  (\w{8})"
GLOBAL = r"S_([GL])DATA32: \[(\w{4}):(\w{8})\], Type:\s*(\S+), (.+)"
MODULE = r'^(\w{4,})(?: "([^"]+)")?? "([^"]+)"\s*$'
SYMBOL = r"^\(\w+\)\s+([^\s:]+)(?::\s+(\S.*))?"
PROCEDURE = r"\[(\w{4}):(\w{8})\], Cb: (\w+), Type:\s+([^\s,]+), (.+)"
STORED = r"^(\S+), Type:\s+([\w()]+), (.+)$"
LOCAL = r"\[(\w{4}):(\w{8})\], Type:\s*(\S+), (.+)"
LEAF = r"^(0x\w+) : .* (LF_\w+)"
#: Kinds of type records that are read.
LEAVES = ("LF_ARGLIST", "LF_ARRAY", "LF_BITFIELD", "LF_CLASS", "LF_ENUM", "LF_FIELDLIST", "LF_MFUNCTION", "LF_MODIFIER", "LF_POINTER", "LF_PROCEDURE", "LF_STRUCTURE", "LF_UNION")
#: Lines of a dump that one task puts in order.
LINES_TOGETHER = 1 << 16
#: Keys below this are primitive types.
FIRST_RECORD = 0x1000


def part(text: Column | str, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k)


def hex_part(text: Column | str, pattern: str, k: int) -> Column:
    return codec.from_hex(part(text, pattern, k))


def type_key(text: Column) -> Column:
    """The number of a type: 0x1234, or in parentheses after the name of a primitive."""
    inner = F.regexp_extract(text, r"\(([0-9A-Fa-f]+)\)", 1)
    return F.when(text.startswith("0x"), codec.from_hex(text)).when(inner != "", codec.from_hex(inner)).cast("int")


def sections(numbered: DataFrame) -> DataFrame:
    """``numbered`` (line_no, line) with each line's section; headings are left out, and
    what is above the first."""
    is_head = F.col("line").rlike(SECTION)
    heads = numbered.where(is_head).select("line_no", part("line", SECTION, 1).alias("section"))
    return under(numbered.where(~is_head), heads, "section").select(*numbered.columns, "section")


def under(lines: DataFrame, heads: DataFrame, *columns: str) -> DataFrame:
    """Lines with the ``columns`` of the last heading above them and its number, ``base``;
    lines without one are left out."""
    return joins.asof_backward(lines, heads, "line_no", columns=columns, bucket=LINES_TOGETHER).where("base is not null")


def code_lines(lines: DataFrame) -> DataFrame:
    """LINES: (path, line_number, section, offset, seq). Headings name the file and the
    section of the pairs below them."""
    at, is_head = lines.where("section = 'LINES'").select("line_no", "line"), F.col("line").rlike(LINES_HEAD)
    heads = at.where(is_head).select("line_no", part("line", LINES_HEAD, 1).alias("path"), hex_part("line", LINES_HEAD, 2).cast("int").alias("section"))
    rows = under(at.where(~is_head), heads, "path", "section")
    pair = F.arrays_zip(F.regexp_extract_all("line", F.lit(LINE_PAIR), 1).alias("l"), F.regexp_extract_all("line", F.lit(LINE_PAIR), 2).alias("o"))
    each = rows.select("line_no", "path", "section", F.posexplode(pair).alias("_k", "p"))
    return each.select("path", F.col("p.l").cast("int").alias("line_number"), "section", codec.from_hex(F.col("p.o")).alias("offset"), (F.col("line_no") * 1000 + F.col("_k")).alias("seq"))


def publics(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("section") == "PUBLICS") & F.col("line").rlike(PUBLIC))
    return rows.select(part("line", PUBLIC, 1).alias("type"), hex_part("line", PUBLIC, 2).cast("int").alias("section"), hex_part("line", PUBLIC, 3).alias("offset"), hex_part("line", PUBLIC, 4).alias("flags"), part("line", PUBLIC, 5).alias("name"))


def globals_(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("section") == "GLOBALS") & F.col("line").rlike(GLOBAL))
    return rows.select(hex_part("line", GLOBAL, 2).cast("int").alias("section"), hex_part("line", GLOBAL, 3).alias("offset"), type_key(part("line", GLOBAL, 4)).alias("type"), part("line", GLOBAL, 5).alias("name"), (part("line", GLOBAL, 1) == "G").alias("is_global"))


def contributions(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("section") == "SECTION CONTRIBUTIONS") & F.col("line").rlike(CONTRIBUTION))
    return rows.select(*[hex_part("line", CONTRIBUTION, k).alias(n) for k, n in enumerate(("module", "section", "offset", "size"), 1)])


def modules(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("section") == "MODULES") & F.col("line").rlike(MODULE))
    return rows.select(hex_part("line", MODULE, 1).cast("int").alias("id"), F.nullif(part("line", MODULE, 2), F.lit("")).alias("lib"), part("line", MODULE, 3).alias("obj"))


def functions(lines: DataFrame) -> DataFrame:
    """SYMBOLS: functions with what lies inside them: variables in registers and on the
    stack, static variables, and whether there is a frame pointer.

    Blocks nest, so a running count of what opens and closes says where a function ends;
    it starts anew in every module.
    """
    rows = lines.where("section = 'SYMBOLS'").select("line_no", "line", part("line", SYMBOL, 1).alias("kind"), part("line", SYMBOL, 2).alias("rest"))
    heads = rows.where(F.col("line").startswith("** Module")).select("line_no")
    rows = joins.asof_backward(rows, heads, "line_no", bucket=LINES_TOGETHER).withColumn("module", F.coalesce("base", F.lit(-1))).drop("base")
    starts = F.col("kind").isin("S_GPROC32", "S_LPROC32") & F.col("rest").rlike(PROCEDURE)
    of_module = Window.partitionBy("module").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fn", F.last(F.when(starts, F.col("line_no")), ignorenulls=True).over(of_module)).where("fn is not null")
    inside = Window.partitionBy("module", "fn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("module", "fn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.sum(F.when(F.col("kind") == "S_BLOCK32", 1).when(F.col("kind") == "S_END", -1).otherwise(0))
    rows = rows.withColumn("_d", depth.over(inside)).withColumn("closed", F.coalesce(F.min("_d").over(before) < 0, F.lit(False))).where("not closed")
    stored = F.when(F.col("kind").isin("S_BPREL32", "S_REGISTER") & F.col("rest").rlike(STORED), F.struct("line_no", F.col("kind").alias("symbol_type"), F.lower(part("rest", STORED, 1)).alias("location"), type_key(part("rest", STORED, 2)).alias("data_type"), part("rest", STORED, 3).alias("name")))
    static = F.when((F.col("kind") == "S_LDATA32") & F.col("rest").rlike(LOCAL), F.struct("line_no", hex_part("rest", LOCAL, 1).cast("int").alias("section"), hex_part("rest", LOCAL, 2).alias("offset"), type_key(part("rest", LOCAL, 3)).alias("type"), part("rest", LOCAL, 4).alias("name")))
    head = F.when(F.col("line_no") == F.col("fn"), F.struct("kind", "rest"))
    per = rows.groupBy("module", "fn").agg(F.max(head).alias("h"), F.array_sort(F.collect_list(stored)).alias("symbols"), F.array_sort(F.collect_list(static)).alias("static_variables"), F.bool_or(F.col("line").rlike(r"^\s*Flags: Frame Ptr Present\s*$")).alias("frame_pointer_present"))
    return per.select(
        F.col("h.kind").alias("type"), hex_part("h.rest", PROCEDURE, 1).cast("int").alias("section"), hex_part("h.rest", PROCEDURE, 2).alias("offset"), hex_part("h.rest", PROCEDURE, 3).alias("size"), type_key(part("h.rest", PROCEDURE, 4)).alias("func_type"), part("h.rest", PROCEDURE, 5).alias("name"),
        F.transform("symbols", lambda x: x.dropFields("line_no")).alias("symbols"), F.transform("static_variables", lambda x: x.dropFields("line_no")).alias("static_variables"), "frame_pointer_present",
    )


def leaves(lines: DataFrame) -> DataFrame:
    """TYPES: (key, leaf, text) of the type records that are read; a record is its first
    line and what follows up to the next."""
    rows = lines.where("section = 'TYPES'").select("line_no", "line")
    numbered = under(rows, rows.where(F.col("line").rlike(r"^0x\w{4,8} : ")).select("line_no")).withColumnRenamed("base", "_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    whole = numbered.groupBy("_id").agg(text.alias("text"))
    return whole.select(type_key(part("text", LEAF, 1)).alias("key"), part("text", LEAF, 2).alias("leaf"), "text").where(F.col("leaf").isin(*LEAVES))


def records(found: DataFrame) -> DataFrame:
    """Type records in columns; what a kind does not have is null."""
    t = F.col("text")
    key = lambda p, k=1: type_key(F.nullif(part(t, p, k), F.lit("")))
    number = lambda p, k=1: F.nullif(part(t, p, k), F.lit("")).cast("long")
    text = lambda p, k=1: F.nullif(part(t, p, k), F.lit(""))
    lists = lambda p, k: F.regexp_extract_all(t, F.lit(p), k)
    member = r"LF_MEMBER, \w+, type = ([^,]*), offset = (\d+)\s+member name = '([^']*)'"
    base = r"LF_BCLASS, \w+, type = ([^,]*), offset = (\d+)"
    value = r"LF_ENUMERATE,.*value = (?:\([\w_]*\)\s)?(-?\d+)(?:\([\w_]*\))?, name = '([^']+)'"
    argument = r"list\[\d+\] = ([?\w()]+)"
    one = lambda leaf, c: F.when(F.col("leaf").isin(*leaf.split()), c)
    members = F.transform(F.arrays_zip(lists(member, 1).alias("t"), lists(member, 2).alias("o"), lists(member, 3).alias("n")), lambda x: F.struct(x["o"].cast("int").alias("offset"), type_key(x["t"]).alias("type"), x["n"].alias("name")))
    table = F.when(F.contains(t, F.lit("LF_VFUNCTAB")), F.array(F.struct(F.lit(0).alias("offset"), F.lit(0x403).alias("type"), F.lit("vftable").alias("name")))).otherwise(F.array().cast("array<struct<offset:int,type:int,name:string>>"))
    supers = F.transform(F.arrays_zip(lists(base, 1).alias("t"), lists(base, 2).alias("o")), lambda x: F.struct(x["o"].cast("int").alias("offset"), type_key(x["t"]).alias("type")))
    variants = F.transform(F.arrays_zip(lists(value, 1).alias("v"), lists(value, 2).alias("n")), lambda x: F.struct(x["n"].alias("name"), x["v"].cast("long").alias("value")))
    named = r"class name = ((?:[^\n,]|,\S)+)"
    return found.select(
        "key", "leaf",
        one("LF_MODIFIER", key(r"modifies type ([^\n,]*)")).alias("modifies"),
        one("LF_ARRAY", key(r"Element type = ([^\n,]+)")).alias("array_type"),
        F.coalesce(one("LF_ARRAY", number(r"length = (?:[\w()]+ )?(\d+)")), one("LF_CLASS LF_STRUCTURE LF_UNION", number(r"Size = (?:\([\w_]+\) )?(\d+)"))).alias("size"),
        one("LF_FIELDLIST", F.array_sort(F.concat(table, members))).alias("members"),
        one("LF_FIELDLIST", supers).alias("supers"),
        one("LF_FIELDLIST", variants).alias("variants"),
        one("LF_CLASS LF_STRUCTURE LF_UNION LF_ENUM", key(r"field list type (0x\w+)")).alias("field_list"),
        F.coalesce(one("LF_CLASS LF_STRUCTURE LF_UNION", text(named)), one("LF_ENUM", text(r"enum name = ([^\n]+)"))).alias("name"),
        one("LF_CLASS LF_STRUCTURE LF_UNION LF_ENUM", key(r"UDT\((0x\w+)\)")).alias("udt"),
        F.coalesce(F.contains(t, F.lit("FORWARD REF")), F.lit(False)).alias("is_forward_ref"),
        one("LF_ENUM", key(r"type = (\S+) field list")).alias("underlying_type"),
        one("LF_ARGLIST", F.transform(lists(argument, 1), type_key)).alias("args"),
        one("LF_POINTER", key(r"Element type : ([^\n,]+)")).alias("element_type"),
        one("LF_PROCEDURE LF_MFUNCTION", key(r"Return type = ([^,]+)")).alias("return_type"),
        one("LF_MFUNCTION", key(r"Class type = ([^,]+)")).alias("class_type"),
        one("LF_MFUNCTION", key(r"This type = ([^,]+)")).alias("this_type"),
        one("LF_PROCEDURE LF_MFUNCTION", text(r"Call type = ([^\n,]+)")).alias("call_type"),
        one("LF_PROCEDURE LF_MFUNCTION", number(r"Parms = (\d+)")).alias("num_params"),
        one("LF_PROCEDURE LF_MFUNCTION", key(r"Arg list type = (\w+)")).alias("arg_list_type"),
        one("LF_MFUNCTION", codec.from_hex(text(r"This adjust = ([0-9a-f]+)"))).alias("this_adjust"),
        one("LF_BITFIELD", number(r"bits = (\d+)")).alias("bit_count"),
        one("LF_BITFIELD", number(r"starting position = (\d+)")).alias("bit_start"),
        one("LF_BITFIELD", key(r"Type = (.+\([0-9a-fA-F]+\))")).alias("bit_type"),
    )


def node_type(decorated: Column) -> Column:
    """What a decorated name stands for, by its beginning."""
    return (
        F.when(decorated.startswith("??_7"), "VTABLE").when(decorated.startswith("??_8"), "VBTABLE")
        .when(decorated.startswith("??_C@"), F.when(decorated.startswith("??_C@_1"), "WIDECHAR").otherwise("STRING"))
        .when(decorated.rlike(r"^__real@"), "FLOAT").when(decorated.startswith("__imp_"), "IMPORT").when(decorated.rlike(r"^\?[^?].*@@[0-3]"), "DATA").when(decorated.rlike(r"^\?"), "FUNCTION")
    )


def float_size(symbol: Column) -> Column:
    """The size of a float constant, which its symbol's digits tell."""
    digits = F.regexp_extract(symbol, r"^__real@(?:[48]@)?([0-9a-fA-F]+)$", 1)
    stated = F.regexp_extract(symbol, r"^__real@([48])@", 1)
    return F.when(stated != "", stated.cast("int")).when(F.length(digits) == 8, 4).when(F.length(digits) == 16, 8)


def collate(public: DataFrame, contribution: DataFrame, data: DataFrame, function: DataFrame) -> DataFrame:
    """One node for each place that any section of the dump knows of. Global data without
    a public symbol or a contribution is left out."""
    at = ["section", "offset"]
    p = public.groupBy(*at).agg(F.max("name").alias("decorated"))
    c = contribution.withColumn("section", F.col("section").cast("int")).groupBy(*at).agg(F.max("size").alias("contribution"))
    g = data.groupBy(*at).agg(F.max("name").alias("friendly"), F.max("type").alias("data_type"), F.bool_or("is_global").alias("is_global"))
    f = function.groupBy(*at).agg(F.max("name").alias("function"), F.max("size").alias("function_size"))
    all_ = p.join(c, at, "full").join(g, at, "full").join(f, at, "full")
    kept = all_.where(F.col("friendly").isNull() | ~F.coalesce("is_global", F.lit(False)) | F.col("decorated").isNotNull() | F.col("contribution").isNotNull())
    kind = F.when(F.col("function").isNotNull(), "FUNCTION").otherwise(F.coalesce(node_type(F.col("decorated")), F.when(F.col("friendly").isNotNull(), "DATA")))
    sized = kept.withColumn("estimated", F.lead("offset").over(Window.partitionBy("section").orderBy("offset")) - F.col("offset"))
    return sized.select(*at, kind.alias("node_type"), F.coalesce("function", "friendly", "decorated").alias("name"), F.col("decorated").alias("symbol"), F.coalesce("function_size", F.least("contribution", "estimated"), "contribution", "estimated").alias("size"), "contribution", "data_type")
