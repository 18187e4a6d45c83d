"""Instruction text that can be compared across images: addresses become names.

Instructions come decoded (img, func_addr, addr, size, mnemonic, op_str). What each
address in them means depends on its place: the operand of a call or jump, a pointer in
brackets, a displacement, an immediate value. All mentions become rows, are named by one
join, and are numbered per function in the order of their first use, so that texts of
both images agree where names are missing; then each instruction's template is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec, entity
from twinscope.operators import joins
from twinscope.operators.store import State

# Jumps, and the forms of operands.
JUMPS = ("ja", "jae", "jb", "jbe", "jcxz", "je", "jecxz", "jg", "jge", "jl", "jle", "jmp", "jne", "jno", "jnp", "jns", "jo", "jp", "js", "loop", "loope", "loopne")
_WHOLE, _POINTER, _DISPLACED, _IMMEDIATE = r"^0x([0-9a-f]+)$", r"(?<=\[)0x([0-9a-f]+)(?=\])", r"(?<= )0x([0-9a-f]+)(?=\])", r"(?<=, )0x([0-9a-f]+)"


def _signed_hex(c: Column) -> Column:
    return F.when(c < 0, F.concat(F.lit("-"), codec.to_hex(-c))).otherwise(codec.to_hex(c))


def mentions(code: DataFrame, is_32bit: bool = True) -> DataFrame:
    """(img, func_addr, addr, slot, value, rule): the addresses in each instruction.

    Rules: call and pointer always get a name or number; value gets one if it is an
    address; compare and jump only take a name; indirect is a pointer that is called."""
    one = F.col("mnemonic").isin("call", "push", *JUMPS)
    looked = F.contains("op_str", F.lit("0x")) & (F.col("mnemonic").isin(*JUMPS) | (F.col("size") > 4) | F.lit(not is_32bit))
    at = lambda pattern: F.conv(F.regexp_extract("op_str", pattern, 1), 16, 10).cast("long")
    whole = F.col("op_str").rlike(_WHOLE) & one
    rule = F.when(F.col("mnemonic") == "call", "call").when(F.col("mnemonic") == "push", "value").when(F.col("mnemonic") == "jmp", "jump")
    item = lambda ok, slot, pattern, r: F.when(ok & F.col("op_str").rlike(pattern), F.struct(F.lit(slot).alias("slot"), at(pattern).alias("value"), r.alias("rule")))
    is_call = F.col("mnemonic") == "call"
    found = F.array(
        item(whole & rule.isNotNull(), 0, _WHOLE, rule),
        item(~whole, 1, _POINTER, F.when(is_call, "indirect").otherwise("pointer")),
        item(~whole & ~is_call, 2, _DISPLACED, F.lit("value")),
        item(~whole, 3, _IMMEDIATE, F.when(F.col("mnemonic") == "cmp", "compare").otherwise("value")),
    )
    return code.where(looked).select("img", "func_addr", "addr", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m")).select("img", "func_addr", "addr", "m.slot", "m.value", "m.rule")


def named(found: DataFrame, state: State, pointers: DataFrame | None = None) -> DataFrame:
    """Mentions with ``text``, the name for the address under its rule, if it has one.
    ``pointers``: img, addr, target of pointers in the images."""
    s = state.entities.withColumns({"_name": entity.match_name(), "_best": entity.best_name(), "_size": F.when(F.col("img") == schema.ORIG, entity.any_size(schema.ORIG)).otherwise(entity.any_size(schema.RECOMP))})
    probes = found.select("img", F.col("value").alias("addr")).distinct()
    near = joins.asof_backward(probes, s, "addr", ("img",), ("_name", "_best", "_size", "type"))
    into = F.col("addr") - F.col("base")
    part = F.when(F.col("type").isin(schema.DATA, schema.OFFSET) & (into < F.col("_size")), F.concat("_best", F.lit("+"), into.cast("string"), F.lit(" (OFFSET)")))
    exact = F.when(into == 0, F.col("_name"))
    names = near.select("img", F.col("addr").alias("value"), exact.alias("_exact"), F.when(into == 0, F.col("_name")).otherwise(part).alias("_any"), F.when(into == 0, F.col("type")).alias("_type"))
    if pointers is not None:
        behind = pointers.join(s.select("img", F.col("addr").alias("target"), F.col("_name").alias("_behind")), ["img", "target"]).select("img", F.col("addr").alias("value"), "_behind")
        names = names.join(behind, ["img", "value"], "left")
    else:
        names = names.withColumn("_behind", F.lit(None).cast("string"))
    arrow = lambda c: F.concat(F.lit("->"), F.col(c))
    indirect = F.when(F.col("_type") == schema.DATA, F.col("_exact")).when(F.col("_type") == schema.IMPORT, arrow("_exact")).otherwise(arrow("_behind"))
    text = F.when(F.col("rule").isin("call", "jump"), F.col("_exact")).when(F.col("rule") == "indirect", indirect).otherwise(F.col("_any"))
    return found.join(names, ["img", "value"], "left").select(*found.columns, text.alias("text"))


def placeholders(found: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Mentions that are replaced, with what by. Numbers count the addresses of a function
    in the order of first use, named ones too; a pointer that is called counts apart.
    ``valid``: img, value of known addresses."""
    known = valid.select("img", "value", F.lit(True).alias("_ok")).distinct() if valid is not None else None
    rows = found.join(known, ["img", "value"], "left") if known is not None else found.withColumn("_ok", F.lit(None).cast("boolean"))
    counts = F.col("rule").isin("call", "pointer", "indirect") | ((F.col("rule") == "value") & F.coalesce("_ok", F.lit(False)))
    uses = rows.where(counts).withColumn("_indirect", F.col("rule") == "indirect")
    first = uses.groupBy("img", "func_addr", "value", "_indirect").agg(F.min(F.struct("addr", "slot")).alias("_first"))
    order = Window.partitionBy("img", "func_addr").orderBy("_first")
    numbers = first.withColumn("_n", F.row_number().over(order)).drop("_first")
    # A function's first way of naming an address stays for all its uses there.
    keep = Window.partitionBy("img", "func_addr", "value", "_indirect").orderBy("addr", "slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = uses.withColumn("text", F.first("text").over(keep)).join(numbers, ["img", "func_addr", "value", "_indirect"])
    counted = counted.select("img", "func_addr", "addr", "slot", F.coalesce("text", F.concat(F.lit("<OFFSET"), F.col("_n").cast("string"), F.lit(">"))).alias("text"))
    plain = rows.where(~counts & F.col("rule").isin("compare", "jump") & F.col("text").isNotNull()).select("img", "func_addr", "addr", "slot", "text")
    return counted.unionByName(plain)


def normalise(code: DataFrame, state: State, valid: DataFrame | None = None, pointers: DataFrame | None = None) -> DataFrame:
    """``code`` with ``text``, each instruction with its addresses replaced. Jumps that
    have no name show how far they go."""
    put = placeholders(named(mentions(code), state, pointers), valid)
    by_slot = put.groupBy("img", "func_addr", "addr").agg(*[F.max(F.when(F.col("slot") == k, F.col("text"))).alias(f"_s{k}") for k in range(4)])
    rows = code.join(by_slot, ["img", "func_addr", "addr"], "left")
    jump = F.col("mnemonic").isin(*JUMPS) & F.col("op_str").rlike(_WHOLE)
    distance = F.conv(F.regexp_extract("op_str", _WHOLE, 1), 16, 10).cast("long") - (F.col("addr") + F.col("size"))
    op = F.col("op_str")
    # Later places first, so that what is put in is not searched again.
    for k, pattern in ((3, _IMMEDIATE), (2, _DISPLACED), (1, _POINTER)):
        safe = F.regexp_replace(F.col(f"_s{k}"), r"([\\$])", r"\\$1")
        op = F.when(F.col(f"_s{k}").isNotNull(), F.regexp_replace(op, F.lit(pattern), safe)).otherwise(op)
    op = F.coalesce("_s0", F.when(jump, _signed_hex(distance)), op)
    return rows.select(*code.columns, F.trim(F.concat_ws(" ", "mnemonic", op)).alias("text"))


def as_lines(normalised: DataFrame) -> DataFrame:
    """(img, addr, lines): each function's text in order, as comparisons take it."""
    lines = F.array_sort(F.collect_list(F.struct("addr", "text")))
    return normalised.groupBy("img", F.col("func_addr").alias("of")).agg(lines.alias("l")).select("img", F.col("of").alias("addr"), F.transform("l", lambda x: F.struct(codec.to_hex(x["addr"]).alias("addr"), x["text"].alias("text"))).alias("lines"))
