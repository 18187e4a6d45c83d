"""Names along references, and matching by elimination."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import entity
from twinscope.operators import lineage
from twinscope.operators.normalise import JUMPS

DEPTH = 10


def thunk_names(merged: DataFrame, depth: int = DEPTH, eager: bool = False) -> DataFrame:
    """(img, addr, name) for entities that stand for others: the name of the function or
    import at the end of their references, at most ``depth`` steps away, in a form that
    says what they are.

    Each step is a join on the reference, so nothing depends on the length of the
    longest chain but the number of steps. With ``eager`` the lineage is cut at each step, and
    the walk ends when nothing is left to follow: most references are one step long.
    """
    kinds = merged.where(F.col("type").isin(schema.THUNK, schema.VTORDISP, schema.IMPORT_THUNK))
    per_image = []
    for img, addr, ref in ((schema.ORIG, "orig_addr", "ref_orig"), (schema.RECOMP, "recomp_addr", "ref_recomp")):
        children = kinds.where(F.col(addr).isNotNull() & F.col(ref).isNotNull()).select(F.col(addr).alias("addr"), F.col(ref).alias("ref"), "type", "displacement")
        roots = merged.where(F.col("type").isin(schema.FUNCTION, schema.IMPORT) & F.col(addr).isNotNull()).select(F.col(addr).alias("ref"), entity.best_name().alias("root")).where("root is not null")
        at = children.join(roots, "ref", "left")
        up = children.select(F.col("addr").alias("ref"), F.col("ref").alias("next"))
        for _ in range(depth - 1):
            if eager:
                at = lineage.cut(at)
                if at.where("root is null and ref is not null").isEmpty():
                    break
            at = at.join(up, "ref", "left").withColumn("ref", F.when(F.col("root").isNull(), F.col("next")).otherwise(F.col("ref"))).drop("next")
            at = at.join(roots.withColumnRenamed("root", "found"), "ref", "left").withColumn("root", F.coalesce("root", "found")).drop("found")
        d = lambda k: F.coalesce(F.col(f"displacement.{k}"), F.lit(0)).cast("string")
        name = (
            F.when(F.col("type") == schema.THUNK, F.concat(F.lit("Thunk of '"), "root", F.lit("'")))
            .when(F.col("type") == schema.VTORDISP, F.concat("root", F.lit("`vtordisp{"), d("d0"), F.lit(", "), d("d1"), F.lit("}'")))
            .otherwise(F.col("root"))
        )
        per_image.append(at.where(entity.has_text(F.col("root"))).select(F.lit(img).alias("img"), "addr", name.alias("name")))
    return per_image[0].unionByName(per_image[1])


def eliminate(samples: DataFrame, group: str = "array_type") -> DataFrame:
    """Match start-up functions by the addresses they use.

    ``samples`` has (group, img, func_addr, used, is_write, seq): a row for each address
    that a function reads or writes. A sample that only one function of each side shares
    matches them; both are out, and the first such sample then left counts. The order of
    samples matters, so each array, a few hundred functions, is one task; the samples that
    are ready wait in a heap, so each row is looked at a few times at most.
    """

    def work(pdf):
        users: dict = {}
        for row in pdf.sort_values(["img", "seq", "used", "is_write"]).itertuples():
            users.setdefault((row.used, row.is_write), set()).add((row.img, row.func_addr))
        left = list(users.values())
        samples_of: dict = {}
        for k, members in enumerate(left):
            for m in members:
                samples_of.setdefault(m, []).append(k)
        is_ready = lambda members: len(members) == 2 and {m[0] for m in members} == {schema.ORIG, schema.RECOMP}
        ready = [k for k, members in enumerate(left) if is_ready(members)]
        kind, out = pdf[group].iloc[0], []
        while ready:
            k = heapq.heappop(ready)
            if not is_ready(left[k]):
                continue
            pair = dict(left[k])
            out.append((kind, pair[schema.ORIG], pair[schema.RECOMP], len(out)))
            for m in pair.items():
                for other in samples_of[m]:
                    left[other].discard(m)
                    if is_ready(left[other]):
                        heapq.heappush(ready, other)
        return pdf.__class__(out, columns=[group, "orig_addr", "recomp_addr", "nth"])

    kind = samples.schema[group].dataType.simpleString()
    return samples.groupBy(group).applyInPandas(work, f"{group} {kind}, orig_addr long, recomp_addr long, nth int")


def thunks_of_matched(pairs: DataFrame, thunks: DataFrame) -> DataFrame:
    """Pairs of thunks (img, target, addr) whose targets are matched to each other."""
    side = lambda img, key, out: thunks.where(F.col("img") == img).select(F.col("target").alias(key), F.col("addr").alias(out))
    both = pairs.join(side(schema.ORIG, "orig_addr", "o"), "orig_addr").join(side(schema.RECOMP, "recomp_addr", "r"), "recomp_addr")
    return both.select(F.col("o").alias("orig_addr"), F.col("r").alias("recomp_addr"))


def fingerprints(instructions: DataFrame, matched_data: DataFrame) -> DataFrame:
    """(img, func_addr, used, is_write, seq): the matched data that each function's code
    up to its first return refers to, as original addresses, in the order of use. Only
    what a move or a store puts its result into is written; jumps use nothing.

    ``instructions``: img, func_addr, addr, mnemonic, op_str; ``matched_data``: img, addr, orig_addr.
    """
    ends = instructions.where("mnemonic = 'ret'").groupBy("img", "func_addr").agg(F.min("addr").alias("stop"))
    body = instructions.join(ends, ["img", "func_addr"], "left").where((F.col("stop").isNull() | (F.col("addr") <= F.col("stop"))) & ~F.col("mnemonic").isin(*JUMPS))
    stores = F.col("mnemonic").isin("mov", "fstp")
    sides = F.when(stores, F.split("op_str", ", ", 2)).otherwise(F.array("op_str"))
    operands = body.select("img", "func_addr", "addr", stores.alias("stores"), F.posexplode(sides).alias("nth", "operand"))
    used = operands.select("img", "func_addr", "addr", "stores", "nth", F.posexplode(F.regexp_extract_all("operand", F.lit("0x([0-9a-f]{6,8})"), 1)).alias("k", "hex"))
    order = F.col("addr") * 16 + F.col("nth") * 8 + F.col("k")
    at = used.select("img", "func_addr", order.alias("seq"), F.conv("hex", 16, 10).cast("long").alias("addr"), (F.col("stores") & (F.col("nth") == 0)).alias("is_write"))
    return at.join(matched_data, ["img", "addr"]).select("img", "func_addr", F.col("orig_addr").alias("used"), "is_write", "seq")
