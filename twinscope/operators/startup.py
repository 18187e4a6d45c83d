"""Functions that run before or after main, which lists between two labels name.

The lists of both images are matched by the data that their functions use (see
naming.eliminate); their functions then have a name and a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec
from twinscope.operators import compare, naming, store
from twinscope.operators.store import State

# The labels before and after each list, and the name of what is in it.
LISTS = {
    "C_INIT": ("___xi_a", "___xi_z", "$CRT_C_Initializer"),
    "CPP_INIT": ("___xc_a", "___xc_z", "$CRT_CPP_Initializer"),
    "C_PRE_TERM": ("___xp_a", "___xp_z", "$CRT_C_Pre-Terminator"),
    "C_TERM": ("___xt_a", "___xt_z", "$CRT_C_Terminator"),
}
LABELS = tuple(label for row in LISTS.values() for label in row[:2])


def function_name(list_: Column | str) -> Column:
    """The name of the functions in a list."""
    of = F.create_map(*[F.lit(x) for kind, row in LISTS.items() for x in (kind, row[2])])
    return F.try_element_at(of, F.col(list_) if isinstance(list_, str) else list_)


def labels(entities: DataFrame, img: int) -> DataFrame:
    """(name, addr) of the labels in one image: the last of a name, but none after the
    place where all labels were seen."""
    rows = entities.where((F.col("img") == img) & F.col("name").isin(*LABELS)).select("name", "addr")
    firsts = rows.groupBy("name").agg(F.min("addr").alias("first"))
    complete = firsts.agg(F.when(F.count("*") == len(LABELS), F.max("first")).alias("_all"))
    return rows.join(F.broadcast(complete)).where(F.col("_all").isNull() | (F.col("addr") <= F.col("_all"))).groupBy("name").agg(F.max("addr").alias("addr"))


def spans(found: DataFrame) -> DataFrame:
    """(list, start, stop) of the lists of which both labels are known."""
    rows = None
    for kind, (before, after, _) in LISTS.items():
        own = found.where(F.col("name").isin(before, after)).agg(F.max(F.when(F.col("name") == before, F.col("addr"))).alias("start"), F.max(F.when(F.col("name") == after, F.col("addr"))).alias("stop"))
        own = own.select(F.lit(kind).alias("list"), "start", "stop")
        rows = own if rows is None else rows.unionByName(own)
    return rows.where("start is not null and stop is not null")


def listed(blocks: DataFrame) -> DataFrame:
    """(list, position, addr) of the functions in each list, whose ``blocks`` (list, data)
    are read as pointers; null ones are fillers, and a torn block lists nothing."""
    whole = blocks.where(F.octet_length("data") % 4 == 0)
    return whole.select("list", F.posexplode(compare.words(F.col("data"))).alias("position", "addr")).where("addr <> 0")


def unwrapped(functions: DataFrame, most: int = 16) -> DataFrame:
    """``functions`` (addr, code) with func_addr, where a first jump or call leads if that
    is near, and thunk_addr, the address itself if so."""
    code = F.col("code")
    is_jump = F.hex(F.substring(code, 1, 1)).isin("E8", "E9") & (F.octet_length(code) >= 5)
    step = codec.little_endian(code, 1, 4, signed=True) + 5
    near = F.coalesce(is_jump & (F.abs(step) <= most), F.lit(False))
    return functions.withColumns({"func_addr": F.when(near, F.col("addr") + step).otherwise(F.col("addr")), "thunk_addr": F.when(near, F.col("addr"))})


def match(state: State, functions: DataFrame, samples: DataFrame) -> State:
    """Match and name the functions of both images' lists. ``functions``: img, list,
    func_addr, thunk_addr; ``samples``: as naming.eliminate() takes them, by list."""
    both = functions.groupBy("list").agg(F.count_distinct("img").alias("n")).where("n = 2").select("list")
    pairs = naming.eliminate(samples.join(both, "list", "left_semi"), "list").select("orig_addr", "recomp_addr")
    thunk = lambda img, key, out: functions.where((F.col("img") == img) & F.col("thunk_addr").isNotNull()).select(F.col("func_addr").alias(key), F.col("thunk_addr").alias(out))
    thunks = pairs.join(thunk(schema.ORIG, "orig_addr", "o"), "orig_addr").join(thunk(schema.RECOMP, "recomp_addr", "r"), "recomp_addr").select(F.col("o").alias("orig_addr"), F.col("r").alias("recomp_addr"))
    at = functions.select("img", "list", F.explode(F.filter(F.array("func_addr", "thunk_addr"), lambda x: x.isNotNull())).alias("addr")).groupBy("img", "addr").agg(F.max("list").alias("list"))
    state = state.upsert(store.delta(at, {"type": F.lit(schema.FUNCTION), "name": function_name("list")})).cut()
    every = pairs.withColumn("_turn", F.lit(0)).unionByName(thunks.withColumn("_turn", F.lit(1)))
    return state.match(every.withColumn("rank", F.struct("_turn", "orig_addr", "recomp_addr")), "rank")
