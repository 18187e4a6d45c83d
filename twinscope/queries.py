"""Queries that apply the engine's operators to the provided tables, with their SQL.

The tables stand in for the engine's own: parts are entities of two images (even and odd
keys), orders are results of reports (a sample for each priority), events are code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec, entity, report
from twinscope.operators import compare, diff, joins, layout, lint, matchers, naming, reports, roadmap, store, windows
from twinscope.operators.store import State
from twinscope.plans import compare as compare_plans
from twinscope.sources import annotations, reports_json, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Entities from parts

BASE = 4096
TYPES = {"ECONOMY": schema.FUNCTION, "LARGE": schema.DATA, "MEDIUM": schema.STRING, "PROMO": schema.VTABLE, "SMALL": schema.IMPORT}
_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPES.items())
ENT = f"""ent AS (SELECT CAST(p_partkey % 2 AS INTEGER) AS img, {BASE} + p_partkey * 16 AS addr, p_partkey AS pk, p_name AS name, p_name || '@' || p_brand AS symbol,
 CASE p_type {_CASE} END AS type, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS size, p_size, p_brand FROM part)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("int")
    for k, v in TYPES.items():
        kind = F.when(F.col("p_type") == k, v).otherwise(kind)
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("long"))
    side = F.col("p_partkey") % 2
    return table(spark, sf_dir, "part").select(
        side.cast("int").alias("img"), (F.col("p_partkey") * 16 + BASE).alias("addr"), kind.alias("type"), F.col("p_name").alias("name"), F.concat("p_name", F.lit("@"), "p_brand").alias("symbol"),
        F.when(side == 0, size).alias("orig_size"), F.when(side == 1, size).alias("recomp_size"), (F.col("p_size") % 3 == 0).alias("verified"), (F.col("p_size") % 7 == 0).alias("static_var"),
    )


def state(spark: SparkSession, sf_dir: str) -> State:
    sections = entities(spark, sf_dir).groupBy("img", F.floor(F.col("addr") / 8192).cast("int").alias("section_id")).count()
    ranges = sections.select("img", "section_id", (F.col("section_id").cast("long") * 8192).alias("start"), ((F.col("section_id").cast("long") + 1) * 8192).alias("stop"))
    return State.of(spark, entities(spark, sf_dir), sections=ranges)


def _nth(where_o: str, where_r: str, key: str = "name", final: str = "") -> str:
    return f"""WITH {ENT}, o AS (SELECT {key} AS k, addr, row_number() OVER (PARTITION BY {key} ORDER BY addr) AS rn FROM ent WHERE img = 0 AND {where_o}),
 r AS (SELECT {key} AS k, addr, row_number() OVER (PARTITION BY {key} ORDER BY addr) AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM ent WHERE img = 1 AND {where_r})
 {final or 'SELECT o.addr AS orig_addr, r.addr AS recomp_addr FROM o JOIN r ON o.k = r.k AND o.rn = r.rn'}"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many original entities of each type a match by name finds."""
    s = state(spark, sf_dir)
    o = s.side(schema.ORIG).select(F.col("name").alias("key"), "addr", "type")
    r = s.side(schema.RECOMP).select(F.col("name").alias("key"), F.col("addr").alias("other"))
    found = joins.nth_occurrence_join(o, r, ["key"], ["addr"], ["other"], "left")
    return found.groupBy(entity.type_name("type").alias("type_name")).agg(F.count("*").alias("n_entities"), F.count("other").alias("n_matched")).withColumn("share", F.round(F.col("n_matched") / F.col("n_entities"), 6))


_NAMES = "CASE type " + " ".join(f"WHEN {v} THEN '{schema.TYPE_NAMES[v]}'" for v in TYPES.values()) + " ELSE 'UNK' END"
QUERIES["match_coverage"] = flagship
ORACLE["match_coverage"] = f"""WITH {ENT}, o AS (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY addr) AS rn FROM ent WHERE img = 0),
 r AS (SELECT name, addr, row_number() OVER (PARTITION BY name ORDER BY addr) AS rn FROM ent WHERE img = 1)
 SELECT {_NAMES} AS type_name, count(*) AS n_entities, count(r.addr) AS n_matched, round(count(r.addr) / count(*), 6) AS share FROM o LEFT JOIN r ON o.name = r.name AND o.rn = r.rn GROUP BY 1"""


@query(_nth("symbol <> ''", "symbol <> ''", "substr(symbol, 1, 255)"))
def match_symbols(spark, sf_dir):
    return matchers.symbols(state(spark, sf_dir), truncate=True).matches


@query(_nth("symbol <> ''", "symbol <> ''", "symbol", "SELECT 'NON_UNIQUE_SYMBOL' AS event, count(*) AS n FROM o JOIN r ON o.k = r.k AND o.rn = r.rn WHERE r.n > r.rn HAVING count(*) > 0 UNION ALL SELECT 'NO_MATCH', count(*) FROM o WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.rn = o.rn) HAVING count(*) > 0"))
def match_symbols_events(spark, sf_dir):
    return matchers.symbols(state(spark, sf_dir)).events.groupBy("event").agg(F.count("*").alias("n"))


@query(_nth("type = 1", "(type IS NULL OR type = 1)"))
def match_functions(spark, sf_dir):
    return matchers.functions(state(spark, sf_dir)).matches


@query(_nth("type = 1", "(type IS NULL OR type = 1)", final="SELECT o.addr AS orig_addr FROM o JOIN r ON o.k = r.k AND o.rn = r.rn WHERE r.n > 1"))
def match_functions_ambiguous(spark, sf_dir):
    return matchers.functions(state(spark, sf_dir)).events.where("event = 'AMBIGUOUS_MATCH'").select("orig_addr")


@query(_nth("type = 2 AND p_size % 7 <> 0", "(type IS NULL OR type = 2)"))
def match_variables(spark, sf_dir):
    return matchers.variables(state(spark, sf_dir)).matches


@query(_nth("type = 4", "type = 4"))
def match_strings(spark, sf_dir):
    return matchers.strings(state(spark, sf_dir)).matches


@query(_nth("type = 4", "type = 4", final="SELECT o.addr AS orig_addr FROM o JOIN ent e ON e.addr = o.addr WHERE e.p_size % 3 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.k = o.k AND r.rn = o.rn)"))
def match_strings_verified_misses(spark, sf_dir):
    return matchers.strings(state(spark, sf_dir)).events.select("orig_addr")


_VT = """v AS (SELECT img, addr, name AS class, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN name END AS base, CASE WHEN p_size % 2 = 0 THEN name || '::`vftable''' ELSE name || '::`vftable''{for `' || CASE WHEN p_size % 4 = 1 THEN name ELSE p_brand END || '''}' END AS rname FROM ent)"""


@query(f"""WITH {ENT}, {_VT}, r AS (SELECT rname AS k, addr, row_number() OVER (PARTITION BY rname ORDER BY addr) AS rn FROM v WHERE img = 1),
 o1 AS (SELECT class || '::`vftable''' AS k, addr, row_number() OVER (PARTITION BY class ORDER BY addr) AS rn FROM v WHERE img = 0 AND coalesce(base, class) = class),
 m1 AS (SELECT o1.addr AS orig_addr, r.addr AS recomp_addr FROM o1 JOIN r ON o1.k = r.k AND o1.rn = r.rn),
 left_ AS (SELECT addr, class || '::`vftable''{{for `' || coalesce(base, class) || '''}}' AS k FROM v WHERE img = 0 AND addr NOT IN (SELECT orig_addr FROM m1)),
 o2 AS (SELECT k, addr, row_number() OVER (PARTITION BY k ORDER BY addr) AS rn FROM left_)
 SELECT * FROM m1 UNION ALL SELECT o2.addr, r.addr FROM o2 JOIN r ON o2.k = r.k AND o2.rn = r.rn""")
def match_vtables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = F.col("p_partkey") % 2
    base = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, F.col("p_name"))
    of = F.when(F.col("p_size") % 4 == 1, F.col("p_name")).otherwise(F.col("p_brand"))
    rname = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("::`vftable'"))).otherwise(F.concat("p_name", F.lit("::`vftable'{for `"), of, F.lit("'}")))
    rows = p.select(side.cast("int").alias("img"), (F.col("p_partkey") * 16 + BASE).alias("addr"), F.lit(schema.VTABLE).alias("type"), F.when(side == 0, F.col("p_name")).otherwise(rname).alias("name"), F.when(side == 0, base).alias("base_class"))
    return matchers.vtables(State.of(spark, rows)).matches


@query(f"WITH {ENT} SELECT o.a AS orig_addr, r.a AS recomp_addr FROM (SELECT upper(name) AS k, max(addr) AS a FROM ent WHERE img = 0 AND type = 7 GROUP BY 1) o JOIN (SELECT upper(name) AS k, min(addr) AS a FROM ent WHERE img = 1 AND type = 7 GROUP BY 1) r ON o.k = r.k")
def match_imports(spark, sf_dir):
    return matchers.imports(state(spark, sf_dir)).matches


_LINES = "m AS (SELECT event_id AS a, 'u' || user_id AS path, event_id % 100 + 1 AS line_no FROM events), d AS (SELECT 'u' || user_id AS path, event_id % 100 AS line_no, min(event_id) AS b FROM events GROUP BY 1, 2)"


@query(f"WITH {_LINES} SELECT min(m.a) AS orig_addr, d.b AS recomp_addr FROM m JOIN d ON m.path = d.path AND m.line_no = d.line_no GROUP BY d.b")
def match_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("path", F.concat(F.lit("u"), "user_id"))
    marks = e.select(F.lit(0).alias("img"), F.col("event_id").alias("addr"), F.lit(schema.LINE).alias("type"), F.col("path").alias("filename"), (F.col("event_id") % 100).cast("int").alias("line"))
    lines = e.select("path", (F.col("event_id") % 100).cast("int").alias("line_no"), F.col("event_id").alias("addr"), F.col("event_id").alias("seq"))
    return matchers.lines(State.of(spark, marks), lines).matches


def _tree(spark, sf_dir) -> State:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    parent = (F.floor(k / 8) * 2 + k % 2) * 16 + BASE
    shift = F.struct((F.col("p_size") % 2).cast("long").alias("d0"), F.lit(0).cast("long").alias("d1"))
    rows = p.select((k % 2).cast("int").alias("img"), (k * 16 + BASE).alias("addr"), F.when(k % 2 == 0, parent).alias("ref_orig"), F.when(k % 2 == 1, parent).alias("ref_recomp"), shift.alias("displacement"))
    roots = spark.createDataFrame([(BASE, BASE + 16)], schema.MATCHES)
    return State.of(spark, rows, matches=roots)


def _ref_pass(n: int) -> str:
    prev = f"m{n - 1}"
    side = lambda img, own: f"SELECT t.addr, p.o AS parent, t.d, row_number() OVER (PARTITION BY p.o, t.d ORDER BY t.addr) AS rn FROM t JOIN {prev} p ON t.ref = p.{own} WHERE t.img = {img} AND t.addr NOT IN (SELECT {own} FROM {prev})"
    return f"m{n} AS (SELECT * FROM {prev} UNION ALL SELECT a.addr AS o, b.addr AS r FROM ({side(0, 'o')}) a JOIN ({side(1, 'r')}) b ON a.parent = b.parent AND a.d = b.d AND a.rn = b.rn)"


@query(f"WITH t AS (SELECT p_partkey % 2 AS img, p_partkey * 16 + {BASE} AS addr, (p_partkey // 8 * 2 + p_partkey % 2) * 16 + {BASE} AS ref, p_size % 2 AS d FROM part), m0 AS (SELECT {BASE} AS o, {BASE + 16} AS r), " + ", ".join(_ref_pass(n) for n in range(1, 11)) + " SELECT CAST(o AS BIGINT) AS orig_addr, CAST(r AS BIGINT) AS recomp_addr FROM m10")
def match_references(spark, sf_dir):
    return matchers.references(_tree(spark, sf_dir)).matches


@query(f"WITH o AS (SELECT p_partkey * 16 + {BASE} + 8 AS addr, p_name AS n, p_brand AS b, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey * 16 + {BASE} AS addr, p_name AS n, p_brand AS b, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part WHERE p_partkey % 2 = 1) SELECT o.addr AS orig_addr, r.addr AS recomp_addr FROM o JOIN r USING (n, b, rn)")
def match_static_variables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, side = F.col("p_partkey"), F.col("p_partkey") % 2
    parents = p.select(F.lit(0).alias("img"), (k * 16 + BASE).alias("addr"), F.lit(schema.FUNCTION).alias("type"), F.concat(F.lit("?"), F.translate("p_name", " ", "_"), F.lit("@")).alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("static_var"), F.lit(None).cast("long").alias("parent_function"))
    owned = p.where(side == 0).select(F.lit(0).alias("img"), (k * 16 + BASE + 8).alias("addr"), F.lit(schema.DATA).alias("type"), F.lit(None).cast("string").alias("symbol"), F.concat("p_brand", F.lit("@")).alias("name"), F.lit(True).alias("static_var"), (k * 16 + BASE).alias("parent_function"))
    others = p.where(side == 1).select(F.lit(1).alias("img"), (k * 16 + BASE).alias("addr"), F.lit(schema.DATA).alias("type"), F.concat(F.lit("?"), "p_brand", F.lit("@?1?"), F.translate("p_name", " ", "_"), F.lit("@")).alias("symbol"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("static_var"), F.lit(None).cast("long").alias("parent_function"))
    return matchers.static_variables(State.of(spark, parents.unionByName(owned).unionByName(others))).matches


@query("SELECT CAST(0 AS INTEGER) AS img, o_custkey AS addr, arg_max(o_orderpriority, struct_pack(d := o_orderdate, k := o_orderkey)) AS name, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS BIGINT) END, struct_pack(d := o_orderdate, k := o_orderkey)) FILTER (WHERE o_orderkey % 3 = 0) AS orig_size FROM orders GROUP BY 2")
def upsert_last_writer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("order", F.struct("o_orderdate", "o_orderkey"))
    always, third = F.lit(True), F.col("o_orderkey") % 3 == 0
    rows = o.select(F.lit(0).alias("img"), F.col("o_custkey").alias("addr"), "order", "o_orderpriority", "o_orderkey")
    set_ = store.delta(rows, {"name": F.col("o_orderpriority"), "orig_size": F.col("o_orderkey")}, when={"name": always, "orig_size": third}, keep=("order",))
    merged = store.merge(State.empty(spark).entities, store.last_writer(set_, "order"))
    return merged.select("img", "addr", "name", "orig_size")


_M = "m AS (" + _nth("symbol <> ''", "symbol <> ''", "symbol").replace(f"WITH {ENT}, ", "WITH ") + ")"


@query(f"WITH {ENT}, {_M} SELECT m.orig_addr, m.recomp_addr, coalesce(r.name, o.name) AS name, coalesce(r.type, o.type) AS type, o.size AS orig_size, r.size AS recomp_size FROM m JOIN ent o ON o.addr = m.orig_addr JOIN ent r ON r.addr = m.recomp_addr")
def merged_matches(spark, sf_dir):
    return matchers.symbols(state(spark, sf_dir)).get_matches().select("orig_addr", "recomp_addr", "name", "type", "orig_size", "recomp_size")


@query(f"WITH {ENT}, {_M} SELECT img, addr FROM ent WHERE addr NOT IN (SELECT orig_addr FROM m) AND addr NOT IN (SELECT recomp_addr FROM m)")
def unmatched_entities(spark, sf_dir):
    s = matchers.symbols(state(spark, sf_dir))
    return s.unmatched(schema.ORIG).select("img", "addr").unionByName(s.unmatched(schema.RECOMP).select("img", "addr"))


@query(f"WITH {ENT}, {_M} SELECT o.addr AS orig_addr, m.recomp_addr FROM ent o LEFT JOIN m ON m.orig_addr = o.addr WHERE img = 0 UNION ALL SELECT NULL, addr FROM ent WHERE img = 1 AND addr NOT IN (SELECT recomp_addr FROM m)")
def all_entities(spark, sf_dir):
    return matchers.symbols(state(spark, sf_dir)).get_all().select("orig_addr", "recomp_addr")


@query(f"WITH {ENT}, {_M} SELECT (SELECT count(*) FROM ent) - (SELECT count(*) FROM m) AS entities, (SELECT count(*) FROM m) AS matches, (SELECT count(*) FROM ent WHERE img = 0 AND type = 1 AND addr NOT IN (SELECT orig_addr FROM m)) AS unmatched_functions")
def store_counts(spark, sf_dir):
    return matchers.symbols(state(spark, sf_dir)).counts()


@query(f"WITH {ENT} SELECT addr, name FROM ent WHERE img = 0 AND addr >= 5000 AND addr < 20000")
def range_scan(spark, sf_dir):
    return state(spark, sf_dir).all(schema.ORIG, 5000, 20000).select("addr", "name")


_PROBES = f"probes AS (SELECT DISTINCT CAST(l_linenumber % 2 AS INTEGER) AS img, {BASE} + l_partkey * 16 + l_quantity::BIGINT AS addr FROM lineitem)"


def probes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).cast("int").alias("img"), (F.col("l_partkey") * 16 + BASE + F.col("l_quantity").cast("long")).alias("addr")).distinct()


@query(f"WITH {ENT}, {_PROBES} SELECT p.img, p.addr, e.addr AS base, e.name FROM probes p ASOF LEFT JOIN ent e ON p.img = e.img AND p.addr >= e.addr")
def asof_entity(spark, sf_dir):
    return state(spark, sf_dir).get(probes(spark, sf_dir), ("name",), exact=False).select("img", "addr", "base", "name")


@query(f"WITH {ENT}, {_PROBES} SELECT p.img, p.addr, coalesce(p.addr = e.addr OR p.addr - e.addr < coalesce(nullif(e.size, 0), 0), FALSE) AS intersects FROM probes p ASOF LEFT JOIN ent e ON p.img = e.img AND p.addr >= e.addr")
def intersects_entity(spark, sf_dir):
    return state(spark, sf_dir).intersects(probes(spark, sf_dir)).select("img", "addr", "intersects")


_SOLID = ", ".join(map(str, schema.SOLID))


@query(f"WITH {ENT}, {_PROBES}, sec AS (SELECT DISTINCT img, addr // 8192 AS s FROM ent), q AS (SELECT p.*, CASE WHEN sec.s IS NOT NULL THEN (sec.s + 1) * 8192 END AS stop FROM probes p LEFT JOIN sec ON sec.img = p.img AND sec.s = p.addr // 8192), solid AS (SELECT img, addr AS a FROM ent WHERE type IN ({_SOLID})) SELECT q.img, q.addr, CASE WHEN q.stop IS NOT NULL THEN least(coalesce(x.a, q.stop), q.stop) - q.addr END AS max_size FROM q ASOF LEFT JOIN solid x ON q.img = x.img AND q.addr < x.a")
def room_of_probes(spark, sf_dir):
    return state(spark, sf_dir).room(probes(spark, sf_dir)).select("img", "addr", "max_size")


@query(f"WITH {ENT}, s AS (SELECT addr, type, size, addr // 8192 AS sec FROM ent WHERE img = 0 AND type IN ({_SOLID})), n AS (SELECT *, lead(addr) OVER (PARTITION BY sec ORDER BY addr) AS nx FROM s) SELECT addr, coalesce(nx, (sec + 1) * 8192) - addr AS max_size FROM n WHERE size IS NULL AND type IN ({', '.join(map(str, schema.MEASURED))})")
def max_sizes(spark, sf_dir):
    s = state(spark, sf_dir)
    return windows.max_sizes(s.entities, s.sections, schema.ORIG)


@query("WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - l_partkey AS estimated_size FROM d")
def estimated_size(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return windows.estimated_sizes(d, ["l_orderkey"], "l_partkey")


_OVER = f"WITH {ENT}, {_M}, a AS (SELECT o.addr AS orig_addr, m.recomp_addr, coalesce(r.name, o.name) AS name, coalesce(r.symbol, o.symbol) AS symbol, coalesce(r.type, o.type) AS type FROM ent o LEFT JOIN m ON m.orig_addr = o.addr LEFT JOIN ent r ON r.addr = m.recomp_addr WHERE o.img = 0 UNION ALL SELECT NULL, addr, name, symbol, type FROM ent WHERE img = 1 AND addr NOT IN (SELECT recomp_addr FROM m)), w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY orig_addr NULLS LAST, recomp_addr) AS nth, count(*) OVER (PARTITION BY name) AS n FROM a WHERE type = 1)"


@query(_OVER + " SELECT orig_addr, recomp_addr, name, symbol, CAST(nth AS INTEGER) AS nth, name || '(' || nth || ')' AS computed_name FROM w WHERE n > 1")
def unique_names(spark, sf_dir):
    return windows.unique_names(windows.overloaded(matchers.symbols(state(spark, sf_dir)).merged()))


@query(f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey % 2 AS img, p_partkey * 16 + {BASE} AS addr, ((p_partkey // 6) * 2 + p_partkey % 2) * 16 + {BASE} AS ref, p_name AS name, p_size FROM part),
 roots AS (SELECT img, addr AS ref, name AS root FROM t WHERE p_size % 5 = 0), kids AS (SELECT * FROM t WHERE p_size % 5 <> 0),
 walk AS (SELECT k, img, addr, ref, p_size, 1 AS d FROM kids UNION ALL SELECT w.k, w.img, w.addr, x.ref, w.p_size, w.d + 1 FROM walk w JOIN kids x ON x.img = w.img AND x.addr = w.ref WHERE w.d < 10 AND x.ref <> w.ref)
 SELECT CAST(w.img AS INTEGER) AS img, w.addr, CASE w.p_size % 5 WHEN 1 THEN 'Thunk of ''' || root || '''' WHEN 2 THEN root || '`vtordisp{{' || w.p_size || ', 0}}''' ELSE root END AS name FROM walk w JOIN roots r ON r.img = w.img AND r.ref = w.ref""")
def thunk_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, kind = F.col("p_partkey"), F.col("p_size") % 5
    ref = (F.floor(k / 6) * 2 + k % 2) * 16 + BASE
    type_ = F.when(kind == 0, schema.FUNCTION).when(kind == 1, schema.THUNK).when(kind == 2, schema.VTORDISP).otherwise(schema.IMPORT_THUNK)
    at = lambda side, c: F.when(k % 2 == side, c)
    shift = F.struct(F.col("p_size").cast("long").alias("d0"), F.lit(0).cast("long").alias("d1"))
    merged = p.select(at(0, k * 16 + BASE).alias("orig_addr"), at(1, k * 16 + BASE).alias("recomp_addr"), type_.alias("type"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("computed_name"), at(0, ref).alias("ref_orig"), at(1, ref).alias("ref_recomp"), shift.alias("displacement"))
    return naming.thunk_names(merged)


@query("""WITH p AS (SELECT DISTINCT user_id, event_id // 500 * 500 AS low, event_id // 500 * 500 + 120 AS high FROM events), c AS (SELECT p.user_id, p.low, p.high, count(DISTINCT e.event_type) AS n, min(e.event_type) AS v FROM p LEFT JOIN events e ON e.user_id = p.user_id AND e.event_id BETWEEN p.low AND p.high GROUP BY ALL)
 SELECT user_id, low, high, n AS n_values, CASE WHEN n = 1 THEN v END AS event_type FROM c""")
def unique_in_range(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    low = F.floor(F.col("event_id") / 500) * 500
    p = e.select("user_id", low.alias("low"), (low + 120).alias("high")).distinct()
    return joins.unique_in_range(p, e, ["user_id"], "low", "high", "event_id", "event_type")


@query(f"WITH {ENT}, s AS (SELECT s_suppkey * 128 AS start, 64 + s_nationkey AS size, s_name FROM supplier) SELECT e.addr, CASE WHEN e.addr < s.start + s.size THEN s.s_name END AS s_name FROM ent e ASOF LEFT JOIN s ON e.addr >= s.start")
def module_of_address(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 128).alias("start"), (F.lit(64) + F.col("s_nationkey")).alias("size"), "s_name")
    return joins.interval_join(entities(spark, sf_dir).select("addr"), s, "addr", columns=("s_name",)).select("addr", "s_name")


_SEQ = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate)"


def _symbols(spark, sf_dir) -> DataFrame:
    """Line items as annotated functions: a file a supplier, in the order of keys."""
    items = table(spark, sf_dir, "lineitem")
    seq = joins.numbered(items, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"], "seq")
    return seq.select(F.concat(F.lit("f"), "l_suppkey", F.lit(".cpp")).alias("path"), F.when(F.col("l_linenumber") == 3, "string").otherwise("function").alias("kind"), F.lit("M").alias("module"), F.col("l_partkey").alias("offset"), F.col("l_returnflag").alias("name"), "seq", F.col("seq").alias("line_number"), F.lit(False).alias("lookup_by_name"), (F.col("l_linenumber") == 7).alias("is_folded"))


_SYM = f"y AS (SELECT 'f' || l_suppkey || '.cpp' AS path, CASE WHEN l_linenumber = 3 THEN 'string' ELSE 'function' END AS kind, 'M' AS module, l_partkey AS \"offset\", l_returnflag AS name, CAST({_SEQ} AS INTEGER) AS seq, l_linenumber = 7 AS is_folded FROM lineitem)"


@query(f"WITH {_SYM}, z AS (SELECT path, seq, \"offset\" < lag(\"offset\") OVER (PARTITION BY path, module ORDER BY seq) AS bad FROM y WHERE kind = 'function' AND NOT is_folded) SELECT CAST(204 AS INTEGER) AS code, path, seq AS line_number FROM z WHERE bad")
def lint_function_order(spark, sf_dir):
    return lint.function_order(_symbols(spark, sf_dir)).select("code", "path", "line_number")


@query(f"WITH {_SYM}, z AS (SELECT *, row_number() OVER (PARTITION BY module, \"offset\" ORDER BY path, seq) AS n FROM y) SELECT path, seq AS line_number FROM z WHERE n > 1 AND NOT is_folded AND kind <> 'string'")
def lint_repeated_offsets(spark, sf_dir):
    return lint.repeated_offsets(_symbols(spark, sf_dir)).select("path", "line_number")


@query(f"WITH {_SYM}, z AS (SELECT *, first_value(name) OVER (PARTITION BY module, \"offset\" ORDER BY path, seq) AS f FROM y WHERE kind = 'string') SELECT path, seq AS line_number FROM z WHERE name <> f")
def lint_changed_strings(spark, sf_dir):
    return lint.changed_strings(_symbols(spark, sf_dir)).select("path", "line_number")


@query(f"WITH {_SYM}, z AS (SELECT *, row_number() OVER (PARTITION BY module, \"offset\" ORDER BY path, seq) AS n FROM y) SELECT path, seq FROM z WHERE n = 1 OR is_folded")
def first_uses(spark, sf_dir):
    return lint.first_uses(_symbols(spark, sf_dir)).select("path", "seq")


@query("WITH z AS (SELECT o_custkey, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM orders) SELECT o_custkey, o_orderkey FROM z WHERE o_totalprice > coalesce(m, 0)")
def rising_values(spark, sf_dir):
    return windows.rising(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey")


# Reports from orders

_REP = """rep AS (SELECT * FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS sample_id, '0x' || lower(to_hex(o_custkey)) AS orig_addr, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '0x' || lower(to_hex(o_custkey + o_orderkey % 3)) END AS recomp_addr, 'f' || o_custkey AS name,
 CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN 5 ELSE 1 END AS type, least(1.0, round(o_totalprice / 400000, 4)) AS accuracy, o_orderkey % 7 = 0 AS is_effective_match, o_orderstatus = 'P' AS is_stub, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1)"""


def samples(spark, sf_dir) -> DataFrame:
    o = joins.numbered(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"], [F.col("o_orderkey").asc_nulls_last()], "rn").where("rn = 1")
    k = F.col("o_orderkey")
    return o.select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("sample_id"), F.lit("a.dll").alias("filename"), codec.to_hex(F.col("o_custkey")).alias("orig_addr"), F.when(k % 11 != 0, codec.to_hex(F.col("o_custkey") + k % 3)).alias("recomp_addr"),
        F.concat(F.lit("f"), "o_custkey").alias("name"), F.when(k % 4 == 3, 5).when(k % 4 != 0, 1).alias("type"), F.least(F.lit(1.0), report.rounded(F.col("o_totalprice") / 400000, 4)).alias("accuracy"), (k % 7 == 0).alias("is_effective_match"), (F.col("o_orderstatus") == "P").alias("is_stub"),
    )


_RANK = "CASE WHEN is_stub THEN -1.0 WHEN accuracy = 1.0 AND NOT is_effective_match THEN 1000.0 WHEN is_effective_match THEN 1.0 ELSE accuracy END"
_EFF = "CASE WHEN is_effective_match THEN 1.0 ELSE accuracy END"


@query(f"WITH {_REP}, b AS (SELECT *, row_number() OVER (PARTITION BY orig_addr ORDER BY {_RANK} DESC, sample_id) AS k FROM rep), v AS (SELECT orig_addr, count(DISTINCT coalesce(recomp_addr, '-')) AS n FROM rep GROUP BY 1) SELECT b.orig_addr, CASE WHEN v.n = 1 THEN recomp_addr ELSE 'various' END AS recomp_addr, name, type, accuracy, is_effective_match, is_stub FROM b JOIN v ON b.orig_addr = v.orig_addr WHERE k = 1")
def combine_reports(spark, sf_dir):
    return reports.combine(samples(spark, sf_dir))


_DIFF = f"""WITH {_REP}, o AS (SELECT * FROM rep WHERE sample_id = 1), n AS (SELECT * FROM rep WHERE sample_id = 5), d AS (SELECT coalesce(o.orig_addr, n.orig_addr) AS orig_addr, o.name AS on_, n.name AS nn, o.accuracy AS oa, n.accuracy AS na, o.is_effective_match AS oe, n.is_effective_match AS ne, o.is_stub AS os, n.is_stub AS ns,
 CASE WHEN o.orig_addr IS NULL THEN 'NEW' WHEN n.orig_addr IS NULL THEN 'DROPPED' WHEN os AND ns THEN 'NO_CHANGE' WHEN os THEN 'INCREASE' WHEN ns THEN 'DECREASE' WHEN oa = 1.0 AND ne THEN 'ENTROPY' WHEN oe AND na = 1.0 THEN 'INCREASE' WHEN oe AND ne THEN 'NO_CHANGE' WHEN oe THEN 'DECREASE' WHEN ne THEN 'INCREASE' WHEN oa < na THEN 'INCREASE' WHEN oa > na THEN 'DECREASE' ELSE 'NO_CHANGE' END AS judgement FROM o FULL JOIN n ON o.orig_addr = n.orig_addr)"""


def _diff(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir)
    return reports.diff(s.where("sample_id = 1"), s.where("sample_id = 5"))


@query(_DIFF + " SELECT orig_addr, judgement FROM d")
def report_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select("orig_addr", "judgement")


@query(_DIFF + """ SELECT judgement, orig_addr, orig_addr || ' - ' || coalesce(nn, on_) || ' (' || CASE WHEN os IS NULL THEN 'new' WHEN os THEN 'stub' ELSE printf('%.2f%%', CASE WHEN oe THEN 100.0 ELSE oa * 100 END) || CASE WHEN oe THEN '*' ELSE '' END END || ' -> ' || CASE WHEN ns IS NULL THEN 'gone' WHEN ns THEN 'stub' ELSE printf('%.2f%%', CASE WHEN ne THEN 100.0 ELSE na * 100 END) || CASE WHEN ne THEN '*' ELSE '' END END || ')' AS line FROM d WHERE judgement <> 'NO_CHANGE'""")
def report_diff_lines(spark, sf_dir):
    return reports.diff_lines(_diff(spark, sf_dir))


_TOT = f"SELECT sample_id, count(*) FILTER (WHERE type = 1 AND NOT is_stub) AS functions, round(coalesce(sum(accuracy) FILTER (WHERE type = 1 AND NOT is_stub), 0), 6) AS accuracy, round(coalesce(sum({_EFF}) FILTER (WHERE type = 1 AND NOT is_stub), 0), 6) AS effective_accuracy, count(*) FILTER (WHERE type = 1 AND orig_addr = recomp_addr) AS aligned, count(*) FILTER (WHERE (type IS NULL OR type = 1) AND NOT is_stub) AS progress_functions, round(coalesce(sum({_EFF}) FILTER (WHERE (type IS NULL OR type = 1) AND NOT is_stub), 0), 6) AS progress_accuracy FROM rep GROUP BY 1"


@query(f"WITH {_REP} {_TOT}")
def report_totals(spark, sf_dir):
    t = reports.totals(samples(spark, sf_dir), ["sample_id"])
    return t.withColumns({c: F.round(c, 6) for c in ("accuracy", "effective_accuracy", "progress_accuracy")})


@query(f"WITH {_REP}, t AS ({_TOT}) SELECT sample_id, round(functions / greatest(functions + 100, 500), 6) AS implemented, round(effective_accuracy / CASE functions WHEN 0 THEN 1 ELSE functions END, 6) AS mean_accuracy, round(effective_accuracy / greatest(functions + 100, 500), 6) AS progress, round(aligned / CASE functions WHEN 0 THEN 1 ELSE functions END, 6) AS alignment FROM t")
def report_summary(spark, sf_dir):
    s = reports.summary(reports.totals(samples(spark, sf_dir), ["sample_id"]), unmatched=100, expected=500)
    return s.select("sample_id", *[F.round(c, 6).alias(c) for c in ("implemented", "mean_accuracy", "progress", "alignment")])


@query(f"WITH {_REP} SELECT sample_id, orig_addr FROM rep WHERE NOT (is_effective_match OR accuracy >= 1) AND NOT is_stub AND (contains(orig_addr, 'f1') OR contains(lower(name), 'f1'))")
def ui_search(spark, sf_dir):
    return reports.search(samples(spark, sf_dir), " F1 ", hide_perfect=True, hide_stubs=True).select("sample_id", "orig_addr")


_PAGED = f"WITH {_REP}, s AS (SELECT sample_id, orig_addr, name, row_number() OVER (ORDER BY {_RANK} DESC, orig_addr, sample_id) AS row FROM rep)"


def _paged(spark, sf_dir) -> DataFrame:
    rows = samples(spark, sf_dir)
    order = [*reports.sort_columns("accuracy", descending=True), F.col("sample_id").asc_nulls_last()]
    return joins.numbered(windows.pages(rows, order, 200), ["page"], order, "row")


@query(_PAGED + " SELECT sample_id, orig_addr, CAST((row - 1) // 200 AS INTEGER) AS page, CAST((row - 1) % 200 + 1 AS INTEGER) AS row FROM s")
def ui_pages(spark, sf_dir):
    return _paged(spark, sf_dir).select("sample_id", "orig_addr", "page", "row")


@query(_PAGED + " SELECT CAST((row - 1) // 200 AS INTEGER) AS page, arg_min(orig_addr, row) AS first, arg_max(orig_addr, row) AS last FROM s GROUP BY 1")
def ui_page_headings(spark, sf_dir):
    return reports.page_headings(_paged(spark, sf_dir), [], "orig_addr")


@query(f"WITH {_REP} SELECT sample_id, orig_addr, recomp_addr, name, type, accuracy, is_effective_match, is_stub FROM rep")
def report_json_round_trip(spark, sf_dir):
    rows, written = samples(spark, sf_dir), None
    for k in range(1, 6):  # a report for each priority
        one = reports_json.to_json(rows.where(F.col("sample_id") == k), "a.dll", 0.0).select(F.lit(k).alias("sample_id"), F.col("value").alias("text"))
        written = one if written is None else written.unionByName(one)
    return reports_json.parse(written).select("sample_id", "orig_addr", "recomp_addr", "name", "type", "accuracy", "is_effective_match", "is_stub")


@query(f"WITH {_REP} SELECT sample_id || ',' || orig_addr || ',' || coalesce(recomp_addr, '') || ',' || name || ',' || coalesce(CAST(type AS VARCHAR), '') AS value FROM rep")
def report_csv(spark, sf_dir):
    return reports_json.to_csv(samples(spark, sf_dir), ["sample_id", "orig_addr", "recomp_addr", "name", "type"])


@query(f"WITH {_REP} SELECT sample_id, orig_addr, CASE WHEN {_EFF} = 1.0 THEN 'green' WHEN {_EFF} > 0.8 THEN 'yellow' ELSE 'red' END AS colour, round({_EFF}, 6) AS effective_accuracy FROM rep")
def percent_colours(spark, sf_dir):
    eff = report.effective_accuracy(F.col("accuracy"), F.col("is_effective_match"))
    return samples(spark, sf_dir).select("sample_id", "orig_addr", report.percent_colour(eff).alias("colour"), F.round(eff, 6).alias("effective_accuracy"))


# Roadmap

_MEAN = "w AS (SELECT l_suppkey, CAST(l_extendedprice AS BIGINT) AS v FROM lineitem), s AS (SELECT *, avg(v) OVER (PARTITION BY l_suppkey) AS m, stddev_pop(v) OVER (PARTITION BY l_suppkey) AS d, count(*) OVER (PARTITION BY l_suppkey) AS n FROM w), a AS (SELECT l_suppkey, CAST(trunc(avg(v)) AS BIGINT) AS mean FROM s WHERE n = 1 OR abs(v - m) <= 2 * d GROUP BY 1)"


def _means(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.round("l_extendedprice").cast("long").alias("v"))
    return windows.mean_without_outliers(items, ["l_suppkey"], "v")


@query(f"WITH {_MEAN.replace('CAST(l_extendedprice AS BIGINT)', 'CAST(round(l_extendedprice) AS BIGINT)')} SELECT l_suppkey, mean FROM a")
def mean_without_outliers(spark, sf_dir):
    return _means(spark, sf_dir)


@query(f"WITH {_MEAN.replace('CAST(l_extendedprice AS BIGINT)', 'CAST(round(l_extendedprice) AS BIGINT)')} SELECT 'n' || s_nationkey AS library, min(mean) AS start FROM a JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def library_order(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), "s_nationkey").alias("lib"), F.col("s_name").alias("module"))
    return roadmap.library_order(_means(spark, sf_dir).join(s, "l_suppkey"))


@query("SELECT DISTINCT 'c' || c_custkey AS module FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def leftover_modules(spark, sf_dir):
    name = lambda k: F.concat(F.lit("c"), F.col(k)).alias("module")
    return roadmap.leftover(table(spark, sf_dir, "customer").select(name("c_custkey")), table(spark, sf_dir, "orders").select(name("o_custkey")))


@query("(SELECT '-' AS side, c_name AS name FROM customer EXCEPT SELECT '-', s_name FROM supplier) UNION ALL (SELECT '+', s_name FROM supplier EXCEPT SELECT '+', c_name FROM customer)")
def target_differences(spark, sf_dir):
    return compare_plans.exports_diff(table(spark, sf_dir, "customer").withColumnRenamed("c_name", "name"), table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "name")).select("side", "name")


# Positional comparison

_SLOT = "t AS (SELECT l_orderkey AS k, list(l_partkey * 16 + 4096 ORDER BY l_partkey, l_linenumber, l_extendedprice) AS s FROM lineitem GROUP BY 1), pair AS (SELECT a.k AS orig_addr, a.s AS o, b.s AS r, least(len(a.s), len(b.s)) AS n FROM t a JOIN t b ON b.k = a.k + 1 WHERE a.k % 2 = 0)"


def _tables(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    slots = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_extendedprice"))).alias("s")).select("l_orderkey", F.transform("s", lambda x: x["l_partkey"] * 16 + BASE).alias("s"))
    a = slots.where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("orig_addr"), F.col("s").alias("orig_slots"), (F.col("l_orderkey") + 1).alias("next"))
    return a.join(slots.select(F.col("l_orderkey").alias("next"), F.col("s").alias("recomp_slots")), "next").drop("next")


@query(f"WITH {ENT}, {_SLOT}, {_M}, z AS (SELECT orig_addr, o[i] AS ov, r[i] AS rv FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM pair)), e AS (SELECT o.addr AS oa, m.recomp_addr AS ra FROM ent o LEFT JOIN m ON m.orig_addr = o.addr WHERE img = 0 UNION ALL SELECT NULL, addr FROM ent WHERE img = 1 AND addr NOT IN (SELECT recomp_addr FROM m)) SELECT z.orig_addr, round(avg(CASE WHEN x.oa IS NOT NULL AND y.ra IS NOT NULL AND x.ra IS NOT DISTINCT FROM y.ra THEN 1.0 ELSE 0.0 END), 6) AS ratio, count(*) AS n_slots FROM z LEFT JOIN e x ON x.oa = z.ov LEFT JOIN e y ON y.ra = z.rv GROUP BY 1")
def vtable_ratio(spark, sf_dir):
    merged = matchers.symbols(state(spark, sf_dir)).merged()
    return compare.vtable_ratio(compare.vtables(_tables(spark, sf_dir), merged)).select("orig_addr", F.round("ratio", 6).alias("ratio"), "n_slots")


@query("WITH e AS (SELECT vec_id, label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings), x AS (SELECT vec_id, unnest(embedding) > 0 AS a, unnest(nx) > 0 AS b FROM e WHERE nx IS NOT NULL) SELECT vec_id, CASE WHEN bool_and(a = b) THEN 'MATCH' WHEN vec_id % 2 = 0 THEN 'WARN' ELSE 'DIFF' END AS verdict, count(*) AS n_items, count(*) FILTER (WHERE a <> b) AS n_different FROM x GROUP BY 1")
def variable_verdicts(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").withColumn("nx", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("nx is not null")
    items = e.select("vec_id", F.explode(F.arrays_zip("embedding", "nx")).alias("x")).select("vec_id", ((F.col("x.embedding") > 0) == (F.col("x.nx") > 0)).alias("equal"), F.lit(None).cast("string").alias("error"), (F.col("vec_id") % 2 == 0).alias("raw_only"))
    return compare.verdicts(items, "vec_id")


@query("WITH p AS (SELECT DISTINCT l_orderkey, l_suppkey % 10 AS a, l_partkey % 10 AS b FROM lineitem) SELECT l_orderkey, a, count(*) AS n_partners, min(b) AS partner FROM p GROUP BY 1, 2")
def bijective_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 10).alias("a"), (F.col("l_partkey") % 10).alias("b")).distinct()
    return compare.partners(p, ("l_orderkey",), "a", "b")


@query("""WITH l AS (SELECT l_orderkey AS k, CAST(l_partkey % 64 AS INTEGER) AS a, CAST(l_suppkey % 64 AS INTEGER) AS b FROM lineitem) SELECT DISTINCT k AS orig_addr, 'ebp' AS orig_register, -CAST(a AS BIGINT) AS orig_offset, CASE WHEN b % 2 = 0 THEN 'ebp' ELSE 'esp' END AS recomp_register, CAST(b AS BIGINT) AS recomp_offset FROM l""")
def stack_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    a = F.concat(F.lit("mov eax, dword ptr [ebp - "), codec.to_hex(F.col("l_partkey") % 64), F.lit("]"))
    b = F.concat(F.lit("mov eax, dword ptr ["), F.when(F.col("l_suppkey") % 64 % 2 == 0, "ebp").otherwise("esp"), F.lit(" + "), codec.to_hex(F.col("l_suppkey") % 64), F.lit("]"))
    blocks = items.select(F.col("l_orderkey").alias("orig_addr"), F.xxhash64(*items.columns).alias("block"), F.array(a, F.lit("ret")).alias("orig"), F.array(b, F.lit("ret")).alias("recomp"))
    return compare.stack_pairs(blocks).select("orig_addr", F.col("orig.register").alias("orig_register"), F.col("orig.offset").alias("orig_offset"), F.col("recomp.register").alias("recomp_register"), F.col("recomp.offset").alias("recomp_offset"))


@query("WITH s AS (SELECT DISTINCT l_orderkey AS type_key, CAST(l_linenumber * 4 AS INTEGER) AS o FROM lineitem), n AS (SELECT *, coalesce(lead(o) OVER (PARTITION BY type_key ORDER BY o), 40) AS nx FROM s) SELECT type_key, o AS \"offset\", CAST(2 AS INTEGER) AS size, 'm' AS name FROM n UNION ALL SELECT type_key, CAST(g AS INTEGER), 1, '(padding)' FROM (SELECT type_key, unnest(range(o + 2, nx)) AS g FROM n)")
def layout_padding(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("type_key"), (F.col("l_linenumber") * 4).alias("offset"), F.lit(2).alias("size"), F.lit(False).alias("signed"), F.lit("m").alias("name"), F.lit(False).alias("is_pointer")).distinct()
    total = s.select("type_key").distinct().withColumn("type_size", F.lit(40))
    return layout.padded(s, total).select("type_key", "offset", "size", "name")


# Text

_PATH = "regexp_replace(url, '^https?://', '')"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS f FROM pages), parts AS (SELECT *, list_reverse(list_filter(string_split_regex(lower(f), '[/\\\\]+'), lambda x: x <> '')) AS c FROM p),
 a AS (SELECT page_id, f, c FROM parts WHERE page_id % 2 = 0), b AS (SELECT f AS l, c AS d FROM parts WHERE page_id % 2 = 1),
 s AS (SELECT a.f, b.l, coalesce(list_position([c[i] IS NOT DISTINCT FROM d[i] AND c[i] IS NOT NULL AND c[i] NOT IN ('.', '..') FOR i IN range(1, greatest(len(c), len(d)) + 1)], FALSE) - 1, greatest(len(c), len(d))) AS score FROM (SELECT DISTINCT f, c FROM a) a JOIN (SELECT DISTINCT l, d FROM b) b ON a.c[1] = b.d[1]),
 t AS (SELECT f, l, score = max(score) OVER (PARTITION BY f) AS top FROM s), u AS (SELECT f, count(*) AS n, min(l) AS l FROM t WHERE top GROUP BY 1)
 SELECT a.page_id, CASE WHEN u.n = 1 THEN u.l END AS local_path FROM a LEFT JOIN u ON u.f = a.f""")
def path_suffix_match(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    foreign = p.where("page_id % 2 = 0").withColumnRenamed("path", "foreign_path")
    local = p.where("page_id % 2 = 1").select(F.col("path").alias("local_path"))
    return text.local_paths(foreign, local).select("page_id", "local_path")


@query("SELECT doc_id, CASE WHEN regexp_matches(hex(encode(text)), '[1-9A-F]') THEN 'NO' WHEN octet_length(encode(text)) < 4 THEN 'YES' ELSE 'MAYBE' END AS state FROM documents")
def init_states(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codec.init_state(F.col("text").cast("binary"), F.lit(4)).alias("state"))


@query("SELECT o_orderkey, '0x' || lower(to_hex(o_orderkey)) AS shown, o_orderkey AS back FROM orders")
def hex_codec(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", codec.to_hex(F.col("o_orderkey")).alias("shown"))
    return o.withColumn("back", codec.from_hex(F.col("shown")))


@query("SELECT o_orderkey, o_orderkey AS number FROM orders")
def encoded_number(spark, sf_dir):
    letters = F.concat(F.translate(F.hex("o_orderkey"), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"), F.lit("@"))
    return table(spark, sf_dir, "orders").select("o_orderkey", codec.encoded_number(letters).alias("number"))


@query("SELECT doc_id, coalesce(regexp_full_match(text, '[\\t\\r\\n\\x20-\\x7f][\\t\\r\\n\\x20-\\x7f\\x{a0}-\\x{ff}]*'), FALSE) AS likely FROM documents")
def latin1_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", entity.likely_latin1(F.col("text")).alias("likely"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations")
def filled_down(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return windows.filled_down(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "heading").select("conv_id", "turn", "heading")


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'FUNCTION' WHEN 'R' THEN 'GLOBAL' ELSE 'HINT' END AS kind, 'M' || l_linestatus AS module, l_partkey AS \"offset\", l_linenumber % 2 = 0 AS strict, l_returnflag <> 'A' AS known FROM lineitem")
def marker_columns(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    word = F.when(F.col("l_returnflag") == "N", "FUNCTION").when(F.col("l_returnflag") == "R", "GLOBAL").otherwise("HINT")
    line = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "// ").otherwise("//  "), word, F.lit(": M"), "l_linestatus", F.lit(" "), codec.to_hex(F.col("l_partkey")))
    return annotations.markers(items.select("l_orderkey", "l_linenumber", line.alias("line"))).select("l_orderkey", "l_linenumber", "kind", "module", "offset", "strict", "known")


@query("SELECT p_partkey, p_name || ' x = \"\";' AS code, replace(p_name, ' ', '_') AS variable FROM part")
def code_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("  "), "p_name", F.lit(' x = "a // {b}"; // note'))
    name = F.concat(F.lit("int "), F.translate("p_name", " ", "_"), F.lit(" = 1;"))
    return p.select("p_partkey", annotations.code_only(line).alias("code"), annotations.variable_name(name).alias("variable"))


@query("WITH p AS (SELECT p_partkey, p_partkey % 3 AS m FROM part) SELECT 4096 + p_partkey AS addr, CASE WHEN m = 0 THEN CAST(1 AS INTEGER) ELSE 2 END AS type, p_partkey * 2 AS size FROM p WHERE m <> 2")
def metadata_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "Function").when(F.col("p_partkey") % 3 == 1, "GLOBAL").otherwise("nonsense")
    body = p.select((F.col("p_partkey") + 2).alias("line_no"), F.concat_ws("|", codec.to_hex(F.col("p_partkey") + 4096), kind, (F.col("p_partkey") * 2).cast("string")).alias("line"))
    head = spark.createDataFrame([(0, "# parts"), (1, "Address|Type|Size")], "line_no long, line string")
    return text.metadata(head.unionByName(body))[0].select("addr", "type", "size")


# Sequences: code of one user against the next


def _streams(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s")).select("user_id", F.transform("s", lambda x: x["event_type"]).alias("s"))
    return per.select("user_id", F.col("s").alias("a"), (F.col("user_id") + 1).alias("next")).join(per.select(F.col("user_id").alias("next"), F.col("s").alias("b")), "next")


@query()
def sequence_ratios(spark, sf_dir):
    return diff.sequences(_streams(spark, sf_dir), keep=["user_id"]).select("user_id", F.round("ratio", 6).alias("ratio"), "effective", F.size("codes").alias("n_codes"))


@query()
def unified_diffs(spark, sf_dir):
    found = diff.sequences(_streams(spark, sf_dir), keep=["user_id", "a", "b"])
    lines = lambda c: F.transform(c, lambda x, i: F.struct(codec.to_hex(i.cast("long")).alias("addr"), x.alias("text")))
    return diff.unified_diffs(found.select("user_id", "codes", lines("a").alias("orig"), lines("b").alias("recomp")), keep=["user_id"])


#: Listings that match in effect, or not; one for each rule and its nearest miss.
LISTINGS = (
    ("cmp eax, dword ptr [ebp - 8] / jg {}", "cmp dword ptr [ebp - 8], eax / jl {}", True),
    ("cmp eax, dword ptr [ebp - 8] / jg {}", "cmp dword ptr [ebp - 8], eax / jg {}", False),
    ("test cl, dl / jne {}", "test dl, cl / jne {}", True),
    ("mov eax, dword ptr [ebp - 4] / cmp eax, dword ptr [ebp - 8] / ja {}", "mov eax, dword ptr [ebp - 8] / cmp eax, dword ptr [ebp - 4] / jb {}", True),
    ("lea eax, [ebp - 4] / cmp eax, dword ptr [ebp - 8] / ja {}", "lea eax, [ebp - 8] / cmp eax, dword ptr [ebp - 4] / jb {}", False),
    ("fld dword ptr [{}] / fmul dword ptr [edi] / ret", "fld dword ptr [edi] / fmul dword ptr [{}] / ret", True),
    ("fld dword ptr [{}] / fdiv dword ptr [edi] / ret", "fld dword ptr [edi] / fdiv dword ptr [{}] / ret", False),
    ("mov edx, {} / add edx, dword ptr [ebp - 4]", "mov edx, dword ptr [ebp - 4] / add edx, {}", True),
    ("mov edx, {} / sub edx, dword ptr [ebp - 4]", "mov edx, dword ptr [ebp - 4] / sub edx, {}", False),
    ("mov eax, {} / push eax / ret", "mov ecx, {} / push ecx / ret", True),
    ("push eax / mov edi, {} / ret", "push ecx / mov edi, {} / ret", False),
    ("inc esi / nop / mov eax, {} / nop / ret", "nop / mov eax, {} / nop / inc esi / ret", True),
    ("inc eax / nop / mov eax, {} / nop / ret", "nop / mov eax, {} / nop / inc eax / ret", False),
    ("mov eax, {} / ret", "mov ax, {} / ret", False),
    ("mov eax, {} / ret", "mov eax, {} / ret", False),  # equal: a match, not an effective one
)


@query("SELECT o_orderkey, list_contains([" + ", ".join(str(i) for i, x in enumerate(LISTINGS) if x[2]) + f"], o_orderkey % {len(LISTINGS)}) AS effective FROM orders")
def effective_matches(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind, label = F.col("o_orderkey") % len(LISTINGS), codec.to_hex(F.col("o_orderkey") + 16)
    def side(k: int) -> Column:
        text = F.get(F.array(*[F.lit(x[k]) for x in LISTINGS]), kind.cast("int"))
        return F.split(F.replace(text, F.lit("{}"), label), " / ")

    return diff.sequences(o.select("o_orderkey", side(0).alias("a"), side(1).alias("b")), keep=["o_orderkey"]).select("o_orderkey", "effective")


@query()
def start_up_elimination(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    samples_ = items.select(F.concat(F.lit("a"), F.col("l_suppkey") % 20).alias("array_type"), (F.col("l_orderkey") % 2).cast("int").alias("img"), F.col("l_orderkey").alias("func_addr"), F.col("l_partkey").alias("used"), (F.col("l_linenumber") % 2 == 0).alias("is_write"), F.col("l_linenumber").cast("long").alias("seq"))
    return naming.eliminate(samples_)
