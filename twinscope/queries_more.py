"""More queries: symbol dumps, annotated code, names, values, debug lines and exports.

As in :mod:`twinscope.queries`, the provided tables stand in for the engine's own; text
that the engine would read from files is written by the query from their columns first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec, display, entity, names
from twinscope.operators import compare, completion, export, layout, lines, lint, matchers, naming, normalise, reports, roadmap, startup
from twinscope.operators.store import State
from twinscope.plans import listings
from twinscope.queries import _NAMES, BASE, ENT, query, samples, state, table, _REP
from twinscope.sources import annotations, images, reports_json, symbol_dump

# Symbol dumps


def _dump(spark, section: str, rows: DataFrame) -> DataFrame:
    """Lines (line_no, line) of one section of a dump, between others."""
    heads = spark.createDataFrame([(-3, "*** IDS"), (-2, "0x1 : nothing"), (-1, f"*** {section}"), (1 << 50, "*** THE END"), ((1 << 50) + 1, "(0000) left out")], "line_no long, line string")
    return symbol_dump.sections(heads.unionByName(rows.select("line_no", "line")))


def _digits(c: Column, n: int = 8) -> Column:
    """Hexadecimal, with zeros up to ``n`` digits; a number that has more keeps them."""
    return F.lpad(F.hex(c), F.greatest(F.length(F.hex(c)), F.lit(n)), "0")


@query("SELECT 'c:\\src\\o' || l_orderkey || '.cpp' AS path, CAST(l_linenumber AS INTEGER) AS line_number, CAST(l_orderkey % 4 + 1 AS INTEGER) AS section, l_partkey AS \"offset\" FROM lineitem")
def dump_lines(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    k, section = F.col("l_orderkey"), _digits(F.col("l_orderkey") % 4 + 1, 4)
    head = items.select("l_orderkey").distinct().select((k * 1000).alias("line_no"), F.concat(F.lit("  c:\\src\\o"), k, F.lit(".cpp (None), "), section, F.lit(":00000000-00000010, line/addr pairs = 2")).alias("line"))
    body = items.select((k * 1000 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("   "), F.col("l_linenumber"), F.lit(" "), _digits(F.col("l_partkey"))).alias("line"))
    return symbol_dump.code_lines(_dump(spark, "LINES", head.unionByName(body))).select("path", "line_number", "section", "offset")


@query("SELECT 'S_PUB32' AS type, CAST(p_size % 9 + 1 AS INTEGER) AS section, p_partkey AS \"offset\", CAST(p_size AS BIGINT) AS flags, '?' || replace(p_name, ' ', '_') || '@@YAXXZ' AS name FROM part")
def dump_publics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("S_PUB32: ["), _digits(F.col("p_size") % 9 + 1, 4), F.lit(":"), _digits(F.col("p_partkey")), F.lit("], Flags: "), _digits(F.col("p_size")), F.lit(", ?"), F.translate("p_name", " ", "_"), F.lit("@@YAXXZ"))
    return symbol_dump.publics(_dump(spark, "PUBLICS", p.select(F.col("p_partkey").alias("line_no"), text.alias("line"))))


@query("SELECT CAST(3 AS INTEGER) AS section, s_suppkey AS \"offset\", CASE WHEN s_suppkey % 2 = 0 THEN CAST(1136 AS INTEGER) ELSE CAST(s_suppkey + 4096 AS INTEGER) END AS type, s_name AS name, s_nationkey % 2 = 0 AS is_global FROM supplier")
def dump_globals(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, "T_32PRCHAR(0470)").otherwise(F.concat(F.lit("0x"), F.hex(F.col("s_suppkey") + 4096)))
    text = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "S_GDATA32").otherwise("S_LDATA32"), F.lit(": [0003:"), _digits(F.col("s_suppkey")), F.lit("], Type:   "), kind, F.lit(", "), "s_name")
    return symbol_dump.globals_(_dump(spark, "GLOBALS", s.select(F.col("s_suppkey").alias("line_no"), text.alias("line"))))


@query("SELECT o_custkey AS module, o_orderkey % 5 + 1 AS section, o_orderkey * 16 AS \"offset\", o_orderkey % 16 + 1 AS size FROM orders")
def dump_contributions(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.concat(F.lit("  "), _digits(F.col("o_custkey"), 4), F.lit("  "), _digits(k % 5 + 1, 4), F.lit(":"), _digits(k * 16), F.lit("  "), _digits(k % 16 + 1), F.lit("  60501020"))
    return symbol_dump.contributions(_dump(spark, "SECTION CONTRIBUTIONS", o.select(k.alias("line_no"), text.alias("line"))))


@query("SELECT CAST(c_custkey AS INTEGER) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'lib' || c_nationkey || '.lib' END AS lib, 'obj/' || c_custkey || '.obj' AS obj FROM customer")
def dump_modules(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lib = F.when(k % 3 == 0, F.concat(F.lit(' "lib'), "c_nationkey", F.lit('.lib"'))).otherwise(F.lit(""))
    text = F.concat(_digits(k, 4), lib, F.lit(' "obj/'), k, F.lit('.obj"'))
    return symbol_dump.modules(_dump(spark, "MODULES", c.select(k.alias("line_no"), text.alias("line"))))


@query("""WITH l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'f' || o_orderkey AS name, CAST(1 AS INTEGER) AS section, o_orderkey * 16 AS "offset", CAST(16 AS BIGINT) AS size, coalesce(n, 0) AS n_symbols, o_orderkey % 3 = 0 AS frame FROM orders LEFT JOIN l ON l.k = o_orderkey""")
def dump_functions(spark, sf_dir):
    o, items, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderkey")
    at = k * 1000
    row = lambda n, text: F.struct((at + n).alias("line_no"), text.alias("line"))
    start = F.concat(F.lit("(000000) S_GPROC32: [0001:"), _digits(k * 16), F.lit("], Cb: 00000010, Type:             T_NOTYPE(0000), f"), k)
    frame = F.when(k % 3 == 0, F.lit("         Flags: Frame Ptr Present")).otherwise(F.lit("         Flags:"))
    body = o.select(F.explode(F.array(row(0, F.when(k % 7 == 0, F.concat(F.lit('** Module: "'), k, F.lit('"'))).otherwise(F.lit(""))), row(1, start), row(2, frame), row(3, F.lit("(000030)  S_BLOCK32: [0001:00000000], Cb: 00000004, ")), row(900, F.lit("(000060)  S_END")), row(901, F.lit("(000070) S_END")))).alias("x")).select("x.*")
    stored = items.select((F.col("l_orderkey") * 1000 + 10 + F.col("l_linenumber")).alias("line_no"), F.concat(F.lit("(000040)   S_BPREL32: ["), _digits(F.col("l_linenumber") * 4), F.lit("], Type:     T_INT4(0074), v"), F.col("l_linenumber")).alias("line"))
    found = symbol_dump.functions(_dump(spark, "SYMBOLS", body.unionByName(stored)))
    return found.select("name", "section", "offset", "size", F.size("symbols").cast("long").alias("n_symbols"), F.coalesce("frame_pointer_present", F.lit(False)).alias("frame"))


@query("""SELECT CAST(4096 + p_partkey AS INTEGER) AS key, CASE p_partkey % 3 WHEN 0 THEN 'LF_ARRAY' WHEN 1 THEN 'LF_MODIFIER' ELSE 'LF_STRUCTURE' END AS leaf, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 2 THEN CAST(p_size * 2 AS BIGINT) END AS size,
 CASE WHEN p_partkey % 3 = 1 THEN CAST(4096 + p_size AS INTEGER) END AS modifies, CASE WHEN p_partkey % 3 = 0 THEN CAST(116 AS INTEGER) END AS array_type, CASE WHEN p_partkey % 3 = 2 THEN replace(p_name, ' ', '_') END AS name FROM part""")
def dump_types(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key, size = F.concat(F.lit("0x"), F.lower(F.hex(k + 4096))), F.col("p_size")
    leaf = F.when(k % 3 == 0, "0x1503 LF_ARRAY").when(k % 3 == 1, "0x1001 LF_MODIFIER").otherwise("0x1505 LF_STRUCTURE")
    head = F.concat(key, F.lit(" : Length = 14, Leaf = "), leaf)
    array = F.concat(F.lit("    Element type = T_INT4(0074)\n    Index type = T_SHORT(0011)\n    length = "), size)
    modifier = F.concat(F.lit("    const, modifies type 0x"), F.lower(F.hex(size + 4096)))
    structure = F.concat(F.lit("    # members = 1,  field list type 0x1fff, \n    Size = "), size * 2, F.lit(", class name = "), F.translate("p_name", " ", "_"), F.lit(", UDT(0x00001ffe)"))
    text = F.split(F.concat(head, F.lit("\n"), F.when(k % 3 == 0, array).when(k % 3 == 1, modifier).otherwise(structure)), "\n")
    rows = p.select(k, F.posexplode(text).alias("i", "line")).select((k * 10 + F.col("i")).alias("line_no"), "line")
    return symbol_dump.records(symbol_dump.leaves(_dump(spark, "TYPES", rows))).select("key", "leaf", F.col("size").cast("long").alias("size"), "modifies", "array_type", "name")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'VTABLE' WHEN 1 THEN 'STRING' WHEN 2 THEN 'FLOAT' WHEN 3 THEN 'IMPORT' WHEN 4 THEN 'FUNCTION' END AS kind, CASE WHEN p_partkey % 6 = 2 THEN CAST(CASE WHEN p_size % 2 = 0 THEN 4 ELSE 8 END AS INTEGER) END AS size FROM part")
def decorated_names(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    word = F.translate("p_name", " ", "_")
    symbol = F.when(k == 0, F.concat(F.lit("??_7"), word, F.lit("@@6B@"))).when(k == 1, F.concat(F.lit("??_C@_04"), word, F.lit("@text@"))).when(k == 2, F.concat(F.lit("__real@"), F.when(F.col("p_size") % 2 == 0, _digits(F.col("p_size"))).otherwise(_digits(F.col("p_size"), 16))))
    symbol = symbol.when(k == 3, F.concat(F.lit("__imp__"), word)).when(k == 4, F.concat(F.lit("?"), word, F.lit("@@YAXXZ"))).otherwise(word)
    return p.select("p_partkey", symbol_dump.node_type(symbol).alias("kind"), symbol_dump.float_size(symbol).cast("int").alias("size"))


# Annotated code


def _files(spark, sf_dir) -> DataFrame:
    """A source file for each supplier: a function, a global and a string, or a mistake."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    mark = lambda kind, n: F.concat(F.lit(f"// {kind}: M"), F.col("s_nationkey") % 2, F.lit(" 0x"), F.lower(F.hex(k * 16 + n)), F.lit("\n"))
    function = F.concat(mark("FUNCTION", 0), F.lit("void f"), k, F.lit("()\n{\n  return;\n}\n"))
    data = F.concat(mark("GLOBAL", 4), F.lit("int g_"), k, F.lit(" = 1;\n"))
    text = F.concat(mark("STRING", 8), F.lit('char* s = "text '), k, F.lit('";\n'))
    wrong = F.when(k % 5 == 0, F.concat(mark("FUNCTION", 12), F.lit("void g();\n"))).otherwise(F.lit(""))
    return s.select(F.concat(F.lit("src/"), k, F.lit(".cpp")).alias("path"), F.concat(function, data, text, wrong).alias("text"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'src/' || s_suppkey || '.cpp' AS path, 'M' || s_nationkey % 2 AS module FROM supplier)
 SELECT path, 'function' AS kind, module, k * 16 AS "offset", 'void f' || k || '()' AS name, CAST(2 AS INTEGER) AS line_number FROM s UNION ALL SELECT path, 'variable', module, k * 16 + 4, 'g_' || k, CAST(7 AS INTEGER) FROM s UNION ALL SELECT path, 'string', module, k * 16 + 8, 'text ' || k, CAST(9 AS INTEGER) FROM s""")
def parsed_code(spark, sf_dir):
    found, _ = annotations.parse(_files(spark, sf_dir))
    return found.select("path", "kind", "module", F.col("offset").cast("long").alias("offset"), "name", F.col("line_number").cast("int").alias("line_number"))


@query("SELECT 'src/' || s_suppkey || '.cpp' AS path, CAST(207 AS INTEGER) AS code FROM supplier WHERE s_suppkey % 5 = 0")
def parser_alerts(spark, sf_dir):
    _, alerts = annotations.parse(_files(spark, sf_dir))
    return lint.in_order(alerts).select("path", F.col("code").cast("int").alias("code"))


@query("SELECT count(*) FILTER (WHERE s_suppkey % 5 = 0) AS errors, CAST(0 AS BIGINT) AS warnings FROM supplier")
def alert_counts(spark, sf_dir):
    return lint.counts(annotations.parse(_files(spark, sf_dir))[1])


@query("SELECT p_partkey, replace(p_name, ' ', '_') || '<int *>' AS class, 'note ' || p_brand AS comment, p_size % 2 = 0 AS blank FROM part")
def code_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.when(F.col("p_size") % 2 == 0, "   // only this").otherwise("int x; // and this")
    return p.select("p_partkey", annotations.class_name(F.concat(F.lit("class "), F.translate("p_name", " ", "_"), F.lit("<int*> : Base {"))).alias("class"), annotations.comment_text(F.concat(F.lit("// note "), "p_brand")).alias("comment"), annotations.blank_or_comment(line).alias("blank"))


# Names

_CHAR = "CASE WHEN c = chr(9) THEN '\\t' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = '\\' THEN '\\\\' WHEN c = '\"' THEN '\\\"' WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 255 THEN '\\x' || lpad(lower(to_hex(unicode(c))), 2, '0') WHEN unicode(c) < 127 THEN c WHEN unicode(c) < 65536 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0') ELSE '\\U' || lpad(lower(to_hex(unicode(c))), 8, '0') END"


@query(f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'L' ELSE '' END || '\"' || array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {_CHAR}), '') || '\"' AS name FROM conversations")
def quoted_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", names.quoted(F.col("text"), F.col("role") == "user").alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size % 10 AS BIGINT) WHEN p_partkey % 4 = 1 THEN p_partkey END AS length, CASE WHEN p_partkey % 4 < 2 THEN p_size % 2 = 1 END AS is_wide FROM part")
def string_symbols(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    letters = F.concat(F.translate(F.hex("p_partkey"), "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"), F.lit("@"))
    length = F.when(k == 0, (F.col("p_size") % 10).cast("string")).when(k == 1, letters).otherwise(F.lit("z"))
    found = names.string_constant(F.concat(F.lit("??_C@_"), F.col("p_size") % 2, length, F.lit("ABCD@"), F.translate("p_name", " ", "?"), F.lit("@")))
    return p.select("p_partkey", found["length"].alias("length"), found["is_wide"].alias("is_wide"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN p_type || '::' || replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', '_') || '<' || p_type || '>' ELSE replace(p_name, ' ', '_') || '<' || p_type || ' *>' END || '::`vftable''' AS name FROM part")
def table_names(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    word, other = F.translate("p_name", " ", "_"), F.col("p_type")
    symbol = F.when(k == 0, F.concat(F.lit("??_7"), word, F.lit("@@6B@"))).when(k == 1, F.concat(F.lit("??_7"), word, F.lit("@"), other, F.lit("@@6B@"))).when(k == 2, F.concat(F.lit("??_7?$"), word, F.lit("@V"), other, F.lit("@@@@6B@"))).otherwise(F.concat(F.lit("??_7?$"), word, F.lit("@PAV"), other, F.lit("@@@@6B@")))
    return p.select("p_partkey", names.table_name(symbol).alias("name"))


@query("SELECT p_partkey, '(' || p_name || ', (' || p_brand || '))' AS arguments FROM part")
def demangled_arguments(spark, sf_dir):
    found = names.demangled(F.concat(F.lit("?"), "p_name", F.lit("@"), "p_brand"), lambda s: "void __thiscall f({}, ({}))".format(*s[1:].split("@")))
    return table(spark, sf_dir, "part").select("p_partkey", names.arguments(found).alias("arguments"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || '[' || replace(p_name, ' ', '_') || '::' || p_brand || '_#]' ELSE p_type || '::' || p_brand END AS space, CASE WHEN p_size % 3 = 0 THEN '_thunk_' ELSE '' END || 'run' AS base FROM part")
def sanitised_names(spark, sf_dir):
    space = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit("<"), "p_name", F.lit("::"), "p_brand", F.lit(" *>"))).otherwise(F.concat("p_type", F.lit("::"), "p_brand"))
    name = F.concat(space, F.lit("::run"))
    found = names.sanitised(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Thunk of '"), name, F.lit("'"))).otherwise(name))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found["namespaces"], "::").alias("space"), found["base"].alias("base"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', 'net:'), '[0-9]+', '#') AS name, regexp_replace(upper(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '(.)\\.[^.]+$', '\\1')), '[^0-9A-Z_]', '', 'g') AS id, CASE WHEN length(split_part(url, '::', 1)) > 20 THEN substr(url, 1, 20) || '...' ELSE url END AS short FROM pages")
def substituted_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    changed = F.regexp_replace(names.substituted(F.col("url"), [("^https?://", "net:")]), "^([^0-9]*)[0-9]+", "$1#")
    return p.select("page_id", changed.alias("name"), names.identifier(F.col("url")).alias("id"), names.shortened(F.col("url")).alias("short"))


@query(f"WITH {ENT} SELECT addr, name || ' (' || {_NAMES} || ')' AS shown, lower(substr({_NAMES}, 1, 3)) AS short FROM ent")
def shown_names(spark, sf_dir):
    return state(spark, sf_dir).entities.select("addr", entity.match_name().alias("shown"), roadmap.type_short("type").alias("short"))


# Values


@query("SELECT doc_id, '\"' || array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '(?s).'), lambda c: " + _CHAR + "), '') || '\"' AS name, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents WHERE doc_id IS NOT NULL")
def completed_strings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    start = (F.col("k") + 1) * (1 << 24)
    memory = docs.select(F.lit(0).alias("img"), F.col("k").cast("int").alias("section_id"), start.alias("start"), (F.octet_length("data") + 8).cast("long").alias("size"), "data")
    rows = docs.select(F.lit(0).alias("img"), start.alias("addr"), F.lit(schema.STRING).alias("type"))
    done = completion.complete(State.of(spark, rows), memory, schema.ORIG, "utf-8")
    return done.entities.select((F.floor(F.col("addr") / (1 << 24)) - 1).alias("doc_id"), "name", F.col("orig_size").alias("size"))


@query(f"WITH {ENT} SELECT addr, size = 8 AS is_double FROM ent WHERE img = 0 AND type = 2 AND size IN (4, 8)")
def floats_without_data(spark, sf_dir):
    rows = state(spark, sf_dir).entities.where(F.col("type") == schema.DATA).withColumns({"type": F.lit(schema.FLOAT), "name": F.lit(None).cast("string")})
    return completion.floats_without_data(rows, schema.ORIG)


@query(f"WITH {ENT} SELECT addr, size FROM ent WHERE img = 1 AND type = 4")
def strings_without_data(spark, sf_dir):
    return completion.strings_without_data(state(spark, sf_dir).entities.withColumn("name", F.lit(None).cast("string")), schema.RECOMP).select("addr", "size")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, (l_partkey * 100 + l_linenumber * 20) % 100 >= CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey % 50 END AS inside FROM lineitem")
def uninitialised_ranges(spark, sf_dir):
    items, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    headers = items.select(k).distinct().select((k * 100).alias("start"), F.lit(100).cast("long").alias("virtual_size"), (k % 50).alias("raw_size"), (k % 3 == 0).alias("uninitialised"))
    probes = items.select("l_orderkey", "l_linenumber", "l_extendedprice", (k * 100 + F.col("l_linenumber") * 20 % 100).alias("addr"))
    return completion.in_ranges(probes, completion.uninitialised_ranges(headers)).drop("addr")


@query("SELECT o_orderkey, o_custkey AS plain, -o_custkey - 1 AS negative, 'k' || o_orderkey AS text FROM orders")
def decoded_bytes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    little = lambda c: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 16, "0"), 15 - 2 * i, 2) for i in range(4)]))
    data = F.concat(little(F.col("o_custkey")), little(-F.col("o_custkey") - 1), F.concat(F.lit("k"), "o_orderkey").cast("binary"), F.unhex(F.lit("00FF")))
    b = o.select("o_orderkey", data.alias("data"))
    return b.select("o_orderkey", codec.little_endian(F.col("data"), 0).alias("plain"), codec.little_endian(F.col("data"), 4, 4, signed=True).alias("negative"), codec.until_nul(F.col("data"), 8).alias("text"))


# Debug lines

_AT = "SELECT event_id % 997 AS addr, 'u' || user_id AS path, CAST(event_id % 300 AS INTEGER) AS line_no, event_id AS seq FROM events"


def _debug_lines(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select((k % 997).alias("addr"), F.concat(F.lit("u"), "user_id").alias("path"), (k % 300).cast("int").alias("line_no"), k.alias("seq"))


@query(f"WITH l AS ({_AT}), m AS (SELECT addr, arg_max(path, seq) AS path, arg_max(line_no, seq) AS line_no FROM l GROUP BY 1) SELECT p_partkey AS addr, path, line_no FROM part LEFT JOIN m ON m.addr = p_partkey")
def line_of_address(spark, sf_dir):
    return lines.line_of(_debug_lines(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("addr")))


@query(f"WITH l AS ({_AT}) SELECT DISTINCT p_partkey AS addr FROM part WHERE p_partkey IN (SELECT addr FROM l)")
def function_starts(spark, sf_dir):
    return lines.starts_in_code(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("addr")), _debug_lines(spark, sf_dir))


@query(f"WITH l AS ({_AT}), p AS (SELECT DISTINCT 'u' || user_id AS path FROM events), h AS (SELECT path, count(DISTINCT addr) AS n, min(addr) AS a FROM l WHERE line_no BETWEEN 40 AND 60 AND addr % 7 = 0 GROUP BY 1) SELECT p.path, coalesce(n, 0) AS n_values, CASE WHEN n = 1 THEN a END AS addr FROM p LEFT JOIN h ON h.path = p.path")
def function_in_lines(spark, sf_dir):
    debug = _debug_lines(spark, sf_dir)
    marked = lines.mark_starts(debug, debug.select("addr").where("addr % 7 = 0"))
    ranges = debug.select("path").distinct().select("path", F.lit(40).alias("low"), F.lit(60).alias("high"))
    return lines.function_in(marked, ranges).select("path", "n_values", "addr")


@query(f"WITH l AS ({_AT}) SELECT 'u' || c.k AS path, l.line_no, l.addr FROM (SELECT DISTINCT user_id AS k FROM events) c JOIN l ON l.path = 'u' || c.k AND l.line_no BETWEEN 100 AND 170")
def lines_in_ranges(spark, sf_dir):
    debug = _debug_lines(spark, sf_dir)
    ranges = debug.select("path").distinct().select("path", F.lit(100).alias("low"), F.lit(170).alias("high"))
    return lines.search(debug, ranges).select("path", "line_no", "addr")


@query(f"WITH l AS ({_AT}), m AS (SELECT addr, arg_max(path, seq) AS path, arg_max(line_no, seq) AS line_no FROM l GROUP BY 1) SELECT p_partkey AS addr, 'nop' || CASE WHEN path IS NULL THEN '' ELSE ' ' || chr(9) || '(' || path || ':' || line_no || CASE WHEN p_size % 2 = 0 THEN ', pinned' ELSE '' END || ')' END AS text FROM part LEFT JOIN m ON m.addr = p_partkey")
def lines_with_source(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("addr"), F.lit("nop").alias("text"), "p_size")
    return lines.with_source(p.drop("p_size"), _debug_lines(spark, sf_dir), p.where("p_size % 2 = 0").select("addr"))


# Start-up lists

_LABEL = "CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(startup.LABELS)) + " END"


@query(f"WITH e AS (SELECT o_orderkey * 4 AS addr, {_LABEL} AS name FROM orders), f AS (SELECT name, min(addr) AS first FROM e WHERE name IS NOT NULL GROUP BY 1), c AS (SELECT CASE WHEN count(*) = {len(startup.LABELS)} THEN max(first) END AS last FROM f) SELECT name, max(addr) AS addr FROM e, c WHERE name IS NOT NULL AND (last IS NULL OR addr <= last) GROUP BY 1")
def start_up_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.get(F.array(*[F.lit(x) for x in startup.LABELS]), (k % 11).cast("int"))
    return startup.labels(table(spark, sf_dir, "orders").select(F.lit(0).alias("img"), (k * 4).alias("addr"), label.alias("name")), schema.ORIG)


@query("SELECT 'L' || l_orderkey AS list, l_partkey AS addr FROM lineitem WHERE l_partkey <> 0")
def start_up_lists(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    little = F.concat(*[F.substring(F.lpad(F.hex("l_partkey"), 16, "0"), 15 - 2 * i, 2) for i in range(4)])
    blocks = items.groupBy(F.concat(F.lit("L"), "l_orderkey").alias("list")).agg(F.unhex(F.array_join(F.collect_list(little), "")).alias("data"))
    return startup.listed(blocks).select("list", "addr")


@query("SELECT o_orderkey * 64 AS addr, CASE WHEN o_orderkey % 3 < 2 AND o_custkey % 32 + 5 <= 16 THEN o_orderkey * 64 + o_custkey % 32 + 5 ELSE o_orderkey * 64 END AS func_addr, CASE WHEN o_orderkey % 3 < 2 AND o_custkey % 32 + 5 <= 16 THEN o_orderkey * 64 END AS thunk_addr FROM orders")
def unwrapped_jumps(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.unhex(F.concat(F.when(k % 3 == 0, "E8").when(k % 3 == 1, "E9").otherwise("90"), F.lpad(F.hex(F.col("o_custkey") % 32), 2, "0"), F.lit("000000")))
    return startup.unwrapped(table(spark, sf_dir, "orders").select((k * 64).alias("addr"), code.alias("code"))).drop("code")


# Matching


@query(f"WITH {ENT}, t AS (SELECT name, max_by(CASE WHEN pk % 6 = 0 THEN addr + 1000000 ELSE addr END, addr) AS o FROM ent WHERE img = 0 GROUP BY 1), r AS (SELECT name, addr AS s, CASE WHEN pk % 5 = 0 THEN addr + 1000000 ELSE addr END AS r FROM ent WHERE img = 1) SELECT o AS orig_addr, min_by(r, s) AS recomp_addr FROM t JOIN r USING (name) GROUP BY 1")
def match_exports(spark, sf_dir):
    e = state(spark, sf_dir).entities
    side = lambda img: e.where(F.col("img") == img).select(F.col("addr").alias("seq"), "addr", "name")
    k = (F.col("addr") - BASE) / 16
    thunks = e.where(((F.col("img") == 0) & (k % 6 == 0)) | ((F.col("img") == 1) & (k % 5 == 0))).select("img", "addr", (F.col("addr") + 1000000).alias("target"))
    return matchers.exports(State.empty(spark), side(0), side(1), thunks).matches


@query("SELECT CAST(4096 AS BIGINT) AS orig_addr, CAST(8192 AS BIGINT) AS recomp_addr")
def match_entry(spark, sf_dir):
    return matchers.entry(state(spark, sf_dir), 4096, 8192).matches


@query("WITH p AS (SELECT l_partkey AS a, l_suppkey AS b, min(l_orderkey * 8 + l_linenumber) AS o FROM lineitem WHERE l_partkey % 7 = l_suppkey % 7 GROUP BY 1, 2), x AS (SELECT a, b FROM p QUALIFY o = min(o) OVER (PARTITION BY a) AND o = min(o) OVER (PARTITION BY b)) SELECT count(*) >= (SELECT count(*) FROM x) AS holds FROM x")
def first_pairs_hold(spark, sf_dir):
    from twinscope.operators import joins

    items = table(spark, sf_dir, "lineitem").where("l_partkey % 7 = l_suppkey % 7").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"))
    pairs = joins.first_pairs(items.withColumn("o", F.struct("o", "a", "b")), "a", "b", "o")
    once = pairs.agg((F.count_distinct("a") == F.count("*")) & (F.count_distinct("b") == F.count("*")))
    return once.toDF("holds")


@query(f"WITH {ENT} SELECT l_orderkey, l_linenumber, l_extendedprice, EXISTS (SELECT 1 FROM ent WHERE ent.img = l_linenumber % 2 AND ent.addr = {BASE} + l_partkey * 16) AS found FROM lineitem")
def existing_addresses(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_linenumber") % 2).cast("int").alias("img"), (F.col("l_partkey") * 16 + BASE).alias("addr"))
    known = state(spark, sf_dir).exists(items.select("img", "addr").distinct()).withColumn("found", F.lit(True))
    return items.join(known, ["img", "addr"], "left").select("l_orderkey", "l_linenumber", "l_extendedprice", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT o_orderkey AS orig_addr, o_custkey AS recomp_addr, o_orderkey * 2 = o_custkey AS is_match FROM orders")
def known_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    matches = o.select(F.col("o_orderkey").alias("orig_addr"), (F.col("o_orderkey") * 2).alias("recomp_addr"))
    return State.of(spark, State.empty(spark).entities, matches).is_match(o.select(F.col("o_orderkey").alias("orig_addr"), F.col("o_custkey").alias("recomp_addr")))


@query("WITH p AS (SELECT p_partkey AS k FROM part) SELECT k AS orig_addr, k + 100000 AS recomp_addr FROM p WHERE k + 100000 BETWEEN 100100 AND 100900")
def lines_in_range(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    rows = p.select(F.lit(0).alias("img"), k.alias("addr"), F.lit(schema.LINE).alias("type")).unionByName(p.select(F.lit(1).alias("img"), (k + 100000).alias("addr"), F.lit(schema.LINE).alias("type")))
    matches = p.select(k.alias("orig_addr"), (k + 100000).alias("recomp_addr"))
    return State.of(spark, rows, matches).lines_in_range(100100, 100900).select("orig_addr", "recomp_addr")


# Comparison and reports


@query(f"WITH {ENT} SELECT l_orderkey AS func_addr, l_orderkey * 100 + l_linenumber AS addr, CASE WHEN e.name IS NOT NULL THEN 'call ' || e.name || ' (FUNCTION)' ELSE 'call far' END AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS k FROM lineitem) l LEFT JOIN ent e ON e.addr = {BASE} + k * 16 AND e.img = 0 AND e.type = 1")
def normalised_calls(spark, sf_dir):
    st = state(spark, sf_dir)
    functions = st.entities.where((F.col("img") == 0) & (F.col("type") == schema.FUNCTION))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    code = items.select(F.lit(0).alias("img"), F.col("l_orderkey").alias("func_addr"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("addr"), F.lit(5).alias("size"), F.lit("call").alias("mnemonic"), codec.to_hex(F.col("k") * 16 + BASE).alias("op_str"))
    found = normalise.normalise(code, State.of(spark, functions))
    return found.select("func_addr", "addr", F.regexp_replace("text", r"<OFFSET\d+>", "far").alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 4 + 1 AS n FROM part) SELECT CAST(1048577 + 2 * k AS INTEGER) AS type_key, CAST(g * 4 AS INTEGER) AS "offset", CAST(CASE WHEN g % 2 = 0 THEN 4 ELSE 2 END AS INTEGER) AS size, 'm' || g AS name FROM (SELECT k, unnest(range(0, n)) AS g FROM p)""")
def flattened_types(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    key = (k * 2 + (1 << 20)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    member = lambda i: F.struct((i * 4).cast("int").alias("offset"), F.when(i % 2 == 0, 0x74).otherwise(0x11).alias("type"), F.concat(F.lit("m"), i.cast("string")).alias("name"))
    fields = p.select(key.alias("key"), F.lit("LF_FIELDLIST").alias("leaf"), none("long").alias("size"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), member).alias("members"), none("int").alias("field_list"))
    types = p.select((key + 1).alias("key"), F.lit("LF_STRUCTURE").alias("leaf"), F.lit(16).cast("long").alias("size"), none("array<struct<offset:int,type:int,name:string>>").alias("members"), key.alias("field_list"))
    records = fields.unionByName(types)
    for c, kind in (("modifies", "int"), ("array_type", "int"), ("udt", "int"), ("underlying_type", "int"), ("bit_type", "int"), ("element_type", "int")):
        records = records.withColumn(c, none(kind))
    records = records.withColumns({"supers": F.array().cast("array<struct<offset:int,type:int>>"), "is_forward_ref": F.lit(False)})
    found = layout.scalars(records).where((F.col("type_key") >= 1 << 20) & (F.col("type_key") % 2 == 1))
    return found.select(F.col("type_key").cast("int").alias("type_key"), F.col("offset").cast("int").alias("offset"), F.col("size").cast("int").alias("size"), "name")


@query("WITH m AS (SELECT l_orderkey AS t, CAST(l_linenumber * 8 AS INTEGER) AS o, 'm' || l_linenumber AS n FROM lineitem GROUP BY ALL) SELECT p.t AS type_key, CAST(20 AS INTEGER) AS \"offset\", arg_max(m.n, m.o) FILTER (WHERE m.o <= 20) AS member, CAST(20 - max(m.o) FILTER (WHERE m.o <= 20) AS INTEGER) AS into FROM (SELECT DISTINCT l_orderkey AS t FROM lineitem) p LEFT JOIN m ON m.t = p.t GROUP BY 1")
def member_at_offset(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    members = items.select(F.col("l_orderkey").alias("type_key"), (F.col("l_linenumber") * 8).cast("int").alias("offset"), F.concat(F.lit("m"), "l_linenumber").alias("name"), F.col("l_linenumber").alias("ordinal"))
    return layout.member_at(members, items.select(F.col("l_orderkey").alias("type_key"), F.lit(20).alias("offset")).distinct()).withColumn("into", F.col("into").cast("int"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_partkey % 3 = 0 THEN 'ebp + 0x' || lpad(lower(to_hex(l_suppkey + 1)), CAST(greatest(2, length(to_hex(l_suppkey + 1))) AS INTEGER), '0') ELSE 'esp - 0x' || lpad(lower(to_hex(l_suppkey + 1)), CAST(greatest(2, length(to_hex(l_suppkey + 1))) AS INTEGER), '0') END || CASE WHEN l_linenumber % 2 = 0 THEN '  v' || l_linenumber ELSE '' END AS place, CASE WHEN l_linenumber > 1 THEN 'ERROR' WHEN l_partkey = l_suppkey THEN 'CHECK' ELSE 'SWAP' END AS mark FROM lineitem")
def stack_texts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    up = F.col("l_partkey") % 3 == 0
    offset = (F.col("l_suppkey") + 1) * F.when(up, 1).otherwise(-1)
    symbol = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("v"), "l_linenumber"))
    return items.select("l_orderkey", "l_linenumber", "l_extendedprice", display.stack_offset_text(F.when(up, "ebp").otherwise("esp"), offset, symbol).alias("place"), display.stack_mark(F.col("l_linenumber"), F.col("l_partkey") == F.col("l_suppkey")).alias("mark"))


@query("SELECT o_orderkey, lpad('+ 0x' || lpad(lower(to_hex(o_custkey)), CAST(greatest(2, length(to_hex(o_custkey))) AS INTEGER), '0'), 10, ' ') || ' ' || CASE WHEN o_orderkey % 4 = 0 THEN '  ' || repeat(' ', 30) ELSE ': ' || rpad(o_orderpriority, 30, ' ') END || ' ' || o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' : ' || o_custkey END AS line FROM orders")
def compared_lines(spark, sf_dir):
    k = F.col("o_orderkey")
    line = display.compared_line(F.col("o_custkey"), F.when(k % 4 != 0, F.col("o_orderpriority")), F.col("o_orderstatus"), F.col("o_custkey").cast("string"), k % 2 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query(f"WITH {ENT} SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_partkey % 10 = 0 THEN 'nullptr' WHEN e.name IS NULL THEN 'Unknown pointer 0x' || lower(to_hex({BASE} + l_partkey * 16)) ELSE 'Pointer to ' || e.name || ' (' || {_NAMES} || ')' END AS text FROM lineitem LEFT JOIN ent e ON e.img = 0 AND e.addr = {BASE} + l_partkey * 16")
def pointer_texts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey") * 16 + BASE).otherwise(0).alias("addr"))
    named = state(spark, sf_dir).side(schema.ORIG).select("addr", entity.match_name().alias("shown"))
    return items.join(named, "addr", "left").select("l_orderkey", "l_linenumber", "l_extendedprice", display.pointer_text(F.col("addr"), F.col("shown")).alias("text"))


@query(f"WITH {_REP} SELECT sample_id, orig_addr, CASE WHEN type = 5 THEN 'all' WHEN is_effective_match OR accuracy <> 1.0 THEN 'part' END AS diff FROM rep")
def shown_diffs(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", "orig_addr", reports.shown_diff(F.lit(None).cast("string"), F.lit("all"), F.lit("part")).alias("diff"))


@query("SELECT event_type AS error, 's' || user_id % 9 AS subject, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2")
def failure_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("error"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("subject"))
    return reports.failure_counts(e)


@query("WITH e AS (SELECT event_id AS seq, event_type AS error, 's' || user_id % 9 AS subject FROM events) SELECT seq, error, subject FROM e WHERE error <> 'click' UNION ALL SELECT min(seq), error, subject FROM e WHERE error = 'click' GROUP BY 2, 3")
def first_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("error"), F.concat(F.lit("s"), F.col("user_id") % 9).alias("subject"))
    return reports.first_failures(e, ["click"])


@query("SELECT p_partkey AS at, CAST(-1 AS INTEGER) AS n, '; ' || p_name AS line FROM part UNION ALL SELECT p_partkey, CAST(0 AS INTEGER), rpad('0x' || lower(to_hex(p_partkey)), 10, ' ') || ': ' || p_type FROM part UNION ALL SELECT p_partkey, CAST(1 AS INTEGER), '        : ' || p_brand FROM part")
def assembly_dumps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    line = F.array(F.struct(codec.to_hex(F.col("p_partkey")).alias("addr"), F.col("p_type").alias("text")), F.struct(F.lit("").alias("addr"), F.col("p_brand").alias("text")))
    return roadmap.dumps(p.select(F.col("p_partkey").alias("at_"), F.col("p_name").alias("name"), line.alias("lines")), "at_")


@query("SELECT p_partkey AS addr, p_size * 100 AS size, CAST(p_size % 2 AS INTEGER) AS problem FROM part WHERE p_size % 2 = 0 OR p_partkey % 3 = 0")
def oversized_tables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    slots = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(1), F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = p.select(F.col("p_partkey").alias("addr"), (F.col("p_size") * 100).alias("size"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(10**6).alias("orig_max_size"), slots.alias("orig_slots"), (F.col("p_size") % 2).cast("int").alias("problem"))
    return compare.oversized_vtables(rows).select("addr", "size", "problem")


# Exports


@query("SELECT o_orderkey AS orig_addr, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 50 AS INTEGER) END AS return_type, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 50 < 30 THEN o_custkey % 50 + 1 END AS n_arguments FROM orders")
def signatures(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    matches = o.select(F.col("o_orderkey").alias("orig_addr"), (F.col("o_orderkey") + 10**6).alias("recomp_addr"))
    symbols = o.where("o_orderkey % 2 = 0").select((F.col("o_orderkey") + 10**6).alias("addr"), F.lit("f").alias("name"), (F.col("o_custkey") % 50 + 4096).cast("int").alias("func_type"))
    none = F.lit(None)
    kinds = spark.range(50).select((F.col("id") + 4096).cast("int").alias("key"), F.col("id").cast("int").alias("return_type"), none.cast("string").alias("call_type"), none.cast("int").alias("class_type"), none.cast("long").alias("this_adjust"), (F.col("id") + 5000).cast("int").alias("arg_list_type"), none.cast("array<int>").alias("args"))
    lists = spark.range(30).select((F.col("id") + 5000).cast("int").alias("key"), none.cast("int").alias("return_type"), none.cast("string").alias("call_type"), none.cast("int").alias("class_type"), none.cast("long").alias("this_adjust"), none.cast("int").alias("arg_list_type"), F.sequence(F.lit(0), F.col("id").cast("int")).alias("args"))
    found = export.signatures(matches, symbols, kinds.unionByName(lists))
    return found.select("orig_addr", "return_type", F.when(F.col("arguments").isNotNull(), F.size("arguments").cast("long")).alias("n_arguments"))


@query("SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS is_new FROM orders WHERE o_orderkey % 5 = 0 OR o_orderstatus = 'F'")
def changed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), "o_custkey")
    known = o.where("k % 5 <> 0").withColumn("status", F.when(F.col("status") == "F", F.lit(None)).otherwise(F.col("status")))
    return export.changed(known, o, "k", ("status", "o_custkey")).select("k", "is_new")


@query("SELECT l_orderkey AS function, l_linenumber AS ordinal, CASE WHEN l_linenumber % 2 = 1 THEN 'r' || l_linenumber WHEN l_linenumber = 2 THEN 's' || l_linenumber END AS name FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def parameter_names(spark, sf_dir):
    items, n = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), F.col("l_linenumber")
    odd = n % 2 == 1
    parameters = items.select(F.col("l_orderkey").alias("function"), n.alias("ordinal"), F.when(odd, F.concat(F.lit("R"), n)).alias("register"), F.when(~odd, (n * 8).cast("long")).alias("stack_offset"))
    stored = items.where(odd | (n == 2)).select(F.col("l_orderkey").alias("function"), F.when(odd, F.concat(F.lit("r"), n)).otherwise(F.concat(F.lit("["), F.hex(n * 8), F.lit("]"))).alias("location"), F.concat(F.when(odd, "r").otherwise("s"), n).alias("name"))
    return export.parameter_names(parameters, stored).select("function", "ordinal", "name")


# Patterns in code


@query("SELECT o_orderkey AS path_key, 4 + o_custkey % 7 AS addr, o_custkey + 4096 AS target FROM orders")
def code_jumps(spark, sf_dir):
    """Absolute jumps in code that each order's row writes, by the scan that images use."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    little = F.concat(*[F.substring(F.lpad(F.hex(k + 4096), 16, "0"), 15 - 2 * i, 2) for i in range(4)])
    code = F.unhex(F.concat(F.repeat(F.lit("90"), (4 + k % 7).cast("int")), F.lit("FF25"), little, F.lit("C3")))

    def work(batches):
        for pdf in batches:
            rows = [(key, at, to) for key, data in zip(pdf["o_orderkey"], pdf["code"]) for at, to in images.jumps(bytes(data))]
            yield pdf.__class__(rows, columns=["path_key", "addr", "target"])

    return o.select("o_orderkey", code.alias("code")).mapInPandas(work, "path_key long, addr long, target long")


@query("WITH s AS (SELECT o_custkey % 40 AS used, o_orderkey % 2 AS img, o_orderkey AS f FROM orders) SELECT count(*) = count(DISTINCT f) AS once FROM s")
def start_up_pairs_once(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("L"), F.col("o_custkey") % 40).alias("list"), (k % 2).cast("int").alias("img"), k.alias("func_addr"), F.floor(F.col("o_custkey") / 40).alias("used"), F.lit(True).alias("is_write"), k.alias("seq"))
    found = naming.eliminate(rows, "list")
    return found.agg((F.count("*") == F.count_distinct("orig_addr")) & (F.count("*") == F.count_distinct("recomp_addr"))).toDF("once")


_STACK = "l AS (SELECT DISTINCT l_orderkey AS k, 'ebp' AS r1, -CAST(l_partkey % 64 AS BIGINT) AS o1, CASE WHEN l_suppkey % 2 = 0 THEN 'ebp' ELSE 'esp' END AS r2, CAST(l_suppkey % 64 AS BIGINT) AS o2 FROM lineitem)"


@query(f"WITH {_STACK}, s AS (SELECT k, 'orig' AS side, r1 AS register, o1 AS o, r1 = r2 AND o1 = o2 AS same FROM l UNION ALL SELECT k, 'recomp', r2, o2, r1 = r2 AND o1 = o2 FROM l) SELECT k AS orig_addr, side, register, o AS \"offset\", CASE WHEN count(*) <> 1 THEN 'ERROR' WHEN bool_and(same) THEN 'CHECK' ELSE 'SWAP' END AS mark FROM s GROUP BY k, side, register, o")
def stack_listing(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    a = F.concat(F.lit("mov eax, dword ptr [ebp - "), codec.to_hex(F.col("l_partkey") % 64), F.lit("]"))
    b = F.concat(F.lit("mov eax, dword ptr ["), F.when(F.col("l_suppkey") % 2 == 0, "ebp").otherwise("esp"), F.lit(" + "), codec.to_hex(F.col("l_suppkey") % 64), F.lit("]"))
    blocks = items.select(F.col("l_orderkey").alias("orig_addr"), F.xxhash64(*items.columns).alias("block"), F.array(a).alias("orig"), F.array(b).alias("recomp"))
    return listings.stacks(blocks).select("orig_addr", "side", "register", "offset", "mark")


@query("SELECT DISTINCT o_custkey * 7 AS addr, CAST(n_nationkey + 1 AS INTEGER) AS section, CASE WHEN n_nationkey IS NOT NULL THEN o_custkey * 7 - n_nationkey * 1000 END AS \"offset\" FROM orders LEFT JOIN nation ON o_custkey * 7 >= n_nationkey * 1000 AND o_custkey * 7 < n_nationkey * 1000 + 600")
def section_places(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("a").alias("path"), F.lit("section").alias("kind"), (F.col("n_nationkey").cast("long") * 1000).alias("addr"), F.lit(600).cast("long").alias("size"))
    places = table(spark, sf_dir, "orders").select(F.lit("a").alias("path"), (F.col("o_custkey") * 7).alias("addr")).distinct()
    return images.to_section(n, places).select("addr", F.col("section").cast("int").alias("section"), "offset")


# Reports, lint and roadmap

_EFFECTIVE = "CASE WHEN is_effective_match THEN 1.0 ELSE accuracy END"


@query(f"WITH {_REP} SELECT orig_addr, name || ' (' || orig_addr || ' / ' || coalesce(recomp_addr, 'n/a') || ') is ' || CASE WHEN is_stub THEN 'stub' ELSE printf('%.2f%%', 100 * {_EFFECTIVE}) || CASE WHEN is_effective_match THEN '*' ELSE '' END END || ' similar to the original' AS line FROM rep")
def one_line_matches(spark, sf_dir):
    return reports_json.one_line(samples(spark, sf_dir))


@query(f"WITH {_REP} SELECT sample_id, orig_addr FROM rep WHERE NOT (CAST(substr(name, 2) AS BIGINT) % 10 = 3) AND NOT coalesce(type = 5, FALSE)")
def rows_without_ignored(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("library", F.coalesce(F.col("type") == 5, F.lit(False)))
    ignored = rows.select("name").distinct().where(F.substring("name", 2, 20).cast("long") % 10 == 3)
    return reports.without(rows, ignored, libraries=False).select("sample_id", "orig_addr")


def _symbols(spark, sf_dir) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat(F.lit("src/"), "p_brand", F.when(k % 3 == 0, ".h").otherwise(".cpp"))
    return p.select(path.alias("path"), k.alias("line_number"), F.lit("function").alias("kind"), (F.col("p_size") % 2 == 0).alias("lookup_by_name"), F.col("p_name").alias("name"), F.col("p_type").alias("module"), (k * 16).alias("offset"), F.lit(False).alias("is_folded"), k.alias("seq"))


@query("SELECT CAST(109 AS INTEGER) AS code, 'src/' || p_brand || '.cpp' AS path, p_partkey AS line_number, p_name AS detail, p_type AS target FROM part WHERE p_partkey % 3 <> 0 AND p_size % 2 = 0")
def by_name_alerts(spark, sf_dir):
    return lint.by_name_outside_headers(_symbols(spark, sf_dir))


@query("SELECT p_partkey AS line_number, p_size > 10 AS usable FROM part")
def usable_symbols(spark, sf_dir):
    good, bad = lint.usable(_symbols(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_number"), "p_size"), "line_number"), F.col("p_size") > 10)
    return good.select("line_number", F.lit(True).alias("usable")).unionByName(bad.select("line_number", F.lit(False).alias("usable")))


@query("SELECT p_partkey, 'CMakeFiles/' || p_type || '.dir/' AS prefix, 'src/' || replace(p_name, ' ', '_') || '.cpp' AS short FROM part")
def module_names(spark, sf_dir):
    module = F.concat(F.lit("CMakeFiles/"), "p_type", F.lit(".dir/src/"), F.translate("p_name", " ", "_"), F.lit(".cpp.obj"))
    return table(spark, sf_dir, "part").select("p_partkey", roadmap.module_prefix(module).alias("prefix"), roadmap.short_name(module).alias("short"))


@query("SELECT event_type AS event, CASE event_type WHEN 'click' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def event_severities(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", matchers.NO_MATCH).when(F.col("event_type") == "view", matchers.AMBIGUOUS_MATCH).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("event"), matchers.severity(name).alias("severity")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 's' || l_suppkey % 50 AS module, l_partkey * 16 + 4096 AS a, l_partkey * 16 + 4096 + l_suppkey AS r FROM lineitem), s AS (SELECT *, avg(a) OVER w AS mean, stddev_pop(a) OVER w AS dev, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY module))
 SELECT x.module, x.mean, y.earliest, y.moved AS mean_displacement FROM (SELECT module, CAST(trunc(avg(a)) AS BIGINT) AS mean FROM s WHERE n = 1 OR abs(a - mean) <= 2 * dev GROUP BY 1) x JOIN (SELECT module, min(a) AS earliest, CAST(trunc(avg(r - a)) AS BIGINT) AS moved FROM m GROUP BY 1) y USING (module)""")
def module_order(spark, sf_dir):
    a = F.col("l_partkey") * 16 + 4096
    road = table(spark, sf_dir, "lineitem").select(F.lit("fun").alias("row_type"), F.concat(F.lit("s"), F.col("l_suppkey") % 50).alias("module"), a.alias("orig_addr"), F.col("l_suppkey").alias("displacement"), F.lit(None).cast("string").alias("lib"))
    return roadmap.module_order(road, "fun").select("module", "mean", "earliest", "mean_displacement")


@query("SELECT p_partkey * 16 + 8192 AS orig_addr, p_partkey * 16 + 8192 + p_size AS recomp_addr, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) END AS displacement, '0001:' || lpad(upper(to_hex(p_partkey * 16 + 4096)), 8, '0') AS orig_place, 'obj' || (p_partkey * 16 + 8192 + p_size - 4096) // 4096 AS module FROM part")
def roadmap_rows(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    matches = p.select((k * 16 + 8192).alias("orig_addr"), (k * 16 + 8192 + F.col("p_size")).alias("recomp_addr"), F.lit(schema.FUNCTION).alias("type"), F.col("p_name").alias("name"), (k % 2).alias("half"))
    # Sections of one name where keys are even, of different names where they are odd.
    sections = lambda same: spark.createDataFrame([(0, 1, 4096, 1 << 40, "a"), (1, 1, 4096, 1 << 40, "a" if same else "b")], "img int, section_id int, start long, stop long, name string")
    span = spark.range(p.count() // 256 + 4)
    contributions = span.select((F.col("id") * 4096 + 4096).alias("start"), F.lit(4096).cast("long").alias("size"), F.col("id").alias("module"))
    modules = span.select(F.col("id").cast("int").alias("id"), F.concat(F.lit("obj"), "id").alias("obj"), F.lit(None).cast("string").alias("lib"))
    found = [roadmap.rows(matches.where(F.col("half") == i).drop("half"), sections(i == 0), contributions, modules) for i in (0, 1)]
    return found[0].unionByName(found[1]).select("orig_addr", "recomp_addr", "displacement", "orig_place", "module")


@query("SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) AS blocks FROM orders")
def diff_block_counts(spark, sf_dir):
    lines_ = F.array(F.array(F.lit("0x1"), F.lit("nop")))
    none = F.lit(None).cast("array<array<string>>")
    block = lambda i: F.struct(F.when(i % 2 == 0, lines_).otherwise(none).alias("both"), F.when(i % 2 == 1, lines_).otherwise(none).alias("orig"), none.alias("recomp"))
    groups = F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 5 * 2).cast("int")), block)
    diff_ = F.array(F.struct(F.lit("@@").alias("slug"), groups.alias("groups")))
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.diff_blocks(diff_).cast("int").alias("blocks"))


# Places and pointers


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, (l_partkey = 0 AND l_suppkey = 0) OR (l_partkey // 8 = l_suppkey // 8 AND l_partkey % 8 = l_suppkey % 8) AS pointer_equal FROM lineitem")
def equal_pointers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    # Matches at every eighth address; a pointer belongs to the last one at or before it.
    starts = items.select(F.floor(F.col("l_partkey") / 8).alias("k")).unionByName(items.select(F.floor(F.col("l_suppkey") / 8).alias("k"))).distinct()
    rows = starts.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("img"), (F.col("k") * 8 + 1).alias("addr"))
    matches = starts.select((F.col("k") * 8 + 1).alias("orig_addr"), (F.col("k") * 8 + 1).alias("recomp_addr"))
    pairs = items.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", (F.col("l_partkey") + 1).alias("orig_value"), (F.col("l_suppkey") + 1).alias("recomp_value"))
    found = compare.pointers_equal(pairs, State.of(spark, rows, matches))
    return found.select("l_orderkey", "l_linenumber", "l_extendedprice", "pointer_equal")


@query("SELECT DISTINCT o_custkey * 9 AS addr FROM orders WHERE o_custkey * 9 >= 1000 AND o_custkey * 9 < 1000 + 100 + (SELECT max(n_nationkey) FROM nation) * 200")
def valid_addresses(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("a").alias("path"), F.lit("section").alias("kind"), (F.col("n_nationkey").cast("long") * 200 + 1000).alias("addr"), F.lit(100).cast("long").alias("size"))
    image = spark.createDataFrame([("a", "image", 1000, None)], "path string, kind string, addr long, size long")
    return images.valid_address(n.unionByName(image), table(spark, sf_dir, "orders").select(F.lit("a").alias("path"), (F.col("o_custkey") * 9).alias("addr")).distinct()).select("addr")


@query("SELECT s_suppkey AS addr FROM supplier WHERE s_nationkey % 8 >= 4 AND s_nationkey % 2 = 0")
def image_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.lit("section").alias("kind"), F.col("s_suppkey").alias("addr"), F.col("s_nationkey").cast("long").alias("n1"))
    return images.regions(rows, 4, 1).select("addr")


@query("SELECT DISTINCT l_orderkey AS func_addr, l_partkey * 16 + 1048576 AS used, l_linenumber = 1 AS is_write, (l_orderkey * 100 + l_linenumber) * 16 + CASE WHEN l_linenumber = 1 THEN 0 ELSE 8 END AS seq FROM lineitem WHERE l_partkey % 3 <> 0")
def start_up_samples(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    place = F.concat(F.lit("dword ptr ["), codec.to_hex(F.col("l_partkey") * 16 + (1 << 20)), F.lit("]"))
    operands = F.when(F.col("l_linenumber") == 1, F.concat(place, F.lit(", eax"))).otherwise(F.concat(F.lit("eax, "), place))
    at = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    code = items.select(F.lit(0).alias("img"), F.col("l_orderkey").alias("func_addr"), at.alias("addr"), F.lit("mov").alias("mnemonic"), operands.alias("op_str"))
    ends = items.select("l_orderkey").distinct().select(F.lit(0).alias("img"), F.col("l_orderkey").alias("func_addr"), (F.col("l_orderkey") * 100 + 50).alias("addr"), F.lit("ret").alias("mnemonic"), F.lit("").alias("op_str"))
    known = items.where("l_partkey % 3 <> 0").select(F.lit(0).alias("img"), (F.col("l_partkey") * 16 + (1 << 20)).alias("addr")).distinct().withColumn("orig_addr", F.col("addr"))
    return naming.fingerprints(code.unionByName(ends), known).select("func_addr", "used", "is_write", "seq").distinct()
