import json

import pytest
from pyspark.sql import functions as F

from twinscope.functions import codec, entity
from twinscope.sources import reports_json, symbol_dump, text

DUMP = r"""*** MODULES

0001 "CMakeFiles/a.dir/x.cpp.obj"
0004 "C:\lib\SHLW32MT.LIB" "check.obj"

*** PUBLICS

S_PUB32: [0003:0001292A], Flags: 00000000, __OP_LOG10jmptab
S_PUB32: [0001:00000010], Flags: 00000000, ?f@@YAXXZ

*** GLOBALS

S_GDATA32: [0003:000004A4], Type:   T_32PRCHAR(0470), g_set

*** SECTION CONTRIBUTIONS

  00DA  0001:00000010  00000073  60501020

*** LINES

  C:\path\to\flags.h (None), 0001:00078040-0007805E, line/addr pairs = 3

     58 00078040     59 00078047
     60 0007805D

*** SYMBOLS

** Module: "CMakeFiles/a.dir/x.cpp.obj"

(000058) S_COMPILE:
(00008C) S_GPROC32: [0001:00000010], Cb: 00000073, Type:             0x1024, f
         Parent: 00000000, End: 00000110, Next: 00000000
         Flags: Frame Ptr Present
(0000C4)  S_REGISTER: ESI, Type:             0x1E14, this
(0000D4)  S_BLOCK32: Parent: 0000008C
(0000E0)   S_BPREL32: [FFFFFFF8], Type:             T_INT4(0074), i
(0000F0)  S_END
(0000F4)  S_LDATA32: [0003:000004A4], Type:   T_32PRCHAR(0470), set
(000110) S_END
(000120) S_LDATA32: [0003:000005A4], Type:   T_32PRCHAR(0470), outside

*** TYPES

0x103b : Length = 14, Leaf = 0x1503 LF_ARRAY
	Element type = T_REAL32(0040)
	Index type = T_SHORT(0011)
	length = 16
	Name =

0x1040 : Length = 50, Leaf = 0x1203 LF_FIELDLIST
	list[0] = LF_BCLASS, public, type = 0x1039, offset = 0
	list[1] = LF_MEMBER, public, type = T_INT4(0074), offset = 8
		member name = 'm_b'
	list[2] = LF_MEMBER, public, type = 0x103B, offset = 4
		member name = 'm_a'

0x1041 : Length = 30, Leaf = 0x1504 LF_CLASS
	# members = 2,  field list type 0x1040, CONSTRUCTOR,
	Derivation list type 0x0000, VT shape type 0x20fb
	Size = 28, class name = MxString, UDT(0x00004db6)

0x1050 : Length = 10, Leaf = 0x1005 LF_OTHER
	nothing
"""


@pytest.fixture(scope="module")
def dump(spark):
    rows = list(enumerate(DUMP.splitlines(), 1))
    return symbol_dump.sections(spark.createDataFrame(rows, "line_no long, line string")).cache()


def test_dump_sections(dump):
    assert [tuple(r)[:4] for r in symbol_dump.code_lines(dump).orderBy("seq").collect()] == [(r"C:\path\to\flags.h", 58, 1, 0x78040), (r"C:\path\to\flags.h", 59, 1, 0x78047), (r"C:\path\to\flags.h", 60, 1, 0x7805D)]
    assert {(r.section, r.offset, r.name) for r in symbol_dump.publics(dump).collect()} == {(3, 0x1292A, "__OP_LOG10jmptab"), (1, 0x10, "?f@@YAXXZ")}
    assert [tuple(r) for r in symbol_dump.globals_(dump).collect()] == [(3, 0x4A4, 0x470, "g_set", True)]
    assert [tuple(r) for r in symbol_dump.contributions(dump).collect()] == [(0xDA, 1, 0x10, 0x73)]
    assert {tuple(r) for r in symbol_dump.modules(dump).collect()} == {(1, None, "CMakeFiles/a.dir/x.cpp.obj"), (4, r"C:\lib\SHLW32MT.LIB", "check.obj")}


def test_functions(dump):
    (f,) = symbol_dump.functions(dump).collect()
    assert (f.type, f.section, f.offset, f.size, f.func_type, f.name, f.frame_pointer_present) == ("S_GPROC32", 1, 0x10, 0x73, 0x1024, "f", True)
    assert [tuple(s) for s in f.symbols] == [("S_REGISTER", "esi", 0x1E14, "this"), ("S_BPREL32", "[fffffff8]", 0x74, "i")]
    assert [tuple(s) for s in f.static_variables] == [(3, 0x4A4, 0x470, "set")]


def test_types(dump):
    got = {r.key: r for r in symbol_dump.records(symbol_dump.leaves(dump)).collect()}
    assert set(got) == {0x103B, 0x1040, 0x1041}
    assert (got[0x103B].array_type, got[0x103B].size) == (0x40, 16)
    assert [tuple(m) for m in got[0x1040].members] == [(4, 0x103B, "m_a"), (8, 0x74, "m_b")] and got[0x1040].supers[0].type == 0x1039
    assert (got[0x1041].name, got[0x1041].size, got[0x1041].field_list, got[0x1041].udt) == ("MxString", 28, 0x1040, 0x4DB6)


def test_collate(dump):
    nodes = symbol_dump.collate(symbol_dump.publics(dump), symbol_dump.contributions(dump), symbol_dump.globals_(dump), symbol_dump.functions(dump))
    got = {(r.section, r.offset): r for r in nodes.collect()}
    assert got[1, 0x10].name == "f" and got[1, 0x10].size == 0x73 and got[1, 0x10].node_type == "FUNCTION"
    assert (3, 0x4A4) not in got


def lines_of(spark, s):
    return spark.createDataFrame(list(enumerate(s.split("\n"), 1)), "line_no long, line string")


def test_metadata(spark):
    rows, errors = text.metadata(lines_of(spark, "# comment\nAddress|Name|Type|size\n\n0x1000|f|library|0x10\n1001|g|stub|7\n// no\nzz|h||\n1002|x|what|\n1003|y||1x"))
    got = {r.addr: r for r in rows.collect()}
    assert set(got) == {0x1000, 0x1001} and got[0x1000].library and got[0x1000].size == 16 and got[0x1001].stub and got[0x1001].library is None
    assert {(r.line_no, r.error, r.value) for r in errors.collect()} == {(7, "InvalidAddress", "zz"), (8, "InvalidEntityType", "what"), (9, "InvalidNumber", "1x")}


@pytest.mark.parametrize("header, message", [("addr", text.NO_DELIMITER), ("symbol|test", text.NO_ADDRESS), ("address|address", text.DUPLICATE_COLUMN), ("", text.NO_DELIMITER)])
def test_metadata_headers(spark, header, message):
    with pytest.raises(text.MetadataError, match=message):
        text.metadata(lines_of(spark, header))


def test_local_paths(spark):
    foreign = spark.createDataFrame([(r"Z:\test\file.cpp",), (r"Z:\test\file.h",), (r"C:\A\B\x.c",), (r"q\y.c",)], "foreign_path string")
    local = spark.createDataFrame([("/test/FILE.cpp",), ("/r/b/x.c",), ("/a/b/x.c",), ("/1/y.c",), ("/2/y.c",)], "local_path string")
    got = {r.foreign_path: r.local_path for r in text.local_paths(foreign, local).collect()}
    assert got == {r"Z:\test\file.cpp": "/test/FILE.cpp", r"Z:\test\file.h": None, r"C:\A\B\x.c": "/a/b/x.c", r"q\y.c": None}


def test_codec(spark):
    row = spark.range(1).select(
        codec.from_hex(F.lit("0xFF")).alias("a"), codec.from_hex(F.lit("zz")).alias("b"), codec.encoded_number(F.lit("BA@")).alias("c"), codec.little_endian(F.unhex(F.lit("01020384")), 0).alias("d"),
        codec.little_endian(F.unhex(F.lit("FFFFFFFF")), 0, 4, True).alias("e"), codec.until_nul(F.unhex(F.lit("41420043"))).alias("f"), entity.likely_latin1(F.lit("ab\u00e9")).alias("g"), entity.likely_latin1(F.lit("\u00e9b")).alias("h"),
        codec.init_state(F.unhex(F.lit("0000")), F.lit(4)).alias("i"), codec.init_state(F.unhex(F.lit("00000100")), F.lit(2)).alias("j"), codec.init_state(F.unhex(F.lit("0000")), F.lit(2)).alias("k"), codec.encoded_number(F.lit("3")).alias("l"),
    ).first()
    assert row[:] == (255, None, 16, 0x84030201, -1, "AB", True, False, "YES", "NO", "MAYBE", 4)


def test_report_round_trip(spark):
    rows = spark.createDataFrame([("0x10", "0x20", "f", 1, 0.5, True, False), ("0x11", None, "g", None, 1.0, False, True)], "orig_addr string, recomp_addr string, name string, type int, accuracy double, is_effective_match boolean, is_stub boolean")
    out = reports_json.to_json(rows, "a.dll", 5.0)
    data = json.loads(out.first().value)
    assert data["data"][1] == {"address": "0x11", "name": "g", "matching": 1.0, "stub": True}
    back = reports_json.parse(out.select(F.lit(0).alias("sample_id"), F.col("value").alias("text")))
    assert back.select(*rows.columns).orderBy("orig_addr").collect() == rows.collect()
    bad = spark.createDataFrame([(0, "{}"), (1, "no"), (2, '{"file":"x","format":2,"timestamp":1,"data":[]}')], "sample_id int, text string")
    assert reports_json.parse(bad).count() == 0
