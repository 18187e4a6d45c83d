"""Row shapes and codes that all operators share."""

from __future__ import annotations

from pyspark.sql import types as T

ORIG, RECOMP = 0, 1

# Codes of entity types, as reports store them.
FUNCTION, DATA, POINTER, STRING, VTABLE, FLOAT, IMPORT = 1, 2, 3, 4, 5, 6, 7
LINE, THUNK, VTORDISP, WIDECHAR, IMPORT_THUNK, LABEL, OFFSET = 8, 9, 10, 11, 12, 13, 14
TYPE_NAMES = {
    FUNCTION: "FUNCTION", DATA: "DATA", POINTER: "POINTER", STRING: "STRING", VTABLE: "VTABLE", FLOAT: "FLOAT", IMPORT: "IMPORT",
    LINE: "LINE", THUNK: "THUNK", VTORDISP: "VTORDISP", WIDECHAR: "WIDECHAR", IMPORT_THUNK: "IMPORT_THUNK", LABEL: "LABEL", OFFSET: "OFFSET",
}
#: Types whose size is measured as the distance to what follows.
MEASURED = (FUNCTION, VTABLE, DATA, IMPORT_THUNK, THUNK, VTORDISP)
#: Types that take up room, so that nothing else can start inside.
SOLID = (*MEASURED, FLOAT, STRING, WIDECHAR)

_long, _str, _bool = T.LongType(), T.StringType(), T.BooleanType()

#: What an entity may have besides its image and address, in column order.
ATTRIBUTES: dict[str, T.DataType] = {
    "type": T.IntegerType(), "name": _str, "computed_name": _str, "symbol": _str,
    "orig_size": _long, "recomp_size": _long, "orig_max_size": _long, "recomp_max_size": _long,
    "ref_orig": _long, "ref_recomp": _long, "displacement": T.StructType([T.StructField("d0", _long), T.StructField("d1", _long)]),
    "stub": _bool, "library": _bool, "skip": _bool, "static_var": _bool, "verified": _bool,
    "parent_function": _long, "base_class": _str, "filename": _str, "line": T.IntegerType(), "data_type": T.IntegerType(),
}
ENTITIES = T.StructType([T.StructField("img", T.IntegerType(), False), T.StructField("addr", _long, False), *[T.StructField(k, v) for k, v in ATTRIBUTES.items()]])
MATCHES = T.StructType([T.StructField("orig_addr", _long), T.StructField("recomp_addr", _long)])
SECTIONS = T.StructType([T.StructField("img", T.IntegerType()), T.StructField("section_id", T.IntegerType()), T.StructField("start", _long), T.StructField("stop", _long)])
EVENTS = T.StructType([T.StructField("event", _str), T.StructField("orig_addr", _long), T.StructField("msg", _str)])
ALERTS = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("path", _str), T.StructField("line_number", T.IntegerType()), T.StructField("detail", _str), T.StructField("target", _str)])

_lines = T.ArrayType(T.ArrayType(_str))
DIFF = T.ArrayType(T.StructType([T.StructField("slug", _str), T.StructField("groups", T.ArrayType(T.StructType([T.StructField("both", _lines), T.StructField("orig", _lines), T.StructField("recomp", _lines)])))]))
#: One compared entity of one report.
REPORT = T.StructType([
    T.StructField("sample_id", T.IntegerType()), T.StructField("filename", _str), T.StructField("orig_addr", _str), T.StructField("recomp_addr", _str), T.StructField("name", _str),
    T.StructField("type", T.IntegerType()), T.StructField("accuracy", T.DoubleType()), T.StructField("is_effective_match", _bool), T.StructField("is_stub", _bool),
])
OPCODES = "array<struct<tag: string, i1: int, i2: int, j1: int, j2: int>>"
