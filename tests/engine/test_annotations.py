from pyspark.sql import functions as F

from twinscope.sources import annotations as an


def read(text, **aliases):
    r = an.Reader("a/test.cpp", aliases)
    for line in text.splitlines():
        r.read(line)
    r.finish()
    return r


def codes(r):
    return [a[0] for a in r.alerts]


def test_function():
    r = read("// FUNCTION: TEST 0x1000\nvoid f()\n{\n  int x;\n}\n")
    (s,) = r.symbols
    assert (s["offset"], s["name"], s["line_number"], s["end_line"], s["module"]) == (0x1000, "void f()", 2, 5, "TEST")
    assert not r.alerts


def test_several_modules_and_duplicates():
    r = read("// FUNCTION: A 0x1\n// FUNCTION: B 0x2\n// FUNCTION: A 0x3\nint f() { return 1; }\n")
    assert [s["offset"] for s in r.symbols] == [1, 2]
    assert codes(r) == [102]


def test_named_by_comment():
    r = read("// SYNTHETIC: A 0x1\n// Pizza::`scalar deleting destructor'\n// LIBRARY: A 0x2\nint x;\n")
    assert r.symbols[0]["lookup_by_name"] and r.symbols[0]["name"] == "Pizza::`scalar deleting destructor'"
    assert codes(r) == [203]


def test_variables_and_strings():
    r = read('// GLOBAL: A 0x1\nint g_x = 5;\n// STRING: A 0x2\nreturn "hi\\n";\n// FUNCTION: A 0x10\nvoid f()\n{\n  // GLOBAL: A 0x3\n  static int s[4];\n}\n')
    assert [(s["kind"], s["name"]) for s in r.symbols] == [("variable", "g_x"), ("string", "hi\n"), ("variable", "s"), ("function", "void f()")]
    assert r.symbols[2]["is_static"] and r.symbols[2]["parent_function"] == 0x10


def test_scopes_and_vtables():
    r = read("namespace N\n{\n// VTABLE: A 0x1\n// VTABLE: A 0x2 Base\nclass P : Base {\n};\n}\n")
    assert [(s["name"], s["base_class"]) for s in r.symbols] == [("N::P", None), ("N::P", "Base")]


def test_recovery():
    assert codes(read("// FUNCTION: A 0x1\nvoid f();\n")) == [207]
    assert codes(read("// FUNCTION: A 0x1\n// GLOBAL: A 0x2\nint x;\n")) == [202]
    assert codes(read("// FUNCTION: A 0x1\nvoid f()\n// FUNCTION: A 0x2\n")) == [201]
    assert codes(read("// FUNCTION: A 0x1\nvoid f()\n{\n// FUNCTION: A 0x2\nvoid g() { }\n")) == [105]
    assert codes(read("//FUNCTION: A 0x1\n\n{\n}\n")) == [101, 107, 106]
    assert codes(read("// WHAT: A 0x1\n")) == [104]
    assert codes(read("// FUNCTION: A 0x1\n")) == [108]


def test_aliases():
    r = read("// FUNC: A 0x1\nint f() { }\n", A={"func": "function", "STUB": "FUNCTION", "other": "nothing"})
    assert r.symbols[0]["marker_type"] == "FUNCTION"


def test_columns(spark):
    lines = spark.createDataFrame([("// FUNCTION: hello 0x10 FOLDED",), ("//stub: A 0xZ",), ("// LINE: A 0x1f",), (None,)], "line string")
    got = an.markers(lines).orderBy("offset").collect()
    assert [(r.kind, r.module, r.offset, r.extra, r.strict) for r in got] == [("FUNCTION", "HELLO", 16, "FOLDED", False), ("LINE", "A", 31, None, True)]
    one = spark.createDataFrame([("int a[4]; // x {",)], "l string")
    assert one.select(an.variable_name(F.col("l")), an.code_only(F.col("l"))).first()[:] == ("a", "int a[4];")
    assert one.select(an.class_name(F.lit("class A<int*>")), an.blank_or_comment(F.lit(" // x"))).first()[:] == ("A<int *>", True)


def test_parse(spark):
    files = spark.createDataFrame([("a.h", "// FUNCTION: A 0x1\nint f() { }\n"), ("b.h", None), ("c.h", "// FUNCTION: A 0x1\n")], "path string, text string")
    symbols, alerts = an.parse(files)
    assert symbols.count() == 1 and [r.code for r in alerts.collect()] == [108]
