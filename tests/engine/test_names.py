import pytest
from pyspark.sql import functions as F

from twinscope.functions import display, names


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["plain", 'say "hi"', "tab\tline\nreturn\r", "back\\slash", "\x00\x1f\x7f", "café ÿ", "☃ snow", "😀", ""])
def test_quoted(spark, text):
    want = text.encode("unicode_escape").decode().replace('"', '\\"')
    assert one(spark, names.quoted(F.col("t")), t=text) == f'"{want}"'
    assert one(spark, names.quoted(F.col("t"), F.lit(True)), t=text) == f'L"{want}"'


def test_symbols(spark):
    rows = [
        ("??_C@_08LIDF@December?$AA@", 8, False), ("??_C@_1O@POHA@?$AA?$AA?$AA?$AA?$AA?$AA@", 14, True), ("??_C@_1BA@OGCF@text@", 16, True), ("??_C@_0BB@ABCD@longer?5text@", 17, False), ("?f@@YAXXZ", None, None),
    ]
    got = spark.createDataFrame([r[:1] for r in rows], "s string").select(names.string_constant(F.col("s")).alias("x")).collect()
    assert [(None, None) if g.x is None else (g.x.length, g.x.is_wide) for g in got] == [r[1:] for r in rows]
    tables = {"??_7Ship@@6B@": "Ship::`vftable'", "??_7Ship@Yard@@6B@": "Yard::Ship::`vftable'", "??_7?$List@VShip@@@@6B@": "List<Ship>::`vftable'", "??_7?$List@PAVShip@@@@6B@": "List<Ship *>::`vftable'"}
    for symbol, want in tables.items():
        assert one(spark, names.table_name(F.col("s")), s=symbol) == want
    found = names.demangled(F.col("s"), lambda s: f"void __thiscall {s}(int, (char))" if s.startswith("?") else "")
    assert one(spark, names.arguments(found), s="?x") == "(int, (char))" and one(spark, names.arguments(found), s="x") is None
    assert one(spark, names.adjuster_name(F.col("s")), s="[thunk]: public: void __thiscall A::f`vtordisp{-4, 0}'(int)") == "A::f`vtordisp{-4, 0}'"
    assert one(spark, names.adjuster_name(F.col("s")), s="void A::f()") is None
    assert one(spark, names.plain_table(F.col("s")), s="const List<class Ship, struct Yard>::`vftable'") == "List<Ship, struct Yard>::`vftable'"


def test_names_for_others(spark):
    cases = {
        "Ship": ([], "Ship"), "Yard::Ship::sail": (["Yard", "Ship"], "sail"), "List<Yard::Ship *>::add": (["List[Yard::Ship_#]"], "add"), "Ship::`scalar destructor'": (["Ship"], "'scalar_destructor'"),
        "Thunk of 'Yard::Ship::sail'": (["Yard", "Ship"], "_thunk_sail"), "A<B<C::D>::E>::f": (["A[B[C::D]::E]"], "f"),
    }
    for name, (spaces, base) in cases.items():
        got = one(spark, names.sanitised(F.col("s")), s=name)
        assert (got.namespaces, got.base) == (spaces, base), name
    assert one(spark, names.substituted(F.col("s"), [("FUN_([0-9a-f]+)", "Sub_$1"), ("^Sub", "Own")]), s="FUN_12ab") == "Own_12ab"
    assert [one(spark, names.identifier(F.col("s")), s=p) for p in ("c:\\games\\My Game-2.exe", "/opt/lib.so.1", "plain")] == ["MYGAME2", "LIBSO", "PLAIN"]
    assert one(spark, names.shortened(F.col("s"), 6), s="Transporter::run") == "Transp..." and one(spark, names.shortened(F.col("s")), s="Ship::run") == "Ship"
    assert spark.range(1).select(names.struct_format(F.array(F.lit("i"), F.lit("h"))).alias("x"), names.struct_format(F.array().cast("array<string>")).alias("y")).first() == ("<ih", "")


def test_display(spark):
    place = lambda r, o, s: one(spark, display.stack_offset_text(F.col("r"), F.col("o"), F.col("s")), r=r, o=o, s=s)
    assert place("ebp", 8, None) == "ebp + 0x08" and place("ebp", -0x1C, "count") == "ebp - 0x1c  count" and place("esp", 0x123, None) == "esp + 0x123"
    line = lambda equal: one(spark, display.compared_line(F.col("o"), F.col("n"), F.lit("7"), F.lit("9"), F.col("e")), o=4, n="total", e=equal)
    assert line(True) == "    + 0x04 : " + f"{'total':30}" + " 7" and line(False).endswith(" 7 : 9")
    assert one(spark, display.compared_line(F.col("o"), F.lit(None).cast("string"), F.lit("7"), F.lit("9"), F.lit(True)), o=4) == "    + 0x04   " + " " * 30 + " 7"
    assert [one(spark, display.pointer_text(F.col("a"), F.col("n")), a=a, n=n) for a, n in ((0, None), (16, "x (DATA)"), (255, None))] == ["nullptr", "Pointer to x (DATA)", "Unknown pointer 0xff"]
    assert one(spark, display.dump_line(F.col("a"), F.col("t")), a="0x401000", t="ret") == "0x401000  : ret" and one(spark, display.dump_line(F.col("a"), F.col("t")), a="", t="ret") == "        : ret"
