import random

import pytest
from pyspark.sql import functions as F

from twinscope import schema as s
from twinscope.operators import compare, joins, layout, matchers, naming, normalise, store, windows
from twinscope.operators.store import State
from twinscope.plans import compare as plan


def rows(spark, *items):
    """Entities from (img, addr, attributes)."""
    out = [tuple([img, addr, *[more.get(n) for n in s.ATTRIBUTES]]) for img, addr, more in items]
    return spark.createDataFrame(out, s.ENTITIES)


def state(spark, *items, sections=()):
    return State.of(spark, rows(spark, *items), sections=spark.createDataFrame(list(sections), s.SECTIONS))


def pairs(st):
    return sorted(tuple(r) for r in st.matches.collect())


def events(st):
    return sorted((r.event, r.orig_addr) for r in st.events.collect())


def test_symbols_in_order(spark):
    st = matchers.symbols(state(spark, *[(i, a, {"symbol": "x"}) for i, a in ((0, 200), (0, 100), (1, 600), (1, 500), (1, 700))], (0, 300, {"symbol": "y"}), (0, 301, {"symbol": ""})))
    assert pairs(st) == [(100, 500), (200, 600)]
    assert events(st) == [("NON_UNIQUE_SYMBOL", 100), ("NON_UNIQUE_SYMBOL", 200), ("NO_MATCH", 300)]


@pytest.mark.parametrize("cut", [True, False])
def test_truncated(spark, cut):
    st = state(spark, (0, 1, {"symbol": "x" * 255 + "a"}), (1, 2, {"symbol": "x" * 255 + "b"}))
    assert pairs(matchers.symbols(st, cut)) == ([(1, 2)] if cut else [])


def test_functions_null_types(spark):
    st = matchers.functions(state(spark, (0, 1, {"name": "f", "type": s.FUNCTION}), (0, 2, {"name": "g"}), (1, 5, {"name": "f"}), (1, 6, {"name": "g", "type": s.FUNCTION}), (1, 7, {"name": "f", "type": s.DATA})))
    assert pairs(st) == [(1, 5)] and events(st) == []


def test_ambiguous_functions(spark):
    st = matchers.functions(state(spark, *[(0, a, {"name": "f", "type": s.FUNCTION}) for a in (1, 2, 3)], (1, 5, {"name": "f", "symbol": "s5"}), (1, 6, {"name": "f"})))
    assert pairs(st) == [(1, 5), (2, 6)]
    assert events(st) == [("AMBIGUOUS_MATCH", 1), ("AMBIGUOUS_MATCH", 2), ("NO_MATCH", 3)]


def test_ambiguous_functions_list_all_that_are_left(spark):
    rows = [(0, a, {"name": "f", "type": s.FUNCTION}) for a in (1, 2, 3)] + [(1, 100 + a, {"name": "f", "symbol": f"s{a}"}) for a in range(40)]
    st = matchers.functions(state(spark, *rows))
    told = {r.orig_addr: r.msg for r in st.events.collect()}
    assert sorted(told) == [1, 2, 3]
    for i, msg in enumerate(told[a] for a in (1, 2, 3)):
        assert f"taken 's{i}', left [{', '.join(f's{a}' for a in range(i + 1, 40))}]" in msg


def test_vtables(spark):
    t = lambda **k: {"type": s.VTABLE, **k}
    st = matchers.vtables(state(spark, (0, 1, t(name="X")), (0, 2, t(name="X", base_class="Y")), (0, 3, t(name="Z", base_class="Z")), (1, 5, t(name="X::`vftable'")), (1, 6, t(name="X::`vftable'{for `Y'}")), (1, 7, t(name="Z::`vftable'{for `Z'}"))))
    assert pairs(st) == [(1, 5), (2, 6), (3, 7)]


def test_imports_last_and_first(spark):
    i = lambda n: {"type": s.IMPORT, "name": n}
    assert pairs(matchers.imports(state(spark, (0, 1, i("a")), (0, 2, i("A")), (1, 5, i("A")), (1, 6, i("a"))))) == [(2, 5)]


def test_static_variables(spark):
    f = {"type": s.FUNCTION, "symbol": "?f@@YA"}
    v = lambda n: {"type": s.DATA, "name": n, "static_var": True, "parent_function": 10}
    st = matchers.static_variables(state(spark, (0, 10, f), (0, 1, v("a")), (0, 2, v("a")), (0, 3, {**v("b"), "parent_function": 99}), (1, 5, {"symbol": "?a@?1??f@@YAXXZ@4HA"}), (1, 6, {"symbol": "?a@?2??f@@YAXXZ@4HA"}), (1, 7, {"symbol": "?a@?1??g@@YA"})))
    assert pairs(st) == [(1, 5), (2, 6)] and events(st) == [("NO_MATCH", 3)]


def test_references(spark):
    d = {"displacement": (0, 0)}
    st = state(spark, (0, 10, {"name": "f"}), (0, 20, {"ref_orig": 10, **d}), (0, 30, {"ref_orig": 20, **d}), (1, 110, {"name": "f"}), (1, 120, {"ref_recomp": 110, **d}), (1, 130, {"ref_recomp": 120, **d}), (0, 40, {"ref_orig": 0}))
    st = st.match(spark.createDataFrame([(10, 110)], s.MATCHES))
    assert pairs(matchers.references(st)) == [(10, 110), (20, 120), (30, 130)]
    warned = matchers.references(st, passes=1)
    assert pairs(warned) == [(10, 110), (20, 120)] and events(warned) == [("GENERAL_WARNING", -1)]


def test_merge_rules(spark):
    st = state(spark, (0, 1, {"name": "a", "stub": True}), (1, 5, {"name": None, "symbol": "s"}))
    st = st.match(spark.createDataFrame([(1, 5), (7, 8)], s.MATCHES))
    got = {(r.orig_addr, r.recomp_addr): r for r in st.get_matches().collect()}
    assert got[1, 5].name == "a" and got[1, 5].symbol == "s" and got[1, 5].stub and (7, 8) in got
    st = st.upsert(store.delta(spark.createDataFrame([(1,)], "addr long"), {"name": F.lit("n")}, s.ORIG))
    assert {r.name for r in st.entities.where("addr in (1, 5)").collect()} == {"n"}
    again = st.match(spark.createDataFrame([(1, 9), (3, 5), (3, 9)], s.MATCHES))
    assert pairs(again) == [(1, 5), (3, 9), (7, 8)]


def test_first_pairs(spark):
    p = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 2), (2, 6, 3), (3, 6, 4), (3, 7, 5)], "a int, b int, o int")
    assert sorted((r.a, r.b) for r in joins.first_pairs(p, "a", "b", "o").collect()) == [(1, 5), (2, 6), (3, 7)]


def test_first_pairs_of_a_long_chain(spark):
    every = [(a, b, a * 50 + b) for a in range(50) for b in range(50)] + [(k, k + d, 9000 + 2 * k + d) for k in range(100, 180) for d in (0, 1)]
    got = joins.first_pairs(spark.createDataFrame(every, "a int, b int, o int"), "a", "b", "o").collect()
    assert sorted((r.a, r.b) for r in got) == [(k, k) for k in [*range(50), *range(100, 180)]]


def test_first_free(spark):
    r = random.Random(5)
    lefts = [(r.choice([1, 2, 3, 4, 5, 6, 7]), a) for a in r.sample(range(1000), 150)]
    rights = [(r.choice([1, 2, 3, 4, 5, 6, 7, 9]), a) for a in r.sample(range(1000), 150)]
    links = [(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (4, 4), (4, 5), (5, 6), (6, 6), (7, 7), (7, 7), (8, 9), (6, 8)]
    free, want = sorted((a, form) for form, a in rights), []
    for a, kind in sorted((a, kind) for kind, a in lefts):
        at = next((x for x in free if (kind, x[1]) in links), None)
        if at is not None:
            free.remove(at)
            want.append((a, at[0]))
    made = [spark.createDataFrame(x, f"{a} long, {b} long") for x, a, b in ((lefts, "kind", "left"), (rights, "form", "right"), (links, "kind", "form"))]
    assert sorted(tuple(x) for x in joins.first_free(*made).collect()) == sorted(want) and len(want) > 80


def test_set_null(spark):
    st = state(spark, (0, 1, {"name": "a", "symbol": "b"}))
    got = st.upsert(store.delta(spark.createDataFrame([(1,), (2,)], "addr long"), {"name": F.lit(None)}, s.ORIG)).entities.orderBy("addr").collect()
    assert [(r.addr, r.name, r.symbol) for r in got] == [(1, None, "b"), (2, None, None)]


def test_lookups(spark):
    st = state(spark, (0, 100, {"orig_size": 10, "type": s.DATA}), (0, 200, {"type": s.FUNCTION}), (0, 250, {"type": s.LABEL}), sections=[(0, 1, 0, 300)])
    probes = spark.createDataFrame([(0, a) for a in (50, 100, 109, 110, 200, 201, 400)], "img int, addr long")
    assert [r.intersects for r in st.intersects(probes).orderBy("addr").collect()] == [False, True, True, False, True, False, False]
    assert [r.max_size for r in st.room(probes).orderBy("addr").collect()] == [50, 100, 91, 90, 100, 99, None]
    assert [r.base for r in st.nearest(probes).orderBy("addr").collect()] == [None, 100, 100, 100, 200, 200, 250]
    assert {(r.addr, r.max_size) for r in windows.max_sizes(st.entities, st.sections, 0).collect()} == {(200, 100)}


def test_names(spark):
    st = state(spark, (0, 100, {"type": s.FUNCTION, "name": "Hello"}), (0, 200, {"type": s.THUNK, "ref_orig": 100}), (0, 300, {"type": s.VTORDISP, "ref_orig": 200, "displacement": (-4, 0)}), (0, 400, {"type": s.FUNCTION, "name": "Hello"}), (1, 500, {"type": s.FUNCTION, "name": "Hello"}))
    got = {r.addr: r.name for r in naming.thunk_names(st.merged()).collect()}
    assert got == {200: "Thunk of 'Hello'", 300: "Hello`vtordisp{-4, 0}'"}
    assert [(r.orig_addr, r.recomp_addr, r.nth) for r in windows.overloaded(st.merged()).orderBy("nth").collect()] == [(100, None, 1), (400, None, 2), (None, 500, 3)]


def test_eliminate(spark):
    data = [("a", 0, 10, 1, True, 0), ("a", 0, 20, 1, True, 0), ("a", 1, 110, 1, True, 0), ("a", 1, 120, 1, True, 0), ("a", 0, 10, 2, False, 1), ("a", 1, 110, 2, False, 1)]
    got = naming.eliminate(spark.createDataFrame(data, "array_type string, img int, func_addr long, used long, is_write boolean, seq long")).collect()
    assert {(r.orig_addr, r.recomp_addr) for r in got} == {(10, 110), (20, 120)}


def test_layout(spark):
    fields = "key int, leaf string, modifies int, array_type int, size long, members array<struct<offset:int,type:int,name:string>>, supers array<struct<offset:int,type:int>>, field_list int, udt int, is_forward_ref boolean, underlying_type int, bit_type int, element_type int"
    recs = [
        (0x1000, "LF_FIELDLIST", None, None, None, [(0, 0x74, "a"), (4, 0x1003, "b"), (12, 0x1004, "p")], [], None, None, False, None, None, None),
        (0x1001, "LF_STRUCTURE", None, None, 20, None, None, 0x1000, None, False, None, None, None),
        (0x1002, "LF_MODIFIER", 0x1001, None, None, None, None, None, None, False, None, None, None),
        (0x1003, "LF_ARRAY", None, 0x72, 4, None, None, None, None, False, None, None, None),
        (0x1004, "LF_POINTER", None, None, None, None, None, None, None, False, None, None, 0x1001),
    ]
    found = layout.scalars(spark.createDataFrame(recs, fields), depth=4)
    of = lambda k: sorted((r.offset, r.size, r.name, r.is_pointer) for r in found.where(F.col("type_key") == k).collect())
    assert of(0x1001) == of(0x1002) == [(0, 4, "a", False), (4, 2, "b[0]", False), (6, 2, "b[1]", False), (12, 4, "p", True)]
    total = spark.createDataFrame([(0x1001, 18)], "type_key int, type_size int")
    pads = layout.padded(layout.without_overlaps(found.where("type_key = 4097")), total).where("name = '(padding)'")
    assert sorted(r.offset for r in pads.collect()) == [8, 9, 10, 11, 16, 17]


LAYOUT = "key int, leaf string, modifies int, array_type int, size long, members array<struct<offset:int,type:int,name:string>>, supers array<struct<offset:int,type:int>>, field_list int, udt int, is_forward_ref boolean, underlying_type int, bit_type int, element_type int"


def structure(key, members, size=64):
    return [(key, "LF_FIELDLIST", None, None, None, members, [], None, None, False, None, None, None), (key + 1, "LF_STRUCTURE", None, None, size, None, None, key, None, False, None, None, None)]


def test_layout_of_all_primitives_and_depths(spark):
    kinds = {0x08: 4, 0x408: 4, 0x62: 4, 0x7A: 2, 0x7B: 4, 0x7C: 1, 0x174: 2, 0x274: 4, 0x374: 4, 0x574: 6, 0x43: 16, 0x74: 4}
    recs = structure(0x1000, [(16 * i, k, f"m{i}") for i, k in enumerate(kinds)])
    for n in range(1, 15):
        recs += structure(0x1000 + 2 * n, [(0, 0x1000 + 2 * n - 1, "in")])
    found = layout.scalars(spark.createDataFrame(recs, LAYOUT)).where("type_key in (4097, 4125)").collect()
    for key, prefix in ((0x1001, ""), (0x101D, "in." * 14)):
        assert sorted((r.offset, r.size, r.name) for r in found if r.type_key == key) == sorted((16 * i, size, f"{prefix}m{i}") for i, size in enumerate(kinds.values()))
    assert layout.primitives(spark).select("key").distinct().count() == layout.primitives(spark).count() == 306


@pytest.mark.parametrize("key", [0x7F, 0x2000, 0x1001])
def test_layout_unknown_or_circular(spark, key):
    with pytest.raises(ValueError):
        layout.scalars(spark.createDataFrame(structure(0x1000, [(0, key, "m")]), LAYOUT))


def test_variables(spark):
    st = state(spark, (0, 100, {"orig_size": 8}), (1, 500, {"recomp_size": 8})).match(spark.createDataFrame([(100, 500)], s.MATCHES))
    le = lambda *v: bytearray(b"".join(x.to_bytes(4, "little") for x in v))
    data = [(1, "a", 7, 8, le(5, 104), le(5, 504), "NO", "NO"), (2, "b", 7, 8, le(5, 104), le(6, 500), "NO", "NO"), (3, "c", None, 2, bytearray(b"ab"), bytearray(b"ac"), "NO", "MAYBE"), (4, "d", 7, 8, le(0, 0), le(0, 0), "NO", "YES"), (5, "e", 7, 8, le(0, 0), le(0, 0), "MAYBE", "YES")]
    v = spark.createDataFrame(data, "orig_addr long, name string, data_type int, size int, orig_block binary, recomp_block binary, orig_bss string, recomp_bss string")
    shape = spark.createDataFrame([(7, 0, 4, True, "x", False), (7, 4, 4, False, "y", True)], "type_key int, offset int, size int, signed boolean, name string, is_pointer boolean")
    got = {r.orig_addr: (r.verdict, r.n_different) for r in compare.verdicts(compare.variables(v, shape, st), "orig_addr").collect()}
    assert got == {1: ("MATCH", 0), 2: ("DIFF", 2), 3: ("WARN", 1), 4: ("DIFF", 2), 5: ("MATCH", 0)}


def test_stacks(spark):
    blocks = spark.createDataFrame([(1, 0, ["mov eax, dword ptr [ebp - 0x8]", "nop"], ["mov eax, dword ptr [ebp - 0xc]", "nop"]), (1, 1, ["push ebx"], []), (1, 2, ["lea ecx, [ebp + 0x4]"], ["nop"])], "orig_addr long, block int, orig array<string>, recomp array<string>")
    (got,) = compare.stack_pairs(blocks).collect()
    assert (got.orig.offset, got.recomp.offset) == (-8, -12)
    assert compare.structural_mismatches(blocks).count() == 1


def code(spark, *items):
    return spark.createDataFrame([(0, 0x1000, *i) for i in items], "img int, func_addr long, addr long, size int, mnemonic string, op_str string")


def test_normalise(spark):
    st = state(spark, (0, 0x403000, {"name": "g_x", "type": s.DATA, "orig_size": 16}), (0, 0x402000, {"name": "f", "type": s.FUNCTION}), (0, 0x404000, {"name": "imp", "type": s.IMPORT}))
    lines = code(
        spark, (0x1000, 5, "call", "0x402000"), (0x1005, 5, "call", "0x402010"), (0x100A, 6, "mov", "eax, dword ptr [0x403004]"), (0x1010, 6, "call", "dword ptr [0x404000]"), (0x1016, 5, "push", "0x403008"), (0x101B, 5, "push", "0x12345678"),
        (0x1020, 2, "jmp", "0x1000"), (0x1022, 6, "jne", "0x1030"), (0x1028, 6, "mov", "ecx, dword ptr [eax*4 + 0x500000]"), (0x102E, 6, "cmp", "eax, 0x403000"), (0x1034, 3, "mov", "eax, dword ptr [ebp - 0x8]"), (0x1037, 5, "call", "0x402010"),
    )
    valid = spark.createDataFrame([(0, 0x403008), (0, 0x500000)], "img int, value long")
    got = [r.text for r in normalise.normalise(lines, st, valid).orderBy("addr").collect()]
    assert got == [
        "call f (FUNCTION)", "call <OFFSET2>", "mov eax, dword ptr [g_x+4 (OFFSET)]", "call dword ptr [->imp (IMPORT)]", "push g_x+8 (OFFSET)", "push 0x12345678", "jmp -0x22", "jne 0x8",
        "mov ecx, dword ptr [eax*4 + <OFFSET6>]", "cmp eax, g_x (DATA)", "mov eax, dword ptr [ebp - 0x8]", "call <OFFSET2>",
    ]


def test_whole_run(spark):
    st = state(spark, (0, 100, {"type": s.FUNCTION, "name": "f", "orig_size": 9}), (0, 200, {"type": s.FUNCTION, "name": "g"}), (1, 500, {"type": s.FUNCTION, "name": "f", "recomp_size": 8}), (1, 600, {"name": "g", "recomp_size": 8}), sections=[(0, 1, 0, 1000), (1, 1, 0, 1000)])
    st = plan.reconcile(st, plan.default_stages())
    assert pairs(st) == [(100, 500), (200, 600)]
    texts = [(0, 100, ["a", "b"]), (1, 500, ["a", "b"]), (0, 200, ["a", "b"]), (1, 600, ["a", "c"])]
    lines = spark.createDataFrame([(i, a, [(hex(k), t) for k, t in enumerate(ts)]) for i, a, ts in texts], "img int, addr long, lines array<struct<addr:string,text:string>>")
    slots = spark.createDataFrame([], "orig_addr long, orig_slots array<bigint>, recomp_slots array<bigint>")
    out = plan.compare_all(st, lines, slots, "a.dll")
    assert {(r.orig_addr, r.accuracy) for r in out.report.collect()} == {("0x64", 1.0), ("0xc8", 0.5)}
    assert out.totals.first().functions == 2
    assert plan.functions(st, lines).where("diff is not null").count() == 1


def test_overloads_by_arguments(spark):
    st = state(spark, (0, 100, {"type": s.FUNCTION, "name": "f", "symbol": "?f@int"}), (0, 200, {"type": s.FUNCTION, "name": "f", "symbol": "?f@char"}), (0, 300, {"type": s.FUNCTION, "name": "f"}))
    done = plan.names(st, lambda symbol: f"void f({symbol.rpartition('@')[2]})")
    assert {r.addr: r.computed_name for r in done.entities.collect()} == {100: "f(int)", 200: "f(char)", 300: "f(3)"}
