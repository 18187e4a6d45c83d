import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tests.engine.test_store import pairs, state
from twinscope import schema as s
from twinscope.operators import completion, export, lines, naming, reports, roadmap, startup
from twinscope.plans import project
from twinscope.sources import headers


def test_values_are_read(spark):
    data = struct.pack("<f", 1.5) + struct.pack("<d", -0.1) + b"two words\0" + "wide".encode("utf-16-le") + b"\0\0" + b"\xff\xfe" + b"caf\xe9"
    memory = spark.createDataFrame([(0, 1, 1000, 64, bytearray(data)), (0, 2, 5000, 8, bytearray(b"abc"))], "img int, section_id int, start long, size long, data binary")
    at = 1000 + 12
    st = state(
        spark, (0, 1000, {"type": s.FLOAT, "orig_size": 4}), (0, 1004, {"type": s.FLOAT, "recomp_size": 8}), (0, 1001, {"type": s.FLOAT, "orig_size": 4, "name": "known"}), (0, at, {"type": s.STRING}), (0, at + 10, {"type": s.WIDECHAR}),
        (0, at + 4, {"type": s.STRING, "orig_size": 3}), (0, 1060, {"type": s.STRING, "orig_size": 90}), (0, 5000, {"type": s.STRING}), (0, 9999, {"type": s.FLOAT, "orig_size": 4}), (1, 1000, {"type": s.FLOAT, "recomp_size": 4}),
    )
    done = completion.complete(st, memory, s.ORIG)
    got = {r.addr: (r.name, r.orig_size) for r in done.side(s.ORIG).collect()}
    assert got[1000] == ("1.5", 4) and got[1004][0] == "-0.1" and got[1001][0] == "known"
    assert got[at] == ('"two words"', 10) and got[at + 10] == ('L"wide"', 10) and got[at + 4] == ('"wo"', 3)
    assert got[5000] == ('"abc"', 4)  # what is beyond the file's bytes reads as zero
    assert {(r.event, r.orig_addr) for r in done.events.collect()} == {(completion.READ_FAILED, 1060), (completion.READ_FAILED, 9999)}
    assert done.side(s.RECOMP).where("name is not null").isEmpty()
    bad = completion.read_values(spark.createDataFrame([(1000, "string", 3)], "addr long, kind string, size long"), spark.createDataFrame([(1, 1000, 9, bytearray(b"\xff\xff\0"))], "section_id int, start long, size long, data binary"), "ascii")
    assert bad.first().error == completion.DECODE_FAILED


def test_uninitialised(spark):
    ranges = completion.uninitialised_ranges(spark.createDataFrame([(100, 50, 20, False), (200, 10, 10, False), (300, 30, 30, True)], "start long, virtual_size long, raw_size long, uninitialised boolean"))
    probes = spark.createDataFrame([(a,) for a in (100, 119, 120, 149, 150, 205, 300, 329, 330)], "addr long")
    assert [r.inside for r in completion.in_ranges(probes, ranges).orderBy("addr").collect()] == [False, False, True, True, False, False, True, True, False]


def test_lines(spark):
    rows = spark.createDataFrame([("a.cpp", 3, 100, 1), ("a.cpp", 4, 104, 2), ("b/c.cpp", 9, 104, 3), ("a.cpp", 90, 200, 4)], "path string, line_no int, addr long, seq long")
    at = {r.addr: (r.path, r.line_no) for r in lines.line_of(rows, spark.createDataFrame([(100,), (104,), (7,)], "addr long")).collect()}
    assert at == {100: ("a.cpp", 3), 104: ("b/c.cpp", 9), 7: (None, None)}
    marked = lines.mark_starts(rows, lines.starts_in_code(spark.createDataFrame([(100,), (200,), (300,)], "addr long"), rows))
    probes = spark.createDataFrame([("a.cpp", 1, 10), ("a.cpp", 1, 95), ("a.cpp", 4, 10)], "path string, low int, high int")
    assert {(r.low, r.high): (r.addr, r.n_values) for r in lines.function_in(marked, probes).collect()} == {(1, 10): (100, 1), (1, 95): (None, 2), (4, 10): (None, 0)}
    assert {(r.high, r.addr) for r in lines.search(marked, probes.limit(1)).collect()} == {(10, 100), (10, 104)}
    text = lines.with_source(spark.createDataFrame([(100, "nop"), (104, "ret"), (1, "int3")], "addr long, text string"), rows, spark.createDataFrame([(104,)], "addr long"))
    assert {r.text for r in text.collect()} == {"nop \t(a.cpp:3)", "ret \t(c.cpp:9, pinned)", "int3"}


def test_start_up_lists(spark):
    st = state(spark, (0, 10, {"name": "___xc_a"}), (0, 30, {"name": "___xc_z"}), (0, 12, {"name": "___xc_a"}), (0, 40, {"name": "___xi_a"}), (0, 50, {"name": "other"}), (1, 900, {"name": "f"}))
    found = startup.spans(startup.labels(st.entities, s.ORIG)).collect()
    assert [(r.list, r.start, r.stop) for r in found] == [("CPP_INIT", 12, 30)]
    every = state(spark, *[(0, 10 + i, {"name": n}) for i, n in enumerate(startup.LABELS)], (0, 90, {"name": "___xc_a"}))
    assert {r.name: r.addr for r in startup.labels(every.entities, s.ORIG).collect()}["___xc_a"] == 10 + startup.LABELS.index("___xc_a")
    blocks = spark.createDataFrame([("C_INIT", bytearray(struct.pack("<4I", 0, 500, 0, 600))), ("C_TERM", bytearray(b"abc"))], "list string, data binary")
    assert [(r.position, r.addr) for r in startup.listed(blocks).orderBy("position").collect()] == [(1, 500), (3, 600)]
    code = [(500, b"\xe9\x0b\0\0\0"), (600, b"\xe9\x0c\0\0\0"), (700, b"\xe8\xf0\xff\xff\xff"), (800, b"\x90\x90\x90\x90\x90"), (900, b"\xe9\0")]
    got = {r.addr: (r.func_addr, r.thunk_addr) for r in startup.unwrapped(spark.createDataFrame([(a, bytearray(c)) for a, c in code], "addr long, code binary")).collect()}
    assert got == {500: (516, 500), 600: (600, None), 700: (689, 700), 800: (800, None), 900: (900, None)}


def test_start_up_match(spark):
    functions = [(0, "CPP_INIT", 516, 500), (0, "CPP_INIT", 600, None), (1, "CPP_INIT", 716, 700), (1, "CPP_INIT", 800, None), (0, "C_TERM", 950, None)]
    samples = [("CPP_INIT", 0, 516, 1, True, 0), ("CPP_INIT", 1, 716, 1, True, 0), ("CPP_INIT", 0, 600, 1, False, 1), ("CPP_INIT", 1, 800, 1, False, 1), ("C_TERM", 0, 950, 3, True, 0)]
    st = startup.match(state(spark), spark.createDataFrame(functions, "img int, list string, func_addr long, thunk_addr long"), spark.createDataFrame(samples, "list string, img int, func_addr long, used long, is_write boolean, seq long"))
    assert pairs(st) == [(500, 700), (516, 716), (600, 800)]
    assert {(r.img, r.addr, r.type, r.name) for r in st.entities.where("img = 0").collect()} == {(0, a, s.FUNCTION, n) for a, n in ((500, "$CRT_CPP_Initializer"), (516, "$CRT_CPP_Initializer"), (600, "$CRT_CPP_Initializer"), (950, "$CRT_C_Terminator"))}


def test_fingerprints(spark):
    code = [
        (0, 1, 10, "mov", "dword ptr [0x400000], eax"), (0, 1, 11, "mov", "byte ptr [0x400004], byte ptr [0x400008]"), (0, 1, 12, "add", "dword ptr [0x400000], 1"), (0, 1, 13, "jmp", "0x400008"), (0, 1, 14, "fstp", "dword ptr [0x40000c]"),
        (0, 1, 15, "push", "0x999999"), (0, 1, 16, "ret", ""), (0, 1, 17, "mov", "dword ptr [0x400008], eax"), (0, 2, 30, "mov", "eax, dword ptr [0x40]"),
    ]
    known = spark.createDataFrame([(0, a, a + 1) for a in (0x400000, 0x400004, 0x400008, 0x40000C)], "img int, addr long, orig_addr long")
    found = naming.fingerprints(spark.createDataFrame(code, "img int, func_addr long, addr long, mnemonic string, op_str string"), known)
    assert [(r.used - 1, r.is_write) for r in found.orderBy("seq").collect()] == [(0x400000, True), (0x400004, True), (0x400008, False), (0x400000, False), (0x40000C, True)]


def test_headers(spark):
    dos = struct.pack("<2s29HI", b"MZ", *range(29), 64)
    assert headers.mz(dos)["lfanew"] == 64 and headers.mz(dos)["ovno"] == 12
    linear = dos.ljust(64, b"\0") + struct.pack("<2s2BI2H40I", b"LE", 0, 0, 0, 2, 1, *range(40))
    assert headers.lx(linear)["cpu"] == 2 and headers.lx(linear)["heap_size"] == 39
    with pytest.raises(ValueError):
        headers.lx(linear[:66] + b"\1" + linear[67:])
    for width, order in ((1, "<"), (2, ">")):
        ident = b"\x7fELF" + bytes([width, 1 if order == "<" else 2]) + bytes(10)
        raw = struct.pack(order + ("16sHHIIIIIHHHHHH" if width == 1 else "16sHHIQQQIHHHHHH"), ident, 2, 3, 1, 0x8048000, 52, 99, 0, 52, 32, 4, 40, 5, 6)
        got = headers.elf(raw)
        assert (got["bits"], got["big_endian"], got["entry"], got["shstrndx"]) == (32 * width, int(order == ">"), 0x8048000, 6)
    mach = struct.pack("<8I", 0xFEEDFACE, 7, 3, 2, 11, 1000, 0x85, 0)
    assert headers.mach_o(mach)["commands"] == 11
    rows = spark.createDataFrame([("a", bytearray(dos)), ("b", bytearray(linear)), ("c", bytearray(mach)), ("d", bytearray(b"none")), ("e", None)], "path string, content binary")
    got = headers.decode(rows).where("name = 'magic'").collect()
    assert {(r.path, r.format, r.value) for r in got} == {("a", "mz", b"MZ".hex()), ("b", "lx", b"LE".hex()), ("c", "mach-o", str(0xFEEDFACE))}


def segmented():
    """A 16-bit image with a segment of code that has a chain of relocations, and one of data."""
    body = bytearray(0x20)
    struct.pack_into("<H", body, 4, 0x10)  # the chain goes on at 0x10 and ends there
    struct.pack_into("<H", body, 0x10, 0xFFFF)
    relocations = struct.pack("<H", 2) + struct.pack("<BBHHH", 5, 1, 4, 1, 7) + struct.pack("<BBHHH", 3, 4, 8, 2, 0)
    fields = {"segments": 2, "modules": 1, "segment_table": 0x40, "module_table": 0x60, "import_names": 0x62, "entry_table": 0x70, "shift": 4}
    layout = [f.split(":") for f in headers.NE.split()]
    head = struct.pack("<" + "".join(k for _, k in layout), *[b"NE" if n == "magic" else fields.get(n, 0) for n, _ in layout])
    ne = bytearray(0x90)
    ne[: len(head)] = head
    ne[0x40:0x50] = struct.pack("<8H", 0x10, 0x20, headers.HAS_RELOCATIONS, 0x20, 0x18, 0, 1, 0)
    ne[0x60:0x6A] = struct.pack("<H", 1) + b"\0" + bytes([6]) + b"KERNEL"
    ne[0x70:0x80] = bytes([1, 1, 3]) + struct.pack("<H", 0x12) + bytes([2, 0]) + bytes([1, 0xFF, 1]) + struct.pack("<HBH", 0x3FCD, 2, 0x34) + bytes([0])
    out = bytearray(struct.pack("<2s29HI", b"MZ", *[0] * 29, 64).ljust(64, b"\0") + ne)
    out = out.ljust(0x100, b"\0") + body + relocations
    return bytes(out.ljust(0x180 + 0x10000, b"\0"))


def test_16_bit_images():
    image = headers.Segmented(segmented())
    assert image.offset(1) == 0x100 and image.length(2) == 0x10000 and len(image.bytes_of(1)) == 0x20
    assert image.module(1) == "KERNEL"
    assert image.entries() == [(1, 1, 0x12), (4, 2, 0x34)]
    assert [(at, r["source"], r["first"]) for at, r in image.relocations(1)] == [(4, 5, 1), (0x10, 5, 1), (8, 3, 2)]
    assert list(image.relocations(2)) == []
    with pytest.raises(ValueError):
        headers.Segmented(b"MZ".ljust(80, b"\0"))


def test_reports(spark):
    rows = spark.createDataFrame([("0x1", "0x9", s.FUNCTION, True, 0.5), ("0x2", "0x8", s.FUNCTION, False, 1.0), ("0x3", "0x7", s.VTABLE, False, 1.0)], "orig_addr string, recomp_addr string, type int, is_effective_match boolean, accuracy double")
    shown = lambda stored: [r.x for r in rows.orderBy("orig_addr").select(reports.shown_diff(stored, F.lit("all"), F.lit("part")).alias("x")).collect()]
    assert shown(F.lit(None).cast("string")) == ["part", None, "all"] and shown(F.lit("old")) == ["old"] * 3
    assert reports.by_address(rows, "0x2").count() == 1
    hidden, sort = reports.shown_columns(rows, False, "recomp_addr")
    assert "recomp_addr" not in hidden.columns and sort == "orig_addr" and reports.shown_columns(rows, True, "recomp_addr")[1] == "recomp_addr"
    diff = spark.createDataFrame([("0x1", [("@@", [([["a", "nop", "b"]], None, None), (None, [["c", "ret"]], [["d", "int3"]])])])], f"orig_addr string, diff {s.DIFF.simpleString()}")
    assert [tuple(r)[1:] for r in reports.diff_rows(diff).orderBy("block", "n").collect()] == [(0, 0, "a", "b", " ", "nop"), (1, 0, "c", "", "-", "ret"), (1, 1, "", "d", "+", "int3")]
    failures = spark.createDataFrame([(1, "Type", "A"), (2, "Name", "B"), (3, "Type", "A"), (4, "Other", "C"), (5, "Other", "C")], "seq int, error string, subject string")
    assert [(r.subject, r.n) for r in reports.failure_counts(failures).collect()] == [("A", 2), ("C", 2), ("B", 1)]
    assert sorted(r.seq for r in reports.first_failures(failures, ["Type", "Name"]).collect()) == [1, 2, 4, 5]
    dump = roadmap.dumps(spark.createDataFrame([(20, "g", [("", "nop")]), (10, "f", [("0xa", "ret")])], "orig_addr long, name string, lines array<struct<addr:string,text:string>>"), "orig_addr")
    assert [r.line for r in dump.collect()] == ["; f", "0xa       : ret", "; g", "        : nop"]


def test_export(spark):
    matches = spark.createDataFrame([(1, 11), (2, 22)], "orig_addr long, recomp_addr long")
    symbols = spark.createDataFrame([(11, "f", 0x1000)], "addr long, name string, func_type int")
    types = spark.createDataFrame([(0x1000, 3, "C Near", None, None, 0x1001, None), (0x1001, None, None, None, None, None, [0x74])], "key int, return_type int, call_type string, class_type int, this_adjust long, arg_list_type int, args array<int>")
    got = {r.orig_addr: (r.func_type, r.return_type, r.arguments) for r in export.signatures(matches, symbols, types).collect()}
    assert got == {1: (0x1000, 3, [0x74]), 2: (None, None, None)}
    parameters = spark.createDataFrame([(1, 0, "ECX", None), (1, 1, None, 0xA), (1, 2, None, 4)], "function long, ordinal int, register string, stack_offset long")
    at = spark.createDataFrame([(1, "ecx", "this"), (1, "[A]", "count")], "function long, location string, name string")
    assert {r.ordinal: r.name for r in export.parameter_names(parameters, at).collect()} == {0: "this", 1: "count", 2: None}
    known = spark.createDataFrame([(1, "f", None), (2, "g", 5)], "k int, name string, size int")
    wanted = spark.createDataFrame([(1, "f", None), (2, "g", 6), (3, "h", 1)], "k int, name string, size int")
    assert {(r.k, r.is_new) for r in export.changed(known, wanted, "k", ("name", "size")).collect()} == {(2, False), (3, True)}


def test_project(tmp_path):
    pytest.importorskip("yaml")
    assert project.sequence(None) == () and project.sequence("a") == ("a",) and project.sequence(["a", "b"]) == ("a", "b")
    assert project.single(("a",)) == "a" and project.single(("a", "b")) == ["a", "b"]
    names = [n for n, _ in project.identified([tmp_path / x for x in ("Game-1.exe", "GAME1.DLL", "game1.bin", "x.y.z")])]
    assert names == ["GAME1", "GAME1_0", "GAME1_1", "XY"]
    original = tmp_path / "cd" / "GAME.EXE"
    original.parent.mkdir()
    original.write_bytes(b"game")
    (tmp_path / "build" / "out").mkdir(parents=True)
    for n in ("game.exe", "game.pdb"):
        (tmp_path / "build" / "out" / n).write_bytes(b"new")
    content = {"targets": {"GAME": {"filename": "game.exe", "hash": {"sha256": hashlib.sha256(b"game").hexdigest()}, "source-root": "src", "report": {"ignore_functions": ["f"]}}}}
    project.save(tmp_path / project.PROJECT, content)
    found = project.Project.find(tmp_path / "cd")
    assert found.folder == tmp_path and found.targets["GAME"].source_roots == (tmp_path / "src",) and found.targets["GAME"].ignore_functions == ("f",)
    with pytest.raises(ValueError):
        found.target("GAME")
    assert found.detect_originals([tmp_path / "cd"]) == {"GAME": original}
    assert set(found.detect_recompiled(tmp_path / "build", tmp_path / "build")) == {"GAME"}
    again = project.Project.find(tmp_path / "build" / "out")
    assert again.target("GAME").original == original and again.target("GAME").symbols.name == "game.pdb" and again.unknown == ()
    assert again.target(paths=(original, original, original, tmp_path)).name == "GAME"
    for wrong in ({}, {"name": "GAME", "paths": (original,) * 4}):
        with pytest.raises(ValueError):
            again.target(**wrong)
    with pytest.raises(KeyError):
        again.target("NONE")
    with pytest.raises(FileNotFoundError):
        project.Project.find(tmp_path, ("other.yml", "user.yml", "build.yml"))
