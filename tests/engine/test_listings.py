import pytest

from twinscope.operators import diff, lint, roadmap
from twinscope.plans import listings
from twinscope.sources import images


def test_stacks(spark):
    blocks = [
        (1, 0, ["mov eax, dword ptr [ebp - 0x8]", "mov ecx, dword ptr [ebp - 0x8]"], ["mov eax, dword ptr [ebp - 0xc]", "mov ecx, dword ptr [ebp - 0x10]"]),
        (2, 0, ["lea eax, [ebp + 0x8]", "inc dword ptr [ebp - 0x4]"], ["lea eax, [ebp + 0x8]", "inc dword ptr [ebp - 0x14]"]), (3, 0, ["nop"], []),
    ]
    frame = spark.createDataFrame(blocks, "orig_addr long, block int, orig array<string>, recomp array<string>")
    symbols = spark.createDataFrame([(2, "ebp", -4, "count")], "orig_addr long, register string, offset long, symbol string")
    got = {(r.orig_addr, r.side, r.offset): r.line for r in listings.stacks(frame, symbols).collect()}
    assert got[1, "orig", -8] == "ERROR  ebp - 0x08: ebp - 0x10, ebp - 0x0c" and got[1, "recomp", -12] == "SWAP  ebp - 0x0c: ebp - 0x08"
    assert got[2, "orig", 8] == "CHECK  ebp + 0x08: ebp + 0x08" and got[2, "orig", -4] == "SWAP  ebp - 0x04  count: ebp - 0x14"
    assert {tuple(r) for r in listings.stack_findings(frame).collect()} == {(1, "NOT_ONE_TO_ONE"), (3, "STRUCTURE_DIFFERS")}


def test_variables(spark):
    le = lambda *v: bytearray(b"".join(x.to_bytes(4, "little") for x in v))
    pairs = spark.createDataFrame([(1, "same", 7, 8, le(5, 6), le(5, 6), "NO", "NO"), (2, "other", 7, 8, le(5, 6), le(5, 9), "NO", "NO")], "orig_addr long, name string, data_type int, size int, orig_block binary, recomp_block binary, orig_bss string, recomp_bss string")
    layout = spark.createDataFrame([(7, 0, 4, True, "x", False), (7, 4, 4, True, "y", False)], "type_key int, offset int, size int, signed boolean, name string, is_pointer boolean")
    got = [(r.name, r.verdict, None if r.line is None else " ".join(r.line.split())) for r in listings.variables(pairs, layout).collect()]
    assert got == [("same", "MATCH", None), ("other", "DIFF", "+ 0x04 : y 6 : 9")]
    assert listings.variables(pairs, layout, all_items=True).count() == 4


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("mov eax, 1 / push eax / pop ecx", "mov ecx, 1 / push ecx / pop eax", True), ("mov eax, [esi + 4] / ret", "mov edx, [edi + 4] / ret", True), ("mov eax, 1 / mov eax, 2", "mov ecx, 1 / mov eax, 2", True),
        ("mov eax, 1", "mov eax, 2", False), ("mov eax, 1", "nop", False), ("xor ax, ax", "xor dx, dx", True), ("add eax, ebx", "add x12, ebx", False), ("", "", True),
    ],
)
def test_registers_resolve(a, b, want):
    assert diff.registers_resolve(a.split(" / "), b.split(" / ")) is want


def test_sections_and_lint(spark):
    rows = spark.createDataFrame([("a", "section", 0x1000, 0x100), ("a", "section", 0x3000, 0x10), ("a", "image", 0x0, None)], "path string, kind string, addr long, size long")
    probes = spark.createDataFrame([("a", a) for a in (0x0FFF, 0x1000, 0x10FF, 0x1100, 0x3008)], "path string, addr long")
    assert [(r.section, r.offset) for r in images.to_section(rows, probes).orderBy("addr").collect()] == [(None, None), (1, 0), (1, 0xFF), (None, None), (2, 8)]
    alerts = lambda *codes: spark.createDataFrame([(c,) for c in codes], "code int")
    assert [lint.failed(alerts(101)), lint.failed(alerts(101), True), lint.failed(alerts(207)), lint.failed(alerts(), True)] == [False, True, True, False]
    road = spark.createDataFrame([("0001:00000000", None, 16, None, None, "fun", "f"), ("0001:00000000", "0001:00000008", 16, 24, 8, "fun", "g")], "orig_place string, recomp_place string, orig_addr long, recomp_addr long, displacement long, row_type string, name string")
    assert roadmap.as_text(road).count() == 2 and roadmap.as_text(road, matched_only=True).count() == 1
