import struct

from pyspark.sql import functions as F

from twinscope.sources import images as im


def tiny():
    """A PE file with code, constants, data, imports, exports and relocations."""
    base = 0x10000000
    code = bytearray(0x200)
    code[0:6] = b"\xff\x25" + struct.pack("<I", base + 0x3000)
    code[0x10:0x16] = b"\xd9\x05" + struct.pack("<I", base + 0x2010)
    code[0x20:0x26] = b"\xb8" + struct.pack("<I", base + 0x2040) + b"\xe9"
    code[0x30:0x38] = b"\x2b\x49\xfc\xe9" + struct.pack("<i", -0x38)
    const = bytearray(0x200)
    const[0x10:0x14] = struct.pack("<f", 1.5)
    const[0x40:0x4C] = struct.pack("<III", 0x19930520, 1, base + 0x2060)
    const[0x60:0x68] = struct.pack("<iI", -1, base + 0x1000)
    const[0x100:0x106] = b"hello\0"
    data = bytearray(0x200)  # imports at 0x3000
    data[0:8] = struct.pack("<II", 0x30F0, 0)
    data[0x20:0x28] = struct.pack("<II", 0x30F0, 0)
    data[0x40:0x54] = struct.pack("<5I", 0x3020, 0, 0, 0x30E0, 0x3000)
    data[0xE0:0xEA] = b"dll.dll\0\0\0"
    data[0xF0:0xF8] = b"\0\0fname\0"
    data[0x100:0x128] = struct.pack("<2L2H7L", 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0)
    data[0x128:0x130] = struct.pack("<II", 0x1030, 0x30E0)
    reloc = struct.pack("<IIHHHH", 0x1000, 16, 0x3002, 0x3012, 0x3180, 0)
    code[0x180:0x184] = struct.pack("<I", base + 0x2100)
    dirs = [(0x3100, 40), (0x3040, 40), (0, 0), (0, 0), (0, 0), (0x4000, 16)] + [(0, 0)] * 10
    optional = struct.pack("<HBBIIIIIIIII", 0x10B, 0, 0, 0, 0, 0, 0x1000, 0x1000, 0x2000, base, 0x1000, 0x200) + bytes(96 - 40 - 4) + struct.pack("<I", 16) + b"".join(struct.pack("<II", *d) for d in dirs)
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", im.I386, 4, 0, 0, 0, len(optional), 0)
    sections, raw = b"", 0x400
    for name, rva, flags in ((b".text", 0x1000, im.CODE | im.EXECUTE | im.READ), (b".rdata", 0x2000, im.INITIALISED | im.READ), (b".data", 0x3000, im.INITIALISED | im.READ | im.WRITE), (b".reloc", 0x4000, im.INITIALISED | im.READ)):
        sections += struct.pack("<8s6I2HI", name, 0x200, rva, 0x200, raw, 0, 0, 0, 0, flags)
        raw += 0x200
    return (head + optional + sections).ljust(0x400, b"\0") + bytes(code) + bytes(const) + bytes(data) + reloc.ljust(0x200, b"\0")


def test_decode(spark):
    base = 0x10000000
    files = spark.createDataFrame([("a.dll", bytearray(tiny())), ("b.txt", bytearray(b"text")), ("c", None)], "path string, content binary")
    rows = im.decode(files).cache()
    by = {}
    for r in rows.collect():
        by.setdefault(r.kind, []).append(r)
    assert (by["image"][0].addr, by["image"][0].target) == (base, base + 0x1000)
    assert [r.name for r in by["section"]] == [".text", ".rdata", ".data", ".reloc"]
    assert [(r.addr, r.target) for r in by["relocation"]] == [(base + 0x1002, base + 0x3000), (base + 0x1012, base + 0x2010), (base + 0x1180, base + 0x2100)]
    assert [(r.addr, r.name, r.extra) for r in by["import"]] == [(base + 0x3000, "fname", "dll.dll")]
    assert [(r.addr, r.name) for r in by["export"]] == [(base + 0x1030, "dll.dll")]
    assert [(r.addr, r.target) for r in by["import_thunk"]] == [(base + 0x1000, base + 0x3000)]
    assert [(r.addr, r.size, r.value) for r in by["float"]] == [(base + 0x2010, 4, 1.5)]
    assert [(r.addr, r.target, r.n1) for r in by["handler"]] == [(base + 0x1020, base + 0x2040, 1)]
    assert [(r.addr, r.n1, r.n2, r.target) for r in by["adjuster"]] == [(base + 0x1030, -4, 0, base + 0x1000)]
    assert "hello" in [r.name for r in by["string"]]
    assert im.regions(rows, im.CODE).count() == 1
    assert files.select(im.file_format(F.col("content"))).collect() == [("PE",), (None,), (None,)]
    probes = spark.createDataFrame([("a.dll", base), ("a.dll", base - 1), ("a.dll", base + 0x41FF), ("a.dll", base + 0x4200)], "path string, addr long")
    assert im.valid_address(rows, probes).count() == 2
    places = spark.createDataFrame([("a.dll", 2, 16), ("a.dll", 9, 0)], "path string, section int, offset long")
    assert [r.addr for r in im.to_address(rows, places).orderBy("section").collect()] == [base + 0x2010, None]


def test_scans():
    assert list(im.adjusters(b"\x2b\x49\xfc\x81\xc1\xf0\xff\xff\xff\xe9\0\0\0\0", 16)) == [(16, -4, 2**32 + 16, 30, 14)]
    assert list(im.adjusters(b"\x2b\x49\xfc\x83\xe9\x08\xe9\0\0\0\0")) == [(0, -4, 8, 11, 11)]
    assert list(im.float_uses(b"\xd9\x1d\0\0\0\0\xdc\x0d\1\0\0\0")) == [(6, 1, 8)]
