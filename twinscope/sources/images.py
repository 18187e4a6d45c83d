"""Executable images as tables: headers, sections, relocations, imports, exports.

An image is one row of binaryFile, so decoding needs no shuffle: a task walks the tables
of its files and emits rows of one narrow shape, of which each accessor below is a
filter. Patterns in code are found in the sections' bytes the same way.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places in headers, flags of sections, numbers of data directories.
I386 = 0x14C
CODE, INITIALISED, UNINITIALISED, EXECUTE, READ, WRITE = 0x20, 0x40, 0x80, 0x20000000, 0x40000000, 0x80000000
EXPORTS, IMPORTS, RELOCATIONS, DEBUG = 0, 1, 5, 6


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def file_format(content: Column) -> Column:
    """PE, LE, NE, NX, MZ, ELF or MACHO by the first bytes; null for others."""
    at = lambda start, n: F.substring(content, start, F.lit(n))
    second = F.decode(at((_dword(content, 60) + 1).cast("int"), 2), "ISO-8859-1")
    dos = F.when(second.isin("PE", "LE", "NE", "NX"), second).otherwise(F.lit("MZ"))
    magic = F.hex(at(F.lit(1), 4))
    return F.when(magic.startswith("4D5A"), dos).when(magic == "7F454C46", "ELF").when(magic.isin("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE"), "MACHO")


def _dword(content: Column, offset: int) -> Column:
    byte = lambda k: F.conv(F.hex(F.substring(content, offset + k + 1, 1)), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


@dataclass
class Image:
    """A PE file: its sections and what its directories list, by absolute address."""

    data: bytes
    base: int
    entry: int
    is_debug: bool
    sections: list[tuple[str, int, int, int, int, int]]  # name, start, virtual size, raw offset, raw size, flags
    directories: list[tuple[int, int]]

    @staticmethod
    def parse(data: bytes) -> Image | None:
        """The image, or None if it is not a PE file for i386."""
        if data[:2] != b"MZ":
            return None
        (at,) = struct.unpack_from("<I", data, 60)
        if data[at : at + 4] != b"PE\0\0":
            return None
        machine, n_sections, _, symbols, _, optional, flags = struct.unpack_from("<HHIIIHH", data, at + 4)
        if machine != I386:
            return None
        head = at + 24
        wide = struct.unpack_from("<H", data, head)[0] == 0x20B
        (entry,) = struct.unpack_from("<I", data, head + 16)
        base = struct.unpack_from("<Q", data, head + 24)[0] if wide else struct.unpack_from("<I", data, head + 28)[0]
        first = head + (112 if wide else 96)
        (n,) = struct.unpack_from("<I", data, first - 4)
        directories = [struct.unpack_from("<II", data, first + 8 * k) for k in range(min(n, 16))]
        rows = []
        for k in range(n_sections):
            name, virtual, rva, raw_size, raw, _, _, _, _, bits = struct.unpack_from("<8s6I2HI", data, head + optional + 40 * k)
            rows.append((name.rstrip(b"\0").decode("ascii", "replace"), base + rva, virtual, raw, raw_size, bits))
        debug = len(directories) > DEBUG and directories[DEBUG][1] > 0
        return Image(data, base, base + entry, debug, rows, directories)

    def extent(self, s: tuple) -> int:
        return max(s[2], s[4])

    def view(self, addr: int) -> bytes:
        """The bytes that the file has from an address to the end of its section."""
        for s in self.sections:
            if s[1] <= addr < s[1] + self.extent(s):
                return self.data[s[3] + addr - s[1] : s[3] + s[4]]
        return b""

    def read(self, addr: int, size: int) -> bytes | None:
        """Bytes with zeros for what the file leaves out; None across a section's end."""
        for s in self.sections:
            if s[1] <= addr and addr + size <= s[1] + self.extent(s):
                return self.view(addr)[:size].ljust(size, b"\0")
        return None

    def text(self, addr: int) -> str:
        return self.view(addr).split(b"\0", 1)[0].decode("latin-1")

    def directory(self, k: int) -> int | None:
        return self.base + self.directories[k][0] if k < len(self.directories) and self.directories[k][0] else None

    def regions(self, need: int, without: int = 0) -> Iterator[tuple[int, bytes]]:
        for s in self.sections:
            if s[5] & need == need and not s[5] & without:
                yield s[1], self.data[s[3] : s[3] + min(s[4], s[2] or s[4])]

    def relocations(self) -> Iterator[int]:
        at = self.directory(RELOCATIONS)
        table = self.view(at) if at else b""
        while len(table) >= 8:
            page, size = struct.unpack_from("<II", table)
            if size < 8:
                return
            yield from (self.base + page + (v & 0xFFF) for (v,) in struct.iter_unpack("<H", table[8 : size - size % 2]) if v)
            table = table[size:]

    def imports(self) -> Iterator[tuple[int, str, int | None, str | None]]:
        at = self.directory(IMPORTS)
        while at and (row := self.read(at, 20)) and any(row):
            lookup, _, _, module, slot = struct.unpack("<5I", row)
            k = 0
            while (cell := self.read(self.base + lookup + k, 4)) and (there := self.read(self.base + slot + k, 4)) and any(cell) and any(there):
                (value,) = struct.unpack("<I", cell)
                by_number = bool(value >> 31)
                yield self.base + slot + k, self.text(self.base + module), value & 0x7FFF if by_number else None, None if by_number else self.text(self.base + value + 2)
                k += 4
            at += 20

    def exports(self) -> Iterator[tuple[int, str]]:
        at = self.directory(EXPORTS)
        if at is None:
            return
        (n,) = struct.unpack("<I", self.read(at + 20, 4))
        cells = struct.unpack(f"<{2 * n}I", self.read(at + 40, 8 * n) or bytes(8 * n))
        yield from ((self.base + f, self.text(self.base + name)) for f, name in zip(cells[:n], cells[n:]))

    def thunks(self) -> Iterator[tuple[int, int]]:
        """Jumps at the start of the code, which builds for debugging put there."""
        for start, code in self.regions(CODE):
            k = 0
            while self.is_debug and code[k : k + 1] == b"\xe9" and len(code) >= k + 5:
                yield start + k, start + k + 5 + struct.unpack_from("<i", code, k + 1)[0]
                k += 5

    def symbol_file(self) -> str | None:
        at = self.directory(DEBUG)
        row = self.read(at, 28) if at else None
        if row is None:
            return None
        size, _, raw = struct.unpack_from("<3I", row, 16)
        entry = self.data[raw : raw + size]
        skip = {b"NB10": 16, b"RSDS": 24}.get(entry[:4])
        return entry[skip:].split(b"\0", 1)[0].decode("latin-1") if skip else None


# Patterns in code. Opcodes.
_JUMP = re.compile(rb"(?s)(?=\xff\x25(.{4}))")
_FLOAT = re.compile(rb"(?s)(?=([\xd8\xd9\xdc\xdd])([\x05\x0d\x15\x1d\x25\x2d\x35\x3d])(.{4}))")
_HANDLER = re.compile(rb"(?s)(?=\xb8(.{4})\xe9)")
_SHIFT = re.compile(rb"(?s)(?=\x2b\x49(.)(?:\xe9(.{4})|\x81\xc1(.{4})\xe9(.{4})|\x83\xe9(.)\xe9(.{4})))")
_INFO = re.compile(rb"\x20\x05\x93\x19")


def _number(form: str, data: bytes) -> int:
    return struct.unpack("<" + form, data)[0]



def jumps(code: bytes, base: int = 0) -> Iterator[tuple[int, int]]:
    """(place, address of the target) of absolute jumps."""
    return ((base + m.start(), _number("I", m[1])) for m in _JUMP.finditer(code))


def float_uses(code: bytes, base: int = 0) -> Iterator[tuple[int, int, int]]:
    """(place, address, size) of instructions that take a float from memory. Loads are
    the only ones with an opcode of their own."""
    for m in _FLOAT.finditer(code):
        op, kind = m[1][0], m[2][0]
        if op in (0xD8, 0xDC) or kind == 0x05:
            yield base + m.start(), _number("I", m[3]), 4 if op in (0xD8, 0xD9) else 8


def handlers(code: bytes, base: int = 0) -> Iterator[tuple[int, int]]:
    """(place, address of the table) of exception handlers."""
    return ((base + m.start(), _number("I", m[1])) for m in _HANDLER.finditer(code))


def unwind_tables(data: bytes, base: int = 0) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(address, entries) of exception tables."""
    for m in _INFO.finditer(data):
        if m.start() + 12 > len(data):
            continue
        n, at = struct.unpack_from("<II", data, m.start() + 4)
        at -= base
        yield base + m.start(), [struct.unpack_from("<iI", data, at + 8 * k) for k in range(n) if 0 <= at + 8 * k <= len(data) - 8]


def adjusters(code: bytes, base: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(place, first shift, second shift, target, size) of functions that adjust the
    object pointer and jump on."""
    for m in _SHIFT.finditer(code):
        first = _number("b", m[1])
        if m[2]:
            second, jump, size = 0, m[2], 8
        elif m[3]:
            second, jump, size = 2**32 - _number("i", m[3]), m[4], 14
        else:
            second, jump, size = _number("b", m[5]), m[6], 11
        yield base + m.start(), first, second, base + m.start() + size + _number("i", jump), size


ROW = "path string, kind string, addr long, target long, size long, n1 long, n2 long, name string, extra string, value double"


def decode(files: DataFrame) -> DataFrame:
    """Rows of all tables and patterns of the images in ``files`` (path, content).

    kind: image (addr is the base, target the entry), section (size is the extent, n1
    the flags, n2 the size in the file), relocation (target is what is there), import,
    export, thunk, import_thunk, float, handler, adjuster, string.
    """

    def rows_of(path: str, image: Image) -> Iterator[dict]:
        row = lambda kind, addr, **more: {"path": path, "kind": kind, "addr": addr, **more}
        yield row("image", image.base, target=image.entry, name=image.symbol_file(), n1=int(image.is_debug))
        for name, start, virtual, _, raw, bits in image.sections:
            yield row("section", start, size=max(virtual, raw), n1=bits, n2=raw, name=name)
        fixed = set(image.relocations())
        for addr in sorted(fixed):
            view = image.view(addr)
            yield row("relocation", addr, target=_number("I", view[:4]) if len(view) >= 4 else None)
        imports = {}
        for addr, module, number, name in image.imports():
            imports[addr] = name
            yield row("import", addr, name=name, extra=module, n1=number)
        for k, (addr, name) in enumerate(image.exports()):
            yield row("export", addr, name=name, n1=k)
        for addr, target in image.thunks():
            yield row("thunk", addr, target=target, size=5)
        constant = [(s[1], s[1] + image.extent(s)) for s in image.sections if s[5] & INITIALISED and not s[5] & (WRITE | EXECUTE)]
        tables = {a: e for start, data in image.regions(INITIALISED, WRITE | EXECUTE) for a, e in unwind_tables(data, start)}
        seen: set[int] = set()
        for start, code in image.regions(CODE):
            for addr, target in jumps(code, start):
                if addr + 2 in fixed and target in imports:
                    yield row("import_thunk", addr, target=target, size=6)
            for addr, pointer, size in float_uses(code, start):
                if pointer in seen:
                    continue
                seen.add(pointer)  # even if this use does not count: the first one decides
                block = image.read(pointer, size)
                if addr + 2 in fixed and block and any(a <= pointer < b for a, b in constant):
                    yield row("float", pointer, size=size, value=struct.unpack("<f" if size == 4 else "<d", block)[0], name=str(struct.unpack("<f" if size == 4 else "<d", block)[0]))
            for addr, table in handlers(code, start):
                if table in tables:
                    yield row("handler", addr, target=table, n1=len(tables[table]))
            for addr, first, second, target, size in adjusters(code, start):
                yield row("adjuster", addr, target=target, size=size, n1=first, n2=second)
        data = [(s[1], s[1] + image.extent(s)) for s in image.sections if s[5] & INITIALISED and not s[5] & EXECUTE]
        pointers = {_number("I", v[:4]) for a in fixed if len(v := image.view(a)) >= 4}
        end = 0
        for addr in sorted(p for p in pointers if any(a <= p < b for a, b in data)):
            text = image.text(addr)
            if text and addr >= end and re.fullmatch(r"[\t\r\n\x20-\x7f][\t\r\n\x20-\x7f\xa0-\xff]*", text):
                end = addr + len(text)
                yield row("string", addr, size=len(text) + 1, name=text)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                image = Image.parse(bytes(content)) if content is not None else None
                if image is not None:
                    out = pd.DataFrame(rows_of(path, image), columns=names)
                    yield out.astype(object).where(out.notna(), None)

    return files.select("path", "content").mapInPandas(work, ROW)


def valid_address(rows: DataFrame, addresses: DataFrame, addr: str = "addr") -> DataFrame:
    """Addresses between the image's base and the end of its last section; gaps count."""
    bounds = rows.where("kind in ('image', 'section')").groupBy("path").agg(F.min(F.when(F.col("kind") == "image", F.col("addr"))).alias("_lo"), F.max(F.when(F.col("kind") == "section", F.col("addr") + F.col("size"))).alias("_hi"))
    return addresses.join(bounds, "path").where((F.col(addr) >= F.col("_lo")) & (F.col(addr) < F.col("_hi"))).drop("_lo", "_hi")


def to_address(rows: DataFrame, places: DataFrame) -> DataFrame:
    """places (path, section from 1, offset) with their absolute address; null if there is
    no such section."""
    from pyspark.sql import Window

    numbered = rows.where("kind = 'section'").withColumn("section", F.row_number().over(Window.partitionBy("path").orderBy("addr")))
    return places.join(numbered.select("path", "section", F.col("addr").alias("_start")), ["path", "section"], "left").withColumn("addr", F.col("_start") + F.col("offset")).drop("_start")


def to_section(rows: DataFrame, addresses: DataFrame, addr: str = "addr") -> DataFrame:
    """addresses (path, addr) with their section, from 1, and offset in it; null outside of
    all sections."""
    from pyspark.sql import Window

    from twinscope.operators import joins

    ranges = rows.where("kind = 'section'").withColumn("section", F.row_number().over(Window.partitionBy("path").orderBy("addr"))).select("path", F.col("addr").alias(addr), "size", "section")
    found = joins.interval_join(addresses, ranges, addr, ("path",), start=addr, columns=("section",))
    return found.select(*addresses.columns, "section", F.when(F.col("section").isNotNull(), F.col(addr) - F.col("base")).alias("offset"))


def regions(rows: DataFrame, need: int, without: int = 0) -> DataFrame:
    """Sections with all of some flags and none of others."""
    s = rows.where("kind = 'section'")
    return s.where((F.col("n1").bitwiseAND(F.lit(need)) == need) & (F.col("n1").bitwiseAND(F.lit(without)) == 0))
