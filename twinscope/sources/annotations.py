"""Annotated source code: markers in comments that give the address of what follows.

Single lines are told apart by regular expressions in the JVM. What a marker stands for
depends on the lines after it, so a file is read in order by a small state machine, one
file at a time, in mapInPandas over whole files: no shuffle, and a file never spans
tasks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import PureWindowsPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.functions import codec

# The forms of markers and code lines, and the codes of alerts.
MARKER = r"(?i)^\s*//\s*(\w+):\s*(\w+)\s+(0x[a-f0-9]+) *(\S.+\S)?"
STRICT = r"^\s*// ([A-Z]+): ([A-Z0-9]+) (0x[a-f0-9]+)(?: (\S.+\S))?\n?$"
KINDS = ("FUNCTION", "STUB", "SYNTHETIC", "TEMPLATE", "GLOBAL", "VTABLE", "STRING", "LIBRARY", "LINE")
ALERTS = {
    "UNLIKELY_STUB": 100, "NOT_STRICT_FORMAT": 101, "DUPLICATE_MODULE": 102, "DUPLICATE_OFFSET": 103, "UNKNOWN_ANNOTATION": 104, "MISSED_END_OF_FUNCTION": 105, "MISSED_START_OF_FUNCTION": 106,
    "UNEXPECTED_BLANK_LINE": 107, "UNEXPECTED_END_OF_FILE": 108, "BYNAME_FUNCTION_IN_CPP": 109, "GLOBAL_MISSING_PREFIX": 110, "GLOBAL_NOT_VARIABLE": 111, "ORPHANED_STATIC_VARIABLE": 112,
    "SYMBOL_OPTION_IGNORED": 113, "ALIAS_GOES_NOWHERE": 114, "UNEXPECTED_MARKER": 201, "INCOMPATIBLE_MARKER": 202, "BAD_NAMEREF": 203, "FUNCTION_OUT_OF_ORDER": 204, "NO_SUITABLE_NAME": 205,
    "WRONG_STRING": 206, "NO_IMPLEMENTATION": 207,
}
#: Codes from here on are errors, below warnings.
ERRORS = 200
_CHAR, _TEXT, _BLOCK, _REST = r"'(?:[^'\\]|\\.)'", r'(L)?("(?:[^"\\]|\\.)*")', r"/\*.*?\*/", r"//.*"
_TRAILING = r"\s*(?://|/\*).*$"
_CLASS = r"^\s*(?://)?\s*(?:class|struct) ((?:\w+(?:<.+>)?(?:::)?)+)"
_SCOPE = r"(?:class|struct|namespace) (\w+)"
_VARIABLE = r"((?:\w+::)*\w+)(?:\(\w|\)\(|\[|\s*=|;)"


def markers(lines: DataFrame, line: str = "line", aliases: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Lines that are markers, with kind, module, offset, extra, and whether they are
    well formed. ``aliases`` maps modules to other words for the kinds."""
    # One match a line: all groups at once, between characters that no marker holds.
    groups = F.split(F.regexp_replace(F.col(line), f"{MARKER}(?s:.*)", "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    found = lines.where(F.col(line).rlike(MARKER)).withColumn("_groups", groups)
    part = lambda k: F.get("_groups", F.lit(k - 1))
    kind, module = F.upper(part(1)), F.upper(part(2))
    for target, words in normal_aliases(aliases or {}).items():
        for word, meaning in words.items():
            kind = F.when((module == target) & (F.upper(part(1)) == word), meaning).otherwise(kind)
    return found.select(*lines.columns, kind.alias("kind"), module.alias("module"), codec.from_hex(part(3)).alias("offset"), F.nullif(part(4), F.lit("")).alias("extra"), F.col(line).rlike(STRICT).alias("strict"), kind.isin(*KINDS).alias("known"))


def normal_aliases(aliases: Mapping[str, Mapping[str, str]]) -> dict[str, dict[str, str]]:
    """Aliases that name a kind and are not one, in upper case; the first of equals."""
    out: dict[str, dict[str, str]] = {}
    for target, words in aliases.items():
        kept: dict[str, str] = {}
        for word, meaning in words.items():
            if word.upper() not in KINDS and meaning.upper() in KINDS:
                kept.setdefault(word.upper(), meaning.upper())
        if kept:
            out[target.upper()] = kept
    return out


def code_only(line: Column) -> Column:
    """A line without the contents of strings and without comments."""
    for pattern, put in ((_CHAR, "''"), (_TEXT, '""'), (_BLOCK, ""), (_REST, "")):
        line = F.regexp_replace(line, pattern, put)
    return F.trim(line)


def without_trailing_comment(line: Column) -> Column:
    return F.regexp_replace(line, _TRAILING, "")


def blank_or_comment(line: Column) -> Column:
    return F.trim(line).rlike(r"^(?://|/\*)|\*/$|^$")


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def class_name(line: Column) -> Column:
    """The class that a line declares, pointers in template arguments one space apart."""
    name = F.regexp_extract(line, _CLASS, 1)
    return _or_null(F.regexp_replace(F.regexp_replace(name, r"<(\w+)\s*(\*+)\s*>", "<$1 $2>"), r"<(\w+)\s+>", "<$1>"))


def variable_name(line: Column) -> Column:
    return _or_null(F.regexp_extract(line, _VARIABLE, 1))


def comment_text(line: Column) -> Column:
    return _or_null(F.regexp_extract(line, r"^\s*//\s+(.*)", 1))


def _fix_class(name: str) -> str:
    return re.sub(r"<(\w+)\s*(\*+)?\s*>", lambda m: f"<{m[1]} {m[2]}>" if m[2] else f"<{m[1]}>", name)


def string_literal(line: str) -> tuple[str, bool] | None:
    """The first string on a line, unescaped, and whether it is wide."""
    m = re.search(_TEXT, line)
    if m is None:
        return None
    try:
        return ast.literal_eval(m[2]), m[1] is not None
    except (SyntaxError, ValueError):
        return None


SYMBOL_COLUMNS = ("path", "kind", "marker_type", "module", "offset", "name", "line_number", "end_line", "lookup_by_name", "name_is_symbol", "is_folded", "is_static", "parent_function", "base_class", "is_widechar", "seq")
SYMBOLS = "path string, kind string, marker_type string, module string, offset long, name string, line_number int, end_line int, lookup_by_name boolean, name_is_symbol boolean, is_folded boolean, is_static boolean, parent_function long, base_class string, is_widechar boolean, seq int"
_OUT = SYMBOLS + ", code int, detail string"


@dataclass
class _Mark:
    kind: str
    module: str
    offset: int
    extra: str | None


@dataclass
class _Scopes:
    """Names of the classes and namespaces that are open, by counting braces."""

    open: list[str | None] = field(default_factory=list)
    next: str | None = None

    def read(self, line: str) -> None:
        for pattern, put in ((_CHAR, "''"), (_TEXT, '""'), (_BLOCK, ""), (_REST, "")):
            line = re.sub(pattern, put, line)
        m = re.search(_SCOPE, line)
        if m and not line.rstrip().endswith(";"):
            self.next = m[1]
        for c in line:
            if c == "{":
                self.open.append(self.next)
                self.next = None
            elif c == "}" and self.open:
                self.open.pop()

    def qualified(self, name: str) -> str:
        names = [s for s in self.open if s]
        return "::".join(names if name in names else [*names, name])


#: Marker kinds that may follow each other, by what they wait for.
_FAMILY = {"FUNCTION": "code", "STUB": "code", "SYNTHETIC": "synthetic", "TEMPLATE": "template", "LIBRARY": "library", "GLOBAL": "data", "STRING": "data", "VTABLE": "table"}


class Reader:
    """Reads one file: a queue of markers waits for the line that they describe, and a
    function, once its signature is read, for its end."""

    def __init__(self, path: str, aliases: Mapping[str, Mapping[str, str]]):
        self.path, self.aliases = path, normal_aliases(aliases)
        self.symbols: list[dict] = []
        self.alerts: list[tuple[int, int, str]] = []
        self.scopes = _Scopes()
        self.waiting: dict[tuple, _Mark] = {}  # in the order of the file
        self.family: str | None = None
        self.function: dict | None = None  # between signature and end
        self.body = False  # past the opening brace
        self.number = 0

    def alert(self, name: str, line: str) -> None:
        self.alerts.append((ALERTS[name], self.number, line.strip()))

    def fail(self, name: str, line: str) -> None:
        self.alert(name, line)
        self.waiting, self.family, self.function, self.body = {}, None, None, False

    def emit(self, kind: str, mark: _Mark, name: str, start: int, **more) -> None:
        self.symbols.append({"path": self.path, "kind": kind, "marker_type": mark.kind, "module": mark.module, "offset": mark.offset, "name": name, "line_number": start, "end_line": start, "seq": len(self.symbols), **more})

    def end_function(self, end: int, line: str, by_name: bool = False) -> None:
        f = self.function
        for mark in f["marks"]:
            option = (mark.extra or "").lower()
            if option == "symbol" and not by_name:
                self.alert("SYMBOL_OPTION_IGNORED", line)
            self.emit("function", mark, f["name"], f["start"], end_line=end, lookup_by_name=by_name, name_is_symbol=option == "symbol" and by_name, is_folded=option == "folded")
        self.function, self.body, self.waiting, self.family = None, False, {}, None

    def begin_function(self, name: str) -> None:
        self.function = {"marks": list(self.waiting.values()), "name": name, "start": self.number, "indent": 0}
        self.waiting, self.family = {}, None

    def marker(self, m: re.Match, line: str) -> None:
        module = m[2].upper()
        kind = self.aliases.get(module, {}).get(m[1].upper(), m[1].upper())
        if not re.match(STRICT, line):
            self.alert("NOT_STRICT_FORMAT", line)
        mark = _Mark(kind, module, int(m[3], 16), m[4])
        if self.function and not self.body:
            return self.fail("UNEXPECTED_MARKER", line)
        if self.body and self.family is None and kind not in ("GLOBAL", "STRING", "LINE"):
            self.alert("MISSED_END_OF_FUNCTION", line)
            self.end_function(self.number - 1, line)
        if kind == "LINE":
            return self.emit("line", mark, f"{PureWindowsPath(self.path).name}:{self.number}", self.number)
        family = _FAMILY.get(kind)
        if family is None:
            return self.alert("UNKNOWN_ANNOTATION", line)
        if (self.family or family) != family or (self.body and family != "data"):
            return self.fail("INCOMPATIBLE_MARKER", line)
        category = {"code": "code", "data": kind, "table": "table"}.get(family, "code")
        key = (category, module, mark.extra if family == "table" else None)
        if key in self.waiting:
            self.alert("DUPLICATE_MODULE", line)
        else:
            self.waiting[key] = mark
        self.family = family

    def named(self, line: str) -> None:
        """A function that a comment names."""
        text = re.match(r"\s*//\s+(.*)", line)
        if text is None:
            return self.fail("BAD_NAMEREF", line)
        self.begin_function(text[1].rstrip("\n"))
        self.end_function(self.number, line, by_name=True)

    def code(self, line: str) -> None:
        text = line.strip()
        if not text:
            return self.alert("UNEXPECTED_BLANK_LINE", line)
        if text.startswith("//"):
            return self.named(line)
        if text == "{":
            self.alert("MISSED_START_OF_FUNCTION", line)
            self.begin_function("(unknown)")
            self.body = True
            return None
        signature = re.sub(_TRAILING, "", text)
        if signature.endswith(");"):
            return self.fail("NO_IMPLEMENTATION", line)
        self.begin_function(signature)
        if signature.endswith(("}", "};")):
            self.end_function(self.number, line)
        else:
            self.body = signature.endswith("{")
        return None

    def data(self, line: str) -> None:
        text = line.strip()
        if not text:
            return self.alert("UNEXPECTED_BLANK_LINE", line)
        name = None
        if any(m.kind == "GLOBAL" for m in self.waiting.values()):
            if text.startswith("return"):
                return self.fail("GLOBAL_NOT_VARIABLE", line)
            m = re.match(r"\s*//\s+(.*)", line) if text.startswith("//") else re.search(_VARIABLE, line)
            name = m[1] if m else None
        literal = string_literal(line)
        if name is None and literal is None:
            return self.fail("NO_SUITABLE_NAME", line)
        for mark in self.waiting.values():
            if mark.kind == "STRING":
                if literal is not None:
                    self.emit("string", mark, literal[0], self.number, is_widechar=literal[1])
                continue
            parent = None
            if self.body:
                parent = next((f.offset for f in self.function["marks"] if f.module == mark.module), None)
                if parent is None:
                    self.alert("ORPHANED_STATIC_VARIABLE", line)
                    continue
            if name is not None:
                self.emit("variable", mark, self.scopes.qualified(name), self.number, is_static=self.body, parent_function=parent)
        self.waiting, self.family = {}, None
        return None

    def read(self, line: str) -> None:
        self.number += 1
        m = re.match(MARKER, line)
        if m:
            self.marker(m, line)
            return
        self.scopes.read(line)
        if self.family == "code":
            self.code(line)
        elif self.family in ("synthetic", "template", "library"):
            self.named(line)
        elif self.family == "data":
            self.data(line)
        elif self.family == "table":
            found = re.match(_CLASS, line)
            if found:
                for mark in self.waiting.values():
                    self.emit("vtable", mark, self.scopes.qualified(_fix_class(found[1])), self.number, base_class=mark.extra)
                self.waiting, self.family = {}, None
        elif self.function and not self.body:
            if line.strip() == "{":
                self.function["indent"] = line.index("{")
                self.body = True
        elif self.body:
            at = self.function["indent"]
            if line.strip().startswith("}") and line[at : at + 1] == "}":
                self.end_function(self.number, line)

    def finish(self) -> None:
        if self.family or self.function:
            self.alert("UNEXPECTED_END_OF_FILE", "")


def parse(files: DataFrame, aliases: Mapping[str, Mapping[str, str]] | None = None, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(symbols, alerts) of files given as whole texts, one a row."""
    words = {k: dict(v) for k, v in (aliases or {}).items()}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[dict] = []
            for name, whole in zip(pdf["_path"], pdf["_text"]):
                reader = Reader(name, words)
                for line in (whole or "").splitlines():
                    reader.read(line)
                reader.finish()
                rows += reader.symbols
                rows += [{"path": name, "code": c, "line_number": n, "detail": d} for c, n, d in reader.alerts]
            names = [x.split()[0] for x in _OUT.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    both = files.select(F.col(path).alias("_path"), F.col(text).alias("_text")).mapInPandas(work, _OUT)
    flags = ("lookup_by_name", "name_is_symbol", "is_folded", "is_static", "is_widechar")
    symbols = both.where("code is null").select(*[F.coalesce(c, F.lit(False)).alias(c) if c in flags else c for c in SYMBOL_COLUMNS])
    return symbols, both.where("code is not null").select("code", "path", "line_number", "detail", F.lit(None).cast("string").alias("target"))


def is_error(code: Column) -> Column:
    return code >= ERRORS


def should_skip(kind: Column, marker_type: Column) -> Column:
    return (kind == "function") & (marker_type == "STUB")
