"""Text files: discovery, whole files, numbered lines, and delimited metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec

#: Extensions of C and C++ code.
CODE = ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx")
UNREADABLE, MISSING = 302, 301


def discover(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = CODE) -> DataFrame:
    """Paths of code files below the folders, without repeats, in any-case order."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).select("path")
    return found.where(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*extensions)).distinct().orderBy(F.lower("path"), "path")


def files(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(path, text) of whole files; text is null where the bytes are not in the encoding."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    if encoding.upper().replace("-", "") == "UTF8":
        return raw.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return raw.select("path", F.decode("content", encoding).alias("text"))


def unreadable(read: DataFrame) -> DataFrame:
    """Alerts for files whose text could not be decoded."""
    return read.where("text is null").select(F.lit(UNREADABLE).alias("code"), "path", F.lit(0).alias("line_number"), F.lit("cannot decode").alias("detail"), F.lit(None).cast("string").alias("target"))


def lines(read: DataFrame) -> DataFrame:
    """(path, line_no, line) of files; any line ending counts."""
    return read.where("text is not null").select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("_i", "line")).select("path", (F.col("_i") + 1).alias("line_no"), "line")


# Delimited metadata

# Words for entity types in metadata.
METADATA_TYPES = {"function": schema.FUNCTION, "template": schema.FUNCTION, "synthetic": schema.FUNCTION, "library": schema.FUNCTION, "stub": schema.FUNCTION, "global": schema.DATA, "string": schema.STRING, "widechar": schema.WIDECHAR, "float": schema.FLOAT, "vtable": schema.VTABLE}
NO_DELIMITER, NO_ADDRESS, DUPLICATE_COLUMN = "no delimiter in the header", "no address column", "a column is named twice"
COLUMNS = ("address", "name", "symbol", "type", "size")


class MetadataError(ValueError):
    """The header of a metadata file cannot be used."""


def sniff(header: str) -> tuple[str, list[str]]:
    """(delimiter, lower-case column names) of a header line."""
    delimiter = next((d for d in "|,\t" if d in header), None)
    if delimiter is None:
        raise MetadataError(NO_DELIMITER)
    names = [c.strip().lower() for c in header.split(delimiter)]
    if len(set(names)) < len(names):
        raise MetadataError(DUPLICATE_COLUMN)
    if "address" not in names:
        raise MetadataError(NO_ADDRESS)
    return delimiter, names


def metadata(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of one metadata file given as numbered lines (line_no, line).

    Comments and blank lines do not count; the first line that does is the header, and
    the only thing that the driver reads. A row that cannot be used is an error with its
    line and the value at fault. Quotes keep delimiters, a backslash keeps what follows.
    """
    text = F.trim("line")
    used = numbered.where((text != "") & ~text.startswith("#") & ~text.startswith("//"))
    header = used.orderBy("line_no").first()
    if header is None:
        raise MetadataError(NO_DELIMITER)
    delimiter, names = sniff(header.line)
    body = used.where(F.col("line_no") > header.line_no)
    options = {"sep": delimiter, "escape": "\\", "quote": '"', "mode": "PERMISSIVE"}
    kinds = ", ".join(f"`{c}` string" for c in names)
    parsed = body.select("line_no", F.from_csv("line", F.lit(kinds), options).alias("r"))
    of = lambda c: F.nullif(F.col(f"r.{c}"), F.lit("")) if c in names else F.lit(None).cast("string")
    words = F.create_map(*[F.lit(x) for pair in METADATA_TYPES.items() for x in pair])
    kind = F.lower(F.trim(of("type")))
    wide = parsed.select("line_no", codec.from_hex(of("address")).alias("addr"), of("name").alias("name"), of("symbol").alias("symbol"), F.try_element_at(words, kind).alias("type"), codec.from_decimal_or_hex(of("size")).alias("size"), (kind == "stub").alias("stub"), (kind == "library").alias("library"), of("address").alias("_a"), of("type").alias("_t"), of("size").alias("_s"))
    fault = lambda name, c: F.struct(F.lit(name).alias("error"), F.col(c).alias("value"))
    wrong = F.when(F.col("addr").isNull(), fault("InvalidAddress", "_a")).when(F.col("_t").isNotNull() & F.col("type").isNull(), fault("InvalidEntityType", "_t")).when(F.col("_s").isNotNull() & F.col("size").isNull(), fault("InvalidNumber", "_s"))
    checked = wide.withColumn("wrong", wrong)
    flag = lambda c: F.when(F.col(c), True)
    rows = checked.where("wrong is null").select("line_no", "addr", "name", "symbol", "type", "size", flag("stub").alias("stub"), flag("library").alias("library"))
    return rows, checked.where("wrong is not null").select("line_no", "wrong.error", "wrong.value")


# Paths of another system

def path_parts(path: str):
    """Components from the end, in lower case."""
    return F.reverse(F.filter(F.split(F.lower(path), r"[/\\]+"), lambda x: x != ""))


def local_paths(foreign: DataFrame, local: DataFrame, column: str = "foreign_path") -> DataFrame:
    """Each foreign path with the local path that ends like it, component by component,
    for the longest; null if there is none or several are as good. Only paths with the
    same file name meet."""
    f = foreign.select(column).distinct().withColumn("_f", path_parts(column)).withColumn("_name", F.get("_f", F.lit(0)))
    c = local.select(F.col("local_path")).distinct().withColumn("_l", path_parts("local_path")).withColumn("_name", F.get("_l", F.lit(0)))
    same = F.aggregate(
        F.zip_with("_f", "_l", lambda a, b: F.coalesce((a == b) & ~a.isin(".", ".."), F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")),
        lambda s: s["n"],
    )
    scored = f.join(c, "_name").withColumn("_score", same)
    w = Window.partitionBy(column)
    best = scored.withColumn("_top", F.max("_score").over(w)).where("_score = _top").groupBy(column).agg(F.count("*").alias("_n"), F.min("local_path").alias("local_path")).where("_n = 1").drop("_n")
    return foreign.join(best, column, "left")
