"""Saved reports as JSON, and the other forms that results are written in."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscope import schema
from twinscope.functions import codec, report

#: The version of the file format that is read and written.
FORMAT = 1
_ROW = "struct<address string, name string, matching double, recomp string, stub boolean, effective boolean, type int, diff string>"
FILE = "file string, format int, timestamp double, data array<struct<address string, name string, matching double, recomp string, stub boolean, effective boolean, type int, diff string>>"


def parse(texts: DataFrame, text: str = "text") -> DataFrame:
    """Report rows (schema.REPORT) of JSON texts numbered by sample_id. A text that is no
    report of this version, or lacks what a report must have, yields no rows."""
    read = texts.select("sample_id", F.from_json(text, FILE).alias("r"))
    ok = read.where((F.col("r.format") == FORMAT) & F.col("r.file").isNotNull() & F.col("r.timestamp").isNotNull() & F.col("r.data").isNotNull())
    ok = ok.where(F.forall("r.data", lambda x: x["address"].isNotNull() & x["name"].isNotNull() & x["matching"].isNotNull()))
    each = ok.select("sample_id", "r.file", F.explode("r.data").alias("e"))
    known = F.when(F.col("e.type").isin(*schema.TYPE_NAMES), F.col("e.type"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return each.select("sample_id", F.col("file").alias("filename"), F.col("e.address").alias("orig_addr"), F.col("e.recomp").alias("recomp_addr"), "e.name", known.alias("type"), F.col("e.matching").alias("accuracy"), no(F.col("e.effective")).alias("is_effective_match"), no(F.col("e.stub")).alias("is_stub"), F.from_json("e.diff", "array<array<string>>").alias("raw_diff"))


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of report files, numbered in the order of ``paths``."""
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, sample_id int")
    texts = spark.read.text(list(paths), wholetext=True).select(F.col("value").alias("text"), F.regexp_replace(F.input_file_name(), r"^file:/*", "/").alias("path"))
    return parse(texts.join(order.withColumn("path", F.regexp_replace("path", r"^file:/*", "/")), "path"))


def to_json(rows: DataFrame, filename: str, timestamp: float, diff: str | None = None) -> DataFrame:
    """One row with the report as JSON text; what has its default value is left out."""
    unless = lambda c, v: F.when(c != v, c)
    fields = [
        F.col("orig_addr").alias("address"), "name", F.col("accuracy").alias("matching"), F.col("recomp_addr").alias("recomp"), unless(F.col("is_stub"), F.lit(False)).alias("stub"),
        unless(F.col("is_effective_match"), F.lit(False)).alias("effective"), *([F.col(diff).alias("diff")] if diff else []), "type",
    ]
    data = F.array_sort(F.collect_list(F.struct(*fields)))
    whole = rows.agg(data.alias("data")).select(F.struct(F.lit(filename).alias("file"), F.lit(FORMAT).alias("format"), F.lit(float(timestamp)).alias("timestamp"), "data").alias("r"))
    return whole.select(F.to_json("r", {"ignoreNullFields": "true"}).alias("value"))


def to_csv(rows: DataFrame, columns: Sequence[str], addresses: Sequence[str] = ()) -> DataFrame:
    """Rows as unquoted delimited text, addresses in hexadecimal, nulls empty."""
    shown = [F.coalesce(codec.to_hex(F.col(c)) if c in addresses else F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(F.concat_ws(",", *shown).alias("value"))


def one_line(rows: DataFrame) -> DataFrame:
    text = F.when(F.col("is_stub"), "stub").otherwise(report.percent_text(report.effective_accuracy(F.col("accuracy"), F.col("is_effective_match")), F.col("is_effective_match")))
    return rows.select("orig_addr", F.concat("name", F.lit(" ("), "orig_addr", F.lit(" / "), F.coalesce("recomp_addr", F.lit("n/a")), F.lit(") is "), text, F.lit(" similar to the original")).alias("line"))


def diff_text(diffs: DataFrame, key: str = "orig_addr") -> DataFrame:
    """Diffs as lines: the headings, common lines, and - and + for what differs."""
    blocks = diffs.select(key, F.posexplode("diff").alias("d", "g")).select(key, "d", "g.slug", F.posexplode("g.groups").alias("b", "x"))
    line = lambda mark, lines, k: F.transform(F.coalesce(lines, F.array().cast("array<array<string>>")), lambda v: F.concat(F.coalesce(F.get(v, F.lit(0)), F.lit("")), F.lit(f" : {mark} "), F.get(v, F.lit(k))))
    body = F.concat(line(" ", F.col("x.both"), 1), line("-", F.col("x.orig"), 1), line("+", F.col("x.recomp"), 1))
    all_ = F.concat(F.when(F.col("b") == 0, F.array("slug")).otherwise(F.array().cast("array<string>")), body)
    return blocks.select(key, "d", "b", F.posexplode(all_).alias("n", "line"))


def badge(implemented: int, total: int, accuracy: float, title: str = "progress") -> str:
    """A small SVG picture of two shares."""
    share = implemented / total if total else 0.0
    bar = lambda y, v: f'<rect x="0" y="{y}" width="200" height="8" fill="#ddd"/><rect x="0" y="{y}" width="{200 * min(1.0, max(0.0, v)):.1f}" height="8" fill="#3a7"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="200" height="60"><text x="0" y="12">{html.escape(title)} {100 * share:.2f}%</text>{bar(18, share)}{bar(34, accuracy)}</svg>'


def page(report_json: str, title: str = "report") -> str:
    """A page that holds a report and lists it."""
    safe = json.dumps(json.loads(report_json)).replace("</", "<\\/")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table id=t></table><script>const r={safe};t.innerHTML=r.data.map(e=>'<tr><td>'+e.address+'<td>'+(100*e.matching).toFixed(2)+'%').join('')</script>"


def write(rows: DataFrame, path: str, filename: str, timestamp: float, diff: str | None = None) -> None:
    """Write a report as one JSON text."""
    to_json(rows, filename, timestamp, diff).coalesce(1).write.mode("overwrite").text(path)
