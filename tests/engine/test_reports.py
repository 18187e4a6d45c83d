import pytest
from pyspark.sql import functions as F

from twinscope.operators import lint, reports, roadmap, windows
from twinscope.plans import compare as plan
from twinscope.sources import reports_json

ROW = "sample_id int, filename string, orig_addr string, recomp_addr string, name string, type int, accuracy double, is_effective_match boolean, is_stub boolean"


def rows(spark, *items):
    return spark.createDataFrame([(s, "a.dll", a, r, f"f{a}", t, acc, eff, stub) for s, a, r, t, acc, eff, stub in items], ROW)


def test_combine(spark):
    got = {r.orig_addr: r for r in reports.combine(rows(
        spark, (0, "1", "x", 1, 0.8, False, False), (1, "1", "y", 1, 0.2, False, False), (0, "2", None, 1, 0.2, False, False), (1, "2", None, 1, 0.8, False, True), (0, "3", "x", 1, 0.9, True, False), (1, "3", "x", 1, 1.0, False, False),
        (0, "4", None, 1, 0.5, False, False), (1, "4", "x", 1, 0.5, True, False), (0, "5", "p", 1, 0.5, False, False), (1, "5", "p", 1, 0.5, False, False),
    )).collect()}
    assert (got["1"].accuracy, got["1"].recomp_addr) == (0.8, "various")
    assert (got["2"].accuracy, got["2"].recomp_addr, got["2"].is_stub) == (0.2, None, False)
    assert (got["3"].accuracy, got["3"].is_effective_match) == (1.0, False)
    assert got["4"].is_effective_match and got["4"].recomp_addr == "various" and got["5"].recomp_addr == "p"


def test_judgements(spark):
    old = rows(spark, (0, "1", None, 1, 0.5, False, False), (0, "2", None, 1, 0.5, False, True), (0, "3", None, 1, 1.0, False, False), (0, "4", None, 1, 0.9, True, False), (0, "5", None, 1, 0.9, True, False), (0, "6", None, 1, 0.1, False, True))
    new = rows(spark, (1, "2", None, 1, 0.5, False, True), (1, "3", None, 1, 0.9, True, False), (1, "4", None, 1, 0.8, True, False), (1, "5", None, 1, 1.0, False, False), (1, "6", None, 1, 0.1, False, False), (1, "7", None, 1, 0.1, False, True))
    got = {r.orig_addr: r.judgement for r in reports.diff(old, new).collect()}
    assert got == {"1": "DROPPED", "2": "NO_CHANGE", "3": "ENTROPY", "4": "NO_CHANGE", "5": "INCREASE", "6": "INCREASE", "7": "NEW"}
    lines = {r.orig_addr: r.line for r in reports.diff_lines(reports.diff(old, new)).collect()}
    assert lines["3"] == "3 - f3 (100.00% -> 100.00%*)" and lines["7"] == "7 - f7 (new -> stub)" and lines["1"] == "1 - f1 (50.00% -> gone)"


def test_totals_and_search(spark):
    r = rows(spark, (0, "0x1", "0x1", 1, 0.5, False, False), (0, "0x2", "0x9", 1, 0.5, True, False), (0, "0x3", None, None, 0.25, False, False), (0, "0x4", "0x4", 1, 0.0, False, True), (0, "0x5", None, 5, 1.0, False, False))
    (t,) = reports.totals(r).collect()
    assert (t.functions, t.accuracy, t.effective_accuracy, t.aligned, t.progress_functions, t.progress_accuracy) == (2, 1.0, 1.5, 2, 3, 1.75)
    s = reports.summary(reports.totals(r), unmatched=2).first()
    assert (s.implemented, s.progress) == (0.5, 0.375)
    assert reports.summary(reports.totals(r.limit(0))).first().implemented == 0
    assert {x.orig_addr for x in reports.search(r, "0X2").collect()} == {"0x2"}
    assert reports.search(r, hide_perfect=True, hide_stubs=True).count() == 2
    d = "array<struct<slug:string,groups:array<struct<both:array<array<string>>,orig:array<array<string>>,recomp:array<array<string>>>>>>"
    shown = spark.createDataFrame([("a", [("@", [([["1", "Mov", "2"]], None, None), (None, [["1", "old"]], [["2", "new"]])])]), ("b", None)], f"orig_addr string, diff {d}")
    assert [reports.search(shown, q, k).count() for q, k in (("mov", "code"), ("mov", "diff"), ("NEW", "diff"))] == [1, 0, 1]
    assert [x[0] for x in shown.select(reports.diff_blocks(F.col("diff"))).collect()][0] == 1


def test_files(spark, tmp_path):
    a = rows(spark, (0, "1", None, 1, 0.5, False, False))
    for name, source in (("a", "X.dll"), ("b", "x.DLL"), ("c", "y.dll")):
        (tmp_path / f"{name}.json").write_text(reports_json.to_json(a, source, 1.0).first().value)
    path = lambda n: str(tmp_path / f"{n}.json")
    assert plan.aggregate(spark, [path("a"), path("b")]).count() == 1
    assert plan.compare_reports(spark, path("a"), path("b")).first().judgement == "NO_CHANGE"
    with pytest.raises(ValueError):
        plan.aggregate(spark, [path("a")])
    with pytest.raises(ValueError):
        plan.compare_reports(spark, path("a"), path("c"))
    assert "svg" in reports_json.badge(1, 2, 0.5) and "<script>" in reports_json.page('{"data": []}')


def test_lint(spark):
    y = spark.createDataFrame(
        [("a.cpp", "function", "M", 16, "f", 1, 1, False, False), ("a.cpp", "function", "M", 8, "g", 2, 5, False, False), ("a.cpp", "function", "M", 4, "h", 3, 9, False, True), ("a.cpp", "string", "M", 16, "x", 4, 12, False, False), ("b.cpp", "string", "M", 16, "y", 1, 3, False, False), ("b.cpp", "function", "M", 16, "k", 2, 4, True, False), ("b.h", "function", "M", 32, "k", 1, 4, True, False)],
        "path string, kind string, module string, offset long, name string, seq int, line_number int, lookup_by_name boolean, is_folded boolean",
    )
    none = spark.createDataFrame([], "code int, path string, line_number int, detail string, target string")
    got = sorted((r.code, r.path, r.line_number) for r in lint.files(y, none).collect())
    assert got == [(103, "b.cpp", 4), (109, "b.cpp", 4), (204, "a.cpp", 5), (206, "b.cpp", 3)]
    assert lint.counts(lint.files(y, none)).first()[:] == (2, 2)
    assert lint.aliases(spark, {"T": {"STUB": "FUNCTION", "x": "function", "y": "no"}}).count() == 2


def test_roadmap(spark):
    m = spark.createDataFrame([(0x1010, 0x2020, 1, "f"), (0x1020, 0x2060, 1, "g"), (0x9000, 0x2070, 1, "h")], "orig_addr long, recomp_addr long, type int, name string")
    s = spark.createDataFrame([(0, 1, 0x1000, 0x2000, ".text"), (1, 1, 0x2000, 0x3000, ".text")], "img int, section_id int, start long, stop long, name string")
    c = spark.createDataFrame([(1, 0x2000, 0x40), (2, 0x2040, 0x40)], "module long, start long, size long")
    o = spark.createDataFrame([(1, None, "CMakeFiles/a.dir/x.cpp.obj"), (2, "lib", "b.obj")], "id int, lib string, obj string")
    road = roadmap.rows(m, s, c, o)
    got = {r.name: r for r in road.collect()}
    assert (got["f"].displacement, got["f"].orig_place, got["f"].module) == (0x1010, "0001:00000010", "CMakeFiles/a.dir/x.cpp.obj")
    assert got["h"].displacement is None and got["g"].lib == "lib" and got["f"].row_type == "fun"
    order = roadmap.module_order(road, "fun")
    assert [r.library for r in roadmap.library_order(order).collect()] == ["CMakeFiles/a.dir/", "lib"]
    assert road.select(roadmap.short_name(F.lit("CMakeFiles/a.dir/x.cpp.obj"))).first()[0] == "x.cpp"
    assert roadmap.as_text(road).count() == 3


def test_outliers(spark):
    df = spark.createDataFrame([("a", v) for v in [10] * 9 + [1000]] + [("b", 7)], "k string, v long")
    assert {tuple(r) for r in windows.mean_without_outliers(df, ["k"], "v").collect()} == {("a", 10), ("b", 7)}
