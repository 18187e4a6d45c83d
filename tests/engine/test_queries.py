"""Registered queries without SQL, against brute force over whole tables."""

import math

from twinscope import queries, queries_more


def parts(n=120):
    return [(k, f"{'red blue green'.split()[k % 7 % 3]} part", f"Brand#{k % 5 % 2}", "SMALL", k * 7 % 50 + 1) for k in range(n)]


def test_match_static_variables_uses_every_part(spark, tmp_path):
    spark.createDataFrame(parts(), "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    free, want = {k: f"?{brand}@?1?{name.replace(' ', '_')}@" for k, name, brand, *_ in parts() if k % 2}, set()
    for k, name, brand, *_ in parts():
        if k % 2 == 0:
            at = next((r for r, symbol in free.items() if f"?{name.replace(' ', '_')}@" in symbol and brand in symbol), None)
            if at is not None:
                del free[at]
                want.add((k * 16 + queries.BASE + 8, at * 16 + queries.BASE))
    got = queries.match_static_variables(spark, str(tmp_path)).collect()
    assert len(want) > 30 and {(r.orig_addr, r.recomp_addr) for r in got} == want


def test_match_static_variables_with_many_of_one_name(spark, tmp_path):
    spark.createDataFrame([(k, "red part", "Brand#1", "SMALL", 1) for k in range(100)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.match_static_variables(spark, str(tmp_path)).collect()
    assert sorted((r.orig_addr, r.recomp_addr) for r in got) == [(k * 16 + queries.BASE + 8, (k + 1) * 16 + queries.BASE) for k in range(0, 100, 2)]


def orders(spark, tmp_path):
    """Five reports of 500 rows. All prices are half-way between two accuracies, but some of
    the shares are, as doubles, just below."""
    rows = [(k, k % 500, "P" if k % 13 == 0 else "F", 40.0 * (k * 7 % 500) + 20, f"{k // 500 + 1}-X") for k in range(2500)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = []
    for k, cust, status, price, priority in rows:
        accuracy = min(1.0, math.floor(price / 400000 * 10000 + 0.5) / 10000)
        found.append((int(priority[0]), hex(cust), accuracy, k % 7 == 0, status == "P"))
    return found


def ranked(found):
    rank = lambda r: -1.0 if r[4] else 1.0 if r[3] else r[2]
    return sorted(found, key=lambda r: (-rank(r), r[1], r[0]))


def test_ui_pages_round_as_their_sql(spark, tmp_path):
    want = [(r[0], r[1], n // 200, n % 200 + 1) for n, r in enumerate(ranked(orders(spark, tmp_path)))]
    got = queries.ui_pages(spark, str(tmp_path)).select("sample_id", "orig_addr", "page", "row").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_one_line_matches_rounds_as_its_sql(spark, tmp_path):
    text = {(r[1], "stub" if r[4] else f"{100 * (1.0 if r[3] else r[2]):.2f}%" + "*" * r[3]) for r in orders(spark, tmp_path)}
    got = queries_more.one_line_matches(spark, str(tmp_path)).collect()
    assert len(got) == 2500 and {(r.orig_addr, r.line.split(" is ")[1].removesuffix(" similar to the original")) for r in got} == text


def test_one_line_matches_below_zero_and_without_a_key(spark, tmp_path):
    rows = [(None, 1, "F", 100000.0, "1-X"), (3, 1, "F", 300000.0, "1-X"), (1, 2, "F", -5.0, "1-X"), (2, 3, "F", -0.0, "1-X"), (4, 4, "F", 5.0, "1-X"), (5, 5, "F", -80.0, "1-X")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries_more.one_line_matches(spark, str(tmp_path)).collect()
    want = ["f1 (0x1 / 0x1) is 75.00%", "f2 (0x2 / 0x3) is -0.00%", "f3 (0x3 / 0x5) is -0.00%", "f4 (0x4 / 0x5) is 0.00%", "f5 (0x5 / 0x7) is -0.02%"]
    assert sorted(r.line.removesuffix(" similar to the original") for r in got) == want


def test_ui_page_headings_round_as_their_sql(spark, tmp_path):
    paged = [r[1] for r in ranked(orders(spark, tmp_path))]
    got = queries.ui_page_headings(spark, str(tmp_path)).collect()
    assert sorted((r.page, r.first, r.last) for r in got) == [(n // 200, paged[n], paged[min(n + 199, 2499)]) for n in range(0, 2500, 200)]


def test_ui_page_headings_with_rows_without_an_address(spark, tmp_path):
    """Equal ranks, so rows without an address are the last of all, and head no page."""
    rows = [(7 * k + 1, k if k < 250 else None, "F", 40000.0, f"{k % 5 + 1}-X") for k in range(255)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    paged = sorted(hex(k) for k in range(250))
    got = queries.ui_page_headings(spark, str(tmp_path)).collect()
    assert sorted((r.page, r.first, r.last) for r in got) == [(0, paged[0], paged[199]), (1, paged[200], paged[249])]


def test_dump_contributions_of_modules_beyond_four_digits(spark, tmp_path):
    keys = [(k, 65530 + k) for k in range(20)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = queries_more.dump_contributions(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((m, k % 5 + 1, k * 16, k % 16 + 1) for k, m in keys)


def test_dump_modules_beyond_four_digits(spark, tmp_path):
    keys = [(k, k % 25) for k in (0, 9, 65535, 65536, 70000, 1 << 20)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = queries_more.dump_modules(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(k, f"lib{n}.lib" if k % 3 == 0 else None, f"obj/{k}.obj") for k, n in keys}
