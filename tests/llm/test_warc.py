import hashlib

import numpy as np
import pytest

from twinscope.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:twinscope:page:99>\r\nContent-Length: 7\r\n\r\nHTTP\r\n\r\npayload\r\n\r\n"
PAGES = [
    (1, "http://a/ b", "<html>" + "x" * 200 + "</html>"),
    (2, None, None),
    (3, "u", ""),
    (4, "u", FAKE * 3),
    (5, "u", "ends in a line break\r\n"),
    (6, "u", "\r\n" + FAKE),
    (7, "u", "<html>" + "x" * 200 + "</html>"),
    (0, "u", "tail\r\n\r\n\r\n" + "é" * 50 + "\r"),
    (9, "u", "tail\r\n\r\n\r\n" + "é" * 50 + "\r"),
    (10, "u", "short"),
    (11, "u", "short"),
    (12, "u", "long " * 20000 + FAKE),
    (None, "u", "<html>" + "x" * 200 + "</html>"),
]


@pytest.mark.parametrize("compression, split", [("gzip", "128m"), ("none", "128m"), ("none", "700"), ("none", "97")])
def test_round_trip(spark, tmp_path, compression, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    path = f"file://{tmp_path}/archive"
    warc.write(pages, path, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = warc.read(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(PAGES)
    by_id = {r.id: r for r in got}
    assert len(by_id) == len(PAGES)
    for page, _, html in PAGES:
        r = by_id[f"<urn:twinscope:page:{'' if page is None else page}>"]
        raw = (html or "").encode()
        first = min(p for p, _, h in PAGES if h == html and p is not None)
        again = len(raw) >= 100 and first != page
        assert r.record_type == ("revisit" if again else "response"), page
        assert r.payload_bytes == len(raw)
        assert r.digest == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert r.refers_to == (f"<urn:twinscope:page:{first}>" if again else None)
        assert again or bytes(r.payload) == raw


def test_only_the_chain_counts():
    at = np.array([0, 5, 10, 12, 30])
    assert warc.reachable(at, np.array([10, 12, 30, 30, 50])).tolist() == [True, False, True, False, True]
    assert warc.reachable(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
