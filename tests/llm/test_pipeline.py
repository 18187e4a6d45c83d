import random
import re

import numpy as np

from tests.llm.corpus import text
from twinscope.llm import queries

import corpus_pipeline as cp


def tables(spark, folder):
    rng = random.Random(9)
    rows = [(i, text(rng, rng.randrange(40, 200)), "en", f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(10)]
    rows += [(300 + i, rows[20 + i][1] + " and a word", "en", "s1") for i in range(10)]
    passage = text(rng, 130)
    rows += [(400 + i, f"{text(rng, 60)} {passage} {text(rng, 60)}", "en", "s2") for i in range(6)]
    rows += [(500 + i, text(rng, 50).replace(" ", "$$ "), "en", "s3") for i in range(40)] + [(600, None, None, None), (601, "", "en", "s0"), (602, "too short", "en", "s0")]
    spark.createDataFrame([(i, t, x, s, len(t or "")) for i, t, x, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 500 <= i < 600), 0) for i, *_ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return {i: t for i, t, *_ in rows}


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    texts = tables(spark, folder)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, folder)
        if k < 4:
            assert docs.columns == list(cp.COLUMNS)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["quality_rules"]}
    assert kept == {i for i in texts if not 500 <= i < 700}
    lone = {r.doc_id for r in seen["simhash_near_dedup"]}
    assert lone == {i for i in kept if not 200 <= i < 400}
    cut = {r.doc_id: r.text for r in seen["suffix_array_dedup"]}
    assert set(cut) == lone and all(cut[i] == texts[i] for i in lone if i < 200)
    assert all(len(cut[i]) < len(texts[i]) - 300 for i in range(400, 406))
    mixed = [r.doc_id for r in seen["source_mixing"]]
    assert set(mixed) <= lone and max(mixed.count(i) for i in set(mixed)) <= 3
    tokens = {}
    for r in seen["packing"]:
        tokens.setdefault(r.doc_id, 0)
        tokens[r.doc_id] += r.length
        assert r.offset + r.length <= 4096 and len(np.frombuffer(r.ids, "<u4")) == r.length
    assert set(tokens) == set(mixed)


def test_run_and_names(spark, tmp_path):
    tables(spark, str(tmp_path))
    assert cp.run(spark, str(tmp_path)).count() > 0
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, ties, and columns with the names that stages use."""
    rng = random.Random(12)
    words = text(rng, 60)
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (2, words, None, None), (None, words, "en", "a"), (None, text(rng, 60), None, "b"), (3, None, "en", "a"), (4, "", None, None), (5, text(rng, 5000), "en", "b"), (6, text(rng, 60), "en", None)]
    extra = "text_hash long, _w string, name string, th long, raw string, fp long, base long, size string, target double, kept boolean, start long, _key long"
    docs = spark.createDataFrame([(i, t, x, s, None if t is None else len(t), *[None] * 12) for i, t, x, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = sorted(str(r.doc_id) for r in docs.collect())
    assert kept["quality_rules"] == sorted(["1", "1", "2", "None", "None", "5", "6"])
    assert kept["simhash_near_dedup"] == kept["suffix_array_dedup"] == sorted(["1", "5", "6", "None"])
    assert set(kept["packing"]) == set(kept["source_mixing"])


def test_stages_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], [(1, None, None, None, None), (None, None, None, None, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in cp.STAGES:
            got = stage(spark, docs, str(tmp_path))
            want = {"quality_rules": 0, "simhash_near_dedup": min(1, len(rows)), "suffix_array_dedup": len(rows), "packing": len(rows)}.get(name)
            assert want is None or got.count() == want, name
