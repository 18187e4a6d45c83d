import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.corpus import documents, frame
from twinscope.llm import graph, shared, simhash, substring_dedup, suffix_dedup

WORDS = re.compile("[^\x20\x09-\x0d]+")


def gaps(flags):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(int), [0]])))
    return [tuple(x) for x in edge.reshape(-1, 2).tolist()]


@pytest.mark.parametrize("length, gram, crowd", [(400, 64, 2048), (50, 16, 2048), (50, 16, 1), (20, 8, 3)])
def test_suffix_dedup(spark, length, gram, crowd):
    rows = documents()
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    want = []
    for (key, _), b in zip(rows, raw):
        steps = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                steps[i] += 1
                steps[i + length] -= 1
        gone = np.cumsum(steps)[: len(b)] > 0
        want.append((str(key), len(b), gaps(gone), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    got = suffix_dedup.dedup(frame(spark, rows), length=length, gram=gram, crowd=crowd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [(x.start, x.end) for x in r.spans], hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == sorted(want)


def test_suffix_dedup_as_text(spark):
    got = {r.doc_id: r for r in suffix_dedup.dedup(frame(spark, [(1, "a" + "é" * 300), (2, "b" + "é" * 300)]), as_text=True, keep=("key",)).collect()}
    assert got[1].kept == "a" and got[1].key == "k"
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window, hot", [(13, False), (5, False), (13, True)])
def test_substring_dedup(spark, monkeypatch, window, hot):
    if hot:  # all that occurs ten times is
        monkeypatch.setattr(substring_dedup, "HOT_COUNT", 1)
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", 10)
    rows = documents()
    words = [WORDS.findall(t or "") for _, t in rows]
    order = [float("inf") if k is None else k for k, _ in rows]
    least = {}
    for k, w in zip(order, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, k), k)
    want = []
    for (name, _), k, w in zip(rows, order, words):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone[i : i + window] = True
        want.append((str(name), len(w), gaps(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring_dedup.dedup(frame(spark, rows), window=window).collect()
    assert sorted((str(r.doc_id), r.n_words, [(x.start, x.end) for x in r.spans], r.kept) for r in got) == sorted(want)


def test_substring_dedup_odd(spark):
    assert substring_dedup.dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup(frame(spark, []), window=5, block=4)
    with pytest.raises(TypeError):
        substring_dedup.dedup(frame(spark, []).withColumn("doc_id", F.lit("a")))


def test_spans_of_structured_texts():
    """A Thue-Morse text and its complement, which collide in polynomials modulo 2^64."""
    word = b"a"
    while len(word) < 2048:
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + word.translate(bytes.maketrans(b"ab", b"ba")) + word, np.uint8)
    at = np.array([0, 2048, 4096])
    a, b, c = shared.Spans(data).of(at, at + 2048).tolist()
    assert a == c and a != b


def brute_print(t, n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORDS.findall((t or "").translate(lower))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, keys, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("shard_rows", [2048, 3])
def test_simhash(spark, shard_rows):
    rows = documents() + [(2000 + i, documents()[20][1] + f" more{i}") for i in range(6)]
    prints = [brute_print(t, 4) for _, t in rows]
    want = brute_components(prints, [k for k, _ in rows], 6)
    got = simhash.cluster(frame(spark, rows), radius=6, shard_rows=shard_rows).collect()
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == sorted((str(k), p, str(c)) for (k, _), p, c in zip(rows, prints, want))


def test_bk_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 8), dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.bitwise_xor.reduce(flips[:, :k], axis=1) for k in range(1, 8)]]))[:, None]
    group = np.sort(rng.integers(0, 4, len(fp)))
    forest = simhash.Forest(group, fp)
    q, n = forest.within(group, fp, 4)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if group[i] == group[j] and np.bitwise_count(fp[i] ^ fp[j])[0] <= 4}
    assert set(zip(q.tolist(), n.tolist())) == want


def test_block_masks():
    rng = np.random.default_rng(2)
    for blocks in (5, 6, 8):
        masks = simhash.block_masks(blocks, 4)
        for _ in range(200):
            d = sum(1 << int(b) for b in set(rng.integers(0, 64, 4).tolist()))
            assert any(d & m == 0 for m in masks)


@pytest.mark.parametrize("shard_rows", [2048, 100])
def test_wide_links_lose_no_pair_at_the_radius(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        bits = rng.integers(0, 2, 512, dtype=np.uint8)
        near = bits.copy()
        near[rng.choice(512, 78, replace=False)] ^= 1
        rows += [(2 * i + k, np.packbits(b, bitorder="little").view("<i8").tolist()) for k, b in enumerate((bits, near))]
    got = simhash.links(spark.createDataFrame(rows, "fp long, f array<long>"), radius=78, shard_rows=shard_rows, width=8).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == {(2 * i, 2 * i + 1) for i in range(200)}


def test_keep_one(spark):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["changed"] + words[151:]
    rows = [(5, " ".join(words)), (4, " ".join(near)), (9, "quite another text"), (9, "quite another text"), (None, "quite another text"), (None, "alone and without a key"), (1, "x y z")]
    got = simhash.keep_one(frame(spark, rows), radius=simhash.radius_for(0.8, 8), width=8)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "4", "9", "None"]
    assert got.columns == frame(spark, rows).columns
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, 260), rng.integers(0, 400, 260)
    chain = [(i, i + 1) for i in range(500, 560)]
    edges = [(int(x), int(y)) for x, y in zip(a, b)] + chain + [(7, 7)]
    parent = np.arange(600)
    graph.unite(parent, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == parent[i] for i in range(600))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_that_clash(spark):
    docs = frame(spark, documents()).withColumn("fp", F.lit("x")).withColumn("_key", F.lit(1))
    assert simhash.cluster(docs).count() == len(documents())


def test_trees_spare_comparisons(monkeypatch):
    """A query within 4 bits sees under a quarter of a tree of 1024 unrelated fingerprints."""
    rng, seen, plain = np.random.default_rng(1), [0], simhash._apart

    def counting(a, b):
        seen[0] += len(a)
        return plain(a, b)

    f = np.unique(rng.integers(0, 1 << 51, 1024, dtype=np.uint64)).reshape(-1, 1)
    forest = simhash.Forest(np.zeros(len(f), np.int64), f)
    monkeypatch.setattr(simhash, "_apart", counting)
    q, n = forest.within(np.zeros(len(f), np.int64), f, 4)
    assert seen[0] < len(f) ** 2 / 4
    far = np.bitwise_count(f ^ f.T)
    assert {(int(a), int(b)) for a, b in zip(q, n)} == {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 4))}
