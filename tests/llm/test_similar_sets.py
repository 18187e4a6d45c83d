import random

import numpy as np
import pytest

from tests.llm.corpus import documents, frame, text
from tests.llm.test_dedup import WORDS
from twinscope.llm import simhash, similar_sets

import corpus_pipeline as cp


def shingles(t, n=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORDS.findall((t or "").translate(lower))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= round(10 * similarity) * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(rows))]


def near_the_limit(n=150, seed=5):
    """Pairs of texts with similarities around 0.8, some at 0.8 exactly."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = text(rng, rng.randrange(30, 200)).split()
        other = words + text(rng, rng.randrange(1, len(words) // 3)).split()
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                other[rng.randrange(len(words))] = "changed"
        if i % 3 == 1:
            words = words[: 4 + 4 * (len(words) // 5)]
            other = words + text(rng, (len(words) - 4) // 4).split()
        rows += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(other))]
    return rows


@pytest.mark.parametrize("shard_rows", [2048, 3])
def test_cluster_against_brute_force(spark, shard_rows):
    rows = documents() + near_the_limit() + [(2000 + i, documents()[20][1] + f" more{i}") for i in range(20)]
    want = sorted((str(k), str(c)) for (k, _), c in zip(rows, brute_components(rows)))
    got = similar_sets.cluster(frame(spark, rows), shard_rows=shard_rows).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want


def test_stage_joins_at_the_limit_only(spark, tmp_path):
    rows = near_the_limit()
    near = [len(a & b) / len(a | b) for a, b in ((shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, len(rows), 2))]
    assert sum(0.8 <= x < 0.83 for x in near) > 20 and sum(0.75 < x < 0.8 for x in near) > 5
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in cp.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert got == set(brute_components(rows))


def test_group_links_of_crowds():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, 40)) for _ in range(80)]
    base = np.sort(rng.integers(0, 1 << 62, 60))
    sets += [np.unique(np.append(base[i % 9 :], rng.integers(0, 1 << 62, i % 5))) for i in range(70)] + [sets[0], sets[1][:-1]]
    group = np.repeat([3, 8], [100, len(sets) - 100])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    wide = simhash.bits_of(np.concatenate(sets).astype(np.uint64), row, len(sets), similar_sets.WIDTH).view(np.int64)
    rows = [np.concatenate([w, s]) for w, s in zip(wide, sets)]
    parent = similar_sets.group_links(group, np.append(0, np.cumsum([len(s) for s in rows])), np.concatenate(rows), 0.8)
    want = np.arange(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] == group[j] and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
                x, y = sorted((want[i], want[j]))
                want[want == y] = x
    assert (parent == want).all() and len(set(parent.tolist())) < len(sets) - 60


def test_radius_holds_at_the_limit():
    """Fingerprints of sets of all sizes that share just enough are within the radius."""
    rng = np.random.default_rng(4)
    far = []
    for n in [4, 5, 6, 9, 20, 60, 200, 1000]:
        for _ in range(150):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a = np.append(common, rng.integers(0, 1 << 63, n // 8, dtype=np.uint64))
            b = np.append(common, rng.integers(0, 1 << 63, n // 4 - n // 8, dtype=np.uint64))
            f = simhash.bits_of(np.append(a, b), np.repeat([0, 1], [len(a), len(b)]), 2, similar_sets.WIDTH)
            far.append(int(np.bitwise_count(f[0] ^ f[1]).sum()))
    assert max(far) < similar_sets.radius_for(0.8) - 10


def test_hot_shingles(spark):
    rng = random.Random(8)
    rows = [(i, " ".join([text(rng, 60), "a passage that all of these texts have in common and that makes some shingles hot", text(rng, 20)])) for i in range(60)]
    rows += [(100 + i, t + " end") for i, t in rows[:20]]
    got = {r.doc_id: r.component_id for r in similar_sets.cluster(frame(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)
    assert len(similar_sets.hot_shingles(frame(spark, rows).select("text"), 5)) > 5


def test_keep_one_odd(spark):
    rows = [(9, "quite another text"), (9, "quite another text"), (None, "quite another text"), (None, "alone and without a key"), (7, None), (8, ""), (1, "x y z")]
    assert sorted(str(r.doc_id) for r in similar_sets.keep_one(frame(spark, rows)).collect()) == ["1", "7", "9", "None"]
    assert similar_sets.keep_one(frame(spark, [])).count() == 0


def test_keep_one_of_each_group_of_a_repeated_key(spark):
    a, b, c = (text(random.Random(i), 80) for i in range(3))
    rows = [(9, a), (9, a + " more"), (9, b), (3, c), (9, c)]
    got = sorted((r.doc_id, r.text.removesuffix(" more")) for r in similar_sets.keep_one(frame(spark, rows)).collect())
    assert got == sorted([(9, a), (9, b), (3, c)])
