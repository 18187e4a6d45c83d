import math

from twinscope.llm import source_mixing as sm

DOCS = "doc_id long, text string, source string, size string"


def brute(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by filling sources up until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(weights[i % 3]) for i, s in enumerate(order)}
    left, full = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return full | share
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1, "c": 100, None: 7}, {"a": 1000, "b": 1, "c": 1, "d": 1}, {"x": 0, "y": 5}, {"a": 0}):
        got = {r.source: r.target for r in sm.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want), (sizes, got, want)


def rows():
    out = [(i, "w " * (i % 17), ["a", "b", "c", None][i % 4 if i % 3 else 0], "x") for i in range(400)]
    return out + [(5, "same words", "b", "x")] * 3 + [(None, "no key", "c", None), (7, None, "a", "x"), (8, "", "a", "x")]


def test_words_meet_targets(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(5)
    got = sm.assign(docs, per_bucket=8).collect()
    assert len(got) == len(rows())
    total = {}
    for r in got:
        words = sum(c.words for c in r.copies)
        assert words <= 3 * r.size and len(r.copies) <= 3 and all(0 <= c.position <= 1 for c in r.copies)
        t = total.setdefault(r.source, [0, r.target, 0])
        t[0] += words
        t[2] += r.size
    assert all(abs(words - target) <= 1 for words, target, _ in total.values())
    want = brute({s: t[2] for s, t in total.items()})
    assert all(math.isclose(total[s][1], want[s], abs_tol=1e-6) for s in want)
    again = sm.assign(docs.repartition(3), per_bucket=8).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "", r.size, str(r.copies))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_training_order_has_whole_documents(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = [tuple(r) for r in sm.in_training_order(docs, per_bucket=8).collect()]
    known = set(rows())
    assert set(got) <= known
    taken = sm.assign(docs, per_bucket=8, whole=True).collect()
    assert len(got) == sum(len(r.copies) for r in taken)
    assert sum(g[:3] == (5, "same words", "b") for g in got) == sum(len(r.copies) for r in taken if r.doc_id == 5 and r.size == 2 and r.source == "b")


def test_ramps_move_sources_in_time(spark):
    docs = spark.createDataFrame([(i, "a b c", "early" if i % 2 else "late", "") for i in range(2000)], DOCS)
    ramps = ((1.9, 0.1), (0.1, 1.9))
    got = sm.assign(docs, weights=(1.0,), ramps=ramps).collect()
    mean = lambda s: sum(c.position for r in got if r.source == s for c in r.copies) / sum(len(r.copies) for r in got if r.source == s)
    assert mean("early") < 0.4 < 0.6 < mean("late")


def test_empty_table(spark):
    assert sm.in_training_order(spark.createDataFrame([], DOCS)).count() == 0
