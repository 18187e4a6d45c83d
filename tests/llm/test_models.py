import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.corpus import documents, frame, text
from twinscope.llm import embedding_dedup, language_id, quality_rules, toxicity

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_counts(t):
    t = t or ""
    w = WORDS.findall(t)
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in lines
            lines.add(line)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_counts(spark):
    rows = documents() + [(1, "a\nb \na\n\n \nb \nA"), (2, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8"), (3, "#a $$ <b>"), (4, "x " * 9)]
    got = quality_rules.with_counts(frame(spark, rows)).select("doc_id", *quality_rules.COUNTS).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(k), *brute_counts(t)) for k, t in rows)


def test_rules_are_learned_and_keep_clean_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        kind = i % 5
        words = text(rng, rng.randrange(30, 80))
        rows.append((i, {0: words.replace(" ", "$$ "), 1: words.upper()}.get(kind, words)))
        labels.append((i, 0 if kind < 2 else 1))
    labels += [(None, 0), (3, None), (10**6, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows += [(1000, None), (1001, ""), (0, rows[0][1])]
    judged = quality_rules.judge(frame(spark, rows), known)
    got = {(r.doc_id, r.kept) for r in judged.collect()}
    assert all((i, i % 5 >= 2) in got for i in range(500)) and (1000, False) in got
    assert judged.count() == len(rows)
    assert quality_rules.judge(frame(spark, rows[:3]), known.limit(0)).where("rule is not null").count() == 0
    assert quality_rules.judge(frame(spark, []), known, with_text=True).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(scale=0.12, size=(60, 16))
    group = base[0] + rng.normal(scale=0.1, size=(40, 16))
    x = np.vstack([base, near, group]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist(), 1) for i in range(5)] + [(2000, (x[7] * 2).tolist(), 1)]
    odd = [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] + [1.0] * 15, 0), (3003, [float("inf")] + [1.0] * 15, 0), (3004, [], 0), (3005, [None] * 16, 0), (3006, [1.0, 2.0], 0), (3007, [2.0, 4.1], 0), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    for _ in range(60):
        comp = np.array([comp[h].min() for h in hit])
    want = {int(i): (int(h.sum()) - 1, int(c)) for i, h, c in zip(ids, hit, comp)}
    for block, cells in ((4096, 256), (32, 8)):
        got = {r.vec_id: r for r in embedding_dedup.cluster(df, block=block, max_cells=cells).collect()}
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (*want[i], want[i][1] == i) for i in want)
        assert all(got[i].n_links == 0 and got[i].kept for i in (3000, 3001, 3002, 3003, 3004, 3005, None))
        assert got[3006].n_links == got[3007].n_links == 1 and got[3007].component_id == 3006
    assert embedding_dedup.cluster(df.limit(0)).count() == 0


def test_languages(spark):
    rng = random.Random(6)
    letters = {"en": "the ing ou sh wh", "de": "sch ung ei ä ch", "fr": "eau é oi qu ent", "es": "ción os ar ñ ll"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
    langs = [rng.choice(list(letters)) for _ in range(400)]
    rows = [(i, make(x), x) for i, x in enumerate(langs)]
    docs = spark.createDataFrame(rows + [(500, None, "en"), (501, "12 !", "fr"), (502, "", None), (None, "the", "en"), (503, "lone", "xx")], "doc_id long, text string, lang string")
    out = language_id.held_out(F.col("doc_id"), 3, 1)
    model = language_id.fit(docs.where(~out))
    got = {r.doc_id: r for r in language_id.predict(docs.drop("lang"), model).collect()}
    held = [r.doc_id for r in docs.where(out).select("doc_id").collect() if r.doc_id < 400]
    assert len(held) > 80 and sum(got[i].lang_pred == langs[i] for i in held) >= 0.97 * len(held)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and None in got
    assert language_id.fit(docs.where("lang = 'zz'")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.family_of("fr") == "romance" and language_id.family_of("qq") == "qq"


def test_toxicity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        words = text(rng, rng.randrange(20, 120)).split()
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "scumbag", "wretched"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    known = spark.createDataFrame(labels + [(None, 1), (1, None), (10**7, 1)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (5000, None), (5001, ""), (None, "idiotic"), (4, rows[4][1])])
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    found = [i for i in range(900) if i % 2 and got[i] >= 0.5]
    assert sum(i % 9 == 0 for i in found) >= 45 and sum(i % 9 != 0 for i in found) <= 4
    assert got[5000] == got[5001] < 0.5 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.fit(docs, known.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 1e-6
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_risk_stays_non_negative():
    rng = np.random.default_rng(8)
    rows = lambda n, p: [(np.flatnonzero(rng.random(30) < p), np.ones(30)) for _ in range(n)]
    fix = lambda xs: [(i, v[: len(i)]) for i, v in xs]
    w = toxicity.train_nnpu(fix(rows(50, 0.9)), fix(rows(500, 0.1)), 30, 0.1, epochs=20)
    assert np.isfinite(w).all()


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} " * (5 + i), f"l{k:02d}") for k in range(70) for i in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dims=256)
    assert {x for m in model.within.values() for x in m.classes} == {f"l{k:02d}" for k in range(70)}


def brute_risk(w, pos, unl, prior):
    """The corrected risk of dense rows, term by term."""
    loss = lambda x, sign: np.log1p(np.exp(-sign * (x @ w[:-1] + w[-1])))
    positive = np.mean([loss(x, 1) for x in pos])
    negative = np.mean([loss(x, -1) for x in unl]) - prior * np.mean([loss(x, -1) for x in pos])
    return prior * positive + max(0.0, negative)


def test_training_lowers_the_corrected_risk():
    rng = np.random.default_rng(2)
    direction = rng.normal(size=12)
    make = lambda n, sign: (rng.random((n, 12)) < 1 / (1 + np.exp(-sign * direction))).astype(float)
    pos, hidden, clean = make(80, 1), make(60, 1), make(540, -1)
    unl = np.vstack([hidden, clean])
    sparse = lambda rows: [(np.flatnonzero(x), x[x > 0]) for x in rows]
    w = toxicity.train_nnpu(sparse(pos), sparse(unl), 12, 0.1)
    w[-1] += toxicity.cut_point(pos @ w[:-1] + w[-1], unl @ w[:-1] + w[-1])  # the cut moves the bias only
    start = np.append(np.zeros(12), np.log(0.1 / 0.9))
    assert brute_risk(w, pos, unl, 0.1) < 0.5 * brute_risk(start, pos, unl, 0.1)
    score = unl @ w[:-1]
    assert np.mean([(score[:60] > c).mean() for c in score[60:]]) > 0.95  # hidden positives rank above clean rows


EXTRA = "score double, predicted int, lang_pred string, fp long, text_hash long, family string, _text string, features string"


def with_clashes(spark, rows):
    """(doc_id, text, lang) with columns of the names that models use."""
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], f"doc_id long, text string, lang string, {EXTRA}")


def test_models_on_odd_rows(spark):
    rng = random.Random(14)
    words = lambda n: text(rng, n)
    rows = [(i, words(40) + (" scumbag wretched" if i % 6 == 0 else ""), "en" if i % 2 else "fr") for i in range(240)]
    rows = [(i, t.replace("a", "ä") if x == "fr" else t, x) for i, t, x in rows]
    odd = [(900, words(60_000) + " scumbag wretched scumbag", "en"), (901, "scumbag wretched", "en"), (901, "scumbag wretched", "en"), (902, "x" * 200_000, None), (903, None, None), (904, "", "fr"), (None, "scumbag", None), (905, "tie tie", "en"), (906, "tie tie", "en")]
    docs = with_clashes(spark, rows + odd)
    labels = spark.createDataFrame([(i, int(i % 6 == 0), "x") for i in range(240)], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.score(docs.select("doc_id", "text"), model).collect()]
    by = dict(got)
    assert len(got) == len(rows) + len(odd) and all(0 <= x <= 1 for _, x in got)
    assert by[901] > by[905] and by[903] == by[904] < 0.5 and by[905] == by[906] and len({x for k, x in got if k == 901}) == 1
    languages = language_id.fit(docs)
    out = language_id.predict(docs.select("doc_id", "text"), languages).collect()
    said = {r.doc_id: r.lang_pred for r in out}
    assert len(out) == len(rows) + len(odd) and said[903] == said[904] == "und" and said[900] == "en" and said[905] == said[906]
    assert toxicity.score(docs.select("doc_id", "text").limit(0), model).count() == 0 and language_id.predict(docs.limit(0).select("doc_id", "text"), languages).count() == 0


def test_other_operators_on_clashing_columns(spark, tmp_path):
    from twinscope.llm import source_mixing, warc

    v = [(i, [float(i == j) for j in range(4)], 1, 2.0, 3) for i in range(4)] + [(9, [0.0, 1.0, 0.0, 0.0], 1, 2.0, 3)]
    got = embedding_dedup.cluster(spark.createDataFrame(v, "vec_id long, embedding array<double>, node long, x double, links long"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {0: (0, 0), 1: (1, 1), 2: (0, 2), 3: (0, 3), 9: (1, 1)}
    pages = spark.createDataFrame([(1, "u", "a" * 200, "p", 7), (2, "u", "a" * 200, "q", 8), (3, "u", "b" * 3_000_000, None, None)], "page_id long, url string, html string, payload_digest string, refers_to long")
    warc.write(pages, f"file://{tmp_path}/w")
    out = {r.id: (r.record_type, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/w").collect()}
    assert out == {"<urn:twinscope:page:1>": ("response", 200), "<urn:twinscope:page:2>": ("revisit", 200), "<urn:twinscope:page:3>": ("response", 3_000_000)}
    docs = spark.createDataFrame([(1, "w " * 100_000, "a", 1, 2, 3), (2, "w " * 50, "b", 1, 2, 3), (3, None, None, 1, 2, 3)], "doc_id long, text string, source string, target long, source_size long, position long")
    mixed = {r.doc_id: (r.size, r.source_size) for r in source_mixing.assign(docs).collect()}
    assert mixed == {1: (100_000, 100_000), 2: (50, 50), 3: (0, 0)}
