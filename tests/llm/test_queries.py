"""Each query over a small folder of tables, against brute force over the same rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.corpus import documents, text
from tests.llm.test_dedup import WORDS, brute_components, brute_print
from tests.llm.test_models import brute_counts
from tests.llm.test_source_mixing import brute
from twinscope.llm import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(21)
    docs, seen = [], set()
    for k, t in documents():
        if k is not None and k not in seen:
            seen.add(k)
            docs.append((k, t))
    letters = {"en": "the ing ou sh wh", "de": "sch ung ei ä ch"}
    for i in range(240):
        lang = "en" if i % 2 else "de"
        words = " ".join("".join(rng.choice(letters[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 60))).split()
        if i % 8 == 0:
            words[5:5] = ["scumbag"] * 3
        docs.append((2000 + i, " ".join(words)))
    rows = [(k, t, ("en" if k % 2 else "de") if k >= 2000 else None, [None, "b", "a", "c"][k % 4], len(t or "")) for k, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k % 3 > 0), int(k >= 2000 and k % 8 == 0)) for k, _ in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    v = np.random.default_rng(3).normal(size=(120, 12))
    v[60:80] = v[:20] + 0.05
    vectors = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(500, None, 0), (501, [0.0] * 12, 1), (502, v[3].tolist(), 2), (503, [float("nan")] * 12, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    pages = [(i, f"http://x/{i}", None if i == 7 else f"<p>{text(rng, 30 if i % 3 else 3)}</p>\r\n\r\n" if i < 30 else f"<b>{'same ' * (40 if i % 2 else 2)}</b>") for i in range(50)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder, dict(docs), {r[0]: r[3] for r in rows}, dict((a, b) for a, b, _ in vectors), {a: b for a, _, b in pages}


def run(spark, tables, name, *columns):
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, tables[0]).select(*columns).collect())


def test_op1(spark, tables):
    got = run(spark, tables, "op1_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [g[:6] for g in got] == sorted((k, *brute_counts(t)) for k, t in tables[1].items())
    assert all(g[6] == (g[1] < 20 or 100 * g[5] > 30 * g[1]) and not (g[6] and g[7]) for g in got)


def test_op2(spark, tables):
    got = run(spark, tables, "op2_source_mixing", "doc_id", "size", "source_size", "target", "taken")
    size = {k: len(WORDS.findall(t or "")) for k, t in tables[1].items()}
    total = Counter()
    for k, s in tables[2].items():
        total[s] += size[k]
    target, taken = brute(dict(total)), Counter()
    for k, n, of, to, took in got:
        s = tables[2][k]
        assert n == size[k] and of == total[s] and math.isclose(to, target[s], rel_tol=1e-9) and 0 <= took <= 3 * n
        taken[s] += took
    assert len(got) == len(size) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert got == run(spark, tables, "op2_source_mixing", "doc_id", "size", "source_size", "target", "taken")


def test_op3(spark, tables):
    usable = {k: np.array(v, np.float32).astype(float) for k, v in tables[3].items() if v is not None and np.isfinite(v).all() and np.any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in usable.items()}
    link = {a: {b for b in unit if b != a and unit[a] @ unit[b] >= 0.9} for a in unit}
    want = []
    for k in tables[3]:
        reach, todo = {k}, [k]
        while todo:
            fresh = link.get(todo.pop(), set()) - reach
            reach |= fresh
            todo += fresh
        want.append((k, len(link.get(k, ())), min(reach), min(reach) == k))
    assert run(spark, tables, "op3_embedding_dedup", "vec_id", "n_links", "component_id", "kept") == sorted(want)


def test_op4(spark, tables):
    raw = {k: (t or "").encode() for k, t in tables[1].items()}
    seen = Counter(b[i : i + 400] for b in raw.values() for i in range(len(b) - 399))
    want = []
    for k, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert run(spark, tables, "op4_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want)


def test_op5(spark, tables):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, t in tables[1].items()}
    got = run(spark, tables, "op5_packing", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    at, filled = {}, {}
    for k, start, n, crc, total, seq, offset in got:
        assert start == at.get(k, 0) and total == len(ids[k])
        assert crc == zlib.crc32(struct.pack(f"<{n}I", *ids[k][start : start + n]))
        at[k] = start + n
        filled.setdefault(seq, []).append((offset, n))
    assert at == {k: len(v) for k, v in ids.items()}
    for pieces in filled.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 4096


def test_op6(spark, tables):
    keys = sorted(tables[1])
    prints = [brute_print(tables[1][k], 4) for k in keys]
    want = [(k, f"{p:016x}", c) for k, p, c in zip(keys, prints, brute_components(prints, keys, 4))]
    assert run(spark, tables, "op6_simhash", "doc_id", "fingerprint", "component_id") == want


def test_op7(spark, tables):
    words = {k: WORDS.findall(t or "") for k, t in tables[1].items()}
    least = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            least.setdefault(tuple(words[k][i : i + 13]), k)
    want = []
    for k, w in words.items():
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = True
        want.append((k, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert run(spark, tables, "op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want)


def test_op8(spark, tables):
    raw = {k: (h or "").encode() for k, h in tables[4].items()}
    first = {}
    for k in sorted(raw):
        first.setdefault(raw[k], k)
    want = [(k, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if len(b) >= 100 and first[b] != k else ("response", None))) for k, b in raw.items()]
    got = queries.QUERIES["op8_warc"](spark, tables[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def held(k, n, at):
    return zlib.crc32(str(k).encode()) % n == at


def test_op9(spark, tables):
    got = run(spark, tables, "op9_toxicity", "doc_id", "held_out", "score", "predicted")
    assert [(k, h) for k, h, _, _ in got] == [(k, held(k, 5, 0)) for k in sorted(tables[1])]
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for _, _, s, p in got)
    bad = [(k, p) for k, h, _, p in got if h and k >= 2000]
    assert all(p == (k % 8 == 0) for k, p in bad) and any(p for _, p in bad)


def test_op10(spark, tables):
    got = run(spark, tables, "op10_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert [(k, h) for k, h, _, _ in got] == [(k, held(k, 3, 1)) for k in sorted(tables[1])]
    assert all(0 <= s <= 1 for *_, s in got)
    for k, _, lang, _ in got:
        t = tables[1][k]
        assert (lang == "und") == (t is None or not any(c.isalpha() for c in t)), k
        if k >= 2000:
            assert lang == ("en" if k % 2 else "de")
