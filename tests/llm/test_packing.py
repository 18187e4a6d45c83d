import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinscope.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Plain words, and more words.", "", None, "it's don't WE'LL", "a<|endoftext|>b <|startoftext|>", "été Ünï é Å", "x\x1cy z w　v\x85u", "12 345 a1b2", "###$$$ !!", "\n\t \r\x0b\x0c", "tab\tand\nline",
]


def test_ids_are_those_of_the_tokenizer():
    own, whole = packing.WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH)
    texts = [t for t in TEXTS if t is not None] * 2
    raw = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(r) for r in raw])
    ids, n = own.rows(np.frombuffer(b"".join(raw), np.uint8), at)
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_words_met_again_outlive_those_met_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 300)
    monkeypatch.setattr(packing, "CACHED_PARTS", 50, raising=False)
    own, whole = packing.WordEncoder(open(PATH).read()), Tokenizer.from_file(PATH)
    asked, word = [], own.word
    own.word = lambda w: asked.append(w) or word(w)
    for step in range(20):
        texts = [" ".join(f"x{step}y{i} often{i % 7}" for i in range(100)), "", "Often met, it's été"]
        at = np.cumsum([0] + [len(t.encode()) for t in texts])
        ids, n = own.rows(np.frombuffer("".join(texts).encode(), np.uint8), at)
        for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text
        assert len(own._h) <= 300 + 2 * 111 and len(own._parts) <= 50
    assert len(asked) == len(set(asked)) == 20 * 100 + 7 + 4


def test_a_batch_is_encoded_in_steps_of_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    own = packing.WordEncoder(open(PATH).read())
    texts = pa.array(["some words of a text that is packed " * 60] * 1900)
    tracemalloc.start()
    for _, _, data, at in packing.shared.text_steps(texts, packing.STEP_BYTES):
        own.rows(data, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_waiting_pieces_do_not_keep_their_documents():
    p = packing.Packer(4096, 32, 0)
    for i in range(20):
        list(p.add((i, 4096 * 5 + 100), np.zeros(4096 * 5 + 100, "<u4")))
    held = [ids for pieces in p._open.values() for _, _, ids in pieces]
    assert held and all(ids.base is None for ids in held)


def test_classes_fill_their_bins():
    p = packing.Packer(4096, 32, 0)
    for n in range(1, 13000, 7):
        cuts = list(p.cuts(n))
        assert sum(size for _, size in cuts) == n
        assert all(size * k <= 4096 and (size + 1) * (k + 1) > 4096 - k - 1 for k, size in cuts)


def test_pieces_cover_each_document_once(spark):
    texts = TEXTS + ["word and other text " * 3000, "many small ones"] * 3 + ["some tokens of a text that is packed "] * 40
    rows = [(i if i != 5 else None, t, "x") for i, t in enumerate(texts)] + [(1, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = packing.pack(docs, PATH, capacity=256).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(((-1 if i is None else i), tuple(whole.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, _ in rows)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    padded = total = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and r.length * 4 == len(r.ids)
            at += r.length
        assert at <= 256
        total += at
        padded += 0 if at & (at - 1) == 0 else 256 - at
    assert padded < 0.03 * total
    docs_of = {}
    for r in got:
        docs_of.setdefault(-1 if r.doc_id is None else r.doc_id, []).append((r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens))
    for key, pieces in docs_of.items():
        pieces.sort()
        if key == 1:
            assert [p[1] for p in pieces] == [(2,), (2,)]
            continue
        ids = ()
        for start, part, n in pieces:
            assert start == len(ids)
            ids += part
        assert (key, ids) in want and n == len(ids)
    assert len(docs_of) == len(rows) - 1
    assert zlib.crc32(b"") == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
