"""Harmonic packing of tokenised documents into training sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than
capacity / (k + 1) and at most capacity / k tokens, and each of its bins takes exactly
k pieces. Workers fill the bins of their own rows, without a shuffle.

Cutting makes the classes tight. A document yields full sequences, then the largest
units capacity // k that fit in what is left, until a tail of at most capacity / fine
tokens remains; bins of units are full, bins of tails at least fine / (fine + 1) full.
The pieces of bins that a worker could not fill are laid end to end and cut at the
capacity; what remains of that is cut into sequences whose lengths are powers of two,
which need no padding. Each worker holds less than one bin of each class.

Edge cases: a null or empty text is the end token alone; a text longer than memory for
its tokens is not supported (4 bytes a token); rows repeated in the table are packed
again; null keys are kept; extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared

#: Words whose ids a worker remembers (about 40 bytes each); those met only once go when there are more.
CACHED_WORDS = 400_000
#: Parts of words whose ids a worker remembers (about 250 bytes each), twice.
CACHED_PARTS = 40_000
#: Bytes of text that are encoded in one step, which takes about 40 times as many.
STEP_BYTES = 1 << 20
#: Pieces of one batch that a worker gives back, of at most a sequence each.
BATCH_PIECES = 250
_PIECES = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of many runs, ``size`` of them, one after another."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class WordEncoder:
    """Ids of whole texts by a tokeniser that drops white space and joins nothing
    across it, so that a text's ids are those of its words.

    A step of many texts is encoded at once: words are told apart by a 64-bit hash, only
    words not met before are encoded, and the ids are gathered from one flat array. Plain
    ASCII words skip the normaliser, whose effect on them is lower case.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_str(definition)
        self._model = self._whole.model
        self._parts: dict[str, tuple[int, ...]] = {}
        self._old_parts: dict[str, tuple[int, ...]] = {}
        # By hash: where the ids are, and whether the word was met again.
        self._h, self._met = np.zeros(0, np.uint64), np.zeros(0, bool)
        self._start, self._size, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def _forget(self) -> None:
        """Keep the words met again since they came or were last kept."""
        stay = self._met
        self._h, self._met = self._h[stay], np.zeros(int(stay.sum()), bool)
        self._ids = self._ids[_places(self._start[stay], self._size[stay])]
        self._size = self._size[stay]
        self._start = np.cumsum(self._size, dtype=np.int64) - self._size

    def word(self, word: str) -> list[int]:
        if not word.isascii() or not word.isprintable() or "'" in word or "<|" in word:
            return self._whole.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part in _PIECES.findall(word.lower()):
            ids = self._parts.get(part)
            if ids is None:
                ids = self._old_parts.get(part) or tuple(x.id for x in self._model.tokenize(part))
                if len(self._parts) >= CACHED_PARTS:
                    self._old_parts, self._parts = self._parts, {}
                self._parts[part] = ids
            out += ids
        return out

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        ids = [self.word(w) for w in words]
        size = np.array([len(x) for x in ids], np.int32)
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(size.sum()))
        start = np.concatenate([self._start, len(self._ids) + np.cumsum(size, dtype=np.int64) - size])
        h = np.concatenate([self._h, h])
        order = np.argsort(h, kind="stable")  # two sorted runs, merged
        self._h, self._start = h[order], start[order]
        self._size = np.concatenate([self._size, size])[order]
        self._met = np.concatenate([self._met, np.zeros(len(words), bool)])[order]
        self._ids = np.concatenate([self._ids, flat])

    def rows(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, their number in each row) for a piece of texts."""
        starts, ends, before = shared.word_spans(data, at)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(at) - 1, np.int64)
        kinds, first, which = np.unique(shared.Spans(data).of(starts, ends), return_index=True, return_inverse=True)
        if len(self._h) > CACHED_WORDS:
            self._forget()
        slot = np.searchsorted(self._h, kinds)
        new = np.ones(len(kinds), bool)
        if len(self._h):
            new = self._h[np.minimum(slot, len(self._h) - 1)] != kinds
            self._met[slot[~new]] = True
        if new.any():
            whole, i = data.tobytes(), first[new]
            self._learn(kinds[new], [whole[s:e].decode() for s, e in zip(starts[i].tolist(), ends[i].tolist())])
            slot = np.searchsorted(self._h, kinds)
        entry = slot[which]
        n = self._size[entry]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return self._ids[_places(self._start[entry], n)], np.diff(upto[before])


_encoders: dict[str, WordEncoder] = {}


def _encoder(definition: str) -> WordEncoder:
    """This worker's encoder, which later tasks of the worker go on with."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = WordEncoder(definition)
    return _encoders[definition]


class Packer:
    """Fills the bins of one worker. Pieces come out with their sequence and offset."""

    def __init__(self, capacity: int, fine: int, first_sequence: int):
        self.capacity, self.fine, self._next = capacity, fine, first_sequence
        self._open: dict[int, list] = {}

    def _sequence(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids in pieces:
            yield doc, start, ids, self._next, at
            at += len(ids)
        self._next += 1

    def cuts(self, n: int) -> Iterator[tuple[int, int]]:
        """(class, length) of the pieces of a document of n tokens, in order."""
        for _ in range(n // self.capacity):
            yield 1, self.capacity
        left = n % self.capacity
        while left:
            k = -(-self.capacity // left)
            unit = self.capacity // k
            if left * self.fine <= self.capacity:
                k, unit = self.capacity // left, left
            yield k, unit
            left -= unit

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for k, size in self.cuts(len(ids)):
            held = self._open.setdefault(k, [])
            part = ids[start : start + size]
            held.append((doc, start, part.copy() if k > 1 else part))  # what waits must not keep the whole document
            start += size
            if len(held) == k:
                yield from self._sequence(self._open.pop(k))

    def finish(self) -> Iterator[tuple]:
        rest = [p for k in sorted(self._open) for p in self._open[k]]
        self._open.clear()
        left = sum(len(p[2]) for p in rest)
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc, start, ids = rest.pop(0)
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:]))
                    ids = ids[:room]
                taken.append((doc, start, ids))
                room -= len(ids)
            yield from self._sequence(taken)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = 4096, end_id: int | None = 2, fine: int = 32) -> DataFrame:
    """The pieces of all documents, each at its place in a sequence.

    ``tokenizer`` is the path of a definition file, read on the driver and sent to the
    workers. Columns: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens
    (with the end token), sequence_id, offset. Sequence numbers are unique, and the same
    when a task runs again over the same rows.
    """
    import pyarrow as pa

    shared.text_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(definition.value)
        packer = Packer(capacity, fine, TaskContext.get().partitionId() << 33)
        schema: list = []
        end = np.array([] if end_id is None else [end_id], "<u4")

        def table(pieces: list) -> pa.RecordBatch:
            doc, start, ids, seq, at = zip(*pieces)
            longs = [pa.array(x, pa.int64()) for x in (start, [len(i) for i in ids], [d[1] for d in doc], seq, at)]
            keys = pa.array([d[0] for d in doc], schema[0])
            return pa.RecordBatch.from_arrays([keys, longs[0], longs[1], pa.array([i.tobytes() for i in ids], pa.binary()), *longs[2:]], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        ready: list = []
        for batch in batches:
            schema[:] = [batch.column(0).type]
            for lo, hi, data, at in shared.text_steps(batch.column(1), STEP_BYTES):
                flat, n = encoder.rows(data, at)
                for name, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), np.split(flat, np.cumsum(n)[:-1])):
                    ids = np.concatenate([ids, end])
                    ready += packer.add((name, len(ids)), ids)
                    if len(ready) >= BATCH_PIECES:
                        yield table(ready)
                        ready = []
        ready += packer.finish()
        for i in range(0, len(ready), BATCH_PIECES):
            yield table(ready[i : i + BATCH_PIECES])

    out = rows.mapInArrow(work, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("key", key)
