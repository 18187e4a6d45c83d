"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the same table, whatever their label,
are the unlabelled. A linear classifier in numpy minimises the class-prior-corrected
risk  prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)),
whose negative part is kept from falling below zero by stepping back when it does
(Kiryo et al., 2017). The prior is the share of toxic texts among labelled ones.

Features are words and their first 3 to 6 and last 4 bytes, lower case, as hashes.
Those whose document frequency differs most between positives and unlabelled texts, and
by more than chance would have it, are kept (a fixed number), so the model is a small table that every worker holds; all
texts are scored whole, in Arrow batches.

Edge cases: a null or empty text has no feature and gets the score of the bias; without
a confirmed toxic text all scores are 0; null keys and labels teach nothing; a row that
is repeated is scored alike; labels of unknown documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared

PREFIXES = (3, 4, 5, 6)
SUFFIX = 4


def features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each occurrence of each feature in a piece of texts."""
    text = shared.lower(data)
    starts, ends, before = shared.word_spans(text, rows, shared.IS_NO_LETTER)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(before))
    spans = shared.Spans(text)
    size = ends - starts
    out_row, out_hash = [row], [spans.of(starts, ends)]
    for n in PREFIXES:
        long = size > n
        out_row.append(row[long])
        out_hash.append(spans.of(starts[long], starts[long] + n) ^ np.uint64(0x5050505050505050 + n))
    long = size > SUFFIX
    out_row.append(row[long])
    out_hash.append(spans.of(ends[long] - SUFFIX, ends[long]) ^ np.uint64(0x7373737373737373))
    return np.concatenate(out_row), np.concatenate(out_hash).view(np.int64)


def train_nnpu(x_p: list[tuple[np.ndarray, np.ndarray]], x_u: list[tuple[np.ndarray, np.ndarray]], dims: int, prior: float, epochs: int = 60, rate: float = 0.05, l2: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Weights (the last is the bias) for rows given as (indices, values): Adam on the
    non-negative risk with the logistic loss, in minibatches of both kinds."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    w[-1] = np.log(prior / (1 - prior))
    batches = max(1, min(40, len(x_u) // 500))
    t = 0

    def stack(rows):
        ids = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        values = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        return ids, values, of, len(rows)

    def margins(s):
        ids, values, of, n = s
        return np.bincount(of, w[ids] * values, minlength=n) + w[-1]

    def gradient(s, per_row):
        ids, values, of, _ = s
        g = np.bincount(ids, per_row[of] * values, minlength=dims + 1)
        g[-1] = per_row.sum()
        return g

    cut = lambda rows, parts: [stack([rows[i] for i in order]) for order in np.array_split(rng.permutation(len(rows)), parts)]
    for epoch in range(epochs):
        for p, u in zip(cut(x_p, batches), cut(x_u, batches)):
            if not p[3] or not u[3]:
                continue
            fp, fu = margins(p), margins(u)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            g_negative = gradient(u, su / u[3]) - prior * gradient(p, sp / p[3])
            g = prior * gradient(p, (sp - 1) / p[3]) + g_negative if negative >= 0 else -g_negative
            g[:-1] += l2 * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (0.98**epoch) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[-1] -= cut_point(margins(stack(x_p)), margins(stack(x_u)))
    return w


def cut_point(f_p: np.ndarray, f_u: np.ndarray) -> float:
    """The margin at which to call a text toxic: the one with the largest recall^2 /
    Pr(called toxic), a criterion that needs no negatives (Lee and Liu, 2003), then half
    way down to the next text."""
    if not len(f_p) or not len(f_u):
        return 0.0
    f_p, f_u = np.sort(f_p), np.sort(f_u)
    recall = (len(f_p) - np.arange(len(f_p))) / len(f_p)
    called = (len(f_u) - np.searchsorted(f_u, f_p)) / len(f_u)
    best = f_p[np.argmax(recall**2 / np.maximum(called, 1 / len(f_u)))]
    below = max([x[np.searchsorted(x, best) - 1] for x in (f_p, f_u) if x[0] < best], default=best - 2.0)
    return float(best + below) / 2


@dataclass(frozen=True)
class ToxicityModel:
    hashes: np.ndarray  # sorted
    weights: np.ndarray  # one for each hash, then the bias
    prior: float

    def rows(self, data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(indices, values) of each row: the logarithm of one more than the count."""
        row, slot = self._slots(data, at)
        d = max(1, len(self.hashes))
        kinds, n = np.unique(row * d + slot, return_counts=True)
        cut = np.searchsorted(kinds, np.arange(len(at)) * d)
        return [(kinds[a:b] % d, np.log1p(n[a:b])) for a, b in zip(cut[:-1], cut[1:])]

    def _slots(self, data, at):
        row, h = features(data, at)
        if not len(self.hashes):
            return row[:0], row[:0]
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[slot] == h
        return row[known], slot[known]

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, slot = self._slots(data, at)
        d = max(1, len(self.hashes))
        kinds, n = np.unique(row * d + slot, return_counts=True)
        f = np.bincount(kinds // d, self.weights[kinds % d] * np.log1p(n), minlength=len(at) - 1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", max_positive: int = 20_000, max_unlabelled: int = 30_000, kept_features: int = 1024, min_docs: int = 4, min_z: float = 4.0) -> ToxicityModel:
    """Learn from at most ``max_positive`` confirmed toxic texts and about
    ``max_unlabelled`` texts in all, chosen by a hash of the key."""
    shared.text_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_toxic"))
    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = keyed.select("_key").join(known, "_key", "left")
    n, n_known, n_toxic = marked.agg(F.count("*"), F.count("_toxic"), F.sum(F.coalesce("_toxic", F.lit(0)))).first()
    if not n_toxic:
        return ToxicityModel(np.zeros(0, np.int64), np.array([-30.0]), 0.0)
    prior = min(0.9, max(1e-3, n_toxic / n_known))
    # The texts are not shuffled: the unlabelled are told by their keys' hashes, the positives by a list of bounded length.
    at = F.shiftrightunsigned(F.xxhash64("_key"), 1) / float(1 << 63)
    positive = marked.where("_toxic = 1").select("_key").distinct().orderBy(F.xxhash64("_key")).limit(max_positive).withColumn("p", F.lit(True))
    chosen = keyed.join(F.broadcast(positive), "_key", "left").select("_text", F.coalesce("p", F.lit(False)).alias("p"), (at < max_unlabelled / n).alias("u"))
    chosen = shared.stash(chosen.where(F.col("p") | F.col("u")), "toxicity-sample")

    def differences(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            is_p, is_u = (np.array(batch.column(i).to_pylist(), bool) for i in (1, 2))
            for lo, hi, data, rows in shared.text_steps(batch.column(0)):
                row, h = features(data, rows)
                once = np.unique(np.stack([h, row]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
                kinds, first = np.unique(once[0], return_index=True)
                if len(kinds):
                    n_p = np.add.reduceat(is_p[lo:hi][once[1]].astype(np.int64), first)
                    n_u = np.add.reduceat(is_u[lo:hi][once[1]].astype(np.int64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n_p), pa.array(n_u)], ["h", "p", "u"])

    n_p, n_u = chosen.agg(F.sum(F.col("p").cast("long")), F.sum(F.col("u").cast("long"))).first()
    n_p, n_u = max(1, n_p or 0), max(1, n_u or 0)
    counts = chosen.mapInArrow(differences, "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u") + 1) / float(n_p + n_u + 2)
    z = F.abs(F.col("p") / float(n_p) - F.col("u") / float(n_u)) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = counts.where((F.col("p") + F.col("u") >= min_docs) & (z >= min_z)).orderBy(F.desc(z), "h").limit(kept_features).select("h").collect()
    blank = ToxicityModel(np.sort(np.array([r.h for r in best], np.int64)), np.zeros(len(best) + 1), prior)

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, rows in shared.text_steps(batch.column(0)):
                got = blank.rows(data, rows)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], ["p", "u", "i", "x"])

    got = sorted(chosen.mapInArrow(vectors, "p boolean, u boolean, i binary, x binary").collect(), key=lambda r: (bytes(r.i), bytes(r.x)))
    sparse = [(np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(np.float64)) for r in got]
    x_p = [s for s, r in zip(sparse, got) if r.p]
    x_u = [s for s, r in zip(sparse, got) if r.u]
    return ToxicityModel(blank.hashes, train_nnpu(x_p, x_u, len(best), prior), prior)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row of ``docs`` with its score (0 to 1, higher: likelier toxic)."""
    rows = docs.select(F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, at in shared.text_steps(batch.column(0)):
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sent.value.score(data, at))], [*[f"_keep_{i}" for i in range(len(columns))], "score"])

    kinds = ", ".join(f"_keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return rows.mapInArrow(work, f"{kinds}, score double").select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "score")
