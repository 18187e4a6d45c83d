"""Hierarchical language identification.

The family of a text's language is predicted first, then the language within that
family. Both levels are one-versus-one linear support vector machines over counts of
hashed byte trigrams of letters, trained with numpy by dual coordinate descent on a
bounded sample of the labelled texts; every text is then scored whole.

Edge cases: a text that is null or has no letter is ``und`` with score 0; null keys and
null languages teach nothing; languages with fewer than ``min_docs`` texts are not
learned; with one learned language every text gets it; repeated rows are scored alike;
a table without labelled texts yields ``und`` for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscope.llm import shared

UND = "und"
#: Families of languages by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "romance": "ca es fr gl it la oc pt ro",
    "semitic": "am ar he mt",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr tt uz",
    "uralic": "et fi hu",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def profile(data: np.ndarray, rows: np.ndarray, dims: int) -> np.ndarray:
    """A unit vector for each row: square roots of its trigram counts."""
    n = len(rows) - 1
    text = shared.lower(data)
    text = np.where(shared.IS_NO_LETTER[text], np.uint8(32), text)
    out = np.zeros((n, dims), np.float32)
    if len(text) > 2:
        tri = (text[:-2].astype(np.uint64) << np.uint64(16)) | (text[1:-1].astype(np.uint64) << np.uint64(8)) | text[2:]
        row = np.repeat(np.arange(n), np.diff(rows))[:-2]
        use = (text[1:-1] != 32) & (np.repeat(np.arange(n), np.diff(rows))[2:] == row)
        slot = (shared.mix(tri[use]) % np.uint64(dims)).astype(np.int64)
        out = np.sqrt(np.bincount(row[use] * dims + slot, minlength=n * dims)).astype(np.float32).reshape(n, dims)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, for
    y in {-1, 1}: dual coordinate descent, classes weighted to equal totals."""
    n, d = x.shape
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float64)
    cost = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * c
    alpha, w = np.zeros(n), np.zeros(d + 1)
    diag = (x * x).sum(1) + 1 / (2 * cost)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * (w @ x[i]) - 1 + alpha[i] / (2 * cost[i])
            step = max(alpha[i] - g / diag[i], 0.0) - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] += step
                most = max(most, abs(g))
        if most < 1e-3:
            break
    return w


@dataclass(frozen=True)
class OneVersusOne:
    """Machines for all pairs of classes; the class with the most votes wins, then the
    one with the larger sum of margins."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def train(x: np.ndarray, names: np.ndarray) -> OneVersusOne:
        classes = tuple(sorted(set(names.tolist())))
        pairs = tuple(combinations(range(len(classes)), 2))
        weights = []
        for a, b in pairs:
            use = (names == classes[a]) | (names == classes[b])
            weights.append(train_svm(x[use], np.where(names[use] == classes[a], 1.0, -1.0)))
        return OneVersusOne(classes, pairs, np.array(weights).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class index, confidence from 0.5 to 1) of each row."""
        n, k = len(x), len(self.classes)
        votes, worst = np.zeros((n, k)), np.full((n, k), np.inf)
        margin = x @ self.weights[:, :-1].T.astype(np.float32) + self.weights[:, -1].astype(np.float32)
        total = np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            m = margin[:, j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            total[:, a] += m
            total[:, b] -= m
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = np.argmax(votes + 1e-3 * np.tanh(total / max(1, k)), axis=1)
        sure = worst[np.arange(n), best]
        return best, np.where(np.isfinite(sure), 1 / (1 + np.exp(-3 * np.clip(sure, 0, 30))), 1.0)


@dataclass(frozen=True)
class LanguageModel:
    dims: int
    families: OneVersusOne
    within: dict[str, OneVersusOne]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self.families.predict(x)
        lang = np.empty(len(x), object)
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, more = self.within[name].predict(x[rows])
                lang[rows] = np.array(self.within[name].classes, object)[best]
                sure[rows] = sure[rows] * more
        return lang, sure


def sample(docs: DataFrame, by: str, key: str, most: int, min_docs: int = 1) -> DataFrame:
    """About ``most`` rows of each value of ``by`` that has ``min_docs``: those with the
    smallest hashes of ``key``, the same ones on every run."""
    counts = docs.where(F.col(by).isNotNull()).groupBy(by).count().where(F.col("count") >= min_docs)
    at = F.shiftrightunsigned(F.xxhash64(key), 1) / float(1 << 63)
    share = counts.select(F.col(by).alias("_by"), F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")).alias("_share"))
    return docs.join(F.broadcast(share), F.col(by) == F.col("_by")).where((F.col("_share") >= 1) | (at < F.col("_share"))).drop("_by", "_share")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 500, min_docs: int = 3, dims: int = 4096, max_docs: int = 6000) -> LanguageModel | None:
    """Learn every language that has ``min_docs`` texts, from about ``docs_per_language``
    of each and ``max_docs`` in all, but ``min_docs`` of each where there are very many;
    the sample's profiles (dims x 4 bytes each) are what the driver gets."""
    shared.text_batches(docs.sparkSession)
    named = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"))
    seen = named.select("_lang").distinct().count()
    per = min(docs_per_language, max(min_docs, max_docs // max(1, seen)))
    chosen = sample(named, "_lang", "_key", per, min_docs).select("_key", "_lang", "_text")
    kind = chosen.schema["_key"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, rows in shared.text_steps(batch.column(2), rows=512):
                x = profile(data, rows, dims)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in x], pa.binary())], ["key", "lang", "x"])

    got = chosen.mapInArrow(work, f"key {kind}, lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, str(r.key), bytes(r.x)))
    x = np.vstack([np.frombuffer(r.x, np.float32) for r in got])
    names = np.array([r.lang for r in got], object)
    family = np.array([family_of(n) for n in names], object)
    within = {f: OneVersusOne.train(x[family == f], names[family == f]) for f in sorted(set(family))}
    return LanguageModel(dims, OneVersusOne.train(x, family), within)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of each row of ``docs`` with lang_pred and score, from whole texts."""
    rows = docs.select(F.col(text).alias("_text"), (F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).alias("_letter"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            for lo, hi, data, at in shared.text_steps(batch.column(0), rows=512):
                if model is None:
                    lang, sure = np.full(hi - lo, UND, object), np.zeros(hi - lo)
                else:
                    lang, sure = model.predict(profile(data, at, model.dims))
                letter = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), bool)
                lang[~letter] = UND
                sure = np.where(letter, sure, 0.0)
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(np.clip(sure, 0, 1), pa.float64())], [*[f"_keep_{i}" for i in range(len(columns))], "lang_pred", "score"])

    kinds = ", ".join(f"_keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(work, f"{kinds}, lang_pred string, score double")
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key's text leaves ``part``; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
