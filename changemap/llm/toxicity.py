"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemap.llm.text import aside, as_bytes, plain_words

FEATURES = 1 << 18
# labelled rows that the model is fitted on; a bounded sample by the hash of the id
MAX_TRAIN = 6000
STEPS = 300
RATE = 0.03
RIDGE = 1e-3
MIN_SUPPORT = 5
# words whose weights a task keeps at hand
MEMO = 100_000
# rejected from this expected severity on; grades start at 0
THRESHOLD = 0.2
# a word marks toxic texts if this many times as frequent there, in so many texts
MARKER_RATIO = 20.0
MARKER_TEXTS = 5


def word_features(word: bytes) -> tuple[int, ...]:
    """The buckets of a word: itself and its first characters, for words built on one stem."""
    stems = {word, b"^" + word[:4], b"^" + word[:6]}
    return tuple(zlib.crc32(s) % FEATURES for s in stems)


def text_features(raw: bytes | None) -> np.ndarray:
    """Buckets of the distinct words of a whole text, one entry for each word and kind."""
    return np.array([b for w in sorted(set(plain_words(raw))) for b in word_features(w)], np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    """One weight vector for all thresholds: P(grade > k) = logistic(weights.x - cuts[k])."""

    weights: np.ndarray
    cuts: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the probabilities to be above each threshold."""
        return _logistic(np.asarray(score, np.float64)[..., None] - self.cuts).sum(axis=-1)


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Ordinal:
    """Maximum likelihood with a ridge, by full-batch Adam. Grades are 0, 1, ... without gaps.

    The cuts stay ordered: the first is free, the steps between them are exponentials.
    Without rows, or with one grade only, all weights are zero and every severity is the
    mean grade.
    """
    grades = np.asarray(grades, np.int64)
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Ordinal(np.zeros(FEATURES), np.array([30.0]))
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    support = np.bincount(flat, minlength=FEATURES)  # a bucket of few texts would only learn those texts
    row, flat = row[support[flat] >= MIN_SUPPORT], flat[support[flat] >= MIN_SUPPORT]
    used = np.flatnonzero(support >= MIN_SUPPORT)
    place = np.zeros(FEATURES, np.int32)
    place[used] = np.arange(len(used))
    at = place[flat]
    above = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    p = np.concatenate((np.zeros(len(used)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(rows)
    for t in range(1, steps + 1):
        w, head, gaps = p[:len(used)], p[len(used)], np.exp(p[len(used) + 1:])
        cuts = head + np.concatenate(([0.0], np.cumsum(gaps)))
        f = np.bincount(row, w[at], n)
        up = np.concatenate((np.ones((n, 1)), _logistic(f[:, None] - cuts), np.zeros((n, 1))), axis=1)
        each = np.arange(n)
        hi, lo = up[each, grades], up[each, grades + 1]
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob  # of log P by the score
        df = -(dhi - dlo) / n
        dcut = np.zeros(top)
        np.add.at(dcut, grades[grades > 0] - 1, dhi[grades > 0] / n)
        np.add.at(dcut, grades[grades < top], -dlo[grades < top] / n)
        later = np.cumsum(dcut[::-1])[::-1]
        g = np.concatenate((np.bincount(at, df[row], len(used)) + ridge * w, later[:1], later[1:] * gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    weights = np.zeros(FEATURES)
    weights[used] = p[:len(used)]
    return Ordinal(weights, p[len(used)] + np.concatenate(([0.0], np.cumsum(np.exp(p[len(used) + 1:])))))


def grade_sample(texts: list[bytes], toxic: np.ndarray) -> np.ndarray:
    """Severity grades for texts, given as words, that are only labelled toxic or not.

    0: not toxic. 1: toxic. 2: toxic with at least as many distinct marker words as half
    of the toxic texts. Markers are words far more frequent in the toxic texts.
    """
    bad, good = Counter(), Counter()
    for t, y in zip(texts, toxic):
        (bad if y else good).update(set(t.split()))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    markers = {
        w for w, c in bad.items()
        if c >= MARKER_TEXTS and math.log(c / n_bad) - math.log((good[w] + 0.5) / n_good) >= math.log(MARKER_RATIO)
    }
    hits = np.array([len(markers.intersection(t.split())) for t in texts])
    median = np.median(hits[toxic == 1]) if toxic.any() else 0
    return np.where(toxic == 1, np.where(hits >= max(2, median), 2, 1), 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Ordinal:
    """Fits on at most ``max_train`` labelled rows, taken by the hash of their id.

    Rows with null text, id or label are left out; of several texts with one id the least
    counts, and of several labels the highest, so the model does not change from run to run.
    Without labels nothing is toxic. This sample is the one thing that
    goes to the driver: ``max_train`` texts.
    """
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic"))
    chosen = marked.join(docs.where(F.col(text_col).isNotNull()).select(id_col).distinct(), id_col, "left_semi")
    chosen = chosen.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_train)
    rows = (
        docs.select(id_col, as_bytes(F.col(text_col)).alias("_raw")).join(F.broadcast(chosen), id_col)
        .where("_raw IS NOT NULL").groupBy(id_col, "_toxic").agg(F.min("_raw").alias("_raw"))
    )

    def words(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda raw: b" ".join(sorted(set(plain_words(bytes(raw))))))

    got = rows.select(F.pandas_udf(words, "binary")("_raw").alias("w"), "_toxic", F.xxhash64(F.col(id_col)).alias("h")).collect()
    got.sort(key=lambda r: (r["h"], bytes(r["w"])))
    toxic = np.array([int(r["_toxic"] > 0) for r in got], np.int64)
    texts = [bytes(r["w"]) for r in got]
    del got
    grades = grade_sample(texts, toxic) if texts else toxic
    present = np.unique(grades)
    grades = np.searchsorted(present, grades) if len(present) and present[0] == 0 else grades * 0
    return fit([text_features(t) for t in texts], grades)


class _Scores(dict):
    """Word -> its weight, filled as words come up; cleared when large."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) > MEMO:
            self.clear()
        self[word] = s = float(sum(self.weights[b] for b in word_features(word)))
        return s


def severity(text: Column, model: Ordinal, spark) -> Column:
    """Expected severity of whole texts, 0 to the highest grade; null, empty and wordless texts 0."""
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.cuts))

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, cuts = sent.value
        of, shared = _Scores(weights), Ordinal(weights, cuts)
        for batch in texts:
            score = np.full(len(batch), -np.inf)
            for k, raw in enumerate(batch):  # the words of one text at a time
                if words := set(plain_words(raw)):
                    score[k] = math.fsum(map(of.__getitem__, words))
            yield pd.Series(shared.severity(score))

    return F.pandas_udf(scored, "double")(as_bytes(text))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity``; replaces a column of that name, others pass through."""
    return docs.withColumn("severity", severity(F.col(text_col), model, docs.sparkSession))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below ``threshold``, by a model fitted on ``labels``; all their columns,
    whatever their names. Rows with null or empty text stay, and so do repeated rows; an empty table stays empty."""
    docs, new, back = aside(docs, {"_severity", "_toxic", "_raw"})
    text_col = new.get(text_col, text_col)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns], severity(F.col(text_col), train(docs, labels, text_col=text_col), docs.sparkSession).alias("_severity"))
    return back(kept.where(F.col("_severity") < threshold).drop("_severity"))
