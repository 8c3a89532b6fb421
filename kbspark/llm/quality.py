"""Ordinal regression on graded ratings: one weight for each hashed text feature, ordered thresholds between grades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS_REMEMBERED, as_bytes, own_id
from .decontaminate import words_of

#: Labelled rows that a model is fitted on, at most about; drawn by a hash of the id.
TRAIN_ROWS = 8_000
#: Buckets of hashed features, texts that must have a feature, strength of the shrinkage that chooses features, and rounds
#: of the choice and of the fit of those chosen.
BITS, LEAST_TEXTS, SHRINK, ROUNDS, FIT_ROUNDS = 20, 5, 2e-3, 150, 150
#: Bytes of the beginnings of words that count as features beside whole words.
BEGINNINGS = (4, 5, 6)

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, 9, 10, 13, 46, 44])


def features(text: bytes | None) -> set[bytes]:
    """The distinct words and word beginnings of a whole text, and in tenths its shares of capitals, digits and odd characters."""
    text = text or b""
    size = max(len(text), 1)
    shares = (len(text) - len(text.translate(None, kind)) for kind in (_UPPER, _DIGIT, _PLAIN))
    upper, digit, plain = (int(10 * n / size) for n in shares)
    words = set(words_of(text))
    beginnings = {b"\x01" + w[:n] for w in words for n in BEGINNINGS if len(w) > n}
    return words | beginnings | {b"\x00u%d" % upper, b"\x00d%d" % digit, b"\x00p%d" % plain}


def bucket(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - BITS)


@dataclass
class Model:
    """P(grade <= k) = logistic(cuts[k] - sum of the weights of a text's features); cuts ascend."""

    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.cuts[None, :], -50, 50)))
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1), axis=1)


def train(grades: np.ndarray, lists: list[np.ndarray], n_grades: int) -> Model:
    """Proximal gradient descent with a step for each coordinate, until weights that don't pay for themselves are 0.

    Then those left are fitted anew without shrinkage, which would hold them too small.
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
    seen, at = np.unique(flat, return_inverse=True)
    common = np.bincount(at, minlength=len(seen)) >= LEAST_TEXTS if len(seen) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(lists)), sizes)[common[at]]
    new = np.cumsum(common) - 1
    at, seen = new[at[common[at]]], seen[common]
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(len(grades), 1), 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-6 * np.arange(n_grades - 1))
    w, past_w, past_c, n = np.zeros(len(seen)), np.full(len(seen), 1e-8), np.full(n_grades - 1, 1e-8), max(len(grades), 1)
    for round_ in range(ROUNDS + FIT_ROUNDS if len(grades) else 0):
        if round_ == ROUNDS:
            left = np.flatnonzero(w)
            new = np.full(len(seen), -1)
            new[left] = np.arange(len(left))
            row, at = row[new[at] >= 0], new[at[new[at] >= 0]]
            w, past_w, seen, past_c = w[left], np.full(len(left), 1e-8), seen[left], np.full(n_grades - 1, 1e-8)
        score = np.bincount(row, w[at], len(lists))
        low = np.where(grades > 0, cuts[np.maximum(grades - 1, 0)] - score, -50.0)
        high = np.where(grades < n_grades - 1, cuts[np.minimum(grades, n_grades - 2)] - score, 50.0)
        s_low, s_high = (1 / (1 + np.exp(-np.clip(x, -50, 50))) for x in (low, high))
        p = np.maximum(s_high - s_low, 1e-9)
        d_low, d_high = s_low * (1 - s_low) / p, s_high * (1 - s_high) / p
        g = np.bincount(at, (d_high - d_low)[row], len(seen)) / n + 1e-5 * w
        gc = np.zeros(n_grades - 1)
        np.add.at(gc, np.maximum(grades - 1, 0), np.where(grades > 0, d_low, 0) / n)
        np.add.at(gc, np.minimum(grades, n_grades - 2), np.where(grades < n_grades - 1, -d_high, 0) / n)
        past_w += g * g
        past_c += gc * gc
        step = 0.3 / np.sqrt(past_w)
        w -= step * g
        if round_ < ROUNDS:
            w = np.sign(w) * np.maximum(np.abs(w) - step * SHRINK, 0)
        cuts = np.maximum.accumulate(cuts - 0.3 / np.sqrt(past_c) * gc)
    weights = np.zeros(1 << BITS, np.float32)
    weights[seen] = w
    return Model(weights, cuts)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Learn from the rated rows of docs; ratings has id_col and grade_col (0 to n_grades - 1; null or other: not rated).

    At most about TRAIN_ROWS ids are drawn by a hash, so the join with docs broadcasts a bounded table and no text is
    shuffled; of the texts only hashed features reach the driver. An id counts once: rated several times by its least grade, and
    with several texts by that of the least features. Null ids are not rated; null and empty texts have no words; whole texts
    count. Ids are compared as integers if both tables have such, else as strings. Empty tables give a model without weights.
    """
    id_, kind, arrow = own_id(docs, id_col)
    if own_id(ratings, id_col)[1] != kind:
        id_, kind, arrow = id_.cast("string"), "string", pa.string()
    rated = ratings.where(F.col(grade_col).between(0, n_grades - 1) & F.col(id_col).isNotNull())
    rated = rated.groupBy(F.col(id_col).cast(kind).alias("_rated")).agg(F.min(F.col(grade_col).cast("int")).alias("_grade"))
    share = min(1.0, TRAIN_ROWS / max(rated.count(), 1))
    drawn = rated.where(F.pmod(F.xxhash64("_rated", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            lists = [np.array(sorted({bucket(f) for f in features(t)}), np.int32).tobytes() for t in as_bytes(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(arrow), batch.column("_grade"), pa.array(lists, pa.binary())], names=["_id", "_grade", "_features"])

    texts = docs.select(id_.alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(drawn), F.col("_id") == F.col("_rated")).select("_id", "_grade", "_text").mapInArrow(listed, f"_id {kind}, _grade int, _features binary")
    rows = sorted(rows.groupBy("_id").agg(F.min("_grade").alias("_grade"), F.min("_features").alias("_features")).collect())
    return train(np.array([r["_grade"] for r in rows], np.int64), [np.frombuffer(r["_features"], np.int32) for r in rows], n_grades)


#: Weights are summed in these units, as integers, so a sum doesn't depend on the order of features.
UNIT = 2.0**-40


class _Weights(dict):
    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= WORDS_REMEMBERED:
            self.clear()
        value = self[feature] = round(float(self.weights[bucket(feature)]) / UNIT)
        return value


def grade(docs: DataFrame, model: Model, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, expected_grade and p_tail, the probability of a grade of least or more.

    Whole texts count, however long. A null text is graded as an empty one. Rows are independent, so repeated rows get equal
    grades; ids may have any type or be null; other columns are ignored. With nothing learned every row gets the same grade. An
    empty table gives no rows. Scored where the rows are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        held = _Weights(m.weights)
        for batch in source:
            scores = np.array([UNIT * sum(map(held.__getitem__, features(t))) for t in as_bytes(batch.column("_text"))])
            p = m.probabilities(scores)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, least:].sum(axis=1))], names=["_id", "expected_grade", "p_tail"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()
    return narrow.mapInArrow(scored, f"_id {kind}, expected_grade double, p_tail double").withColumnRenamed("_id", id_col)
