"""Quality: ordinal regression with cumulative links on graded ratings.

One vector of weights over hashed text features, shared by all grades, gives a text its place z; ordered thresholds
t_1 < t_2 < ... cut the line: P(grade >= k) = sigmoid(z - t_k). The features of a text are the shares of its words' hashes
and of their shapes (letters, digits and signs with runs shortened), and the share of words that repeat the one before.
The expected grade is the sum over grades; the tail probability P(grade >= cut) selects."""

from __future__ import annotations

import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import Bounded, kept, slices
from kinlink.llm.labelled import held_out, sample

SPACE, PER_LABEL, ROUNDS, RATE = 1 << 16, 1500, 150, 0.3
SHAPES = 1 << 12
REPEAT = SPACE + SHAPES
_RUNS = re.compile(r"(.)\1+")


def _shape(chunk: bytes) -> int:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in chunk.decode("utf-8", "replace"))
    return SPACE + zlib.crc32(_RUNS.sub(r"\1+", kinds).encode()) % SHAPES


def _pair(chunk: bytes) -> int:
    """The word's hash and its shape's, in one number."""
    return zlib.crc32(chunk) % SPACE << 12 | _shape(chunk) - SPACE


@kept
def _pairs() -> Bounded:
    return Bounded(_pair, 300_000)


def hashed(data: bytes) -> np.ndarray:
    """Pairs for each word; a last number has the words that repeat the one before."""
    words = data.split()
    again = sum(map(operator.eq, words, words[1:]))
    return np.append(np.fromiter(map(_pairs().__getitem__, words), np.int64, len(words)), again).astype(np.int32)


def features(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, shares) of what hashed() gives."""
    words, again = pairs[:-1], int(pairs[-1])
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.concatenate([words >> 12, SPACE + (words & SHAPES - 1)]).astype(np.int64)
    index, n = np.unique(both, return_counts=True)
    return np.append(index, REPEAT), np.append(n, again) / len(words)


class Model:
    def __init__(self, grades, weights, cuts):
        self.grades, self.weights, self.cuts = grades, weights, cuts

    def tails(self, z: float) -> np.ndarray:
        """P(grade >= k) for each grade but the lowest."""
        return 1 / (1 + np.exp(-np.clip(z - self.cuts, -30, 30)))

    def expected(self, z: float) -> float:
        return float(self.grades[0] + (np.diff(self.grades) * self.tails(z)).sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray) -> Model:
    """Full-batch Adam on the mean log-likelihood, each grade weighted alike, with a small L2 penalty."""
    grades = np.unique(grade).astype(float)
    k = np.searchsorted(grades, grade)
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    index, value = (np.concatenate([r[j] for r in rows]) for j in (0, 1))
    weight = 1 / np.bincount(k)[k]
    weight /= weight.sum()
    theta = np.concatenate([np.zeros(REPEAT + 1), [-1.0], np.full(len(grades) - 2, 0.5)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    at = np.arange(1, len(grades))
    for step in range(1, ROUNDS + 1):
        w, raw = theta[: REPEAT + 1], theta[REPEAT + 1 :]
        cuts = raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])
        z = np.bincount(row, w[index] * value, len(rows))
        tail = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None], -30, 30)))
        full = np.concatenate([np.ones((len(z), 1)), tail, np.zeros((len(z), 1))], axis=1)
        mine = np.maximum(full[np.arange(len(z)), k] - full[np.arange(len(z)), k + 1], 1e-9)
        slope = tail * (1 - tail)  # d tail_j / d z; of the likelihood: plus for j = k, minus for j = k + 1
        sign = (at[None] == k[:, None]).astype(float) - (at[None] == k[:, None] + 1)
        d = sign * slope / mine[:, None] * weight[:, None]
        gz, gc = -d.sum(axis=1), d.sum(axis=0)
        graw = np.array([gc.sum(), *[gc[i:].sum() * np.exp(raw[i]) for i in range(1, len(raw))]])
        g = np.concatenate([np.bincount(index, gz[row] * value, REPEAT + 1) + 1e-6 * w, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = theta[REPEAT + 1 :]
    return Model(grades, theta[: REPEAT + 1], raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))]))


def graded(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, cut: int | None = None, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, held_out (never learned from), expected_grade, tail_prob = P(grade >= cut; the top
    grade by default) and selected (tail_prob >= least).

    Learned from at most per_label documents of each grade. Null and empty texts lie at z = 0 and are judged by the
    thresholds alone. Repeated rows give repeated rows. With fewer than two grades known every document gets that grade
    (0 without any) and is selected. An empty table gives no rows; other columns are not read."""
    rows, _ = sample(docs, labels, label, per_label, hashed)
    spark = docs.sparkSession
    grade = np.array([r[1] for r in rows])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    if len(set(grade.tolist())) < 2:
        same = float(grade[0]) if len(grade) else 0.0
        out = ids.select("doc_id", F.lit(same).alias("expected_grade"), F.lit(1.0).alias("tail_prob"))
    else:
        model = fit([features(r[2]) for r in rows], grade)
        top = int(np.searchsorted(model.grades, model.grades[-1] if cut is None else cut)) - 1
        shared = spark.sparkContext.broadcast(model)

        def run(batches):
            model = shared.value
            weights = model.weights.tolist()
            cache = Bounded(lambda c: weights[zlib.crc32(c) % SPACE] + weights[_shape(c)], 300_000)
            for batch in slices(batches):
                expected, tails = [], []
                for text in batch.column(1).to_pylist():
                    words = text.split()
                    again = sum(map(operator.eq, words, words[1:]))
                    z = (sum(map(cache.__getitem__, words)) + weights[REPEAT] * again) / len(words) if words else 0.0
                    expected.append(model.expected(z))
                    tails.append(float(model.tails(z)[min(max(top, 0), len(model.cuts) - 1)]) if top >= 0 else 1.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(expected, pa.float64()), pa.array(tails, pa.float64())], ["doc_id", "expected_grade", "tail_prob"])

        out = ids.mapInArrow(run, "doc_id long, expected_grade double, tail_prob double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", (F.col("tail_prob") >= least).alias("selected"))
