"""Toxicity as cumulative-link ordinal regression.

Severity grades are ordered: P(grade >= k) = sigmoid(w.x - theta_k), one weight vector for all thresholds and
theta increasing. x counts the hashed words of a text and the words' beginnings, up to 4. The output is the expected severity, the sum of
P(grade >= k), and a text counts as toxic if P(grade >= 1) is at least one half.

The model is fitted on at most `per_grade` labelled documents of each grade, those with the smallest hash of
their id, and of these on as many as have `sample_bytes` of features together; every document is scored over its
whole text.

Defined results: null text and text without a word have severity 0 and are not toxic, and so has every text if
fewer than two grades are labelled; labels that are null or have no document are not learned from; a document with
several labels or rows is learned from with each; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from .kernels import LETTERS, U, buffers, mix

BITS = 18
HEADS = (3, 4, 5)  # bytes of a word's beginning


def word_bins(column: pa.Array):
    """Sorted distinct feature bins of each text, and how often each occurs: whole words, and their beginnings.

    A long text is read in pieces at separators, so every word counts.
    """
    data, offsets = buffers(column)
    for r in range(len(offsets) - 1):
        parts = []
        for a, b in LETTERS.pieces(data, int(offsets[r]), int(offsets[r + 1])):
            cut = LETTERS.of(data, np.array([a, b]))
            parts += [cut.h, *(mix(cut.heads(k) + U(k)) for k in HEADS)]
        every = (np.concatenate(parts) >> U(64 - BITS)).astype(np.int32) if parts else np.empty(0, np.int32)
        yield np.unique(every, return_counts=True)


def packed(bins: np.ndarray, counts: np.ndarray) -> bytes:
    return bins.astype("<i4").tobytes() + np.minimum(counts, 255).astype("<i4").tobytes()


def value(counts: np.ndarray) -> np.ndarray:
    """What a feature is worth that occurs so often."""
    return np.minimum(counts, 4.0)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade from 0/1 labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    rows = labels.where("doc_id is not null and toxic is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(1)) == 0, 2).otherwise(1).alias("grade"))


def _features(batches):
    for b in batches:
        yield pa.record_batch([b.column("grade"), pa.array([packed(*x) for x in word_bins(b.column("text"))], pa.binary())], ["grade", "bins"])


class CumulativeLink:
    """Weights by bin, and the ordered thresholds."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each score and threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta[None, :], -40, 40)))


class Likelihood:
    """The penalised likelihood of graded texts: weights of the features that enough texts have, then the thresholds.

    The first threshold is a parameter as it is, each further one the logarithm of its distance from the one before.
    """

    def __init__(self, grades: np.ndarray, bins: list[np.ndarray], counts: list[np.ndarray], least: int, l2: float):
        self.grades, self.top, self.n = grades, int(grades.max()), len(grades)
        lens = np.array([len(b) for b in bins])
        flat = np.concatenate(bins) if bins else np.empty(0, np.int32)
        keep = np.bincount(flat, minlength=1 << BITS)[flat] >= least
        self.row, self.x = np.repeat(np.arange(len(bins)), lens)[keep], value(np.concatenate(counts))[keep]
        self.used, self.col = np.unique(flat[keep], return_inverse=True)
        self.k, self.l2 = len(self.used), l2 / max(1, np.sqrt(self.n))
        self.weight = np.ones(self.n)
        for g in range(self.top + 1):  # grades weigh alike, however many rows they have
            self.weight[grades == g] = self.n / ((self.top + 1) * max(1, (grades == g).sum()))

    def start(self) -> np.ndarray:
        cum = [float(self.weight[self.grades >= k].sum() / self.weight.sum()) for k in range(1, self.top + 1)]
        raw = np.array([np.log((1 - c) / max(c, 1e-3)) for c in cum])
        return np.concatenate([np.zeros(self.k), raw[:1], np.log(np.maximum(np.diff(raw), 1e-2))])

    def theta(self, par: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([par[self.k : self.k + 1], np.exp(par[self.k + 1 :])]))

    def loss(self, par: np.ndarray) -> tuple[float, np.ndarray]:
        """What a text costs on average, with the penalty; and its gradient."""
        k, grades, at = self.k, self.grades, np.arange(self.n)
        score = np.bincount(self.row, weights=par[:k][self.col] * self.x, minlength=self.n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - self.theta(par)[None, :], -40, 40)))
        one, none = np.ones((self.n, 1)), np.zeros((self.n, 1))
        full, slope = np.concatenate([one, p, none], 1), np.concatenate([none, p * (1 - p), none], 1)
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        d_low, d_high = slope[at, grades] / mass, slope[at, grades + 1] / mass  # d log mass / d(score - theta)
        g_score = -self.weight * (d_low - d_high)
        g_theta = np.bincount(grades, weights=self.weight * d_low, minlength=self.top + 1)[1:] - np.bincount(grades, weights=self.weight * d_high, minlength=self.top + 1)[:-1]
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(self.col, weights=g_score[self.row] * self.x, minlength=k), tail[:1], tail[1:] * np.exp(par[k + 1 :])]) / self.n
        grad[:k] += self.l2 * par[:k]
        return float(-(self.weight * np.log(mass)).sum() / self.n + self.l2 / 2 * (par[:k] ** 2).sum()), grad


def fit(grades: np.ndarray, bins: list[np.ndarray], counts: list[np.ndarray], least: int = 3, l2: float = 0.3, steps: int = 250) -> CumulativeLink:
    """Maximum penalised likelihood by full-batch Adam; words in fewer than `least` texts get no weight."""
    of = Likelihood(grades, bins, counts, least, l2)
    par = of.start()
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, steps + 1):
        _, grad = of.loss(par)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        par -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[of.used] = par[: of.k]
    return CumulativeLink(weights, of.theta(par))


def train(docs: DataFrame, grades: DataFrame, per_grade: int = 4000, top: int = 2, sample_bytes: int = 48 << 20) -> CumulativeLink | None:
    """The model, or None if fewer than two grades have documents."""
    picked = None
    for g in range(top + 1):
        some = grades.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # at most per_grade rows a grade
    found = rows.select("grade", "text").mapInArrow(_features, "grade int, bins binary").withColumn("size", F.octet_length("bins"))
    few = W.partitionBy("grade").orderBy(F.xxhash64("bins"), "bins").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumns({"sofar": F.sum("size").over(few), "turn": F.row_number().over(W.partitionBy("grade").orderBy(F.xxhash64("bins"), "bins"))})
    got = found.where((F.col("sofar") <= sample_bytes // (top + 1)) & (F.col("turn") <= 2 * per_grade)).orderBy("grade", "turn").select("grade", "bins").collect()
    seen = sorted({r.grade for r in got})
    if len(seen) < 2:
        return None
    order = {g: i for i, g in enumerate(seen)}
    return fit(np.array([order[r.grade] for r in got]), *zip(*(np.frombuffer(r.bins, "<i4").reshape(2, -1) for r in got), strict=True))


def _score(model: CumulativeLink | None):
    def run(batches):
        for b in batches:
            bins = list(word_bins(b.column("text")))
            some = np.array([len(x) > 0 for x, _ in bins], bool) & (model is not None)
            severity, p = np.zeros(len(bins)), np.zeros(len(bins))
            if model is not None and some.any():
                above = model.above(np.array([float(model.weights[x] @ value(c)) for x, c in bins]))
                severity[some], p[some] = above.sum(1)[some], above[some, 0]
            yield pa.record_batch([b.column("doc_id"), pa.array(severity), pa.array(p), pa.array(p >= 0.5, pa.bool_())], ["doc_id", "severity", "p_toxic", "toxic"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_grade: int = 4000) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, toxic of every document."""
    model = train(docs, graded(labels), per_grade)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, severity double, p_toxic double, toxic boolean")
