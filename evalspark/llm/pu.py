"""Positive-unlabelled learning: a linear model trained by the non-negative risk estimate."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Features = Callable[[str], set]


@dataclass(frozen=True)
class Training:
    """Bounds and settings of one training run; the samples are spread over all rows by a hash of the id."""

    positives: int = 4_000  # most positive rows used
    unlabelled: int = 16_000  # most unlabelled rows used
    vocabulary: int = 20_000  # most features kept, those with the most evidence first
    least_rows: int = 5  # a kept feature is in so many sampled rows at least
    evidence: float = 25.0  # and its rates in the two samples differ by this chi-square at least
    rounds: int = 400
    rate: float = 0.05
    decay: float = 1e-4  # L2 weight
    beta: float = 0.0  # the negative risk may fall to -beta before its gradient is reversed
    gamma: float = 1.0  # size of the reversed step


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of the text's features); no features give sigmoid(bias)."""

    bias: float = 0.0
    weights: dict[bytes, float] = field(default_factory=dict)
    prior: float = 0.5

    def score(self, features: set) -> float:
        g = self.bias + sum(map(self.weights.__getitem__, features & self.weights.keys()))
        return float(1.0 / (1.0 + np.exp(-np.clip(g, -40.0, 40.0))))


def _bounded(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """About ``most`` rows and never above a few per cent more, by a hash of their id; all rows if there are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, as the features of a batch are held as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def minimise(positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float, how: Training) -> tuple[float, np.ndarray]:
    """(bias, weights) that minimise  prior * R+(P) + max(0, R-(U) - prior * R-(P))  with the logistic loss, by Adam.

    When the bracket, an estimate of the negatives' risk, falls below -beta, the step climbs it instead (Kiryo et al.,
    2017), which keeps a flexible model from driving it below what any true risk can be.
    """
    p_at, p_row = _csr(positive)
    u_at, u_row = _csr(unlabelled)
    n_p, n_u = len(positive), len(unlabelled)
    w = np.zeros(width + 1)  # the last is the bias
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def out(at, row, n):
        return np.bincount(row, weights=w[at], minlength=n) + w[-1]

    def slope(at, row, by):
        return np.append(np.bincount(at, weights=by[row], minlength=width), by.sum())

    for t in range(1, how.rounds + 1):
        g_p, g_u = out(p_at, p_row, n_p), out(u_at, u_row, n_u)
        s_p, s_u = _logistic(g_p), _logistic(g_u)
        # loss of calling g positive: log(1 + e^-g), slope s - 1; of calling it negative: log(1 + e^g), slope s
        negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
        bracket = slope(u_at, u_row, s_u / n_u) - slope(p_at, p_row, prior * s_p / n_p)
        if negative >= -how.beta:
            grad = slope(p_at, p_row, prior * (s_p - 1) / n_p) + bracket
        else:
            grad = -how.gamma * bracket
        grad[:-1] += how.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = how.rate * min(1.0, 2.0 * (1 - t / (how.rounds + 1)))
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return float(w[-1]), w[:-1]


def train(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, features: Features, how: Training) -> Model:
    """A model of ``label_col`` = 1 from docs (doc_id, text) and labels (doc_id, label_col).

    ``learn`` (over doc_id) says which labels may be seen.  Positives are docs with a seen label 1; the unlabelled
    sample is drawn from all docs, whose labels are not looked at.  The class prior is estimated as the share of 1
    among the seen labels, smoothed by half a row each way.  Without a positive or without docs the model is constant.
    """
    spark = docs.sparkSession
    seen = labels.filter(F.coalesce(learn, F.lit(False))).filter(F.col(label_col).isNotNull())
    seen = seen.groupBy(F.col("doc_id").alias("id")).agg(F.max(label_col).alias("label"))
    n, ones = seen.agg(F.count("*"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    prior = ((ones or 0) + 0.5) / ((n or 0) + 1)
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    chosen = _bounded(seen.filter("label = 1").select("id"), how.positives, 1)
    # at most Training.positives ids, so the texts need not be shuffled
    positive = texts.join(F.broadcast(chosen), "id").select("text", F.lit(1).alias("kind"))
    sample = positive.union(_bounded(texts, how.unlabelled, 2).select("text", F.lit(0).alias("kind")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [sorted(features(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.binary()))], names=["kind", "seen"])

    found = sample.mapInArrow(read, "kind int, seen array<binary>")
    n_p, n_u = (sample.filter(F.col("kind") == k).count() for k in (1, 0))
    counts = found.select("kind", F.explode("seen").alias("f")).groupBy("f").agg(
        F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    all_rate = (F.col("p") + F.col("u")) / max(1, n_p + n_u)
    gap = F.col("p") / max(1, n_p) - F.col("u") / max(1, n_u)
    chi = gap * gap / (all_rate * (1 - all_rate) * (1 / max(1, n_p) + 1 / max(1, n_u)) + 1e-300)
    kept = (counts.filter((F.col("p") + F.col("u") >= how.least_rows) & (chi >= how.evidence))
            .orderBy(F.desc(chi), "f").limit(how.vocabulary).collect())
    names = [bytes(r.f) for r in kept]
    place = {f: i for i, f in enumerate(names)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [sorted(place[f] for f in features(t.as_py() or "") & place.keys()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["kind", "at"])

    rows = [(r.kind, r.at) for r in sample.mapInArrow(index, "kind int, at array<int>").toLocalIterator()]
    positives, others = [a for k, a in rows if k == 1], [a for k, a in rows if k == 0]
    if not positives or not others:
        return Model(float(np.log(prior / (1 - prior))), {}, prior)
    positives.sort(), others.sort()  # the order of the tasks must not matter
    bias, weights = minimise(positives, others, len(names), prior, how)
    return Model(bias, {f: float(x) for f, x in zip(names, weights, strict=True) if x}, prior)


def scored(docs: DataFrame, model: Model, features: Features, out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, from the whole text of every row; NULL text counts as empty.

    A column of ``docs`` that has the name ``out`` is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() != out.lower()])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(features(t.as_py() or "")) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).cast("double").alias(out)).schema)
