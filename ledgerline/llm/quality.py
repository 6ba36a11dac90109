"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are described by style features of the whole text.  A
logistic model minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; the class prior is the least ratio of the
unlabelled to the positive share above a score threshold of a first fit.

All documents are unlabelled text: means and spreads, the counts behind the prior and every step on the
risk are sums over their features, which are written once.  A first fit on a bounded sample gives the
scores along which the prior is counted and the point that the steps begin at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, save

#: Bound of the trusted positives that the model is fitted on.
MAX_POSITIVE = 4_000
#: Bound of the unlabelled documents of the first fit; the model itself is fitted on all.
MAX_FIRST = 8_000
#: Steps on the risk over all documents, at most, and the lengths tried of each.
STEPS, LENGTHS = 12, (1.0, 0.5, 0.25, 0.125, 0.03, 0.0)
#: Standardised features are clipped there.
CLIP = 12
SYMBOLS = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"
N_FEATURES = 16 + len(SYMBOLS)


def features(text: str | None) -> np.ndarray:
    """Style features of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lower, upper, digit = count[97:123].sum(), count[65:91].sum(), count[48:58].sum()
    high = count[0xC2:].sum()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    distinct = len(set(words))
    letters = max(1, lower + upper + high)
    symbols = np.array([count[ord(c)] for c in SYMBOLS])
    style = [
        np.log1p(len(words)),
        distinct / n,
        distinct / np.sqrt(n),
        again / n,
        pairs / n,
        len(set(lines)) / len(lines),
        upper / letters,
        np.sqrt(upper / letters),
        digit / chars,
        np.sqrt(symbols.sum() / n),
        high / letters,
        count[46] / n,
        count[44] / n,
        len(text) / n / 10,
        len(lines) / n,
        float(not words),
    ]
    return np.concatenate([style, np.sqrt(symbols / n)])


def _features_of(docs: DataFrame, keys: str) -> DataFrame:
    """keys (a schema of columns to keep) and `features`."""
    kept = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            rows = [features(t) for t in batch.column("text").to_pylist()]
            made = pa.array([r.tolist() for r in rows], pa.list_(pa.float32()))
            yield pa.record_batch([*(batch.column(k) for k in kept), made], names=[*kept, "features"])

    return docs.select(*kept, "text").mapInArrow(run, f"{keys}, features array<float>")


def _total(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of of(x), flat arrays, over blocks x of all features: added up in each task, then place by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(np.asarray(batch.column(0).flatten(), float).reshape(-1, N_FEATURES))
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["place", "x"])

    sums = rows.select("features").mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    return np.array([r.x for r in sums.orderBy("place").collect()])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05):
    """Adam on the non-negative risk with logistic loss; gradients turn back where the bound is met.

    Weights decay the more, the fewer positives there are.
    """
    decay = 0.25 / max(1, len(p))
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    p, u = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        plus = prior * (p.T @ (sp - 1)) / len(p)
        minus = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g = (plus + minus if risk >= 0 else -minus) + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _cuts(positive: np.ndarray, share: float = 0.4) -> np.ndarray:
    """Thresholds with at least this share of the positives above them."""
    return np.quantile(positive, np.linspace(0, 1 - share, 100))


def _prior(positive: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> float:
    """The class prior from positive scores and the counts of n unlabelled ones at or above each cut.

    It is the least ratio of the unlabelled to the positive share above a cut, as an upper bound: every true ratio is
    at least the prior.  Each measured one is raised by one and a half standard errors: of too low a prior trusted
    documents would pay, of too high a one little changes.
    """
    best = 0.98
    for cut, u in zip(cuts, above, strict=True):
        p = (positive >= cut).sum()
        if u and p:
            best = min(best, (u / n) / (p / len(positive)) * (1 + 1.5 * np.sqrt(1 / u + 1 / p)))
    return float(max(best, 0.05))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from scores of both kinds; see _prior()."""
    cuts = _cuts(positive)
    return _prior(positive, cuts, np.array([(unlabelled >= c).sum() for c in cuts]), len(unlabelled))


def _minimise(total: Callable, n: int, p: np.ndarray, prior: float, w: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of the least non-negative risk over n unlabelled rows, from w; total(of) sums of(x) over them.

    With logistic loss the unbiased risk is convex, so Newton's step is at hand; where it would bring the unlabelled part
    below zero, its gradient counts less (by a factor from 0 to 1), so that the step ends on the bound.  The length is
    the best of LENGTHS; steps end when none lowers the risk.
    """
    k = p.shape[1]
    decay = 0.25 / len(p) * np.r_[np.ones(k - 1), 0]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def slopes(x: np.ndarray) -> np.ndarray:
        z = x @ w
        s = sigmoid(z)
        return np.r_[np.logaddexp(0, z).sum(), s @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()]

    for _ in range(steps):
        sums = total(slopes) / n
        pull = sums[1 : k + 1]
        part = sums[0] - prior * np.logaddexp(0, p @ w).mean()
        part_slope = pull - prior * (sigmoid(p @ w) @ p) / len(p)
        slope = pull - prior * p.mean(axis=0) + decay * w
        bend = sums[k + 1 :].reshape(k, k) + np.diag(decay + 1e-9)
        a, b = np.linalg.solve(bend, slope), np.linalg.solve(bend, part_slope)
        less = np.clip((part_slope @ a - part) / max(part_slope @ b, 1e-12), 0, 1)
        tried = np.array([w - t * (a - less * b) for t in LENGTHS])
        soft = total(lambda x, tried=tried: np.logaddexp(0, x @ tried.T).sum(axis=0)) / n
        parts = soft - prior * np.logaddexp(0, p @ tried.T).mean(axis=0)
        risks = prior * np.logaddexp(0, -(p @ tried.T)).mean(axis=0) + np.maximum(parts, 0) + tried**2 @ decay / 2
        best = int(np.argmin(risks))
        w = tried[best]
        if risks[-1] - risks[best] < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_first: int = MAX_FIRST) -> Model:
    """Fit from docs(doc_id, text) and trusted labels(doc_id, quality).

    Positives are documents with quality 1 in every label row, of which those of smallest hash, at most max_positive,
    are used.  All documents are the unlabelled text, also those without id.  Without either kind of rows the model
    scores everything 0.5.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    rank = F.abs(F.xxhash64(F.col("doc_id"), F.lit(5)) % 1_000_000)
    rows = save(_features_of(docs.select(rank.alias("rank"), "doc_id", "text"), "rank long, doc_id long"), "features")

    def least(n: int, bound: int) -> Column:
        """Ranks that hold the bound and a margin, or all."""
        return F.col("rank") < min(1_000_000, int(1_000_000 * (1.2 * bound + 200) / max(n, 1)))

    def chosen(frame: DataFrame, bound: int) -> np.ndarray:
        found = frame.orderBy("rank", "doc_id").limit(bound).select("features").toPandas()["features"]
        return np.array(found.tolist(), float).reshape(-1, N_FEATURES)

    n, n_good = rows.count(), good.count()
    some_good = good.withColumn("rank", rank).filter(least(n_good, max_positive)).select("doc_id")
    positive = chosen(rows.filter(least(n_good, max_positive)).join(some_good, "doc_id", "left_semi"), max_positive)
    if not len(positive):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    sums = _total(rows, lambda x: np.r_[x.sum(axis=0), (x * x).sum(axis=0)]) / n
    mean = sums[:N_FEATURES]
    scale = np.maximum(np.sqrt(np.maximum(sums[N_FEATURES:] - mean**2, 0)), 1e-6)
    even = lambda x: np.c_[np.clip((x - mean) / scale, -CLIP, CLIP), np.ones(len(x))]
    total = lambda of: _total(rows, lambda x: of(even(x)))
    p, some = even(positive), even(chosen(rows.filter(least(n, max_first)), max_first))
    first = _descend(p[:, :-1], some[:, :-1], 0.5)
    cuts = _cuts(p @ first)
    above = total(lambda x: ((x @ first)[:, None] >= cuts).sum(axis=0).astype(float))
    prior = _prior(p @ first, cuts, above, n)
    w = _minimise(total, n, p, prior, _descend(p[:, :-1], some[:, :-1], prior))
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of docs(doc_id, text).

    Null and empty texts get the score of an empty text; rows with equal or null doc_id are
    scored one by one; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = batch.column(1).to_pylist()
            s = model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES))
            made = [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.record_batch(made, names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score() predicts 1, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
