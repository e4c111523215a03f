"""Operator 1: a quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a logistic score that minimises the
non-negative unbiased risk ``pi R_p(+) + max(0, R_u(-) - pi R_p(-))`` (when the
difference is negative, the step ascends it instead). The class prior ``pi`` comes from
positives and unlabelled texts alone: a classifier that tells them apart orders the
texts, and the prior is the least ratio of the unlabelled to the positive share above a
threshold (best-bin estimation: where only positives score, unlabelled texts hold ``pi``
times as many). Every gradient step sums over all training rows on the executors; only
vectors of the number of features, or of bins, reach the driver.

Features come from the text alone. A null or empty text has zero counts and is
scored like any other, however long a text is. One row per input row; only id and text
are read, rows equal in text score alike, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textkernel import chunks, lowered_words, shingle_hashes, words

N_FEATURES = 20
BINS = 1000  # of the score, for the prior


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: values and distinct values."""
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d, minlength=n).astype(float), np.bincount(d[new], minlength=n).astype(float)


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_SYMBOL, _MARK, _STOP, _HIGH = _class(b"#*$%&|<>"), _class(b"!?"), _class(b".,;:"), _class(bytes(range(128, 256)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, N_FEATURES) array of shares and logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, wdoc = words(data, offsets)
    n_words = np.bincount(wdoc, minlength=n).astype(float)
    w1, c1 = np.maximum(n_words, 1), np.maximum(size, 1)
    h, d = lowered_words(data, offsets)
    _, uniq = _distinct(h, d, n)
    g3, d3 = shingle_hashes(h, d, 3)
    all3, uniq3 = _distinct(g3, d3, n)
    count = {k: _per_doc(t[data], offsets) for k, t in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("mark", _MARK), ("stop", _STOP), ("high", _HIGH))}
    last, first = (data[ends - 1], data[starts]) if len(starts) else (data[:0], data[:0])
    by_word = lambda flags: np.bincount(wdoc, flags.astype(float), minlength=n)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    length = (ends - starts).astype(float)
    mean = by_word(length) / w1
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.minimum(mean, 40) / 10, np.sqrt(np.maximum(by_word(length**2) / w1 - mean**2, 0)).clip(0, 40) / 10,
        count["upper"] / letters, np.log1p(20 * count["digit"] / c1), np.log1p(100 * count["symbol"] / w1), np.log1p(100 * count["mark"] / w1),
        count["stop"] / w1, count["high"] / c1, uniq / w1, 1 - uniq3 / np.maximum(all3, 1),
        by_word(_SYMBOL[last]) / w1, by_word(_MARK[last]) / w1, by_word(_UPPER[first]) / w1, by_word(length == 1) / w1,
        (size == 0).astype(float), np.log1p(_per_doc(data == 10, offsets)) / np.log1p(size + 2), (count["symbol"] > 5).astype(float), (1 - uniq3 / np.maximum(all3, 1) > 0.3).astype(float),
    ])


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its feature array, materialised."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch, 1):
                x = features(data, offsets)
                flat = pa.array(x.ravel(), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind}, x array<double>")
    return materialise(out, "quality-features")


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _sums(df: DataFrame, part, width: int) -> np.ndarray:
    """Sum over all rows of the vector that ``part`` makes of each batch; one row per task reaches the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "v": pa.array(total)})

    got = df.mapInArrow(rows, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in got:
        out[r.k] = r.v
    return out


def _scales(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all rows."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])

    m = _sums(train, moments, 2 * N_FEATURES + 1)
    n = max(m[0], 1.0)
    mean = m[1 : N_FEATURES + 1] / n
    return mean, np.sqrt(np.maximum(m[N_FEATURES + 1 :] / n - mean**2, 1e-6))


def _design(batch: pa.RecordBatch, mean: np.ndarray, dev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled features with a constant first, and which rows are trusted positives."""
    x = np.clip((_matrix(batch) - mean) / dev, -6, 6)
    return np.column_stack([np.ones(len(x)), x]), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)


def order(train: DataFrame, steps: int = 10, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations) of a plain logistic fit of positives against all texts, half the weight each, by Newton steps.

    No prior enters it, so that it can order texts for an estimate of one.
    """
    d = N_FEATURES + 1
    mean, dev = _scales(train)
    w = np.zeros(d)
    for _ in range(steps):

        def parts(batch: pa.RecordBatch, now: np.ndarray = w) -> np.ndarray:
            x, pos = _design(batch, mean, dev)
            p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
            curve = lambda x, p: ((x * (p * (1 - p))[:, None]).T @ x).ravel()
            return np.concatenate([[len(x), pos.sum()], p @ x, (p[pos] - 1) @ x[pos], curve(x, p), curve(x[pos], p[pos])])

        g = _sums(train, parts, 2 + 2 * d + 2 * d * d)
        n_u, n_p = 2 * max(g[0], 1), 2 * max(g[1], 1)
        ridge = l2 * np.concatenate([[1e-3], np.ones(d - 1)])
        slope = g[2 : 2 + d] / n_u + g[2 + d : 2 + 2 * d] / n_p + ridge * w
        curve = (g[2 + 2 * d : 2 + 2 * d + d * d] / n_u + g[2 + 2 * d + d * d :] / n_p).reshape(d, d)
        step = np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-3:
            break
    return w, mean, dev


def fit(train: DataFrame, prior: float, steps: int = 40, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, deviations) from rows (x, positive); every row is unlabelled text, positives count in both roles."""
    d = N_FEATURES
    mean, dev = _scales(train)
    w = np.zeros(d + 1)
    w[0] = np.log(prior / (1 - prior))
    avg, sq = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        now = w.copy()

        def gradients(batch: pa.RecordBatch, now: np.ndarray = now) -> np.ndarray:
            x, pos = _design(batch, mean, dev)
            z = np.clip(x @ now, -30, 30)
            p = 1 / (1 + np.exp(-z))  # derivative of log(1+e^z); of log(1+e^-z) it is p-1
            loss_minus = np.logaddexp(0, z)
            return np.concatenate([[len(x), pos.sum(), loss_minus.sum(), loss_minus[pos].sum()], p @ x, p[pos] @ x[pos], (p[pos] - 1) @ x[pos]])

        g = _sums(train, gradients, 4 + 3 * (d + 1))
        n_u, n_p = max(g[0], 1), max(g[1], 1)
        u_minus, p_minus, p_plus = g[4 : 5 + d] / n_u, g[5 + d : 6 + 2 * d] / n_p, g[6 + 2 * d :] / n_p
        gap = g[2] / n_u - prior * g[3] / n_p
        grad = prior * p_plus + u_minus - prior * p_minus if gap >= 0 else prior * p_minus - u_minus
        grad = grad + l2 * np.concatenate([[0], w[1:]])
        avg, sq = 0.9 * avg + 0.1 * grad, 0.99 * sq + 0.01 * grad**2
        w = w - rate * (avg / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.99**step)) + 1e-8)
    return w, mean, dev


def score(table: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and its score in 0..1."""
    w, mean, dev = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip((_matrix(batch) - mean) / dev, -6, 6)
            z = np.clip(w[0] + x @ w[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.select("doc_id", "x").mapInArrow(rows, f"doc_id {kind}, score double")


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The prior from counts by descending score: the least upper bound of unlabelled share / positive share over the bins."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 0.5
    q_p, q_u = np.cumsum(positive) / n_p, np.cumsum(unlabelled) / n_u
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    some = q_p > 0
    at = np.flatnonzero(some)[np.argmin((q_u[some] + slack) / q_p[some])]
    return float(np.clip(q_u[at] / q_p[at], 0.01, 0.99))


def class_prior(train: DataFrame) -> float:
    """The share of positives among the texts of ``train`` (x, positive), from positives and unlabelled texts alone."""
    w, mean, dev = order(train)

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        x, pos = _design(batch, mean, dev)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        at = np.minimum(((1 - p) * BINS).astype(np.int64), BINS - 1)
        return np.concatenate([np.bincount(at[pos], minlength=BINS), np.bincount(at, minlength=BINS)]).astype(float)

    found = _sums(train, counts, 2 * BINS)
    return best_bin(found[:BINS], found[BINS:])


def classify(docs: DataFrame, labels: DataFrame, may_train: str, steps: int = 40) -> DataFrame:
    """doc_id and score of every document. ``may_train`` is an SQL condition on doc_id: rows whose labels may be learned from.

    ``labels`` has doc_id and quality; a document rated more than once counts by its
    mean rating, a null rating not at all. Only good ratings are used: all other texts
    are unlabelled. Without a positive the prior is a half.
    """
    table = feature_table(docs)
    rated = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(may_train).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("positive"))
    train = table.where(may_train).join(rated.where("positive"), "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    train = materialise(train, "quality-train")
    return score(table, fit(train, class_prior(train), steps))
