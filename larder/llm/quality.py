"""Quality classifier learned from trusted positives and unlabelled text.

Every text becomes a short vector of shares and rates. A logistic model minimises the non-negative
unbiased risk of positive-unlabelled learning: the risk of the positives, plus what the unlabelled text
costs as negatives beyond the positives hidden in it, where that difference may not fall below zero.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage

#: Rows of either kind a model is fitted on, those with the smallest hashes; statistics need no more.
FIT_ROWS = 20_000
THRESHOLD = 0.7
STEPS = 600
RATE = 0.05
RIDGE = 1e-4

_SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)  # 0 other control, then one class per kind of byte
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
_CLASS[list(_SYMBOLS)] = 7 + np.arange(len(_SYMBOLS))
_KINDS = 7 + len(_SYMBOLS)
_ODD = np.isin(np.arange(256), list(b"!#$%&*|<>=~^{}[]\\@_+"))
_UPPER = _CLASS == 2
#: Lines shorter than this say little about themselves.
_LINE_BYTES = 40
N_FEATURES = _KINDS + 14


def features(text: str) -> np.ndarray:
    """Shares of byte classes, word and line statistics, and the worst line's; zeros without text."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    if not n:
        return out
    out[:_KINDS] = np.sqrt(np.bincount(_CLASS[raw], minlength=_KINDS) / n)
    words = text.split()
    k = len(words)
    rest = out[_KINDS:]
    rest[0] = np.log1p(n) / 10
    if k:
        counts = Counter(words)
        rest[1] = min(n / k, 50) / 10
        rest[2] = len(counts) / k
        rest[3] = np.sqrt(max(counts.values()) / k)
        rest[4] = sum(map(str.__eq__, words, words[1:])) / k
        rest[5] = np.log1p(k / len(counts))
    lines = [x for x in text.split("\n") if x]
    if lines:
        rest[6] = len(set(lines)) / len(lines)
        rest[7] = np.log1p(k / len(lines)) / 10
    ends = np.append(np.flatnonzero(raw == 10), n)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts
    long = sizes >= min(_LINE_BYTES, int(sizes.max()))
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask[raw])[np.maximum(ends - 1, 0)]))
    upper, odd = sums(_UPPER), sums(_ODD)
    rest[8] = (upper[long] / np.maximum(sizes[long], 1)).max()
    rest[9] = (odd[long] / np.maximum(sizes[long], 1)).max()
    worst_distinct, worst_repeat = 1.0, 0.0
    for line in lines:
        if len(line) >= _LINE_BYTES:
            own = line.split()
            worst_distinct = min(worst_distinct, len(set(own)) / max(1, len(own)))
            worst_repeat = max(worst_repeat, sum(map(str.__eq__, own, own[1:])) / max(1, len(own)))
    rest[10], rest[11] = worst_distinct, worst_repeat
    rest[12] = (odd > 0.05 * np.maximum(sizes, 1))[long].mean()
    rest[13] = (upper > 0.3 * np.maximum(sizes, 1))[long].mean()
    return out


@dataclass(frozen=True)
class Model:
    """Weights over clipped, standardised features and their squares; None rejects nothing."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -5, 5)
        return np.hstack([z, z * z / 5, np.ones((len(z), 1))])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(rows))
        # Rounded, as the last digits of a product depend on how many rows are multiplied at once.
        return np.round(_sigmoid(self.inputs(rows) @ self.weights), 12)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Minimise prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) with Adam.

    Where the part in the maximum is negative, a step goes up its gradient instead, which undoes the
    overfit that made it so. Without positives, or with a prior of 1, there is nothing to reject.
    """
    if not len(positives) or not len(unlabelled) or prior >= 1:
        none = np.zeros(N_FEATURES)
        return Model(none, none + 1, None)
    blank = Model(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3, None)
    p, u = blank.inputs(positives), blank.inputs(unlabelled)
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)
        as_negative = -np.log(1 - gu + 1e-12).mean() + prior * np.log(1 - gp + 1e-12).mean()
        slope = u.T @ gu / len(u) - prior * (p.T @ gp) / len(p)
        step = prior * (p.T @ (gp - 1)) / len(p) + slope if as_negative >= 0 else -slope
        step += ridge * w
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(blank.mean, blank.scale, w)


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose labels are not learned from; a row without id is learned from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds == fold, F.lit(False))


def with_features(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, features) of every row."""
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.float32)
            starts = np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(starts, flat)], names=["doc_id", "features"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, features array<float>")


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` feature vectors: those whose ids have the smallest hashes."""
    drawn = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("features")).limit(most).select("features").toArrow()
    return drawn.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", label_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """The model for feature rows (doc_id, features) and a table of 0/1 labels, held-out rows left aside.

    A document with several labels counts as positive if all are 1; null labels are none. The class
    prior is the share of positives among the labelled rows less one standard error: a prior too high
    would take junk for hidden positives, one a little low only lowers scores.
    """
    known = labels.filter(~held_out(F.col(label_id)) & F.col(label).isNotNull() & F.col(label_id).isNotNull())
    known = known.groupBy(F.col(label_id).alias("doc_id")).agg(F.min(label).alias("label"))
    n, good = known.agg(F.count("*"), F.sum("label")).first()
    share = (good or 0) / max(1, n)
    prior = share - np.sqrt(share * (1 - share) / max(1, n))
    open_rows = rows.filter(~held_out(F.col("doc_id")))
    positives = open_rows.join(known.filter("label = 1").select("doc_id"), "doc_id", "left_semi")
    return fit(_sample(positives, fit_rows), _sample(open_rows, fit_rows), prior)


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Only the text enters a score. A null text is empty, and empty texts are scored like any other.
    Without a positive label, or without a negative one, nothing can be told apart and every score is 1.
    Repeated rows are scored each on its own. Labels of unknown documents only count for the prior.
    No documents give no rows. Other columns are not read.

    The model is fitted on at most ``fit_rows`` positives and as many unlabelled rows.
    """
    rows = stage(with_features(docs, text, id_column), "quality-features")
    model = learn(rows, labels, label, fit_rows=fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(matrix))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    Texts are scored again as they pass, row by row, so nothing is shuffled and ids need not be unique.
    """
    rows = stage(with_features(docs, text, id_column), "quality-features")
    model = learn(rows, labels)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        matrix = np.stack([features(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
        return pd.Series(model.scores(matrix))

    return docs.filter(score(F.coalesce(F.col(text), F.lit(""))) >= threshold)
