"""Quality classifier by Bradley-Terry pairwise ranking.

P(a is preferred to b) = sigmoid(w . (features(a) - features(b))). Preference
pairs put a text of label 1 before one of label 0; w minimises the logistic
loss of their feature differences. The threshold is a quantile of the scores of
the texts learned from: the share of label 0 among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import kernels
from .sampling import held_out, training_ids

#: Most labelled texts whose features are fetched to learn from; every pair of them counts.
MAX_LABELLED = 8000
CUT = 0.3

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!", "?", "*", "%", "$", "#", "&", "|", "@", "<>", "{}[]()\\=;", "\"'", "-_+/~^`:"]
_CLASS = np.full(256, len(_CLASSES), np.int64)  # bytes of other characters
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars.encode())] = _i
_N = len(_CLASSES) + 1
FEATURES = [f"share of {c[:3]!r}" for c in [*_CLASSES, "other"]] + ["log words", "word length", "distinct words", "top word", "repeated lines", "line length", "capital words", "long words", "is empty"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a slice; an empty text has zeros and "is empty"."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((rows, len(FEATURES)))
    out[:, -1] = size == 0
    if not len(data):
        return out
    owner = np.repeat(np.arange(rows), size)
    shares = np.bincount(owner * _N + _CLASS[data], minlength=rows * _N).reshape(rows, _N) / np.maximum(size, 1)[:, None]
    out[:, :_N] = np.sqrt(shares)
    start, end, row = kernels.words(data, offsets)
    n = np.bincount(row, minlength=rows)
    some = np.maximum(n, 1)
    sums = kernels.prefix_hash(data, True)
    r, _, times = kernels.counted(row, kernels.spans(sums, start, end))
    top = np.zeros(rows)
    np.maximum.at(top, r, times)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    letters = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
    capital = (upper[end] - upper[start] > 1) & (upper[end] - upper[start] == letters[end] - letters[start])
    lines = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][size > 0])
    lines = lines[lines < len(data)]
    stop = np.append(lines[1:], len(data))
    of = np.searchsorted(offsets, lines, "right") - 1
    _, _, line_times = (lr := kernels.counted(of, kernels.spans(sums, lines, stop)))
    n_lines = np.maximum(np.bincount(of, minlength=rows), 1)
    out[:, _N] = np.log1p(n)
    out[:, _N + 1] = np.log1p(np.bincount(row, end - start, minlength=rows) / some)
    out[:, _N + 2] = np.bincount(r, minlength=rows) / some**0.8
    out[:, _N + 3] = np.sqrt(top / some)
    out[:, _N + 4] = np.bincount(lr[0], line_times - 1, minlength=rows) / n_lines
    out[:, _N + 5] = np.log1p(size / n_lines)
    out[:, _N + 6] = np.bincount(row, capital, minlength=rows) / some
    out[:, _N + 7] = np.bincount(row, (end - start) > 24, minlength=rows) / some
    return out


def feature_rows(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, x: the features as an array of doubles."""
    ship(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in kernels.slices(batch.column("text")):
                x = features(data, offsets)
                own = batch.slice(at, end - at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), flat], [*keep, "x"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, x array<double>")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, ridge: float = 1 / 60_000, block: int = 500) -> QualityModel:
    """Strengths from all preference pairs (label 1 before label 0): Newton steps on their mean loss, with a ridge penalty.

    Sums over pairs are taken in blocks of texts of label 1, as products of the
    block's features, its table of probabilities and the features of label 0.
    With labels of one class only there are no pairs: every score is the same.
    """
    mean, scale = x.mean(0) if len(x) else np.zeros(len(FEATURES)), x.std(0) if len(x) else np.ones(len(FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(len(mean)), 0.0 if len(bad) else -10.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    zg, zb = z[good], z[bad]
    pairs, w = len(good) * len(bad), np.zeros(z.shape[1])
    for _ in range(50):
        slope, bend = ridge * w, ridge * np.eye(len(w))
        below = zb @ w
        for at in range(0, len(zg), block):
            own = zg[at : at + block]
            p = 1 / (1 + np.exp(-np.clip((own @ w)[:, None] - below, -30, 30)))
            v = p * (1 - p)
            slope = slope + (own.T @ (p - 1).sum(1) - zb.T @ (p - 1).sum(0)) / pairs
            mixed = own.T @ v @ zb
            bend = bend + ((own.T * v.sum(1)) @ own + (zb.T * v.sum(0)) @ zb - mixed - mixed.T) / pairs
        move = np.linalg.solve(bend, slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    strength = ((x - mean) / scale) @ w
    threshold = float(np.quantile(strength, len(bad) / len(y)))
    spread = np.quantile(strength[good], 0.5) - np.quantile(strength[bad], 0.5)
    return QualityModel(mean, scale, w, threshold, float(6 / max(spread, 1e-6)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """A model from the features of at most max_labelled texts of the training folds."""
    ids = F.broadcast(training_ids(labels, "quality", max_labelled))
    rows = sorted(feature_rows(docs.select("doc_id", "text").join(ids, "doc_id"), ["doc_id", "label"]).collect(), key=lambda r: (r.doc_id, r.x))
    return fit_bradley_terry(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out (false for a null id), score, predicted.

    Null texts count as empty; these get a score like any other text. Equal
    texts have equal scores; repeated rows are scored one by one.
    """
    ship(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in kernels.slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), pa.array(model.score(features(data, offsets)))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
