"""Quality scores from pairwise preferences (Bradley-Terry).

Each labelled good document is preferred to labelled poor ones; the strength of a document is linear in features of its
text, and the weights minimise the logistic loss on feature differences of the preference pairs (Newton steps with a small
ridge). The threshold is a quantile of the training scores, chosen where it separates the labels best.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import NOT_SPACE, Words

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "digits", "symbols", "bangs", "pipes", "stops", "commas", "distinct", "repeats",
    "alternate", "lines", "same_lines", "symbol_ends", "capital_words", "non_ascii", "top_word", "distinct_pairs",
)
_CLASS = {
    "upper": [*range(0x41, 0x5B)], "digits": [*range(0x30, 0x3A)], "symbols": [c for c in range(0x21, 0x7F) if chr(c) in "#$%&*+<=>@[\\]^_`{}~"], "bangs": [0x21, 0x3F],
    "pipes": [0x7C, 0x2F], "stops": [0x2E], "commas": [0x2C, 0x3B, 0x3A], "lines": [0x0A], "non_ascii": [*range(0x80, 0x100)],
}


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    words = Words(texts, NOT_SPACE, lower=False)
    raw, off, first = words.raw, words.offsets, words.first
    rows, size, n = len(off) - 1, np.maximum(np.diff(off), 1), np.maximum(np.diff(first), 1)
    f = {"log_words": np.log1p(np.diff(first))}
    length = words.ends - words.starts
    f["mean_word"] = _per_row(length, first) / n
    f["long_words"] = _per_row(length > 15, first) / n
    for name, members in _CLASS.items():
        table = np.zeros(256, bool)
        table[members] = True
        f[name] = _per_row(table[raw], off) / size
    lowered = Words(texts, NOT_SPACE)
    h = lowered.hashes()
    f["repeats"] = _per_row(np.append(False, (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])) if len(h) else h, first) / n
    f["alternate"] = _per_row(np.concatenate([[False] * min(2, len(h)), (h[2:] == h[:-2]) & (words.row[2:] == words.row[:-2])]) if len(h) else h, first) / n

    def distinct(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, row))
        v, r = values[order], row[order]
        new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])) if len(v) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        most = np.zeros(rows)
        np.maximum.at(most, r[at], np.diff(np.append(at, len(v))))
        return np.bincount(r[at], minlength=rows), most

    kinds, most = distinct(h, words.row)
    f["distinct"], f["top_word"] = kinds / np.sqrt(n), most / n
    pairs = h[1:] * np.uint64(3) + h[:-1] if len(h) else h
    same = words.row[1:] == words.row[:-1]
    f["distinct_pairs"] = distinct(pairs[same], words.row[1:][same])[0] / n if len(h) else np.zeros(rows)
    line = Words(texts, np.arange(256) != 0x0A, lower=False)
    f["same_lines"] = 1 - distinct(line.hashes(), line.row)[0] / np.maximum(np.diff(line.first), 1)
    f["same_lines"][np.diff(line.first) == 0] = 0
    ends = raw[words.ends - 1] if len(h) else raw[:0]
    table = np.zeros(256, bool)
    table[_CLASS["symbols"] + [0x21, 0x7C]] = True
    f["symbol_ends"] = _per_row(table[ends], first) / n
    start = raw[words.starts] if len(h) else raw[:0]
    f["capital_words"] = _per_row((start >= 0x41) & (start <= 0x5A), first) / n
    return np.stack([f[k] for k in FEATURES], axis=1).astype(float)


class Model:
    """Standardised linear strengths, the threshold, and a scale that maps the threshold to ``at``."""

    def __init__(self, x: np.ndarray, y: np.ndarray, at: float, pairs_each: int, seed: int = 7):
        self.at, self.mean = at, x.mean(axis=0) if len(x) else np.zeros(len(FEATURES))
        self.scale = np.maximum(x.std(axis=0), 1e-6) if len(x) else np.ones(len(FEATURES))
        self.weights, self.threshold, self.spread = np.zeros(len(FEATURES)), -1.0, 1.0
        good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(poor):
            rng = np.random.default_rng(seed)
            z = self._z(x)
            count = pairs_each * max(len(good), len(poor))
            d = z[rng.choice(good, count)] - z[rng.choice(poor, count)]  # preference pairs: good over poor
            w = np.zeros(d.shape[1])
            for _ in range(30):
                p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the model takes the poor one
                step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / count + 1e-3 * np.eye(len(w)), d.T @ p / count - 1e-3 * w)
                w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
                if np.abs(step).max() < 1e-6:
                    break
            self.weights = w
            s = z @ w
            quantiles = np.unique(np.quantile(s, np.linspace(0.0, 1.0, 1001)))
            right = [((s >= q) == (y == 1)).mean() for q in quantiles]
            best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
            self.threshold = quantiles[best[0]]
            self.spread = max(float(s.std()), 1e-6)
        elif len(poor):
            self.threshold = 1.0

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ``at`` where the strength equals the threshold."""
        s = (self._z(x) @ self.weights - self.threshold) / self.spread * 2 + np.log(self.at / (1 - self.at))
        return np.clip(1 / (1 + np.exp(-np.clip(s, -500, 500))), 0.0, 1.0)


def _features(batches):
    for whole in batches:
        for part in text_slices(whole):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def _score(batches, model: Model):
    for whole in batches:
        for part in text_slices(whole):
            s = model.score(features(part.column("text")))
            predicted = np.where((s >= model.at), 1, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array(predicted)], ["doc_id", "held_out", "score", "predicted"])


def held_out(doc_id, folds: int):
    """Whether crc32 of the id as text leaves the remainder 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learn(documents: DataFrame, labels: DataFrame, at: float = 0.3, most_rows: int = 20_000, pairs_each: int = 4, folds: int = 5) -> Model:
    """Fit on the labelled rows that are not held out: the ``most_rows`` with the smallest hashes of the id, whose ids alone are broadcast.

    Null labels and ids teach nothing; of repeated label rows the smallest label counts. With one label only, every text gets
    that label.
    """
    ids = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    got = rows.mapInArrow(_features, "quality int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), int)
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, int)  # the same model whatever order the rows come in
    return Model(x[order], y[order], at, pairs_each)


def score(documents: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text (doc_id, text); null and empty texts are scored on zero features."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), "text")
    return docs.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int")
