"""Text quality by Bradley-Terry ranking.

A document's strength is a linear function of features of its whole text. It is learned from
preference pairs (a document labeled 1 is preferred to one labeled 0) by logistic loss on the
difference of their features. The cut is a quantile of the training scores: the share of
documents labeled 0. Scores are the logistic of the strength, shifted so that the cut gets
`threshold`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.shingles import texts, word_hashes
from docstruct.llm.store import written
from docstruct.llm.words import ALL_STOP_WORDS

MAX_TRAINING = 20_000
MAX_PAIRS = 200_000
SYMBOLS = "%&$#*!|=<>@\"'.,;:-_/()"

_KIND = np.zeros(256, np.int64)  # 0 others, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 beyond ASCII, then SYMBOLS
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 6
for _i, _c in enumerate(SYMBOLS):
    _KIND[ord(_c)] = 7 + _i
KINDS = 7 + len(SYMBOLS)
FEATURES = KINDS + 9


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights - self.cut
        return 1 / (1 + np.exp(-(strength + np.log(self.threshold / (1 - self.threshold))).clip(-30, 30)))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<float>) per row: shares of character kinds, of stop words, of repeated
    words and lines, and lengths. A null text counts as empty and has features as well."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_features(sorted(ALL_STOP_WORDS)), "id bigint, x array<double>")


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.7, max_pairs: int = MAX_PAIRS, ridge: float = 1e-3, steps: int = 60, seed: int = 7) -> Ranking:
    """Fit on features and labels. With one label only there are no pairs: all strengths are 0."""
    mean = x.mean(0) if len(x) else np.zeros(FEATURES)
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(FEATURES)
    z = ((x - mean) / scale).clip(-8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(FEATURES)
    if len(good) and len(bad):
        if len(good) * len(bad) <= max_pairs:
            i, j = np.repeat(good, len(bad)), np.tile(bad, len(good))
        else:
            rng = np.random.default_rng(seed)
            i, j = rng.choice(good, max_pairs), rng.choice(bad, max_pairs)
        d = z[i] - z[j]
        for _ in range(steps):  # Newton steps on mean log(1 + exp(-d w)) + ridge |w|^2 / 2
            p = 1 / (1 + np.exp((d @ weights).clip(-30, 30)))
            gradient = -(d * p[:, None]).mean(0) + ridge * weights
            hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(FEATURES)
            step = np.linalg.solve(hessian, gradient)
            weights -= step
            if np.abs(step).max() < 1e-8:
                break
    strength = z @ weights
    cut = float(np.quantile(strength, len(bad) / len(y))) if len(y) and len(good) and len(bad) else 0.0
    return Ranking(weights, mean, scale, cut, threshold)


def scored(
    docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.7, max_training: int = MAX_TRAINING,
) -> DataFrame:
    """One row per row of *docs*: id, held_out, score, predicted (1 if score >= threshold).

    Learns from at most *max_training* labeled documents (the first by hash of the identifier)
    for which *held_out*, an expression over the identifier, is not true; it decides nothing else.
    Every row gets a score, with an empty or null text too. A document with two labels trains
    nothing, nor does a label without document or a null label. Rows that repeat an identifier are
    scored each; a null identifier is not held out. An empty table gives an empty result, and
    without labels of both kinds all scores are *threshold*.
    """
    table = written(features(docs, id_col, text_col), "quality-features")
    own = labels.select(F.col(id_col).cast("bigint").alias(id_col), F.col(label_col).alias("y")).where(f"{id_col} IS NOT NULL AND y IN (0, 1)")
    own = own.where(~F.coalesce(held_out, F.lit(False))).groupBy(id_col).agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most")
    own = own.orderBy(F.xxhash64(id_col), id_col).limit(max_training).select(F.col(id_col).alias("id"), "y")
    # At most max_training rows of two numbers: a proven bound.
    sample = table.join(F.broadcast(own), "id").dropDuplicates(["id"]).orderBy("id").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    model = fit(x, np.array(sample.column("y").to_pylist(), np.int64), threshold)
    out = table.mapInArrow(_score(model), "id bigint, score double").withColumnRenamed("id", id_col)
    return out.select(
        id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    )


def _score(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], ["id", "score"])

    return run


def _features(stop_words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = pa.array([" ".join(stop_words)])
        stops = np.unique(np.concatenate([word_hashes(d, o)[0] for _, d, o in texts(joined)]))
        for batch in batches:
            x = np.zeros((batch.num_rows, FEATURES))
            for row, data, offsets in texts(batch.column("text")):
                hashes, first = word_hashes(data, offsets)
                is_stop = np.isin(hashes, stops)
                kinds = _KIND[data]
                for i in range(len(offsets) - 1):
                    a, b, w, v = offsets[i], offsets[i + 1], first[i], first[i + 1]
                    n, m = int(b - a), int(v - w)
                    if not n:
                        continue
                    out = x[row + i]
                    counts = np.bincount(kinds[a:b], minlength=KINDS)
                    out[:KINDS] = counts / n
                    lines = int(counts[5]) + 1
                    letters = counts[1] + counts[2] + counts[6]
                    different = len(np.unique(hashes[w:v]))
                    out[KINDS:] = (
                        np.log1p(n), np.log1p(m), n / (m + 1), is_stop[w:v].mean() if m else 0.0, different / max(m, 1) ** 0.8,
                        m / lines, letters / n, counts[2] / (counts[1] + counts[2] + 1), counts[7:].sum() / (m + 1),
                    )
            flat = pa.array(x.reshape(-1))
            ends = pa.array(np.arange(batch.num_rows + 1) * FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, flat)], ["id", "x"])

    return run
