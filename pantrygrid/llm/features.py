"""Hashed byte n-gram features and the linear models over them.

A text's features are the counts of its hashed byte n-grams, divided by their number. A whole batch is scored at once:
every position of the buffer looks up the weight of the n-gram that starts there, and sums over rows are differences of
one running sum. Models are fitted on a bounded sample; its features are counted on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Hash bits and n-gram lengths of the features.
BITS, GRAMS = 12, (1, 2, 3)


def gram_codes(data: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """The hashed n-gram that starts at each position of data (those that would pass its end are hashed short)."""
    code = np.full(len(data), n, np.uint32)
    for k in range(n):
        part = np.zeros(len(data), np.uint32)
        part[: len(data) - k] = data[k:]
        code = (code * np.uint32(0x01000193)) ^ (part + np.uint32(1))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (code ^ (code >> np.uint32(12))) & np.uint32((1 << bits) - 1)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the rows that offsets bound."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def linear_scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, grams=GRAMS, bits: int = BITS) -> np.ndarray:
    """Rows by classes: mean weight of a row's n-grams (those that cross into the next row are left out). weights: (grams * 2 ** bits, classes)."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    length = np.diff(offsets)
    for g, n in enumerate(grams):
        code = gram_codes(data, n, bits)
        own = np.repeat(offsets[1:], length) - np.arange(len(data)) >= n
        for k in range(weights.shape[1]):
            out[:, k] += row_sums(np.where(own, weights[g << bits :, k][code], 0.0), offsets) / np.maximum(length - n + 1, 1)
    return out


def count_features(data: np.ndarray, grams=GRAMS, bits: int = BITS) -> np.ndarray:
    """The features of one text, as linear_scores weighs them."""
    out = np.zeros(len(grams) << bits, np.float32)
    for g, n in enumerate(grams):
        if len(data) >= n:
            code = gram_codes(data, n, bits)[: len(data) - n + 1]
            out[g << bits : (g + 1) << bits] = np.bincount(code, minlength=1 << bits) / len(code)
    return out


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and targets of a bounded sample (text, y array<double>), and which features the columns are: those that any row has. The caller bounds the rows."""

    def run(batches):
        for b in batches:
            data, at = shared.buffers(b.column(0))
            rows = [count_features(data[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            found = [np.flatnonzero(x).astype(np.int32) for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(rows, found)], pa.list_(pa.float32())), b.column(1)], names=["at", "x", "y"])

    got = sample.select("text", "y").mapInArrow(run, "at array<int>, x array<float>, y array<double>").toArrow()
    seen = np.zeros(len(GRAMS) << BITS, bool)
    for part in got.to_batches():
        seen[np.asarray(part["at"].flatten())] = True
    place = np.cumsum(seen) - 1
    x = np.zeros((len(got), int(seen.sum())), np.float32)
    row = 0
    for part in got.to_batches():
        size = np.diff(np.asarray(part["at"].offsets))
        x[row + np.repeat(np.arange(len(size)), size), place[np.asarray(part["at"].flatten())]] = np.asarray(part["x"].flatten())
        row += len(size)
    return x, np.asarray(got["y"].to_pylist(), float), np.flatnonzero(seen)


def bounded_sample(df: DataFrame, key: str | Column, rows: int) -> DataFrame:
    """About rows of the rows of df, by a hash of key, the same ones at every run; never over twice as many, even where all keys are one."""
    n = df.count()
    if n <= rows:
        return df
    drawn = df.where(F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key, F.lit("sample")), F.lit(1 << 30)) < F.lit(int(rows / n * (1 << 30)))).limit(2 * rows)
    return df.limit(rows) if drawn.isEmpty() else drawn


def fit_softmax(x: np.ndarray, y: np.ndarray, which: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights (all features, classes) of softmax regression on soft targets y (rows of classes), by Nesterov's gradient steps.

    which: the features that the columns of x are; all others have zero weights, as no row has them. Features are scaled
    to unit root mean square first, in place; the scale is folded into the weights. No rows: zero weights.
    """
    whole = np.zeros((len(GRAMS) << BITS, y.shape[1] if y.ndim == 2 else 1))
    if not len(x):
        return whole
    scale = (1 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-3)).astype(np.float32)
    x *= scale  # in place: the sample is the largest thing that the driver holds
    y = y.astype(np.float32)
    size = float(np.einsum("ij,ij->", x, x)) / len(x)
    w, v, rate = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros((x.shape[1], y.shape[1]), np.float32), np.float32(2.0 / max(size * 0.5, 1e-9))
    for k in range(steps):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = v - rate * (x.T @ (p - y) / np.float32(len(x)) + np.float32(ridge) * v)
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    whole[which] = w * scale[:, None]
    return whole
