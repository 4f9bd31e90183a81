"""Hashed n-gram counts of texts and linear models on them, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwatch.llm.batches import Words, map_columns

HASH = np.uint32(0x9E3779B1)


def char_grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot of the n bytes that begin at each byte (n <= 4)."""
    if len(data) < n:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    gram = wide[: len(data) - n + 1].copy()
    for i in range(1, n):
        gram |= wide[i : len(data) - n + 1 + i] << np.uint32(8 * i)
    return (((gram + np.uint32(n)) * HASH) >> np.uint32(32 - bits)).astype(np.int64)


def word_grams(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Slot of the n words that begin at each word, by their hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.int64)
    gram = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(hashes) - n + 1 + i]
    return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def shares(slots: list[np.ndarray], size: int) -> np.ndarray:
    """For each family of n-grams the share of every slot, one family after the other."""
    out = np.zeros(size * len(slots), np.float32)
    for i, s in enumerate(slots):
        if len(s):
            out[i * size : (i + 1) * size] = np.bincount(s, minlength=size) / len(s)
    return out


def text_words(words: Words, doc: int) -> slice:
    return slice(words.first[doc], words.first[doc + 1])


def collect_vectors(rows: DataFrame, label: str, vectors, size: int) -> tuple[np.ndarray, list]:
    """Feature vectors and labels of a sample whose rows the caller has bounded, in the order of their ids.

    ``vectors(texts)`` yields a vector of ``size`` per text; only what is not zero travels.
    """

    def sparse(texts: pa.Array) -> list:
        places, values = [], []
        for v in vectors(texts):
            at = np.flatnonzero(v)
            places.append(at.astype(np.int32))
            values.append(v[at])
        return [places, values]

    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))]
    found = map_columns(rows, ["text"], fields, sparse).select("doc_id", label, "at", "value").toArrow()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    out = np.zeros((found.num_rows, size), np.float32)
    at, value = found["at"].combine_chunks(), found["value"].combine_chunks()
    row = np.repeat(np.arange(found.num_rows), at.value_lengths().to_numpy())
    out[row, at.flatten().to_numpy()] = value.flatten().to_numpy()
    labels = found[label].to_pylist()
    return out[order], [labels[i] for i in order]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and biases of one logistic regression per column of y (0 or 1).

    Features are scaled by their root mean square, which the weights take in at the end; Adam on the whole sample.
    """
    scale = np.sqrt((x**2).mean(0)) + 1e-6
    x = x / scale
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    share = (weight / weight.sum()).astype(np.float32)[:, None]
    for t in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        g, gb = x.T @ error + decay * w, error.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / np.sqrt(x.shape[1]) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * mb / (np.sqrt(vb) + 1e-8)
    return w / scale[:, None], b


def platt(scores: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * score + b))), by Newton steps with smoothed targets."""
    positive, negative = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        slope = weight * (p - target)
        hessian = np.array([[(curve * scores**2).sum() + 1e-3, (curve * scores).sum()], [(curve * scores).sum(), curve.sum() + 1e-3]])
        da, db = np.linalg.solve(hessian, [(slope * scores).sum() + 1e-3 * (a - 1), slope.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a), float(b)
