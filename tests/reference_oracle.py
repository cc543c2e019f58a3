"""A plain numpy version of the scores and the order, row by row."""

from __future__ import annotations

import numpy as np


def hashed_rows(rows: int, dimensions: int, first: int = 0) -> np.ndarray:
    """Uniform values in [-1, 1) that depend on row and component alone."""
    out = np.empty((rows, dimensions), np.float32)
    for i in range(rows):
        out[i] = np.random.default_rng([first + i, dimensions]).uniform(-1, 1, dimensions)
    return out


def fold(values: np.ndarray) -> float:
    return float(np.cumsum(values.astype(np.float64))[-1])


def encode(row: np.ndarray) -> tuple[np.ndarray, np.float32]:
    x = row.astype(np.float64)
    h = (x / np.sqrt(fold(x * x))).astype(np.float16).astype(np.float32)
    return h, np.float32(1 / np.sqrt(fold(h.astype(np.float64) ** 2)))


def unit(query: np.ndarray, half: bool) -> np.ndarray:
    y = np.asarray(query, np.float64)
    q = (y / np.sqrt(fold(y * y))).astype(np.float32)
    return q.astype(np.float16).astype(np.float32) if half else q


def scores(corpus: list[tuple[np.ndarray, np.float32]], query: np.ndarray, half: bool = False) -> np.ndarray:
    q = unit(query, half).astype(np.float64)
    return np.array([np.float32(fold(h.astype(np.float64) * q) * float(inv)) for h, inv in corpus], np.float32)


def best(s: np.ndarray, k: int, excluded=()) -> list[tuple[int, float]]:
    order = np.lexsort((np.arange(len(s)), -s))
    return [(int(i), float(s[i])) for i in order if i not in set(excluded)][:k]
