"""Vectors as arrays: which take part, and cosines in double precision summed in one fixed order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.to_list(), np.float64).reshape(-1, dim)


def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, component after component, so that any engine that adds in order gets these bits."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def level(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between 1/2 and 1. Sums of squares then neither
    overflow nor vanish, and a cosine keeps its bits, as powers of two round nothing."""
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosines of original vectors."""
    a, b = level(a), level(b)
    return sums(a, b) / (np.sqrt(sums(a, a)) * np.sqrt(sums(b, b)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = level(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
