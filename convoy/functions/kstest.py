"""Significance of the two-sample Kolmogorov-Smirnov statistic."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How significance is found; the caller names one, and no size changes it.
EXACT, LIMITING = "exact", "limiting"


def exact_p_value(n: int, m: int, statistic: float) -> float:
    """P(D >= statistic) under the null, by counting the orderings of both samples that stay
    strictly inside the band; the counts are kept as probabilities."""
    if statistic <= 0:
        return 1.0
    g = math.gcd(n, m)
    # A point (i, j) of the path is outside when |i/n - j/m| reaches the statistic.
    band = round(statistic * n * m / g)
    a, b = m // g, n // g
    j = np.arange(m + 1)
    inside = np.abs(-j * b) < band
    row = np.cumprod(inside).astype(float)
    for i in range(1, n + 1):
        # Probability of reaching (i, j): from above with weight i/(i+j), from the left j/(i+j).
        ok = np.abs(i * a - j * b) < band
        up = row * (i / (i + j))
        row = _left_to_right(up, i, ok)
    return float(min(1.0, max(0.0, 1.0 - row[m])))


def _left_to_right(up: np.ndarray, i: int, ok: np.ndarray) -> np.ndarray:
    out = np.zeros_like(up)
    lo, hi = (int(np.argmax(ok)), len(ok) - int(np.argmax(ok[::-1]))) if ok.any() else (0, 0)
    previous = 0.0
    for j in range(lo, hi):
        previous = up[j] + previous * (j / (i + j)) if ok[j] else 0.0
        out[j] = previous
    return out


def limiting_p_value(n: int, m: int, statistic: float) -> float:
    """P(D >= statistic) from the limiting distribution, for large samples."""
    lam = math.sqrt(n * m / (n + m)) * statistic
    if lam < 0.2:
        return 1.0
    k = np.arange(1, 101)
    series = 2.0 * np.sum((-1.0) ** (k - 1) * np.exp(-2.0 * (k * lam) ** 2))
    return float(min(1.0, max(0.0, series)))


def p_value(n: int, m: int, statistic: float, method: str = EXACT) -> float:
    """P(D >= statistic) by ``method``: exact takes n * m steps, limiting is a short series."""
    if method not in (EXACT, LIMITING):
        raise ValueError(f"unknown method: {method}")
    if n == 0 or m == 0:
        return float("nan")
    return exact_p_value(n, m, statistic) if method == EXACT else limiting_p_value(n, m, statistic)


@lru_cache(maxsize=4096)
def step_p_value(n: int, m: int, step: int) -> float:
    """Exact p-value of the statistic ``step / lcm(n, m)``, the form that all of them have."""
    return exact_p_value(n, m, step / math.lcm(n, m))


def exact_p_values(n: int, m: int, statistics: np.ndarray) -> np.ndarray:
    """Exact p-values of many statistics; each different one is worked out once."""
    steps = np.rint(statistics * math.lcm(n, m)).astype(int)
    found, at = np.unique(steps, return_inverse=True)
    return np.array([step_p_value(n, m, int(k)) for k in found])[at].reshape(steps.shape)


@lru_cache(maxsize=64)
def critical_statistic(n: int, m: int, alpha: float, method: str = EXACT) -> float:
    """Smallest reachable statistic whose p-value is below ``alpha``, by bisection."""
    steps = math.lcm(n, m)
    lo, hi = 0, steps
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if p_value(n, m, mid / steps, method) < alpha else (mid + 1, hi)
    return lo / steps


def ks_p_value(n: Column, m: Column, statistic: Column, method: str = LIMITING) -> Column:
    """p-value per row."""

    @F.pandas_udf(T.DoubleType())
    def values(n: pd.Series, m: pd.Series, statistic: pd.Series) -> pd.Series:
        rows = zip(n, m, statistic, strict=True)
        return pd.Series([p_value(int(a), int(b), float(d), method) for a, b, d in rows])

    return values(n, m, statistic)
