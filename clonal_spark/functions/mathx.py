"""Special functions as Columns (built-in functions only, so they stay in whole-stage code) and NumPy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Stirling's series for log-gamma and of the series for digamma.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_SHIFT = 8


def _d(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = F.greatest(x, _d(low))
    return x if high is None else F.least(x, _d(high))


def lgamma(x: Column) -> Column:
    """log-gamma for x > 0: shifted up by 8 with one logarithm of the product, then Stirling's series."""
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + i)
    z = x + _SHIFT
    inverse = _d(1) / z
    square = inverse * inverse
    series = _d(_STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * square + c
    return (z - 0.5) * F.log(z) - z + _HALF_LOG_2PI + series * inverse - F.log(product)


def digamma(x: Column) -> Column:
    """For x > 0: shifted up by 8, then the asymptotic series."""
    z = x + _SHIFT
    square = _d(1) / (z * z)
    series = _d(_DIGAMMA[-1])
    for c in reversed(_DIGAMMA[:-1]):
        series = series * square + c
    below = _d(1) / x
    for i in range(1, _SHIFT):
        below = below + _d(1) / (x + i)
    return F.log(z) - _d(0.5) / z + series * square - below


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, _d(0)).otherwise(x * F.log(y))


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def logsumexp(values: Column) -> Column:
    """Of an array column."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, _d(0), lambda s, v: s + F.exp(v - top)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -500, 500)))


def np_lgamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    product = x.copy()
    for i in range(1, _SHIFT):
        product = product * (x + i)
    z = x + _SHIFT
    inverse = 1 / z
    series = np.full_like(z, _STIRLING[-1])
    for c in reversed(_STIRLING[:-1]):
        series = series * inverse * inverse + c
    return (z - 0.5) * np.log(z) - z + _HALF_LOG_2PI + series * inverse - np.log(product)


def np_digamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for i in range(_SHIFT):
        out -= 1 / (x + i)
    z = x + _SHIFT
    square = 1 / (z * z)
    series = np.full_like(z, _DIGAMMA[-1])
    for c in reversed(_DIGAMMA[:-1]):
        series = series * square + c
    return out + np.log(z) - 0.5 / z + series * square


def np_xlogy(x, y) -> np.ndarray:
    x, y = np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float))
    return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, y)))


def np_logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def np_sigmoid(x) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
