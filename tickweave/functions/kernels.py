"""Weighting kernels of the realised kernel estimator, for numbers and for columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Within this distance of 0 the limit is used.
NEAR_ZERO = 0.001


@dataclass(frozen=True)
class Kernel:
    """A kernel as a numpy function and as a column expression, with its constants."""

    name: str
    array: Callable[[np.ndarray], np.ndarray]
    column: Callable[[Column], Column]
    curvature: float
    k_00: float
    c_star: float
    efficiency: float
    reach: float = math.inf

    def bandwidth(self, mean_ticks: float) -> float:
        return self.c_star * mean_ticks**0.6

    def lags(self, n: int, h: float) -> int:
        return math.floor(min(n, self.reach * h))


def _parzen(x):
    return np.where(x < 0.5, 1 - 6 * x**2 + 6 * x**3, np.where(x < 1, 2 * (1 - x) ** 2, 0.0))


def _parzen_column(x: Column) -> Column:
    return F.when(x < 0.5, 1 - 6 * x * x + 6 * x * x * x).when(x < 1, 2 * (1 - x) * (1 - x)).otherwise(F.lit(0.0))


def _parzen_strict(x):
    return np.where(x < 0.5, 1 - 6 * x**2 + 6 * x**3, np.where(x < 1, 2 * (1 - x) ** 3, 0.0))


def _parzen_strict_column(x: Column) -> Column:
    return F.when(x < 0.5, 1 - 6 * x * x + 6 * x * x * x).when(x < 1, 2 * (1 - x) * (1 - x) * (1 - x)).otherwise(F.lit(0.0))


def _safe(x):
    return np.where(np.abs(x) < NEAR_ZERO, 1.0, x)


def _quadratic(x):
    y = _safe(np.asarray(x, float))
    return np.where(np.abs(x) < NEAR_ZERO, 1.0, 3 / y**2 * (np.sin(y) / y - np.cos(y)))


def _quadratic_column(x: Column) -> Column:
    return F.when(F.abs(x) < NEAR_ZERO, F.lit(1.0)).otherwise(3 / (x * x) * (F.sin(x) / x - F.cos(x)))


def _fejer(x):
    y = _safe(np.asarray(x, float))
    return np.where(np.abs(x) < NEAR_ZERO, 1.0, (np.sin(y) / y) ** 2)


def _fejer_column(x: Column) -> Column:
    s = F.sin(x) / x
    return F.when(F.abs(x) < NEAR_ZERO, F.lit(1.0)).otherwise(s * s)


def _tukey(x):
    return np.sin(math.pi / 2 * np.exp(-np.asarray(x, float))) ** 2


def _tukey_column(x: Column) -> Column:
    s = F.sin(F.lit(math.pi / 2) * F.exp(-x))
    return s * s


def _exponential(x):
    x = np.asarray(x, float)
    return (1 + x) * np.exp(-x)


# Curvature at 0, integral of the square, bandwidth constant, relative efficiency.
PARZEN = Kernel("parzen", _parzen, _parzen_column, 12.0, 0.269, 3.51, 0.97, 1.0)
PARZEN_STRICT = Kernel("parzen_strict", _parzen_strict, _parzen_strict_column, 12.0, 0.269, 3.51, 0.97, 1.0)
QUADRATIC_SPECTRAL = Kernel("quadratic_spectral", _quadratic, _quadratic_column, 0.2, 3 * math.pi / 5, 0.46, 0.93)
FEJER = Kernel("fejer", _fejer, _fejer_column, 2 / 3, math.pi / 3, 0.84, 0.94)
TUKEY_HANNING = Kernel("tukey_hanning", _tukey, _tukey_column, math.pi**2 / 2, 0.52, 2.16, 1.06)
BNHLS_2008 = Kernel("bnhls_2008", _exponential, lambda x: (1 + x) * F.exp(-x), 1.0, 5 / 4, 0.96, 1.09)
KERNELS = {k.name: k for k in (PARZEN, QUADRATIC_SPECTRAL, FEJER, TUKEY_HANNING, BNHLS_2008)}


@dataclass(frozen=True)
class Preaveraging:
    """Weights on (0, 1) and the integral that normalises them."""

    weight: Callable[[float], float] = lambda x: min(x, 1 - x)
    psi: float = 0.25

    def weights(self, k: int) -> list[float]:
        return [float(self.weight(i / k)) for i in range(1, k)]


TRIANGLE = Preaveraging()
