"""Normality statistics: D'Agostino-Pearson K2 as column expressions, Shapiro-Wilk weights and p-value."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Polynomial coefficients of the Shapiro-Wilk approximation (Royston 1995, AS R94).
OUTER_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SECOND_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]
SMALL_GAMMA = [-2.273, 0.459]


def k2_statistic(n: Column, skew: Column, excess_kurtosis: Column) -> Column:
    """K2 from the count, the biased skewness and the biased excess kurtosis; NULL below 8 values."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(F.log(w2) / 2)

    expected = 3 * (n - 1) / (n + 1)
    variance = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess_kurtosis + 3 - expected) / F.sqrt(variance)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + (8 / s) * (2 / s + F.sqrt(1 + 4 / (s * s)))
    z_kurt = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z_skew * z_skew + z_kurt * z_kurt)


def k2_p_value(k2: Column) -> Column:
    return F.exp(-k2 / 2)


def _poly(coefficients: list[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_weights(n: int) -> list[float]:
    """The n antisymmetric weights that multiply the sorted sample."""
    if n == 3:
        return [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    normal = NormalDist()
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    total = sum(v * v for v in m)
    root = 1 / math.sqrt(n)
    last = _poly(OUTER_WEIGHT, root) + m[-1] / math.sqrt(total)
    if n > 5:
        second = _poly(SECOND_WEIGHT, root) + m[-2] / math.sqrt(total)
        scale = math.sqrt((total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
        outer = {0: -last, 1: -second, n - 2: second, n - 1: last}
    else:
        scale = math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        outer = {0: -last, n - 1: last}
    return [outer.get(i, v / scale) for i, v in enumerate(m)]


def shapiro_p_value(w: float, n: int) -> float:
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return max(p, 0.0)
    if w >= 1:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(SMALL_GAMMA, n)
        if y >= gamma:
            return 0.0
        y, mean, sd = -math.log(gamma - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_LOG_SD, n))
    else:
        x = math.log(n)
        mean, sd = _poly(LARGE_MEAN, x), math.exp(_poly(LARGE_LOG_SD, x))
    return 0.5 * math.erfc((y - mean) / sd / math.sqrt(2))
