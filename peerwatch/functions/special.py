"""Scalar mathematics applied to single aggregated numbers."""

from __future__ import annotations

import math

EULER_GAMMA = 0.5772156649015329


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n points (isolation-forest normaliser)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front) if log_front > -745 else 0.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_t(rho: float | None, n: int) -> float | None:
    """t statistic of a correlation; None when it is undefined, infinite when it is perfect."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1.0:
        return math.copysign(math.inf, rho)
    return rho * math.sqrt((n - 2) / ((1.0 - rho) * (1.0 + rho)))


def two_sided_p(t: float | None, n: int) -> float | None:
    """Two-sided p-value of Student's t with n - 2 degrees of freedom."""
    if t is None:
        return None
    if math.isinf(t):
        return 0.0
    freedom = n - 2
    return incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))
