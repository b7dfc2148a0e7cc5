"""Student's t quantile through the regularised incomplete beta function."""

from __future__ import annotations

import math


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * f


def t_cdf(t: float, dof: float) -> float:
    tail = betainc(dof / 2, 0.5, dof / (dof + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, dof: float) -> float:
    """Inverse of t_cdf by bisection, then refined where the bracket allows."""
    if not 0 < p < 1 or dof <= 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, dof)
    lo, hi = 0.0, 1.0
    while t_cdf(hi, dof) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if t_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2
