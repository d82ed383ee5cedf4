"""Tail probabilities used by the statistics operators (numpy only)."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = h
        for term in (even, odd):
            d = 1.0 / (1.0 + term * d or tiny)
            c = 1.0 + term / c or tiny
            h *= d * c
        if abs(h - before) < 1e-15 * abs(h):
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def t_quantile(p: float, df: float) -> float:
    """Upper quantile (p above one half) by bisection."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1.0 - t_two_sided(mid, df) / 2.0 < p else (lo, mid)
    return (lo + hi) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


# The published response surface of the unit-root statistic of a series with a constant, as
# polynomials of the statistic below and above a bend, and the statistics outside of which p is 0 or 1.
UNIT_ROOT_BEND, UNIT_ROOT_LEAST, UNIT_ROOT_MOST = -1.61, -18.83, 2.74
UNIT_ROOT_BELOW = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(t: float) -> float:
    """p-value of a unit-root statistic (one series, constant, no trend)."""
    if t > UNIT_ROOT_MOST:
        return 1.0
    if t < UNIT_ROOT_LEAST:
        return 0.0
    surface = UNIT_ROOT_BELOW if t <= UNIT_ROOT_BEND else UNIT_ROOT_ABOVE
    z = sum(c * t**i for i, c in enumerate(surface))
    return math.erfc(-z / math.sqrt(2.0)) / 2.0
