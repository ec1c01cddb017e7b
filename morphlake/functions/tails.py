"""Tail probabilities of test statistics, for the few rows that tests give; plain mathematics."""

from __future__ import annotations

import math
from functools import cache


def _continued(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return None
    return 0.0 if math.isinf(t) else beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The t value whose two-sided tail is 2 * (1 - p), by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 2 * (1 - p) else (low, mid)
    return (low + high) / 2


def normal_two_sided(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2))


@cache
def _rank_sum_counts(n: int, m: int) -> tuple[int, ...]:
    """How many of the orders of n and m untied values give each U."""
    ways = [[0] * (n * m + 1) for _ in range(n + 1)]
    ways[0][0] = 1
    for value in range(1, n + m + 1):
        for k in range(min(value, n), 0, -1):
            for u in range(n * m, -1, -1):
                shift = value - k
                if shift <= m and u >= shift:
                    ways[k][u] += ways[k - 1][u - shift]
    return tuple(ways[n])


def mann_whitney(u: float, n: int, m: int, ties: float) -> float:
    """Two-sided p of U: exact where a side has at most 8 values and none tie, else normal with ties and continuity."""
    top = max(u, n * m - u)
    if ties == 0 and min(n, m) <= 8:
        counts = _rank_sum_counts(n, m)
        return min(1.0, 2 * sum(counts[math.ceil(top) :]) / math.comb(n + m, n))
    total = n + m
    sd = math.sqrt(n * m / 12 * ((total + 1) - ties / (total * (total - 1))))
    return 1.0 if sd == 0 else min(1.0, normal_two_sided(max(0.0, top - n * m / 2 - 0.5) / sd))


@cache
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for s in range(len(ways) - 1, rank - 1, -1):
            ways[s] += ways[s - rank]
    return tuple(ways)


def signed_rank(w_plus: float, n: int, ties: float) -> float:
    """Two-sided p of the rank sum of positive differences (zeros dropped): exact to 50 without ties, else normal."""
    if n == 0:
        return 1.0
    total = n * (n + 1) / 2
    low = min(w_plus, total - w_plus)
    if ties == 0 and n <= 50:
        return min(1.0, 2 * sum(_signed_rank_counts(n)[: math.floor(low) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, normal_two_sided((low - total / 2) / sd))
