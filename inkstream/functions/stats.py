"""Normal, t and rank-sum probabilities for a handful of aggregated rows.

Used inside vectorised UDFs on results that already have one row per metric or variant.
"""

from __future__ import annotations

import math
from functools import cache


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p for p >= 0.5, by bisection on the two-sided tail."""
    if df <= 0 or not 0.5 <= p < 1.0:
        return math.nan
    tail, low, high = 2.0 * (1.0 - p), 0.0, 1.0
    while t_two_sided(high, df) > tail and high < 1e12:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if t_two_sided(mid, df) > tail:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


@cache
def _partition_numerator(m: int) -> tuple[int, list[int]]:
    """``(d, p)`` with 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^m)) = p(q) / (1 - q^d)^(m + 1).

    ``d`` is the least common multiple of 1..m (840 for eight), and 1 / (1 - q^i) is (1 + q^i + ... + q^(d - i)) / (1 - q^d).
    """
    d = math.lcm(*range(1, m + 1))
    p = [1]
    for i in (1, *range(1, m + 1)):
        out = [0] * (len(p) + d - i)
        for at in range(len(out)):  # a sum of d / i terms that lie i apart, from the one before
            out[at] = (p[at] if at < len(p) else 0) + (out[at - i] if at >= i else 0) - (p[at - d] if 0 <= at - d < len(p) else 0)
        p = out
    return d, p


def _partitions_up_to(x: int, m: int) -> int:
    """How many partitions into at most ``m`` parts the numbers 0..x have together, exactly and without a table over x."""
    d, p = _partition_numerator(m)
    return sum(p[r] * math.comb((x - r) // d + m, m) for r in range(x % d, min(x + 1, len(p)), d)) if x >= 0 else 0


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the larger U without ties; the smaller sample has a few values, the larger any number.

    The arrangements with statistic v are the coefficients of a Gaussian binomial, the product over i = 1..m of
    (1 - q^(n + i)) / (1 - q^i).  The numerator has 2^m terms, and what each takes from the sums of the
    denominator's coefficients is counted in closed form: time and memory do not grow with ``n``, and all is in integers.
    """
    m, n = min(n1, n2), max(n1, n2)
    lowest = m * n - math.ceil(u)  # arrangements as extreme as u, seen from the other end
    if lowest < 0:
        return 0.0
    terms = {0: 1}
    for i in range(1, m + 1):
        for exponent, sign in list(terms.items()):
            terms[exponent + n + i] = terms.get(exponent + n + i, 0) - sign
    ways = sum(sign * _partitions_up_to(lowest - exponent, m) for exponent, sign in terms.items())
    return min(1.0, 2 * ways / math.comb(m + n, m))


def rank_sum_p(r1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of the rank-sum test from the first sample's rank sum.

    ``ties`` is the sum of t^3 - t over groups of equal values.  Small samples without ties
    are exact, others use the tie-corrected normal approximation with continuity correction.
    """
    if n1 == 0 or n2 == 0:
        return math.nan
    u1 = r1 - n1 * (n1 + 1) / 2.0
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= 8 and ties == 0:
        return rank_sum_exact(u, n1, n2)
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return min(1.0, 2.0 * normal_sf(z))
