"""Tail probabilities and small-sample tests as column expressions, so that p-values come by group, in the plan.

Null where an input is null or out of range.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients of the gamma function for g = 7, as published.
LANCZOS_G = 7.0
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Terms of continued fractions and series.
TERMS = 200


def log_gamma(x: Column) -> Column:
    """For x of 0.5 and more."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta, by Lentz's rule, for x under (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def turn(s: Column, k: Column) -> Column:
        d = 1 / safe(1 + k * s["d"])
        c = safe(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, n: Column) -> Column:
        # Even and odd terms in turn.
        m = F.floor(n / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(s, F.when(n % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * TERMS + 1)), start, step, lambda s: s["h"])


def beta_regularized(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for a and b of 0.5 and more."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = x <= (a + 1) / (a + b + 2)
    p, q, z = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    side = front * _fraction(p, q, z) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(low, side).otherwise(1 - side))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return F.when(df > 0, beta_regularized(df / 2, F.lit(0.5), df / (df + t * t)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs; null under three, 0 where it is perfect."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(t_tail(t, (n - 2).cast("double"))))


def normal_tail(z: Column) -> Column:
    """Two-sided p of the standard normal: a series near the middle, a continued fraction in the tails."""
    x = F.abs(z) / math.sqrt(2)
    series = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.struct(x.alias("t"), F.lit(0.0).alias("s")), lambda s, n: F.struct((s["t"] * 2 * x * x / (2 * n + 3)).alias("t"), (s["s"] + s["t"]).alias("s")), lambda s: s["s"])
    low = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    high = F.exp(-x * x) / math.sqrt(math.pi) / F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), x, lambda s, n: x + (n / 2) / s)
    return F.when(x < 2, low).otherwise(high)


def upper_normal(z: Column) -> Column:
    """P of more than z."""
    return F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2)


def k_squared_p(n: Column, skew: Column, kurt: Column) -> Column:
    """p of the omnibus test of normality from skewness and kurtosis (not excess), for n of 8 and more."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (b2 - 1))
    zs = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / root**2))
    below = 1 + x * F.sqrt(2 / (a - 4))
    zk = ((1 - 2 / (9 * a)) - F.signum(below) * ((1 - 2 / a) / F.abs(below)) ** (1 / 3)) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, F.exp(-(zs * zs + zk * zk) / 2))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null without spread, where Spark's own divides by zero."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def signed_rank_p(n: Column, w: Column, ties: Column) -> Column:
    """Two-sided p of the smaller rank sum: counted out up to 25 without ties, else by the normal approximation; 1 for none."""
    size = n * (n + 1) / 2
    ways = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))),
        F.transform(F.sequence(F.lit(0), size.cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0)),
        lambda acc, k: F.transform(acc, lambda x, i: x + F.when(i >= k, F.get(acc, i - k)).otherwise(0.0)),
    )
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n))
    # In doubles: the product of three counts passes a long from some two million on.
    m = n.cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48.0
    return F.when(n == 0, 1.0).when((n <= 25) & (ties == 0), exact).otherwise(normal_tail((w - m * (m + 1) / 4.0) / F.sqrt(var)))


#: Samples that the test of Shapiro and Wilk is given, at most; others have the omnibus test.
SMALL = 19


def shapiro_weights(n: int) -> list[float]:
    """Weights of the ordered sample, by the published approximation."""
    if n == 3:
        return [-math.sqrt(0.5), 0.0, math.sqrt(0.5)]
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(x * x for x in m), 1 / math.sqrt(n)
    # The polynomials for the two outer weights.
    last = -2.706056 * u**5 + 4.434685 * u**4 - 2.071190 * u**3 - 0.147981 * u**2 + 0.221157 * u + m[-1] / math.sqrt(mm)
    if n <= 5:
        scale = math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        inner = [x / scale for x in m[1:-1]]
        return [-last, *inner, last]
    second = -3.582633 * u**5 + 5.682633 * u**4 - 1.752461 * u**3 - 0.293762 * u**2 + 0.042981 * u + m[-2] / math.sqrt(mm)
    scale = math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
    return [-last, -second, *(x / scale for x in m[2:-2]), second, last]


def shapiro(values: Column) -> Column:
    """struct(w, p) of a sorted array of 3 to `SMALL` values that are not all equal; null for others."""
    n = F.size(values)
    weights = F.array(*(F.array(*(F.lit(x) for x in shapiro_weights(k))) if k >= 3 else F.array(F.lit(0.0)) for k in range(SMALL + 1)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = total(values) / n
    top = total(F.zip_with(values, F.get(weights, n), lambda x, a: F.coalesce(x * a, F.lit(0.0))))
    spread = total(F.transform(values, lambda x: (x - mean) ** 2))
    w = F.least(F.lit(1.0), F.try_divide(top * top, spread))
    k = n.cast("double")
    left = F.log(1 - w)
    # The published polynomials for the mean and deviation of the transformed statistic.
    few = (-F.log(-2.273 + 0.459 * k - left) - (0.544 - 0.39978 * k + 0.025054 * k**2 - 0.0006714 * k**3)) / F.exp(1.3822 - 0.77857 * k + 0.062767 * k**2 - 0.0020322 * k**3)
    x = F.log(k)
    more = (left - (-1.5861 - 0.31082 * x - 0.083751 * x**2 + 0.0038915 * x**3)) / F.exp(-0.4803 - 0.082676 * x + 0.0030302 * x**2)
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    p = F.when(w >= 1, 1.0).when(n == 3, three).otherwise(upper_normal(F.when(n <= 11, few).otherwise(more)))
    return F.when((n >= 3) & (n <= SMALL) & (spread > 0), F.struct(w.alias("w"), p.alias("p")))
