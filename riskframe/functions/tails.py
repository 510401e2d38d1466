"""Tail probabilities of test statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _log_gamma_half(twice: Column) -> Column:
    """ln of the gamma function at half of a positive whole number."""
    odd = twice % 2 == 1
    # Gamma(n) = (n-1)!, Gamma(n + 1/2) = sqrt(pi) * product of (i - 1/2) up to n.
    factors = F.floor((twice - 1) / 2).cast("int")
    shift = F.when(odd, 0.5).otherwise(0.0)
    steps = F.when(factors >= 1, F.sequence(F.lit(1), F.greatest(factors, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    start = F.when(odd, math.log(math.pi) / 2).otherwise(0.0)
    return F.aggregate(steps, start, lambda acc, i: acc + F.log(i - shift))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) of a chi-square variable with ``df`` degrees of freedom: the regularised upper gamma function.

    Below the mean by the power series of the lower function, above it by the continued
    fraction of the upper one (modified Lentz). 1 for x <= 0; null without degrees of freedom.
    """
    a, h = df / 2, x.cast("double") / 2
    front = F.exp(a * F.log(h) - h - _log_gamma_half(df.cast("int")))
    rounds = F.sequence(F.lit(1), (F.lit(120) + F.ceil(12 * F.sqrt(a))).cast("int"))

    def series(acc: Column, n: Column) -> Column:
        term = acc["term"] * h / (a + n)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    first = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    lower = F.aggregate(rounds, first, series, lambda acc: acc["sum"]) * front

    def apart(v: Column) -> Column:
        return F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

    def fraction(acc: Column, n: Column) -> Column:
        top = -n * (n - a)
        b = acc["b"] + 2.0
        d = 1 / apart(top * acc["d"] + b)
        c = apart(b + top / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["f"] * c * d).alias("f"))

    b0 = h + 1 - a
    start = F.struct(b0.alias("b"), F.lit(1 / _TINY).alias("c"), (1 / apart(b0)).alias("d"), (1 / apart(b0)).alias("f"))
    upper = F.aggregate(rounds, start, fraction, lambda acc: acc["f"]) * front
    tail = F.when(x <= 0, 1.0).when(h < a + 1, 1 - lower).otherwise(upper)
    return F.when(df > 0, F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def normal_tails(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal variable."""
    return chi_square_tail(z * z, F.lit(1))


def kolmogorov_tail(distance: Column, n: Column, m: Column) -> Column:
    """Asymptotic P(D >= distance) of the two-sample Kolmogorov-Smirnov statistic for ``n`` and ``m`` rows.

    The alternating series for large arguments, its theta transform for small ones.
    """
    size = F.try_divide(n.cast("double") * m, n + m)
    x = F.sqrt(size) * distance
    terms = F.sequence(F.lit(1), F.lit(20))
    large = F.aggregate(
        terms, F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x)
    )
    small = F.aggregate(
        terms, F.lit(0.0), lambda acc, k: acc + F.exp(-((2.0 * k - 1) * (2.0 * k - 1)) * math.pi**2 / (8 * x * x))
    )
    tail = F.when(x <= 0, 1.0).when(x < 1, 1 - math.sqrt(2 * math.pi) / x * small).otherwise(large)
    return F.when(size > 0, F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))
