"""The normal distribution as column expressions: tail, cumulative probability and the quantile, to about 1e-13."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SQRT_2PI = math.sqrt(2 * math.pi)


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / _SQRT_2PI


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _tail(x: Column) -> Column:
    """P(X > x) for x >= 0: near zero by the series of odd powers, further out by the continued fraction."""
    steps = F.sequence(F.lit(1), F.lit(80))
    start = F.struct(x.alias("term"), x.alias("total"))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    near = 0.5 - density(x) * F.aggregate(steps, start, more)["total"]
    far = density(x) / F.aggregate(F.sequence(F.lit(200), F.lit(1)), x, lambda a, k: x + k / a)
    return F.when(x < 2.5, near).otherwise(far)


def upper_tail(x: Column) -> Column:
    """P(X > x), exact in relative terms far out."""
    return _once(x, lambda v: _once(_once(F.abs(v), _tail), lambda t: F.when(v >= 0, t).otherwise(1 - t)))


def cumulative(x: Column) -> Column:
    return upper_tail(-x)


def tail_point(q: Column) -> Column:
    """The x with P(X > x) = q, for 0 < q < 1: a rational start, then Newton steps; null outside."""

    def found(p: Column) -> Column:
        t = F.sqrt(-2 * F.log(p))
        # fixed values: Abramowitz and Stegun 26.2.23
        start = _once(t, lambda t: F.greatest(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t), F.lit(0.0)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), start, lambda x, _: F.greatest(x + (_tail(x) - p) / density(x), F.lit(0.0)))

    def signed(q: Column) -> Column:
        x = _once(F.least(q, 1 - q), found)
        return F.when((q > 0) & (q < 1), _once(x, lambda x: F.when(q <= 0.5, x).otherwise(-x)))

    return _once(q, signed)
