"""Distribution functions that Spark lacks, as column expressions: rational forms, and folds of series and continued fractions.

Nothing here leaves the JVM. Sums run over as many terms as the shape needs, some ten times its square root, and are
folded backwards, so that a step carries one number. Null arguments and arguments outside a domain give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes from here on take a normal approximation, whose relative error is below 1e-9 there.
LARGE = 1e9
# A published rational form of the normal distribution function, highest power first, for distances up to 7.07.
UPPER = [3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
LOWER = [8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# A published start for upper-tail normal quantiles, good to 4.5e-4, highest power first.
START_UPPER, START_LOWER = [0.010328, 0.802853, 2.515517], [0.001308, 0.189269, 1.432788, 1.0]


def given(*values: Column | float, body: Callable[..., Column]) -> Column:
    """body of values that are computed once each: what a lambda takes from outside is computed anew at each step."""
    held = F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(held), lambda h: body(*[h[f"v{i}"] for i in range(len(values))])), F.lit(0))


def polynomial(coefficients: list[float], x: Column) -> Column:
    """By Horner's rule, highest power first."""
    return reduce(lambda value, c: value * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def folded(terms: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step from the last term's number down to 1."""
    return F.aggregate(F.sequence(F.greatest(terms.cast("int"), F.lit(1)), F.lit(1), F.lit(-1)), start, lambda acc, k: step(acc, k.cast("double")))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for positive x: Stirling's series at x + 8, led back by the recurrence."""

    def of(x: Column) -> Column:
        y = x + 8
        w = 1 / (y * y)
        tail = polynomial([-691 / 360360, 1 / 1188, -1 / 1680, 1 / 1260, -1 / 360, 1 / 12], w) / y
        product = reduce(lambda p, i: p * (x + i), range(1, 8), x)
        return F.when(x > 0, F.when(x < 1e15, (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.ln(product)).otherwise(x * F.ln(x) - x))

    return given(x, body=of)


def digamma(x: Column) -> Column:
    """The derivative of lgamma for positive x."""

    def of(x: Column) -> Column:
        y = x + 8
        w = 1 / (y * y)
        tail = polynomial([1 / 12, -691 / 32760, 1 / 132, -1 / 240, 1 / 252, -1 / 120, 1 / 12, 0.0], w)
        return F.when(x > 0, F.ln(y) - 0.5 / y - tail - reduce(lambda s, i: s + 1 / (x + i), range(1, 8), 1 / x))

    return given(x, body=of)


def trigamma(x: Column) -> Column:
    """The derivative of digamma for positive x."""

    def of(x: Column) -> Column:
        y = x + 8
        w = 1 / (y * y)
        tail = polynomial([7 / 6, -691 / 2730, 5 / 66, -1 / 30, 1 / 42, -1 / 30, 1 / 6, 0.0], w) / y
        return F.when(x > 0, 1 / y + 0.5 * w + tail + reduce(lambda s, i: s + 1 / ((x + i) * (x + i)), range(1, 8), 1 / (x * x)))

    return given(x, body=of)


def _upper_tail(z: Column) -> Column:
    """The normal probability above z, for z >= 0."""
    far = reduce(lambda below, k: z + k / below, (4.0, 3.0, 2.0, 1.0), z + 0.65)
    bell = F.exp(-z * z / 2)
    return F.when(z < 7.07106781186547, bell * polynomial(UPPER, z) / polynomial(LOWER, z)).otherwise(bell / (far * math.sqrt(2 * math.pi)))


def norm_cdf(x: Column) -> Column:
    return given(x, F.abs(x), body=lambda x, z: F.when(~F.isnan(x), F.when(x > 0, 1 - _upper_tail(z)).otherwise(_upper_tail(z))))


def norm_ppf(p: Column | str) -> Column:
    """The normal quantile: a rational start and two Halley steps on the smaller tail. Null at and beyond 0 and 1."""
    p = F.col(p) if isinstance(p, str) else p

    def of(p: Column, tail: Column, t: Column) -> Column:
        start = t - polynomial(START_UPPER, t) / polynomial(START_LOWER, t)

        def halley(z: Column, _: Column) -> Column:
            step = (F.when(z < 0, 1 - _upper_tail(-z)).otherwise(_upper_tail(z)) - tail) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
            return z + step / (1 - z * step / 2)

        z = F.aggregate(F.sequence(F.lit(1), F.lit(2)), start, halley)
        return F.when(p < 0.5, -z).otherwise(z)

    tail = F.least(p, 1 - p)
    inside = (p > 0) & (p < 1)
    return F.when(inside, given(p, tail, F.sqrt(-2 * F.ln(tail)), body=of))


def _series(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a) times this is the lower incomplete gamma function, for x < a + 1."""
    return folded(40 + 10 * F.sqrt(a), F.lit(1.0), lambda acc, k: 1 + acc * x / (a + k)) / a


def _fraction(a: Column, x: Column) -> Column:
    """x^a e^-x / gamma(a) times this is the upper incomplete gamma function, for x >= a + 1."""
    terms = 60 + 10 * F.sqrt(a)
    return 1 / folded(terms, x + 1 - a + 2 * (F.floor(terms) + 1), lambda acc, k: x - 1 - a + 2 * k - k * (k - a) / acc)


def gamma_q(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function, of a > 0 and x >= 0."""
    return _gamma(a, x, upper=True)


def gamma_p(a: Column, x: Column) -> Column:
    """The regularised lower incomplete gamma function, of a > 0 and x >= 0."""
    return _gamma(a, x, upper=False)


def _gamma(a: Column, x: Column, upper: bool) -> Column:
    def of(a: Column, x: Column, front: Column) -> Column:
        low, high = front * _series(a, x), front * _fraction(a, x)
        small = F.least(low, F.lit(1.0))
        large = F.least(high, F.lit(1.0))
        part = F.when(x < a + 1, 1 - small if upper else small).otherwise(large if upper else 1 - large)
        normal = 3 * F.sqrt(a) * (F.pow(x / a, F.lit(1 / 3)) - 1 + 1 / (9 * a))
        part = F.when(a > LARGE, norm_cdf(-normal if upper else normal)).otherwise(part)
        return F.when(x == 0, F.lit(float(upper))).when(x == math.inf, F.lit(float(not upper))).otherwise(part)

    inside = (a > 0) & (a < math.inf) & (x >= 0) & ~F.isnan(x)
    return F.when(inside, given(a, x, F.exp(a * F.ln(x) - x - lgamma(a)), body=of))


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, of a, b > 0; 0 below 0 and 1 above 1. By its continued fraction."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            m = F.floor(k / 2)
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / acc

        return 1 / folded(80 + 12 * F.sqrt(F.greatest(a, b)), F.lit(1.0), step)

    def of(a: Column, b: Column, x: Column, front: Column) -> Column:
        turned = x > (a + 1) / (a + b + 2)
        return F.when(turned, 1 - front * fraction(b, a, 1 - x) / b).otherwise(front * fraction(a, b, x) / a)

    front = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.ln(x) + b * F.log1p(-x))
    return F.when((a > 0) & (b > 0), F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(~F.isnan(x), given(a, b, x, front, body=of)))


def gamma_cdf(x: Column, shape: Column, scale: Column) -> Column:
    """Values below 0 count as 0."""
    return F.when(scale > 0, gamma_p(shape, F.greatest(x, F.lit(0.0)) / scale))


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """The upper tail of the F distribution."""
    return F.when(~F.isnan(f), beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * F.greatest(f, F.lit(0.0)))))
