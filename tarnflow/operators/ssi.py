"""Standardised streamflow indices: fitted per series and calendar period, applied to the same or to new values."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma, gamma_cdf, given, norm_cdf, norm_ppf, trigamma
from .stats import l_moments
from .windows import normal_scores, rolling

KEYS = ["site"]


#: How values are grouped for a fit: the number of a value's period, and how many there are in a cycle.
PERIODS = {"month": (F.month, 12), "week": (F.weekofyear, 53), "dayofyear": (F.dayofyear, 366), "all": (lambda ts: F.lit(1), 1)}


def with_period(sums: DataFrame, freq: str = "month", around: int = 0) -> DataFrame:
    """sums with their period; with `around`, each value once for every period within so many of its own, round the cycle."""
    number, cycle = PERIODS[freq]
    if not around:
        return sums.withColumn("period", number("ts"))
    near = F.explode(F.sequence(F.lit(-around), F.lit(around)))
    return sums.withColumn("_near", near).withColumn("period", F.pmod(number("ts") - 1 + F.col("_near"), F.lit(cycle)) + 1).drop("_near")


def normal_params(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, mu, sigma)."""
    return values.where("q IS NOT NULL").groupBy(*by).agg(F.avg("q").alias("mu"), F.stddev_samp("q").alias("sigma"))


def normal_ssi(sums: DataFrame, by: list[str] = KEYS, params: DataFrame | None = None, freq: str = "month") -> DataFrame:
    """(by, ts, ssi): standardised values; null where a period has no variance."""
    keys, values = [*by, "period"], with_period(sums, freq)
    params = normal_params(values, keys) if params is None else params
    return values.join(params, keys, "left").select(*by, "ts", F.try_divide(F.col("q") - F.col("mu"), F.col("sigma")).alias("ssi"))


def positive_means(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, m, u, p0): mean of the positive values, the log of it less the mean log, and the share of the others."""
    pos = F.when(F.col("q") > 0, F.col("q"))
    m = values.where("q IS NOT NULL").groupBy(*by).agg(F.avg(pos).alias("m"), F.avg(F.ln(pos)).alias("g"), F.avg((F.col("q") <= 0).cast("double")).alias("p0"))
    return m.select(*by, "m", (F.ln("m") - F.col("g")).alias("u"), "p0")


def gamma_params(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, scale, p0): Thom's closed form on positive values; p0 is the share of zeros."""
    m = positive_means(values, by)
    shape = F.try_divide(1 + F.sqrt(1 + 4 * F.col("u") / 3), 4 * F.col("u"))
    return m.select(*by, shape.alias("shape"), F.try_divide(F.col("m"), shape).alias("scale"), "p0")


#: Newton steps on the inverse shape; from Thom's start, which is off by 2 % at most, the error is squared by each.
STEPS = 6


def gamma_ml_params(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, shape, scale, p0): the most likely gamma distribution of the positive values, at location 0.

    The likelihood depends on their mean and mean log alone, which Spark sums by map-side combining; its maximum, where
    ln(shape) - digamma(shape) equals the log of the mean less the mean log, is found by a fold of Newton steps for each
    series and period. Without two different positive values there is none (null).
    """
    m = positive_means(values, by)

    def newton(u: Column) -> Column:
        def step(k: Column, _: Column) -> Column:
            off = F.ln(k) - digamma(k) - u
            return 1 / (1 / k + off / (k * k * (1 / k - trigamma(k))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), (1 + F.sqrt(1 + 4 * u / 3)) / (4 * u), step)

    fit = m.withColumn("shape", F.when(F.col("u") > 1e-12, given(F.col("u"), body=newton)))
    return fit.select(*by, "shape", (F.col("m") / F.col("shape")).alias("scale"), "p0")


def pearson3_params(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, alpha, beta, xi, t3, l1, l2) from L-moments, by approximate relations; without skew a normal fits (alpha null)."""
    m = l_moments(values, by)
    skewed = F.abs("t3") >= 1e-6
    return m.select(
        *by,
        F.when(skewed, 4 / (F.col("t3") * F.col("t3"))).alias("alpha"),
        F.when(skewed, 0.5 * F.col("l2") * F.abs("t3")).alias("beta"),
        F.when(skewed, F.col("l1") - F.try_divide(2 * F.col("l2"), F.col("t3"))).alias("xi"),
        "t3", "l1", "l2",
    )


@dataclass(frozen=True)
class Distribution:
    """A distribution for an index: params(values (by, q), by) fits one row a series and period, and cdf(q) uses its columns.

    With a column p0 among the parameters, the share of zeros, an index may count zeros apart (prob_zero).
    """

    params: Callable[[DataFrame, list[str]], DataFrame]
    cdf: Callable[[Column], Column]


def _gamma_cdf(q: Column) -> Column:
    return gamma_cdf(q, F.col("shape"), F.col("scale"))


DISTRIBUTIONS = {"gamma": Distribution(gamma_params, _gamma_cdf), "gamma_ml": Distribution(gamma_ml_params, _gamma_cdf)}


def distribution_ssi(sums: DataFrame, dist: Distribution, by: list[str] = KEYS, prob_zero: bool = False, params: DataFrame | None = None, freq: str = "month") -> DataFrame:
    """(by, ts, ssi) of (by, ts, q) by any distribution, fitted here unless params are given.

    With prob_zero, zeros have probability p0. Values of periods without a fit, and those of probability 0 or 1, are null.
    """
    keys = [*by, "period"]
    values = with_period(sums, freq)
    params = dist.params(values, keys) if params is None else params
    out = values.join(params, keys, "left").withColumn("_f", dist.cdf(F.col("q")))
    cdf = F.when(F.col("q") == 0, F.col("p0")).otherwise(F.col("p0") + (1 - F.col("p0")) * F.col("_f")) if prob_zero else F.col("_f")
    return out.withColumn("_p", cdf).select(*by, "ts", norm_ppf("_p").alias("ssi"))


def gamma_ssi(sums: DataFrame, by: list[str] = KEYS, prob_zero: bool = False, params: DataFrame | None = None, freq: str = "month") -> DataFrame:
    """(by, ts, ssi) by Thom's gamma distribution."""
    return distribution_ssi(sums, DISTRIBUTIONS["gamma"], by, prob_zero, params, freq)


def pearson3_ssi(sums: DataFrame, by: list[str] = KEYS, params: DataFrame | None = None, limit: float = 4.0, freq: str = "month") -> DataFrame:
    """(by, ts, ssi), clipped to +-limit. The tail follows the sign of the skew."""
    keys = [*by, "period"]
    values = with_period(sums, freq)
    params = pearson3_params(values, keys) if params is None else params
    j = values.join(params, keys, "left")
    g = gamma_cdf(F.abs(F.col("q") - F.col("xi")), F.col("alpha"), F.col("beta"))
    n = norm_cdf((F.col("q") - F.col("l1")) / F.nullif(F.col("l2") * math.sqrt(math.pi), F.lit(0.0)))
    j = j.withColumn("_g", g).withColumn("_n", n)
    above = F.when(F.col("q") > F.col("xi"), F.col("_g")).otherwise(0.0)
    below = F.when(F.col("q") < F.col("xi"), 1 - F.col("_g")).otherwise(1.0)
    cdf = F.when(F.col("alpha").isNull(), F.col("_n")).when(F.col("t3") > 0, above).otherwise(below)
    p = F.least(F.greatest(cdf, F.lit(1e-12)), F.lit(1 - 1e-12))
    return j.withColumn("_p", p).select(*by, "ts", F.least(F.greatest(norm_ppf("_p"), F.lit(-limit)), F.lit(limit)).alias("ssi"))


def normal_scores_ssi(sums: DataFrame, by: list[str] = KEYS, train: DataFrame | None = None, freq: str = "month", around: int = 0) -> DataFrame:
    """(by, ts, ssi) by ranks in the training values of the same period; beyond them it is null."""
    keys = [*by, "period"]
    values = with_period(sums, freq)
    scored = normal_scores(with_period(train if train is not None else sums, freq, around).select(*keys, "q"), values, keys)
    return scored.select(*by, "ts", norm_ppf("cdf").alias("ssi"))


@dataclass
class SSI:
    """fit on one record, transform another. agg_func: sum or mean.

    dist: gamma (Thom's closed form), gamma_ml (maximum likelihood), pearson3, normal, normal_scores, or a Distribution.

    freq says which values are fitted together (see PERIODS; dayofyear for daily series), and fit_window takes those of
    so many periods before and behind as well.
    """

    window: int = 12
    dist: str | Distribution = "gamma"
    agg_func: str = "sum"
    prob_zero: bool = False
    freq: str = "month"
    fit_window: int = 0
    by: list[str] = field(default_factory=lambda: list(KEYS))
    params: DataFrame | None = None
    train: DataFrame | None = None

    def __post_init__(self):
        known = isinstance(self.dist, Distribution) or self.dist in (*DISTRIBUTIONS, "pearson3", "normal", "normal_scores")
        if not known or self.agg_func not in ("sum", "mean"):
            raise ValueError(f"unknown dist or agg_func: {self.dist}, {self.agg_func}")
        if self.freq not in PERIODS or not 0 <= 2 * self.fit_window < max(2, PERIODS[self.freq][1]):
            raise ValueError(f"unknown freq or too wide a fit_window: {self.freq}, {self.fit_window}")

    @property
    def distribution(self) -> Distribution:
        return self.dist if isinstance(self.dist, Distribution) else DISTRIBUTIONS[self.dist]

    def sums(self, flow: DataFrame) -> DataFrame:
        return rolling(flow, self.window, self.agg_func, self.by) if self.window > 1 else flow.select(*self.by, "ts", "q")

    def fit(self, flow: DataFrame) -> SSI:
        self.train = self.sums(flow)
        values, keys = with_period(self.train, self.freq, self.fit_window), [*self.by, "period"]
        if self.dist != "normal_scores":
            fits = {"pearson3": pearson3_params, "normal": normal_params}
            self.params = (fits[self.dist] if self.dist in fits else self.distribution.params)(values, keys)
        return self

    def apply(self, sums: DataFrame) -> DataFrame:
        if self.train is None:
            raise RuntimeError("fit() first")
        if self.dist == "normal_scores":
            return normal_scores_ssi(sums, self.by, self.train, self.freq, self.fit_window)
        if self.dist == "normal":
            return normal_ssi(sums, self.by, self.params, self.freq)
        if self.dist == "pearson3":
            return pearson3_ssi(sums, self.by, self.params, freq=self.freq)
        return distribution_ssi(sums, self.distribution, self.by, self.prob_zero, self.params, self.freq)

    def transform(self, flow: DataFrame) -> DataFrame:
        return self.apply(self.sums(flow))

    def fit_transform(self, flow: DataFrame) -> DataFrame:
        return self.fit(flow).training_ssi()

    def training_ssi(self) -> DataFrame:
        return self.apply(self.train)
