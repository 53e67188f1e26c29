"""Thomas-Fiering: a seasonal first-order Markov model of monthly flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import normal
from ..operators.calendar import monthly_totals
from ..operators.recursion import affine_path
from .base import Generator


def stedinger_tau(monthly: DataFrame) -> DataFrame:
    """(site, month, tau): lower bounds from extremes and the median; 0 where the formula gives none."""
    m = monthly.groupBy("site", "month").agg(F.max("q").alias("a"), F.min("q").alias("b"), F.median("q").alias("c"))
    tau = F.try_divide(F.col("a") * F.col("b") - F.col("c") * F.col("c"), F.col("a") + F.col("b") - 2 * F.col("c"))
    return m.select("site", "month", F.greatest(F.coalesce(tau, F.lit(0.0)), F.lit(0.0)).alias("tau"))


def normalized(monthly: DataFrame, tau: DataFrame) -> DataFrame:
    """(site, year, month, x): ln(q - tau); null where q does not exceed tau."""
    gap = F.col("q") - F.col("tau")
    return monthly.join(tau, ["site", "month"]).select("site", "year", "month", F.ln(F.when(gap > 0, gap)).alias("x"))


def month_pair_rho(x: DataFrame, rho: str = "reference") -> DataFrame:
    """(site, month, rho): correlation of a month with the next.

    "reference" pairs the k-th value of each (December with January of the same place), after cutting the longer one:
    its first if the earlier month is longer, its last otherwise. "classical" pairs by date.
    """
    if rho == "classical":
        a = x.select("site", "year", "month", "x")
        b = x.select("site", F.when(F.col("month") == 1, F.col("year") - 1).otherwise(F.col("year")).alias("year"), (F.pmod(F.col("month") + 10, F.lit(12)) + 1).alias("month"), F.col("x").alias("y"))
        return a.join(b, ["site", "year", "month"]).groupBy("site", "month").agg(F.corr("x", "y").alias("rho"))
    w = Window.partitionBy("site", "month")
    k = x.select("site", "month", "x", F.row_number().over(w.orderBy("year")).alias("k"), F.count("*").over(w).alias("n"))
    after = k.select("site", (F.pmod(F.col("month") + 10, F.lit(12)) + 1).alias("month"), F.col("x").alias("y"), F.col("k").alias("k2"), F.col("n").alias("n2"))
    shift = F.greatest(F.col("n") - F.col("n2"), F.lit(0))
    pairs = k.join(after, ["site", "month"]).where(F.col("k") - shift == F.col("k2"))
    return pairs.groupBy("site", "month").agg(F.corr("x", "y").alias("rho"))


class ThomasFieringGenerator(Generator):
    def __init__(self, rho: str = "reference"):
        self.rho = rho

    def fit(self, flow: DataFrame) -> ThomasFieringGenerator:
        monthly = monthly_totals(flow)
        tau = stedinger_tau(monthly)
        x = normalized(monthly, tau)
        moments = x.groupBy("site", "month").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sigma"), F.min("x").alias("x_min"))
        least = monthly.groupBy("site").agg(F.min("q").alias("q_min"), F.min("year").alias("first_year"))
        joined = moments.join(month_pair_rho(x, self.rho), ["site", "month"]).join(tau, ["site", "month"])
        self.params = joined.join(least, "site")
        self.is_fitted = True
        return self

    def generate(self, n_realizations: int = 1, n_years: int | None = None, seed: int = 0) -> DataFrame:
        """Monthly (realization, site, ts, q). A month's value is an affine map of the one before; the maps are composed over
        blocks, so a long series is no single row or task."""
        self.check_fitted()
        months = 12 * (n_years or 1)
        p = self.params
        before = p.select("site", (F.pmod("month", F.lit(12)) + 1).alias("month"), F.col("mu").alias("mu0"), F.col("sigma").alias("sigma0"), F.col("rho").alias("rho0"))
        least = p.groupBy("site").agg(F.min("x_min").alias("x_least"))
        monthly = p.join(before, ["site", "month"]).join(least, "site")
        series = monthly.withColumn("realization", F.explode(F.sequence(F.lit(0), F.lit(n_realizations - 1))))
        steps = series.where(F.col("month") <= months).withColumn("t", F.explode(F.sequence(F.col("month") - 1, F.lit(months - 1), F.lit(12))))
        r, e = F.col("rho" if self.rho == "reference" else "rho0"), normal(seed, "tf", F.col("realization"), F.col("site"), F.col("t"))
        slope = r * F.col("sigma") / F.col("sigma0")
        first = F.col("t") == 0
        a = F.when(first, F.lit(0.0)).otherwise(slope)
        b = F.when(first, F.col("mu") + F.col("sigma") * e).otherwise(F.col("mu") - slope * F.col("mu0") + F.sqrt(1 - r * r) * F.col("sigma") * e)
        paths = affine_path(steps.select("realization", "site", "t", a.alias("a"), b.alias("b")), ["realization", "site"], months)
        facts = p.join(least, "site").select("site", (F.col("month") - 1).alias("_m"), "tau", "x_least", "q_min", "first_year")
        out = paths.withColumn("_m", F.pmod("t", F.lit(12))).join(facts, ["site", "_m"])
        q = F.exp(F.when(F.col("x") < 0, F.col("x_least")).otherwise(F.col("x"))) + F.col("tau")
        ts = F.make_date(F.col("first_year") + F.floor(F.col("t") / 12).cast("int"), F.col("_m") + 1, F.lit(1))
        return out.select("realization", "site", ts.alias("ts"), F.when(q < 0, F.col("q_min")).otherwise(q).alias("q"))
