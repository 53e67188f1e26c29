"""Kirsch: monthly multi-site bootstrap with correlation colouring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.calendar import log_floor, monthly_totals
from ..operators.stats import month_correlations, monthly_moments
from .base import Generator


def complete_scores(monthly: DataFrame, moments: DataFrame) -> DataFrame:
    """(site, hist_idx, month, z): scores of years with all twelve months, numbered in order from 0."""
    z = monthly.join(moments, ["site", "month"]).withColumn("z", (F.col("q") - F.col("mu")) / F.col("sigma"))
    z = z.withColumn("_n", F.count("*").over(Window.partitionBy("site", "year"))).where("_n = 12")
    return z.select("site", (F.dense_rank().over(Window.partitionBy("site").orderBy("year")) - 1).alias("hist_idx"), "month", "z")


def half_year_shifted(z: DataFrame) -> DataFrame:
    """Rows July to June: months 7 to 12 of a year become 1 to 6, months 1 to 6 of the next kept year 7 to 12."""
    last = F.max("hist_idx").over(Window.partitionBy("site"))
    out = z.select("site", (F.col("hist_idx") - (F.col("month") <= 6).cast("int")).alias("hist_idx"), (F.pmod(F.col("month") + 5, F.lit(12)) + 1).alias("month"), "z", last.alias("_last"))
    return out.where("hist_idx >= 0 AND hist_idx < _last").drop("_last")


def upper_factor(corr: np.ndarray, rounds: int = 50) -> np.ndarray:
    """U with U'U = corr; negative eigenvalues are lifted and the diagonal restored until the factorisation works."""
    if not np.isfinite(corr).all():
        raise ValueError("a calendar month has no variance, so its correlations are undefined")
    for _ in range(rounds):
        try:
            return np.linalg.cholesky(corr).T
        except np.linalg.LinAlgError:
            values, vectors = np.linalg.eigh(corr)
            corr = vectors @ np.diag(np.where(values < 0, 1e-8, values)) @ vectors.T
            np.fill_diagonal(corr, 1.0)
    raise ValueError(f"the correlation matrix is not positive definite after {rounds} repairs")


def factors(z: DataFrame) -> DataFrame:
    """(site, k, j, u) for k <= j: the upper factor of each site's 12 x 12 month correlations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corr = pdf.pivot(index="m1", columns="m2", values="r").to_numpy(float)
        u = upper_factor((corr + corr.T) / 2)
        k, j = np.triu_indices(12)
        return pd.DataFrame({"site": pdf["site"].iloc[0], "k": k + 1, "j": j + 1, "u": u[k, j]})

    return month_correlations(z).groupBy("site").applyInPandas(run, "site string, k int, j int, u double")


def bootstrap(spark, n_realizations: int, n_years: int, n_hist: int, seed: int) -> DataFrame:
    """(realization, syn_year, month, hist_idx): one draw for all sites, for n_years + 1 years."""
    rows = spark.range(n_realizations).select(F.col("id").cast("int").alias("realization"), F.explode(F.sequence(F.lit(0), F.lit(n_years))).alias("syn_year"))
    rows = rows.select("realization", "syn_year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return rows.withColumn("hist_idx", F.floor(uniform(seed, "boot", "realization", "syn_year", "month") * n_hist).cast("int"))


def gathered(boot: DataFrame, z: DataFrame, n_hist: int) -> DataFrame:
    """(realization, site, syn_year, month, x): the drawn scores of every site; a draw beyond its last row takes the last."""
    last = F.max("hist_idx").over(Window.partitionBy("site"))
    ends = z.withColumn("_last", last).where("hist_idx = _last").select("site", F.explode(F.sequence(F.col("_last") + 1, F.greatest(F.lit(n_hist), F.col("_last") + 1))).alias("hist_idx"), "month", "z")
    return boot.join(z.select("site", "hist_idx", "month", "z").unionByName(ends), ["hist_idx", "month"]).select("realization", "site", "syn_year", "month", F.col("z").alias("x"))


def coloured(x: DataFrame, u: DataFrame) -> DataFrame:
    """(realization, site, syn_year, month, z): the row of twelve scores times U."""
    joined = x.join(u.withColumnRenamed("k", "month"), ["site", "month"])
    return joined.groupBy("realization", "site", "syn_year", F.col("j").alias("month")).agg(F.sum(F.col("x") * F.col("u")).alias("z"))


def combined(z: DataFrame, shifted: DataFrame, combine: str = "reference") -> DataFrame:
    """(realization, site, syn_year, month, z): January to June from the shifted rows' second half, July to December from
    the next row's first half ("reference") or its second half ("paper")."""
    spring = shifted.where("month > 6").withColumn("month", F.col("month") - 6)
    following = z.where("syn_year > 0").withColumn("syn_year", F.col("syn_year") - 1)
    autumn = following.where("month <= 6").withColumn("month", F.col("month") + 6) if combine == "reference" else following.where("month > 6")
    years = z.groupBy("realization").agg(F.max("syn_year").alias("n"))
    return spring.unionByName(autumn).join(years, "realization").where("syn_year < n").drop("n")


class KirschGenerator(Generator):
    def __init__(self, generate_using_log_flow: bool = True, combine: str = "reference"):
        self.log, self.combine = generate_using_log_flow, combine

    def preprocessing(self, flow: DataFrame, timestep: str = "monthly") -> DataFrame:
        if timestep != "monthly":
            raise NotImplementedError("only monthly bootstraps")
        monthly = monthly_totals(flow)
        return monthly.withColumn("q", log_floor(F.col("q"))) if self.log else monthly

    def fit(self, flow: DataFrame) -> KirschGenerator:
        monthly = self.preprocessing(flow)
        self.moments = monthly_moments(monthly).cache()
        flat = self.moments.where("sigma = 0").select("site", "month").head(1)
        if flat:
            raise ValueError(f"site {flat[0].site} has no variance in month {flat[0].month}")
        self.z = complete_scores(monthly, self.moments).cache()
        self.shifted = half_year_shifted(self.z)
        self.u, self.u_shifted = factors(self.z).cache(), factors(self.shifted).cache()
        facts = self.z.agg(F.max("hist_idx")).first()[0]
        if facts is None:
            raise ValueError("no year has all twelve months")
        self.n_hist = facts + 1
        self.last_year = monthly.agg(F.max("year")).first()[0]
        self.is_fitted = True
        return self

    def generate(self, n_realizations: int = 1, n_years: int | None = None, seed: int = 0, boot: DataFrame | None = None) -> DataFrame:
        """Monthly (realization, site, ts, q) from the January after the record. boot may give the draws instead."""
        self.check_fitted()
        n_years = n_years or self.n_hist
        if boot is None:
            boot = bootstrap(self.z.sparkSession, n_realizations, n_years, self.n_hist, seed)
        elif boot.groupBy("realization").count().where(F.col("count") != (n_years + 1) * 12).head(1):
            raise ValueError(f"boot needs {(n_years + 1) * 12} draws a realization")
        zc = combined(coloured(gathered(boot, self.z, self.n_hist), self.u), coloured(gathered(boot, self.shifted, self.n_hist), self.u_shifted), self.combine)
        q = F.col("z") * F.col("sigma") + F.col("mu")
        ts = F.make_date(F.col("syn_year") + self.last_year + 1, F.col("month"), F.lit(1))
        return zc.join(self.moments, ["site", "month"]).select("realization", "site", ts.alias("ts"), (F.exp(q) if self.log else q).alias("q"))
