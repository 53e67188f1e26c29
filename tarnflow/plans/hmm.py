"""Gaussian hidden Markov model of monthly flows, one for each site."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..operators.recursion import state_path
from ..operators.stats import seasonal_factors
from .base import Generator


def log_density(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd) - 0.5 * np.log(2 * np.pi)


def total(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def baum_welch(x: np.ndarray, states: int, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(start, transition, mean, sd, log-likelihood), states in order of their means. Starts from quantiles of x."""
    n, k = len(x), states
    mu = np.quantile(x, (np.arange(k) + 0.5) / k)
    sd = np.full(k, max(x.std() / k, 1e-3))
    p = np.full((k, k), 0.3 / max(k - 1, 1)) + np.eye(k) * (0.7 - 0.3 / max(k - 1, 1))
    start, before = np.full(k, 1 / k), -np.inf
    floor = max(1e-3 * x.std(), 1e-6)
    for _ in range(rounds):
        b, lp = log_density(x, mu, sd), np.log(np.maximum(p, 1e-300))
        fwd, bwd = np.empty((n, k)), np.zeros((n, k))
        fwd[0] = np.log(np.maximum(start, 1e-300)) + b[0]
        for t in range(1, n):
            fwd[t] = b[t] + total(fwd[t - 1][:, None] + lp, 0)
        for t in range(n - 2, -1, -1):
            bwd[t] = total(lp + b[t + 1] + bwd[t + 1], 1)
        score = float(total(fwd[-1], 0))
        g = np.exp(fwd + bwd - score)
        xi = np.exp(fwd[:-1, :, None] + lp + (b[1:] + bwd[1:])[:, None, :] - score).sum(0)
        start, p = g[0] / g[0].sum(), xi / np.maximum(xi.sum(1, keepdims=True), 1e-300)
        weight = np.maximum(g.sum(0), 1e-300)
        mu = (g * x[:, None]).sum(0) / weight
        sd = np.sqrt((g * (x[:, None] - mu) ** 2).sum(0) / weight).clip(floor)
        if score - before < tolerance:
            break
        before = score
    order = np.argsort(mu)
    return start[order], p[np.ix_(order, order)], mu[order], sd[order], score


def viterbi(x: np.ndarray, start: np.ndarray, p: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    b, lp = log_density(x, mu, sd), np.log(np.maximum(p, 1e-300))
    best, back = np.log(np.maximum(start, 1e-300)) + b[0], np.zeros((len(x), len(mu)), int)
    for t in range(1, len(x)):
        step = best[:, None] + lp
        back[t] = step.argmax(0)
        best = step.max(0) + b[t]
    path = [int(best.argmax())]
    for t in range(len(x) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


class HMMGenerator(Generator):
    """Options: states, rounds, log_transform, deseasonalize (divide by multiplicative monthly factors)."""

    def __init__(self, n_hidden_states: int = 2, max_iter: int = 100, tolerance: float = 1e-8, log_transform: bool = False, deseasonalize: bool = False):
        for name, value, kind in (("n_hidden_states", n_hidden_states, int), ("max_iter", max_iter, int), ("tolerance", tolerance, float)):
            if not isinstance(value, kind):
                raise TypeError(f"{name} must be {kind.__name__}")
        self.k, self.rounds, self.tolerance, self.log, self.season = n_hidden_states, max_iter, tolerance, log_transform, deseasonalize

    def fit(self, monthly: DataFrame) -> HMMGenerator:
        """monthly: (site, ts, q). Missing and non-positive values are left out. A site's series is one group: months are few."""
        x = monthly.where("q > 0").select("site", "ts", "q")
        self.factors = seasonal_factors(x) if self.season else None
        if self.season:
            x = x.withColumn("month", F.month("ts")).join(self.factors, ["site", "month"]).select("site", "ts", (F.col("q") / F.col("factor")).alias("q"))
        x = x.withColumn("q", F.ln("q")) if self.log else x
        k, rounds, tolerance = self.k, self.rounds, self.tolerance

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts")
            v = pdf["q"].to_numpy(float)
            start, p, mu, sd, score = baum_welch(v, k, rounds, tolerance)
            return pd.DataFrame({"site": [pdf["site"].iloc[0]], "first_year": [pd.Timestamp(pdf["ts"].iloc[0]).year], "start": [start.tolist()], "p": [p.tolist()], "mu": [mu.tolist()], "sd": [sd.tolist()], "score": [score], "days": [pdf["ts"].tolist()], "path": [viterbi(v, start, p, mu, sd).tolist()]})

        schema = "site string, first_year int, start array<double>, p array<array<double>>, mu array<double>, sd array<double>, score double, days array<date>, path array<int>"
        self.models = x.groupBy("site").applyInPandas(run, schema).cache()
        self.states = self.models.select("site", F.explode(F.arrays_zip("days", "path")).alias("s")).select("site", F.col("s.days").alias("ts"), F.col("s.path").alias("state"))
        self.is_fitted = True
        return self

    def generate(self, n_realizations: int = 1, n_years: int | None = None, seed: int = 0) -> DataFrame:
        """Monthly (realization, site, ts, q) from the January of the record's first year."""
        self.check_fitted()
        months = 12 * (n_years or 1)
        series = self.models.select("site", "start", "p", F.explode(F.sequence(F.lit(0), F.lit(n_realizations - 1))).alias("realization"))

        def pick(weights, u):
            folded = F.aggregate(weights, F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("s")), lambda a, w: F.struct((a["c"] + w).alias("c"), (a["s"] + F.when(a["c"] + w < u, 1).otherwise(0)).alias("s")))
            return F.least(folded["s"], F.size(weights) - 1)

        steps = series.select("realization", "site", "start", "p", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("t"))
        u = uniform(seed, "hmm", F.col("realization"), F.col("site"), F.col("t"))
        weights = F.when(F.col("t") == 0, F.transform("p", lambda _: F.col("start"))).otherwise(F.col("p"))
        maps = steps.withColumn("u", u).select("realization", "site", "t", F.transform(weights, lambda w: pick(w, F.col("u"))).alias("m"))
        states = state_path(maps, ["realization", "site"], months).join(self.models.select("site", "first_year", "mu", "sd"), "site")
        e = normal(seed, "hmm", F.col("realization"), F.col("site"), F.col("t"))
        paths = states.select("realization", "site", "first_year", "t", (F.get("mu", F.col("s")) + F.get("sd", F.col("s")) * e).alias("x"))
        ts = F.make_date(F.col("first_year") + F.floor(F.col("t") / 12).cast("int"), F.pmod(F.col("t"), F.lit(12)) + 1, F.lit(1))
        out = paths.select("realization", "site", ts.alias("ts"), (F.exp("x") if self.log else F.col("x")).alias("q"))
        if not self.season:
            return out
        return out.withColumn("month", F.month("ts")).join(self.factors, ["site", "month"]).select("realization", "site", "ts", (F.col("q") * F.col("factor")).alias("q"))
