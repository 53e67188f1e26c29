"""Nowak: monthly flows to days, by the daily shape of a near neighbour in the record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.calendar import checked_non_negative
from .base import Generator
from .kirsch import KirschGenerator

#: Days of a profile; a leap February gets its 29th day from the 28th.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def padded(flow: DataFrame, shift: int, pad: str = "edge") -> DataFrame:
    """flow with `shift` days before and after: copies of its ends, or with "wrap" of its other end."""
    ends = flow.groupBy("site").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ahead = ends.select("site", "a", "b", F.explode(F.sequence(F.lit(1), F.lit(shift))).alias("d"))
    before = ahead.select("site", F.date_sub("a", F.col("d")).alias("ts"), (F.col("a") if pad == "edge" else F.date_sub("b", F.col("d") - 1)).alias("at"))
    after = ahead.select("site", F.date_add("b", F.col("d")).alias("ts"), (F.col("b") if pad == "edge" else F.date_add("a", F.col("d") - 1)).alias("at"))
    copies = before.unionByName(after).join(flow.withColumnRenamed("ts", "at"), ["site", "at"]).select("site", "ts", "q")
    return flow.select("site", "ts", "q").unionByName(copies)


def candidate_days(flow: DataFrame, max_shift: int = 7, pad: str = "edge") -> DataFrame:
    """(month, cand, day, site, q): the record's months, each moved by up to max_shift days; windows that lack a day go.

    cand numbers year and shift: y * (2 s + 1) + shift + s, y counting the record's years from 0.
    """
    y0, s = flow.agg(F.min(F.year("ts"))).first()[0], max_shift
    lengths = F.array(*map(F.lit, MONTH_DAYS))
    years = flow.select(F.year("ts").alias("y")).distinct()
    shifts = F.explode(F.sequence(F.lit(-s), F.lit(s)))
    windows = years.select("y", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select("y", "month", shifts.alias("shift"))
    windows = windows.select("month", ((F.col("y") - F.lit(y0)) * (2 * s + 1) + F.col("shift") + s).alias("cand"), F.date_add(F.make_date("y", "month", F.lit(1)), F.col("shift")).alias("start"))
    days = windows.select("month", "cand", "start", F.explode(F.sequence(F.lit(1), F.get(lengths, F.col("month") - 1))).alias("day"))
    days = days.select("month", "cand", "day", F.date_add("start", F.col("day") - 1).alias("ts"))
    out = days.join(padded(flow, s, pad), "ts").select("month", "cand", "day", "site", "q")
    n = F.count("*").over(Window.partitionBy("month", "cand", "site"))
    return out.withColumn("_n", n).where(F.col("_n") == F.get(lengths, F.col("month") - 1)).drop("_n")


def candidate_totals(days: DataFrame) -> DataFrame:
    """(month, cand, total) of the index gauge, the sum over sites."""
    return days.groupBy("month", "cand").agg(F.sum("q").alias("total"))


def profiles(days: DataFrame) -> DataFrame:
    """(month, cand, site, day, p): each site's shares by day; uniform where its total is zero."""
    w = Window.partitionBy("month", "cand", "site")
    share = F.coalesce(F.try_divide(F.col("q"), F.sum("q").over(w)), 1 / F.count("*").over(w))
    clipped = days.select("month", "cand", "site", "day", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("p"))
    return clipped.withColumn("p", F.col("p") / F.sum("p").over(w))


def nearest(totals: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(queries' columns, cand, distance, rank): the k candidates of the same month nearest in total; ties by cand.

    queries: any keys, month, total. Candidates are 15 a year and month: they are gathered into one row a month.
    """
    keys = [c for c in queries.columns if c not in ("total",)]
    library = totals.groupBy("month").agg(F.collect_list(F.struct("cand", F.col("total").alias("c"))).alias("library"))
    near = F.slice(F.array_sort(F.transform("library", lambda x: F.struct(F.abs(x["c"] - F.col("total")).alias("distance"), x["cand"].alias("cand")))), 1, k)
    return queries.join(library, "month").select(*keys, "total", F.posexplode(near).alias("rank", "n")).select(*keys, "total", (F.col("rank") + 1).alias("rank"), "n.cand", "n.distance")


def picked(near: DataFrame, keys: list[str], method: str, seed: int) -> DataFrame:
    """(keys, cand): one neighbour by weights of distance or of rank, drawn from hashed uniforms."""
    if method == "distance_weighted":
        weight = 1 / (F.col("distance") + 1e-10)
    elif method == "lall_and_sharma_1996":
        weight = 1 / F.col("rank").cast("double")
    else:
        raise ValueError(f"unknown sample method: {method}")
    w = Window.partitionBy(*keys)
    cum = near.select(*keys, "cand", "rank", weight.alias("_w")).withColumn("_c", F.sum("_w").over(w.orderBy("rank")) / F.sum("_w").over(w))
    u = uniform(seed, "nowak", *keys)
    return cum.where((F.col("_c") >= u) | (F.col("_c") >= 1 - 1e-12)).groupBy(*keys).agg(F.min_by("cand", "rank").alias("cand"))


def disaggregated(monthly: DataFrame, profile: DataFrame, picks: DataFrame) -> DataFrame:
    """(realization, site, ts, q) by day. All sites use the same candidate; a leap February repeats its last share."""
    daily = monthly.withColumn("month", F.month("ts")).join(picks, ["realization", "ts", "month"]).join(profile, ["month", "cand", "site"])
    leap = (F.col("month") == 2) & (F.dayofmonth(F.last_day("ts")) == 29)
    extra = daily.where(leap & (F.col("day") == 28)).withColumn("day", F.lit(29))
    both = daily.unionByName(extra)
    total = F.sum("p").over(Window.partitionBy("realization", "site", "ts"))
    return both.withColumn("_t", total).select("realization", "site", F.date_add("ts", F.col("day") - 1).alias("ts"), (F.col("q") * F.col("p") / F.col("_t")).alias("q"))


class NowakDisaggregator:
    def __init__(self, n_neighbors: int = 5, max_month_shift: int = 7, pad: str = "edge"):
        self.k, self.shift, self.pad = n_neighbors, max_month_shift, pad

    def fit(self, flow: DataFrame) -> NowakDisaggregator:
        self.sites = {r.site for r in flow.select("site").distinct().collect()}
        days = candidate_days(flow, self.shift, self.pad).cache()
        self.totals, self.profile = candidate_totals(days).cache(), profiles(days).cache()
        return self

    def find_neighbors(self, monthly: DataFrame, n_neighbors: int | None = None) -> DataFrame:
        queries = monthly.groupBy("realization", "ts").agg(F.sum("q").alias("total")).withColumn("month", F.month("ts"))
        return nearest(self.totals, queries, n_neighbors or self.k)

    def disaggregate(self, monthly: DataFrame, n_neighbors: int | None = None, sample_method: str = "distance_weighted", seed: int = 0) -> DataFrame:
        monthly = monthly.cache()  # read by the check, the search and the product
        if {r.site for r in monthly.select("site").distinct().collect()} != self.sites:
            raise ValueError("the monthly flows must have the fitted sites")
        picks = picked(self.find_neighbors(monthly, n_neighbors), ["realization", "ts", "month"], sample_method, seed)
        return checked_non_negative(disaggregated(monthly, self.profile, picks))


class KirschNowakGenerator(Generator):
    def __init__(self, n_neighbors: int = 5, max_month_shift: int = 7, **kirsch):
        self.kirsch, self.nowak = KirschGenerator(**kirsch), NowakDisaggregator(n_neighbors, max_month_shift)

    def fit(self, flow: DataFrame) -> KirschNowakGenerator:
        self.kirsch.fit(flow)
        self.nowak.fit(flow)
        self.is_fitted = True
        return self

    def generate(self, n_realizations: int = 1, n_years: int | None = 1, seed: int = 0) -> DataFrame:
        self.check_fitted()
        return self.nowak.disaggregate(self.kirsch.generate(n_realizations, n_years, seed), seed=seed)
