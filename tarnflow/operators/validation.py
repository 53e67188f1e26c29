"""Validation of an ensemble against history, period by period, in real and log space: the tables behind the surveyed figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_sf, norm_cdf
from . import stats

GROUP = ["site", "period", "space"]
#: Year and period of a date. Weeks belong to the year that ISO 8601 gives them.
SCALES = {
    "monthly": (F.year, F.month),
    "weekly": (lambda ts: F.date_part(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear),
}


def period_sums(flow: DataFrame, scale: str, by: list[str] = stats.KEYS) -> DataFrame:
    """(by, year, period, q): sums by month or week; missing days are skipped, a period of missing days alone is missing."""
    if scale not in SCALES:
        raise ValueError(f"unknown scale: {scale}")
    year, period = SCALES[scale]
    return flow.groupBy(*by, year(F.col("ts")).alias("year"), period(F.col("ts")).alias("period")).agg(F.sum("q").alias("q"))


def in_spaces(sums: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Every row twice, with space real and log; logarithms are of values raised to the floor. Missing values are left out."""
    both = F.array(F.struct(F.lit("real").alias("space"), F.col("q")), F.struct(F.lit("log").alias("space"), F.log(F.greatest("q", F.lit(floor))).alias("q")))
    rest = [c for c in sums.columns if c != "q"]
    return sums.where("q IS NOT NULL").select(*rest, F.explode(both).alias("_s")).select(*rest, "_s.space", "_s.q")


def compared(history: DataFrame, members: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(site, period, space, sample, n, q1, q2, q3, low, high, rank_sum_p, levene_p): history and ensemble, a row each.

    history is (site, year, period, q) and members (realization, site, year, period, q); all years and realizations of a
    period are one sample. Periods that only one of them has are left out. The p-values, Wilcoxon's and Levene's, are of
    the two samples and stand on both rows; Levene's is null where no sample varies.
    """
    stacked = history.select("site", "period", "q", F.lit("history").alias("sample")).unionByName(members.select("site", "period", "q", F.lit("ensemble").alias("sample")))
    spaced = in_spaces(stacked, floor)
    shared = spaced.groupBy(*GROUP).agg(F.min("sample").alias("a"), F.max("sample").alias("b")).where("a < b").drop("a", "b")
    x = spaced.join(shared, GROUP)
    boxes = stats.box_stats(x, [*GROUP, "sample"]).join(x.groupBy(*GROUP, "sample").agg(F.count("*").alias("n")), [*GROUP, "sample"])
    ranks = stats.rank_sum(x, "sample", "history", GROUP).select(*GROUP, (2 * norm_cdf(-F.abs("z"))).alias("rank_sum_p"))
    spread = stats.levene(x, "sample", GROUP)
    ratio: Column = f_sf(F.col("w"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    tests = ranks.join(spread.select(*GROUP, F.when(F.col("w").isNotNull(), ratio).alias("levene_p")), GROUP)
    return boxes.join(tests, GROUP).select(*GROUP, "sample", "n", "q1", "q2", "q3", "low", "high", "rank_sum_p", "levene_p")


def moment_boxes(members: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(site, period, space, moment, q1, q2, q3, low, high): how the mean and sd over realizations vary from year to year.

    sd is the population's. Logarithms are taken of the flows, ahead of the moments, for whatever is passed: history that
    has been resampled (`ensemble.resampled_history`) is treated as the ensemble is.
    """
    yearly = in_spaces(members, floor).groupBy(*GROUP, "year").agg(F.avg("q").alias("mean"), F.stddev_pop("q").alias("sd"))
    return stats.box_stats(yearly.unpivot([*GROUP, "year"], ["mean", "sd"], "moment", "q"), [*GROUP, "moment"])
