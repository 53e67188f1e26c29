"""Rolling windows, lags and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["site"]


def rolling(flow: DataFrame, window: int, agg: str = "sum", by: list[str] = KEYS, forward: bool = False) -> DataFrame:
    """(by, ts, q): trailing (or forward) aggregates of whole windows; a window with a missing value gives no row."""
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(*((0, window - 1) if forward else (1 - window, 0)))
    value = F.sum("q") if agg == "sum" else F.avg("q")
    return flow.select(*by, "ts", value.over(w).alias("_v"), F.count("q").over(w).alias("_n")).where(F.col("_n") == window).select(*by, "ts", F.col("_v").alias("q"))


def rolling_trimmed(flow: DataFrame, window: int, by: list[str] = KEYS) -> DataFrame:
    """Trailing sums without the first and the last `window` of their rows."""
    sums = rolling(flow, window, by=by)
    w = Window.partitionBy(*by)
    ranked = sums.withColumn("_i", F.row_number().over(w.orderBy("ts"))).withColumn("_n", F.count("*").over(w))
    return ranked.where((F.col("_i") > 1) & (F.col("_i") <= F.col("_n") - window)).drop("_i", "_n")


def rolling_days(flow: DataFrame, days: int, by: list[str] = KEYS) -> DataFrame:
    """Means over the trailing `days` calendar days."""
    w = Window.partitionBy(*by).orderBy(F.unix_date("ts")).rangeBetween(1 - days, 0)
    return flow.select(*by, "ts", F.avg("q").over(w).alias("q"))


def normal_scores(train: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """(values' columns, cdf): how many training values are below, plus a half, over their number, within `by`.

    Training values and values are ranked together in one window, so nothing is joined pair by pair.
    """
    keys = [*by, "q"]
    below = (
        train.groupBy(*keys).agg(F.count("*").alias("_t"))
        .unionByName(values.select(*keys).distinct().withColumn("_t", F.lit(0).cast("long")))
        .groupBy(*keys).agg(F.sum("_t").alias("_t"))
    )
    w = Window.partitionBy(*by).orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    counted = below.withColumn("_below", F.coalesce(F.sum("_t").over(w), F.lit(0))).withColumn("_n", F.sum("_t").over(Window.partitionBy(*by)))
    return values.join(counted.select(*keys, "_below", "_n"), keys, "left").withColumn("cdf", (F.col("_below") + 0.5) / F.col("_n")).drop("_below", "_n")
