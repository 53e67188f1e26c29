"""Filters, missing data and calendar resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["site"]
#: The label of the period that a day falls in, by frequency.
LABELS = {
    "D": lambda ts: ts,
    "W-SUN": lambda ts: F.next_day(F.date_sub(ts, 1), "SUN"),
    "MS": lambda ts: F.trunc(ts, "month"),
    "M": F.last_day,
    "AS": lambda ts: F.trunc(ts, "year"),
    "A": lambda ts: F.make_date(F.year(ts), F.lit(12), F.lit(31)),
}


def zero_to_null(flow: DataFrame) -> DataFrame:
    return flow.withColumn("q", F.nullif("q", F.lit(0.0)))


def positive(flow: DataFrame) -> DataFrame:
    return flow.where("q > 0")


def sites_without_gaps(flow: DataFrame) -> DataFrame:
    """Sites of which no value is missing."""
    whole = flow.groupBy("site").agg(F.count_if(F.col("q").isNull()).alias("n")).where("n = 0").select("site")
    return flow.join(whole, "site", "left_semi")


def dates_kept(flow: DataFrame, how: str = "any") -> DataFrame:
    """Dates on which no site is missing (how any), or some site is there (how all)."""
    counted = flow.groupBy("ts").agg(F.count("q").alias("n"), F.count("*").alias("m"))
    return flow.join(counted.where("n = m" if how == "any" else "n > 0").select("ts"), "ts", "left_semi")


def log_floor(q: Column, floor: float = 1e-6) -> Column:
    return F.ln(F.greatest(q, F.lit(floor)))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def complete_years(flow: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Years of which every day has a row."""
    w = Window.partitionBy(*by, F.year("ts"))
    return flow.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == F.dayofyear(F.make_date(F.year("ts"), F.lit(12), F.lit(31)))).drop("_n")


def whole_years_of_months(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """The first n // 12 * 12 months of each series (ts, q)."""
    w = Window.partitionBy(*by)
    return monthly.withColumn("_i", F.row_number().over(w.orderBy("ts"))).withColumn("_n", F.count("*").over(w)).where("_i <= floor(_n / 12) * 12").drop("_i", "_n")


def filled(flow: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Gaps take the value before, or else the value after."""
    w = Window.partitionBy(*by).orderBy("ts")
    before = F.last("q", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("q", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return flow.withColumn("q", F.coalesce(before, after))


def between(flow: DataFrame, first: str, last: str) -> DataFrame:
    return flow.where(F.col("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def floored(q: Column, least: Column) -> Column:
    """Negative values become a constant."""
    return F.when(q < 0, least).otherwise(q)


def monthly_totals(flow: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, year, month, q): sums that skip missing days; a month of missing days alone sums to 0."""
    return flow.groupBy(*by, F.year("ts").alias("year"), F.month("ts").alias("month")).agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"))


def resampled(flow: DataFrame, freq: str, agg: str = "sum", by: list[str] = KEYS, fill: bool = False) -> DataFrame:
    """(by, ts, q) by period label. agg is sum or mean; with fill, empty periods between a series' ends sum to 0."""
    if freq not in LABELS or agg not in ("sum", "mean"):
        raise ValueError(f"unknown frequency or aggregate: {freq}, {agg}")
    value = F.coalesce(F.sum("q"), F.lit(0.0)) if agg == "sum" else F.avg("q")
    out = flow.groupBy(*by, LABELS[freq](F.col("ts")).alias("ts")).agg(value.alias("q"))
    if not fill:
        return out
    step = {"D": "1 day", "W-SUN": "7 days", "MS": "1 month", "M": "1 month", "AS": "1 year", "A": "1 year"}[freq]
    begin = "trunc(min(ts), 'month')" if freq == "M" else "trunc(min(ts), 'year')" if freq == "A" else "min(ts)"  # from first days, as month ends differ in length
    spine = out.groupBy(*by).agg(F.explode(F.expr(f"sequence({begin}, max(ts), interval {step})")).alias("ts")).withColumn("ts", LABELS[freq](F.col("ts")))
    return spine.join(out, [*by, "ts"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)) if agg == "sum" else F.col("q"))


def index_gauge(flow: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sum over all sites, by date."""
    return flow.groupBy(*(by or []), "ts").agg(F.sum("q").alias("q"))


def as_matrix(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """One row a year, columns m1 to m12."""
    wide = monthly.groupBy(*by, "year").pivot("month", list(range(1, 13))).agg(F.sum("q"))
    return wide.select(*by, "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def checked_non_negative(flow: DataFrame) -> DataFrame:
    """flow, which raises when read if a value is missing, not finite or negative."""
    bad = F.col("q").isNull() | F.isnan("q") | (F.col("q") < 0) | (F.abs("q") == float("inf"))
    return flow.withColumn("q", F.when(bad, F.raise_error(F.concat(F.lit("bad flow at "), F.col("ts").cast("string"))).cast("double")).otherwise(F.col("q")))
