"""Flows as they arrive: calendar totals with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_totals(readings: DataFrame, period: str = "1 day", late: str = "2 days") -> DataFrame:
    """(site, start, q, n) of tumbling periods over a stream (site, ts timestamp, q); readings later than `late` are left out.

    The state is one sum a site and open period: it is bounded by the watermark, not by the stream.
    """
    held = readings.withWatermark("ts", late)
    sums = held.groupBy("site", F.window("ts", period)).agg(F.sum("q").alias("q"), F.count("q").alias("n"))
    return sums.select("site", F.col("window.start").alias("start"), "q", "n")
