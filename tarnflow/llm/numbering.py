"""Consecutive numbers for the rows of ordered groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def numbered(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df with number, each row's place, from 0, among the rows of its group in the given order, and of, how many these are.

    group must not be null.

    The rows are dealt over ranges of (group, order) and sorted inside them, so a group may span any number of
    partitions; this layout is written once. A row's place is its place in its partition, less that of the group's first
    row there, plus the group's rows in the partitions before: only one count for each partition and group is gathered.
    Rows that tie in `order` are numbered in some order, the same whenever the result is read.
    """
    ranged = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    laid = stored(ranged.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33).cast("int")), "ranges")
    ends = laid.groupBy("_part", group).agg(F.min("_m").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ends.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("of"))
    return laid.join(starts, ["_part", group]).withColumn("number", F.col("_m") + F.col("_shift")).drop("_m", "_part", "_shift")
