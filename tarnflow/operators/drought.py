"""Drought events in standardised index series (ts, ssi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .windows import rolling_trimmed

KEYS = ["site"]


def events(ssi: DataFrame, by: list[str] = KEYS, critical: float = -1.0, start: str = "first") -> DataFrame:
    """(by, drought_id, start, end, duration, magnitude, severity) of runs of negative values.

    A run counts if it reaches `critical` and ends within the record; a missing value ends a run. start is the run's first
    day, or with "critical" its last day at or below `critical`.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    over = F.coalesce(F.col("ssi") >= 0, F.lit(True)).cast("int")
    marked = ssi.select(*by, "ts", "ssi", F.sum(over).over(w).alias("_g"), F.max(F.when(over == 1, F.col("ts"))).over(Window.partitionBy(*by)).alias("_last"))
    run = marked.where("ssi < 0").groupBy(*by, "_g", "_last").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count("*").alias("duration"),
        F.sum("ssi").alias("magnitude"),
        F.min("ssi").alias("severity"),
        F.max(F.when(F.col("ssi") <= critical, F.col("ts"))).alias("_critical"),
    )
    run = run.where((F.col("severity") <= critical) & (F.col("end") < F.col("_last")))
    number = F.row_number().over(Window.partitionBy(*by).orderBy("end"))
    begun = F.col("start") if start == "first" else F.col("_critical")
    return run.select(*by, number.alias("drought_id"), begun.alias("start"), "end", "duration", "magnitude", "severity")


def events_of_ensemble(ssi: DataFrame, by: list[str]) -> DataFrame:
    """Events with the start rule of ensemble verification."""
    return events(ssi, by, start="critical")


def flow_events(flow: DataFrame, window: int, index, by: list[str]) -> DataFrame:
    """Events of flows: trimmed rolling sums, a standardised index over them (index(sums, by) gives ssi), then events."""
    return events_of_ensemble(index(rolling_trimmed(flow, window, by), by), by)


def hysteresis(ssi: DataFrame, by: list[str] = KEYS, least: int = 3, end_after: int = 3, intensity: float = -0.6) -> DataFrame:
    """(by, start, end, duration, intensity): droughts that begin after `least` negative values and end after `end_after`
    others, where single values of the other kind only set the counters back by one.

    The state machine folds over each series in date order; series are as long as months go.
    """
    series = ssi.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ts", "ssi"))).alias("v"))
    kind = "array<struct<start:int,stop:int>>"
    zero = F.struct(*[F.lit(x).alias(n) for n, x in (("i", 0), ("dry", False), ("start", 0), ("stop", 0), ("pos", 0), ("neg", 0))], F.array().cast(kind).alias("out"))

    def step(a, x):
        i, dry, neg, pos = a["i"], a["dry"], a["neg"], a["pos"]
        low = F.coalesce(x["ssi"] < 0, F.lit(False))
        wet_start = F.when(low & (neg == 0), i).otherwise(a["start"])
        begins = ~dry & low & (neg + 1 >= least)
        pos_wet = F.when(low, F.greatest(pos - 1, F.lit(0))).otherwise(pos + 1)
        neg_wet = F.when(low, neg + 1).otherwise(F.greatest(neg - 1, F.lit(0)))
        long_wet = ~low & (pos_wet > 6)
        stop = F.when(pos == 0, i).otherwise(a["stop"])
        pos_dry = F.when(low, F.greatest(pos - 1, F.lit(0))).otherwise(pos + 1)
        ends = dry & ~low & (pos_dry >= end_after)
        out = F.when(ends, F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), stop.alias("stop"))))).otherwise(a["out"])
        return F.struct(
            (i + 1).alias("i"),
            F.when(dry, ~ends).otherwise(begins).alias("dry"),
            F.when(dry, a["start"]).otherwise(wet_start).alias("start"),
            F.when(dry, stop).otherwise(a["stop"]).alias("stop"),
            F.when(dry, F.when(ends, 0).otherwise(pos_dry)).otherwise(F.when(begins | long_wet, 0).otherwise(pos_wet)).alias("pos"),
            F.when(dry, F.when(ends, 0).otherwise(neg)).otherwise(F.when(begins | long_wet, 0).otherwise(neg_wet)).alias("neg"),
            out.alias("out"),
        )

    def finish(a):
        return F.when(a["dry"], F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["i"].alias("stop"))))).otherwise(a["out"])

    found = series.select(*by, "v", F.explode(F.aggregate("v", zero, step, finish)).alias("e"))
    inside = F.slice("v", F.col("e.start") + 1, F.greatest(F.col("e.stop") - F.col("e.start"), F.lit(0)))
    mean = F.aggregate(inside, F.lit(0.0), lambda a, x: a + x["ssi"]) / F.size(inside)
    out = found.select(*by, F.get("v", F.col("e.start"))["ts"].alias("start"), F.get("v", F.col("e.stop") - 1)["ts"].alias("end"), (F.col("e.stop") - F.col("e.start")).cast("long").alias("duration"), mean.alias("intensity"))
    return out.where(F.col("intensity") < intensity)


def outside(series: DataFrame, spans: DataFrame, by: list[str] = KEYS, bucket: int = 128) -> DataFrame:
    """The rows of series (by, ts, ...) on days that no span (by, start, end; both days inside) covers.

    A span is laid over the buckets of `bucket` days that it touches, so a row meets only spans of its own bucket.
    """
    number = lambda day: F.floor(F.unix_date(day) / bucket)
    laid = spans.where("start <= end").select(*by, "start", "end", F.explode(F.sequence(number(F.col("start")), number(F.col("end")))).alias("_bucket"))
    s, e = series.withColumn("_bucket", number(F.col("ts"))).alias("s"), laid.alias("e")
    same = F.col("s.ts").between(F.col("e.start"), F.col("e.end")) & (F.col("s._bucket") == F.col("e._bucket"))
    for c in by:
        same = same & (F.col(f"s.{c}") == F.col(f"e.{c}"))
    return s.join(e, same, "left_anti").drop("_bucket")


def calm_quartiles(ssi: DataFrame, spans: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, q1, q2, q3) of the index on days outside droughts; a series that is all drought has no row."""
    calm = outside(ssi.where("ssi IS NOT NULL").select(*by, "ts", F.col("ssi").alias("q")), spans, by)
    q = quantiles(calm, [0.25, 0.5, 0.75], by)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("i") == k, F.col("q"))).alias(f"q{k + 1}") for k in range(3)])
