"""Exact quantiles of groups of any size, by counting passes, and interpolation between ordered points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Groups (and ranges of values) of so many values are sorted in one buffer; larger ones are narrowed by counting first.
SMALL, BINS = 100_000, 1024


def quantiles(values: DataFrame, p: list[float], by: list[str], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(by, i, p, q): the quantiles p of q in each group, linearly interpolated, as `percentile` gives them.

    No buffer grows with a group. A group's range of values is cut into equal bins that are counted (`bins` rows a group and
    task, summed before the shuffle); the bins that hold a wanted rank are narrowed in the next pass, between their own
    least and greatest value, until they hold one value or at most `small`, which are sorted. Passes read the values again;
    most data need one or two. Missing values are left out, groups without values too. Keys must not be null.
    """
    values = values.where("q IS NOT NULL").select(*by, "q")
    sizes = stored(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi")), "sizes")
    points = F.array(*map(F.lit, p))
    few = values.join(sizes.where(F.col("n") <= small).select(*by), by, "left_semi").groupBy(*by).agg(F.percentile("q", points).alias("v"))
    small_ones = few.select(*by, F.posexplode("v").alias("i", "q"))
    out = small_ones
    large = sizes.where(F.col("n") > small)
    if not large.isEmpty():
        out = out.unionByName(_selected(values, large, p, by, small, bins))
    return out.select(*by, "i", F.get(points, F.col("i")).alias("p"), "q")


def _selected(values: DataFrame, groups: DataFrame, p: list[float], by: list[str], small: int, bins: int) -> DataFrame:
    """(by, i, q) of groups (by, n, lo, hi), by narrowing ranges of values."""
    at = F.transform(F.array(*map(F.lit, p)), lambda x: x * (F.col("n") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda h: F.array(F.floor(h), F.ceil(h)))))
    path = [*by, "_id"]
    open_ = groups.select(*by, F.lit("").alias("_id"), "lo", "hi", F.lit(0).cast("long").alias("below"), ranks.alias("ranks"))
    live = values.withColumn("_id", F.lit(""))
    found = []
    while True:
        span = F.col("hi") / 2 - F.col("lo") / 2  # halved, so that it is finite
        share = F.floor(F.try_divide(F.col("q") / 2 - F.col("lo") / 2, span) * bins).cast("int")
        bin_ = F.when(span > 0, F.least(share, F.lit(bins - 1))).otherwise((F.col("q") > F.col("lo")).cast("int"))  # a least and a greatest value always part
        live = live.join(open_.select(*path, "lo", "hi"), path).where("q BETWEEN lo AND hi").select(*path, "q", bin_.alias("_bin"))
        counts = live.groupBy(*path, "_bin").agg(F.count("*").alias("c"), F.min("q").alias("lo"), F.max("q").alias("hi")).join(open_.select(*path, "below", "ranks"), path)
        w = Window.partitionBy(*path).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("c").over(w), F.lit(0)))
        inside = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c")))
        hit = stored(counts.withColumn("ranks", inside).where(F.size("ranks") > 0), "bins")
        found.append(hit.where("lo = hi").select(*by, F.explode("ranks").alias("rank"), F.col("lo").alias("q")))
        few = hit.where((F.col("lo") < F.col("hi")) & (F.col("c") <= small))
        runs = live.join(few.select(*path, "_bin", "below", "ranks"), [*path, "_bin"]).groupBy(*path, "_bin").agg(F.sort_array(F.collect_list("q")).alias("v"), F.first("below").alias("below"), F.first("ranks").alias("ranks"))
        picked = F.explode(F.transform("ranks", lambda r: F.struct(r.alias("rank"), F.get("v", (r - F.col("below")).cast("int")).alias("q"))))
        found.append(runs.select(*by, picked.alias("x")).select(*by, "x.rank", "x.q"))
        deeper = F.concat_ws(".", "_id", "_bin")
        open_ = hit.where((F.col("lo") < F.col("hi")) & (F.col("c") > small)).withColumn("_id", deeper)
        if open_.isEmpty():
            break
        live = live.withColumn("_id", deeper)
    held = reduce(DataFrame.unionByName, found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "q"))).alias("m"))
    asked = groups.join(held, by).select(*by, "m", F.posexplode(at).alias("i", "h"))
    low, high = F.element_at("m", F.floor("h")), F.element_at("m", F.ceil("h"))
    between = (F.ceil("h") - F.col("h")) * low + (F.col("h") - F.floor("h")) * high
    return asked.select(*by, "i", F.when((F.floor("h") == F.ceil("h")) | (low == high), low).otherwise(between).alias("q"))


def interpolated(points: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, x, ...) with y, linear between the points (by, x, y) around x; beyond the ends the end's y.

    Points and questions are merged in one ordered scan a group, so each question meets its two neighbours only. Of
    points that share an x the greatest y counts. A group without points gives null, and so does a null x.
    """
    knots = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "x").agg(F.max("y").alias("y"))
    both = knots.select(*by, "x", F.struct("x", "y").alias("_k")).unionByName(asked, allowMissingColumns=True).withColumn("_asked", F.col("_k").isNull())
    w = Window.partitionBy(*by).orderBy("x")
    before = F.last("_k", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumn("_a", F.coalesce(before, after)).withColumn("_b", F.coalesce(after, before)).where("_asked")
    x0, y0, x1, y1 = (F.col(c) for c in ("_a.x", "_a.y", "_b.x", "_b.y"))
    y = F.when(x1 > x0, y0 + (y1 - y0) * (F.col("x") - x0) / (x1 - x0)).otherwise(y0)
    return met.select(*asked.columns, F.when(F.col("x").isNotNull(), y).alias("y"))


def plotting_positions(flow: DataFrame, by: list[str]) -> DataFrame:
    """(by, x, y): the values y of each group in order at x = rank / (n + 1), points of the inverse distribution function."""
    w = Window.partitionBy(*by)
    return flow.where("q IS NOT NULL").select(*by, (F.row_number().over(w.orderBy("q")) / (F.count("*").over(w) + 1)).alias("x"), F.col("q").alias("y"))


def inverse_ecdf(flow: DataFrame, asked: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """asked (by, p, ...) with q, the value of that probability in flow (by, q), linear between plotting positions."""
    got = interpolated(plotting_positions(flow, by), asked.withColumnRenamed(p, "x"), by)
    return got.withColumnRenamed("x", p).withColumnRenamed("y", "q")
