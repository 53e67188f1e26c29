"""Moments, correlations, quantiles and tests on flows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

KEYS = ["site"]
SEASONS = {"dayofyear": F.dayofyear, "week": F.weekofyear, "month": F.month}


def monthly_moments(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, month, mu, sigma): mean and sample standard deviation of each calendar month."""
    return monthly.groupBy(*by, "month").agg(F.avg("q").alias("mu"), F.stddev_samp("q").alias("sigma"))


def monthly_population_moments(monthly: DataFrame) -> DataFrame:
    """(site, month, mu, sigma_pop) over all years and realizations."""
    return monthly.groupBy("site", "month").agg(F.avg("q").alias("mu"), F.stddev_pop("q").alias("sigma_pop"))


def standardized(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, year, month, z) with the moments of each calendar month."""
    w = Window.partitionBy(*by, "month")
    return monthly.select(*by, "year", "month", ((F.col("q") - F.avg("q").over(w)) / F.stddev_samp("q").over(w)).alias("z"))


def month_correlations(z: DataFrame, by: list[str] = KEYS, year: str = "hist_idx") -> DataFrame:
    """(by, m1, m2, r): correlations between the calendar months of the same year."""
    a = z.select(*by, year, F.col("month").alias("m1"), F.col("z").alias("x"))
    b = z.select(*by, year, F.col("month").alias("m2"), F.col("z").alias("y"))
    return a.join(b, [*by, year]).groupBy(*by, "m1", "m2").agg(F.corr("x", "y").alias("r"))


def site_pairs(flow: DataFrame, itself: bool) -> DataFrame:
    """(ts, site1, site2, x, y) for the pairs of sites in name order (with themselves, if wanted) that share a date.

    A date's values travel once, as one array, and the upper triangle is made of it where it stands; the sums by pair that
    follow are combined before they are sent. Dates, not pairs, are shuffled.
    """
    rows = flow.groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("site", "q"))).alias("_v"))
    first = rows.select("ts", "_v", F.posexplode("_v").alias("_i", "_a"))
    second = F.explode(F.slice("_v", F.col("_i") + (1 if itself else 2), F.size("_v")))
    pairs = first.select("ts", "_a", second.alias("_b"))
    return pairs.select("ts", F.col("_a.site").alias("site1"), F.col("_b.site").alias("site2"), F.col("_a.q").alias("x"), F.col("_b.q").alias("y"))


def site_correlations(flow: DataFrame) -> DataFrame:
    """(site1, site2, r) for all ordered pairs of sites, over their common dates."""
    half = site_pairs(flow, True).groupBy("site1", "site2").agg(F.corr("x", "y").alias("r"))
    turned = F.when(F.col("site1") == F.col("site2"), F.array(F.struct("site1", "site2"))).otherwise(F.array(F.struct("site1", "site2"), F.struct(F.col("site2").alias("site1"), F.col("site1").alias("site2"))))
    return half.select(F.explode(turned).alias("_p"), "r").select("_p.site1", "_p.site2", "r")


def site_dispersions(ssi: DataFrame) -> DataFrame:
    """(site1, site2, dispersion): summed squared differences for each pair of sites in name order."""
    return site_pairs(ssi, False).groupBy("site1", "site2").agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("dispersion"))


def autocorrelation(flow: DataFrame, lags: list[int], by: list[str] = KEYS) -> DataFrame:
    """(by, lag, n, r, low, high): Pearson's r between a series and itself lag rows on, and its 95 % interval by Fisher's z."""
    w = Window.partitionBy(*by).orderBy("ts")
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("q", k).over(w).alias("y")) for k in lags])
    long = flow.select(*by, F.col("q").alias("x"), pairs.alias("pairs")).select(*by, "x", F.explode("pairs").alias("p")).select(*by, "x", "p.lag", "p.y").where("x IS NOT NULL AND y IS NOT NULL")
    out = long.groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    half = 1.959963984540054 / F.sqrt(F.col("n") - 3)
    return out.withColumn("low", F.tanh(F.atanh("r") - half)).withColumn("high", F.tanh(F.atanh("r") + half))


def probabilities(n: int = 50, low: float = 0.0001, high: float = 0.9999) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def flow_duration(flow: DataFrame, p: list[float], by: list[str] = KEYS) -> DataFrame:
    """(by, i, p, q): exact quantiles, linearly interpolated; a series may be of any length."""
    return quantiles(flow, p, by)


def annual_duration_envelope(flow: DataFrame, p: list[float], by: list[str] = KEYS) -> DataFrame:
    """(by, i, low, high): the range of the yearly curves, over years and realizations."""
    series = [*by, *[c for c in ("realization",) if c in flow.columns and c not in by], "year"]
    yearly = flow_duration(flow.withColumn("year", F.year("ts")), p, series)
    return yearly.groupBy(*by, "i").agg(F.min("q").alias("low"), F.max("q").alias("high"))


def flow_ranges(flow: DataFrame, season: str, by: list[str] = KEYS) -> DataFrame:
    """(by, period, low, middle, high) by day of year, ISO week or month.

    For an ensemble the middle is the median of the realizations' medians.
    """
    keyed = flow.withColumn("period", SEASONS[season](F.col("ts")))
    if "realization" in flow.columns:
        keyed = keyed.groupBy(*by, "period", "realization").agg(F.min("q").alias("low"), F.median("q").alias("middle"), F.max("q").alias("high"))
        return keyed.groupBy(*by, "period").agg(F.min("low").alias("low"), F.median("middle").alias("middle"), F.max("high").alias("high"))
    return keyed.groupBy(*by, "period").agg(F.min("q").alias("low"), F.median("q").alias("middle"), F.max("q").alias("high"))


def l_moments(flow: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, n, l1, l2, l3, t3): sample L-moments from probability-weighted moments."""
    w = Window.partitionBy(*by).orderBy("q")
    i = F.col("i").cast("double")
    ranked = flow.where("q IS NOT NULL").select(*by, "q", (F.row_number().over(w) - 1).alias("i"))
    b = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg("q").alias("b0"), F.sum(i * F.col("q")).alias("s1"), F.sum(i * (i - 1) * F.col("q")).alias("s2"))
    n = F.col("n").cast("double")
    b = b.withColumn("b1", F.col("s1") / (n * (n - 1))).withColumn("b2", F.try_divide(F.col("s2"), n * (n - 1) * (n - 2)))
    b = b.select(*by, "n", F.col("b0").alias("l1"), (2 * F.col("b1") - F.col("b0")).alias("l2"), (6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")).alias("l3"))
    return b.withColumn("t3", F.try_divide("l3", "l2"))


def box_stats(flow: DataFrame, by: list[str]) -> DataFrame:
    """(by, q1, q2, q3, low, high): quartiles, and the furthest values within 1.5 interquartile ranges of them."""
    q = flow.groupBy(*by).agg(F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"))
    q = q.select(*by, *[F.get("p", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.col("q").between(F.col("q1") - reach, F.col("q3") + reach)
    return flow.join(q, by).groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(near, F.col("q"))).alias("low"), F.max(F.when(near, F.col("q"))).alias("high"))


def _rank_sums(flow: DataFrame, first: Column, by: list[str]) -> DataFrame:
    rank = F.rank().over(Window.partitionBy(*by).orderBy("q")) + (F.count("*").over(Window.partitionBy(*by, "q")) - 1) / 2
    ranked = flow.where("q IS NOT NULL").withColumn("_r", rank).withColumn("_one", first.cast("int"))
    s = ranked.groupBy(*by).agg(F.sum("_one").alias("n1"), F.sum(1 - F.col("_one")).alias("n2"), F.sum(F.col("_r") * F.col("_one")).alias("s"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    return s.select(*by, "n1", "n2", F.try_divide(F.col("s") - n1 * (n1 + n2 + 1) / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)).alias("z"))


def rank_sum(flow: DataFrame, sample: str, first: str, by: list[str]) -> DataFrame:
    """(by, n1, n2, z): Wilcoxon's rank-sum statistic of the sample named `first` against the rest; ties get mean ranks."""
    return _rank_sums(flow, F.col(sample) == first, by)


def rank_sum_pairs(flow: DataFrame, sample: str, by: list[str]) -> DataFrame:
    """(by, first, second, n1, n2, z): the statistic for each pair of samples, in name order.

    Every row goes to the pairs that its sample is part of; the names of a group's samples travel as one array.
    """
    names = flow.where("q IS NOT NULL").groupBy(*by).agg(F.collect_set(sample).alias("_names"))
    other = F.explode(F.array_remove("_names", F.col(sample)))
    both = flow.join(names, by).withColumn("_other", other).withColumn("first", F.least(sample, "_other")).withColumn("second", F.greatest(sample, "_other"))
    return _rank_sums(both, F.col(sample) == F.col("first"), [*by, "first", "second"])


def levene(flow: DataFrame, sample: str, by: list[str]) -> DataFrame:
    """(by, k, n, w): Levene's statistic about the samples' medians; its p-value is f_sf(w, k - 1, n - k). Null where no sample varies."""
    centre = flow.groupBy(*by, sample).agg(F.median("q").alias("_m"))
    d = flow.join(centre, [*by, sample]).withColumn("_d", F.abs(F.col("q") - F.col("_m")))
    groups = d.groupBy(*by, sample).agg(F.count("_d").alias("c"), F.avg("_d").alias("a"), F.sum(F.col("_d") * F.col("_d")).alias("s"))
    g = groups.groupBy(*by).agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("a")).alias("t"), F.sum(F.col("c") * F.col("a") * F.col("a")).alias("b"), F.sum("s").alias("s"))
    among, within = F.col("b") - F.col("t") * F.col("t") / F.col("n"), F.col("s") - F.col("b")
    return g.select(*by, "k", "n", F.try_divide(F.try_divide(F.col("n") - F.col("k"), F.col("k") - 1) * among, within).alias("w"))


def histogram(flow: DataFrame, bins: int, by: list[str] = KEYS) -> DataFrame:
    """(by, bin, low, density): a density histogram over each series' range, bins from 1."""
    ends = flow.where("q IS NOT NULL").groupBy(*by).agg(F.min("q").alias("a"), F.max("q").alias("b"), F.count("*").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.least(F.floor((F.col("q") - F.col("a")) / width).cast("int") + 1, F.lit(bins))
    counted = flow.where("q IS NOT NULL").join(ends, by).where("b > a").groupBy(*by, at.alias("bin"), "a", "b", "n").agg(F.count("*").alias("c"))
    return counted.select(*by, "bin", (F.col("a") + width * (F.col("bin") - 1)).alias("low"), (F.col("c") / (F.col("n") * width)).alias("density"))


def kernel_density(flow: DataFrame, points: int, by: list[str] = KEYS) -> DataFrame:
    """(by, x, density): Gaussian kernels with Scott's bandwidth, on a grid over each series' range."""
    ends = flow.where("q IS NOT NULL").groupBy(*by).agg(F.min("q").alias("a"), F.max("q").alias("b"), F.count("*").alias("n"), F.stddev_samp("q").alias("s"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (points - 1))
    h = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    rows = flow.where("q IS NOT NULL").join(ends.withColumn("h", h), by).select(*by, "q", "h", "n", F.explode(grid).alias("x"))
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("q")) / F.col("h"), 2)) / (F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return rows.groupBy(*by, "x").agg((F.sum(kernel) / F.first("n")).alias("density"))


def binned_density(flow: DataFrame, points: int, bins: int = 400, by: list[str] = KEYS) -> DataFrame:
    """(by, x, density): as `kernel_density`, from counts on a grid of `bins` steps, for series of any length.

    Each value gives its two neighbours on the grid shares by its distance to them (linear binning); kernels then run over
    the grid, bins x points terms a series, so the rows meet no grid point but those two. The error is of the order of the
    squared ratio of a step to the bandwidth. A series of one value, or of equal ones, has no density.
    """
    some = flow.where("q IS NOT NULL")
    ends = some.groupBy(*by).agg(F.min("q").alias("a"), F.max("q").alias("b"), F.count("*").alias("n"), F.stddev_samp("q").alias("s")).where("b > a")
    ends = ends.withColumn("h", F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).withColumn("d", (F.col("b") - F.col("a")) / bins)
    at = (F.col("q") - F.col("a")) / F.col("d")
    left = F.least(F.floor(at), F.lit(bins - 1)).cast("int")
    placed = some.join(ends, by).select(*by, at.alias("_at"), left.alias("_k"))
    sums = placed.groupBy(*by, "_k").agg(F.sum(F.col("_k") + 1 - F.col("_at")).alias("_l"), F.sum(F.col("_at") - F.col("_k")).alias("_r"))
    shares = F.explode(F.array(F.struct(F.col("_k").alias("k"), F.col("_l").alias("w")), F.struct((F.col("_k") + 1).alias("k"), F.col("_r").alias("w"))))
    grid = sums.select(*by, shares.alias("_g")).groupBy(*by, F.col("_g.k").alias("k")).agg(F.sum("_g.w").alias("w"))
    weights = grid.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("_g")).join(ends, by)  # bins + 1 entries at most
    x = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a") + (F.col("b") - F.col("a")) * i / (points - 1))
    each = weights.select(*by, "_g", "a", "d", "h", "n", F.explode(x).alias("x"))
    z = lambda g: (F.col("x") - F.col("a") - g["k"] * F.col("d")) / F.col("h")
    total = F.aggregate("_g", F.lit(0.0), lambda acc, g: acc + g["w"] * F.exp(-0.5 * z(g) * z(g)))
    return each.select(*by, "x", (total / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def stationary(transition: Column, doublings: int = 40) -> Column:
    """The distribution that a transition matrix (rows of probabilities) keeps.

    The chain that stays where it is every other step keeps the same one and always settles; it is squared `doublings` times.
    Where several distributions are kept, the one reached from the first state is given.
    """

    def squared(m: Column) -> Column:
        columns = F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))
        dot = lambda row, column: F.aggregate(F.zip_with(row, column, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
        return F.transform(m, lambda row: F.transform(columns, lambda column: dot(row, column)))

    def rescaled(m: Column) -> Column:
        return F.transform(m, lambda row: F.transform(row, lambda v: v / F.aggregate(row, F.lit(0.0), lambda s, x: s + x)))

    lazy = F.transform(transition, lambda row, i: F.transform(row, lambda v, j: v / 2 + F.when(i == j, 0.5).otherwise(0.0)))
    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(doublings)), lazy, lambda m, _: rescaled(squared(m))), F.lit(0))


def transitions(states: DataFrame, n: int, by: list[str] = KEYS) -> DataFrame:
    """(by, p): the matrix of shares of moves between the states 0 to n - 1 of (by, ts, state); a state never left stays."""
    w = Window.partitionBy(*by).orderBy("ts")
    moves = states.select(*by, F.col("state").alias("i"), F.lead("state").over(w).alias("j")).where("i IS NOT NULL AND j IS NOT NULL")
    cells = [F.count_if((F.col("i") == i) & (F.col("j") == j)).alias(f"c{i}_{j}") for i in range(n) for j in range(n)]
    counted = moves.groupBy(*by).agg(*cells)

    def row(i: int) -> Column:
        total = sum((F.col(f"c{i}_{j}") for j in range(1, n)), F.col(f"c{i}_0"))
        return F.array(*[F.when(total > 0, F.col(f"c{i}_{j}") / total).otherwise(float(i == j)) for j in range(n)])

    return counted.select(*by, F.array(*map(row, range(n))).alias("p"))


def mixture_density(parts: DataFrame, points: int, by: list[str] = KEYS, reach: float = 4.0) -> DataFrame:
    """(by, x, density): the mixture of the normal distributions of parts (by, weights, mu, sd: arrays), on a grid that
    covers all of them `reach` standard deviations wide. Parts without spread are left out."""
    low = F.array_min(F.zip_with("mu", "sd", lambda m, s: m - reach * s))
    high = F.array_max(F.zip_with("mu", "sd", lambda m, s: m + reach * s))
    grid = parts.select(*by, F.filter(F.arrays_zip("weights", "mu", "sd"), lambda k: k["sd"] > 0).alias("_k"), low.alias("_a"), high.alias("_b"))
    x = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("_a") + (F.col("_b") - F.col("_a")) * i / (points - 1)))
    term = lambda k: k["weights"] * F.exp(-0.5 * F.pow((F.col("x") - k["mu"]) / k["sd"], 2)) / (k["sd"] * math.sqrt(2 * math.pi))
    return grid.select(*by, "_k", x.alias("x")).select(*by, "x", F.aggregate("_k", F.lit(0.0), lambda s, k: s + term(k)).alias("density"))


def deseasonalized(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """z scores by calendar month, as `standardized`."""
    return standardized(monthly, by)


def detrended(series: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, t, q): q less its least-squares line over t."""
    line = series.groupBy(*by).agg(F.regr_slope("q", "t").alias("b"), F.regr_intercept("q", "t").alias("a"))
    return series.join(line, by).select(*by, "t", (F.col("q") - F.col("a") - F.col("b") * F.col("t")).alias("q"))


def seasonal_factors(monthly: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, month, factor): multiplicative factors of (by, ts, q) from ratios to a centred 2 x 12 moving average, mean 1."""
    w = Window.partitionBy(*by).orderBy("ts")
    centred = (F.sum("q").over(w.rowsBetween(-6, 5)) + F.sum("q").over(w.rowsBetween(-5, 6))) / 24
    whole = F.count("q").over(w.rowsBetween(-6, 6)) == 13
    ratio = monthly.select(*by, F.month("ts").alias("month"), F.when(whole, F.col("q") / centred).alias("r"))
    means = ratio.groupBy(*by, "month").agg(F.avg("r").alias("m"))
    return means.select(*by, "month", (F.col("m") / F.avg("m").over(Window.partitionBy(*by))).alias("factor"))


def ols_by_series(series: DataFrame, lags: int, by: list[str] = KEYS, trend: bool = False, period: int | None = None) -> pd.DataFrame:
    """Coefficients of q on its lags (and a trend, and seasonal dummies), one row a series.

    Spark sums products of deviations from the means, for raw products of large flows are all but collinear with the
    constant; only these (lags + ...)^2 sums a series reach the driver, where they are scaled before they are solved.
    """
    import numpy as np

    w = Window.partitionBy(*by).orderBy("t")
    names = [f"lag{k}" for k in range(1, lags + 1)]
    terms: list[Column] = [F.lag(F.col("q").cast("double"), k).over(w) for k in range(1, lags + 1)]
    if trend:
        names.append("trend")
        terms.append(F.row_number().over(w).cast("double"))
    for s in range(1, period or 1):
        names.append(f"season{s}")
        terms.append((F.pmod(F.row_number().over(w) - 1, F.lit(period)) == s).cast("double"))
    design = series.select(*by, F.col("q").cast("double").alias("_y"), *[x.alias(n) for x, n in zip(terms, names)]).na.drop(subset=["_y", *names])
    all_ = Window.partitionBy(*by)
    means = [F.avg(c).over(all_).alias(f"_m_{c}") for c in ("_y", *names)]
    apart = {c: F.col(c) - F.col(f"_m_{c}") for c in ("_y", *names)}
    sums = [F.sum(apart[a] * apart[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j <= i]
    sums += [F.sum(apart[a] * apart["_y"]).alias(f"y{i}") for i, a in enumerate(names)]
    rows = design.select("*", *means).groupBy(*by).agg(*sums, *[F.first(f"_m_{c}").alias(f"_m_{c}") for c in ("_y", *names)]).collect()
    out = []
    for r in rows:
        xx = np.array([[r[f"{max(i, j)}_{min(i, j)}"] for j in range(len(names))] for i in range(len(names))]).reshape(len(names), len(names))
        xy = np.array([r[f"y{i}"] for i in range(len(names))])
        scale = np.sqrt(np.diag(xx))
        scale[scale == 0] = 1.0
        slopes = np.linalg.lstsq(xx / np.outer(scale, scale), xy / scale, rcond=None)[0] / scale
        const = r["_m__y"] - sum(b * r[f"_m_{c}"] for b, c in zip(slopes, names))
        out.append([*[r[k] for k in by], const, *slopes])
    return pd.DataFrame(out, columns=[*by, "const", *names])
