"""Linear autoregressions with deterministic forecasts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stats import ols_by_series


def numbered(flow: DataFrame) -> DataFrame:
    """(site, t, q): rows of each series by date, from 1."""
    return flow.select("site", F.row_number().over(Window.partitionBy("site").orderBy("ts")).alias("t"), "q")


class AR:
    """q on its `lag` last values, and a trend and seasonal dummies if wanted, one model a site."""

    def __init__(self, lag: int = 1, trend: bool = False, period: int | None = None):
        self.lag, self.trend, self.period = lag, trend, period

    def fit(self, flow: DataFrame) -> AR:
        series = numbered(flow)
        self.params = ols_by_series(series, self.lag, ["site"], self.trend, self.period)
        w = Window.partitionBy("site").orderBy(F.desc("t"))
        self.recent = series.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= self.lag).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("t", "q"))).alias("recent"))
        return self

    def generate(self, steps: int) -> DataFrame:
        """(site, step, q): the next values, without noise."""
        spark = self.recent.sparkSession
        names = [c for c in self.params.columns if c != "site"]
        params = spark.createDataFrame([(r["site"], [float(r[c]) for c in names]) for _, r in self.params.iterrows()], "site string, b array<double>")
        base, seasons = 1 + self.lag, (self.period or 1) - 1

        def step(a, k):
            value = F.get("b", F.lit(0))
            for i in range(1, self.lag + 1):
                value = value + F.get("b", F.lit(i)) * F.get(a, F.size(a) - i)
            t = F.get("recent", F.size("recent") - 1)["t"] + k
            if self.trend:
                value = value + F.get("b", F.lit(base)) * t
            if seasons:
                s = F.pmod(t - 1, F.lit(self.period))
                value = value + F.when(s > 0, F.get("b", F.lit(base + self.trend - 1) + s)).otherwise(0.0)
            return F.concat(a, F.array(value))

        start = F.transform("recent", lambda x: x["q"])
        path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: F.slice(a, self.lag + 1, steps))
        rows = self.recent.join(params, "site").select("site", F.posexplode(path).alias("step", "q"))
        return rows.select("site", (F.col("step") + 1).alias("step"), "q")


class VAR:
    """Each site's value on the last `lag` values of all sites, by least squares; steps are days or months.

    A step counts if all sites have a value then and at the `lag` steps before; the forecast starts from the last such
    step. Only the means and the co-moments of the variables, (sites x lag)^2 numbers at most, reach the driver.
    """

    def __init__(self, lag: int = 1, step: str = "day"):
        self.lag, self.step = lag, step

    def fit(self, flow: DataFrame) -> VAR:
        self.sites = sorted(r.site for r in flow.select("site").distinct().collect())
        n = len(self.sites)
        number = F.unix_date("ts") if self.step == "day" else F.year("ts") * 12 + F.month("ts")
        sums = flow.where("q IS NOT NULL").groupBy(number.alias("t"), "site").agg(F.sum("q").alias("q"))
        rows = sums.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("site", "q"))).alias("_v")).where(F.size("_v") == n).select("t", F.transform("_v", lambda v: v["q"]).alias("_v"))
        # a row goes to its own step and to the `lag` steps after it, where the arrays of all lags meet
        sent = rows.select(F.explode(F.sequence(F.lit(0), F.lit(self.lag))).alias("k"), "t", "_v").select((F.col("t") + F.col("k")).alias("t"), "k", "_v")
        met = sent.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", "_v"))).alias("_l")).where(F.size("_l") == self.lag + 1)
        design = met.select("t", F.flatten(F.transform("_l", lambda x: x["_v"])).alias("_z"))
        mean = {r.i: (r.m, r.t) for r in design.select("t", F.posexplode("_z").alias("i", "z")).groupBy("i").agg(F.avg("z").alias("m"), F.max("t").alias("t")).collect()}
        if not mean:
            raise ValueError(f"no step has values of all sites at {self.lag} steps before")
        m = np.array([mean[i][0] for i in range(n * (self.lag + 1))])
        means = F.array(*[F.lit(float(x)) for x in m])
        first = design.select(F.zip_with("_z", means, lambda z, mu: z - mu).alias("_d")).select("_d", F.posexplode("_d").alias("i", "x"))
        pairs = first.select("i", "x", F.posexplode(F.slice("_d", F.col("i") + 1, F.size("_d"))).alias("j", "y"))
        c = np.zeros((len(m), len(m)))
        for r in pairs.groupBy("i", (F.col("i") + F.col("j")).alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect():
            c[r.i, r.j] = c[r.j, r.i] = r.s
        slopes = np.linalg.lstsq(c[n:, n:], c[n:, :n], rcond=None)[0]
        self.coef = np.vstack([m[:n] - m[n:] @ slopes, slopes])
        # the newest `lag` arrays, newest first, behind a one: the state that a step maps to the next
        self.recent = design.where(F.col("t") == mean[0][1]).select(F.concat(F.array(F.lit(1.0)), F.slice("_z", 1, n * self.lag)).alias("_s"))
        return self

    def generate(self, steps: int, block: int = 128) -> DataFrame:
        """(site, step, q): the next values, without noise.

        A step is a matrix on the state. Blocks of steps start from powers of the matrix of a whole block, so long
        forecasts run in many tasks.
        """
        n, size = len(self.sites), 1 + len(self.sites) * self.lag
        one = np.zeros((size, size))
        one[0, 0] = 1.0
        one[1 : n + 1] = self.coef.T
        one[n + 1 :, 1 : size - n] = np.eye(size - n - 1)
        spark = self.recent.sparkSession
        whole = np.linalg.matrix_power(one, block)
        maps = spark.createDataFrame([(one.tolist(), whole.tolist())], "_one array<array<double>>, _whole array<array<double>>")

        def moved(matrix: str, state: Column) -> Column:
            return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, state, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y))

        blocks = -(-steps // block)
        start = self.recent.crossJoin(maps).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))  # one row by one row
        if blocks > 1:
            start = start.repartition(min(blocks, spark.sparkContext.defaultParallelism), "_b")
        start = start.withColumn("_s", F.aggregate(F.sequence(F.lit(0), F.col("_b")), F.col("_s"), lambda s, k: F.when(k == 0, s).otherwise(moved("_whole", s))))
        path = F.aggregate(
            F.sequence(F.lit(1), F.least(F.lit(block), F.lit(steps) - F.col("_b") * block)),
            F.array("_s"),
            lambda xs, _: F.concat(xs, F.array(moved("_one", F.element_at(xs, -1)))),
        )
        rows = start.select("_b", F.posexplode(path).alias("_k", "_x")).where("_k > 0")
        named = F.arrays_zip(F.array(*[F.lit(x) for x in self.sites]).alias("site"), F.slice("_x", 2, n).alias("q"))
        return rows.select((F.col("_b") * block + F.col("_k")).alias("step"), F.explode(named).alias("_v")).select("_v.site", "step", "_v.q")
