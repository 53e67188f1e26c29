"""Registered queries on flows derived from the test tables, each with the same query as DuckDB SQL where SQL can say it.

Flows: daily l_quantity by line number (site L1 to L7) or by return flag; an ensemble with the line number as realization.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rng import normal, uniform
from .operators import calendar as cal
from .operators import drought, ensemble, quantiles, ssi, stats, validation, windows
from .plans import autoregression, hmm, kirsch, nowak, thomas_fiering
from .sources import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The whole years of the table, for what bootstraps or pads years. Everything else goes from its first to its last day.
FIRST, LAST = "1995-01-01", "2000-12-31"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- the flows


def flow(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.concat(F.lit("L"), F.col("l_linenumber")).alias("site"), F.to_date("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("q"))


def dense(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return flows.densified(flow(spark, sf), *(FIRST, LAST) if whole else ())


def by_flag(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("q"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """An ensemble, daily."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("realization"), F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("ts")).agg(F.sum("l_quantity").alias("q"))


def months(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return cal.monthly_totals(dense(spark, sf, whole))


def monthly_series(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    return cal.resampled(dense(spark, sf, whole), "MS")


FLOW = "flow AS (SELECT 'L' || l_linenumber AS site, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
DAYS = """, dense AS (SELECT s.site, d.ts, coalesce(f.q, 0) AS q FROM (SELECT DISTINCT site FROM flow) s
  CROSS JOIN (SELECT CAST(unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS DATE) AS ts) d LEFT JOIN flow f ON f.site = s.site AND f.ts = d.ts)"""
DENSE = FLOW + DAYS.format(first="(SELECT min(ts) FROM flow)", last="(SELECT max(ts) FROM flow)")
WHOLE = FLOW + DAYS.format(first=f"DATE '{FIRST}'", last=f"DATE '{LAST}'")
TOTALS = """, months AS (SELECT site, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, sum(q) AS q FROM dense GROUP BY 1, 2, 3),
 series AS (SELECT site, make_date(year, month, 1) AS ts, q FROM months)"""
MONTHS, WHOLE_MONTHS = DENSE + TOTALS, WHOLE + TOTALS
SCORES = WHOLE_MONTHS + """, moments AS (SELECT site, month, avg(q) AS mu, stddev_samp(q) AS sigma FROM months GROUP BY 1, 2),
 z AS (SELECT m.site, m.year, m.month, (m.q - o.mu) / o.sigma AS z, CAST(dense_rank() OVER (PARTITION BY m.site ORDER BY m.year) - 1 AS INTEGER) AS hist_idx FROM months m JOIN moments o USING (site, month))"""
FLAG = "flag AS (SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
MEMBERS = "members AS (SELECT CAST(l_linenumber AS INTEGER) AS realization, l_returnflag AS site, CAST(l_shipdate AS DATE) AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3)"
INDEX = MONTHS + """, idx0 AS (SELECT site, ts, sum(q) OVER w AS q, count(q) OVER w AS n FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 2 PRECEDING)),
 idx AS (SELECT site, ts, (q - avg(q) OVER m) / stddev_samp(q) OVER m AS ssi FROM idx0 WHERE n = 3 WINDOW m AS (PARTITION BY site, month(ts)))"""


def uniform_sql(*keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def normal_sql(seed: int, stream: str, *keys: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(repr(str(seed)), repr(stream + 'u'), *keys)})) * cos(2 * pi() * {uniform_sql(repr(str(seed)), repr(stream + 'v'), *keys)}))"


def gamma_p_sql(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function as a sum of Poisson-like terms."""
    term = f"lambda j_: exp(({a} + j_) * ln({x}) - {x} - lgamma({a} + j_ + 1))"
    return f"CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum(list_transform(range(CAST(80 + greatest({x} - {a}, 0) + 12 * sqrt({x}) AS BIGINT)), {term})) END"


def norm_cdf_sql(z: str) -> str:
    return f"(0.5 + sign({z}) * 0.5 * ({gamma_p_sql('0.5', f'({z} * {z} / 2)')}))"


def norm_ppf_sql(p: str) -> str:
    """Newton steps from the middle, which approach the quantile from within."""
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN list_reduce([0.0::DOUBLE] || list_transform(range(40), lambda i: {p}), lambda z, p: z - ({norm_cdf_sql('z')} - p) * sqrt(2 * pi()) * exp(z * z / 2)) END"


def f_sf_sql(f: str, d1: str, d2: str) -> str:
    """The incomplete beta function's power series, from the side where it converges fast."""

    def series(a: str, b: str, x: str) -> str:
        return f"list_sum(list_transform(range(3000), lambda j_: exp(lgamma({a} + {b} + j_) - lgamma({b}) - lgamma({a} + j_ + 1) + ({a} + j_) * ln({x}) + {b} * ln(1 - {x}))))"

    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * {f}))"
    return f"CASE WHEN {x} >= 1 THEN 1.0 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {series(b, a, f'(1 - {x})')} ELSE {series(a, b, x)} END"


def index(spark: SparkSession, sf: str) -> DataFrame:
    """A standardised index: trailing three-month sums as z scores by calendar month."""
    sums = windows.rolling(monthly_series(spark, sf), 3)
    from pyspark.sql import Window

    w = Window.partitionBy("site", F.month("ts"))
    return sums.select("site", "ts", ((F.col("q") - F.avg("q").over(w)) / F.stddev_samp("q").over(w)).alias("ssi"))


# ---- sources, filters, resampling


@query(f"WITH {DENSE} SELECT * FROM dense")
def flow_daily_densified(spark, sf):
    return dense(spark, sf)


@query(f"WITH {DENSE} SELECT site, ts, nullif(q, 0) AS q FROM dense")
def flow_zero_to_null(spark, sf):
    return cal.zero_to_null(dense(spark, sf))


@query(f"WITH {DENSE} SELECT site, ts, q FROM dense WHERE q > 0")
def positive_flow(spark, sf):
    return cal.positive(dense(spark, sf))


@query("WITH e AS (SELECT event_type || ' ' || hour(ts) AS site, CAST(ts AS DATE) AS ts, sum(value) AS q FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT site FROM e), n AS (SELECT d.site, t.ts, round(e.q, 4) AS q FROM d CROSS JOIN (SELECT DISTINCT ts FROM e) t LEFT JOIN e ON e.site = d.site AND e.ts = t.ts) SELECT * FROM n WHERE site IN (SELECT site FROM n GROUP BY 1 HAVING count(*) = count(q))")
def sites_without_gaps(spark, sf):
    """Sites are event types by hour, some of which have an event every day."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    daily = e.groupBy(F.concat_ws(" ", "event_type", F.hour("ts")).alias("site"), F.to_date("ts").alias("ts")).agg(F.sum("value").alias("q"))
    return rounded(cal.sites_without_gaps(flows.densified(daily, fill=None)), 4)


@query(f"WITH {DENSE}, n AS (SELECT site, ts, nullif(q, 0) AS q FROM dense) SELECT * FROM n WHERE ts IN (SELECT ts FROM n GROUP BY 1 HAVING count(*) = count(q))")
def dates_without_gaps(spark, sf):
    return cal.dates_kept(cal.zero_to_null(dense(spark, sf)))


@query(f"WITH {FLAG} SELECT site, ts, q FROM flag QUALIFY count(*) OVER (PARTITION BY site, year(ts)) = dayofyear(make_date(year(ts), 12, 31))")
def complete_years(spark, sf):
    return cal.complete_years(by_flag(spark, sf))


@query(f"WITH {DENSE}, n AS (SELECT site, ts, nullif(q, 0) AS q FROM dense) SELECT site, ts, coalesce(last_value(q IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(q IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM n")
def filled_gaps(spark, sf):
    return cal.filled(cal.zero_to_null(dense(spark, sf)))


@query(f"WITH {MONTHS} SELECT site, ts, q FROM series WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1998-05-01'")
def date_slice(spark, sf):
    return cal.between(monthly_series(spark, sf), "1996-03-01", "1998-05-01")


@query(f"WITH {FLAG}, m AS (SELECT site, date_trunc('month', ts)::DATE AS ts, sum(q) AS q FROM flag GROUP BY 1, 2) SELECT site, ts, q FROM m QUALIFY row_number() OVER (PARTITION BY site ORDER BY ts) <= count(*) OVER (PARTITION BY site) // 12 * 12")
def whole_years_of_months(spark, sf):
    return cal.whole_years_of_months(cal.resampled(by_flag(spark, sf), "MS"))


@query(f"WITH {MONTHS} SELECT * FROM months")
def monthly_totals(spark, sf):
    return months(spark, sf)


@query(f"WITH {FLOW} SELECT site, CAST(ts + ((7 - dayofweek(ts)) % 7) * INTERVAL 1 DAY AS DATE) AS ts, sum(q) AS q FROM flow GROUP BY 1, 2")
def weekly_sunday_totals(spark, sf):
    return cal.resampled(flow(spark, sf), "W-SUN")


@query(f"WITH {FLOW} SELECT site, last_day(ts) AS ts, round(avg(q), 6) AS q FROM flow GROUP BY 1, 2")
def month_end_means(spark, sf):
    return rounded(cal.resampled(flow(spark, sf), "M", "mean"))


@query(f"WITH {FLOW} SELECT site, make_date(year(ts), 12, 31) AS ts, sum(q) AS q FROM flow GROUP BY 1, 2")
def annual_totals(spark, sf):
    return cal.resampled(flow(spark, sf), "A")


@query("WITH e AS (SELECT event_type AS site, CAST(ts AS DATE) AS ts, sum(value) AS q FROM events GROUP BY 1, 2), d AS (SELECT site, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS ts FROM e GROUP BY site) SELECT d.site, d.ts, round(coalesce(q, 0), 4) AS q FROM d LEFT JOIN e ON e.site = d.site AND e.ts = d.ts")
def event_flow_daily(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("site"), F.to_date("ts").alias("ts"), F.col("value").alias("q"))
    return rounded(cal.resampled(e, "D", fill=True), 4)


@query("SELECT r_name AS site, CAST(o_orderdate AS DATE) AS ts, round(sum(o_totalprice), 2) AS q FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def region_flow(spark, sf):
    t = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    j = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(j.groupBy(F.col("r_name").alias("site"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("q")), 2)


@query(f"WITH {DENSE} SELECT ts, sum(q) AS q FROM dense GROUP BY 1")
def index_gauge(spark, sf):
    return cal.index_gauge(dense(spark, sf))


@query(f"WITH {MONTHS} SELECT site, year, {', '.join(f'sum(q) FILTER (month = {m}) AS m{m}' for m in range(1, 13))} FROM months GROUP BY 1, 2")
def month_matrix(spark, sf):
    return cal.as_matrix(months(spark, sf))


@query(f"WITH {DENSE} SELECT d.site, d.ts, d.q - coalesce(u.q, 0) AS q FROM dense d LEFT JOIN (SELECT 'L3' AS site, ts, sum(q) AS q FROM dense WHERE site IN ('L1', 'L2') GROUP BY ts UNION ALL SELECT 'L4', ts, q FROM dense WHERE site = 'L3') u ON u.site = d.site AND u.ts = d.ts")
def marginal_inflow(spark, sf):
    edges = spark.createDataFrame([("L1", "L3"), ("L2", "L3"), ("L3", "L4")], "upstream string, downstream string")
    return flows.marginal_inflow(dense(spark, sf), edges)


@query(f"WITH {FLOW}, s AS (SELECT site FROM flow GROUP BY 1 HAVING min(year(ts)) <= 1995) SELECT flow.site, ts, q FROM flow JOIN s USING (site)")
def gauges_with_long_records(spark, sf):
    return flows.gauges_with_long_records(flow(spark, sf), 1995)


# ---- moments and scores


@query(f"WITH {MONTHS} SELECT site, year, month, round(ln(greatest(q, 1e-6)), 6) AS q FROM months")
def log_monthly(spark, sf):
    return rounded(months(spark, sf).withColumn("q", cal.log_floor(F.col("q"))))


@query(f"WITH {MONTHS} SELECT site, month, round(avg(q), 6) AS mu, round(stddev_samp(q), 6) AS sigma FROM months GROUP BY 1, 2")
def monthly_mean_std(spark, sf):
    return rounded(stats.monthly_moments(months(spark, sf)))


@query(f"WITH {SCORES} SELECT site, year, month, round(z, 6) AS z FROM z")
def standardize(spark, sf):
    return rounded(stats.standardized(months(spark, sf, whole=True)))


@query(f"WITH {MONTHS} SELECT site, year, month, round(q, 6) AS q FROM months")
def destandardize_roundtrip(spark, sf):
    m = months(spark, sf)
    back = stats.standardized(m).join(stats.monthly_moments(m), ["site", "month"])
    return rounded(back.select("site", "year", "month", (F.col("z") * F.col("sigma") + F.col("mu")).alias("q")))


@query(f"WITH {SCORES} SELECT site, hist_idx, month, round(z, 6) AS z FROM z")
def complete_year_scores(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(kirsch.complete_scores(m, stats.monthly_moments(m)))


@query(f"WITH {SCORES} SELECT site, CASE WHEN month <= 6 THEN hist_idx - 1 ELSE hist_idx END AS hist_idx, CASE WHEN month <= 6 THEN month + 6 ELSE month - 6 END AS month, round(z, 6) AS z FROM z WHERE NOT (month <= 6 AND hist_idx = 0) AND NOT (month > 6 AND hist_idx = 5)")
def half_year_shift(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(kirsch.half_year_shifted(kirsch.complete_scores(m, stats.monthly_moments(m))))


@query(f"WITH {SCORES} SELECT a.site, a.month AS m1, b.month AS m2, round(corr(a.z, b.z), 6) AS r FROM z a JOIN z b ON a.site = b.site AND a.hist_idx = b.hist_idx GROUP BY 1, 2, 3")
def intermonth_corr(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(stats.month_correlations(kirsch.complete_scores(m, stats.monthly_moments(m))))


@query(f"WITH {MONTHS} SELECT a.site AS site1, b.site AS site2, round(corr(a.q, b.q), 6) AS r FROM series a JOIN series b ON a.ts = b.ts GROUP BY 1, 2")
def site_corr_matrix(spark, sf):
    return rounded(stats.site_correlations(monthly_series(spark, sf)))


@query(f"WITH {MONTHS}, l AS (SELECT unnest([1, 2, 3, 6, 12]) AS lag), s AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts) AS i FROM series), r AS (SELECT a.site, CAST(lag AS INTEGER) AS lag, count(*) AS n, corr(a.q, b.q) AS r FROM s a JOIN l ON true JOIN s b ON b.site = a.site AND b.i = a.i + lag GROUP BY 1, 2) SELECT site, lag, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM r")
def lag_autocorr_ci(spark, sf):
    return rounded(stats.autocorrelation(monthly_series(spark, sf), [1, 2, 3, 6, 12]))


@query(f"WITH {MEMBERS}, m AS (SELECT realization, site, date_trunc('month', ts)::DATE AS ts, sum(q) AS q FROM members GROUP BY 1, 2, 3) SELECT site, CAST(month(ts) AS INTEGER) AS month, round(avg(q), 6) AS mu, round(stddev_pop(q), 6) AS sigma_pop FROM m GROUP BY 1, 2")
def ensemble_month_moments(spark, sf):
    m = cal.resampled(members(spark, sf), "MS", by=["realization", "site"])
    return rounded(stats.monthly_population_moments(m.withColumn("month", F.month("ts"))))


# ---- quantiles and ranges

P50 = stats.probabilities()


@query(f"WITH {DENSE}, p AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS i), v AS (SELECT site, quantile_cont(q, {P50}) AS v FROM dense GROUP BY 1) SELECT site, i, round(0.0001 + 0.9998 * i / 49, 6) AS p, round(v[i + 1], 6) AS q FROM v CROSS JOIN p")
def fdc_total(spark, sf):
    return rounded(stats.flow_duration(dense(spark, sf), P50))


@query(f"WITH {MEMBERS}, p AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS i), v AS (SELECT site, realization, year(ts), quantile_cont(q, {P50}) AS v FROM members GROUP BY 1, 2, 3) SELECT site, i, round(min(v[i + 1]), 6) AS low, round(max(v[i + 1]), 6) AS high FROM v CROSS JOIN p GROUP BY 1, 2")
def fdc_annual_envelope(spark, sf):
    return rounded(stats.annual_duration_envelope(members(spark, sf), P50))


def _ranges(f: str) -> str:
    return f"WITH {DENSE} SELECT site, CAST({f}(ts) AS INTEGER) AS period, min(q) AS low, median(q) AS middle, max(q) AS high FROM dense GROUP BY 1, 2"


@query(_ranges("dayofyear"))
def flow_ranges_doy(spark, sf):
    return stats.flow_ranges(dense(spark, sf), "dayofyear")


@query(_ranges("weekofyear"))
def flow_ranges_week(spark, sf):
    return stats.flow_ranges(dense(spark, sf), "week")


@query(_ranges("month"))
def flow_ranges_month(spark, sf):
    return stats.flow_ranges(dense(spark, sf), "month")


@query(f"WITH {MEMBERS}, r AS (SELECT site, realization, CAST(month(ts) AS INTEGER) AS period, min(q) AS low, median(q) AS middle, max(q) AS high FROM members GROUP BY 1, 2, 3) SELECT site, period, min(low) AS low, median(middle) AS middle, max(high) AS high FROM r GROUP BY 1, 2")
def flow_ranges_ensemble(spark, sf):
    return stats.flow_ranges(members(spark, sf), "month")


@query(f"WITH {MONTHS}, q AS (SELECT site, month, quantile_cont(q, [0.25, 0.5, 0.75]) AS p FROM months GROUP BY 1, 2) SELECT m.site, m.month, round(p[1], 6) AS q1, round(p[2], 6) AS q2, round(p[3], 6) AS q3, min(q) FILTER (q BETWEEN p[1] - 1.5 * (p[3] - p[1]) AND p[3] + 1.5 * (p[3] - p[1])) AS low, max(q) FILTER (q BETWEEN p[1] - 1.5 * (p[3] - p[1]) AND p[3] + 1.5 * (p[3] - p[1])) AS high FROM months m JOIN q USING (site, month) GROUP BY m.site, m.month, p")
def boxplot_stats(spark, sf):
    return rounded(stats.box_stats(months(spark, sf), ["site", "month"]))


@query(f"WITH {MONTHS}, e AS (SELECT site, min(q) AS a, max(q) AS b, count(*) AS n FROM months GROUP BY 1) SELECT site, CAST(least(floor((q - a) / ((b - a) / 10)) + 1, 10) AS INTEGER) AS bin, round(a + (b - a) / 10 * (least(floor((q - a) / ((b - a) / 10)) + 1, 10) - 1), 6) AS low, round(count(*) / (n * (b - a) / 10), 6) AS density FROM months JOIN e USING (site) GROUP BY site, a, b, n, bin, low")
def histogram_density(spark, sf):
    return rounded(stats.histogram(months(spark, sf), 10))


@query(f"""WITH {DENSE}, e AS (SELECT site, min(q) AS a, (max(q) - min(q)) / 200 AS d, count(*) AS n, stddev_samp(q) * pow(count(*), -0.2) AS h FROM dense GROUP BY 1),
 at_ AS (SELECT site, a, d, n, h, (q - a) / d AS u, least(floor((q - a) / d), 199) AS k FROM dense JOIN e USING (site)),
 g AS (SELECT site, a, d, n, h, k, sum(w) AS w FROM (SELECT site, a, d, n, h, k, k + 1 - u AS w FROM at_ UNION ALL SELECT site, a, d, n, h, k + 1, u - k FROM at_) GROUP BY ALL)
SELECT site, round(a + 200 * d * i / 49, 6) AS x, round(sum(w * exp(-0.5 * pow((200 * d * i / 49 - k * d) / h, 2))) / (n * h * sqrt(2 * pi())), 8) AS density FROM g, range(50) t(i) GROUP BY site, a, d, n, h, i""")
def binned_density(spark, sf):
    b = stats.binned_density(dense(spark, sf), 50, 200)
    return b.select("site", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(f"WITH {MONTHS}, e AS (SELECT site, min(q) AS a, max(q) AS b, count(*) AS n, stddev_samp(q) * pow(count(*), -0.2) AS h FROM months GROUP BY 1), g AS (SELECT *, a + (b - a) * i / 19 AS x FROM e, range(20) t(i)) SELECT site, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - q) / h, 2)) / (h * sqrt(2 * pi()))) / n, 6) AS density FROM g JOIN months USING (site) GROUP BY site, x, n")
def kernel_density(spark, sf):
    return rounded(stats.kernel_density(months(spark, sf), 20))


# ---- windows


@query(f"WITH {MONTHS} SELECT site, ts, sum(q) OVER w AS q FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 11 PRECEDING) QUALIFY count(*) OVER w = 12")
def rolling_sum_trailing(spark, sf):
    return windows.rolling(monthly_series(spark, sf), 12)


@query(f"WITH {MONTHS} SELECT site, ts, round(avg(q) OVER w, 6) AS q FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 5 PRECEDING) QUALIFY count(*) OVER w = 6")
def rolling_mean_trailing(spark, sf):
    return rounded(windows.rolling(monthly_series(spark, sf), 6, "mean"))


@query(f"WITH {MONTHS} SELECT site, ts, sum(q) OVER w AS q FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) QUALIFY count(*) OVER w = 12")
def rolling_sum_forward(spark, sf):
    return windows.rolling(monthly_series(spark, sf), 12, forward=True)


@query(f"WITH {DENSE} SELECT site, ts, round(avg(q) OVER (PARTITION BY site ORDER BY ts RANGE BETWEEN INTERVAL 179 DAY PRECEDING AND CURRENT ROW), 6) AS q FROM dense")
def rolling_mean_range(spark, sf):
    return rounded(windows.rolling_days(dense(spark, sf), 180))


TRIMMED = ", sums AS (SELECT site, ts, sum(q) OVER w AS q FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 5 PRECEDING) QUALIFY count(*) OVER w = 6), trimmed AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY site ORDER BY ts) > 1 AND row_number() OVER (PARTITION BY site ORDER BY ts) <= count(*) OVER (PARTITION BY site) - 6)"


@query(f"WITH {MONTHS}{TRIMMED} SELECT * FROM trimmed")
def rolling_trim_verification(spark, sf):
    return windows.rolling_trimmed(monthly_series(spark, sf), 6)


@query(f"WITH {MONTHS} SELECT a.site, a.year, a.month, round((count(*) FILTER (b.q < a.q) + 0.5) / count(*), 6) AS cdf FROM months a JOIN months b ON b.site = a.site AND b.month = a.month GROUP BY a.site, a.year, a.month, a.q")
def normal_scores_cdf(spark, sf):
    m = months(spark, sf)
    return rounded(windows.normal_scores(m, m, ["site", "month"]).select("site", "year", "month", "cdf"))


# ---- indices and droughts


@query(f"WITH {INDEX} SELECT site, ts, round(ssi, 6) AS ssi FROM idx")
def zscore_index(spark, sf):
    return rounded(index(spark, sf))


def events_sql(by: str) -> str:
    return EVENTS.replace("PARTITION BY site", f"PARTITION BY {by}").replace("SELECT site, min(ts)", f"SELECT {by}, min(ts)").replace("GROUP BY site, g", f"GROUP BY {by}, g")


EVENTS = """, runs AS (SELECT *, sum(CASE WHEN ssi < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY ts) AS g, max(CASE WHEN ssi >= 0 OR ssi IS NULL THEN ts END) OVER (PARTITION BY site) AS over FROM idx),
 found AS (SELECT site, min(ts) AS first_day, max(ts) AS "end", count(*) AS duration, sum(ssi) AS magnitude, min(ssi) AS severity, max(CASE WHEN ssi <= -1 THEN ts END) AS critical_day FROM runs WHERE ssi < 0 GROUP BY site, g, over HAVING min(ssi) <= -1 AND max(ts) < over)"""


@query(f"""WITH {INDEX}{EVENTS} SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY "end") AS INTEGER) AS drought_id, first_day AS "start", "end", duration, round(magnitude, 6) AS magnitude, round(severity, 6) AS severity FROM found""")
def drought_events(spark, sf):
    return rounded(drought.events(index(spark, sf)))


@query(f"""WITH {INDEX}{EVENTS} SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY "end") AS INTEGER) AS drought_id, critical_day AS "start", "end", duration, round(magnitude, 6) AS magnitude, round(severity, 6) AS severity FROM found""")
def drought_events_by_realization(spark, sf):
    return rounded(drought.events_of_ensemble(index(spark, sf), ["site"]))


@query(f"""WITH {INDEX}{EVENTS}, calm AS (SELECT * FROM idx WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.site = idx.site AND idx.ts BETWEEN first_day AND found."end")),
 v AS (SELECT site, quantile_cont(ssi, [0.25, 0.5, 0.75]) AS v FROM calm GROUP BY 1) SELECT site, round(v[1], 6) AS q1, round(v[2], 6) AS q2, round(v[3], 6) AS q3 FROM v""")
def calm_quartiles(spark, sf):
    i = index(spark, sf)
    return rounded(drought.calm_quartiles(i, drought.events(i).select("site", "start", "end")))


DRAWS = uniform_sql(repr("13"), repr("ecdf"), "site", "month", "CAST(r AS INTEGER)")


@query(f"""WITH {MONTHS}, k AS (SELECT site, month, row_number() OVER (PARTITION BY site, month ORDER BY q) / (count(*) OVER (PARTITION BY site, month) + 1) AS x, q AS y FROM months),
 u AS (SELECT site, month, CAST(r AS INTEGER) AS realization, {DRAWS} AS p FROM (SELECT DISTINCT site, month FROM months), range(40) t(r)),
 low AS (SELECT u.*, k.x AS x0, k.y AS y0 FROM u ASOF LEFT JOIN k ON k.site = u.site AND k.month = u.month AND u.p >= k.x),
 both_ AS (SELECT low.*, k.x AS x1, k.y AS y1 FROM low ASOF LEFT JOIN k ON k.site = low.site AND k.month = low.month AND low.p <= k.x)
SELECT site, month, realization, round(p, 9) AS p, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END, 6) AS q FROM both_""")
def inverse_ecdf_draws(spark, sf):
    m = months(spark, sf)
    asked = m.select("site", "month").distinct().select("site", "month", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("realization"))
    got = quantiles.inverse_ecdf(m, asked.withColumn("p", uniform(13, "ecdf", "site", "month", "realization")), ["site", "month"])
    return got.select("site", "month", "realization", F.round("p", 9).alias("p"), F.round("q", 6).alias("q"))


#: Wet and dry months of the index, as states 0 and 1.
STATES = INDEX + """, states AS (SELECT site, ts, CASE WHEN ssi < 0 THEN 1 ELSE 0 END AS state, ssi FROM idx),
 moves AS (SELECT site, state AS i, lead(state) OVER (PARTITION BY site ORDER BY ts) AS j FROM states),
 off AS (SELECT site, avg(j) FILTER (i = 0) AS p01, 1 - avg(j) FILTER (i = 1) AS p10 FROM moves WHERE j IS NOT NULL GROUP BY 1)"""


def _states(spark, sf):
    return index(spark, sf).select("site", "ts", (F.col("ssi") < 0).cast("int").alias("state"), "ssi")


@query(f"WITH {STATES} SELECT site, round(p10 / (p01 + p10), 6) AS wet, round(p01 / (p01 + p10), 6) AS dry FROM off")
def stationary_states(spark, sf):
    p = stats.transitions(_states(spark, sf), 2).select("site", stats.stationary(F.col("p")).alias("w"))
    return rounded(p.select("site", F.get("w", F.lit(0)).alias("wet"), F.get("w", F.lit(1)).alias("dry")))


@query(f"""WITH {STATES}, m AS (SELECT site, avg(ssi) FILTER (state = 0) AS m0, avg(ssi) FILTER (state = 1) AS m1, stddev_samp(ssi) FILTER (state = 0) AS s0, stddev_samp(ssi) FILTER (state = 1) AS s1 FROM states GROUP BY 1),
 g AS (SELECT *, least(m0 - 4 * s0, m1 - 4 * s1) + (greatest(m0 + 4 * s0, m1 + 4 * s1) - least(m0 - 4 * s0, m1 - 4 * s1)) * i / 39 AS x FROM m JOIN off USING (site), range(40) t(i))
SELECT site, round(x, 6) AS x, round((p10 / s0 * exp(-0.5 * pow((x - m0) / s0, 2)) + p01 / s1 * exp(-0.5 * pow((x - m1) / s1, 2))) / ((p01 + p10) * sqrt(2 * pi())), 6) AS density FROM g""")
def mixture_density(spark, sf):
    s = _states(spark, sf)
    parts = s.groupBy("site").agg(*[F.array(*[f(F.when(F.col("state") == k, F.col("ssi"))) for k in (0, 1)]).alias(n) for f, n in ((F.avg, "mu"), (F.stddev_samp, "sd"))])
    weighed = parts.join(stats.transitions(s, 2).select("site", stats.stationary(F.col("p")).alias("weights")), "site")
    return rounded(stats.mixture_density(weighed, 40))


@query(f"""WITH RECURSIVE {INDEX}, rows_ AS (SELECT site, ts, ssi, coalesce(ssi < 0, false) AS low, CAST(row_number() OVER (PARTITION BY site ORDER BY ts) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY site) AS n FROM idx),
 walk(site, i, dry, begun, stop, pos, neg, ended) AS (
  SELECT site, -1, false, 0, 0, 0, 0, false FROM rows_ WHERE i = 0
  UNION ALL
  SELECT site, i, CASE WHEN dry THEN NOT ends ELSE low AND neg + 1 >= 3 END, CASE WHEN NOT dry AND low AND neg = 0 THEN i ELSE begun END, CASE WHEN dry AND pos = 0 THEN i ELSE stop END,
   CASE WHEN dry THEN CASE WHEN ends THEN 0 ELSE up END WHEN low AND neg + 1 >= 3 OR NOT low AND up > 6 THEN 0 ELSE up END,
   CASE WHEN dry THEN CASE WHEN ends THEN 0 ELSE neg END WHEN low AND neg + 1 >= 3 OR NOT low AND up > 6 THEN 0 WHEN low THEN neg + 1 ELSE greatest(neg - 1, 0) END, dry AND ends
  FROM (SELECT w.site, r.i, w.dry, w.begun, w.stop, w.pos, w.neg, r.low, CASE WHEN r.low THEN greatest(w.pos - 1, 0) ELSE w.pos + 1 END AS up, w.dry AND NOT r.low AND w.pos + 1 >= 3 AS ends FROM walk w JOIN rows_ r ON r.site = w.site AND r.i = w.i + 1)),
 spells AS (SELECT site, begun, stop FROM walk WHERE ended UNION ALL SELECT w.site, begun, n FROM walk w JOIN rows_ r ON r.site = w.site AND r.i = w.i WHERE w.dry AND w.i = n - 1)
SELECT s.site, min(ts) AS "start", max(ts) AS "end", count(*) AS duration, round(avg(ssi), 6) AS intensity FROM spells s JOIN rows_ r ON r.site = s.site AND r.i >= begun AND r.i < stop GROUP BY s.site, begun, stop HAVING avg(ssi) < -0.3""")
def drought_hysteresis(spark, sf):
    return rounded(drought.hysteresis(index(spark, sf), intensity=-0.3))


LMOM = """, ranked AS (SELECT site, month, q, row_number() OVER (PARTITION BY site, month ORDER BY q) - 1 AS i FROM months),
 b AS (SELECT site, month, count(*) AS n, avg(q) AS b0, sum(i * q) / (count(*) * (count(*) - 1)) AS b1, sum(i * (i - 1) * q) / (count(*) * (count(*) - 1) * (count(*) - 2)) AS b2 FROM ranked GROUP BY 1, 2),
 l AS (SELECT site, month, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b)"""


@query(f"WITH {MONTHS}{LMOM} SELECT site, month, n, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(l3 / l2, 6) AS t3 FROM l")
def l_moments(spark, sf):
    return rounded(stats.l_moments(months(spark, sf), ["site", "month"]))


@query(f"WITH {MONTHS}, m AS (SELECT site, month, avg(q) FILTER (q > 0) AS m, ln(avg(q) FILTER (q > 0)) - avg(ln(q)) FILTER (q > 0) AS u, avg(CASE WHEN q <= 0 THEN 1.0 ELSE 0.0 END) AS p0 FROM months GROUP BY 1, 2), k AS (SELECT *, (1 + sqrt(1 + 4 * u / 3)) / (4 * u) AS k FROM m) SELECT site, month, round(k, 4) AS shape, round(m / k, 4) AS scale, round(p0, 4) AS p0 FROM k")
def gamma_thom_params(spark, sf):
    return rounded(ssi.gamma_params(months(spark, sf), ["site", "month"]), 4)


@query(f"WITH {MONTHS}{LMOM} SELECT site, month, round(4 / pow(l3 / l2, 2), 3) AS alpha, round(0.5 * l2 * abs(l3 / l2), 3) AS beta, round(l1 - 2 * l2 / (l3 / l2), 3) AS xi, round(l3 / l2, 3) AS t3, round(l1, 3) AS l1, round(l2, 3) AS l2 FROM l")
def pearson3_params(spark, sf):
    return rounded(ssi.pearson3_params(months(spark, sf), ["site", "month"]), 3)


SUMS3 = MONTHS + ", sums3 AS (SELECT site, ts, sum(q) OVER w AS q FROM series WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 2 PRECEDING) QUALIFY count(*) OVER w = 3)"
THOM = """SELECT {by}, month(ts) AS month, avg(q) FILTER (q > 0) AS m, ln(avg(q) FILTER (q > 0)) - avg(ln(q)) FILTER (q > 0) AS u, avg(CASE WHEN q <= 0 THEN 1.0 ELSE 0.0 END) AS p0 FROM {sums} GROUP BY ALL"""


def _gamma_index(sums: str, by: str) -> str:
    """The index of a table of sums, by Thom's gamma distribution, as table idx."""
    return f""", means AS ({THOM.format(by=by, sums=sums)}), fits AS (SELECT *, (1 + sqrt(1 + 4 * u / 3)) / (4 * u) AS k FROM means),
 probs AS (SELECT {", ".join("s." + c for c in by.split(", "))}, ts, {gamma_p_sql("k", "(q * k / m)")} AS p FROM {sums} s JOIN fits f ON f.month = month(s.ts) AND {" AND ".join(f"f.{c} = s.{c}" for c in by.split(", "))}),
 idx AS (SELECT {by}, ts, {norm_ppf_sql("p")} AS ssi FROM probs)"""


@query(f"WITH {SUMS3}{_gamma_index('sums3', 'site')} SELECT site, ts, round(ssi, 6) AS ssi FROM idx")
def ssi_gamma(spark, sf):
    return rounded(ssi.SSI(window=3).fit_transform(monthly_series(spark, sf)))


#: Digamma and trigamma by recurrence to 20 beyond, and their asymptotic series there.
PSI = "(ln(k + 20) - 0.5 / (k + 20) - 1 / (12 * pow(k + 20, 2)) + 1 / (120 * pow(k + 20, 4)) - 1 / (252 * pow(k + 20, 6)) - list_sum(list_transform(range(20), lambda i: 1 / (k + i))))"
PSI1 = "(1 / (k + 20) + 0.5 / pow(k + 20, 2) + 1 / (6 * pow(k + 20, 3)) - 1 / (30 * pow(k + 20, 5)) + 1 / (42 * pow(k + 20, 7)) + list_sum(list_transform(range(20), lambda i: 1 / pow(k + i, 2))))"
ML = f""", newton(site, month, m, u, p0, step, k) AS (
  SELECT site, month, m, u, p0, 0, 0.5 / u FROM means WHERE u > 1e-12
  UNION ALL SELECT site, month, m, u, p0, step + 1, greatest(k - (ln(k) - {PSI} - u) / (1 / k - {PSI1}), k / 2) FROM newton WHERE step < 60)"""


@query(f"WITH RECURSIVE {MONTHS}, means AS ({THOM.format(by='site', sums='series')}){ML} SELECT site, CAST(month AS INTEGER) AS month, round(k, 4) AS shape, round(m / k, 4) AS scale, round(p0, 4) AS p0 FROM newton WHERE step = 60")
def gamma_ml_params(spark, sf):
    return rounded(ssi.gamma_ml_params(months(spark, sf), ["site", "month"]), 4)


@query(f"WITH RECURSIVE {SUMS3}, means AS ({THOM.format(by='site', sums='sums3')}){ML}, probs AS (SELECT s.site, s.ts, {gamma_p_sql('k', '(q * k / m)')} AS p FROM sums3 s JOIN newton f ON f.site = s.site AND f.month = month(s.ts) WHERE step = 60) SELECT site, ts, round({norm_ppf_sql('p')}, 6) AS ssi FROM probs")
def ssi_gamma_ml(spark, sf):
    return rounded(ssi.SSI(window=3, dist="gamma_ml").fit_transform(monthly_series(spark, sf)))


LMOM3 = LMOM.replace("FROM months", "FROM (SELECT site, month(ts) AS month, q FROM sums3)")


@query(f"""WITH {SUMS3}{LMOM3}, pars AS (SELECT *, l3 / l2 AS t3, 4 / pow(l3 / l2, 2) AS a, 0.5 * l2 * abs(l3 / l2) AS b, l1 - 2 * l2 / (l3 / l2) AS xi FROM l),
 cdfs AS (SELECT s.site, s.ts, CASE WHEN abs(t3) < 1e-6 THEN {norm_cdf_sql("((q - l1) / (l2 * sqrt(pi())))")} WHEN t3 > 0 THEN CASE WHEN q > xi THEN {gamma_p_sql("a", "((q - xi) / b)")} ELSE 0 END ELSE CASE WHEN q < xi THEN 1 - ({gamma_p_sql("a", "((xi - q) / b)")}) ELSE 1 END END AS f FROM sums3 s JOIN pars p ON p.site = s.site AND p.month = month(s.ts)),
 inner_ AS (SELECT site, ts, least(greatest(f, 1e-12), 1 - 1e-12) AS p FROM cdfs)
SELECT site, ts, round(least(greatest({norm_ppf_sql("p")}, -4.0), 4.0), 6) AS ssi FROM inner_""")
def ssi_pearson3(spark, sf):
    return rounded(ssi.SSI(window=3, dist="pearson3").fit_transform(monthly_series(spark, sf)))


@query(f"WITH {SUMS3}, cdfs AS (SELECT a.site, a.ts, (count(*) FILTER (b.q < a.q) + 0.5) / count(*) AS p FROM sums3 a JOIN sums3 b ON b.site = a.site AND month(b.ts) = month(a.ts) GROUP BY a.site, a.ts, a.q) SELECT site, ts, round({norm_ppf_sql('p')}, 6) AS ssi FROM cdfs")
def normal_scores_ssi(spark, sf):
    return rounded(ssi.SSI(window=3, dist="normal_scores").fit_transform(monthly_series(spark, sf)))


@query(f"""WITH {MEMBERS}, m AS (SELECT realization, site, date_trunc('month', ts)::DATE AS ts, sum(q) AS q FROM members GROUP BY 1, 2, 3),
 sums6 AS (SELECT realization, site, ts, sum(q) OVER w AS q FROM m WINDOW w AS (PARTITION BY realization, site ORDER BY ts ROWS 5 PRECEDING) QUALIFY count(*) OVER w = 6),
 cut AS (SELECT * FROM sums6 WINDOW w AS (PARTITION BY realization, site) QUALIFY row_number() OVER (PARTITION BY realization, site ORDER BY ts) BETWEEN 2 AND count(*) OVER w - 6)
 {_gamma_index("cut", "realization, site")}{events_sql("realization, site")}
SELECT realization, site, CAST(row_number() OVER (PARTITION BY realization, site ORDER BY "end") AS INTEGER) AS drought_id, critical_day AS "start", "end", duration, round(magnitude, 6) AS magnitude, round(severity, 6) AS severity FROM found""")
def drought_events_from_flows(spark, sf):
    m = cal.resampled(members(spark, sf), "MS", by=["realization", "site"])
    return rounded(drought.flow_events(m, 6, ssi.gamma_ssi, ["realization", "site"]))


@query(f"WITH {INDEX} SELECT a.site AS site1, b.site AS site2, round(sum(pow(a.ssi - b.ssi, 2)), 6) AS dispersion FROM idx a JOIN idx b ON a.ts = b.ts AND a.site < b.site GROUP BY 1, 2")
def site_pairs_dispersion(spark, sf):
    return rounded(stats.site_dispersions(index(spark, sf).withColumnRenamed("ssi", "q")))


# ---- tests


PAIRS = MONTHS + """, pairs AS (SELECT m.month, least(m.site, o.site) AS first_site, greatest(m.site, o.site) AS second_site, m.site, m.q FROM months m JOIN (SELECT DISTINCT site, month FROM months) o ON o.month = m.month AND o.site <> m.site),
 ranks AS (SELECT *, rank() OVER (PARTITION BY month, first_site, second_site ORDER BY q) + (count(*) OVER (PARTITION BY month, first_site, second_site, q) - 1) / 2 AS r FROM pairs),
 rank_sums AS (SELECT month, first_site, second_site, count(*) FILTER (site = first_site) AS n1, count(*) FILTER (site = second_site) AS n2, sum(r) FILTER (site = first_site) AS s FROM ranks GROUP BY 1, 2, 3),
 wilcoxon AS (SELECT month, first_site, second_site, n1, n2, (s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM rank_sums)"""


@query(f'WITH {PAIRS} SELECT month, first_site AS "first", second_site AS "second", n1, n2, round(z, 6) AS z FROM wilcoxon')
def rank_sum(spark, sf):
    return rounded(stats.rank_sum_pairs(months(spark, sf), "site", ["month"]))


LEVENE = """, c AS (SELECT *, abs(q - median(q) OVER (PARTITION BY month, site)) AS d FROM months), g AS (SELECT month, site, count(*) AS c, avg(d) AS a, sum(d * d) AS s FROM c GROUP BY 1, 2), h AS (SELECT month, count(*) AS k, CAST(sum(c) AS BIGINT) AS n, sum(c * a) AS t, sum(c * a * a) AS b, sum(s) AS s FROM g GROUP BY 1),
 levene AS (SELECT month, k, n, (n - k) / (k - 1) * (b - t * t / n) / (s - b) AS w FROM h)"""


@query(f"WITH {MONTHS}{LEVENE} SELECT month, k, n, round(w, 6) AS w FROM levene")
def levene_stat(spark, sf):
    return rounded(stats.levene(months(spark, sf), "site", ["month"]))


@query(f"""WITH {PAIRS}{LEVENE} SELECT month, first_site AS "first", second_site AS "second", round(2 * {norm_cdf_sql("(-abs(z))")}, 6) AS rank_sum_p, round({f_sf_sql("w", "(k - 1)", "(n - k)")}, 6) AS levene_p FROM wilcoxon JOIN levene USING (month)""")
def test_p_values(spark, sf):
    from .functions.special import f_sf, norm_cdf

    m = months(spark, sf)
    r = stats.rank_sum_pairs(m, "site", ["month"]).select("month", "first", "second", (2 * norm_cdf(-F.abs("z"))).alias("rank_sum_p"))
    v = stats.levene(m, "site", ["month"]).select("month", f_sf(F.col("w"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")).alias("levene_p"))
    return rounded(r.join(v, "month"))


# ---- validation: line number 1 stands for history, the others for its ensemble


def _spaces(year: str, period: str) -> str:
    return f"""{MEMBERS}, sums AS (SELECT realization, site, CAST({year} AS INTEGER) AS year, CAST({period} AS INTEGER) AS period, sum(q) AS q FROM members GROUP BY ALL),
 spaces AS (SELECT realization, site, year, period, 'real' AS space, q FROM sums UNION ALL SELECT realization, site, year, period, 'log', ln(greatest(q, 1e-6)) FROM sums)"""


def _boxed(rows: str, by: str) -> str:
    """The quartiles and whiskers of a table's values, as table box."""
    inside = "q BETWEEN p[1] - 1.5 * (p[3] - p[1]) AND p[3] + 1.5 * (p[3] - p[1])"
    return f"""quartiles AS (SELECT {by}, count(*) AS n, quantile_cont(q, [0.25, 0.5, 0.75]) AS p FROM {rows} GROUP BY ALL),
 box AS (SELECT {by}, n, p[1] AS q1, p[2] AS q2, p[3] AS q3, min(q) FILTER ({inside}) AS low, max(q) FILTER ({inside}) AS high FROM {rows} JOIN quartiles USING ({by}) GROUP BY ALL)"""


BOX = ", ".join(f"round({c}, 6) AS {c}" for c in ("q1", "q2", "q3", "low", "high"))
VALIDATION = """ WITH {spaces}, named AS (SELECT site, period, space, q, CASE realization WHEN 1 THEN 'history' ELSE 'ensemble' END AS sample FROM spaces),
 x AS (SELECT * FROM named SEMI JOIN (SELECT site, period, space FROM named GROUP BY ALL HAVING count(DISTINCT sample) = 2) USING (site, period, space)), {box},
 r AS (SELECT *, rank() OVER (PARTITION BY site, period, space ORDER BY q) + (count(*) OVER (PARTITION BY site, period, space, q) - 1) / 2 AS r, abs(q - median(q) OVER (PARTITION BY site, period, space, sample)) AS d FROM x),
 s AS (SELECT site, period, space, sample, count(*) AS c, sum(r) AS r, avg(d) AS a, sum(d * d) AS s FROM r GROUP BY ALL),
 t AS (SELECT h.site, h.period, h.space, h.c AS n1, e.c AS n2, h.r AS r, h.c * h.a + e.c * e.a AS t, h.c * h.a * h.a + e.c * e.a * e.a AS b, h.s + e.s AS s FROM s h JOIN s e USING (site, period, space) WHERE h.sample = 'history' AND e.sample = 'ensemble'),
 w AS (SELECT site, period, space, n1 + n2 AS m, (r - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z, (n1 + n2 - 2) * (b - t * t / (n1 + n2)) / nullif(s - b, 0) AS w FROM t)
 SELECT site, period, space, sample, n, {rounded}, round(2 * {rank_p}, 6) AS rank_sum_p, CASE WHEN w IS NOT NULL THEN round({levene_p}, 6) END AS levene_p FROM box JOIN w USING (site, period, space)"""


def _validation(year: str, period: str) -> str:
    return VALIDATION.format(spaces=_spaces(year, period), box=_boxed("x", "site, period, space, sample"), rounded=BOX, rank_p=norm_cdf_sql("(-abs(z))"), levene_p=f_sf_sql("w", "1", "(m - 2)"))


def _validated(spark: SparkSession, sf: str, scale: str) -> DataFrame:
    sums = validation.period_sums(members(spark, sf), scale, ["realization", "site"])
    return rounded(validation.compared(sums.where("realization = 1"), sums.where("realization > 1")))


@query(_validation("year(ts)", "month(ts)"))
def validation_monthly(spark, sf):
    return _validated(spark, sf, "monthly")


@query(_validation("isoyear(ts)", "week(ts)"))
def validation_weekly(spark, sf):
    return _validated(spark, sf, "weekly")


@query(f"""WITH {_spaces("year(ts)", "month(ts)")}, yearly AS (SELECT site, period, space, year, avg(q) AS mean, stddev_pop(q) AS sd FROM spaces GROUP BY ALL),
 moments AS (SELECT site, period, space, 'mean' AS moment, mean AS q FROM yearly UNION ALL SELECT site, period, space, 'sd', sd FROM yearly), {_boxed("moments", "site, period, space, moment")}
 SELECT site, period, space, moment, {BOX} FROM box""")
def validation_moments(spark, sf):
    return rounded(validation.moment_boxes(validation.period_sums(members(spark, sf), "monthly", ["realization", "site"])))


# ---- ensembles


@query(f"WITH {MEMBERS} SELECT realization, ts, {', '.join(f'''sum(q) FILTER (site = '{s}') AS "{s}"''' for s in 'ANR')} FROM members GROUP BY 1, 2")
def ensemble_by_realization(spark, sf):
    return ensemble.Ensemble(members(spark, sf)).by_realization(["A", "N", "R"])


@query(f"WITH {MEMBERS} SELECT site, ts, {', '.join(f'sum(q) FILTER (realization = {r}) AS realization_{r}' for r in range(1, 8))} FROM members GROUP BY 1, 2")
def ensemble_by_site(spark, sf):
    return ensemble.Ensemble(members(spark, sf)).by_site(list(range(1, 8)))


@query(f"WITH {MEMBERS} SELECT site, ts, q, CASE realization WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS realization FROM members WHERE realization IN (2, 5, 7)")
def ensemble_subset_renumber(spark, sf):
    return flows.subset_renumbered(members(spark, sf), [2, 5, 7])


@query(f"WITH {MONTHS}, y AS (SELECT array_agg(DISTINCT year ORDER BY year) AS ys FROM months), c AS (SELECT DISTINCT CAST(r AS INTEGER) AS realization, year, month FROM months, range(3) t(r)), d AS (SELECT realization, year, month, ys[CAST(floor({uniform_sql(repr('5'), repr('hist'), 'realization', 'year', 'month')} * len(ys)) AS INTEGER) + 1] AS from_year FROM c, y) SELECT d.realization, m.site, d.year, d.month AS period, m.q FROM d JOIN months m ON m.year = d.from_year AND m.month = d.month")
def resampled_history(spark, sf):
    return ensemble.resampled_history(months(spark, sf).withColumnRenamed("month", "period"), 3, 5)


# ---- generators


@query(f"SELECT o_orderkey AS k, round({uniform_sql(repr('7'), repr('demo'), 'o_orderkey')}, 9) AS u, round({normal_sql(7, 'demo', 'o_orderkey')}, 6) AS e FROM orders")
def hashed_draws(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("k"), F.round(uniform(7, "demo", "o_orderkey"), 9).alias("u"), F.round(normal(7, "demo", "o_orderkey"), 6).alias("e"))


TAU = WHOLE_MONTHS + """, t AS (SELECT site, month, max(q) AS a, min(q) AS b, median(q) AS c FROM months GROUP BY 1, 2),
 tau AS (SELECT site, month, CASE WHEN a + b - 2 * c = 0 THEN 0 ELSE greatest((a * b - c * c) / (a + b - 2 * c), 0) END AS tau FROM t),
 x AS (SELECT site, year, month, CASE WHEN q > tau THEN ln(q - tau) END AS x FROM months JOIN tau USING (site, month))"""
RHO = TAU + """, k AS (SELECT *, row_number() OVER (PARTITION BY site, month ORDER BY year) AS k FROM x),
 rho AS (SELECT a.site, a.month, corr(a.x, b.x) AS rho FROM k a JOIN k b ON b.site = a.site AND b.month = a.month % 12 + 1 AND b.k = a.k GROUP BY 1, 2)"""


@query(f"WITH {TAU} SELECT site, month, round(tau, 6) AS tau FROM tau")
def stedinger_tau(spark, sf):
    return rounded(thomas_fiering.stedinger_tau(months(spark, sf, whole=True)))


@query(f"WITH {TAU} SELECT site, year, month, round(x, 6) AS x FROM x")
def stedinger_norm(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(thomas_fiering.normalized(m, thomas_fiering.stedinger_tau(m)))


@query(f"WITH {RHO} SELECT site, month, round(rho, 6) AS rho FROM rho")
def tf_rho(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(thomas_fiering.month_pair_rho(thomas_fiering.normalized(m, thomas_fiering.stedinger_tau(m))))


@query(f"""WITH RECURSIVE {RHO}, p AS (SELECT x.site, x.month, avg(x) AS mu, stddev_samp(x) AS sigma, min(x) AS x_min, any_value(rho) AS rho, any_value(tau) AS tau FROM x JOIN rho USING (site, month) JOIN tau USING (site, month) GROUP BY 1, 2),
 least_ AS (SELECT site, min(x_min) AS x_min FROM p GROUP BY 1), q_least AS (SELECT site, min(q) AS q_min FROM months GROUP BY 1),
 path(realization, site, t, x) AS (
  SELECT CAST(r AS INTEGER), site, 0, mu + sigma * {normal_sql(11, 'tf', 'CAST(r AS INTEGER)', 'site', '0')} FROM p, range(3) s(r) WHERE month = 1
  UNION ALL
  SELECT path.realization, path.site, path.t + 1, m.mu + m.rho * m.sigma / b.sigma * (path.x - b.mu) + sqrt(1 - m.rho * m.rho) * m.sigma * {normal_sql(11, 'tf', 'path.realization', 'path.site', 'path.t + 1')}
  FROM path JOIN p m ON m.site = path.site AND m.month = (path.t + 1) % 12 + 1 JOIN p b ON b.site = path.site AND b.month = path.t % 12 + 1 WHERE path.t < 59)
 SELECT realization, site, make_date(1995 + t // 12, t % 12 + 1, 1) AS ts, round(CASE WHEN q < 0 THEN q_min ELSE q END, 3) AS q
 FROM (SELECT realization, path.site, t, exp(CASE WHEN x < 0 THEN x_min ELSE x END) + tau AS q FROM path JOIN tau ON tau.site = path.site AND tau.month = t % 12 + 1 JOIN least_ ON least_.site = path.site) JOIN q_least USING (site)""")
def tf_generate(spark, sf):
    return rounded(thomas_fiering.ThomasFieringGenerator().fit(dense(spark, sf, whole=True)).generate(3, 5, seed=11), 3)


BOOT = f"boot AS (SELECT CAST(r AS INTEGER) AS realization, CAST(y AS INTEGER) AS syn_year, CAST(m AS INTEGER) AS month, CAST(floor({uniform_sql(repr('3'), repr('boot'), 'r', 'y', 'm')} * 6) AS INTEGER) AS hist_idx FROM range(4) a(r), range(6) b(y), range(1, 13) c(m))"


BOOTED = BOOT.replace("* 6)", "* (SELECT max(hist_idx) + 1 FROM z))").replace("range(6) b(y)", "range((SELECT max(hist_idx) + 1 FROM z)) b(y)")


@query(f"WITH {SCORES}, {BOOTED} SELECT * FROM boot")
def bootstrap_indices(spark, sf):
    """As many years as the record has whole ones, drawn from these."""
    m = months(spark, sf, whole=True)
    n = kirsch.complete_scores(m, stats.monthly_moments(m)).agg(F.max("hist_idx")).first()[0] + 1
    return kirsch.bootstrap(spark, 4, n - 1, n, 3)


@query(f"WITH {SCORES}, {BOOT} SELECT realization, site, syn_year, z.month, round(z, 6) AS x FROM boot JOIN z USING (hist_idx, month)")
def bootstrap_gather(spark, sf):
    m = months(spark, sf, whole=True)
    return rounded(kirsch.gathered(kirsch.bootstrap(spark, 4, 5, 6, 3), kirsch.complete_scores(m, stats.monthly_moments(m)), 6))


@query()
def kirsch_monthly(spark, sf):
    return rounded(kirsch.KirschGenerator().fit(dense(spark, sf, whole=True)).generate(3, 4, seed=1))


@query()
def kirsch_nowak_daily(spark, sf):
    return rounded(nowak.KirschNowakGenerator().fit(dense(spark, sf, whole=True)).generate(2, 2, seed=1))


CANDS = WHOLE + f""", padded AS (SELECT site, ts, q FROM dense UNION ALL SELECT d.site, CAST(DATE '{FIRST}' - i * INTERVAL 1 DAY AS DATE), d.q FROM dense d, range(1, 8) t(i) WHERE d.ts = DATE '{FIRST}'
  UNION ALL SELECT d.site, CAST(DATE '{LAST}' + i * INTERVAL 1 DAY AS DATE), d.q FROM dense d, range(1, 8) t(i) WHERE d.ts = DATE '{LAST}'),
 win AS (SELECT CAST(m AS INTEGER) AS month, CAST(y * 15 + s + 7 AS INTEGER) AS cand, CAST(make_date(1995 + CAST(y AS INTEGER), CAST(m AS INTEGER), 1) + s * INTERVAL 1 DAY AS DATE) AS begins, [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m] AS n FROM range(6) a(y), range(1, 13) b(m), range(-7, 8) c(s)),
 cand_days AS (SELECT w.month, w.cand, CAST(date_diff('day', w.begins, p.ts) + 1 AS INTEGER) AS day, p.site, p.q FROM win w JOIN padded p ON p.ts >= w.begins AND p.ts < w.begins + n * INTERVAL 1 DAY),
 totals AS (SELECT month, cand, sum(q) AS total FROM cand_days GROUP BY 1, 2),
 profile AS (SELECT month, cand, site, day, CASE WHEN sum(q) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE q / sum(q) OVER w END AS p FROM cand_days WINDOW w AS (PARTITION BY month, cand, site)),
 mon AS (SELECT 0 AS realization, site, date_trunc('month', ts)::DATE AS ts, sum(q) * 1.1 AS q FROM dense GROUP BY 1, 2, 3),
 asked AS (SELECT realization, ts, CAST(month(ts) AS INTEGER) AS month, sum(q) AS total FROM mon GROUP BY 1, 2),
 near AS (SELECT a.realization, a.ts, a.month, a.total, t.cand, abs(t.total - a.total) AS distance, row_number() OVER (PARTITION BY a.realization, a.ts ORDER BY abs(t.total - a.total), t.cand) AS rank FROM asked a JOIN totals t USING (month) QUALIFY rank <= 5),
 cum AS (SELECT *, sum(1 / (distance + 1e-10)) OVER (PARTITION BY realization, ts ORDER BY rank) / sum(1 / (distance + 1e-10)) OVER (PARTITION BY realization, ts) AS c, {uniform_sql(repr('9'), repr('nowak'), 'realization', 'ts', 'month')} AS u FROM near),
 pick AS (SELECT realization, ts, month, arg_min(cand, rank) AS cand FROM cum WHERE c >= u OR c >= 1 - 1e-12 GROUP BY 1, 2, 3)"""


def _raised(spark, sf):
    m = cal.resampled(dense(spark, sf, whole=True), "MS")
    return m.select(F.lit(0).alias("realization"), "site", "ts", (F.col("q") * 1.1).alias("q"))


@query(f"WITH {CANDS} SELECT * FROM totals")
def nowak_candidates(spark, sf):
    return nowak.candidate_totals(nowak.candidate_days(dense(spark, sf, whole=True)))


@query(f"WITH {CANDS} SELECT month, cand, site, day, round(p, 9) AS p FROM profile")
def nowak_profiles(spark, sf):
    return rounded(nowak.profiles(nowak.candidate_days(dense(spark, sf, whole=True))), 9)


@query(f"WITH {CANDS} SELECT realization, ts, month, CAST(rank AS INTEGER) AS rank, cand, round(distance, 4) AS distance FROM near")
def knn_topk(spark, sf):
    return rounded(nowak.NowakDisaggregator().fit(dense(spark, sf, whole=True)).find_neighbors(_raised(spark, sf)).drop("total"), 4)


@query(f"WITH {CANDS} SELECT * FROM pick")
def knn_weighted_pick(spark, sf):
    near = nowak.NowakDisaggregator().fit(dense(spark, sf, whole=True)).find_neighbors(_raised(spark, sf))
    return nowak.picked(near, ["realization", "ts", "month"], "distance_weighted", 9)


@query(f"WITH {CANDS}, d AS (SELECT m.realization, m.site, m.ts, m.q, p.day, p.p FROM mon m JOIN pick k ON k.ts = m.ts JOIN profile p ON p.month = k.month AND p.cand = k.cand AND p.site = m.site), e AS (SELECT * FROM d UNION ALL SELECT realization, site, ts, q, 29, p FROM d WHERE month(ts) = 2 AND day = 28 AND day(last_day(ts)) = 29) SELECT realization, site, CAST(ts + (day - 1) * INTERVAL 1 DAY AS DATE) AS ts, round(q * p / sum(p) OVER (PARTITION BY realization, site, ts), 6) AS q FROM e")
def nowak_disaggregate(spark, sf):
    return rounded(nowak.NowakDisaggregator().fit(dense(spark, sf, whole=True)).disaggregate(_raised(spark, sf), seed=9))


@query(f"WITH {MONTHS}, r AS (SELECT site, month, q / ((sum(q) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + sum(q) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 24) AS r, count(*) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n FROM (SELECT site, ts, CAST(month(ts) AS INTEGER) AS month, q FROM series)), m AS (SELECT site, month, avg(r) FILTER (n = 13) AS m FROM r GROUP BY 1, 2) SELECT site, month, round(m / avg(m) OVER (PARTITION BY site), 6) AS factor FROM m")
def seasonal_factors(spark, sf):
    return rounded(stats.seasonal_factors(monthly_series(spark, sf)))


@query(f"WITH {MONTHS}, t AS (SELECT site, ts, q, row_number() OVER (PARTITION BY site ORDER BY ts) AS t FROM series) SELECT site, t, round(q - regr_intercept(q, t) OVER w - regr_slope(q, t) OVER w * t, 4) AS q FROM t WINDOW w AS (PARTITION BY site)")
def detrended(spark, sf):
    from pyspark.sql import Window

    t = monthly_series(spark, sf).withColumn("t", F.row_number().over(Window.partitionBy("site").orderBy("ts")).cast("long"))
    return rounded(stats.detrended(t), 4)


@query(f"WITH RECURSIVE {MONTHS}, s AS (SELECT site, ts, q, row_number() OVER (PARTITION BY site ORDER BY ts) AS t, lag(q) OVER (PARTITION BY site ORDER BY ts) AS p FROM series), c AS (SELECT site, regr_slope(q, p) AS b, regr_intercept(q, p) AS a FROM s GROUP BY 1), f(site, step, q) AS (SELECT c.site, 1, a + b * last.q FROM c JOIN (SELECT site, arg_max(q, t) AS q FROM s GROUP BY 1) last USING (site) UNION ALL SELECT f.site, step + 1, a + b * f.q FROM f JOIN c USING (site) WHERE step < 12) SELECT site, step, round(q, 4) AS q FROM f")
def ar_fit_forecast(spark, sf):
    return rounded(autoregression.AR(lag=1).fit(monthly_series(spark, sf)).generate(12), 4)


@query()
def ar_seasonal_trend(spark, sf):
    return rounded(autoregression.AR(lag=2, trend=True, period=12).fit(monthly_series(spark, sf)).generate(24), 4)


def var_sql(sites: int, steps: int) -> str:
    """First-order vector autoregression: centred moments, Gauss-Jordan steps, then the recursion on lists of values."""
    made = [
        f"WITH RECURSIVE {MONTHS}, v AS (SELECT site, CAST(substr(site, 2) AS INTEGER) AS i, year(ts) * 12 + month(ts) AS t, q FROM series)",
        f"u AS (SELECT t FROM v GROUP BY 1 HAVING count(q) = {sites})",
        "z AS (SELECT t, i, q FROM v WHERE t IN (FROM u) AND t - 1 IN (FROM u) UNION ALL SELECT t + 1, 100 + i, q FROM v WHERE t IN (FROM u) AND t + 1 IN (FROM u))",
        "m AS (SELECT i, avg(q) AS m FROM z GROUP BY 1)",
        "d AS (SELECT t, i, q - m AS d FROM z JOIN m USING (i))",
        "g0 AS (SELECT a.i - 100 AS i, b.i AS j, sum(a.d * b.d) AS v FROM d a JOIN d b USING (t) WHERE a.i > 100 GROUP BY 1, 2)",
    ]
    for k in range(1, sites + 1):
        last = f"g{k - 1}"
        made.append(
            f"g{k} AS (SELECT g.i, g.j, CASE WHEN g.i = {k} THEN g.v / p.v ELSE g.v - c.v * r.v / p.v END AS v FROM {last} g, (FROM {last} WHERE i = {k} AND j = {100 + k}) p"
            f" JOIN {last} c ON c.j = {100 + k} JOIN {last} r ON r.i = {k} WHERE c.i = g.i AND r.j = g.j)"
        )
    made += [
        f"b AS (SELECT j AS i, list(v ORDER BY i) AS b FROM g{sites} WHERE j <= 100 GROUP BY 1)",
        "a AS (SELECT b.i, b.b, m.m - list_dot_product(b.b, (SELECT list(m ORDER BY i) FROM m WHERE i > 100)) AS a FROM b JOIN m USING (i))",
        "ab AS (SELECT list(a ORDER BY i) AS a, list(b ORDER BY i) AS b FROM a)",
        "f(step, x) AS (SELECT 0, list(q ORDER BY i) FROM z WHERE i < 100 AND t = (SELECT max(t) FROM z) GROUP BY t"
        f" UNION ALL SELECT step + 1, [{', '.join(f'ab.a[{k}] + list_dot_product(ab.b[{k}], x)' for k in range(1, sites + 1))}] FROM f, ab WHERE step < {steps})",
    ]
    return ", ".join(made) + " SELECT 'L' || k AS site, step, round(x[k], 4) AS q FROM f, (SELECT unnest(range(1, " + str(sites + 1) + ")) AS k) WHERE step > 0"


@query(var_sql(7, 12))
def var_forecast(spark, sf):
    return rounded(autoregression.VAR(lag=1, step="month").fit(monthly_series(spark, sf)).generate(12), 4)


@query()
def hmm_generate(spark, sf):
    return rounded(hmm.HMMGenerator().fit(monthly_series(spark, sf)).generate(2, 3, seed=4), 4)


@query()
def hmm_seasonal(spark, sf):
    """In log space and without seasons, which come back with the generated flows."""
    return rounded(hmm.HMMGenerator(log_transform=True, deseasonalize=True).fit(monthly_series(spark, sf)).generate(2, 12, seed=4), 4)


@query()
def hmm_states(spark, sf):
    return hmm.HMMGenerator().fit(monthly_series(spark, sf)).states.select("site", "ts", "state")
