"""Operators and generators against small formulas and invariants."""

import datetime as dt
import math
import time
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnflow.functions import rng, special
from tarnflow.operators import calendar as cal
from tarnflow.operators import drought, ensemble, quantiles, recursion, ssi, stats, validation, windows
from tarnflow.plans import autoregression, hmm, kirsch, nowak, thomas_fiering
from tarnflow.sources import flows
from tarnflow.streaming.droughts import streamed_events
from tarnflow.streaming.totals import streamed_totals

FLOW = "site string, ts date, q double"


def day(n, first=dt.date(2000, 1, 1)):
    return first + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def hist(spark):
    """Three correlated sites, 30 years of seasonal log-normal days."""
    base = spark.range(365 * 30 + 8).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("ts"), "id").where("ts < '2000-01-01'")
    common = rng.normal(1, "c", F.date_format("ts", "yyyyMM"))
    sites = base.select("ts", "id", F.explode(F.array(*map(F.lit, "ABC"))).alias("site"))
    own = rng.normal(1, "o", "site", F.date_format("ts", "yyyyMM"))
    q = F.exp(2 + 0.6 * F.sin(2 * math.pi * F.dayofyear("ts") / 365.25) + 0.5 * common + 0.2 * own + 0.2 * rng.normal(1, "d", "site", "id"))
    return sites.select("site", "ts", q.alias("q")).cache()


@pytest.fixture(scope="module")
def monthly(hist):
    return cal.resampled(hist, "MS").cache()


def brute_gamma_p(a, x):
    """A sum of Poisson-like terms."""
    if x <= 0 or math.isinf(x):
        return float(x > 0)
    return min(1.0, math.fsum(math.exp((a + k) * math.log(x) - x - math.lgamma(a + k + 1)) for k in range(int(80 + max(x - a, 0) + 12 * math.sqrt(x)))))


def brute_beta_i(a, b, x):
    if x > (a + 1) / (a + b + 2):
        return 1 - brute_beta_i(b, a, 1 - x)
    return math.fsum(math.exp(math.lgamma(a + b + k) - math.lgamma(b) - math.lgamma(a + k + 1) + (a + k) * math.log(x) + b * math.log1p(-x)) for k in range(4000)) if x > 0 else 0.0


def test_special_functions(spark):
    """Against the standard library and sums of other series; arguments outside a domain give null."""
    c, nan, inf = F.col, math.nan, math.inf
    x = [-30.0, -8.0, -7.1, -7.0, -5.0, -1.0, -0.1, 0.0, 0.1, 2.5, 6.0, 7.2, 40.0, inf, -inf, nan, None]
    for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", special.norm_cdf(c("x")).alias("p")).collect():
        assert r.p is None if r.x is None or math.isnan(r.x) else math.isclose(r.p, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=1e-8, abs_tol=1e-15) and abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-14
    p = [1e-300, 1e-20, 1e-5, 0.01, 0.3, 0.4999, 0.5, 0.51, 0.999, 1 - 1e-12, 0.0, 1.0, -1.0, 2.0, nan, None]
    for r in spark.createDataFrame([(v,) for v in p], "p double").select("p", special.norm_ppf("p").alias("z")).collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-8 if r.p and 0 < r.p < 1 else r.z is None
    points = [(float(a), float(v)) for a in (0.02, 0.5, 1, 3.3, 40, 900, 25_000) for v in (0, 1e-6, 0.3, 1, 1.6, 4.4, 39, 41.5, 60, 905, 24_800, 25_002.5)] + [(1.0, inf)]
    columns = [special.gamma_p(c("a"), c("x")).alias("p"), special.gamma_q(c("a"), c("x")).alias("q"), special.lgamma(c("a")).alias("l")]
    for r in spark.createDataFrame(points, "a double, x double").select("a", "x", *columns).collect():
        assert abs(r.p - brute_gamma_p(r.a, r.x)) < 1e-10 and abs(r.p + r.q - 1) < 1e-12 and math.isclose(r.l, math.lgamma(r.a), rel_tol=1e-13, abs_tol=1e-13)
    betas = [(a, b, v) for a in (0.5, 2.0, 35.0, 3000.0) for b in (0.5, 3.0, 500.0) for v in (0.0, 1e-3, 0.2, 0.77, 0.93, 1.0)]
    for r in spark.createDataFrame(betas, "a double, b double, x double").select("*", special.beta_i(c("a"), c("b"), c("x")).alias("p")).collect():
        assert abs(r.p - (1.0 if r.x == 1 else brute_beta_i(r.a, r.b, r.x))) < 1e-10
    euler = 0.5772156649015329
    one = spark.range(1).select(*[f(F.lit(v)) for f, v in ((special.digamma, 1.0), (special.digamma, 0.5), (special.trigamma, 1.0), (special.trigamma, 0.5))]).first()
    assert np.allclose(one, [-euler, -euler - 2 * math.log(2), math.pi**2 / 6, math.pi**2 / 2], rtol=1e-14)
    bad = spark.range(1).select(special.gamma_p(F.lit(-1.0), F.lit(1.0)), special.gamma_p(F.lit(1.0), F.lit(-1.0)), special.lgamma(F.lit(0.0)), special.beta_i(F.lit(0.0), F.lit(1.0), F.lit(0.5)), special.gamma_cdf(F.lit(1.0), F.lit(1.0), F.lit(0.0)))
    assert list(bad.first()) == [None] * 5
    huge = spark.range(1).select(special.gamma_p(F.lit(9e8), F.lit(9e8 + 3e4)), special.gamma_p(F.lit(1.1e9), F.lit(1.1e9 + math.sqrt(1.1e9)))).first()
    assert abs(huge[0] - huge[1]) < 1e-5 and abs(huge[0] - NormalDist().cdf(1)) < 1e-5
    assert "Python" not in spark.range(1).select(special.f_sf(F.lit(2.0), F.lit(3.0), F.lit(9.0)))._jdf.queryExecution().toString()


def test_gamma_by_maximum_likelihood(spark):
    """The fold of Newton steps finds the maximum of the likelihood that a search over shapes finds."""
    rng = np.random.default_rng(5)
    samples = {f"s{i}": np.maximum(rng.gamma(k, 3, n), 1e-9) for i, (k, n) in enumerate([(0.05, 40), (0.7, 9), (2, 2), (30, 50), (5000, 30)])}
    rows = [(s, float(v)) for s, vs in samples.items() for v in vs] + [("s1", 0.0), ("s1", -1.0), ("s1", None), ("one", 3.0), ("same", 2.0), ("same", 2.0), ("none", 0.0)]
    got = {r.site: r for r in ssi.gamma_ml_params(spark.createDataFrame(rows, "site string, q double"), ["site"]).collect()}
    for s, vs in samples.items():
        mean, mean_log = vs.mean(), np.log(vs).mean()

        def likelihood(k):
            return (k - 1) * mean_log - k - k * math.log(mean / k) - math.lgamma(k)

        low, high = 1e-3, 1e6
        for _ in range(200):  # golden sections of the log shape
            a, b = low * (high / low) ** 0.382, low * (high / low) ** 0.618
            low, high = (low, b) if likelihood(a) > likelihood(b) else (a, high)
        assert math.isclose(got[s].shape, low, rel_tol=1e-4) and math.isclose(got[s].scale, mean / got[s].shape, rel_tol=1e-12)
        assert likelihood(got[s].shape) >= likelihood(low) - 1e-10 * abs(likelihood(low))
    assert got["s1"].p0 == 2 / 11 and [got[s].shape for s in ("one", "same", "none")] == [None] * 3 and got["none"].p0 == 1


def test_own_distribution(spark, monthly):
    """A distribution of the user's own: log-normal, against numpy."""
    def params(values, by):
        return values.where("q > 0").groupBy(*by).agg(F.avg(F.ln("q")).alias("mu"), F.stddev_samp(F.ln("q")).alias("sigma"))

    own = ssi.Distribution(params, lambda q: special.norm_cdf((F.ln(q) - F.col("mu")) / F.col("sigma")))
    got = {(r.site, r.ts): r.ssi for r in ssi.SSI(window=1, dist=own).fit_transform(monthly).collect()}
    rows = [(r.site, r.ts, r.q) for r in monthly.collect()]
    x = np.log([q for s, ts, q in rows if s == "B" and ts.month == 3])
    assert all(abs(got[s, ts] - (math.log(q) - x.mean()) / x.std(ddof=1)) < 1e-6 for s, ts, q in rows if s == "B" and ts.month == 3)


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(1000).select("id", rng.uniform(3, "x", "id").alias("u"), rng.normal(3, "x", "id").alias("e"))
    b = spark.range(1000).repartition(7).select("id", rng.uniform(3, "x", "id").alias("u"), rng.normal(3, "x", "id").alias("e"))
    assert sorted(a.collect()) == sorted(b.collect())
    u, e = np.array([(r.u, r.e) for r in a.collect()]).T
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03 and abs(e.mean()) < 0.1 and abs(e.std() - 1) < 0.1


def runs(values):
    """Droughts by walking: runs below 0 that reach -1 and end."""
    out, run = [], []
    for i, v in enumerate([*values]):
        if v is not None and v < 0:
            run.append(i)
        else:
            if run and min(values[j] for j in run) <= -1:
                out.append((run[0], run[-1]))
            run = []
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.none(), st.sampled_from([-2.0, -1.0, -0.5, 0.0, 0.7])), max_size=30))
def test_drought_runs(spark, values):
    df = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(values)], "site string, ts date, ssi double")
    got = sorted((r.start, r.end) for r in drought.events(df).collect())
    assert got == [(day(a), day(b)) for a, b in runs(values)]


def test_drought_start_rules(spark):
    df = spark.createDataFrame([("s", day(i), v) for i, v in enumerate([-0.5, -1.5, -1.2, -0.1, 0.3])], "site string, ts date, ssi double")
    first, last = drought.events(df).first(), drought.events_of_ensemble(df, ["site"]).first()
    assert (first.start, first.end, first.duration, first.severity) == (day(0), day(3), 4, -1.5)
    assert round(first.magnitude, 6) == -3.3 and last.start == day(2)


def dry_spells(values, least=3, end_after=3):
    """(first, last + 1) by walking: a state, a start and two counters."""
    spells, dry, start, stop, against, count = [], False, 0, 0, 0, 0
    for i, v in enumerate(values):
        if not dry:
            if v < 0:
                start = i if count == 0 else start
                count, against = count + 1, max(0, against - 1)
                if count >= least:
                    dry, count, against = True, 0, 0
            else:
                count, against = max(0, count - 1), against + 1
                if against > 6:
                    count = against = 0
        elif v < 0:
            stop = i if against == 0 else stop
            against = max(0, against - 1)
        else:
            stop = i if against == 0 else stop
            against += 1
            if against >= end_after:
                spells.append((start, stop))
                dry, count, against = False, 0, 0
    return spells + ([(start, len(values))] if dry else [])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([-2.0, -1.0, 0.5, 1.0]), max_size=40))
def test_hysteresis(spark, values):
    want = [(day(a), day(b - 1), b - a) for a, b in dry_spells(values) if b > a and np.mean(values[a:b]) < -0.6]
    df = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(values)], "site string, ts date, ssi double")
    assert sorted((r.start, r.end, r.duration) for r in drought.hysteresis(df).collect()) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=20), st.integers(1, 5))
def test_rolling(spark, values, w):
    df = spark.createDataFrame([("s", day(i), None if v is None else float(v)) for i, v in enumerate(values)], FLOW)
    want = [(day(i), float(sum(values[i - w + 1 : i + 1]))) for i in range(w - 1, len(values)) if None not in values[i - w + 1 : i + 1]]
    assert sorted((r.ts, r.q) for r in windows.rolling(df, w).collect()) == want
    ahead = [(day(i), float(sum(values[i : i + w]))) for i in range(len(values) - w + 1) if None not in values[i : i + w]]
    assert sorted((r.ts, r.q) for r in windows.rolling(df, w, forward=True).collect()) == ahead


def test_calendar(spark):
    df = spark.createDataFrame([("s", day(0), 1.0), ("s", day(1), None), ("s", day(75), 4.0)], FLOW)
    assert [(r.year, r.month, r.q) for r in cal.monthly_totals(df).orderBy("month").collect()] == [(2000, 1, 1.0), (2000, 3, 4.0)]
    assert [r.q for r in cal.resampled(df, "MS", fill=True).orderBy("ts").collect()] == [1.0, 0.0, 4.0]
    only_missing = spark.createDataFrame([("s", day(0), None)], FLOW)
    assert cal.monthly_totals(only_missing).first().q == 0.0 and cal.resampled(only_missing, "M", "mean").first().q is None
    assert cal.resampled(spark.createDataFrame([("s", dt.date(2024, 1, 7), 1.0), ("s", dt.date(2024, 1, 8), 2.0)], FLOW), "W-SUN").orderBy("ts").first().ts == dt.date(2024, 1, 7)
    with pytest.raises(ValueError):
        cal.resampled(df, "Q")
    with pytest.raises(Exception, match="bad flow"):
        cal.checked_non_negative(df).collect()
    assert {r.q for r in cal.filled(df).collect()} == {1.0, 4.0}
    with pytest.raises(TypeError):
        flows.validated([1])
    with pytest.raises(ValueError):
        flows.validated(df.drop("q"))


def test_l_moments_of_a_line(spark):
    df = spark.createDataFrame([("s", day(i), float(i)) for i in range(11)], FLOW)
    r = stats.l_moments(df).first()
    assert (r.n, r.l1, r.l2) == (11, 5.0, 2.0) and abs(r.t3) < 1e-12


def test_normal_scores(spark):
    train = spark.createDataFrame([("s", v) for v in (1.0, 2.0, 2.0, 5.0)], "site string, q double")
    new = spark.createDataFrame([("s", v) for v in (0.0, 2.0, 9.0)], "site string, q double")
    assert sorted((r.q, r.cdf) for r in windows.normal_scores(train, new, ["site"]).collect()) == [(0.0, 0.125), (2.0, 0.375), (9.0, 1.125)]


def test_ssi(monthly):
    for dist in ("gamma", "pearson3", "normal_scores"):
        s = ssi.SSI(window=12, dist=dist).fit(monthly)
        rows = s.training_ssi().where("site = 'A'").collect()
        v = np.array([r.ssi for r in rows if r.ssi is not None])
        most = 2.0 if dist == "pearson3" else 1.2  # its approximate relations spread the index
        assert len(rows) == 360 - 11 and abs(v.mean()) < 0.2 and 0.7 < v.std() < most, dist
        assert s.transform(monthly.where("ts >= '1990-01-01'")).where("site = 'B'").count() == 120 - 11
    with pytest.raises(ValueError):
        ssi.SSI(dist="other")
    with pytest.raises(RuntimeError):
        ssi.SSI().transform(monthly)


def test_kirsch(spark, hist, monthly):
    g = kirsch.KirschGenerator().fit(hist)
    assert g.n_hist == 30
    u = {(r.k, r.j): r.u for r in g.u.where("site = 'A'").collect()}
    m = np.array([[u.get((k, j), 0.0) for j in range(1, 13)] for k in range(1, 13)])
    corr = {(r.m1, r.m2): r.r for r in stats.month_correlations(g.z).where("site = 'A'").collect()}
    c = np.array([[corr[i, j] for j in range(1, 13)] for i in range(1, 13)])
    assert np.abs(m.T @ m - c).max() < 1e-6
    out = g.generate(20, 10, seed=5)
    assert out.count() == 20 * 10 * 12 * 3 and out.select(F.min("ts")).first()[0] == dt.date(2000, 1, 1)
    assert sorted(out.collect()) == sorted(g.generate(20, 10, seed=5).repartition(9).collect())
    a, b = (x.groupBy("site").agg(F.avg(F.ln("q")).alias("m"), F.stddev(F.ln("q")).alias("s")).orderBy("site").collect() for x in (out, monthly))
    assert all(abs(x.m - y.m) < 0.15 and abs(x.s - y.s) < 0.15 for x, y in zip(a, b))
    r = {(x.site1, x.site2): x.r for x in stats.site_correlations(out.where("realization = 0")).collect()}
    assert r["A", "B"] > 0.5  # the sites share their draws
    draws = kirsch.bootstrap(spark, 1, 2, 30, 1)
    assert g.generate(boot=draws, n_years=2).count() == 72
    with pytest.raises(ValueError):
        g.generate(boot=draws.where("month < 12"), n_years=2)
    with pytest.raises(RuntimeError):
        kirsch.KirschGenerator().generate()
    with pytest.raises(NotImplementedError):
        g.preprocessing(hist, "daily")
    flat = hist.where("year(ts) < 1980").withColumn("q", F.lit(1.0))
    with pytest.raises(ValueError, match="no variance"):
        kirsch.KirschGenerator().fit(flat)


def test_repair():
    singular = np.ones((12, 12))
    u = kirsch.upper_factor(singular)
    assert np.allclose(np.diag(u.T @ u), 1) and np.isfinite(u).all()


def test_half_year_shift(spark):
    z = spark.createDataFrame([("s", y, m, float(100 * y + m)) for y in range(3) for m in range(1, 13)], "site string, hist_idx int, month int, z double")
    got = {(r.hist_idx, r.month): r.z for r in kirsch.half_year_shifted(z).collect()}
    assert len(got) == 24 and got[0, 1] == 7.0 and got[0, 7] == 101.0 and got[1, 12] == 206.0


@pytest.mark.parametrize("method", ["distance_weighted", "lall_and_sharma_1996"])
def test_nowak(hist, monthly, method):
    g = nowak.NowakDisaggregator().fit(hist)
    coarse = monthly.where("year(ts) IN (1976, 1977)").select(F.lit(0).alias("realization"), "site", "ts", (F.col("q") * 1.3).alias("q"))
    fine = g.disaggregate(coarse, sample_method=method, seed=2)
    assert fine.count() == 3 * 731
    back = {(r.site, r.ts): r.q for r in cal.resampled(fine, "MS").collect()}
    assert all(abs(back[r.site, r.ts] - r.q) < 1e-6 * r.q for r in coarse.collect())
    assert fine.where("q < 0 OR q IS NULL").count() == 0
    feb = {r.ts.day: r.q for r in fine.where("site = 'A' AND ts BETWEEN '1976-02-28' AND '1976-02-29'").collect()}
    assert abs(feb[28] - feb[29]) < 1e-12
    assert nowak.candidate_totals(nowak.candidate_days(hist)).count() == 12 * 15 * 30
    with pytest.raises(ValueError):
        g.disaggregate(coarse.where("site = 'A'"))
    with pytest.raises(ValueError):
        g.disaggregate(coarse, sample_method="other")


def test_nearest_ties(spark):
    totals = spark.createDataFrame([(1, c, t) for c, t in ((4, 9.0), (2, 11.0), (3, 9.0), (1, 30.0))], "month int, cand int, total double")
    ask = spark.createDataFrame([(0, 1, 10.0)], "realization int, month int, total double")
    assert [r.cand for r in nowak.nearest(totals, ask, 3).orderBy("rank").collect()] == [2, 3, 4]


def test_kirsch_nowak(hist):
    g = nowak.KirschNowakGenerator().fit(hist)
    out = g.generate(2, 3, seed=3)
    assert out.groupBy("realization", "site").count().where("count <> 1096").count() == 0 and out.where("q IS NULL OR q < 0").count() == 0


@pytest.mark.parametrize("rho", ["reference", "classical"])
def test_thomas_fiering(hist, monthly, rho):
    out = thomas_fiering.ThomasFieringGenerator(rho).fit(hist).generate(10, 20, seed=1)
    assert out.count() == 10 * 20 * 12 * 3 and out.where("q IS NULL OR q < 0").count() == 0
    a, b = (x.groupBy("site", F.month("ts").alias("m")).agg(F.avg("q").alias("q")).orderBy("site", "m").collect() for x in (out, monthly))
    assert np.corrcoef([r.q for r in a], [r.q for r in b])[0, 1] > 0.9


def test_hmm(spark):
    rng_ = np.random.default_rng(0)
    state, rows, truth = 0, [], []
    for i in range(600):
        state = state if rng_.random() < 0.93 else 1 - state
        truth.append(state)
        rows.append(("s", dt.date(1950 + i // 12, i % 12 + 1, 1), float(rng_.normal((20, 60)[state], 5))))
    df = spark.createDataFrame(rows, FLOW)
    g = hmm.HMMGenerator().fit(df)
    m = g.models.first()
    assert abs(m.mu[0] - 20) < 2 and abs(m.mu[1] - 60) < 2 and m.p[0][0] > 0.85
    got = [r.state for r in g.states.orderBy("ts").collect()]
    assert np.mean(np.array(got) == np.array(truth)) > 0.98
    out = g.generate(5, 30, seed=1)
    assert out.count() == 5 * 360 and abs(out.select(F.avg("q")).first()[0] - np.mean([r[2] for r in rows])) < 8
    seasonal = hmm.HMMGenerator(log_transform=True, deseasonalize=True, max_iter=20).fit(df).generate(1, 2)
    assert seasonal.where("q IS NULL").count() == 0
    pi = g.models.select(stats.stationary(F.col("p"))).first()[0]
    assert abs(sum(pi) - 1) < 1e-9 and np.allclose(np.array(pi) @ np.array(m.p), pi)
    with pytest.raises(TypeError):
        hmm.HMMGenerator(n_hidden_states="2")


def test_autoregression(spark):
    x = [3.0]
    for _ in range(40):
        x.append(2 + 0.5 * x[-1])
    df = spark.createDataFrame([("s", day(i), v) for i, v in enumerate(x)], FLOW)
    a = autoregression.AR(1).fit(df.where("ts < '2000-01-15'"))
    want, got = [x[13]], [r.q for r in a.generate(5).orderBy("step").collect()]
    for _ in range(5):
        want.append(2 + 0.5 * want[-1])
    assert np.allclose(got, want[1:], atol=1e-4)
    two = [(s, day(i), float(v)) for i in range(60) for s, v in (("a", math.sin(i / 3)), ("b", math.cos(i / 3)))]
    v = autoregression.VAR(1).fit(spark.createDataFrame(two, FLOW))
    b = {(r.site, r.step): r.q for r in v.generate(4).collect()}
    assert abs(b["a", 3] - math.sin(62 / 3)) < 1e-6 and abs(b["b", 4] - math.cos(63 / 3)) < 1e-6
    wave = [("s", day(i), 5 + 0.1 * i + (i % 4) * 2.0 + 0.01 * math.sin(i * i)) for i in range(80)]
    t = autoregression.AR(1, trend=True, period=4).fit(spark.createDataFrame(wave, FLOW)).generate(8)
    assert all(abs(r.q - (5 + 0.1 * (79 + r.step) + ((79 + r.step) % 4) * 2)) < 0.2 for r in t.collect())


def test_autoregression_of_large_flows(spark):
    """Flows in the millions that vary little: lags are all but collinear with the constant, dummies are tiny beside them."""
    rng = np.random.default_rng(8)
    x = 5e7 + 1e4 * rng.normal(size=80).cumsum() + 1e5 * (np.arange(80) % 4)
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(x)], FLOW)
    mean = x.mean()
    for lag, trend, period in ((1, False, None), (2, True, 4)):
        design = np.array([[1.0, *[x[i - k] - mean for k in range(1, lag + 1)], *([i + 1 - 40] if trend else []), *[i % 4 == s for s in range(1, period or 1)]] for i in range(lag, 80)])
        coef = np.linalg.lstsq(design, x[lag:] - mean, rcond=None)[0]
        got = autoregression.AR(lag, trend, period).fit(df).params.iloc[0]
        want = coef[1:]
        assert np.allclose([float(v) for v in got[2:]], want, rtol=1e-6, atol=1e-9)
        path = list(x - mean)
        for i in range(80, 86):
            row = [1.0, *[path[i - k] for k in range(1, lag + 1)], *([i + 1 - 40] if trend else []), *[i % 4 == s for s in range(1, period or 1)]]
            path.append(np.dot(row, coef))
        made = [r.q for r in autoregression.AR(lag, trend, period).fit(df).generate(6).orderBy("step").collect()]
        assert np.allclose(made, np.array(path[80:]) + mean, rtol=0, atol=1e-2)


def test_var_lags_gaps_and_blocks(spark):
    """Two lags against least squares over whole steps only; long forecasts do not depend on the size of blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 3)).cumsum(axis=0) * 0.3 + rng.normal(size=(90, 3))
    rows = [(s, day(i), float(x[i, j])) for i in range(90) for j, s in enumerate("abc") if i != 40 and (i, s) != (60, "b")] + [("a", day(70), None)]
    v = autoregression.VAR(2).fit(spark.createDataFrame(rows, FLOW))
    whole = [i for i in range(2, 90) if not {i, i - 1, i - 2} & {40, 60}]
    design = np.array([[1.0, *x[i - 1], *x[i - 2]] for i in whole])
    coef = np.linalg.lstsq(design, x[whole], rcond=None)[0]
    assert np.allclose(v.coef, coef, atol=1e-9)
    past, want = [x[89], x[88]], []
    for _ in range(50):
        past.insert(0, np.array([1.0, *past[0], *past[1]]) @ coef)
        want.append(past[0])
    for block in (128, 7, 1):
        got = {(r.site, r.step): r.q for r in v.generate(50, block).collect()}
        assert len(got) == 150 and all(abs(got[s, k + 1] - want[k][j]) < 1e-6 for k in range(50) for j, s in enumerate("abc"))
    with pytest.raises(ValueError):
        autoregression.VAR(3).fit(spark.createDataFrame(rows[:6], FLOW))


def test_ensemble_files(spark, tmp_path):
    rows = [(r, s, day(i), float(r * 10 + i)) for r in (3, 7, 9) for s in "AB" for i in range(3)]
    e = spark.createDataFrame(rows, "realization int, site string, ts date, q double")
    flows.write_ensemble(e, str(tmp_path / "e"))
    back = flows.read_ensemble(spark, str(tmp_path / "e"), [3, 9])
    assert {r.realization for r in back.collect()} == {0, 1} and back.count() == 12
    with pytest.raises(ValueError):
        flows.read_ensemble(spark, str(tmp_path / "e"), [4])
    named = e.select(F.concat(F.lit("realization_"), "realization").alias("realization"))
    assert sorted(r.realization for r in flows.realization_numbers(named).collect()) == ["3", "7", "9"]
    en = ensemble.Ensemble(e)
    assert en.by_realization(["A", "B"]).columns == ["realization", "ts", "A", "B"] and en.by_site([3, 7]).columns == ["site", "ts", "realization_3", "realization_7"]
    again = ensemble.Ensemble.of({"A": e.where("site = 'A'").drop("site"), "B": e.where("site = 'B'").drop("site")})
    assert sorted(again.flows.collect()) == sorted(en.flows.collect())
    assert ensemble.Ensemble.of({3: e.where("realization = 3").drop("realization")}).flows.count() == 6
    with pytest.raises(ValueError):
        ensemble.Ensemble.of({2.5: e})


def test_csv(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("datetime,a,b\n2000-01-01,1,2\n2000-01-02,,4\n")
    got = {(r.site, str(r.ts)): r.q for r in flows.read_wide_csv(spark, str(path)).collect()}
    assert got == {("a", "2000-01-01"): 1.0, ("b", "2000-01-01"): 2.0, ("a", "2000-01-02"): None, ("b", "2000-01-02"): 4.0}
    dealt = {str(r.ts) for r in flows.read_wide_csv(spark, str(path), first_day="1945-01-01").collect()}
    assert dealt == {"1945-01-01", "1945-01-02"}
    flows.write_wide_csv(flows.read_wide_csv(spark, str(path)), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["ts", "a", "b"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", dt.datetime(2024, 1, d, h), 1.0) for d in (1, 2, 9) for h in (1, 5)]
    spark.createDataFrame(rows, "site string, ts timestamp, q double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("site string, ts timestamp, q double").parquet(str(src))
    q = streamed_totals(stream).writeStream.outputMode("append").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.site, r.start.day): (r.q, r.n) for r in spark.table("totals").collect()}
    assert got == {("a", 1): (2.0, 2), ("a", 2): (2.0, 2)}  # the last day is still open


def test_stream_of_droughts(spark, tmp_path):
    """Shuffled micro-batches give the events of the batch operator; what is later than the watermark is left out."""
    rng = np.random.default_rng(11)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for site in ("a", "b", "c"):
        v = np.convolve(rng.normal(size=124), np.ones(5) / 2, "valid")
        rows += [(site, start + dt.timedelta(days=i), None if i % 37 == 36 else float(x)) for i, x in enumerate(v)]
    rows += [("z", start + dt.timedelta(days=i), x) for i, x in enumerate((-2.0, -0.5, 0.0, -0.4, 1.0))]
    rows.sort(key=lambda r: r[1] + dt.timedelta(days=float(rng.uniform(0, 9))))
    parts = [rows[i : i + 80] for i in range(0, len(rows), 80)]
    ends = [(s, start + dt.timedelta(days=400), 1.0) for s in ("a", "b", "c", "z")]
    parts += [ends, [("a", start + dt.timedelta(days=3), -9.0), ("a", start + dt.timedelta(days=420), 1.0)]]  # the first is too late
    kind = "site string, ts timestamp, ssi double"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        time.sleep(0.05)  # files are taken by their time
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(key, store)
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
        out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
        q = streamed_events(stream, late="10 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None and not q.isActive
    finally:
        spark.conf.unset(key)
    want = drought.events(spark.createDataFrame(rows + ends, kind)).collect()
    order = lambda r: (r.site, r.drought_id)
    got = sorted(spark.read.parquet(out).collect(), key=order)
    assert len(want) > 6 and len(got) == len(want)
    for a, b in zip(got, sorted(want, key=order)):
        assert (a.site, a.drought_id, a.start, a.end, a.duration, a.severity) == (b.site, b.drought_id, b.start, b.end, b.duration, b.severity)
        assert abs(a.magnitude - b.magnitude) < 1e-9


def test_diagnostics(spark):
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], FLOW)
    b = stats.box_stats(df, ["site"]).first()
    assert (b.q1, b.q2, b.q3, b.low, b.high) == (2.0, 3.0, 4.0, 1.0, 4.0)
    h = stats.histogram(df, 4).orderBy("bin").collect()
    assert [r.bin for r in h] == [1, 4] and abs(sum(r.density for r in h) * 99 / 4 - 1) < 1e-12
    k = stats.kernel_density(df, 200).collect()
    assert sum(r.density for r in k) > 0
    e = spark.createDataFrame([("u", "d")], "upstream string, downstream string")
    net = spark.createDataFrame([("u", day(0), 2.0), ("d", day(0), 5.0)], FLOW)
    assert {r.site: r.q for r in flows.marginal_inflow(net, e).collect()} == {"u": 2.0, "d": 3.0}
    hist = spark.createDataFrame([(s, y, p, float(10 * y + p)) for s in "ab" for y in (1, 2) for p in (1, 2)], "site string, year int, period int, q double")
    drawn = ensemble.resampled_history(hist, 4, 1)
    assert drawn.count() == 4 * 2 * 2 * 2
    same = drawn.groupBy("realization", "year", "period").agg(F.countDistinct("q").alias("n")).where("n > 1")
    assert same.count() == 0


def test_hmm_queries_iterate_by_default(spark, sf, monkeypatch):
    from tarnflow import queries

    seen = {}

    def fit(self, monthly):
        seen["rounds"] = self.rounds
        raise StopIteration

    monkeypatch.setattr(hmm.HMMGenerator, "fit", fit)
    for name in ("hmm_generate", "hmm_states"):
        with pytest.raises(StopIteration):
            queries.QUERIES[name](spark, sf)
        assert seen.pop("rounds") == 100


def test_index_options(spark):
    """A normal index by day of the year, with neighbouring days in the fit, against numpy; unknown options raise."""
    rng = np.random.default_rng(8)
    days = [day(d, dt.date(1999, 1, 1)) for d in range(3 * 365)]
    q = rng.gamma(2, 3, len(days))
    flow = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days, q)], FLOW)
    got = {r.ts: r.ssi for r in ssi.SSI(window=1, dist="normal", freq="dayofyear", fit_window=2).fit_transform(flow).collect()}
    number = np.array([d.timetuple().tm_yday for d in days])
    for i in range(0, len(days), 50):
        apart = np.abs(number - number[i])
        pool = q[np.minimum(apart, 366 - apart) <= 2]
        assert abs(got[days[i]] - (q[i] - pool.mean()) / pool.std(ddof=1)) < 1e-9
    every = {r.ts: r.ssi for r in ssi.SSI(window=1, dist="normal", freq="all").fit_transform(flow).collect()}
    assert abs(every[days[7]] - (q[7] - q.mean()) / q.std(ddof=1)) < 1e-9
    for bad in ({"dist": "beta"}, {"freq": "hour"}, {"freq": "month", "fit_window": 6}):
        with pytest.raises(ValueError):
            ssi.SSI(**bad)
    with pytest.raises(ValueError):
        flows.realization_numbers(spark.createDataFrame([(1.5,)], "realization double"))


@pytest.mark.parametrize("small", [1, 40, 10**6])
def test_quantiles_by_counting(spark, small):
    """Narrowed ranges give what numpy gives, on ties, single values, heavy tails and huge ranges."""
    rng = np.random.default_rng(3)
    groups = {
        "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([5.0]), "same": np.full(50, 2.5), "normal": rng.normal(size=500), "tails": np.exp(rng.normal(size=300) * 20),
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 1e-300, 1.0, 2.0, 2.0]), "two": np.array([1.0, 3.0]), "least": np.array([0.0, 5e-324, 5e-324, 0.0]), "mixed": np.concatenate([np.zeros(200), rng.random(20), [1e9]]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None)], "site string, q double").repartition(3)
    p = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r.site, r.i): (r.p, r.q) for r in quantiles.quantiles(df, p, ["site"], small=small, bins=128).collect()}
    assert set(got) == {(g, i) for g in groups for i in range(len(p))}
    exact = {r.site: r.v for r in df.groupBy("site").agg(F.percentile("q", F.array(*map(F.lit, p))).alias("v")).collect()}
    for g, vs in groups.items():
        for i, x in enumerate(p):
            assert got[g, i] == (x, exact[g][i])
            if g != "huge":
                assert math.isclose(got[g, i][1], np.quantile(vs, x), rel_tol=1e-9, abs_tol=1e-12)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.floats(-2, 2), st.floats(-5, 5)), min_size=1, max_size=60), st.integers(1, 9))
def test_affine_path(spark, maps, block):
    rows = [(s, t, a, b * k) for k, s in ((1, "x"), (2, "y")) for t, (a, b) in enumerate(maps)]
    got = recursion.affine_path(spark.createDataFrame(rows, "site string, t int, a double, b double").repartition(3), ["site"], len(maps), max(block, 2)).collect()
    for k, s in ((1, "x"), (2, "y")):
        x, want = 0.0, []
        for a, b in maps:
            x = a * x + b * k
            want.append(x)
        mine = [r.x for r in sorted((r for r in got if r.site == s), key=lambda r: r.t)]
        scale = max(1.0, max(map(abs, want)))
        assert len(mine) == len(want) and all(abs(u - v) < 1e-9 * scale for u, v in zip(mine, want))


def test_affine_path_in_several_tasks(spark):
    rows = spark.range(5000).select(F.lit("s").alias("site"), F.col("id").cast("int").alias("t"), F.lit(0.9).alias("a"), F.sin("id").alias("b"))
    got = np.array([r.x for r in recursion.affine_path(rows, ["site"], 5000, 16).orderBy("t").collect()])
    want, x = [], 0.0
    for i in range(5000):
        x = 0.9 * x + math.sin(i)
        want.append(x)
    assert np.allclose(got, want, rtol=1e-10)


def test_interpolated(spark):
    rng = np.random.default_rng(4)
    x, ask = np.unique(rng.integers(0, 50, 20)).astype(float), np.concatenate([rng.random(40) * 60 - 5, [0.0, 7.0, 49.0]])
    y = rng.normal(size=len(x))
    points = spark.createDataFrame([("a", float(u), float(v)) for u, v in zip(x, y)] + [("one", 1.0, 4.0), ("a", None, 3.0), ("dup", 1.0, 2.0), ("dup", 1.0, 3.0)], "site string, x double, y double")
    asked = spark.createDataFrame([("a", float(v), i) for i, v in enumerate(ask)] + [("one", 9.0, 0), ("nobody", 1.0, 0), ("a", None, 99), ("dup", 1.0, 0), ("a", float(ask[0]), 0)], "site string, x double, n int")
    rows = quantiles.interpolated(points, asked, ["site"]).collect()
    assert len(rows) == len(ask) + 5
    got = {(r.site, r.n): r.y for r in rows}
    assert np.allclose([got["a", i] for i in range(len(ask))], np.interp(ask, x, y))
    assert got["one", 0] == 4 and got["nobody", 0] is None and got["a", 99] is None and got["dup", 0] == 3


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(-2, 30)), max_size=6), st.integers(1, 40))
def test_days_outside_spans(spark, spans, bucket):
    series = spark.createDataFrame([("s", day(i), float(i)) for i in range(70)] + [("free", day(3), 1.0)], FLOW)
    df = spark.createDataFrame([("s", day(a), day(a + n)) for a, n in spans], "site string, start date, end date")
    got = sorted((r.site, r.ts) for r in drought.outside(series, df, bucket=bucket).collect())
    assert got == sorted([("s", day(i)) for i in range(70) if not any(a <= i <= a + n for a, n in spans)] + [("free", day(3))])


def test_binned_density(monthly):
    exact = {(r.site, round(r.x, 6)): r.density for r in stats.kernel_density(monthly, 25).collect()}
    for bins, error in ((50, 2e-2), (400, 5e-4)):
        got = {(r.site, round(r.x, 6)): r.density for r in stats.binned_density(monthly, 25, bins).collect()}
        assert set(got) == set(exact) and max(abs(got[k] - exact[k]) for k in exact) < error * max(exact.values())


def test_stationary_and_mixture(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5):
        p = rng.random((n, n)) + 0.01
        p /= p.sum(1, keepdims=True)
        w = np.array(spark.createDataFrame([(p.tolist(),)], "p array<array<double>>").select(stats.stationary(F.col("p"))).first()[0])
        assert np.allclose(w @ p, w, atol=1e-12) and abs(w.sum() - 1) < 1e-12
    turns = spark.createDataFrame([([[0.0, 1.0], [1.0, 0.0]],)], "p array<array<double>>").select(stats.stationary(F.col("p"))).first()[0]
    assert np.allclose(turns, [0.5, 0.5])
    states = spark.createDataFrame([("s", day(i), v) for i, v in enumerate([0, 0, 1, 0, 2, 2])], "site string, ts date, state int")
    assert stats.transitions(states, 4).first().p == [[1 / 3, 1 / 3, 1 / 3, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    mixed = stats.mixture_density(spark.createDataFrame([("s", [0.3, 0.7], [0.0, 5.0], [1.0, 2.0])], "site string, weights array<double>, mu array<double>, sd array<double>"), 2001, reach=8.0).orderBy("x").collect()
    x, d = np.array([(r.x, r.density) for r in mixed]).T
    assert abs(np.trapezoid(d, x) - 1) < 1e-6 and abs(np.trapezoid(d * x, x) - 3.5) < 1e-4


def test_rows_in_file_order(spark, tmp_path):
    """Files of many splits: dates follow the lines of the first file, then of the next."""
    at = tmp_path / "wide"
    at.mkdir()
    for k in range(3):
        (at / f"part{k}.csv").write_text("date,s\n" + "".join(f"x,{k * 1000 + i}\n" for i in range(1000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = flows.read_wide_csv(spark, str(at), first_day="2000-01-01")
        assert got.rdd.getNumPartitions() > 10
        assert sorted((r.ts, r.q) for r in got.collect()) == [(day(i), float(i)) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_month_and_year_ends_are_filled(spark):
    rows = [("s", dt.date(2000, 1, 31), 1.0), ("s", dt.date(2000, 4, 2), 2.0), ("s", dt.date(2002, 2, 1), 4.0)]
    df = spark.createDataFrame(rows, FLOW)
    m = {r.ts: r.q for r in cal.resampled(df, "M", fill=True).collect()}
    assert len(m) == 26 and m[dt.date(2000, 1, 31)] == 1 and m[dt.date(2000, 2, 29)] == 0 and m[dt.date(2000, 4, 30)] == 2 and m[dt.date(2002, 2, 28)] == 4
    mean = {r.ts: r.q for r in cal.resampled(df, "M", "mean", fill=True).collect()}
    assert len(mean) == 26 and mean[dt.date(2001, 2, 28)] is None
    assert {r.ts: r.q for r in cal.resampled(df, "A", fill=True).collect()} == {dt.date(2000, 12, 31): 3, dt.date(2001, 12, 31): 0, dt.date(2002, 12, 31): 4}


def test_validation(spark):
    """Against plain counting; periods of one sample go, constant and missing values have a defined result."""
    rng_ = np.random.default_rng(5)
    h = {("A", p): rng_.gamma(2, 3, 12).round(1).tolist() for p in (1, 2)} | {("A", 3): [4.0, 4.0], ("A", 4): [1.0]}
    e = {("A", p): rng_.gamma(2, 4, 30).round(1).tolist() for p in (1, 2)} | {("A", 3): [4.0, 4.0], ("A", 5): [1.0]}
    h["A", 1] += [None, 0.0]
    history = spark.createDataFrame([(s, y, p, v) for (s, p), vs in h.items() for y, v in enumerate(vs)], "site string, year int, period int, q double")
    members = spark.createDataFrame([(y % 3, s, y // 3, p, v) for (s, p), vs in e.items() for y, v in enumerate(vs)], "realization int, site string, year int, period int, q double")
    got = {(r.period, r.space, r["sample"]): r for r in validation.compared(history, members).collect()}
    assert {k[0] for k in got} == {1, 2, 3} and len(got) == 12
    assert got[3, "real", "history"].levene_p is None and got[3, "log", "ensemble"].rank_sum_p == pytest.approx(1)
    for p in (1, 2):
        for space in ("real", "log"):
            a, b = [np.array([v for v in x["A", p] if v is not None]) for x in (h, e)]
            if space == "log":
                a, b = np.log(np.maximum(a, 1e-6)), np.log(np.maximum(b, 1e-6))
            z = sum(np.sign(x - b).sum() for x in a) / 2 / math.sqrt(len(a) * len(b) * (len(a) + len(b) + 1) / 12)
            for sample, x in (("history", a), ("ensemble", b)):
                r = got[p, space, sample]
                q = np.percentile(x, [25, 50, 75])
                near = x[(x >= q[0] - 1.5 * (q[2] - q[0])) & (x <= q[2] + 1.5 * (q[2] - q[0]))]
                assert r.n == len(x) and [r.q1, r.q2, r.q3, r.low, r.high] == pytest.approx([*q, near.min(), near.max()])
                assert r.rank_sum_p == pytest.approx(2 * NormalDist().cdf(-abs(z)), abs=1e-6) and 0 <= r.levene_p <= 1
    assert validation.compared(history.where("false"), members).count() == 0
    boxes = {(r.period, r.space, r.moment): r for r in validation.moment_boxes(members).collect()}
    means = [np.mean(e["A", 2][i : i + 3]) for i in range(0, 30, 3)]
    assert boxes[2, "real", "mean"].q2 == pytest.approx(np.median(means)) and boxes[3, "real", "sd"].q2 == pytest.approx(0)
    with pytest.raises(ValueError):
        validation.period_sums(members, "daily")


def test_state_path(spark):
    """Blocks of any length give the walk that single steps give; a missing step ends its series."""
    rng_ = np.random.default_rng(2)
    maps = {k: [rng_.integers(0, 3, 3).tolist() for _ in range(40)] for k in ("a", "b")}
    rows = [(k, t, m) for k, ms in maps.items() for t, m in enumerate(ms) if (k, t) != ("b", 17)]
    df = spark.createDataFrame(rows, "k string, t int, m array<int>").repartition(3)
    want = set()
    for k, ms in maps.items():
        state = 0
        for t, m in enumerate(ms[: 17 if k == "b" else 40]):
            state = m[state]
            want.add((k, t, state))
    assert {tuple(r) for r in recursion.state_path(df.where("k = 'a'"), ["k"], 40, 3).collect()} == {w for w in want if w[0] == "a"}
    for block in (17, 64):
        got = {tuple(r) for r in recursion.state_path(df, ["k"], 40, block).collect()}
        assert got == want
    assert recursion.state_path(df.where("false"), ["k"], 40, 3).count() == 0
