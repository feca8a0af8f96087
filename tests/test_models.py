"""Fitted models, sample tests and withdrawal rates against numpy and plain folds."""

import datetime as dt
import math

import numpy as np
import pytest

from tidemark.functions import optimize, splines
from tidemark.functions import volatility as vol
from tidemark.operators import indicators, portfolio, records, regimes, samples, volatility, withdrawal
from tidemark.operators import regression as reg
from tidemark.operators import returns as ret
from tidemark.session import ship

DAY0 = dt.date(2001, 1, 1)
day = lambda i: DAY0 + dt.timedelta(days=i)


def solved(X, y):
    c = np.linalg.lstsq(X, y, rcond=None)[0]
    return c, float(((y - X @ c) ** 2).sum())


def lags_of(y, p, start):
    return np.column_stack([np.ones(len(y) - start), *(y[start - k : len(y) - k] for k in range(1, p + 1))]), y[start:]


@pytest.fixture(scope="module")
def walks(spark):
    r = np.random.default_rng(11)
    out = {"noise": r.normal(size=300)}
    for name, coef, n in (("ar1", [0.7], 400), ("ar3", [0.4, 0.0, -0.5], 500), ("short", [0.5], 14), ("five", [0.1, 0.1, 0.1, 0.1, 0.5], 900)):
        y = np.zeros(n)
        for t in range(n):
            y[t] = 0.3 + sum(c * y[t - 1 - k] for k, c in enumerate(coef) if t > k) + r.normal()
        out[name] = y
    out["walk"] = np.cumsum(np.random.default_rng(2).normal(size=400))
    rows = [(k, day(i), float(v)) for k, y in out.items() for i, v in enumerate(y)] + [("flat", day(i), 2.0) for i in range(50)]
    return out, spark.createDataFrame(rows, "ticker string, date date, y double")


def test_autoregressions_against_least_squares(walks):
    series, df = walks
    x = reg.lagged(df)
    orders = {}
    for r in reg.ar_orders(x.where("ticker <> 'flat'")).collect():
        X, y = lags_of(series[r.ticker], r.lags, 5)
        assert r.rss == pytest.approx(solved(X[:, : r.lags + 1], y)[1])
        orders.setdefault(r.ticker, {})[r.lags] = math.log(r.rss / r.n) + 2 * (r.lags + 1) / r.n
    assert "short" not in orders and orders.keys() == set(series) - {"short"}
    best = {t: max(1, min(a, key=a.get)) for t, a in orders.items()}
    fit = reg.ar_fit(x, reg.chosen(reg.ar_orders(x.where("ticker <> 'flat'"))))
    for r in fit.collect():
        assert r.lags == best[r.ticker]
        X, y = lags_of(series[r.ticker], r.lags, r.lags)
        c, rss = solved(X, y)
        assert [r.const, *r.coef] == pytest.approx(c.tolist()) and r.rss == pytest.approx(rss) and r.n == len(y)
        assert r.r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
        mine = {e.date: e for e in reg.ar_residuals(x, fit).where(f"ticker = '{r.ticker}'").collect()}
        want = y - X @ c
        assert [mine[day(i + r.lags)].residual for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)
        assert [mine[day(i + r.lags)].z for i in range(len(y))] == pytest.approx((want / want.std()).tolist(), abs=1e-8)
    assert best["ar1"] >= 1 and best["ar3"] >= 3 and best["five"] == 5


def test_constant_series_has_no_fit(walks):
    _, df = walks
    x = reg.lagged(df.where("ticker = 'flat'"))
    assert all(r.rss is None or abs(r.rss) < 1e-6 for r in reg.ar_orders(x).collect())


def test_clipping_and_odd_values(spark):
    rows = [("a", day(i), v) for i, v in enumerate([1.0, -1.0] * 50 + [1000.0, None, float("nan"), float("inf")])]
    got = {r.date: r.y for r in reg.clipped(spark.createDataFrame(rows, "ticker string, date date, ret double")).collect()}
    v = np.array([1.0, -1.0] * 50 + [1000.0])
    assert len(got) == 101 and got[day(100)] == pytest.approx(v.mean() + 5 * v.std(ddof=1)) and got[day(0)] == 1.0


def test_unit_roots_against_least_squares(walks):
    series, df = walks
    got = {r.ticker: r for r in reg.unit_root(df.where("ticker <> 'flat'")).collect()}
    for t, y in series.items():
        if t not in got:
            continue
        d, level = np.diff(y), y[:-1]

        def design(p, start):
            X, target = lags_of(d, p, start)
            return np.column_stack([X, level[start:]]), target

        aic = {}
        for p in range(6):
            X, target = design(p, 5)
            aic[p] = len(target) * math.log(solved(X, target)[1] / len(target)) + 2 * (p + 2)
        p = min(aic, key=aic.get)
        X, target = design(p, p)
        c, rss = solved(X, target)
        error = math.sqrt(rss / (len(target) - p - 2) * np.linalg.inv(X.T @ X)[-1, -1])
        assert got[t].lags == p and got[t].statistic == pytest.approx(c[-1] / error)
    assert got["walk"].p_value > 0.05 > got["noise"].p_value
    x = reg.stationary(df, reg.unit_root(df.where("ticker <> 'flat'")))
    n = {r.ticker: r["count"] for r in x.groupBy("ticker").count().collect()}
    assert n["walk"] == 399 and n["noise"] == 300


def test_normal_distribution(spark):
    xs = [-40.0, -8.0, -3.0, -2.5, -1.0, 0.0, 0.5, 2.4999, 2.6, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select("x", reg.normal_cdf(df.x).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=1e-9, abs=1e-300)


def test_largest_gap_by_definition(spark):
    r = np.random.default_rng(5)
    data = {"a": r.normal(size=3000), "b": r.normal(size=777) + 0.2, "c": r.integers(0, 5, 400).astype(float), "d": np.zeros(30), "same": np.zeros(9)}
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("a", None), ("a", float("nan")), ("b", float("inf"))]
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "same"), ("a", "none")]
    v = samples.finite(spark.createDataFrame(rows, "s string, x double"), "s", "x")
    got = {(x.a, x.b): x for x in samples.largest_gap(v, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(got) == set(pairs[:-1])
    for (p, q), x in got.items():
        both = np.concatenate([data[p], data[q]])
        gap = max(abs((data[p] <= t).mean() - (data[q] <= t).mean()) for t in both)
        assert x.ks == pytest.approx(gap, abs=1e-12) and (x.n_a, x.n_b) == (len(data[p]), len(data[q]))
        z = gap * math.sqrt(len(data[p]) * len(data[q]) / (len(data[p]) + len(data[q])))
        want = 1.0 if z < 0.2 else min(1, max(0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))
        assert x.p_value == pytest.approx(want)


def test_score_by_definition(spark):
    r = np.random.default_rng(8)
    data = {"a": r.normal(size=500), "b": r.normal(size=600), "few": r.normal(size=10)}
    v = samples.finite(spark.createDataFrame([(k, float(x)) for k, d in data.items() for x in d], "s string, x double"), "s", "x")
    pairs = spark.createDataFrame([("a", "b"), ("few", "b")], "a string, b string")
    bias = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, bias double")

    def moments(x):
        z = (x - x.mean()) / x.std()
        return [x.mean(), x.var(ddof=1), (z**3).mean(), (z**4).mean() - 3]

    for x in samples.compared(v, pairs, bias).collect():
        a, b = moments(data[x.a]), moments(data[x.b])
        gaps = [abs((p - q) / q) if abs(q) > 1e-10 else abs(p) for p, q in zip(a, b, strict=True)]
        assert [x.mean_gap, x.variance_gap, x.skewness_gap, x.kurtosis_gap] == pytest.approx(gaps)
        n = len(data[x.a])
        jb = n / 6 * (a[2] ** 2 + a[3] ** 2 / 4) if n >= 20 else None
        tests = [(x.ks_p > 0.05, x.ks_p), *((g <= 0.05, max(0, 1 - g)) for g in gaps), (jb is not None and math.exp(-jb / 2) > 0.05, math.exp(-jb / 2) if jb is not None else 0)]
        score = 0.7 * np.mean([1.0 if ok else min(1, p / 0.05) for ok, p in tests]) + 0.3 * (0.9 if x.a == "a" else 0.5)
        assert x.score == pytest.approx(score) and x.passed == (score >= 0.7) and x.passed_tests == sum(ok for ok, _ in tests)


def bisected(values, perpetual, precision, keep):
    low, high = 0.0, 50.0
    while high - low > precision:
        mid = (low + high) / 2
        left = 1.0
        for a, z in zip(values, values[1:], strict=False):
            left -= mid / 100
            if left <= 0:
                left = 0.0
                break
            left *= z / a
        ok = left >= keep if perpetual else left > 0
        low, high = (mid, high) if ok else (low, mid)
    return low


@pytest.mark.parametrize(("precision", "keep"), [(0.01, 1.0), (0.1, 0.9)])
def test_withdrawal_rates_equal_bisection(spark, precision, keep):
    r = np.random.default_rng(3)
    paths = {"calm": 100 * np.exp(np.cumsum(r.normal(0.001, 0.01, 200))), "wild": 50 * np.exp(np.cumsum(r.normal(0, 0.2, 150))), "up": 2.0 ** np.arange(60), "down": 0.5 ** np.arange(60), "short": np.ones(20)}
    df = spark.createDataFrame([(k, day(i), float(x)) for k, v in paths.items() for i, x in enumerate(v)], "ticker string, date date, close double")
    got = {(x.ticker, x.date): x for x in withdrawal.rates(df, 4, 6, precision, keep).collect()}
    assert len(got) == sum(max(0, len(v) - 24) for v in paths.values())
    for k, v in paths.items():
        for i in range(len(v) - 24):
            values, x = v[i : i + 25 : 6], got[k, day(i)]
            assert x.safe == pytest.approx(bisected(values, False, precision, keep)) and x.perpetual == pytest.approx(bisected(values, True, precision, keep)), (k, i)
    p = {x.ticker: x for x in withdrawal.rate_percentiles(withdrawal.rates(df, 4, 6, precision, keep)).collect()}
    safe = [x.safe for (k, _), x in got.items() if k == "wild"]
    assert [p["wild"][f"safe_{q}"] for q in withdrawal.PERCENTILES] == pytest.approx(np.percentile(safe, withdrawal.PERCENTILES).tolist())


def test_balances_with_flows_equal_a_fold(spark):
    r = np.random.default_rng(9)
    close = {"a": 10 * np.exp(np.cumsum(r.normal(0, 0.05, 5000))), "b": np.array([5.0]), "c": np.array([4.0, 2.0, 8.0])}
    flows = [("a", day(int(i)), float(x)) for i, x in zip(r.integers(0, 5000, 900), r.normal(0, 3000, 900), strict=True)] + [("c", day(0), 100.0), ("c", day(0), 50.0), ("z", day(1), 9.0)]
    df = spark.createDataFrame([(k, day(i), float(x)) for k, v in close.items() for i, x in enumerate(v)], "ticker string, date date, close double")
    out = withdrawal.balances(df, spark.createDataFrame(flows, "ticker string, date date, amount double"), 1000.0)
    got = {(x.ticker, x.date): x.value for x in out.collect()}
    worst = {x.ticker: x for x in withdrawal.worst_drawdown(out).collect()}
    for k, v in close.items():
        value, peak, low = 1000.0, -math.inf, 0.0
        for i, x in enumerate(v):
            if i:
                paid = sum(f for t, d, f in flows if t == k and d == day(i - 1)) if k != "a" else by_day.get(i - 1, 0.0)
                value = (value + paid) * x / v[i - 1]
            else:
                by_day = {}
                for t, d, f in flows:
                    if t == k:
                        by_day[(d - DAY0).days] = by_day.get((d - DAY0).days, 0.0) + f
            assert got[k, day(i)] == pytest.approx(value, rel=1e-7, abs=1e-4)
            peak = max(peak, value)
            low = max(low, (peak - value) / peak * 100)
        assert worst[k].drawdown == pytest.approx(low, rel=1e-6)


def simulated(n, mean, omega, alpha, beta, seed):
    r = np.random.default_rng(seed)
    v, y = omega / (1 - alpha - beta), []
    for z in r.normal(size=n):
        y.append(mean + math.sqrt(v) * z)
        v = omega + alpha * (y[-1] - mean) ** 2 + beta * v
    return np.array(y)


def likelihood_of(y, mean, omega, alpha, beta):
    e = (y - mean) ** 2
    w = 0.94 ** np.arange(min(75, len(y)))
    v, total = omega + (alpha + beta) * (e[: len(w)] @ w / w.sum()), 0.0
    for t, x in enumerate(e):
        if t:
            v = omega + alpha * e[t - 1] + beta * v
        total -= 0.5 * (math.log(2 * math.pi) + math.log(v) + x / v)
    return total, v


def test_garch_fits_are_the_likeliest(spark):
    ship(spark)
    series = {"clear": simulated(3000, 0.05, 0.1, 0.12, 0.8, 1), "small": 1e-3 * simulated(800, 0.0, 0.2, 0.3, 0.4, 2), "noise": np.random.default_rng(3).normal(size=400), "flat": np.ones(80), "few": np.ones(20)}
    df = spark.createDataFrame([(k, day(i), float(x)) for k, y in series.items() for i, x in enumerate(y)], "ticker string, date date, ret double")
    got = {r.ticker: r for r in volatility.fits(df).collect()}
    assert set(got) == {"clear", "small", "noise", "flat"} and got["flat"].method == "ewma" and got["flat"].alpha is None
    for k in ("clear", "small", "noise"):
        r, y = got[k], series[k]
        assert r.method == "garch"
        like, last = likelihood_of(y, r.mean, r.omega, r.alpha, r.beta)
        assert r.log_likelihood == pytest.approx(like, abs=1e-5) and r.last_volatility == pytest.approx(math.sqrt(last))
        m, s = y.mean(), y.var()
        grid = np.array([(m + dm * math.sqrt(s), s * level * (1 - a - b), a, b) for a in np.linspace(0, 0.4, 9) for b in np.linspace(0, 0.98, 15) if a + b < 0.999 for level in (0.7, 1.0, 1.4) for dm in (-0.03, 0, 0.03)])
        assert r.log_likelihood >= vol.log_likelihood(y, grid).max() - 1e-6
        near = np.array([[r.mean, r.omega, r.alpha, r.beta]]) * (1 + 1e-3 * np.random.default_rng(0).normal(size=(200, 4)))
        assert r.log_likelihood >= vol.log_likelihood(y, near).max() - 1e-6
    assert got["clear"].alpha == pytest.approx(0.12, abs=0.05) and got["clear"].beta == pytest.approx(0.8, abs=0.08)
    assert got["clear"].arch_p < got["noise"].arch_p and got["clear"].left_arch_p > got["clear"].arch_p
    params = volatility.fits(df).where("method = 'garch'").select("ticker", "mean", "omega", "alpha", "beta")
    for x in volatility.likelihood(df, params).collect():
        assert x.log_likelihood == pytest.approx(got[x.ticker].log_likelihood, rel=1e-9) and math.sqrt(x.last_variance) == pytest.approx(got[x.ticker].last_volatility)
    f = {(x.ticker, x.day): x.volatility for x in volatility.forecast(volatility.fits(df), 400).collect()}
    r = got["clear"]
    e = (series["clear"][-1] - r.mean) ** 2
    v = r.omega + r.alpha * e + r.beta * r.last_volatility**2
    for k in range(1, 401):
        assert f["clear", k] == pytest.approx(math.sqrt(v))
        v = r.omega + (r.alpha + r.beta) * v
    assert f["flat", 400] == got["flat"].last_volatility


def test_tests_of_residuals():
    r = np.random.default_rng(6)
    p = [vol.serial_p(r.normal(size=300)) for _ in range(300)]
    assert 0.4 < np.mean(p) < 0.6 and 0.02 < np.mean(np.array(p) < 0.05) < 0.1
    assert vol.serial_p(np.ones(10)) is None and vol.arch_p(np.ones(10)) is None
    for df in (1, 2, 5, 10):
        for x in (0.1, 1.0, 7.0, 30.0):
            grid = np.linspace(0, x, 400_001)[1:] - x / 800_000
            density = grid ** (df / 2 - 1) * np.exp(-grid / 2) / (2 ** (df / 2) * math.gamma(df / 2))
            want = math.erfc(math.sqrt(x / 2)) if df == 1 else 1 - density.sum() * x / 400_000
            assert vol.upper_gamma(df / 2, x / 2) == pytest.approx(want, abs=1e-6)
    x = r.normal(size=200)
    w = 0.94 ** np.arange(200)[::-1]
    m = w @ x / w.sum()
    assert vol.ewma_variances(x)[-1] == pytest.approx(w @ (x - m) ** 2 / w.sum() * w.sum() ** 2 / (w.sum() ** 2 - (w * w).sum()))


def test_repaired_matrices(spark):
    ship(spark)
    bad = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    names = "abc"
    rows = [(book, p, q, float(m[i, j]), 0.1 * i) for book, m in (("bad", bad), ("good", np.eye(3)), ("zero", np.zeros((3, 3)))) for i, p in enumerate(names) for j, q in enumerate(names)]
    df = spark.createDataFrame(rows, "portfolio string, a string, b string, cov double, mean double")
    for method in ("eigenvalue", "ridge", "shrinkage"):
        got = {}
        for x in portfolio.repaired_moments(df, method, 0.3).collect():
            got.setdefault(x.portfolio, {})[x.a, x.b] = x
        assert {x.repair for x in got["good"].values()} == {"none"} and all(x.cov == float(x.a == x.b) for x in got["good"].values())
        m = np.array([[got["bad"][p, q].cov for q in names] for p in names])
        x = got["bad"]["a", "a"]
        assert np.linalg.eigvalsh(m)[0] > 0 and x.least_before == pytest.approx(-0.8) and x.least_after == pytest.approx(np.linalg.eigvalsh(m)[0])
        values, vectors = np.linalg.eigh(bad)
        want = {"eigenvalue": vectors @ np.diag(np.maximum(values, 1e-8)) @ vectors.T, "ridge": np.eye(3), "shrinkage": np.eye(3)}[method]  # too weak: the diagonal
        assert m == pytest.approx(want) and x.repair == ("eigenvalue" if method == "eigenvalue" else "diagonal")
    assert optimize.repaired(bad, "ridge", 1.0)[1] == "ridge" and optimize.repaired(bad, "ridge", 1.0)[0] == pytest.approx(bad + np.eye(3))
    w = portfolio.optimized(portfolio.repaired_moments(df), "min_variance").where("portfolio = 'bad'").collect()
    assert sum(x.w for x in w) == pytest.approx(1)


def test_extremes_are_left_out_or_held(spark):
    few = [0.0, 1.0] * 20 + [50.0]
    df = spark.createDataFrame([("few", day(i), x) for i, x in enumerate(few)] + [("one", day(0), 3.0)], "ticker string, date date, ret double")
    assert {x.ticker: x["count"] for x in ret.without_extremes(df, 5.0).groupBy("ticker").count().collect()} == {"few": 40, "one": 1}
    half = ret.without_extremes(df.where("ticker = 'few'"), 0.01)  # nearly all are beyond: held, not removed
    m, s = np.mean(few), np.std(few)
    assert [x.ret for x in half.orderBy("date").collect()] == pytest.approx(np.clip(few, m - 0.01 * s, m + 0.01 * s).tolist())
    got = [x.ret for x in ret.winsorized(df.where("ticker = 'few'"), 0.1).orderBy("date").collect()]
    assert got == pytest.approx(np.clip(few, *np.percentile(few, [10, 90])).tolist())


def em(x, rounds):
    """Mixtures of three normals from the terciles on; the likelihood before each step."""
    lo, hi = np.percentile(x, [33, 67])
    of = np.where(x < lo, 0, np.where(x < hi, 1, 2))
    floor = x.var() * 1e-6
    m, v, w = (np.array([f(x[of == k]) for k in range(3)]) for f in (np.mean, np.var, lambda y: len(y) / len(x)))
    v, like = np.maximum(v, floor), []
    for _ in range(rounds):
        d = w / np.sqrt(2 * np.pi * v) * np.exp(-((x[:, None] - m) ** 2) / (2 * v))
        like.append(np.log(d.sum(1)).sum())
        r = d / d.sum(1, keepdims=True)
        n = r.sum(0)
        m = (r * x[:, None]).sum(0) / n
        v, w = np.maximum((r * x[:, None] ** 2).sum(0) / n - m * m, floor), n / len(x)
    return m, v, w, like


def test_mixtures_by_brute_force(spark):
    r = np.random.default_rng(21)
    data = {"three": np.concatenate([r.normal(-0.3, 0.05, 60), r.normal(0.0, 0.02, 100), r.normal(0.2, 0.1, 80)]), "one": r.normal(0, 0.1, 90), "tied": np.repeat([0.1, 0.2, 0.3], 10)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in data.items() for i, x in enumerate(v)], "ticker string, block long, x double")
    got = {x.ticker: x for x in regimes.mixture(df, 6).collect()}
    for k, x in data.items():
        m, v, w, like = em(x, 6)
        order = np.argsort(m)
        assert [p.mean for p in got[k].parts] == pytest.approx(m[order].tolist()) and [p.variance for p in got[k].parts] == pytest.approx(v[order].tolist(), rel=1e-5, abs=1e-9) and [p.weight for p in got[k].parts] == pytest.approx(w[order].tolist())
        assert got[k].log_likelihood == pytest.approx(like[-1]) and all(a <= b + 1e-9 for a, b in zip(like, like[1:], strict=False))
    marks = {(x.ticker, x.block): x.regime for x in regimes.regimes(df, regimes.mixture(df, 6)).collect()}
    assert np.mean([marks["three", i] == (0 if i < 60 else 1 if i < 160 else 2) for i in range(240)]) > 0.85


def test_blocks_are_whole(spark):
    rets = [("a", day(i), 0.01) for i in range(24 * 5 + 3)] + [("short", day(i), 0.01) for i in range(50)]
    x = regimes.block_returns(spark.createDataFrame(rets, "ticker string, date date, ret double"), 5).collect()
    assert {b.ticker for b in x} == {"a"} and len(x) == 24 and x[0].x == pytest.approx(1.01**5 - 1)


def spline_by_definition(x, y, at):
    """All coefficients of the pieces from one dense system: values, and derivatives that do not jump (the third one neither, at
    the second and last but one point)."""
    n = len(x) - 1
    A, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    for i in range(n):
        for px, py in ((x[i], y[i]), (x[i + 1], y[i + 1])):
            A[row, 4 * i : 4 * i + 4] = [(px - x[i]) ** k for k in range(4)]
            b[row] = py
            row += 1
    for i in range(n - 1):
        h = x[i + 1] - x[i]
        for c, nxt in (([0, 1, 2 * h, 3 * h * h], [0, 1, 0, 0]), ([0, 0, 2, 6 * h], [0, 0, 2, 0])):
            A[row, 4 * i : 4 * i + 4] = c
            A[row, 4 * i + 4 : 4 * i + 8] = [-v for v in nxt]
            row += 1
    for i in (0, n - 2):
        A[row, 4 * i + 3], A[row, 4 * i + 7] = 1, -1
        row += 1
    c = np.linalg.solve(A, b).reshape(n, 4)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    return np.array([sum(c[j, e] * (t - x[j]) ** e for e in range(4)) for j, t in zip(k, at, strict=True)])


def test_cubic_fill(spark):
    r = np.random.default_rng(4)
    for n in (4, 5, 9, 30):
        x = np.sort(r.choice(60, n, replace=False))
        y, at = r.normal(size=n), np.arange(x[0], x[-1] + 1)
        assert splines.cubic(x, y, at) == pytest.approx(spline_by_definition(x, y, at), abs=1e-6)
    values = {"a": [None, 1.0, None, 4.0, 2.0, None, None, None, None, None, None, None, None, None, None, None, None, 3.0, 5.0, None], "few": [1.0, None, 3.0], "none": [None, None], "full": [1.0, 2.0]}
    df = spark.createDataFrame([(k, day(i), v) for k, vs in values.items() for i, v in enumerate(vs)], "ticker string, date date, close double")
    got = {(x.ticker, x.date): x.cubic for x in indicators.fill_cubic(df, "close").collect()}
    known = [i for i, v in enumerate(values["a"]) if v is not None]
    want = spline_by_definition(np.array(known), np.array([values["a"][i] for i in known]), np.arange(1, 19))
    for i in range(20):
        if i in (0, 19) or 9 < i < 12:  # outside what is known, and too far from it
            assert got["a", day(i)] is None, i
        else:
            assert got["a", day(i)] == pytest.approx(want[i - 1]), i
    assert got["few", day(1)] == 2.0 and got["none", day(0)] is None and got["full", day(1)] == 2.0


def test_optimality_tells_good_weights_from_others(spark):
    ship(spark)
    r = np.random.default_rng(2)
    a = r.normal(size=(60, 4)) * [0.1, 0.2, 0.3, 0.15] + r.normal(size=(60, 1)) * 0.1
    cov, mean = np.cov(a.T), np.array([0.05, 0.2, 0.1, 0.15])
    mom = spark.createDataFrame([("p", str(i), str(j), float(cov[i, j]), float(mean[i])) for i in range(4) for j in range(4)], "portfolio string, a string, b string, cov double, mean double")
    equal = spark.createDataFrame([("p", str(i), 0.25) for i in range(4)], "portfolio string, ticker string, w double")
    for kind, rf in (("min_variance", None), ("max_sharpe", 0.02)):
        assert portfolio.optimality(mom, portfolio.optimized(mom, kind), rf).first().excess < 1e-3
        assert portfolio.optimality(mom, equal, rf).first().excess > 0.05


def test_history_spans(spark):
    old = [("old", dt.date(1990, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(0, 365 * 12)]
    new = [("new", dt.date(2001, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(0, 360)]
    px = spark.createDataFrame(old + new, "ticker string, date date, close double")
    members = spark.createDataFrame([("a", "old"), ("b", "old"), ("b", "new"), ("c", "none")], "portfolio string, ticker string")
    spans = records.history_span(px, members, "2001-12-26", 3, 5, 10)
    got = {x.portfolio: (x.years, x.tickers, x.sufficient, x.with_rows, x.late) for x in spans.collect()}
    assert got == {"a": (5, 1, 1, 1, 0), "b": (10, 2, 1, 2, 1), "c": (10, 1, 0, 0, 0)}
    rows = records.history_rows(px, members, spans, "2001-12-26")
    assert {(x.portfolio, x.ticker): x["count"] for x in rows.groupBy("portfolio", "ticker").count().collect()} == {("a", "old"): 5 * 365 + 1, ("b", "old"): 10 * 365 + 1, ("b", "new"): 360}
