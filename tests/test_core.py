"""Operators against plain folds in Python, on cases that the tables do not hold."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import income, indicators, integrate, portfolio, records, risk
from tidemark.operators.quantiles import quantile

DAY0 = dt.date(2000, 1, 3)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def series(n, seed=1, ticker="A"):
    r = random.Random(seed)
    return [(ticker, day(i), round(50 + 40 * r.random(), 3)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 20])
def test_ema_equals_the_recursion(spark, n):
    rows = series(1200)
    want, e = {}, None
    for i, (_, d, x) in enumerate(rows):
        if i == n - 1:
            e = sum(v for *_, v in rows[:n]) / n
        elif i >= n:
            e = x * 2 / (n + 1) + e * (1 - 2 / (n + 1))
        if e is not None:
            want[d] = e
    got = {r.date: r.ema for r in indicators.ema(spark.createDataFrame(rows, "ticker string, date date, close double"), n).collect()}
    assert got.keys() == want.keys()
    assert all(got[d] == pytest.approx(want[d], rel=1e-12) for d in want)


def test_asof_is_linear_in_a_long_series(spark):
    bars = spark.range(100_000).select(F.lit("A").alias("ticker"), F.expr("date_add(date'1750-01-01', cast(id as int))").alias("date"), F.col("id").cast("double").alias("close"))
    events = spark.createDataFrame([("A", dt.date(1750, 1, 1)), ("A", dt.date(2023, 10, 15)), ("A", dt.date(2600, 1, 1)), ("B", DAY0)], "ticker string, ex_date date")
    start = time.time()
    got = {(r.ticker, r.ex_date): r.px for r in income.asof(events, bars, "nearest").collect()}
    assert got[("A", dt.date(1750, 1, 1))] == 0 and got[("A", dt.date(2600, 1, 1))] == 99_999 and got[("B", DAY0)] is None
    filled = indicators.fill_gaps(bars.withColumn("close", F.when(F.col("close") % 7 != 3, F.col("close"))), "close")
    assert filled.where("linear is null or abs(linear - datediff(date, date'1750-01-01')) > 1e-9").count() == 0
    assert time.time() - start < 60


def test_reinvested_dividends_off_the_bars(spark):
    prices = spark.createDataFrame([("A", day(0), 10.0), ("A", day(10), 20.0), ("A", day(20), 40.0)], "ticker string, date date, close double")
    div = spark.createDataFrame([("A", day(4), 1.0), ("A", day(15), 2.0)], "ticker string, ex_date date, amount double")
    got = income.total_return(prices, div, reinvest=True).first()
    assert got.total_return == pytest.approx((1 + 1 / 10) * (1 + 2 / 40) * 4 - 1)  # day 15 is as near to both: the later bar


def fold(prices, weights, marks, start):
    """A backtest day by day: {(book, day): value}."""
    days = sorted({d for _, d, _ in prices if d >= start})
    out, cash, held = {}, dict.fromkeys({b for b, *_ in weights}, 1000.0), {}
    last = {}
    by_day = {}
    for t, d, x in prices:
        by_day.setdefault(d, []).append((t, x))
    firsts = {b: min(d for t, d, _ in prices for bb, tt, _ in weights if bb == b and tt == t) for b, *_ in weights}
    for d in sorted({d for _, d, _ in prices}):
        last.update(by_day[d])
        if d < start:
            continue
        for b in cash:
            value = cash[b] + sum(n * last[t] for (bb, t), n in held.items() if bb == b)
            if d in marks:
                held = {k: n for k, n in held.items() if k[0] != b}
                for bb, t, w in weights:
                    if bb == b and t in last:
                        held[b, t] = w * value / last[t]
                cash[b] = value - sum(n * last[t] for (bb, t), n in held.items() if bb == b)
            if firsts[b] <= max(m for m in marks if m <= d):
                out[b, d] = value
    assert days
    return out


def test_backtest_equals_a_daily_fold(spark):
    r = random.Random(4)
    prices = [(t, day(i), round(10 + 90 * r.random(), 2)) for t, begin in (("A", 0), ("B", 3), ("C", 45)) for i in range(begin, 120) if r.random() < 0.4]
    weights = [("x", "A", 0.5), ("x", "B", 0.3), ("y", "B", 0.6), ("y", "C", 0.4), ("z", "C", 1.0)]
    days = sorted({d for _, d, _ in prices if d >= day(10)})
    marks = {days[0], days[20], days[21], days[60]}
    want = fold(prices, weights, marks, day(10))
    got = portfolio.backtest(spark.createDataFrame(prices, "ticker string, date date, close double"), spark.createDataFrame(weights, "portfolio string, ticker string, w double"), spark.createDataFrame([(m,) for m in marks], "date date"), 1000.0, start=str(day(10)))
    got = {(x.portfolio, x.date): x.value for x in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_positions_keep_unfilled_sales(spark):
    t = [("p", "A", 1, 1, 10.0, 5.0), ("p", "A", 1, 2, -4.0, 8.0), ("p", "A", 2, 1, -10.0, 9.0), ("p", "A", 3, 1, 2.0, 7.0)]
    got = portfolio.positions(spark.createDataFrame(t, "portfolio string, ticker string, at int, line int, shares double, price double")).first()
    assert (got.shares, got.avg_cost, got.realised, got.unfilled) == (2.0, 7.0, 4 * 3.0 + 6 * 4.0, 4.0)


def test_quantiles_are_exact(spark):
    r = random.Random(2)
    rows = [(g, r.choice([r.random() * 1e6, 5.0, -3.0, None])) for g in ("a", "b", None) for _ in range(999)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {x.g: x.q for x in quantile(df, "g", "v", q, "q").collect()}
        want = {x.g: x.q for x in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(q)).alias("q")).collect()}
        assert got == pytest.approx(want)
    assert quantile(df.limit(0), "g", "v", 0.5, "q").count() == 0


def test_runs_and_averages_across_days(spark):
    r = random.Random(6)
    rows = [("k", dt.datetime(2020, 1, 1) + dt.timedelta(hours=5 * i), i, r.random() * 100, r.random() < 0.7) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long, v double, bad boolean")
    best = run = 0
    ema = None
    for *_, v, bad in rows:
        run = run + 1 if bad else 0
        best = max(best, run)
        ema = v if ema is None else 0.1 * v + 0.9 * ema
    assert integrate.longest_runs(df, "k", F.col("bad"), ["ts", "i"]).first().longest == best
    assert integrate.smoothed(df, "k", "v", ["ts", "i"]).first().ema == pytest.approx(ema)


def test_tails_rates_and_histories(spark):
    rets = spark.createDataFrame([(t, day(2 * i), float(i)) for t, n in (("A", 5), ("B", 3)) for i in range(n)], "ticker string, date date, ret double")
    got = {(x.ticker, x.place): x.ret for x in risk.aligned_tails(rets, "position").collect()}
    assert got == {("A", 0): 2.0, ("A", 1): 3.0, ("A", 2): 4.0, ("B", 0): 0.0, ("B", 1): 1.0, ("B", 2): 2.0}
    assert risk.aligned_tails(rets).count() == 6 and risk.return_matrix(rets, 4).count() == 5
    seen = spark.createDataFrame([("s", day(i), None if i > 3 else i / 100) for i in range(16)] + [("t", day(1), 0.04), ("t", day(2), None)], "series string, date date, rate double")
    asked = spark.createDataFrame([("s",), ("t",), ("u",)], "series string")
    assert {x.series: x.rate for x in records.latest_rate(seen, asked).collect()} == {"s": 0.02, "t": 0.04, "u": 0.02}
    runs = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 4.0)], "run int, paths_per_second double, memory_mb double")
    h = records.append_run(runs.where("run = 1"), runs)
    assert h.count() == 2 and [x.throughput_change for x in records.regressions(h).orderBy("run").collect()] == [None, 100.0]


def moments_of(cov, mean):
    names = [f"t{i}" for i in range(len(mean))]
    return [("p", a, b, float(cov[i, j]), float(mean[i])) for i, a in enumerate(names) for j, b in enumerate(names)]


def simplex(n, steps):
    """All weights in multiples of 1 / steps that sum to 1."""
    if n == 1:
        yield (steps,)
        return
    for k in range(steps + 1):
        for rest in simplex(n - 1, steps - k):
            yield (k, *rest)


@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(3)
    a = r.normal(size=(40, 4)) * [0.1, 0.2, 0.15, 0.3] + r.normal(size=(40, 1)) * 0.1
    cov, mean = np.cov(a.T), np.array([0.05, 0.12, 0.07, 0.2])
    grid = np.array(list(simplex(4, 40))) / 40
    return cov, mean, grid, spark.createDataFrame(moments_of(cov, mean), "portfolio string, a string, b string, cov double, mean double")


def test_optimised_weights_against_a_grid(market):
    cov, mean, grid, mom = market
    var = np.einsum("ij,jk,ik->i", grid, cov, grid)
    sharpe = (grid @ mean - 0.02) / np.sqrt(var)
    by = lambda kind: np.array([x.w for x in portfolio.optimized(mom, kind).orderBy("ticker").collect()])
    w = by("min_variance")
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w @ cov @ w <= var.min() + 1e-9
    w = by("max_sharpe")
    assert w.sum() == pytest.approx(1) and (w @ mean - 0.02) / np.sqrt(w @ cov @ w) >= sharpe.max() - 1e-6
    w = by("risk_parity")
    assert w * (cov @ w) / (w @ cov @ w) == pytest.approx(np.full(4, 0.25))
    for x in portfolio.frontier(mom, 6).collect():
        enough = grid @ mean >= x.target
        assert x.ret >= x.target - 1e-4 and x.sigma**2 <= var[enough].min() + 1e-5


def test_linkage_by_definition(market):
    cov, _, _, mom = market
    dev = np.sqrt(np.diag(cov))
    d = 1 - cov / np.outer(dev, dev)
    groups, number, want = {i: (i,) for i in range(4)}, 4, []
    while len(groups) > 1:
        h, a, b = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        want.append((a, b, h))
        groups[number] = groups.pop(a) + groups.pop(b)
        number += 1
    got = [(x.a, x.b, x.height) for x in portfolio.linkage(mom).orderBy("step").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_partitions_written_are_replaced_alone(spark, tmp_path):
    from tidemark.sources import tables

    rows = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, n int")
    tables.write_partitioned(rows, f"{tmp_path}/t")
    tables.write_partitioned(rows.where("ticker = 'A'").withColumn("n", F.lit(9)), f"{tmp_path}/t")
    assert {x.ticker: x.n for x in spark.read.parquet(f"{tmp_path}/t").collect()} == {"A": 9, "B": 2}


def test_rebalancing_covers_targets_that_are_not_held(spark):
    held = portfolio.marked(spark.createDataFrame([("p", "A", 10.0, 5.0, 100.0), ("p", "B", 4.0, 50.0, 100.0), ("p", "X", 2.0, 30.0, 100.0)], "portfolio string, ticker string, shares double, avg_cost double, cash double"), spark.createDataFrame([("A", 20.0), ("B", 50.0), ("C", 8.0)], "ticker string, close double"))
    targets = spark.createDataFrame([("p", "A", 0.1), ("p", "C", 0.5), ("p", "B", 0.3575), ("p", "X", 0.2)], "portfolio string, ticker string, w double")
    prices = spark.createDataFrame([("A", 20.0), ("B", 50.0), ("C", 8.0)], "ticker string, close double")
    got = {x.ticker: x.shares for x in portfolio.rebalancing_trades(held, targets, prices).collect()}
    total = 200 + 200 + 60 + 100  # X has no price: at cost, and not traded
    assert got == pytest.approx({"A": (0.1 * total - 200) / 20, "C": 0.5 * total / 8, "B": 0.0 if abs(0.3575 * total - 200) <= 1 else (0.3575 * total - 200) / 50})
    away = spark.createDataFrame([("p", "A", -1.0)], "portfolio string, ticker string, w double")
    assert portfolio.rebalancing_trades(held, away, prices).first().shares == -10.0


def test_backtest_trades_and_report_equal_a_fold(spark):
    r = random.Random(14)
    prices = [(t, day(i), round(10 + 20 * r.random(), 2)) for t, begin in (("A", 0), ("B", 0), ("C", 45)) for i in range(begin, 130) if i in (0, 45) or r.random() < 0.5]
    weights = [("x", "A", 0.5), ("x", "B", 0.3), ("x", "C", 0.1)]
    days = sorted({d for _, d, _ in prices})
    marks = [days[0], days[30], days[31], days[80]]
    df = spark.createDataFrame(prices, "ticker string, date date, close double")
    w, m = spark.createDataFrame(weights, "portfolio string, ticker string, w double"), spark.createDataFrame([(x,) for x in marks], "date date")
    values = portfolio.backtest(df, w, m, 1000.0)
    last, held, cash, want, curve = {}, {}, 1000.0, {}, {}
    for d in days:
        last.update({t: x for t, dd, x in prices if dd == d})
        value = curve[d] = cash + sum(n * last[t] for t, n in held.items())
        if d in marks:
            for _, t, share in weights:
                if t in last:
                    amount = share * value - held.get(t, 0.0) * last[t]
                    if abs(amount) > 1:
                        want[d, t] = amount
                    held[t] = share * value / last[t]
            cash = value - sum(n * last[t] for t, n in held.items())
    trades = portfolio.backtest_trades(df, w, m, values)
    assert {(x.date, x.ticker): x.amount for x in trades.collect()} == pytest.approx(want)
    out = portfolio.backtest_report(values, 1000.0, trades, df.where("ticker = 'A'")).first()
    v = np.array([curve[d] for d in days])
    rets = v[1:] / v[:-1] - 1
    a = [x for t, _, x in sorted(prices) if t == "A"]
    annual = ((v[-1] / 1000) ** (252 / len(v)) - 1) * 100
    vola, fall = rets.std(ddof=1) * 252**0.5 * 100, (v / np.maximum.accumulate(v) - 1).min() * 100
    assert out.total_trades == len(want) and out.final_value == pytest.approx(v[-1]) and out.max_drawdown == pytest.approx(fall)
    assert [out.annualized_return, out.volatility, out.sharpe_ratio, out.calmar_ratio] == pytest.approx([annual, vola, (annual - 2) / vola, annual / -fall])
    assert out.excess_return == pytest.approx((v[-1] / 1000 - a[-1] / a[0]) * 100)


def test_kept_bars_follow_the_files(spark, sf, tmp_path):
    from tidemark.sources import bars

    for name in ("lineitem", "part"):
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    first = bars.bars(spark, str(tmp_path))
    n = first.agg(F.sum("volume")).first()[0]
    assert bars.bars(spark, str(tmp_path)) is first
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(100).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    again = bars.bars(spark, str(tmp_path))
    assert again is not first and again.agg(F.sum("volume")).first()[0] > n and not first.is_cached


def test_optimizers_as_strategies(spark):
    from tidemark.functions import optimize
    from tidemark.session import ship

    ship(spark)
    r = random.Random(31)
    prices = [(t, day(i), 10 + 5 * r.random()) for t, begin in (("A", 0), ("B", 0), ("C", 70)) for i in range(begin, 160)]
    members = [("x", "A"), ("x", "B"), ("y", "B"), ("y", "C")]
    marks = [day(50), day(120)]
    got = portfolio.optimizer_weights(spark.createDataFrame(prices, "ticker string, date date, close double"), spark.createDataFrame(members, "portfolio string, ticker string"), spark.createDataFrame([(m,) for m in marks], "date date"), ("min_variance", "risk_parity"), 30)
    got = {(x.strategy, x.portfolio, x.segment, x.ticker): x.w for x in got.collect()}
    assert len(got) == 2 * 2 * 4
    by = {}
    for t, d, x in sorted(prices):
        by.setdefault(t, []).append((d, x))
    for book in ("x", "y"):
        own = [t for p, t in members if p == book]
        for m in marks:
            rets = {t: [(d, max(-0.5, min(2.0, z / a - 1))) for (_, a), (d, z) in zip(by[t], by[t][1:], strict=False) if d <= m][-30:] for t in own}
            if any(len(v) < 30 for v in rets.values()):
                want = {k: [0.5, 0.5] for k in ("min_variance", "risk_parity")}
                assert (book, m) == ("y", day(50))
            else:
                cov = np.cov(np.array([[v for _, v in rets[t]] for t in own])) * 252
                want = {"min_variance": optimize.least_variance(cov), "risk_parity": optimize.equal_risk(cov)}
            for kind, w in want.items():
                assert [got[kind, book, m, t] for t in own] == pytest.approx(list(w), abs=1e-6)
