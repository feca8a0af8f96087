"""Queries on prices and returns: projections, statistics, windows. Every result is rounded where floats are summed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import stats
from tidemark.operators import indicators as ind
from tidemark.operators import returns as ret
from tidemark.sources import bars as b

Spark = SparkSession


def rnd(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns(stats.rounded(*names, digits=digits))


PERF = """
WITH g AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS growth FROM returns),
d AS (SELECT *, growth / greatest(1.0, max(growth) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM g),
a AS (SELECT ticker, count(*) AS n, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS ann_return, stddev_samp(ret) * sqrt(252) AS ann_vol,
  avg(ret - 0.02 / 252) / stddev_samp(ret) * sqrt(252) AS sharpe,
  avg(ret - 0.02 / 252) / sqrt(avg(pow(least(ret - 0.02 / 252, 0), 2))) * sqrt(252) AS sortino, min(dd) AS max_drawdown FROM d GROUP BY ticker)
"""


@query("a1_ticker_performance", PERF + "SELECT ticker, n, round(ann_return, 6) AS ann_return, round(ann_vol, 6) AS ann_vol, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(ann_return / abs(max_drawdown), 6) AS calmar FROM a")
def a1_ticker_performance(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.performance(b.returns(spark, d)), "ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar")


@query("a9_daily_bars", "SELECT * FROM bars")
def a9_daily_bars(spark: Spark, d: str) -> DataFrame:
    return b.fresh_bars(spark, d)


@query("s1_range_scan", "SELECT ticker, date, close FROM bars WHERE ticker = 'Brand#11' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def s1_range_scan(spark: Spark, d: str) -> DataFrame:
    """The filters on brand and date reach the scans of both tables."""
    return b.resample_daily(b.trades(spark, d)).where("ticker = 'Brand#11' and date between date'1996-01-01' and date'1997-12-31'").select("ticker", "date", "close")


@query("p1_returns", "SELECT ticker, date, round(ret, 6) AS ret, round(ln(1 + ret), 6) AS log_ret FROM returns")
def p1_returns(spark: Spark, d: str) -> DataFrame:
    return rnd(b.returns(spark, d).select("ticker", "date", "ret", F.log1p("ret").alias("log_ret")), "ret", "log_ret")


@query("p2_usable_returns", "SELECT ticker, date, round(greatest(-0.5, least(2.0, ret)), 6) AS ret FROM returns WHERE ticker IN (SELECT ticker FROM bars GROUP BY 1 HAVING count(*) >= 252) AND ticker IN (SELECT ticker FROM returns GROUP BY 1 HAVING count(*) >= 50)")
def p2_usable_returns(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.usable(b.bars(spark, d)), "ret")


OK = "(high >= low AND high >= greatest(open, close) AND low <= least(open, close) AND open > 0 AND high > 0 AND low > 0 AND close > 0)"


@query("p3_consistent_rows", f"SELECT ticker, count(*) AS n, count(*) FILTER ({OK}) AS ok FROM panel GROUP BY ticker")
def p3_consistent_rows(spark: Spark, d: str) -> DataFrame:
    return b.source_panel(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(ret.consistent()).alias("ok"))


@query("p4_clean_prices", f"SELECT ticker, date, close FROM (SELECT *, abs(close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) AS c FROM bars) WHERE c <= 0.5 AND {OK}")
def p4_clean_prices(spark: Spark, d: str) -> DataFrame:
    return ret.clean(b.bars(spark, d)).select("ticker", "date", "close")


@query("p5_standardized", "SELECT ticker, date, close AS adj_close, volume FROM bars")
def p5_standardized(spark: Spark, d: str) -> DataFrame:
    return ret.standardized(b.bars(spark, d)).select("ticker", "date", "adj_close", "volume")


@query("p6_clipped_outliers", """WITH s AS (SELECT ticker, avg(ret) m, stddev_samp(ret) s FROM returns GROUP BY 1)
SELECT ticker, date, round(greatest(m - 5 * s, least(m + 5 * s, ret)), 6) AS clipped FROM returns JOIN s USING (ticker)""")
def p6_clipped_outliers(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.clip_outliers(b.returns(spark, d), 5.0).select("ticker", "date", "clipped"), "clipped")


@query("p7_rescaled", """WITH s AS (SELECT ticker, stddev_samp(ret) s FROM returns GROUP BY 1)
SELECT ticker, round(avg(CASE WHEN s < 0.01 THEN ret * 100 ELSE ret END), 6) AS mean_scaled FROM returns JOIN s USING (ticker) GROUP BY 1""")
def p7_rescaled(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.rescale_small(b.returns(spark, d)).groupBy("ticker").agg(F.avg("scaled").alias("mean_scaled")), "mean_scaled")


@query("p12_weekday_rows", "SELECT ticker, count(*) FILTER (isodow(date) < 6) AS weekday_rows, count(*) FILTER (isodow(date) >= 6) AS weekend_rows FROM bars GROUP BY 1")
def p12_weekday_rows(spark: Spark, d: str) -> DataFrame:
    wd = F.weekday("date") < 5
    return b.bars(spark, d).groupBy("ticker").agg(F.count_if(wd).alias("weekday_rows"), F.count_if(~wd).alias("weekend_rows"))


@query("p13_normalized", "SELECT ticker, date, round((close / first(close) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100, 4) AS pct FROM bars")
def p13_normalized(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.normalized(b.bars(spark, d)).select("ticker", "date", "pct"), "pct", digits=4)


@query("p14_downsampled", """WITH n AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) rn, count(*) OVER (PARTITION BY ticker) n FROM bars)
SELECT ticker, date FROM n WHERE (rn - 1) % CAST(ceil(n / 100) AS BIGINT) = 0 OR rn = n""")
def p14_downsampled(spark: Spark, d: str) -> DataFrame:
    return ret.downsample(b.bars(spark, d), 100).select("ticker", "date")


@query("p17_price_change", "SELECT ticker, round(arg_max(close, date) - arg_min(close, date), 4) AS change, round((arg_max(close, date) / arg_min(close, date) - 1) * 100, 4) AS pct FROM bars GROUP BY 1")
def p17_price_change(spark: Spark, d: str) -> DataFrame:
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return rnd(b.bars(spark, d).groupBy("ticker").agg((last - first).alias("change"), ((last / first - 1) * 100).alias("pct")), "change", "pct", digits=4)


@query("p18_date_filter", "SELECT ticker, count(*) AS n FROM bars WHERE date >= DATE '1998-01-01' AND date <= DATE '1998-12-31' GROUP BY 1")
def p18_date_filter(spark: Spark, d: str) -> DataFrame:
    return b.bars(spark, d).where("date between '1998-01-01' and '1998-12-31'").groupBy("ticker").agg(F.count("*").alias("n"))


@query("a4_var_cvar", """WITH v AS (SELECT ticker, quantile_cont(ret, 0.05) AS q FROM returns GROUP BY 1)
SELECT ticker, round(q, 6) AS var, round(avg(ret), 6) AS cvar FROM returns JOIN v USING (ticker) WHERE ret <= q GROUP BY ticker, q""")
def a4_var_cvar(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.expected_shortfall(b.returns(spark, d), 0.95), "var", "cvar")


AGAINST = """WITH m AS (SELECT date, ret AS bench FROM returns WHERE ticker = 'Brand#11'), j AS (SELECT ticker, ret, bench, greatest(ret - bench, -0.999999) AS act FROM returns JOIN m USING (date) WHERE ticker <> 'Brand#11'),
a AS (SELECT ticker, count(*) AS n, exp(sum(ln(1 + act)) * 252 / count(*)) - 1 AS active, stddev_samp(act) * sqrt(252) AS te, covar_samp(ret, bench) / var_samp(bench) AS beta,
  exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS ar, exp(sum(ln(1 + bench)) * 252 / count(*)) - 1 AS ab FROM j GROUP BY 1)
SELECT ticker, n, round(beta, 6) AS beta, round(active / te, 6) AS information_ratio, round(ar - (0.02 + beta * (ab - 0.02)), 4) AS alpha, round((ar - 0.02) / beta, 4) AS treynor FROM a"""


@query("a7_against_benchmark", AGAINST)
def a7_against_benchmark(spark: Spark, d: str) -> DataFrame:
    return rnd(rnd(ret.against(b.returns(spark, d), "Brand#11"), "beta", "information_ratio"), "alpha", "treynor", digits=4)


@query("a8_moments", "SELECT ticker, round(skewness(ret), 5) AS skew, round(kurtosis(ret), 5) AS kurt FROM returns GROUP BY 1")
def a8_moments(spark: Spark, d: str) -> DataFrame:
    return rnd(b.returns(spark, d).groupBy("ticker").agg(stats.skew("ret").alias("skew"), stats.kurt("ret").alias("kurt")), "skew", "kurt", digits=5)


def _period(unit: str) -> str:
    shift = " + 6" if unit == "week" else ""
    return f"""WITH p AS (SELECT ticker, CAST(date_trunc('{unit}', date) AS DATE){shift} AS period, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)
SELECT ticker, period, close, round(close / lag(close) OVER (PARTITION BY ticker ORDER BY period) - 1, 6) AS ret FROM p"""


def _periods(unit: str):
    def run(spark: Spark, d: str) -> DataFrame:
        return rnd(ret.period_returns(b.bars(spark, d), unit), "ret")

    return query(f"a10_{unit}_returns", _period(unit))(run)


for _unit in ("week", "month", "year"):
    _periods(_unit)


@query("a11_block_returns", """WITH n AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM returns)
SELECT ticker, rn // 21 AS block, round(exp(sum(ln(1 + ret))) - 1, 6) AS ret FROM n WHERE (rn // 21) * 21 < n - 21 GROUP BY 1, 2""")
def a11_block_returns(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.block_returns(b.returns(spark, d), 21).withColumn("block", F.col("block").cast("long")), "ret")


@query("a34_population_stats", """SELECT ticker, round(avg(close), 6) AS mean, round(median(close), 6) AS median, round(var_pop(close), 4) AS variance, round(stddev_pop(close), 6) AS std, min(close) AS low, max(close) AS high,
quantile_disc(close, 0.25) AS p25, quantile_disc(close, 0.75) AS p75 FROM bars GROUP BY 1""")
def a34_population_stats(spark: Spark, d: str) -> DataFrame:
    out = b.bars(spark, d).groupBy("ticker").agg(
        F.avg("close").alias("mean"), F.median("close").alias("median"), F.var_pop("close").alias("variance"), F.stddev_pop("close").alias("std"), F.min("close").alias("low"), F.max("close").alias("high"),
        F.expr("percentile_disc(0.25) within group (order by close)").alias("p25"), F.expr("percentile_disc(0.75) within group (order by close)").alias("p75"),
    )
    return rnd(rnd(out, "mean", "median", "std"), "variance", digits=4)


@query("a35_win_rates", "SELECT ticker, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(ret) FILTER (ret > 0), 6) AS avg_gain, round(avg(ret) FILTER (ret < 0), 6) AS avg_loss FROM returns GROUP BY 1")
def a35_win_rates(spark: Spark, d: str) -> DataFrame:
    r = F.col("ret")
    out = b.returns(spark, d).groupBy("ticker").agg(F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg(F.when(r > 0, r)).alias("avg_gain"), F.avg(F.when(r < 0, r)).alias("avg_loss"))
    return rnd(out, "win_rate", "avg_gain", "avg_loss")


@query("a36_downside_sortino", "SELECT ticker, CASE WHEN count(*) FILTER (ret < 0) = 0 THEN NULL ELSE round((avg(ret) * 252 - 0.02) / (sqrt(avg(ret * ret) FILTER (ret < 0)) * sqrt(252)), 6) END AS sortino FROM returns GROUP BY 1")
def a36_downside_sortino(spark: Spark, d: str) -> DataFrame:
    r = F.col("ret")
    down = F.sqrt(F.avg(F.when(r < 0, r * r))) * F.sqrt(F.lit(252.0))
    return rnd(b.returns(spark, d).groupBy("ticker").agg(F.try_divide(F.avg(r) * 252 - 0.02, down).alias("sortino")), "sortino")


@query("a45_price_extent", "SELECT ticker, min(least(open, high, low, close)) AS lowest, max(greatest(open, high, low, close)) AS highest, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1")
def a45_price_extent(spark: Spark, d: str) -> DataFrame:
    x = ("open", "high", "low", "close")
    return b.bars(spark, d).groupBy("ticker").agg(F.min(F.least(*x)).alias("lowest"), F.max(F.greatest(*x)).alias("highest"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("a46_series_summary", """SELECT ticker, count(*) AS n, round(min(close), 6) AS low, round(max(close), 6) AS high, round(avg(close), 6) AS mean, round(median(close), 6) AS median, round(max(close) - min(close), 6) AS spread,
round(arg_min(close, date), 6) AS first_value, round(arg_max(close, date), 6) AS last_value FROM bars GROUP BY 1""")
def a46_series_summary(spark: Spark, d: str) -> DataFrame:
    c = "close"
    out = b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.median(c).alias("median"), (F.max(c) - F.min(c)).alias("spread"), F.min_by(c, "date").alias("first_value"), F.max_by(c, "date").alias("last_value"))
    return rnd(out, "low", "high", "mean", "median", "spread", "first_value", "last_value")


@query("a50_fund_risk", "SELECT ticker, round(stddev_samp(ret) * sqrt(252), 6) AS vol, round(CASE WHEN stddev_samp(ret) = 0 THEN 0 ELSE (avg(ret) - 0.02 / 252) * 252 / (stddev_samp(ret) * sqrt(252)) END, 6) AS sharpe FROM returns GROUP BY 1")
def a50_fund_risk(spark: Spark, d: str) -> DataFrame:
    vol = stats.volatility("ret")
    return rnd(b.returns(spark, d).groupBy("ticker").agg(vol.alias("vol"), F.coalesce(F.try_divide((F.avg("ret") - 0.02 / 252) * 252, vol), F.lit(0.0)).alias("sharpe")), "vol", "sharpe")


@query("w2_growth", "SELECT ticker, date, round(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS log_growth FROM returns")
def w2_growth(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.cumulative(b.returns(spark, d)).select("ticker", "date", F.log("growth").alias("log_growth")), "log_growth")


@query("w3_drawdown", PERF.replace("WITH g", "WITH g", 1) + "SELECT ticker, date, round(dd, 6) AS drawdown FROM d")
def w3_drawdown(spark: Spark, d: str) -> DataFrame:
    return rnd(ret.cumulative(b.returns(spark, d)).select("ticker", "date", "drawdown"), "drawdown")


@query("w6_sma", "SELECT ticker, date, round(CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END, 6) AS sma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)")
def w6_sma(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.sma(b.bars(spark, d), 20).select("ticker", "date", "sma"), "sma")


@query("w7_ema", """WITH RECURSIVE n AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) rn FROM bars),
e AS (SELECT ticker, CAST(20 AS BIGINT) AS rn, (SELECT avg(close) FROM n m WHERE m.ticker = t.ticker AND m.rn <= 20) AS ema FROM (SELECT DISTINCT ticker FROM n WHERE rn = 20) t
  UNION ALL SELECT n.ticker, n.rn, n.close * (2.0 / 21) + e.ema * (1 - 2.0 / 21) FROM e JOIN n ON n.ticker = e.ticker AND n.rn = e.rn + 1)
SELECT ticker, date, round(ema, 4) AS ema FROM e JOIN n USING (ticker, rn)""")
def w7_ema(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.ema(b.bars(spark, d), 20), "ema", digits=4)


@query("w8_rsi", """WITH x AS (SELECT ticker, date, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS d FROM bars), y AS (SELECT * FROM x WHERE d IS NOT NULL),
z AS (SELECT ticker, date, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l, count(*) OVER w AS c FROM y WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING))
SELECT ticker, date, round(CASE WHEN c < 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 4) AS rsi FROM z""")
def w8_rsi(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.rsi(b.bars(spark, d), 14), "rsi", digits=4)


@query("w9_ewma_variance", """WITH v AS (SELECT ticker, ret, pow(0.94, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1) AS v FROM returns),
s AS (SELECT ticker, sum(v) v1, sum(v * v) v2, sum(v * ret) m, sum(v * ret * ret) q FROM v GROUP BY 1) SELECT ticker, round((q / v1 - pow(m / v1, 2)) * v1 * v1 / (v1 * v1 - v2), 6) AS ewma_var FROM s""")
def w9_ewma_variance(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.ewma_variance(b.returns(spark, d)), "ewma_var")


HOLED = "WITH h AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, CASE WHEN day(date) % 3 = 0 OR day(date) BETWEEN 10 AND 22 THEN NULL ELSE close END AS close FROM bars)"


@query("w10_filled", HOLED + """, k AS (SELECT *, last_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS ra, last_value(close IGNORE NULLS) OVER p AS va,
 first_value(CASE WHEN close IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS rz, first_value(close IGNORE NULLS) OVER f AS vz FROM h
 WINDOW p AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT ticker, date, CASE WHEN rn - ra <= 5 THEN va END AS ffill, round(1e-9 + coalesce(close, CASE WHEN rn - ra <= 5 OR rz - rn <= 5 THEN CASE WHEN ra IS NULL THEN vz WHEN rz IS NULL THEN va ELSE va + (vz - va) * (rn - ra) / nullif(rz - ra, 0) END END), 6) AS linear FROM k""")
def w10_filled(spark: Spark, d: str) -> DataFrame:
    hole = F.when((F.day("date") % 3 == 0) | F.day("date").between(10, 22), None).otherwise(F.col("close"))
    return rnd(ind.fill_gaps(b.bars(spark, d).withColumn("close", hole), "close", 5).select("ticker", "date", "ffill", (F.col("linear") + 1e-9).alias("linear")), "linear")


@query("w11_latest_row", "SELECT ticker, date, arg_max(source, source_priority) AS source FROM panel GROUP BY 1, 2")
def w11_latest_row(spark: Spark, d: str) -> DataFrame:
    return ind.latest(b.source_panel(spark, d), ["ticker", "date"], [F.desc("source_priority")]).select("ticker", "date", "source")


@query("w12_rebalance_dates", """WITH t AS (SELECT DISTINCT date FROM bars)
SELECT 'month' AS unit, min(date) AS date FROM t GROUP BY date_trunc('month', date) UNION ALL SELECT 'quarter', min(date) FROM t GROUP BY date_trunc('quarter', date)
UNION ALL SELECT 'year', min(date) FROM t GROUP BY date_trunc('year', date) UNION ALL SELECT 'week', date FROM t WHERE isodow(date) = 1""")
def w12_rebalance_dates(spark: Spark, d: str) -> DataFrame:
    days = b.bars(spark, d).select("date").distinct()
    parts = [ind.first_of_period(days, u).select(F.lit(u).alias("unit"), "date") for u in ("month", "quarter", "year", "week")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


ACF = """WITH n AS (SELECT ticker, ret, row_number() OVER (PARTITION BY ticker ORDER BY date) rn FROM returns), a AS (SELECT x.ticker, y.rn - x.rn AS lag, corr(x.ret, y.ret) AS rho, count(*) AS n
FROM n x JOIN n y ON x.ticker = y.ticker AND y.rn - x.rn BETWEEN 1 AND 20 GROUP BY 1, 2)"""


@query("w13_autocorrelation", ACF + " SELECT ticker, CAST(lag AS INTEGER) AS lag, n, round(rho, 6) AS rho FROM a")
def w13_autocorrelation(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.autocorrelation(b.returns(spark, d), 20), "rho")


@query("w14_date_gaps", "SELECT ticker, round(avg(g), 6) AS mean_gap, CAST(max(g) AS INTEGER) AS max_gap FROM (SELECT ticker, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS g FROM bars) GROUP BY 1")
def w14_date_gaps(spark: Spark, d: str) -> DataFrame:
    g = b.bars(spark, d).withColumn("g", F.datediff("date", F.lag("date").over(b.by_date())))
    return rnd(g.groupBy("ticker").agg(F.avg("g").alias("mean_gap"), F.max("g").alias("max_gap")), "mean_gap")


@query("w15_first_last", "SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1")
def w15_first_last(spark: Spark, d: str) -> DataFrame:
    x = b.bars(spark, d).where("date between date'1996-01-01' and date'1999-12-31'")
    return x.groupBy("ticker").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))


@query("w16_tail_window", "SELECT ticker, round(sum(ret), 6) AS tail_sum, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) rn FROM returns) WHERE rn <= 60 GROUP BY 1")
def w16_tail_window(spark: Spark, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rnd(b.returns(spark, d).withColumn("rn", rn).where("rn <= 60").groupBy("ticker").agg(F.sum("ret").alias("tail_sum"), F.count("*").alias("n")), "tail_sum")


@query("w17_decay_rate", ACF + " SELECT ticker, round(-regr_slope(ln(abs(rho) + 1e-10), lag), 6) AS decay FROM a GROUP BY 1")
def w17_decay_rate(spark: Spark, d: str) -> DataFrame:
    return rnd(ind.decay_rate(ind.autocorrelation(b.returns(spark, d), 20)), "decay")
