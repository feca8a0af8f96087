"""Queries on covariance, correlation and portfolio risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import returns as ret
from tidemark.operators import risk
from tidemark.plans.market import rnd
from tidemark.sources import bars as b

Spark = SparkSession

PAIRS = """WITH p AS (SELECT x.ticker AS a, y.ticker AS b, x.date, x.ret AS x, y.ret AS y FROM returns x JOIN returns y ON x.date = y.date AND x.ticker <= y.ticker),
c AS (SELECT a, b, count(*) AS n, covar_samp(x, y) AS cov, corr(x, y) AS corr FROM p GROUP BY a, b)"""


@query("a12_covariance", PAIRS + " SELECT a, b, n, round(cov, 6) AS cov, round(corr, 6) AS corr FROM c")
def a12_covariance(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.covariance(b.returns(spark, d)), "cov", "corr")


COMPLETE = "k AS (SELECT date FROM returns GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM returns))"


@query("j6_complete_cases", f"WITH {COMPLETE} SELECT ticker, count(*) AS n, round(avg(ret), 6) AS mean FROM returns SEMI JOIN k USING (date) GROUP BY 1")
def j6_complete_cases(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.complete_cases(b.returns(spark, d)).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")), "mean")


@query("a12_spearman", f"""WITH {COMPLETE}, r AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 AS rk FROM returns SEMI JOIN k USING (date))
SELECT x.ticker AS a, y.ticker AS b, round(corr(x.rk, y.rk), 6) AS spearman FROM r x JOIN r y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2""")
def a12_spearman(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.rank_correlation(b.returns(spark, d)), "spearman")


@query("a12_kendall", """WITH m AS (SELECT ticker, date_trunc('month', date) AS date, arg_max(close, date) AS ret FROM bars GROUP BY 1, 2),
p AS (SELECT x.ticker AS a, y.ticker AS b, x.date, x.ret AS x, y.ret AS y FROM m x JOIN m y ON x.date = y.date AND x.ticker < y.ticker)
SELECT p.a, p.b, round(avg(sign(p.x - q.x) * sign(p.y - q.y)), 6) AS kendall FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.date < q.date GROUP BY 1, 2""")
def a12_kendall(spark: Spark, d: str) -> DataFrame:
    m = b.bars(spark, d).groupBy("ticker", F.date_trunc("month", "date").alias("date")).agg(F.max_by("close", "date").alias("ret"))
    return rnd(risk.kendall(m).select("a", "b", "kendall"), "kendall")


@query("a12_kendall_all_pairs", """WITH p AS (SELECT x.ticker AS a, y.ticker AS b, x.date, x.ret AS x, y.ret AS y FROM returns x JOIN returns y ON x.date = y.date AND x.ticker < y.ticker),
s AS (SELECT p.a, p.b, sign(p.x - q.x)::INT AS sx, sign(p.y - q.y)::INT AS sy FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.date < q.date), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)
SELECT a, b, any_value(n) AS n, round(avg(sx * sy), 6) AS kendall, round(sum(sx * sy) / sqrt(nullif(sum(sx * sx)::DOUBLE * sum(sy * sy), 0)), 6) AS tau_b FROM s JOIN n USING (a, b) GROUP BY 1, 2""")
def a12_kendall_all_pairs(spark: Spark, d: str) -> DataFrame:
    """Daily returns of all tickers."""
    return rnd(risk.kendall(b.returns(spark, d)), "kendall", "tau_b")


SYM = PAIRS + ", s AS (SELECT a, b, cov FROM c UNION ALL SELECT b, a, cov FROM c WHERE a <> b)"


@query("a13_portfolio_variance", SYM + " SELECT round(sum(x.w * y.w * cov), 6) AS variance, round(sqrt(sum(x.w * y.w * cov)), 6) AS sigma FROM s JOIN weights x ON x.ticker = a JOIN weights y ON y.ticker = b")
def a13_portfolio_variance(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.portfolio_variance(risk.covariance(b.returns(spark, d)), b.weights(spark, d)), "variance", "sigma")


@query("a14_risk_contributions", SYM + """, r AS (SELECT a AS ticker, x.w, sum(cov * y.w) AS s FROM s JOIN weights x ON x.ticker = a JOIN weights y ON y.ticker = b GROUP BY a, x.w), t AS (SELECT sqrt(sum(w * s)) AS sigma FROM r)
SELECT ticker, round(s / sigma, 6) AS marginal, round(w * s / sigma, 6) AS contribution, round(w * s / sigma / sigma, 6) AS share FROM r, t""")
def a14_risk_contributions(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.contributions(risk.covariance(b.returns(spark, d)), b.weights(spark, d)), "marginal", "contribution", "share")


PORT = "port AS (SELECT date, sum(w * ret) AS ret FROM returns JOIN weights USING (ticker) GROUP BY 1)"


@query("p20_portfolio_returns", f"WITH {PORT} SELECT date, round(ret, 6) AS ret FROM port")
def p20_portfolio_returns(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.portfolio_returns(b.returns(spark, d), b.weights(spark, d)), "ret")


@query("a15_portfolio_var", f"""WITH {PORT}, q AS (SELECT quantile_cont(ret, 0.05) AS q, avg(ret) AS m, stddev_samp(ret) AS s FROM port)
SELECT round(q * sqrt(10), 6) AS var_hist, round(m * 10 + -1.6448536269514722 * s * sqrt(10), 6) AS var_param, round((SELECT avg(ret) FROM port, q WHERE ret <= q.q) * sqrt(10), 6) AS cvar FROM q""")
def a15_portfolio_var(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.value_at_risk(risk.portfolio_returns(b.returns(spark, d), b.weights(spark, d)), 0.95, 10), "var_hist", "var_param", "cvar")


SCENARIOS = [("crash", "Brand#11", -0.20), ("crash", "Brand#12", 0.05), ("crash", "Brand#13", 0.10), ("inflation", "Brand#11", -0.05), ("inflation", "Brand#14", 0.15), ("quiet", "Brand#99", 0.3)]


@query("a18_stress_test", "WITH v(scenario, ticker, r) AS (VALUES " + ", ".join(f"('{a}', '{t}', {r})" for a, t, r in SCENARIOS) + ") SELECT scenario, round(sum(coalesce(w, 0) * r), 6) AS impact FROM v LEFT JOIN weights USING (ticker) GROUP BY 1")
def a18_stress_test(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.stress(b.weights(spark, d), spark.createDataFrame(SCENARIOS, "scenario string, ticker string, ret double")), "impact")


@query("a19_simulated_var")
def a19_simulated_var(spark: Spark, d: str) -> DataFrame:
    """Normal draws around the portfolio's mean and deviation; two numbers reach the driver."""
    m = risk.portfolio_returns(b.returns(spark, d), b.weights(spark, d)).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s")).first()
    return rnd(risk.simulated_var(spark, m.m or 0.0, m.s or 0.0, 100_000), "var_sim")


@query("a20_benchmark_correlation", f"WITH {PORT}, m AS (SELECT date, ret AS bench FROM returns WHERE ticker = 'Brand#11') SELECT count(*) AS n, round(corr(ret, bench), 6) AS corr FROM port JOIN m USING (date)")
def a20_benchmark_correlation(spark: Spark, d: str) -> DataFrame:
    r = b.returns(spark, d)
    bench = r.where("ticker = 'Brand#11'").select("date", F.col("ret").alias("bench"))
    return rnd(risk.portfolio_returns(r, b.weights(spark, d)).join(bench, "date").agg(F.count("*").alias("n"), F.corr("ret", "bench").alias("corr")), "corr")


@query("a21_low_correlation", PAIRS + " SELECT a, b, n, round(corr, 6) AS corr FROM c WHERE a <> b AND abs(corr) <= 0.02 AND n >= 100")
def a21_low_correlation(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.low_pairs(risk.covariance(b.returns(spark, d)), 0.02, 100), "corr")


@query("b17_correlation_network", PAIRS + " SELECT a, b, round(corr, 6) AS corr FROM c WHERE a <> b AND abs(corr) >= 0.05")
def b17_correlation_network(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.edges(risk.covariance(b.returns(spark, d)), 0.05), "corr")


ROLL = PAIRS + """, r AS (SELECT a, b, date, CASE WHEN count(*) OVER w = 60 THEN corr(x, y) OVER w END AS corr FROM p WHERE b <> a WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS 59 PRECEDING))"""


def _all_pairs(spark: Spark, d: str) -> DataFrame:
    return risk.pairs(b.returns(spark, d), same=False)


@query("w4_rolling_correlation", ROLL + " SELECT a, b, date, round(corr, 5) + 0 AS corr FROM r")  # + 0: no negative zeros
def w4_rolling_correlation(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.rolling_correlation(_all_pairs(spark, d)).select("a", "b", "date", "corr"), "corr", digits=5)


@query("a22_correlation_stability", ROLL + " SELECT a, b, round(avg(corr), 5) AS mean, round(stddev_samp(corr), 5) AS std, round(min(corr), 5) AS low, round(max(corr), 5) AS high, round(max(corr) - min(corr), 5) AS spread FROM r WHERE corr IS NOT NULL GROUP BY 1, 2")
def a22_correlation_stability(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.stability(_all_pairs(spark, d)), "mean", "std", "low", "high", "spread", digits=5)


@query("w4_rolling_correlation_all_pairs", ROLL + " SELECT a, b, date, round(corr, 5) + 0 AS corr FROM r")
def w4_rolling_correlation_all_pairs(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.rolling_correlation(risk.pairs(b.returns(spark, d), same=False)).select("a", "b", "date", "corr"), "corr", digits=5)


@query("a22_correlation_stability_all_pairs", ROLL + " SELECT a, b, round(avg(corr), 5) AS mean, round(stddev_samp(corr), 5) AS std, round(min(corr), 5) AS low, round(max(corr), 5) AS high, round(max(corr) - min(corr), 5) AS spread FROM r WHERE corr IS NOT NULL GROUP BY 1, 2")
def a22_correlation_stability_all_pairs(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.stability(risk.pairs(b.returns(spark, d), same=False)), "mean", "std", "low", "high", "spread", digits=5)


# daily order totals are a smooth series with real recoveries
SMOOTH = """WITH t AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2),
r AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM t) WHERE ret IS NOT NULL)"""
EPISODES = SMOOTH + """, g AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS gr FROM r), h AS (SELECT *, max(gr) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM g),
i AS (SELECT *, gr / pk - 1 AS dd, sum(CASE WHEN gr / pk - 1 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS island FROM h),
dn AS (SELECT ticker, island, min(dd) AS depth, arg_min(date, row(dd, date)) AS trough, min(date) AS s FROM i WHERE dd < 0 GROUP BY 1, 2), tops AS (SELECT ticker, island, date FROM i WHERE dd = 0)
SELECT dn.ticker, pk.date AS peak_date, trough, rec.date AS recovery, round(depth, 6) AS depth, rec.date - s AS days FROM dn JOIN tops pk ON pk.ticker = dn.ticker AND pk.island = dn.island JOIN tops rec ON rec.ticker = dn.ticker AND rec.island = dn.island + 1"""


def smooth_returns(spark: Spark, d: str) -> DataFrame:
    daily = b.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    return b.simple_returns(daily)


@query("w5_drawdown_episodes", EPISODES)
def w5_drawdown_episodes(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.drawdown_episodes(smooth_returns(spark, d)), "depth")


@query("a41_backtest_metrics", f"""WITH {PORT}, g AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS gr FROM (SELECT date, greatest(-0.9, least(0.9, ret)) AS ret FROM port)),
h AS (SELECT *, gr / greatest(1, max(gr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM g)
SELECT count(*) AS days, round(exp(sum(ln(1 + ret)) * 252 / count(*)) - 1, 5) AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol, round(min(dd), 6) AS max_drawdown FROM h""")
def a41_backtest_metrics(spark: Spark, d: str) -> DataFrame:
    port = risk.portfolio_returns(b.returns(spark, d), b.weights(spark, d)).select(F.lit("portfolio").alias("ticker"), "date", F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.col("ret"))).alias("ret"))
    out = ret.performance(port).select(F.col("n").alias("days"), "ann_return", "ann_vol", "max_drawdown")
    return rnd(rnd(out, "ann_vol", "max_drawdown"), "ann_return", digits=5)
