"""Queries on portfolio construction, optimisation and backtests. Portfolios are the five brand families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions.stats import significant, significant_sql
from tidemark.operators import indicators as ind
from tidemark.operators import portfolio as pf
from tidemark.plans.market import rnd
from tidemark.sources import bars as b

Spark = SparkSession
BOOKS = "bk AS (SELECT DISTINCT p_brand AS ticker, left(p_brand, 7) AS portfolio FROM part), pr AS (SELECT portfolio, ticker, date, ret FROM returns JOIN bk USING (ticker))"

def family() -> Column:
    return F.left("ticker", F.lit(7)).alias("portfolio")


def booked(spark: Spark, d: str) -> DataFrame:
    return b.returns(spark, d).select(family(), "ticker", "date", "ret")


def members(spark: Spark, d: str) -> DataFrame:
    return b.table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("cap")).select(family(), "ticker", "cap")


@query("b1_equal_weights", "SELECT left(t, 7) AS portfolio, t AS ticker, round(1.0 / count(*) OVER (PARTITION BY left(t, 7)), 6) AS w FROM (SELECT DISTINCT p_brand AS t FROM part)", base=False)
def b1_equal_weights(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.equal_weights(members(spark, d)).drop("cap"), "w")


@query("b1_core_satellite", "WITH m AS (SELECT DISTINCT p_brand AS t, p_brand LIKE '%1' OR p_brand LIKE '%2' AS c FROM part) SELECT left(t, 7) AS portfolio, t AS ticker, round(CASE WHEN c THEN 0.7 ELSE 0.3 END / count(*) OVER (PARTITION BY left(t, 7), c), 6) AS w FROM m", base=False)
def b1_core_satellite(spark: Spark, d: str) -> DataFrame:
    m = members(spark, d).withColumn("is_core", F.col("ticker").rlike("[12]$"))
    return rnd(pf.core_satellite(m).select("portfolio", "ticker", "w"), "w")


@query("b1_sector_rotation", "WITH m AS (SELECT left(p_brand, 7) AS portfolio, split_part(p_type, ' ', 1) AS sector, min(p_brand) AS ticker FROM part GROUP BY 1, 2) SELECT portfolio, sector, ticker, round(1.0 / count(*) OVER (PARTITION BY portfolio), 6) AS w FROM m", base=False)
def b1_sector_rotation(spark: Spark, d: str) -> DataFrame:
    m = b.table(spark, d, "part").select(F.left("p_brand", F.lit(7)).alias("portfolio"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sector"), F.col("p_brand").alias("ticker"))
    return rnd(pf.sector_rotation(m), "w")


@query("b2_cap_weights", "WITH m AS (SELECT left(p_brand, 7) AS portfolio, p_brand AS ticker, sum(p_retailprice) AS cap FROM part GROUP BY 1, 2) SELECT portfolio, ticker, round(cap / sum(cap) OVER (PARTITION BY portfolio), 6) AS w FROM m", base=False)
def b2_cap_weights(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.proportional(members(spark, d), "cap").drop("cap"), "w")


TAIL = f"WITH {BOOKS}, t AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM pr), l AS (SELECT * FROM t WHERE rn <= 60)"


@query("b3_momentum", TAIL + ", m AS (SELECT portfolio, ticker, exp(sum(ln(1 + ret))) AS m FROM l GROUP BY 1, 2) SELECT portfolio, ticker, CASE WHEN row_number() OVER (PARTITION BY portfolio ORDER BY m DESC, ticker) <= 3 THEN 1.0::DOUBLE / 3 ELSE 0 END AS w FROM m")
def b3_momentum(spark: Spark, d: str) -> DataFrame:
    return pf.momentum(booked(spark, d), 60, 3)


@query("b4_inverse_volatility", TAIL + ", m AS (SELECT portfolio, ticker, 1 / stddev_samp(ret) AS iv FROM l GROUP BY 1, 2) SELECT portfolio, ticker, round(iv / sum(iv) OVER (PARTITION BY portfolio), 6) AS w FROM m")
def b4_inverse_volatility(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.inverse_volatility(booked(spark, d), 60), "w")


def _clipped(spark: Spark, d: str) -> DataFrame:
    return booked(spark, d).withColumn("ret", F.greatest(F.lit(-0.5), F.least(F.lit(2.0), F.col("ret"))))


@query("b5_min_variance")
def b5_min_variance(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.optimized(pf.moments(_clipped(spark, d)), "min_variance"), "w")


OPTIMAL = "SELECT left(p_brand, 7) AS portfolio, count(DISTINCT p_brand) AS assets, true AS sums_to_one, true AS in_bounds, true AS optimal FROM part GROUP BY 1"


def _optimal(spark: Spark, d: str, kind: str, rf: float | None) -> DataFrame:
    mom = pf.moments(_clipped(spark, d))
    x = pf.optimality(mom, pf.optimized(mom, kind), rf)
    return x.select("portfolio", "assets", (F.abs(F.col("total") - 1) < 1e-9).alias("sums_to_one"), (F.col("lowest") >= 0).alias("in_bounds"), (F.col("excess") < 1e-3).alias("optimal"))


@query("b5_optimality", OPTIMAL, base=False)
def b5_optimality(spark: Spark, d: str) -> DataFrame:
    """That no asset would lower the variance of the weights of b5: what makes them the ones asked for."""
    return _optimal(spark, d, "min_variance", None)


@query("b6_optimality", OPTIMAL, base=False)
def b6_optimality(spark: Spark, d: str) -> DataFrame:
    """That no asset would raise the ratio of excess return to deviation of the weights of b6."""
    return _optimal(spark, d, "max_sharpe", 0.02)


@query("b6_max_sharpe")
def b6_max_sharpe(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.optimized(pf.moments(_clipped(spark, d)), "max_sharpe"), "w", digits=4)


@query("b7_risk_parity")
def b7_risk_parity(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.optimized(pf.moments(_clipped(spark, d)), "risk_parity"), "w")


@query("b7_risk_shares", "SELECT left(p_brand, 7) AS portfolio, p_brand AS ticker, round(1.0 / count(*) OVER (PARTITION BY left(p_brand, 7)), 4) AS share FROM (SELECT DISTINCT p_brand FROM part)", base=False)
def b7_risk_shares(spark: Spark, d: str) -> DataFrame:
    """Each asset's share of the variance under risk parity weights: what the weights are for is that these are equal."""
    mom = pf.moments(_clipped(spark, d))
    w = pf.optimized(mom, "risk_parity")
    held = mom.join(w.select("portfolio", F.col("ticker").alias("b"), F.col("w").alias("wb")), ["portfolio", "b"]).groupBy("portfolio", F.col("a").alias("ticker")).agg(F.sum(F.col("cov") * F.col("wb")).alias("s"))
    part = held.join(w, ["portfolio", "ticker"]).withColumn("c", F.col("w") * F.col("s"))
    return rnd(part.select("portfolio", "ticker", (F.col("c") / F.sum("c").over(pf.book())).alias("share")), "share", digits=4)


@query("b8_frontier")
def b8_frontier(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.frontier(pf.moments(_clipped(spark, d)), 10), "target", "ret", "sigma", digits=4)


@query("b13_linkage")
def b13_linkage(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.linkage(pf.moments(_clipped(spark, d))), "height")


@query("j4_aligned_prices", "WITH g AS (SELECT ticker, date FROM (SELECT DISTINCT date FROM bars), (SELECT DISTINCT ticker FROM bars)) SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM g LEFT JOIN bars USING (ticker, date)")
def j4_aligned_prices(spark: Spark, d: str) -> DataFrame:
    p = b.bars(spark, d)
    return pf.aligned(p, p)


BACKTEST = f"""WITH bk AS (SELECT DISTINCT p_brand AS ticker, left(p_brand, 7) AS portfolio, 0.19 AS w FROM part), g AS (SELECT ticker, date FROM (SELECT DISTINCT date FROM bars WHERE date >= DATE '1995-03-01'), (SELECT DISTINCT ticker FROM bars)),
al AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM g LEFT JOIN bars USING (ticker, date)),
al2 AS (SELECT * FROM al WHERE date >= DATE '1995-07-01'), rb AS (SELECT min(date) AS s FROM al2 GROUP BY date_trunc('quarter', date)), sp AS (SELECT s, lead(s) OVER (ORDER BY s) AS e FROM rb),
p AS (SELECT portfolio, ticker, w, date, close, s, e FROM al2 JOIN sp ON date >= s AND (e IS NULL OR date < e) JOIN bk USING (ticker) WHERE close IS NOT NULL), b0 AS (SELECT portfolio, ticker, s, close AS p0 FROM p WHERE date = s),
gr AS (SELECT portfolio, s, date, 1 + sum(w * (close / p0 - 1)) AS g FROM p JOIN b0 USING (portfolio, ticker, s) GROUP BY 1, 2, 3),
wh AS (SELECT b0.portfolio, b0.s, 1 + sum(0.19 * (al2.close / p0 - 1)) AS whole FROM b0 JOIN sp USING (s) JOIN al2 ON al2.ticker = b0.ticker AND al2.date = e GROUP BY 1, 2),
v AS (SELECT portfolio, s, coalesce(exp(sum(ln(coalesce(whole, 1))) OVER (PARTITION BY portfolio ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) * 100000 AS v0 FROM (SELECT DISTINCT portfolio, s FROM gr) LEFT JOIN wh USING (portfolio, s))
SELECT portfolio, date, CASE WHEN v0 * g > 0 THEN round(ln(v0 * g), 6) END AS log_value FROM gr JOIN v USING (portfolio, s)"""


@query("b9_backtest", BACKTEST)
def b9_backtest(spark: Spark, d: str) -> DataFrame:
    """Quarterly rebalanced families, 19% in each member; a family of many members borrows, and a value of 0 or less has no logarithm
    (null). After a rebalance at less than 0 there are no values any more (NaN), as the logarithm of that loss in SQL is none."""
    prices = b.bars(spark, d).where("date >= '1995-03-01'")
    w = members(spark, d).select("portfolio", "ticker", F.lit(0.19).alias("w"))
    days = ind.first_of_period(prices.select("date").distinct().where("date >= '1995-07-01'"), "quarter")
    return rnd(pf.backtest(prices, w, days, start="1995-07-01").select("portfolio", "date", F.when(F.col("value") > 0, F.log("value")).alias("log_value")), "log_value")


TRADES = "tr AS (SELECT 'c' || (o_custkey % 50) AS portfolio, p_brand AS ticker, o_orderkey AS at, CASE WHEN l_linenumber % 3 = 0 THEN -l_quantity ELSE l_quantity END AS shares, l_extendedprice / l_quantity AS price, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def trades(spark: Spark, d: str) -> DataFrame:
    """Trades of fifty books: every third line of an order sells."""
    lines, orders, parts = (b.table(spark, d, t) for t in ("lineitem", "orders", "part"))
    x = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    shares = F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return x.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("portfolio"), F.col("p_brand").alias("ticker"), F.col("o_orderkey").alias("at"), shares.alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_linenumber").alias("line"))


@query("p9_transaction_amounts", f"WITH {TRADES} SELECT portfolio, CASE WHEN shares > 0 THEN 'BUY' ELSE 'SELL' END AS kind, count(*) AS n, round(sum(abs(shares) * price), 2) AS gross, round(sum(CASE WHEN shares > 0 THEN -(shares * price + 5) ELSE -shares * price - 5 END), 2) AS net FROM tr GROUP BY 1, 2", base=False)
def p9_transaction_amounts(spark: Spark, d: str) -> DataFrame:
    s, p = F.col("shares"), F.col("price")
    net = F.when(s > 0, -(s * p + 5)).otherwise(-s * p - 5)
    return rnd(trades(spark, d).groupBy("portfolio", F.when(s > 0, "BUY").otherwise("SELL").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.abs(s) * p).alias("gross"), F.sum(net).alias("net")), "gross", "net", digits=2)


@query("b11_positions", f"""WITH RECURSIVE {TRADES}, n AS (SELECT *, row_number() OVER (PARTITION BY portfolio, ticker ORDER BY tr.at, l_linenumber, shares, price) AS k FROM tr),
f AS (SELECT portfolio, ticker, 0::BIGINT AS k, 0::DOUBLE AS held, 0::DOUBLE AS cost, 0::DOUBLE AS gain, 0::DOUBLE AS unfilled FROM n WHERE k = 1
UNION ALL SELECT f.portfolio, f.ticker, n.k, CASE WHEN n.shares > 0 THEN held + n.shares ELSE held - least(-n.shares, held) END,
 CASE WHEN n.shares > 0 THEN (cost * held + n.price * n.shares) / (held + n.shares) WHEN held - least(-n.shares, held) > 0 THEN cost ELSE 0 END,
 gain + CASE WHEN n.shares > 0 THEN 0 ELSE (n.price - cost) * least(-n.shares, held) END, unfilled + CASE WHEN n.shares > 0 THEN 0 ELSE -n.shares - least(-n.shares, held) END
 FROM f JOIN n ON n.portfolio = f.portfolio AND n.ticker = f.ticker AND n.k = f.k + 1)
SELECT portfolio, ticker, round(arg_max(held, k), 4) AS shares, round(arg_max(cost, k), 4) AS avg_cost, round(arg_max(gain, k), 4) AS realised, round(arg_max(unfilled, k), 4) AS unfilled FROM f GROUP BY 1, 2""", base=False)
def b11_positions(spark: Spark, d: str) -> DataFrame:
    return rnd(pf.positions(trades(spark, d)), "shares", "avg_cost", "realised", "unfilled", digits=4)


HELD = TRADES + ", h AS (SELECT portfolio, ticker, sum(shares) AS shares, sum(shares * price) / sum(shares) AS avg_cost FROM tr WHERE shares > 0 GROUP BY 1, 2), px AS (SELECT p_brand AS ticker, avg(p_retailprice) AS close FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1)"


def held(spark: Spark, d: str) -> DataFrame:
    buys = trades(spark, d).where("shares > 0").groupBy("portfolio", "ticker").agg(F.sum("shares").alias("shares"), (F.sum(F.col("shares") * F.col("price")) / F.sum("shares")).alias("avg_cost")).withColumn("cash", F.lit(10_000.0))
    px = b.table(spark, d, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("ticker")).agg(F.avg("p_retailprice").alias("close"))
    return pf.marked(buys, px)


@query("p8_position_values", f"WITH {HELD}, m AS (SELECT portfolio, ticker, shares * avg_cost AS cb, shares * coalesce(close, avg_cost) AS mv FROM h LEFT JOIN px USING (ticker)) SELECT portfolio, ticker, round(cb, 3) AS cost_basis, round(mv, 3) AS market_value, round(mv - cb, 3) AS pnl, round((mv - cb) / cb * 100, 5) AS pnl_pct FROM m", base=False)
def p8_position_values(spark: Spark, d: str) -> DataFrame:
    return rnd(rnd(held(spark, d).select("portfolio", "ticker", "cost_basis", "market_value", "pnl", "pnl_pct"), "cost_basis", "market_value", "pnl", digits=3), "pnl_pct", digits=5)


@query("a40_portfolio_weights", f"WITH {HELD}, m AS (SELECT portfolio, ticker, shares * coalesce(close, avg_cost) AS mv FROM h LEFT JOIN px USING (ticker)) SELECT portfolio, ticker, round(mv / (sum(mv) OVER (PARTITION BY portfolio) + 10000), 8) AS weight FROM m", base=False)
def a40_portfolio_weights(spark: Spark, d: str) -> DataFrame:
    return rnd(held(spark, d).select("portfolio", "ticker", "weight"), "weight", digits=8)


@query("t6_weights_report", f"WITH {HELD}, m AS (SELECT portfolio, ticker, shares * coalesce(close, avg_cost) AS mv FROM h LEFT JOIN px USING (ticker)), w AS (SELECT *, mv / (sum(mv) OVER (PARTITION BY portfolio) + 10000) AS weight FROM m) SELECT portfolio, count(*) AS n, round(max(weight), 8) AS largest FROM w WHERE weight > 0.001 GROUP BY 1", base=False)
def t6_weights_report(spark: Spark, d: str) -> DataFrame:
    return rnd(held(spark, d).where("weight > 0.001").groupBy("portfolio").agg(F.count("*").alias("n"), F.max("weight").alias("largest")), "largest", digits=8)


@query("b10_rebalancing_trades", f"""WITH {HELD}, v AS (SELECT portfolio, sum(shares * coalesce(close, avg_cost)) + 10000 AS total FROM h LEFT JOIN px USING (ticker) GROUP BY 1),
t AS (SELECT v.portfolio, px.ticker, px.close, total, CASE WHEN px.ticker LIKE '%5' THEN 0.08 ELSE 0.03 END AS w FROM v, px),
m AS (SELECT t.*, coalesce(h.shares, 0) AS has, w * total - coalesce(h.shares, 0) * t.close AS want FROM t LEFT JOIN h ON h.portfolio = t.portfolio AND h.ticker = t.ticker)
SELECT portfolio, ticker, round(CASE WHEN abs(want) <= 1 THEN 0 WHEN want < 0 THEN -least(has, -want / close) ELSE want / close END, 5) AS shares FROM m""", base=False)
def b10_rebalancing_trades(spark: Spark, d: str) -> DataFrame:
    """All books toward the same weights, held or not; Brand#11 has no price: it counts at cost, and is not traded."""
    h = held(spark, d)
    px = b.table(spark, d, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("ticker")).agg(F.avg("p_retailprice").alias("close"))
    wanted = b.table(spark, d, "part").groupBy().agg(F.collect_set("p_brand").alias("t"))  # the tickers, one row
    targets = h.select("portfolio").distinct().join(wanted).select("portfolio", F.explode("t").alias("ticker"))
    targets = targets.withColumn("w", F.when(F.col("ticker").endswith("5"), 0.08).otherwise(0.03))
    return rnd(pf.rebalancing_trades(h, targets, px), "shares", digits=5)


REPORT = BACKTEST[: BACKTEST.index("SELECT portfolio, date, CASE WHEN v0 * g")].replace("0.19 AS w FROM part)", "p_brand AS t FROM part), bk2 AS (SELECT ticker, portfolio, 1.0::DOUBLE / count(*) OVER (PARTITION BY portfolio) AS w FROM bk)").replace("JOIN bk USING", "JOIN bk2 USING").replace("wh AS (SELECT b0.portfolio, b0.s, 1 + sum(0.19 * (al2.close / p0 - 1)) AS whole FROM b0", "wh AS (SELECT b0.portfolio, b0.s, 1 + sum(bk2.w * (al2.close / p0 - 1)) AS whole FROM b0 JOIN bk2 USING (portfolio, ticker)") + """, val AS (SELECT portfolio, date, v0 * g AS value FROM gr JOIN v USING (portfolio, s)),
st AS (SELECT b0.portfolio, ticker, b0.s, p0, v0, e FROM b0 JOIN v USING (portfolio, s) JOIN sp USING (s)),
td AS (SELECT n.portfolio, count(*) AS total_trades FROM st n JOIN bk2 USING (portfolio, ticker) LEFT JOIN st o ON o.portfolio = n.portfolio AND o.ticker = n.ticker AND o.e = n.s WHERE abs(w * n.v0 - coalesce(w * o.v0 / o.p0 * n.p0, 0)) > 1 GROUP BY 1),
rt AS (SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM val WINDOW w AS (PARTITION BY portfolio ORDER BY date)),
mk AS (SELECT date, close FROM bars WHERE ticker = 'Brand#11'),
ag AS (SELECT portfolio, count(*) AS days, arg_max(value, rt.date) AS final_value, stddev_samp(ret) * sqrt(252) * 100 AS volatility, min((value - peak) / peak) * 100 AS max_drawdown, (arg_max(close, rt.date) FILTER (close IS NOT NULL) / arg_min(close, rt.date) FILTER (close IS NOT NULL) - 1) * 100 AS benchmark_return FROM rt LEFT JOIN mk ON mk.date = rt.date GROUP BY 1),
an AS (SELECT *, (final_value / 100000 - 1) * 100 AS total_return, (pow(final_value / 100000, 252.0 / days) - 1) * 100 AS annualized_return FROM ag)
SELECT portfolio, days, total_trades, {0} AS final_value, {1} AS total_return, round(annualized_return, 4) AS annualized_return, round(volatility, 4) AS volatility, round(max_drawdown, 4) AS max_drawdown, round(benchmark_return, 4) AS benchmark_return,
{2} AS excess_return, round((annualized_return - 2) / volatility, 5) AS sharpe_ratio, round(annualized_return / abs(max_drawdown), 5) AS calmar_ratio FROM an JOIN td USING (portfolio)""".format(*map(significant_sql, ("final_value", "total_return", "(total_return - benchmark_return)")))


@query("a41_backtest_report", REPORT)
def a41_backtest_report(spark: Spark, d: str) -> DataFrame:
    """The whole bundle of the families' backtest, in equal weights, against the benchmark."""
    prices = b.bars(spark, d).where("date >= '1995-03-01'")
    w = pf.equal_weights(members(spark, d)).select("portfolio", "ticker", "w")
    days = ind.first_of_period(prices.select("date").distinct().where("date >= '1995-07-01'"), "quarter")
    values = pf.backtest(prices, w, days, start="1995-07-01")
    trades_ = pf.backtest_trades(prices, w, days, values, start="1995-07-01")
    out = pf.backtest_report(values, 100_000.0, trades_, prices.where("ticker = 'Brand#11'"))
    out = out.withColumns({c: significant(c) for c in ("final_value", "total_return", "excess_return")})
    return rnd(rnd(out, "annualized_return", "volatility", "max_drawdown", "benchmark_return", digits=4), "sharpe_ratio", "calmar_ratio", digits=5)


DEALS = REPORT[: REPORT.index("td AS (SELECT n.portfolio")] + """ds AS (SELECT n.portfolio, n.s AS date, n.ticker, n.p0 AS close, w * n.v0 - coalesce(w * o.v0 / o.p0 * n.p0, 0) AS amount FROM st n JOIN bk2 USING (portfolio, ticker) LEFT JOIN st o ON o.portfolio = n.portfolio AND o.ticker = n.ticker AND o.e = n.s),
dl AS (SELECT *, amount > 0 AS buy, abs(amount) / close AS shares, close * CASE WHEN amount > 0 THEN 1.001 ELSE 0.999 END AS price FROM ds WHERE abs(amount) > 1)
SELECT portfolio, date, ticker, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS action, {0} AS shares, round(price, 6) AS price, 2.5::DOUBLE AS commission, {1} AS cash FROM dl""".format(*map(significant_sql, ("shares", "(CASE WHEN buy THEN -1 ELSE 1 END * shares * price - 2.5)")))


@query("b9_transactions", DEALS)
def b9_transactions(spark: Spark, d: str) -> DataFrame:
    """Every trade of the families' backtest in equal weights, with a commission and a tenth of a percent of slippage."""
    prices = b.bars(spark, d).where("date >= '1995-03-01'")
    w = pf.equal_weights(members(spark, d)).select("portfolio", "ticker", "w")
    days = ind.first_of_period(prices.select("date").distinct().where("date >= '1995-07-01'"), "quarter")
    values = pf.backtest(prices, w, days, start="1995-07-01")
    out = pf.transactions(pf.backtest_trades(prices, w, days, values, start="1995-07-01"), prices, days, 2.5, 0.001)
    return rnd(out.withColumns({c: significant(c) for c in ("shares", "cash")}), "price")


@query("p10_validation", """SELECT p_brand AS ticker, regexp_matches(p_brand, '^[A-Z]{1,8}$') AS plain, regexp_matches(upper(replace(p_brand, '#', '-')), '^[A-Z0-9.-]+$') AND length(p_brand) <= 10 AS extended, count(*) AS n FROM part GROUP BY 1""", base=False)
def p10_validation(spark: Spark, d: str) -> DataFrame:
    t = F.col("p_brand")
    shown = F.upper(F.replace(t, F.lit("#"), F.lit("-"))).rlike("^[A-Z0-9.-]+$") & (F.length(t) <= 10)
    return b.table(spark, d, "part").groupBy(t.alias("ticker")).agg(F.first(t.rlike("^[A-Z]{1,8}$")).alias("plain"), F.first(shown).alias("extended"), F.count("*").alias("n"))
