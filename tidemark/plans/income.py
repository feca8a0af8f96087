"""Queries on dividends and total return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import income as inc
from tidemark.operators.quantiles import quantile
from tidemark.plans.market import rnd
from tidemark.sources import bars as b

Spark = SparkSession
END = "2001-10-31"


def _both(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    return b.bars(spark, d), b.dividends(spark, d)


def shifted(div: DataFrame) -> DataFrame:
    """Dividends some days after a bar, so that the as-of rule matters."""
    return div.withColumn("ex_date", F.expr("date_add(ex_date, cast(day(ex_date) % 5 as int))"))


SHIFT = "v AS (SELECT ticker, CAST(ex_date + CAST(day(ex_date) % 5 AS INTEGER) AS DATE) AS ex_date, amount FROM dividends)"


@query("j1_prices_with_dividends", "SELECT ticker, date, close, coalesce(amount, 0) AS dividend FROM bars LEFT JOIN dividends ON bars.ticker = dividends.ticker AND date = ex_date".replace("SELECT ticker", "SELECT bars.ticker"))
def j1_prices_with_dividends(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    return p.join(v.withColumnRenamed("ex_date", "date"), ["ticker", "date"], "left").select("ticker", "date", "close", F.coalesce("amount", F.lit(0.0)).alias("dividend"))


@query("j2_tickers_with_ranges", "WITH r AS (SELECT ticker, count(*) AS ranges, min(start_date) AS first_start FROM intervals GROUP BY 1) SELECT t.ticker, coalesce(ranges, 0) AS ranges, first_start FROM (SELECT DISTINCT p_brand AS ticker FROM part) t LEFT JOIN r USING (ticker)")
def j2_tickers_with_ranges(spark: Spark, d: str) -> DataFrame:
    r = b.cached_intervals(spark, d).groupBy("ticker").agg(F.count("*").alias("ranges"), F.min("start_date").alias("first_start"))
    t = b.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return t.join(r, "ticker", "left").select("ticker", F.coalesce("ranges", F.lit(0)).cast("long").alias("ranges"), "first_start")


@query("j7_asof_nearest", f"""WITH {SHIFT}, c AS (SELECT v.ticker, v.ex_date, v.amount, p.date, p.close, row_number() OVER (PARTITION BY v.ticker, v.ex_date ORDER BY abs(p.date - v.ex_date), p.date DESC) AS rn FROM v JOIN bars p USING (ticker))
SELECT ticker, ex_date, amount, date AS px_date, close AS px FROM c WHERE rn = 1""")
def j7_asof_nearest(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    return inc.asof(shifted(v), p, "nearest")


@query("j8_asof_forward", f"""WITH {SHIFT} SELECT v.ticker, v.ex_date, amount, coalesce(min(date) FILTER (date >= v.ex_date), max(date)) AS px_date, coalesce(arg_min(close, date) FILTER (date >= v.ex_date), arg_max(close, date)) AS px FROM v JOIN bars USING (ticker) GROUP BY 1, 2, 3""")
def j8_asof_forward(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    return inc.asof(shifted(v), p, "forward")


TOTAL = """e AS (SELECT ticker, min(date) d0, max(date) d1, arg_min(close, date) p0, arg_max(close, date) p1 FROM bars GROUP BY 1)"""
TAIL = "round(tr, 6) AS total_return, round(p1 / p0 - 1, 6) AS price_return, round(tr - (p1 / p0 - 1), 6) AS income_return, round(CASE WHEN tr > -1 THEN pow(1 + tr, 365.25 / (d1 - d0)) - 1 END, 6) AS annualized"


@query("d1_total_return", f"WITH {TOTAL}, s AS (SELECT ticker, sum(amount) x FROM dividends GROUP BY 1), t AS (SELECT *, (p1 - p0 + coalesce(x, 0)) / p0 AS tr FROM e LEFT JOIN s USING (ticker)) SELECT ticker, {TAIL} FROM t")
def d1_total_return(spark: Spark, d: str) -> DataFrame:
    return rnd(inc.total_return(*_both(spark, d)), "total_return", "price_return", "income_return", "annualized")


REINVEST = f"{TOTAL}, s AS (SELECT ticker, exp(sum(ln(1 + amount / close))) x FROM dividends JOIN bars USING (ticker) WHERE date = ex_date GROUP BY 1), t AS (SELECT *, coalesce(x, 1) * p1 / p0 - 1 AS tr FROM e LEFT JOIN s USING (ticker))"


@query("d2_reinvested_return", f"WITH {REINVEST} SELECT ticker, {TAIL} FROM t")
def d2_reinvested_return(spark: Spark, d: str) -> DataFrame:
    return rnd(inc.total_return(*_both(spark, d), reinvest=True), "total_return", "price_return", "income_return", "annualized")


@query("d6_reinvestment_benefit", f"WITH {REINVEST}, s1 AS (SELECT ticker, sum(amount) x1 FROM dividends GROUP BY 1) SELECT ticker, round(tr - (p1 - p0 + coalesce(x1, 0)) / p0, 6) AS benefit FROM t LEFT JOIN s1 USING (ticker)")
def d6_reinvestment_benefit(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    one, two = inc.total_return(p, v).select("ticker", F.col("total_return").alias("a")), inc.total_return(p, v, True).select("ticker", F.col("total_return").alias("b"))
    return rnd(one.join(two, "ticker").select("ticker", (F.col("b") - F.col("a")).alias("benefit")), "benefit")


@query("d3_year_over_year", f"""WITH y AS (SELECT CAST(k + 1 AS INTEGER) AS year, DATE '{END}' - CAST(365 * (k + 1) AS INTEGER) AS a, DATE '{END}' - CAST(365 * k AS INTEGER) AS z FROM range(5) t(k)),
p AS (SELECT ticker, year, count(*) AS n, arg_min(close, date) p0, arg_max(close, date) p1 FROM bars JOIN y ON date BETWEEN a AND z GROUP BY 1, 2), s AS (SELECT ticker, year, sum(amount) s FROM dividends JOIN y ON ex_date BETWEEN a AND z GROUP BY 1, 2)
SELECT ticker, year, n, round((p1 - p0 + coalesce(s, 0)) / p0, 6) AS total_return FROM p LEFT JOIN s USING (ticker, year) WHERE n >= 2""")
def d3_year_over_year(spark: Spark, d: str) -> DataFrame:
    return rnd(inc.year_over_year(*_both(spark, d), END), "total_return")


METRICS = f"""WITH g AS (SELECT *, ex_date - lag(ex_date) OVER (PARTITION BY ticker ORDER BY ex_date) AS gap FROM dividends),
m AS (SELECT ticker, count(*) AS payments, sum(amount) AS total, sum(amount) FILTER (ex_date > DATE '{END}' - 365) AS ttm, avg(gap) AS gap FROM g GROUP BY 1), y AS (SELECT ticker, year(ex_date) AS y, sum(amount) s FROM dividends GROUP BY 1, 2),
gr AS (SELECT ticker, pow(arg_max(s, y) / arg_min(s, y), 1.0 / (max(y) - min(y))) - 1 AS growth FROM y GROUP BY 1), l AS (SELECT ticker, arg_max(close, date) AS px FROM bars GROUP BY 1),
x AS (SELECT ticker, payments, total, ttm, ttm / px AS yield, growth, CASE WHEN gap <= 35 THEN 'Monthly' WHEN gap <= 100 THEN 'Quarterly' WHEN gap <= 200 THEN 'Semi-Annual' ELSE 'Annual' END AS frequency FROM m JOIN gr USING (ticker) JOIN l USING (ticker))"""


@query("d4_dividend_metrics", METRICS + " SELECT ticker, payments, frequency, round(total, 5) AS total, round(ttm, 5) AS ttm, round(yield, 6) AS yield, round(growth, 6) AS growth FROM x")
def d4_dividend_metrics(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    return rnd(rnd(inc.dividend_metrics(v, p, END), "total", "ttm", digits=5), "yield", "growth")


@query("d5_dividend_calendar", METRICS + ", z AS (SELECT ticker, max(ex_date) AS z, arg_max(amount, ex_date) AS amount FROM dividends GROUP BY 1), n AS (SELECT ticker, CAST(z + CASE frequency WHEN 'Monthly' THEN INTERVAL 1 MONTH WHEN 'Quarterly' THEN INTERVAL 3 MONTH WHEN 'Semi-Annual' THEN INTERVAL 6 MONTH ELSE INTERVAL 12 MONTH END AS DATE) AS next_date, amount FROM z JOIN x USING (ticker)) SELECT * FROM n WHERE next_date <= DATE '2002-03-31'")
def d5_dividend_calendar(spark: Spark, d: str) -> DataFrame:
    p, v = _both(spark, d)
    return inc.next_payments(v, inc.dividend_metrics(v, p, END), "2002-03-31")


@query("a26_dividend_summary", "SELECT ticker, count(*) AS payments, round(sum(amount), 5) AS total, min(ex_date) AS first_date, max(ex_date) AS last_date, round(count(*) * 365.0 / nullif(max(ex_date) - min(ex_date), 0), 1) AS per_year FROM dividends GROUP BY 1")
def a26_dividend_summary(spark: Spark, d: str) -> DataFrame:
    span = F.nullif(F.datediff(F.max("ex_date"), F.min("ex_date")), F.lit(0))
    out = b.dividends(spark, d).groupBy("ticker").agg(F.count("*").alias("payments"), F.sum("amount").alias("total"), F.min("ex_date").alias("first_date"), F.max("ex_date").alias("last_date"), F.round(F.count("*") * 365.0 / span, 1).alias("per_year"))
    return rnd(out, "total", digits=5)


@query("a29_yearly_dividends", "SELECT ticker, CAST(year(ex_date) AS INTEGER) AS year, count(*) AS n, round(sum(amount), 5) AS total FROM dividends GROUP BY 1, 2")
def a29_yearly_dividends(spark: Spark, d: str) -> DataFrame:
    return rnd(b.dividends(spark, d).groupBy("ticker", F.year("ex_date").alias("year")).agg(F.count("*").alias("n"), F.sum("amount").alias("total")), "total", digits=5)


@query("d7_income_total", "SELECT count(*) AS n, round(sum(amount), 4) AS total FROM dividends WHERE ticker IN ('Brand#11', 'Brand#12') AND ex_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def d7_income_total(spark: Spark, d: str) -> DataFrame:
    v = b.dividends(spark, d).where("ticker in ('Brand#11', 'Brand#12') and ex_date between date'1996-01-01' and date'2000-12-31'")
    return v.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"))


@query("a33_macro_stats", "SELECT o_orderpriority AS series, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1", base=False)
def a33_macro_stats(spark: Spark, d: str) -> DataFrame:
    c = "o_totalprice"
    rows = b.table(spark, d, "orders")
    out = rows.groupBy(F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))
    out = out.join(quantile(rows, "o_orderpriority", c, 0.5, "median"), F.expr("series <=> o_orderpriority"), "left").drop("o_orderpriority")
    return rnd(out, "mean", "median", "std", digits=4)
