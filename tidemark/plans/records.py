"""Queries on stored records beside prices: inflation, rates, dimensions, run histories, comparisons, strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import indicators as ind
from tidemark.operators import portfolio as pf
from tidemark.operators import records as rec
from tidemark.operators import risk
from tidemark.plans.allocation import members
from tidemark.plans.market import rnd
from tidemark.sources import bars as b
from tidemark.sources import formats, tables

Spark = SparkSession

INFLATION = "infl AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'survey' ELSE 'index' END AS source, min(o_totalprice) / 1e6 AS rate FROM orders GROUP BY 1, 2)"


def inflation(spark: Spark, d: str) -> DataFrame:
    """date, source, rate: two monthly series."""
    o = b.table(spark, d, "orders")
    return o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), F.when(F.col("o_orderkey") % 3 == 0, "survey").otherwise("index").alias("source")).agg((F.min("o_totalprice") / 1e6).alias("rate"))


@query("s18_inflation_range", f"WITH {INFLATION} SELECT date, source, rate FROM infl WHERE source = 'index' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", base=False)
def s18_inflation_range(spark: Spark, d: str) -> DataFrame:
    return rec.series_range(inflation(spark, d), "index", "1996-01-01", "1998-12-31")


@query("a25_inflation_coverage", f"WITH {INFLATION} SELECT source, count(*) AS records, min(date) AS first_date, max(date) AS last_date, round(avg(rate), 8) AS mean_rate, min(rate) AS low, max(rate) AS high FROM infl GROUP BY 1", base=False)
def a25_inflation_coverage(spark: Spark, d: str) -> DataFrame:
    return rnd(rec.series_coverage(inflation(spark, d)), "mean_rate", digits=8)


@query("a25_dividend_coverage", "SELECT ticker, count(*) AS records, min(ex_date) AS first_date, max(ex_date) AS last_date, round(sum(amount), 5) AS total, round(avg(amount), 6) AS mean FROM dividends GROUP BY 1")
def a25_dividend_coverage(spark: Spark, d: str) -> DataFrame:
    out = b.dividends(spark, d).groupBy("ticker").agg(F.count("*").alias("records"), F.min("ex_date").alias("first_date"), F.max("ex_date").alias("last_date"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"))
    return rnd(rnd(out, "total", digits=5), "mean")


@query("s12_upsert_dividends", """WITH n AS (SELECT ticker, ex_date, amount * 2 AS amount FROM dividends WHERE year(ex_date) >= 2000 UNION ALL SELECT ticker, CAST(ex_date + 400 AS DATE), amount FROM dividends WHERE year(ex_date) >= 2001)
SELECT ticker, ex_date, amount FROM n UNION ALL SELECT ticker, ex_date, amount FROM dividends ANTI JOIN n USING (ticker, ex_date)""")
def s12_upsert_dividends(spark: Spark, d: str) -> DataFrame:
    old = b.dividends(spark, d).withColumn("ingested", F.lit(1))
    new = old.where("year(ex_date) >= 2000").withColumns({"amount": F.col("amount") * 2, "ingested": F.lit(2)})
    more = old.where("year(ex_date) >= 2001").withColumns({"ex_date": F.date_add("ex_date", 400), "ingested": F.lit(2)})
    return tables.upsert(old, new.unionByName(more), ["ticker", "ex_date"]).drop("ingested")


@query("s12_upsert_inflation", f"WITH {INFLATION} SELECT date, source, CASE WHEN source = 'survey' AND year(date) >= 1997 THEN rate + 1 ELSE rate END AS rate FROM infl", base=False)
def s12_upsert_inflation(spark: Spark, d: str) -> DataFrame:
    old = inflation(spark, d).withColumn("ingested", F.lit(1))
    new = old.where("source = 'survey' and year(date) >= 1997").withColumns({"rate": F.col("rate") + 1, "ingested": F.lit(2)})
    return tables.upsert(old, new, ["date", "source"]).drop("ingested")


@query("s8_dividend_payload", "SELECT ticker, ex_date, amount, 'regular' AS dividend_type, 'USD' AS currency, CAST(1 AS INTEGER) AS frequency, 'series' AS source FROM dividends WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def s8_dividend_payload(spark: Spark, d: str) -> DataFrame:
    entries = F.collect_list(F.struct(F.col("ex_date").cast("string"), "amount"))
    body = b.dividends(spark, d).groupBy("ticker").agg(F.to_json(F.map_from_entries(entries)).alias("body"))
    return formats.dividend_series(body, "1996-01-01", "1999-12-31", "series")


@query("s6_short_records", "SELECT ticker, date, open, high, low, close, volume FROM bars")
def s6_short_records(spark: Spark, d: str) -> DataFrame:
    row = F.struct((F.unix_seconds(F.col("date").cast("timestamp")) * 1000).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").cast("double").alias("v"))
    body = b.bars(spark, d).groupBy("ticker").agg(F.to_json(F.struct(F.collect_list(row).alias("results"))).alias("body"))
    return formats.aggregates(body)


@query("s10_corporate_actions", """WITH s AS (SELECT p_brand AS ticker, DATE '2000-01-03' + CAST(p_partkey % 1000 AS INTEGER) AS date, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 ELSE 2.0 / (p_size + 1) END AS ratio FROM part WHERE p_size > 2),
a AS (SELECT ticker, date, CASE WHEN ratio < 1 THEN 'reverse_split' ELSE 'split' END AS action, CASE WHEN ratio < 1 THEN 1 / ratio ELSE 1 END AS ratio_from, CASE WHEN ratio < 1 THEN 1 ELSE ratio END AS ratio_to FROM s)
SELECT ticker, CAST(date AS DATE) AS date, action, round(ratio_from, 6) AS ratio_from, round(ratio_to, 6) AS ratio_to, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC, ratio_from, ratio_to) AS INTEGER) AS recency FROM a""", base=False)
def s10_corporate_actions(spark: Spark, d: str) -> DataFrame:
    size = F.col("p_size")
    events = b.table(spark, d, "part").where("p_size > 2").select(F.col("p_brand").alias("ticker"), F.date_add(F.lit("2000-01-03").cast("date"), (F.col("p_partkey") % 1000).cast("int")).alias("date"), F.when(size % 2 == 0, size / 2).otherwise(2 / (size + 1)).alias("ratio"))
    return rnd(formats.corporate_actions(events).drop("description"), "ratio_from", "ratio_to")


OBSERVED = "ob AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, CASE WHEN day(o_orderdate) % 5 <> 0 THEN min(o_totalprice) / 1e6 END AS rate FROM orders GROUP BY 1, 2, day(o_orderdate))"


def observed(spark: Spark, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg((F.min("o_totalprice") / 1e6).alias("rate"))
    return o.withColumn("rate", F.when(F.day("date") % 5 != 0, F.col("rate")))


@query("m17_risk_free_rate", f"""WITH {OBSERVED}, l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS rn FROM ob), v AS (SELECT series, arg_max(rate, date) AS rate, max(date) AS as_of FROM l WHERE rn <= 10 AND rate IS NOT NULL GROUP BY 1)
SELECT series, coalesce(rate, 0.02) AS rate, as_of, rate IS NULL AS is_fallback FROM (SELECT DISTINCT series FROM ob UNION ALL SELECT 'none') LEFT JOIN v USING (series)""", base=False)
def m17_risk_free_rate(spark: Spark, d: str) -> DataFrame:
    seen = observed(spark, d)
    asked = seen.select("series").distinct().unionByName(spark.createDataFrame([("none",)], "series string"))
    return rec.latest_rate(seen, asked)


@query("a1_excess_by_rate", f"""WITH {OBSERVED}, v AS (SELECT arg_max(rate, date) AS rf FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM ob WHERE series = '1-URGENT') WHERE rn <= 10 AND rate IS NOT NULL)
SELECT ticker, count(*) AS n, round((avg(ret) - coalesce(any_value(rf), 0.02) / 252) / stddev_samp(ret) * sqrt(252), 6) AS sharpe FROM returns, v GROUP BY 1""")
def a1_excess_by_rate(spark: Spark, d: str) -> DataFrame:
    """Sharpe ratios over the latest observed rate of one series in place of a constant."""
    rate = rec.latest_rate(observed(spark, d).where("series = '1-URGENT'"), spark.createDataFrame([("1-URGENT",)], "series string")).select(F.col("rate").alias("rf"))
    r = b.returns(spark, d).join(F.broadcast(rate)).groupBy("ticker").agg(F.count("*").alias("n"), (F.try_divide(F.avg("ret") - F.max("rf") / 252, F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return rnd(r, "sharpe")


@query("m1_history_rule", """SELECT ticker, count(*) AS records, min(date) AS first_date, max(date) AS last_date, round((max(date) - min(date)) / 365.25, 4) AS years,
 (max(date) - min(date)) / 365.25 >= 5 AND (max(date) - greatest(min(date), DATE '2001-12-31' - 1825)) / 365.25 >= 4 AND max(date) >= DATE '2001-12-31' - 7 AND count(*) >= 5 * 252 * 0.8 AS sufficient, min(date) > DATE '2001-12-31' - 1825 + 365 AS starts_late, (max(date) - min(date)) / 365.25 < 15 AS limited FROM bars GROUP BY 1""")
def m1_history_rule(spark: Spark, d: str) -> DataFrame:
    return rnd(rec.history_rule(b.bars(spark, d), "2001-12-31", 5), "years", digits=4)


SPANS = """WITH e AS (SELECT ticker, min(date) AS f, (max(date) - min(date)) / 365.25 >= 3 AND (max(date) - greatest(min(date), DATE '2001-10-31' - 1095)) / 365.25 >= 2.4 AND max(date) >= DATE '2001-10-31' - 7 AND count(*) >= 3 * 252 * 0.8 AS ok FROM bars GROUP BY 1),
b AS (SELECT DISTINCT left(p_brand, 7) AS portfolio, p_brand AS ticker FROM part), g AS (SELECT portfolio, CASE WHEN bool_and(coalesce(ok, false)) THEN 5 ELSE 10 END AS years, count(*) AS tickers, count(*) FILTER (ok) AS sufficient, count(f) AS with_rows FROM b LEFT JOIN e USING (ticker) GROUP BY 1),
s AS (SELECT *, DATE '2001-10-31' - years * 365 AS start_date FROM g)"""


@query("m1_history_span", SPANS + " SELECT s.portfolio, years, tickers, sufficient, with_rows, start_date, (SELECT count(*) FROM b JOIN e USING (ticker) WHERE b.portfolio = s.portfolio AND f > s.start_date + 365) AS late FROM s")
def m1_history_span(spark: Spark, d: str) -> DataFrame:
    """Five years for the families whose tickers all have three good ones, ten for the others."""
    return rec.history_span(b.bars(spark, d), members(spark, d), "2001-10-31", 3, 5, 10)


@query("m1_history_rows", SPANS + " SELECT portfolio, ticker, count(*) AS n, min(date) AS first_date FROM bars JOIN b USING (ticker) JOIN s USING (portfolio) WHERE date >= start_date AND date <= DATE '2001-10-31' GROUP BY 1, 2")
def m1_history_rows(spark: Spark, d: str) -> DataFrame:
    px, m = b.bars(spark, d), members(spark, d)
    rows = rec.history_rows(px, m, rec.history_span(px, m, "2001-10-31", 3, 5, 10), "2001-10-31")
    return rows.groupBy("portfolio", "ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


@query("m21_return_matrix", """WITH m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1, 2), r AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM m) WHERE ret IS NOT NULL),
k AS (SELECT ticker FROM r GROUP BY 1 HAVING count(*) >= 20), f AS (SELECT r.* FROM r SEMI JOIN k USING (ticker)), c AS (SELECT date FROM f GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM k)) SELECT ticker, date, round(ret, 8) AS ret FROM f SEMI JOIN c USING (date)""")
def m21_return_matrix(spark: Spark, d: str) -> DataFrame:
    """Monthly returns of the tickers with 20 at least, on the months that all of those share."""
    return rnd(risk.return_matrix(b.simple_returns(monthly(spark, d)), 20).select("ticker", "date", "ret"), "ret", digits=8)


def monthly(spark: Spark, d: str) -> DataFrame:
    return b.bars(spark, d).groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("date")).agg(F.max_by("close", "date").alias("close"))


MONTHS = """m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1, 2), mr AS (SELECT * FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM m) WHERE ret IS NOT NULL),
k AS (SELECT date FROM mr GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM mr))"""


@query("j6_complete_months", f"WITH {MONTHS} SELECT ticker, count(*) AS n, round(avg(ret), 6) AS mean FROM mr SEMI JOIN k USING (date) GROUP BY 1")
def j6_complete_months(spark: Spark, d: str) -> DataFrame:
    """Complete cases of monthly returns, of which every table has some."""
    return rnd(risk.complete_cases(b.simple_returns(monthly(spark, d))).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("ret").alias("mean")), "mean")


@query("a12_spearman_months", f"""WITH {MONTHS}, r AS (SELECT ticker, date, rank() OVER (PARTITION BY ticker ORDER BY ret) + (count(*) OVER (PARTITION BY ticker, ret) - 1) / 2.0 AS rk FROM mr SEMI JOIN k USING (date))
SELECT x.ticker AS a, y.ticker AS b, round(corr(x.rk, y.rk), 6) AS spearman FROM r x JOIN r y ON x.date = y.date AND x.ticker < y.ticker GROUP BY 1, 2""")
def a12_spearman_months(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.rank_correlation(b.simple_returns(monthly(spark, d))), "spearman")


TAILS = "n AS (SELECT ticker, date, ret, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM returns), l AS (SELECT min(c) AS len FROM (SELECT count(*) AS c FROM returns GROUP BY ticker))"


@query("j9_aligned_by_position", f"WITH {TAILS} SELECT ticker, CAST(len - k AS BIGINT) AS place, date, round(ret, 8) AS ret FROM n, l WHERE k <= len")
def j9_aligned_by_position(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.aligned_tails(b.returns(spark, d), "position").select("ticker", "place", "date", "ret"), "ret", digits=8)


@query("j9_aligned_by_date", f"WITH {MONTHS} SELECT ticker, date, round(ret, 8) AS ret FROM mr SEMI JOIN k USING (date)")
def j9_aligned_by_date(spark: Spark, d: str) -> DataFrame:
    return rnd(risk.aligned_tails(b.simple_returns(monthly(spark, d)), "date").select("ticker", "date", "ret"), "ret", digits=8)


@query("p16_real_values", "SELECT ticker, date, round(close / pow(1.03, (row_number() OVER (PARTITION BY ticker ORDER BY date) - 1) / 252.0), 4) AS real_close FROM bars")
def p16_real_values(spark: Spark, d: str) -> DataFrame:
    return rnd(rec.real_values(b.bars(spark, d), "close", 0.03).select("ticker", "date", F.col("real").alias("real_close")), "real_close", digits=4)


@query("s20_dimensions", "SELECT split_part(p_type, ' ', 1) AS sector, list_sort(list(DISTINCT p_brand))[1:5] AS tickers, count(DISTINCT p_brand) AS n FROM part GROUP BY 1", base=False)
def s20_dimensions(spark: Spark, d: str) -> DataFrame:
    """Sectors with their tickers (the first five by name are shown), as the dimension table they make."""
    x = b.table(spark, d, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sector"), F.col("p_brand").alias("ticker"))
    return rec.dimension(x, "sector", "ticker", 5).withColumnRenamed("members", "tickers")


@query("s20_sector_funds", "SELECT sector, list_sort(list(DISTINCT fund)) AS funds FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, ts in rec.SECTOR_FUNDS.items() for t in ts.split()) + ") v(sector, fund) GROUP BY 1", base=False)
def s20_sector_funds(spark: Spark, d: str) -> DataFrame:
    return rec.sector_funds(spark).groupBy("sector").agg(F.sort_array(F.collect_set("fund")).alias("funds"))


@query("j14_named_metrics", "WITH s AS (SELECT ticker, stddev_samp(ret) * sqrt(252) AS annual_volatility, avg(ret) * 252 AS annual_mean_return FROM returns GROUP BY 1) SELECT ticker, 'Annualized Volatility' AS name, round(annual_volatility, 6) AS value FROM s UNION ALL SELECT ticker, 'Annual Mean Return (nominal)', round(annual_mean_return, 6) FROM s")
def j14_named_metrics(spark: Spark, d: str) -> DataFrame:
    s = b.returns(spark, d).groupBy("ticker").agg((F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("annual_volatility"), (F.avg("ret") * 252).alias("annual_mean_return"))
    long = s.unpivot("ticker", ["annual_volatility", "annual_mean_return"], "metric", "value")
    return rnd(rec.named(long).select("ticker", "name", "value"), "value")


@query("a48_compared_methods", """WITH m AS (SELECT ticker, source_priority AS p, 'growth' AS metric, close / open - 1 AS v FROM panel UNION ALL SELECT ticker, source_priority, 'spread', (high - low) / low FROM panel),
a AS (SELECT ticker, metric, median(v) AS one FROM m WHERE p = 1 GROUP BY 1, 2), c AS (SELECT ticker, metric, avg(v) AS two FROM m WHERE p = 2 GROUP BY 1, 2)
SELECT ticker, metric, round(one, 6) AS one, round(two, 6) AS two, round(abs(two - one), 6) AS difference, CASE WHEN CASE WHEN metric = 'growth' THEN two > one ELSE two < one END THEN 'two' ELSE 'one' END AS better FROM a JOIN c USING (ticker, metric)""")
def a48_compared_methods(spark: Spark, d: str) -> DataFrame:
    p = b.source_panel(spark, d).withColumns({"growth": F.col("close") / F.col("open") - 1, "spread": (F.col("high") - F.col("low")) / F.col("low")})
    long = p.unpivot(["ticker", "source_priority"], ["growth", "spread"], "metric", "v")
    return rnd(rec.compared(long.where("source_priority = 1"), long.where("source_priority = 2"), ["growth"]), "one", "two", "difference")


RUNS = "ru AS (SELECT CAST(ts AS DATE) AS run, count(*) AS paths_per_second, avg(value) AS memory_mb, avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) AS convergence, avg(CASE WHEN event_type = 'purchase' THEN 0.0 ELSE 1.0 END) AS accuracy, max(value) AS seconds FROM events GROUP BY 1)"


def runs(spark: Spark, d: str) -> DataFrame:
    """One row a day of events, read as one run of a benchmark."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return b.table(spark, d, "events").groupBy(F.to_date("ts").alias("run")).agg(F.count("*").alias("paths_per_second"), F.avg("value").alias("memory_mb"), share(F.col("value") < 50).alias("convergence"), share(~F.coalesce(F.col("event_type") == "purchase", F.lit(False))).alias("accuracy"), F.max("value").alias("seconds"))


@query("s17_run_history", f"WITH {RUNS} SELECT run, round((paths_per_second - lag(paths_per_second) OVER w) / lag(paths_per_second) OVER w * 100, 6) AS throughput_change, round((memory_mb - lag(memory_mb) OVER w) / lag(memory_mb) OVER w * 100, 6) AS memory_change FROM ru WINDOW w AS (ORDER BY run)", base=False)
def s17_run_history(spark: Spark, d: str) -> DataFrame:
    """A history to the end of 1996, and a later batch that holds half a year of it again: what is known is not added twice."""
    every = runs(spark, d)
    h = rec.append_run(every.where("run < '1997-01-01'"), every.where("run >= '1996-07-01'"))
    return rnd(rec.regressions(h).select("run", "throughput_change", "memory_change"), "throughput_change", "memory_change")


@query("a49_benchmark_scores", f"""WITH {RUNS} SELECT run, round(0.3 * least(1, paths_per_second / 50.0) + 0.3 * accuracy + 0.2 * convergence + 0.2 * greatest(0, 1 - memory_mb / 2000), 6) AS score,
 paths_per_second >= 50 AS fast_enough, memory_mb / 1024 <= 8 AS small_enough, convergence >= 0.95 AS converges, accuracy >= 0.8 AS accurate FROM ru""", base=False)
def a49_benchmark_scores(spark: Spark, d: str) -> DataFrame:
    return rnd(rec.scored(runs(spark, d)).select("run", "score", "fast_enough", "small_enough", "converges", "accurate"), "score")


@query("a49_scaling", f"WITH {RUNS} SELECT year(run) AS year, count(*) AS n, round(regr_slope(seconds, paths_per_second), 6) AS slope FROM ru GROUP BY 1", base=False)
def a49_scaling(spark: Spark, d: str) -> DataFrame:
    return rnd(rec.scaling(runs(spark, d).withColumn("year", F.year("run").cast("long")), "year", "paths_per_second", "seconds"), "slope")


@query("j3_scalar_count", "SELECT t.ticker, (SELECT count(*) FROM intervals i WHERE i.ticker = t.ticker) AS ranges FROM (SELECT DISTINCT p_brand AS ticker FROM part) t")
def j3_scalar_count(spark: Spark, d: str) -> DataFrame:
    t = b.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    return spark.sql("SELECT t.ticker, (SELECT count(*) FROM {i} i WHERE i.ticker = t.ticker) AS ranges FROM {t} t", i=b.cached_intervals(spark, d), t=t)


@query("a27_counts", "SELECT count(DISTINCT ticker) AS tickers, count(*) AS records, count(DISTINCT ex_date) AS days FROM dividends")
def a27_counts(spark: Spark, d: str) -> DataFrame:
    return b.dividends(spark, d).agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("records"), F.count_distinct("ex_date").alias("days"))


@query("t1_ordered", "SELECT ticker, records, CAST(row_number() OVER (ORDER BY records DESC, ticker) AS INTEGER) AS place FROM (SELECT ticker, count(*) AS records FROM bars GROUP BY 1)")
def t1_ordered(spark: Spark, d: str) -> DataFrame:
    """Tickers by number of records, and their place (one row each, so the order is over tickers only)."""
    n = b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("records"))
    return n.withColumn("place", F.row_number().over(risk.Window.orderBy(F.desc("records"), "ticker"))).orderBy("place")


STRATEGIES = """WITH RECURSIVE bk AS (SELECT p_brand AS ticker, left(p_brand, 7) AS portfolio, sum(p_retailprice) AS cap FROM part GROUP BY 1, 2), pr AS (SELECT ticker, date, close FROM bars WHERE date >= DATE '1995-03-01'), days AS (SELECT DISTINCT date FROM pr WHERE date >= DATE '1996-01-01'),
al AS (SELECT ticker, date, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS close FROM (SELECT ticker, date FROM (SELECT DISTINCT date FROM pr), (SELECT DISTINCT ticker FROM pr)) LEFT JOIN pr USING (ticker, date)),
sp AS (SELECT s, lead(s) OVER (ORDER BY s) AS e, row_number() OVER (ORDER BY s) AS no FROM (SELECT min(date) AS s FROM days GROUP BY date_trunc('quarter', date))),
st AS (SELECT ticker, date, sum(ln(1 + ret)) OVER l AS m, stddev_samp(ret) OVER l AS sd, count(*) OVER l AS n FROM (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pr) WHERE ret IS NOT NULL WINDOW l AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)),
mk AS (SELECT ticker, portfolio, cap, s FROM bk, sp), kn AS (SELECT mk.*, m, sd, coalesce(n, 0) AS n FROM mk ASOF LEFT JOIN st ON mk.ticker = st.ticker AND mk.s >= st.date),
ru AS (SELECT *, count(*) OVER p AS k, min(n) OVER p < 60 AS short, row_number() OVER (PARTITION BY portfolio, s ORDER BY m DESC NULLS LAST, ticker) AS rank, sum(1 / sd) OVER p AS siv, sum(cap) OVER p AS scap FROM kn WINDOW p AS (PARTITION BY portfolio, s)),
w AS (SELECT 'equal' AS strategy, portfolio, ticker, s, 1.0::DOUBLE / k AS w FROM ru UNION ALL SELECT 'cap_weighted', portfolio, ticker, s, cap / scap FROM ru UNION ALL SELECT 'momentum', portfolio, ticker, s, CASE WHEN short THEN 1.0 / k WHEN rank <= 3 THEN 1.0::DOUBLE / 3 ELSE 0 END FROM ru
 UNION ALL SELECT 'inverse_volatility', portfolio, ticker, s, CASE WHEN short THEN 1.0 / k ELSE 1 / sd / siv END FROM ru),
b0 AS (SELECT w.*, al.close AS p0, e, no FROM w JOIN sp USING (s) JOIN al ON al.ticker = w.ticker AND al.date = s WHERE al.close IS NOT NULL),
gr AS (SELECT strategy, portfolio, no, al.date, 1 + sum(w * (al.close / p0 - 1)) AS g FROM b0 JOIN al ON al.ticker = b0.ticker AND al.date >= s AND (e IS NULL OR al.date < e) GROUP BY 1, 2, 3, 4),
wh AS (SELECT strategy, portfolio, no, 1 + sum(w * (al.close / p0 - 1)) AS whole FROM b0 JOIN al ON al.ticker = b0.ticker AND al.date = e GROUP BY 1, 2, 3),
v AS (SELECT DISTINCT strategy, portfolio, 1::BIGINT AS no, 100000::DOUBLE AS v0 FROM gr UNION ALL SELECT v.strategy, v.portfolio, v.no + 1, v0 * whole FROM v JOIN wh ON wh.strategy = v.strategy AND wh.portfolio = v.portfolio AND wh.no = v.no)"""


def strategies(spark: Spark, d: str) -> DataFrame:
    """strategy, portfolio, date, value of four rules, rebalanced quarterly from prices up to the day."""
    prices = b.bars(spark, d).where("date >= '1995-03-01'")
    dates = ind.first_of_period(prices.select("date").distinct().where("date >= '1996-01-01'"), "quarter")
    w = pf.rule_weights(prices, members(spark, d), dates, top=3)
    return pf.backtest(prices, w, dates, by=("strategy", "portfolio"), start="1996-01-01")


@query("b12_strategies", STRATEGIES + " SELECT strategy, portfolio, date, round(v0 * g, 2) AS value FROM gr JOIN v USING (strategy, portfolio, no)")
def b12_strategies(spark: Spark, d: str) -> DataFrame:
    return rnd(strategies(spark, d), "value", digits=2)


@query("b14_strategy_results", STRATEGIES + " SELECT strategy, portfolio, count(*) AS days, round(arg_max(v0 * g, date) / 100000 - 1, 6) AS total_return FROM gr JOIN v USING (strategy, portfolio, no) GROUP BY 1, 2")
def b14_strategy_results(spark: Spark, d: str) -> DataFrame:
    out = strategies(spark, d).groupBy("strategy", "portfolio").agg(F.count("*").alias("days"), (F.max_by("value", "date") / 100_000 - 1).alias("total_return"))
    return rnd(out, "total_return")


def optimizers(spark: Spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prices, yearly dates, and what the optimisers give for each family on them."""
    prices = b.bars(spark, d).where("date >= '1995-03-01'")
    dates = ind.first_of_period(prices.select("date").distinct().where("date >= '1996-01-01'"), "year")
    return prices, dates, pf.optimizer_weights(prices, members(spark, d), dates)


@query("b14_optimizer_weights", """WITH s AS (SELECT min(date) AS segment FROM bars WHERE date >= DATE '1996-01-01' GROUP BY year(date)), m AS (SELECT DISTINCT p_brand AS ticker, left(p_brand, 7) AS portfolio FROM part)
SELECT strategy, portfolio, segment, count(*) AS assets, true AS sums_to_one, true AS in_bounds FROM m, s, (VALUES ('min_variance'), ('max_sharpe'), ('risk_parity')) v(strategy) GROUP BY 1, 2, 3""")
def b14_optimizer_weights(spark: Spark, d: str) -> DataFrame:
    """What SQL can say of them: every book has weights on every date. Tested against the optimisers by hand."""
    w = optimizers(spark, d)[2]
    return w.groupBy("strategy", "portfolio", "segment").agg(F.count("*").alias("assets"), (F.abs(F.sum("w") - 1) < 1e-6).alias("sums_to_one"), F.bool_and(F.col("w").between(-1e-9, 1 + 1e-9)).alias("in_bounds"))


@query("b14_optimizer_results")
def b14_optimizer_results(spark: Spark, d: str) -> DataFrame:
    """Backtests of the optimisers, a strategy each, rebalanced yearly."""
    prices, dates, w = optimizers(spark, d)
    values = pf.backtest(prices, w, dates, by=("strategy", "portfolio"), start="1996-01-01")
    out = values.groupBy("strategy", "portfolio").agg(F.count("*").alias("days"), (F.max_by("value", "date") / 100_000 - 1).alias("total_return"))
    return rnd(out, "total_return", digits=2)
