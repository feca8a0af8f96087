"""Queries on calendars, gaps and cached intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import holidays as hol
from tidemark.operators import gaps
from tidemark.sources import bars as b

Spark = SparkSession

MISSING = """WITH e AS (SELECT ticker, min(date) a, max(date) z FROM bars GROUP BY 1), want AS (SELECT ticker, date FROM weekdays JOIN e ON date BETWEEN a AND z),
miss AS (SELECT * FROM want WHERE NOT EXISTS (SELECT 1 FROM bars x WHERE x.ticker = want.ticker AND x.date = want.date)),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS no FROM weekdays)"""


def _missing(spark: Spark, d: str) -> DataFrame:
    prices = b.bars(spark, d)
    return gaps.missing_days(prices, b.weekdays(prices))


@query("j10_missing_days", MISSING + " SELECT ticker, date FROM miss")
def j10_missing_days(spark: Spark, d: str) -> DataFrame:
    return _missing(spark, d)


RUNS = MISSING + ", r AS (SELECT ticker, date, no - row_number() OVER (PARTITION BY ticker ORDER BY date) AS island FROM miss JOIN cal USING (date)), g AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS n FROM r GROUP BY ticker, island)"


@query("g1_missing_ranges", RUNS + " SELECT * FROM g")
def g1_missing_ranges(spark: Spark, d: str) -> DataFrame:
    """Runs of missing trading days; weekends don't part a run."""
    return gaps.runs(_missing(spark, d), gaps.weekday_number())


MERGED = """, o AS (SELECT *, max(end_date) OVER (PARTITION BY ticker ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_date - reach > {k} THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY start_date, end_date) AS island FROM o),
m AS (SELECT ticker, min(start_date) AS start_date, max(end_date) AS end_date FROM i GROUP BY ticker, island)"""


@query("g3_merged_ranges", RUNS + MERGED.format(k=5) + " SELECT * FROM m")
def g3_merged_ranges(spark: Spark, d: str) -> DataFrame:
    return gaps.merged(gaps.runs(_missing(spark, d), gaps.weekday_number()), 5)


COMPLEMENT = """WITH o AS (SELECT *, max(end_date) OVER (PARTITION BY ticker ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals WHERE end_date >= DATE '1996-01-01' AND start_date <= DATE '2000-12-31'),
g0 AS (SELECT ticker, coalesce(reach + 1, DATE '1996-01-01') AS start_date, start_date - 1 AS end_date FROM o UNION ALL SELECT ticker, max(end_date) + 1, DATE '2000-12-31' FROM o GROUP BY ticker),
g AS (SELECT * FROM g0 WHERE start_date <= end_date)"""


@query("g4_uncovered_ranges", COMPLEMENT.replace("WITH o AS", "WITH o0 AS", 1).replace("FROM o ", "FROM o0 ") + MERGED.format(k=30) + " SELECT * FROM m")
def g4_uncovered_ranges(spark: Spark, d: str) -> DataFrame:
    """What the cached intervals leave open of 1996-2000, gaps merged that stand at most 30 days apart."""
    return gaps.merged(gaps.uncovered(b.cached_intervals(spark, d), "1996-01-01", "2000-12-31"), 30)


@query("g5_business_ranges", MISSING + ", r AS (SELECT ticker, date, CAST(date - DATE '1970-01-01' AS BIGINT) - row_number() OVER (PARTITION BY ticker ORDER BY date) AS island FROM miss) SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS n FROM r GROUP BY ticker, island")
def g5_business_ranges(spark: Spark, d: str) -> DataFrame:
    """Runs of missing weekdays that a weekend parts."""
    return gaps.runs(_missing(spark, d), F.datediff("date", F.lit("1970-01-01").cast("date")))


@query("p11_overlapping_ranges", "SELECT ticker, count(*) AS n FROM intervals WHERE NOT (end_date < DATE '1997-02-15' OR start_date > DATE '1998-05-15') GROUP BY 1")
def p11_overlapping_ranges(spark: Spark, d: str) -> DataFrame:
    hit = gaps.overlaps(F.col("start_date"), F.col("end_date"), F.lit("1997-02-15").cast("date"), F.lit("1998-05-15").cast("date"))
    return b.cached_intervals(spark, d).where(hit).groupBy("ticker").agg(F.count("*").alias("n"))


@query("g6_exchange_days", """WITH RECURSIVE y AS (SELECT CAST(range AS INTEGER) AS y FROM range(1995, 2003)),
c AS (SELECT y, y % 19 a, y // 100 b, y % 100 c FROM y), c2 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM c), c3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM c2),
c4 AS (SELECT y, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS x FROM c3),
d AS (SELECT CAST(d AS DATE) AS d, y FROM y, generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY) t(d)),
h AS (SELECT make_date(y, CAST(x // 31 AS INTEGER), CAST(x % 31 + 1 AS INTEGER)) - 2 AS d FROM c4
 UNION ALL SELECT d FROM d WHERE isodow(d) = 1 AND ((month(d) = 1 AND day(d) BETWEEN 15 AND 21 AND y >= 1998) OR (month(d) = 2 AND day(d) BETWEEN 15 AND 21) OR (month(d) = 5 AND day(d) > 24) OR (month(d) = 9 AND day(d) < 8))
 UNION ALL SELECT d FROM d WHERE isodow(d) = 4 AND month(d) = 11 AND day(d) BETWEEN 22 AND 28
 UNION ALL SELECT CASE isodow(f) WHEN 6 THEN f - 1 WHEN 7 THEN f + 1 ELSE f END FROM (SELECT make_date(y, 7, 4) f FROM y UNION ALL SELECT make_date(y, 12, 25) FROM y)
 UNION ALL SELECT CASE isodow(f) WHEN 7 THEN f + 1 ELSE f END FROM (SELECT make_date(y, 1, 1) f FROM y) WHERE isodow(f) <> 6)
SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS days FROM weekdays WHERE date NOT IN (SELECT d FROM h) GROUP BY 1""")
def g6_exchange_days(spark: Spark, d: str) -> DataFrame:
    """Trading days a year: weekdays without the exchange's holidays."""
    off = hol.holidays(spark.range(1995, 2003).select(F.col("id").cast("int").alias("year"))).select("date")
    days = b.weekdays(b.bars(spark, d)).join(F.broadcast(off), "date", "left_anti")
    return days.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("days"))


@query("p19_previous_trading_day", """WITH c AS (SELECT DISTINCT date FROM bars), q AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1996-01-01', DATE '1998-12-31', INTERVAL 1 DAY) t(d))
SELECT day, NOT (isodow(day) > 5 OR (month(day) * 100 + day(day)) IN (101, 704, 1225) OR (month(day) = 11 AND isodow(day) = 4 AND day(day) BETWEEN 22 AND 28)) AS likely_open, max(date) AS last_bar
FROM q LEFT JOIN c ON date <= day AND date >= day - 10 GROUP BY 1""")
def p19_previous_trading_day(spark: Spark, d: str) -> DataFrame:
    """For each day: whether trading is likely, and the last day within ten that has bars."""
    days = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'1998-12-31', interval 1 day)")).alias("day"))
    back = days.select("day", F.explode(F.expr("sequence(day - 10, day, interval 1 day)")).alias("date"))
    open_days = b.bars(spark, d).select("date").distinct()
    last = back.join(open_days, "date").groupBy("day").agg(F.max("date").alias("last_bar"))
    likely = (F.weekday("day") < 5) & ~hol.likely_holiday(F.col("day"))
    return days.join(last, "day", "left").select("day", likely.alias("likely_open"), "last_bar")


@query("p15_range_presets", """WITH z AS (SELECT ticker, max(date) AS z FROM bars GROUP BY 1), p(name, days) AS (VALUES ('1D', 1), ('1W', 7), ('1M', 30), ('3M', 90), ('6M', 180), ('1Y', 365), ('3Y', 1095), ('5Y', 1825)),
s AS (SELECT ticker, name, CAST(z - CAST(days AS INTEGER) AS DATE) AS s FROM z, p) SELECT ticker, name, CAST(CASE isodow(s) WHEN 6 THEN s - 1 WHEN 7 THEN s - 2 ELSE s END AS DATE) AS start_date FROM s""")
def p15_range_presets(spark: Spark, d: str) -> DataFrame:
    """First day of each preset range before a ticker's last bar; weekends roll back to Friday."""
    presets = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "6M": 180, "1Y": 365, "3Y": 1095, "5Y": 1825}
    rows = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("days")) for k, v in presets.items()))
    s = b.bars(spark, d).groupBy("ticker").agg(F.max("date").alias("z")).select("ticker", F.explode(rows).alias("p"), "z").select("ticker", "p.name", F.expr("date_sub(z, p.days)").alias("s"))
    return s.select("ticker", "name", F.date_sub("s", F.greatest(F.weekday("s") - 4, F.lit(0))).alias("start_date"))


@query("a23_cache_stats", """WITH r AS (SELECT ticker, count(*) AS ranges FROM intervals GROUP BY 1), s AS (SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1)
SELECT ticker, n, coalesce(ranges, 0) AS ranges, first_date, last_date, CASE WHEN DATE '2001-11-06' - last_date <= 1 THEN 'Current' WHEN DATE '2001-11-06' - last_date <= 7 THEN 'Recent' WHEN last_date IS NULL THEN 'Unknown' ELSE 'Stale' END AS freshness FROM s LEFT JOIN r USING (ticker)""")
def a23_cache_stats(spark: Spark, d: str) -> DataFrame:
    age = F.datediff(F.lit("2001-11-06").cast("date"), "last_date")
    ranges = b.cached_intervals(spark, d).groupBy("ticker").agg(F.count("*").alias("ranges"))
    s = b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    fresh = F.when(age <= 1, "Current").when(age <= 7, "Recent").when(age.isNull(), "Unknown").otherwise("Stale")
    return s.join(ranges, "ticker", "left").select("ticker", "n", F.coalesce("ranges", F.lit(0)).cast("long").alias("ranges"), "first_date", "last_date", fresh.alias("freshness"))


@query("a24_year_coverage", """WITH z AS (SELECT max(date) AS z FROM bars) SELECT ticker, round(least(100.0, count(*) FILTER (isodow(date) < 6 AND date > z - 365) * 100.0 / 252), 4) AS coverage FROM bars, z GROUP BY 1""")
def a24_year_coverage(spark: Spark, d: str) -> DataFrame:
    prices = b.bars(spark, d)
    z = prices.agg(F.max("date").alias("z"))
    n = F.count_if((F.weekday("date") < 5) & (F.col("date") > F.date_sub("z", 365)))
    return prices.join(F.broadcast(z)).groupBy("ticker").agg(F.round(F.least(F.lit(100.0), n * 100.0 / 252), 4).alias("coverage"))


@query("a28_cache_dashboard", """WITH s AS (SELECT ticker, count(*) AS n, max(date) AS z FROM bars GROUP BY 1) SELECT count(*) AS tickers, sum(n)::BIGINT AS records, round(avg(n), 6) AS mean_records, count(*) FILTER (z >= DATE '2001-10-31') AS fresh FROM s""")
def a28_cache_dashboard(spark: Spark, d: str) -> DataFrame:
    s = b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("z"))
    return s.agg(F.count("*").alias("tickers"), F.sum("n").alias("records"), F.round(F.avg("n"), 6).alias("mean_records"), F.count_if(F.col("z") >= F.lit("2001-10-31").cast("date")).alias("fresh"))


@query("t2_largest_tickers", "SELECT ticker, count(*) AS n FROM bars GROUP BY 1 ORDER BY n DESC, ticker LIMIT 5")
def t2_largest_tickers(spark: Spark, d: str) -> DataFrame:
    """A report of the five largest: the limit is the feature."""
    return b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(5)


@query("u_set_operations", """WITH a AS (SELECT DISTINCT ticker, date FROM panel WHERE source_priority = 1), c AS (SELECT DISTINCT ticker, date FROM panel WHERE source_priority = 2)
SELECT 'union' AS kind, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM c) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c) UNION ALL SELECT 'only first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)""")
def u_set_operations(spark: Spark, d: str) -> DataFrame:
    p = b.source_panel(spark, d)
    one, two = (p.where(F.col("source_priority") == k).select("ticker", "date") for k in (1, 2))
    count = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    return count(one.union(two).distinct(), "union").union(count(one.intersect(two), "both")).union(count(one.subtract(two), "only first"))


@query("a51_monthly_coverage", """WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders GROUP BY 1, 2)
SELECT series, count(*) AS points, min(month) AS first_month, max(month) AS last_month, count(*) >= 0.8 * (date_diff('month', min(month), max(month)) + 1) AS complete FROM m GROUP BY 1""")
def a51_monthly_coverage(spark: Spark, d: str) -> DataFrame:
    m = b.table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), F.trunc("o_orderdate", "month").alias("month")).distinct()
    return m.groupBy("series").agg(F.count("*").alias("points"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), (F.count("*") >= 0.8 * (F.months_between(F.max("month"), F.min("month")) + 1)).alias("complete"))


@query("g7_cache_report", """WITH s AS (SELECT event_type AS source, count(*) AS calls, count(*) FILTER (value >= 50) AS slow FROM events GROUP BY 1)
SELECT source, calls, round(slow * 1.0 / calls, 6) AS slow_rate, CASE WHEN slow * 1.0 / calls > 0.5 THEN 'cache more' WHEN calls < 100 THEN 'too few calls' ELSE 'fine' END AS advice FROM s""", base=False)
def g7_cache_report(spark: Spark, d: str) -> DataFrame:
    s = b.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") >= 50).alias("slow"))
    rate = F.col("slow") / F.col("calls")
    return s.select("source", "calls", F.round(rate, 6).alias("slow_rate"), F.when(rate > 0.5, "cache more").when(F.col("calls") < 100, "too few calls").otherwise("fine").alias("advice"))


