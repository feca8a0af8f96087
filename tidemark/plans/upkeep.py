"""Queries on stored tables kept up by batches, the trades as a data source, a table function in SQL, and reports on calls and weights."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.functions import ranges
from tidemark.operators import breaker
from tidemark.plans.allocation import HELD, held
from tidemark.plans.calendar import MISSING
from tidemark.plans.market import rnd
from tidemark.session import ship
from tidemark.sources import bars as b
from tidemark.sources import tables, trades_source
from tidemark.sources.upkeep import PriceStore, TtlCache, shared_folder

Spark = SparkSession


def kept_up(spark: Spark, d: str) -> PriceStore:
    """All bars up to 1999, the years from 1998 on of the first family again (a correction), and the rest."""
    px = b.bars(spark, d).select("ticker", "date", "close", "volume")
    store = PriceStore(spark, shared_folder(spark))
    store.upsert(px.where("year(date) <= 1999"), "first")
    store.upsert(px.where("year(date) between 1998 and 1999 and ticker like 'Brand#1%'").withColumn("volume", F.col("volume") + 1), "correction")
    store.upsert(px.where("year(date) > 1999 and ticker not like 'Brand#5%'"), "second")
    return store


BATCHES = """WITH a AS (SELECT ticker, date, CASE WHEN year(date) BETWEEN 1998 AND 1999 AND ticker LIKE 'Brand#1%' THEN volume + 1 ELSE volume END AS volume FROM bars WHERE year(date) <= 1999 OR ticker NOT LIKE 'Brand#5%'),
l AS (SELECT ticker, 'first' AS source, 1 AS batch, date FROM bars WHERE year(date) <= 1999 UNION ALL SELECT ticker, 'correction', 2, date FROM bars WHERE year(date) BETWEEN 1998 AND 1999 AND ticker LIKE 'Brand#1%' UNION ALL SELECT ticker, 'second', 3, date FROM bars WHERE year(date) > 1999 AND ticker NOT LIKE 'Brand#5%')"""


@query("g9_ticker_stats", BATCHES + ", u AS (SELECT ticker, max(batch) AS updated FROM l GROUP BY 1) SELECT ticker, count(*) AS total_records, min(date) AS first_date, max(date) AS last_date, any_value(updated) AS updated FROM a JOIN u USING (ticker) GROUP BY 1")
def g9_ticker_stats(spark: Spark, d: str) -> DataFrame:
    """Statistics carried along three batches, each of which reads the folders of its own tickers only."""
    return kept_up(spark, d).stats()


@query("s11_range_log", BATCHES + " SELECT ticker, min(date) AS start_date, max(date) AS end_date, source, count(*) AS record_count, batch FROM l GROUP BY ticker, source, batch")
def s11_range_log(spark: Spark, d: str) -> DataFrame:
    return kept_up(spark, d).ranges()


@query("s11_stored_prices", BATCHES + " SELECT ticker, date, volume FROM a")
def s11_stored_prices(spark: Spark, d: str) -> DataFrame:
    return kept_up(spark, d).prices().select("ticker", "date", "volume")


@query("s2_trades_source", "SELECT * FROM bars")
def s2_trades_source(spark: Spark, d: str) -> DataFrame:
    ship(spark)
    return b.resample_daily(trades_source.trades(spark, d))


@query("s2_trades_pushed", "SELECT * FROM bars WHERE ticker IN ('Brand#11', 'Brand#23') AND date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def s2_trades_pushed(spark: Spark, d: str) -> DataFrame:
    """Two tickers, so two partitions, and a range of days that reaches the file's scan."""
    ship(spark)
    x = trades_source.trades(spark, d).where("ticker in ('Brand#11', 'Brand#23') and date between date'1996-01-01' and date'1997-06-30'")
    return b.resample_daily(x)


@query("g5_missing_ranges_sql", MISSING + ", r AS (SELECT ticker, date, CAST(date - DATE '1970-01-01' AS BIGINT) - row_number() OVER (PARTITION BY ticker ORDER BY date) AS island FROM miss) SELECT ticker AS key, min(date) AS start_date, max(date) AS end_date, count(*)::INT AS n FROM r GROUP BY ticker, island")
def g5_missing_ranges_sql(spark: Spark, d: str) -> DataFrame:
    """The table function, called from SQL text."""
    ship(spark)
    ranges.register(spark)
    b.bars(spark, d).select("ticker", "date").createOrReplaceTempView("tidemark_dates")
    return spark.sql("SELECT * FROM missing_ranges(TABLE(SELECT ticker, date FROM tidemark_dates) PARTITION BY ticker ORDER BY date)")


@query("a28_cache_summary", """WITH s AS (SELECT ticker, count(*) AS n, max(date) AS z FROM bars GROUP BY 1), e AS (SELECT count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type IN ('view', 'click')) AS asked FROM events),
t AS (SELECT string_agg(ticker || ':' || n, ',' ORDER BY n DESC, ticker) AS largest FROM (SELECT * FROM s ORDER BY n DESC, ticker LIMIT 5))
SELECT count(*) AS tickers, sum(n)::BIGINT AS records, round(avg(n), 6) AS mean_records, count(*) FILTER (z >= DATE '2001-10-31') AS fresh, (SELECT round(hits / nullif(asked, 0), 6) FROM e) AS hit_rate, (SELECT largest FROM t) AS largest FROM s""")
def a28_cache_summary(spark: Spark, d: str) -> DataFrame:
    """One row: sizes, freshness, the share of requests met by the cache (views of views and clicks), and the five largest tickers."""
    s = b.bars(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.max("date").alias("z"))
    sums = s.agg(F.count("*").alias("tickers"), F.sum("n").alias("records"), F.round(F.avg("n"), 6).alias("mean_records"), F.count_if(F.col("z") >= F.lit("2001-10-31").cast("date")).alias("fresh"))
    top = s.orderBy(F.desc("n"), "ticker").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "ticker", "n"))).alias("l"))
    top = top.select(F.array_join(F.transform("l", lambda x: F.concat(x["ticker"], F.lit(":"), x["n"].cast("string"))), ",").alias("largest"))
    hits = b.table(spark, d, "events").agg(F.round(F.try_divide(F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("view", "click"))), 6).alias("hit_rate"))
    return sums.join(hits).join(top)  # one row each


KINDS = {"timeout": "\"k\": 9", "network": "\"k\": [78]", "rate_limit": "\"k\": [56]"}


@query("a47_error_totals", "WITH e AS (SELECT event_type || ':' || left(props, 50) AS key, " + "CASE " + " ".join(f"WHEN regexp_matches(props, '{p}') THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'other' END AS kind FROM events WHERE event_type = 'error') SELECT kind, count(*) AS errors, count(DISTINCT key) AS messages, sum(count(*)) OVER ()::BIGINT AS total FROM e GROUP BY 1", base=False)
def a47_error_totals(spark: Spark, d: str) -> DataFrame:
    """Errors by what their message looks like: how many, how many different ones, and all together."""
    e = b.table(spark, d, "events").where("event_type = 'error'")
    kind = F.lit("other")
    for k, p in reversed(KINDS.items()):
        kind = F.when(F.col("props").rlike(p), k).otherwise(kind)
    kinds = e.groupBy(kind.alias("kind")).agg(F.count("*").alias("errors"), F.count_distinct(F.concat("event_type", F.lit(":"), F.left("props", F.lit(50)))).alias("messages"))
    total = e.agg(F.count("*").alias("total"))
    return kinds.join(total)  # one row


@query("a53_fetch_rates", """SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_rate, round(count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0), 6) AS hit_rate, string_agg(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END, ',' ORDER BY CASE WHEN event_type <> 'error' THEN event_type END) AS sources_used FROM events GROUP BY 1""", base=False)
def a53_fetch_rates(spark: Spark, d: str) -> DataFrame:
    """By day: the share of calls that did not fail, of requests met by the cache, and the sources that answered."""
    kind = F.col("event_type")
    out = b.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), (F.count_if(kind != "error") / F.count("*")).alias("success_rate"), F.try_divide(F.count_if(kind == "view"), F.count_if(kind.isin("view", "click"))).alias("hit_rate"), F.array_join(F.array_sort(F.collect_set(F.when(kind != "error", kind))), ",").alias("sources_used"))
    return rnd(out, "success_rate", "hit_rate").withColumn("sources_used", F.nullif("sources_used", F.lit("")))


@query("t6_weight_rows", f"WITH {HELD}, m AS (SELECT portfolio, ticker, shares * coalesce(close, avg_cost) AS mv FROM h LEFT JOIN px USING (ticker)), w AS (SELECT *, mv / (sum(mv) OVER (PARTITION BY portfolio) + 10000) AS weight FROM m) SELECT portfolio, ticker, round(weight, 8) AS weight, row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, ticker)::INT AS place FROM w WHERE weight > 0.001", base=False)
def t6_weight_rows(spark: Spark, d: str) -> DataFrame:
    """The report itself: each book's weights above a tenth of a percent, largest first."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc("weight"), "ticker"))
    return rnd(held(spark, d).where("weight > 0.001").select("portfolio", "ticker", "weight", place.alias("place")).orderBy("portfolio", "place"), "weight", digits=8)


@query("p10_weight_sums", """WITH w AS (SELECT p_brand AS ticker, left(p_brand, 7) AS portfolio, round(100 * sum(p_retailprice) / sum(sum(p_retailprice)) OVER (PARTITION BY left(p_brand, 7)), 2) AS w FROM part GROUP BY p_brand)
SELECT portfolio, round(sum(w), 4) AS total, abs(round(sum(w), 4) - 100) <= 0.01 AS percent_fits, abs(round(sum(w), 4) / 100 - 1) <= 0.001 AS share_fits, bool_and(w BETWEEN 0 AND 100) AS in_bounds FROM w GROUP BY 1""", base=False)
def p10_weight_sums(spark: Spark, d: str) -> DataFrame:
    """Weights rounded to hundredths of a percent: do they sum to 100 (within 0.01), and as shares to 1 (within 0.001)?"""
    part = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("v")).withColumn("portfolio", F.left("ticker", F.lit(7)))
    all_ = part.groupBy("portfolio").agg(F.sum("v").alias("all"))
    w = part.join(all_, "portfolio").withColumn("w", F.round(100 * F.col("v") / F.col("all"), 2))
    s = w.groupBy("portfolio").agg(F.round(F.sum("w"), 4).alias("total"), F.bool_and(F.col("w").between(0, 100)).alias("in_bounds"))
    return s.select("portfolio", "total", (F.abs(F.col("total") - 100) <= 0.01).alias("percent_fits"), (F.abs(F.col("total") / 100 - 1) <= 0.001).alias("share_fits"), "in_bounds")


BREAKER = """WITH RECURSIVE o AS (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS sec, coalesce(value >= 40, false) AS bad, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS run, NULL::DOUBLE AS until, '' AS outcome FROM (SELECT DISTINCT event_type FROM o)
UNION ALL SELECT o.event_type, o.n, o.event_id,
 CASE WHEN until IS NOT NULL AND sec < until THEN run WHEN NOT bad THEN 0 WHEN until IS NOT NULL OR run + 1 >= 5 THEN 0 ELSE run + 1 END,
 CASE WHEN until IS NOT NULL AND sec < until THEN until WHEN bad AND (until IS NOT NULL OR run + 1 >= 5) THEN sec + 3600 END,
 CASE WHEN until IS NOT NULL AND sec < until THEN 'rejected' WHEN bad THEN 'failed' ELSE 'ok' END FROM f JOIN o ON o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_id, event_type, outcome FROM f WHERE n > 0"""


@query("x6_circuit_breaker", BREAKER, base=False)
def x6_circuit_breaker(spark: Spark, d: str) -> DataFrame:
    """Every call by what the breaker of its kind did with it: five failures (values from 40 on) in a row, an hour's pause, one trial."""
    ship(spark)
    e = b.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return breaker.calls(e, "event_type", "ts", F.col("value") >= 40, ["event_id"], 5, 3600.0).select("event_id", "event_type", "outcome")


@query("s16_csv_export", """SELECT concat_ws(',', ticker, date, volume) AS line FROM bars""")
def s16_csv_export(spark: Spark, d: str) -> DataFrame:
    return tables.to_csv_lines(b.bars(spark, d).select("ticker", "date", "volume"))


@query("s15_cache_info", "SELECT 'bars' AS name, count(*) AS rows, 600.0::DOUBLE AS age, true AS valid FROM bars UNION ALL SELECT 'dividends', count(*), 7200, false FROM dividends")
def s15_cache_info(spark: Spark, d: str) -> DataFrame:
    """Two frames put at different times, one of which is over its hour."""
    now = dt.datetime(2024, 1, 1, 12)
    cache = TtlCache(spark, shared_folder(spark), dt.timedelta(hours=1))
    cache.put("dividends", b.dividends(spark, d), now - dt.timedelta(hours=2))
    cache.put("bars", b.bars(spark, d), now - dt.timedelta(minutes=10))
    return cache.info(now)
