"""Queries on payloads, several sources, stored tables and service health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import integrate as mix
from tidemark.operators.quantiles import quantile
from tidemark.plans.market import rnd
from tidemark.sources import bars as b
from tidemark.sources import formats, tables

Spark = SparkSession
SAME = "SELECT ticker, date, open, high, low, close, volume FROM bars"


@query("s3_keyed_json", SAME)
def s3_keyed_json(spark: Spark, d: str) -> DataFrame:
    """All bars as one payload a ticker, and read back."""
    fields = F.create_map(*(x for i, n in enumerate(("open", "high", "low", "close", "volume"), 1) for x in (F.lit(f"{i}. {n}"), F.col(n).cast("string"))))
    body = b.bars(spark, d).groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), fields)))).alias("body"))
    return formats.keyed_json(body)


@query("s4_candles", SAME)
def s4_candles(spark: Spark, d: str) -> DataFrame:
    t = F.unix_seconds(F.col("date").cast("timestamp"))
    lists = {"t": t, "o": F.col("open"), "h": F.col("high"), "l": F.col("low"), "c": F.col("close"), "v": F.col("volume").cast("double")}
    rows = b.bars(spark, d).groupBy("ticker").agg(F.collect_list(F.struct(*(x.alias(n) for n, x in lists.items()))).alias("r"))
    body = rows.select("ticker", F.to_json(F.struct(*(F.col(f"r.{n}").alias(n) for n in lists))).alias("body"))
    return formats.candles(body)


@query("s5_records", "SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM bars")
def s5_records(spark: Spark, d: str) -> DataFrame:
    row = F.struct(F.col("date").cast("string").alias("date"), "open", "high", "low", "close", F.col("close").alias("adjClose"), "volume")
    return formats.records(b.bars(spark, d).groupBy("ticker").agg(F.to_json(F.collect_list(row)).alias("body")))


@query("s7_observations", "WITH m AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT series, date, v / 100 AS value FROM m WHERE day(date) % 5 <> 0", base=False)
def s7_observations(spark: Spark, d: str) -> DataFrame:
    m = b.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.min("o_totalprice").alias("v"))
    value = F.when(F.day("date") % 5 == 0, ".").otherwise(F.col("v").cast("string"))
    body = m.groupBy("series").agg(F.to_json(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), value.alias("value")))).alias("body"))
    return formats.observations(body, percent=True)


@query("s9_splits", """WITH s AS (SELECT p_brand AS ticker, CASE WHEN p_size % 2 = 0 THEN p_size / 2.0 ELSE 2.0 / (p_size + 1) END AS ratio FROM part)
SELECT ticker, CASE WHEN ratio < 1 THEN 'reverse_split' ELSE 'split' END AS action, count(*) AS n, round(sum(CASE WHEN ratio < 1 THEN 1 / ratio ELSE 1 END), 4) AS ratio_from, round(sum(CASE WHEN ratio < 1 THEN 1 ELSE ratio END), 4) AS ratio_to FROM s GROUP BY 1, 2""", base=False)
def s9_splits(spark: Spark, d: str) -> DataFrame:
    size = F.col("p_size")
    events = b.table(spark, d, "part").select(F.col("p_brand").alias("ticker"), F.lit("2000-01-03").cast("date").alias("date"), F.when(size % 2 == 0, size / 2).otherwise(2 / (size + 1)).alias("ratio"))
    return rnd(formats.splits(events).groupBy("ticker", "action").agg(F.count("*").alias("n"), F.sum("ratio_from").alias("ratio_from"), F.sum("ratio_to").alias("ratio_to")), "ratio_from", "ratio_to", digits=4)


@query("s11_upsert", "SELECT ticker, date, CASE WHEN year(date) >= 2000 THEN volume + 1 ELSE volume END AS volume FROM bars")
def s11_upsert(spark: Spark, d: str) -> DataFrame:
    old = b.bars(spark, d).select("ticker", "date", "volume").withColumn("ingested", F.lit(1))
    new = old.where("year(date) >= 2000").withColumns({"volume": F.col("volume") + 1, "ingested": F.lit(2)})
    return tables.upsert(old, new, ["ticker", "date"]).drop("ingested")


@query("s13_delete_range", "SELECT ticker, date FROM bars WHERE NOT (ticker = 'Brand#11' AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')")
def s13_delete_range(spark: Spark, d: str) -> DataFrame:
    return tables.delete_range(b.bars(spark, d), "Brand#11", "1997-01-01", "1999-12-31").select("ticker", "date")


@query("s14_insert_absent", "SELECT DISTINCT p_brand AS ticker, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'old' ELSE 'new' END AS origin FROM part", base=False)
def s14_insert_absent(spark: Spark, d: str) -> DataFrame:
    every = b.table(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    old = every.where("ticker like 'Brand#1%'").withColumn("origin", F.lit("old"))
    return tables.insert_absent(old, every.withColumn("origin", F.lit("new")), ["ticker"])


@query("s15_time_to_live", "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1", base=False)
def s15_time_to_live(spark: Spark, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    return tables.alive(e.join(F.broadcast(now)), "ts", F.col("now"), "24 hours").groupBy("event_type").agg(F.count("*").alias("n"))


@query("s16_json_export", """SELECT '{"ticker":"' || ticker || '","date":"' || CAST(date AS VARCHAR) || '","volume":' || volume || '}' AS line FROM bars""")
def s16_json_export(spark: Spark, d: str) -> DataFrame:
    return tables.to_json_lines(b.bars(spark, d).select("ticker", "date", "volume"))


FAULTY = "f AS (SELECT ticker, date, source, source_priority, CASE WHEN day(date) = 9 AND source_priority = 2 THEN NULL ELSE open END AS open, CASE WHEN day(date) = 7 AND source_priority > 1 THEN low * 0.5 ELSE high END AS high, low, close FROM panel)"


def faulty(spark: Spark, d: str) -> DataFrame:
    open_ = F.when((F.day("date") == 9) & (F.col("source_priority") == 2), None).otherwise(F.col("open"))
    high = F.when((F.day("date") == 7) & (F.col("source_priority") > 1), F.col("low") * 0.5).otherwise(F.col("high"))
    return b.source_panel(spark, d).withColumns({"open": open_, "high": high}).drop("volume")


QUALITY = f"""WITH {FAULTY}, q AS (SELECT ticker, source, source_priority, count(*) AS n, count(*) FILTER (high < low) AS inv, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS outs, count(*) FILTER (least(open, high, low, close) <= 0) AS np,
 sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT) / (4.0 * count(*)) AS missing, count(*) - count(DISTINCT date) AS rep,
 (count(DISTINCT open) * 2 < count(*))::INT + (count(DISTINCT high) * 2 < count(*))::INT + (count(DISTINCT low) * 2 < count(*))::INT + (count(DISTINCT close) * 2 < count(*))::INT AS flat FROM f GROUP BY 1, 2, 3),
s AS (SELECT *, (inv > 0)::INT + (outs > 0)::INT + (np > 0)::INT + (missing > 0.1)::INT + (rep > 0)::INT AS k, 100 - 10 * k - 50 * missing - 20 * flat AS score FROM q)"""


@query("a38_source_quality", QUALITY + " SELECT ticker, source, n, CAST(k AS INTEGER) AS issues, round(missing, 6) AS missing, round(score, 4) AS score FROM s")
def a38_source_quality(spark: Spark, d: str) -> DataFrame:
    q = mix.quality(faulty(spark, d)).withColumn("issues", F.size("issues")).drop("source_priority")
    return rnd(rnd(q, "missing"), "score", digits=4)


@query("a39_quality_issues", QUALITY + " SELECT ticker, source, concat_ws(',', CASE WHEN inv > 0 THEN 'inverted' END, CASE WHEN outs > 0 THEN 'outside' END, CASE WHEN np > 0 THEN 'nonpositive' END, CASE WHEN missing > 0.1 THEN 'missing' END, CASE WHEN rep > 0 THEN 'repeated' END) AS issues FROM s")
def a39_quality_issues(spark: Spark, d: str) -> DataFrame:
    return mix.quality(faulty(spark, d)).select("ticker", "source", F.array_join("issues", ",").alias("issues"))


@query("x1_best_source", QUALITY + """, r AS (SELECT f.*, score + CASE WHEN coalesce(high >= low AND high >= greatest(open, close) AND low <= least(open, close) AND open > 0 AND high > 0 AND low > 0 AND close > 0, false) THEN 10 ELSE 0 END AS rs FROM f JOIN s USING (ticker, source)),
w AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY rs DESC, source_priority) AS rn FROM r) SELECT ticker, date, source, close FROM w WHERE rn = 1""")
def x1_best_source(spark: Spark, d: str) -> DataFrame:
    return mix.best_rows(faulty(spark, d)).select("ticker", "date", "source", "close")


@query("x2_priority_cells", f"WITH {FAULTY} SELECT ticker, date, arg_min(open, source_priority) FILTER (open IS NOT NULL) AS open, arg_min(close, source_priority) FILTER (close IS NOT NULL) AS close FROM f GROUP BY 1, 2 HAVING min(source_priority) = 1")
def x2_priority_cells(spark: Spark, d: str) -> DataFrame:
    return mix.by_priority(faulty(spark, d)).select("ticker", "date", "open", "close")


@query("a37_averaged_sources", f"WITH {FAULTY} SELECT ticker, date, count(*) AS sources, round(avg(close) + 1e-9, 6) AS close, round(avg(open) + 1e-9, 6) AS open FROM f GROUP BY 1, 2")
def a37_averaged_sources(spark: Spark, d: str) -> DataFrame:
    return rnd(mix.averaged(faulty(spark, d)).select("ticker", "date", "sources", (F.col("close") + 1e-9).alias("close"), (F.col("open") + 1e-9).alias("open")), "close", "open")


@query("a37_voted_sources", """WITH v AS (SELECT ticker, date, floor(close / 100) * 100 AS close FROM panel), c AS (SELECT ticker, date, close, count(*) AS n FROM v GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY n DESC, close) AS rn FROM c)
SELECT ticker, date, close FROM r WHERE rn = 1""")
def a37_voted_sources(spark: Spark, d: str) -> DataFrame:
    return mix.voted(b.source_panel(spark, d).withColumn("close", (F.floor(F.col("close") / 100) * 100).cast("double"))).select("ticker", "date", "close")


@query("x3_repaired", f"""WITH {FAULTY}, u AS (SELECT *, 0 AS version FROM f UNION ALL SELECT * REPLACE (close * 1.01 AS close), 1 AS version FROM f WHERE day(date) = 5), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, source, date ORDER BY version DESC) AS rn FROM u),
o AS (SELECT ticker, date, source, open, greatest(open, high, close) AS high, least(open, low, close) AS low, close FROM k WHERE rn = 1),
l AS (SELECT ticker, date, source, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low, last_value(close IGNORE NULLS) OVER w AS close FROM o WINDOW w AS (PARTITION BY ticker, source ORDER BY date ROWS 5 PRECEDING))
SELECT ticker, date, source, open, high, low, close, close AS adj_close FROM l WHERE (open IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low IS NOT NULL)::INT + (close IS NOT NULL)::INT >= 2""")
def x3_repaired(spark: Spark, d: str) -> DataFrame:
    rows = faulty(spark, d).withColumn("version", F.lit(0))
    again = rows.where("day(date) = 5").withColumns({"close": F.col("close") * 1.01, "version": F.lit(1)})
    return mix.repaired(rows.unionByName(again), "version").select("ticker", "date", "source", "open", "high", "low", "close", "adj_close")


@query("x9_tagged_sources", "SELECT source, source_priority, count(*) AS n, count(DISTINCT ticker) AS tickers FROM panel GROUP BY 1, 2")
def x9_tagged_sources(spark: Spark, d: str) -> DataFrame:
    return b.source_panel(spark, d).groupBy("source", "source_priority").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"))


@query("u1_union_latest", "SELECT ticker, date, arg_max(close, source_priority) AS close FROM panel WHERE source_priority IN (1, 2) GROUP BY 1, 2")
def u1_union_latest(spark: Spark, d: str) -> DataFrame:
    p = b.source_panel(spark, d).select("ticker", "date", "close", "source_priority")
    return tables.upsert(p.where("source_priority = 1"), p.where("source_priority = 2"), ["ticker", "date"], "source_priority").drop("source_priority")


@query("a44_source_health", "SELECT event_type AS source, count(*) AS calls, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 4) AS latency, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1", base=False)
def a44_source_health(spark: Spark, d: str) -> DataFrame:
    out = b.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("calls"), F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("success_rate"), F.avg("value").alias("latency"))
    out = out.join(quantile(b.table(spark, d, "events"), "event_type", "value", 0.95, "p95"), F.expr("source <=> event_type"), "left").drop("event_type")
    return rnd(rnd(out, "success_rate"), "latency", "p95", digits=4)


@query("a47_error_summary", "SELECT event_type || ':' || left(props, 50) AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10", base=False)
def a47_error_summary(spark: Spark, d: str) -> DataFrame:
    """The ten most frequent messages: the limit is the feature."""
    return b.table(spark, d, "events").groupBy(F.concat("event_type", F.lit(":"), F.left("props", F.lit(50))).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)


@query("a43_error_counts", "SELECT CASE WHEN value >= 90 THEN 'timeout' WHEN value >= 50 THEN 'slow' ELSE 'fine' END AS category, count(*) AS n FROM events GROUP BY 1", base=False)
def a43_error_counts(spark: Spark, d: str) -> DataFrame:
    v = F.col("value")
    return b.table(spark, d, "events").groupBy(F.when(v >= 90, "timeout").when(v >= 50, "slow").otherwise("fine").alias("category")).agg(F.count("*").alias("n"))


@query("x6_health_average", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(sum(pow(0.9, age) * CASE WHEN age = n - 1 THEN 1.0 ELSE 0.1 END * value), 4) AS ema FROM o GROUP BY 1""", base=False)
def x6_health_average(spark: Spark, d: str) -> DataFrame:
    return rnd(mix.smoothed(b.table(spark, d, "events"), "event_type", "value", ["ts", "event_id"]), "ema", digits=4)


@query("x6_failure_runs", """WITH o AS (SELECT event_type, value >= 50 AS f, sum(CASE WHEN value >= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events),
r AS (SELECT event_type, i, count(*) FILTER (f) AS run FROM o GROUP BY 1, 2) SELECT event_type, max(run) AS longest FROM r GROUP BY 1""", base=False)
def x6_failure_runs(spark: Spark, d: str) -> DataFrame:
    return mix.longest_runs(b.table(spark, d, "events"), "event_type", F.coalesce(F.col("value") >= 50, F.lit(False)), ["ts", "event_id"])


@query("a53_fetch_summary", "SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(DISTINCT user_id) AS users, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY 1", base=False)
def a53_fetch_summary(spark: Spark, d: str) -> DataFrame:
    out = b.table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("hit_rate"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("sources"))
    return rnd(out, "hit_rate")
