"""Daily market tables in one long shape, derived from the star-schema tables.

bars: one row for each ticker (part brand) and day. Open and close are the first and last trade of the day in the order of a
full key, so ties cannot change them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def by_date() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, px, qty, src (1..3) and the trade's full key."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "ticker",
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_suppkey") % 3 + 1).cast("int").alias("src"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("key"),
    )


def resample_daily(ticks: DataFrame, *more: str) -> DataFrame:
    """Open, high, low, close and volume by ticker, date and the columns `more`; one shuffle, combined map-side."""
    return ticks.groupBy("ticker", "date", *more).agg(
        F.min_by("px", "key").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "key").alias("close"),
        F.sum("qty").cast("long").alias("volume"),
    )


def resample_many(ticks: DataFrame, *more: str) -> DataFrame:
    """resample_daily for far more ticks than bars, in two passes over the ticks.

    The first and last tick of a key of several columns need a sort of all ticks of a task; sums and extremes of single columns don't.
    So the first pass takes those, and the range of the key's first column; the second leaves only the ticks at its ends, from which
    open and close follow by the full key. A row a bar is broadcast between them, which does not grow with the ticks.
    """
    by, k = ["ticker", "date", *more], F.col("key")[ticks.schema["key"].dataType[0].name]
    # a null is the least, and the first, as in the order of the whole key
    low = F.when(F.count(k) == F.count(F.lit(1)), F.min(k))
    whole = ticks.groupBy(*by).agg(F.max("px").alias("_high"), F.min("px").alias("_low"), F.sum("qty").cast("long").alias("_volume"), low.alias("_a"), F.max(k).alias("_z"))
    whole = whole.select(*(F.col(c).alias(f"_{c}") for c in by), "_high", "_low", "_volume", "_a", "_z")
    same = k.eqNullSafe(F.col("_a")) | k.eqNullSafe(F.col("_z"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    ends = ticks.join(F.broadcast(whole), same)
    return ends.groupBy(*by).agg(F.min_by("px", "key").alias("open"), F.max("_high").alias("high"), F.min("_low").alias("low"), F.max_by("px", "key").alias("close"), F.max("_volume").alias("volume"))


_kept: dict[tuple[str, str, str], tuple[list[tuple], DataFrame]] = {}
BASE = ("lineitem", "part")  # the tables that what is kept comes from


def file_state(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Name, length and time of the files of the tables that bars come from."""
    out = []
    for name in BASE:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(path)
        files = fs.listStatus(path) if status.isDirectory() else [status]
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return out


def kept(df: DataFrame, name: str, sf_dir: str) -> DataFrame:
    """df, computed once in a session for a folder and the state of its files, laid out by ticker and date, in memory and on the
    executors' disks. Other files, lengths or times of the tables below give up what was kept.

    Bars are far fewer than trades, and nearly every query reads them; lost blocks are computed again from the trades.
    """
    spark = df.sparkSession
    key, state = (spark.sparkContext.applicationId, name, sf_dir), file_state(spark, sf_dir)
    for old in [k for k in _kept if k[0] != key[0]]:
        del _kept[old]  # of a session that has ended
    if key in _kept and _kept[key][0] != state:
        _kept.pop(key)[1].unpersist()
    if key not in _kept:
        _kept[key] = state, df.repartition("ticker").sortWithinPartitions("ticker", "date").persist(StorageLevel.MEMORY_AND_DISK)
    return _kept[key][1]


def release() -> None:
    """Give up the bars that are kept, as when the trades have changed."""
    while _kept:
        _kept.popitem()[1][1].unpersist()


def fresh_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars from the trades, not kept."""
    return resample_many(trades(spark, sf_dir))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(fresh_bars(spark, sf_dir), "bars", sf_dir)


def source_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars as three sources see them: source (priority 1..3) is a split of the trades."""
    panel = resample_many(trades(spark, sf_dir), "src").withColumnRenamed("src", "source_priority").withColumn("source", F.concat(F.lit("s"), F.col("source_priority")))
    return kept(panel, "panel", sf_dir)


def simple_returns(prices: DataFrame, close: str = "close") -> DataFrame:
    """ticker, date, close, ret of every day but a ticker's first."""
    return prices.select("ticker", "date", F.col(close).alias("close"), (F.col(close) / F.lag(close).over(by_date()) - 1).alias("ret")).where("ret is not null")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple_returns(bars(spark, sf_dir))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, w: share of all list prices."""
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_retailprice").alias("v"))
    total = by.agg(F.sum("v").alias("t"))
    return by.join(F.broadcast(total)).select("ticker", (F.col("v") / F.col("t")).alias("w"))


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ex_date, amount: one percent of the close of each quarter's last bar."""
    return (
        bars(spark, sf_dir)
        .groupBy("ticker", F.date_trunc("quarter", "date").alias("q"))
        .agg(F.max("date").alias("ex_date"), (F.max_by("close", "date") * 0.01).alias("amount"))
        .select("ticker", "ex_date", "amount")
    )


def cached_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, start_date, end_date: first and last trading day of each quarter, without every third quarter."""
    q = bars(spark, sf_dir).groupBy("ticker", (F.year("date") * 4 + F.quarter("date")).alias("q")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return q.where("q % 3 <> 0").select("ticker", "start_date", "end_date")


def weekdays(dates: DataFrame) -> DataFrame:
    """date: all weekdays from the first to the last date of a frame, generated, not collected."""
    ends = dates.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    return ends.select(F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("date")).where("weekday(date) < 5")


#: The same tables as SQL, for checks.
SQL = """
px AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_quantity AS qty,
              CAST(l_suppkey % 3 + 1 AS INTEGER) AS src, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0),
bars AS (SELECT ticker, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, CAST(sum(qty) AS BIGINT) AS volume
         FROM px GROUP BY ticker, date),
panel AS (SELECT ticker, date, src AS source_priority, 's' || src AS source, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, CAST(sum(qty) AS BIGINT) AS volume
          FROM px GROUP BY ticker, date, src),
returns AS (SELECT * FROM (SELECT ticker, date, close, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars) WHERE ret IS NOT NULL),
weights AS (SELECT p_brand AS ticker, sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) AS w FROM part GROUP BY 1),
dividends AS (SELECT ticker, max(date) AS ex_date, arg_max(close, date) * 0.01 AS amount FROM bars GROUP BY ticker, date_trunc('quarter', date)),
intervals AS (SELECT ticker, min(date) AS start_date, max(date) AS end_date FROM bars GROUP BY ticker, year(date) * 4 + quarter(date) HAVING (year(date) * 4 + quarter(date)) % 3 <> 0),
weekdays AS (SELECT CAST(d AS DATE) AS date FROM (SELECT min(date) a, max(date) z FROM bars), generate_series(a, z, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)
"""
