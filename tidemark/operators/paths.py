"""Block bootstrap of a return series in DataFrame functions: paths are dealt over tasks, the series is joined by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIODS = 252
SERIES_ROWS = 100_000  # daily rows of one series beyond which the join shuffles


def numbered(series: DataFrame) -> DataFrame:
    """pos (from 0, by date) and ret of one daily series: as long as its calendar, whatever the number of tickers."""
    return series.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("pos"), "ret")


def block_bootstrap(series: DataFrame, paths: int, days: int, block: int, seed: int = 42) -> DataFrame:
    """path, day (from 1), ret: blocks of neighbouring days, their starts drawn by hash; the series wraps around."""
    spark = series.sparkSession
    rows = numbered(series)
    n = rows.count()
    blocks = -(-days // block)
    starts = spark.range(paths).withColumnRenamed("id", "path").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    starts = starts.withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "path", "k"), F.lit(max(n, 1))))
    drawn = starts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).select("path", (F.col("k") * block + F.col("i") + 1).alias("day"), F.pmod(F.col("start") + F.col("i"), F.lit(max(n, 1))).alias("pos")).where(F.col("day") <= days)
    return drawn.join(F.broadcast(rows) if n <= SERIES_ROWS else rows, "pos").select("path", "day", "ret")


def growth(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return paths.withColumn("value", F.exp(F.sum(F.log1p("ret")).over(w)))


def path_metrics(paths: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    down = growth(paths).withColumn("down", 1 - F.col("value") / F.greatest(F.max("value").over(w), F.lit(1.0)))
    return down.groupBy("path").agg(F.max_by("value", "day").alias("growth"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(PERIODS)))).alias("volatility"), F.max("down").alias("max_drawdown"))


def percentile_table(metrics: DataFrame, names: list[str], at: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """metric, percentile, value; missing values are left out."""
    long = metrics.unpivot([], names, "metric", "v").where("v is not null and not isnan(v)")
    levels = F.array(*(F.lit(x / 100) for x in at))
    found = long.groupBy("metric").agg(F.percentile("v", levels).alias("q"))
    return found.select("metric", F.posexplode("q").alias("i", "value")).select("metric", F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1).alias("percentile"), "value")


def percentile_paths(paths: DataFrame) -> DataFrame:
    q = growth(paths).groupBy("day").agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    return q.select("day", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))
