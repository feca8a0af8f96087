"""Gaps and interval algebra: missing days as anti joins, runs of days and merged intervals as islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_days(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """ticker, date of the calendar's days between a ticker's first and last bar on which it has none.

    Each ticker's span is dealt out by day and met with the calendar by equality; nothing is broadcast.
    """
    spans = prices.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("z"))
    days = spans.select("ticker", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("date"))
    return days.join(calendar.select("date"), "date", "left_semi").join(prices.select("ticker", "date"), ["ticker", "date"], "left_anti").select("ticker", "date")


def runs(days: DataFrame, order: Column) -> DataFrame:
    """ticker, start_date, end_date, n of runs whose `order` numbers follow one another without a hole."""
    rn = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return days.withColumn("island", order - rn).groupBy("ticker", "island").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n")).drop("island")


def weekday_number(c: str = "date") -> Column:
    days = F.datediff(c, F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))


def merged(intervals: DataFrame, within: int) -> DataFrame:
    """Intervals of each ticker, those merged that overlap or stand at most `within` days apart."""
    w = Window.partitionBy("ticker").orderBy("start_date", "end_date")
    before = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.datediff("start_date", before) > within), 1).otherwise(0)
    island = F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return intervals.withColumn("fresh", fresh).withColumn("island", island).groupBy("ticker", "island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date")).drop("island")


def uncovered(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """The parts of [start, end] that no interval of a ticker covers."""
    w = Window.partitionBy("ticker").orderBy("start_date", "end_date")
    inside = intervals.where((F.col("end_date") >= F.lit(start).cast("date")) & (F.col("start_date") <= F.lit(end).cast("date")))
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = inside.withColumn("a", F.coalesce(F.date_add(reach, 1), F.lit(start).cast("date"))).withColumn("z", F.date_sub("start_date", 1))
    tail = inside.groupBy("ticker").agg(F.date_add(F.max("end_date"), 1).alias("a")).withColumn("z", F.lit(end).cast("date"))
    return gaps.select("ticker", "a", "z").union(tail.select("ticker", "a", "z")).where("a <= z").select("ticker", F.col("a").alias("start_date"), F.col("z").alias("end_date"))


def overlaps(start: Column, end: Column, a: Column, z: Column) -> Column:
    return ~((end < a) | (start > z))
