"""Exact quantiles of large groups: counts by range, then only the range that holds the wanted rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096


def quantile(rows: DataFrame, by: str, value: str, q: float, name: str) -> DataFrame:
    """by, name: the linearly interpolated quantile of each group; null values are left out.

    A group's values are counted in RANGES equal ranges between its ends; the one or two ranges that hold the wanted ranks are
    counted value by value. No task holds a group; equal values combine map-side.
    """
    x = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    ends = x.groupBy(F.col("g").alias("eg")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
    x = x.join(ends, F.expr("g <=> eg")).select("g", "v", F.coalesce(place, F.lit(0)).alias("r"), "n")
    low, high = F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)
    holds = lambda k: (F.col("start") <= k) & (k < F.col("start") + F.col("c"))

    def started(df: DataFrame, part: list[str], order: str) -> DataFrame:
        return df.withColumn("start", F.coalesce(F.sum("c").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    sums = started(x.groupBy("g", "r", "n").agg(F.count("*").alias("c")), ["g"], "r").where(holds(low) | holds(high)).select(F.col("g").alias("sg"), F.col("r").alias("sr"), F.col("start").alias("base"))
    near = x.join(sums, F.expr("g <=> sg and r = sr")).groupBy("g", "r", "n", "base", "v").agg(F.count("*").alias("c"))
    near = started(near, ["g", "r"], "v").withColumn("start", F.col("start") + F.col("base"))
    out = near.groupBy("g").agg(F.max("n").alias("n"), F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"))
    rank = (F.col("n") - 1) * q
    return out.select(F.col("g").alias(by), (F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))).alias(name))
