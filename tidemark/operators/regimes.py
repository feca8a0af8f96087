"""Regimes of block returns: by terciles, and by a mixture of normals fitted for all tickers at once.

The mixture's state is a row a ticker: its components as an array. A step of expectation and maximisation is one aggregate over the rows: each
row's shares in the components are sums of a few numbers, combined map-side; the rows never meet.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.upkeep import shared_folder

LEAST_BLOCKS = 24
FLOOR = 1e-6  # least variance, as a share of the series' own
BOUNDS = (0.33, 0.67)


def block_returns(rets: DataFrame, size: int = 21) -> DataFrame:
    """ticker, block (from 0), x: compound returns of whole blocks of `size` rows, of tickers with LEAST_BLOCKS of them."""
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    x = rets.select("ticker", F.floor(n / size).alias("block"), "ret").groupBy("ticker", "block").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("x"), F.count("*").alias("_n")).where(F.col("_n") == size)
    return x.withColumn("_k", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_k") >= LEAST_BLOCKS).select("ticker", "block", "x")


def terciles(blocks: DataFrame) -> DataFrame:
    """blocks with regime: 0 below the lower bound, 1 up to the upper one, 2 from there on."""
    cuts = blocks.groupBy("ticker").agg(*(F.percentile("x", F.lit(q)).alias(c) for q, c in zip(BOUNDS, ("_lo", "_hi"), strict=True)))
    return blocks.join(cuts, "ticker").withColumn("regime", F.when(F.col("x") < F.col("_lo"), 0).when(F.col("x") < F.col("_hi"), 1).otherwise(2)).drop("_lo", "_hi")


def described(marked: DataFrame) -> DataFrame:
    """ticker, regime, mean, variance (of the population), weight of regimes as they were told."""
    n = F.sum("_n").over(Window.partitionBy("ticker"))
    return marked.groupBy("ticker", "regime").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.count("*").alias("_n")).withColumn("weight", F.col("_n") / n).drop("_n")


def start(blocks: DataFrame) -> DataFrame:
    """ticker, floor, parts: the terciles' components, lowest mean first."""
    low = blocks.groupBy("ticker").agg((F.var_pop("x") * FLOOR).alias("floor"))
    d = described(terciles(blocks)).join(low, "ticker")
    return d.groupBy("ticker", "floor").agg(F.array_sort(F.collect_list(F.struct("mean", F.greatest("variance", "floor").alias("variance"), "weight"))).alias("parts"))


def _shares(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """blocks with dense (weight times density of each component) and all, their sum."""
    x = blocks.join(parts, "ticker")
    density = lambda p: p["weight"] / F.sqrt(2 * math.pi * p["variance"]) * F.exp(-F.pow(F.col("x") - p["mean"], F.lit(2)) / (2 * p["variance"]))
    x = x.withColumn("dense", F.transform("parts", density))
    return x.withColumn("all", F.greatest(F.aggregate("dense", F.lit(0.0), lambda s, v: s + v), F.lit(1e-300)))


def step(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """parts after one step, with log_likelihood of those before it."""
    x = _shares(blocks, parts)
    total = x.groupBy("ticker").agg(F.sum(F.log("all")).alias("log_likelihood"), F.count("*").alias("_n"))
    e = x.select("ticker", "floor", "x", "all", F.posexplode("dense").alias("k", "v")).withColumn("r", F.col("v") / F.col("all"))
    s = e.groupBy("ticker", "floor", "k").agg(F.sum("r").alias("r"), F.sum(F.col("r") * F.col("x")).alias("rx"), F.sum(F.col("r") * F.col("x") * F.col("x")).alias("rxx"))
    mean = F.coalesce(F.try_divide("rx", "r"), F.lit(0.0))
    var = F.greatest(F.coalesce(F.try_divide("rxx", "r"), F.lit(0.0)) - mean * mean, F.col("floor"))
    made = s.join(total, "ticker").select("ticker", "floor", "log_likelihood", F.struct("k", mean.alias("mean"), var.alias("variance"), (F.col("r") / F.col("_n")).alias("weight")).alias("p"))
    made = made.groupBy("ticker", "floor", "log_likelihood").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return made.select("ticker", "floor", "log_likelihood", F.transform("p", lambda p: F.struct(p["mean"].alias("mean"), p["variance"].alias("variance"), p["weight"].alias("weight"))).alias("parts"))


def mixture(blocks: DataFrame, rounds: int = 20) -> DataFrame:
    """ticker, floor, log_likelihood (before the last step), parts (by mean) after `rounds` steps from the terciles.

    The state of a round, a row a ticker, is written to the shared folder, which cuts its lineage, and read by the next round.
    """
    spark = blocks.sparkSession
    folder = shared_folder(spark)
    blocks.write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    now = start(blocks)
    for k in range(rounds):
        step(blocks, now.select("ticker", "floor", "parts")).coalesce(1).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
    return now.withColumn("parts", F.array_sort("parts"))


def regimes(blocks: DataFrame, fitted: DataFrame) -> DataFrame:
    """ticker, block, x, regime: the component (by mean, lowest first) that is likeliest for the block."""
    x = _shares(blocks, fitted.select("ticker", "floor", "parts"))
    return x.select("ticker", "block", "x", (F.array_position("dense", F.array_max("dense")) - 1).cast("int").alias("regime"))
