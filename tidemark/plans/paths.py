"""Simulated paths. Every path is a row of its own, drawn from a hash of (seed, path, block): any task can draw it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import paths as p
from tidemark.operators import risk
from tidemark.plans.market import rnd
from tidemark.sources import bars as b

Spark = SparkSession
PATHS, DAYS, BLOCK = 2000, 504, 21


def _paths(spark: Spark, d: str) -> DataFrame:
    return p.block_bootstrap(risk.portfolio_returns(b.returns(spark, d), b.weights(spark, d)), PATHS, DAYS, BLOCK)


@query("r1_block_bootstrap")
def r1_block_bootstrap(spark: Spark, d: str) -> DataFrame:
    """Of each path: final growth, volatility, largest drawdown."""
    return rnd(p.path_metrics(_paths(spark, d)), "growth", "volatility", "max_drawdown")


@query("a30_outcome_percentiles")
def a30_outcome_percentiles(spark: Spark, d: str) -> DataFrame:
    return rnd(p.percentile_table(p.path_metrics(_paths(spark, d)), ["growth", "volatility", "max_drawdown"]), "value")


@query("a31_percentile_paths")
def a31_percentile_paths(spark: Spark, d: str) -> DataFrame:
    return rnd(p.percentile_paths(_paths(spark, d)), "p10", "p50", "p90")
