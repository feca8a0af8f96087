"""Withdrawal rates over all historic start days, and drawdowns of a balance with cash flows; running sums, no simulation.

A plan takes the same sum at the start of each of `years` years and ends when the last has passed. With A(y) the price y years on,
it can take 100 / S percent, S = sum of A(0) / A(y) over the years, until nothing is left, and 100 (1 - keep A(0) / A(years)) / S if
`keep` of the start is to be left. A bisection from 0 to 50 percent finds the largest step of its last grid below that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import by_date

HIGHEST = 50.0
PERCENTILES = (10, 25, 50, 75, 90)


def grid_step(precision: float) -> float:
    """The width at which a bisection from 0 to HIGHEST stops."""
    step = HIGHEST
    while step > precision:
        step /= 2
    return step


def on_grid(rate: Column, precision: float, strict: bool) -> Column:
    """The largest step below `rate` (strict), or up to it, from 0 to the last but one."""
    step = grid_step(precision)
    steps = F.ceil(rate / step) - 1 if strict else F.floor(rate / step)
    return F.greatest(F.lit(0.0), F.least(F.lit(HIGHEST - step), steps * step))


def rates(prices: DataFrame, years: int, stride: int = 252, precision: float = 0.01, keep: float = 1.0) -> DataFrame:
    """ticker, date (the start), safe, perpetual: percent of the start that a plan from each day can take.

    Rows a year apart have the same number modulo `stride`; along them the reciprocals of a plan are a window of `years` rows.
    Days without `years` more years have no row.
    """
    x = prices.where("close > 0").select("ticker", "date", "close").withColumn("_n", F.row_number().over(by_date()))
    along = Window.partitionBy("ticker", F.col("_n") % stride).orderBy("_n")
    x = x.withColumns({"_s": F.col("close") * F.sum(1 / F.col("close")).over(along.rowsBetween(0, years - 1)), "_end": F.lead("close", years).over(along)}).where("_end is not null")
    perpetual = 100 * (1 - keep * F.col("close") / F.col("_end")) / F.col("_s")
    return x.select("ticker", "date", on_grid(100 / F.col("_s"), precision, True).alias("safe"), on_grid(perpetual, precision, False).alias("perpetual"))


def rate_percentiles(found: DataFrame) -> DataFrame:
    """ticker, starts, and the percentiles of both rates. A group's state is the grid's steps at most."""
    q = lambda c: [F.percentile(c, F.lit(p / 100)).alias(f"{c}_{p}") for p in PERCENTILES]
    return found.groupBy("ticker").agg(F.count("*").alias("starts"), *q("safe"), *q("perpetual"))


def balances(prices: DataFrame, flows: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """ticker, date, value: what `initial` on the first day has become, with flows(ticker, date, amount) paid in (or out) at each
    day's close. A day's flow counts from the next day on.

    Each flow buys amount / close units, so the value is the price times a running sum of units: linear in the series, and
    flows of any size neither lose digits nor overflow with the length.
    """
    paid = flows.groupBy("ticker", "date").agg(F.sum("amount").alias("_paid"))
    x = prices.where("close > 0").select("ticker", "date", "close").join(paid, ["ticker", "date"], "left")
    bought = F.coalesce(F.sum(F.coalesce("_paid", F.lit(0.0)) / F.col("close")).over(by_date().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = F.first("close").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return x.select("ticker", "date", (F.col("close") * (initial / first + bought)).alias("value"))


def worst_drawdown(values: DataFrame) -> DataFrame:
    """ticker, drawdown (percent) and its day: the largest fall of values from their highest so far; the earliest of equal ones."""
    peak = F.max("value").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    x = values.withColumn("_d", (peak - F.col("value")) / peak * 100)
    return x.groupBy("ticker").agg(F.max("_d").alias("drawdown"), F.max_by("date", F.struct("_d", (-F.datediff("date", F.lit("1970-01-01"))).alias("e"))).alias("date"))
