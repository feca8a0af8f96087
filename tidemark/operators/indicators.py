"""Technical indicators and fills along each ticker's series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.splines import cubic
from tidemark.sources.bars import by_date


def rows(n: int):
    return by_date().rowsBetween(1 - n, 0)


def full(x: Column, n: int) -> Column:
    """x, or null until n rows are there."""
    return F.when(F.count("*").over(rows(n)) == n, x)


def sma(prices: DataFrame, n: int = 20) -> DataFrame:
    return prices.withColumn("sma", full(F.avg("close").over(rows(n)), n))


def ema(prices: DataFrame, n: int = 20) -> DataFrame:
    """Exponential average, seeded with the mean of the first n closes; null before, so those rows are left out.

    In closed form, the sum of u(j) * (1 - a)^(t - j), with the seed as first term: running sums over blocks of rows that are short
    enough for the powers to stay exact, and of the blocks before only the few that still weigh more than rounding does.
    """
    a = 2 / (n + 1)
    block = max(1, int(14 / -math.log(1 - a))) if a < 1 else 1
    at = F.row_number().over(by_date()) - n
    x = prices.withColumns({"_at": at, "_mean": F.avg("close").over(rows(n))}).where("_at >= 0")
    x = x.withColumns({"_b": F.floor(F.col("_at") / block), "_pos": F.col("_at") % block, "_u": F.when(F.col("_at") == 0, F.col("_mean")).otherwise(F.col("close") * a)})
    keep = lambda k: F.pow(F.lit(1 - a), k) if a < 1 else F.when(k == 0, 1.0).otherwise(0.0)
    inside = Window.partitionBy("ticker", "_b").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_in", F.sum(F.col("_u") / keep(F.col("_pos"))).over(inside) * keep(F.col("_pos")) if block > 1 else F.col("_u"))
    ends = x.groupBy("ticker", "_b").agg(F.max_by("_in", "_pos").alias("end"))
    carried = F.aggregate(F.collect_list("end").over(Window.partitionBy("ticker").orderBy("_b").rowsBetween(-3, -1)), F.lit(0.0), lambda acc, e: acc * (1 - a) ** block + e)
    before = ends.select("ticker", "_b", carried.alias("_carry"))
    return x.join(before, ["ticker", "_b"]).select("ticker", "date", (F.col("_in") + keep(F.col("_pos") + 1) * F.col("_carry")).alias("ema"))


def rsi(prices: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by plain averages of the last n gains and losses; 100 without losses."""
    d = prices.withColumn("d", F.col("close") - F.lag("close").over(by_date())).where("d is not null")
    gain, loss = F.avg(F.greatest("d", F.lit(0.0))).over(rows(n)), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(rows(n))
    x = d.withColumns({"gain": full(gain, n), "loss": full(loss, n)})
    return x.select("ticker", "date", F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss"))).alias("rsi"))


def ewma_variance(rets: DataFrame, decay: float = 0.94) -> DataFrame:
    """Bias-corrected exponentially weighted variance at each ticker's last day, from weighted sums: no recursion."""
    age = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1
    x = rets.withColumn("v", F.pow(F.lit(decay), age))
    s = x.groupBy("ticker").agg(F.sum("v").alias("v1"), F.sum(F.col("v") * F.col("v")).alias("v2"), F.sum(F.col("v") * F.col("ret")).alias("m"), F.sum(F.col("v") * F.col("ret") * F.col("ret")).alias("q"))
    biased = F.col("q") / F.col("v1") - F.pow(F.col("m") / F.col("v1"), 2)
    return s.select("ticker", (biased * F.try_divide(F.col("v1") * F.col("v1"), F.col("v1") * F.col("v1") - F.col("v2"))).alias("ewma_var"))


def fill_gaps(panel: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Nulls of `column` filled forward, at most `limit` in a row (`ffill`), and by straight lines between neighbours (`linear`).

    Lines reach up to `limit` rows from the known row before or after; outside the known range the nearest value is used.
    """
    p = panel.withColumn("rn", F.row_number().over(by_date()))
    back, on = (Window.partitionBy("ticker").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("date", F.desc("date")))
    known = F.when(F.col(column).isNotNull(), F.struct("rn", F.col(column).alias("v")))
    p = p.withColumns({"a": F.last(known, ignorenulls=True).over(back), "z": F.last(known, ignorenulls=True).over(on)})
    near = (F.col("rn") - F.col("a.rn") <= limit) | (F.col("z.rn") - F.col("rn") <= limit)
    line = F.when(F.col("a").isNull(), F.col("z.v")).when(F.col("z").isNull(), F.col("a.v")).when(F.col("a.rn") == F.col("z.rn"), F.col("a.v")).otherwise(F.col("a.v") + (F.col("z.v") - F.col("a.v")) * (F.col("rn") - F.col("a.rn")) / F.nullif(F.col("z.rn") - F.col("a.rn"), F.lit(0)))
    return p.withColumns({"ffill": F.when(F.col("rn") - F.col("a.rn") <= limit, F.col("a.v")), "linear": F.coalesce(F.col(column), F.when(near, line))}).drop("a", "z", "rn")


def fill_cubic(panel: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """ticker, date, `column` and cubic: nulls filled by the cubic spline through the known rows, by their numbers in the series.

    Up to `limit` rows from the known row before or after, and between known rows only; straight lines where a ticker knows under four
    rows. The spline's equations go from one end of a series to the other: a ticker's rows, which the calendar bounds, are
    solved in one task.
    """

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date").reset_index(drop=True)
        y = rows[column].to_numpy(float)
        n = np.arange(len(y))
        known = np.flatnonzero(~np.isnan(y))
        made = y.copy()
        if len(known):
            before = n - np.maximum.accumulate(np.where(np.isnan(y), -10**9, n))
            after = np.minimum.accumulate(np.where(np.isnan(y), 10**9, n)[::-1])[::-1] - n
            want = np.isnan(y) & ((before <= limit) | (after <= limit))
            made[want] = cubic(known, y[known], n[want])
        return pd.DataFrame({"ticker": rows["ticker"], "date": rows["date"], column: rows[column], "cubic": pd.Series(made).astype(object).where(~np.isnan(made), None)})

    kind = panel.schema["date"].dataType.simpleString()
    return panel.select("ticker", "date", F.col(column).cast("double").alias(column)).groupBy("ticker").applyInPandas(fill, f"ticker string, date {kind}, {column} double, cubic double")


def autocorrelation(rets: DataFrame, lags: int = 50) -> DataFrame:
    """ticker, lag, rho for lags 1..lags: every row meets its own later rows by position; one equi-join on shifted numbers."""
    n = rets.withColumn("rn", F.row_number().over(by_date())).select("ticker", "rn", "ret")
    shifted = n.select("ticker", F.col("ret").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "rn").select("ticker", "y", "lag", (F.col("rn") - F.col("lag")).alias("rn"))
    return n.join(shifted, ["ticker", "rn"]).groupBy("ticker", "lag").agg(F.corr("ret", "y").alias("rho"), F.count("*").alias("n"))


def decay_rate(rho: DataFrame) -> DataFrame:
    """How fast the size of autocorrelations falls with the lag: minus the slope of its logarithm."""
    return rho.groupBy("ticker").agg((-F.regr_slope(F.log(F.abs("rho") + 1e-10), F.col("lag"))).alias("decay"))


def first_of_period(dates: DataFrame, unit: str) -> DataFrame:
    """Dates that begin a period among the dates given: a new month, quarter or year; for weeks, Mondays only."""
    if unit == "week":
        return dates.where("weekday(date) = 0")
    p = F.date_trunc(unit, "date")
    # the earliest date of each period, without an order over all dates
    return dates.groupBy(p.alias("p")).agg(F.min("date").alias("date")).select("date")


def latest(rows_: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ties must be settled by the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows_.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
