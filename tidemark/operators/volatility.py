"""GARCH(1,1) fits of many series at a time, each in a task of its own; the likelihood of given parameters as DataFrame operations.

A ticker's series is what the calendar bounds, some thousands of rows, and the variance of a row needs that of the row before: the fit reads
a series as one array, and different tickers go to different tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import volatility as vol
from tidemark.sources.bars import by_date

LEAST = 50
FIT = "ticker string, n long, method string, mean double, omega double, alpha double, beta double, log_likelihood double, aic double, bic double, last_volatility double, next_volatility double, arch_p double, serial_p double, left_arch_p double, left_serial_p double"


def fits(rets: DataFrame, fallback: str = "ewma") -> DataFrame:
    """The fit of each ticker's returns; under LEAST rows a ticker is left out.

    arch_p and serial_p test the returns about the mean, left_.. the same over their fitted deviation. A fit whose search does not end gives
    way to an exponential average of variance (`ewma`) or to one variance for all rows (`constant`), without parameters.
    """

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("date")["ret"].to_numpy(float)
        y = y[np.isfinite(y)]
        if len(y) < LEAST:
            return pd.DataFrame(columns=[c.split()[0] for c in FIT.split(", ")])
        params, like, done = vol.garch(y)
        n = len(y)
        if done:
            v = vol.variances(y, params[None])[:, 0]
            known = [*params.tolist(), like, 2 * 4 - 2 * like, 4 * math.log(n) - 2 * like]
        else:
            v = vol.ewma_variances(y) if fallback == "ewma" else np.full(n, y.var(ddof=1))
            known = [float(y.mean())] + [None] * 6
        e = y - known[0]
        z = e / np.sqrt(np.where(v > 0, v, 1.0))
        after = params[1] + params[2] * e[-1] ** 2 + params[3] * v[-1] if done else v[-1]
        row = [rows["ticker"].iloc[0], n, "garch" if done else fallback, *known, math.sqrt(v[-1]), math.sqrt(after), vol.arch_p(e), vol.serial_p(e), vol.arch_p(z), vol.serial_p(z)]
        return pd.DataFrame([row], columns=[c.split()[0] for c in FIT.split(", ")])

    return rets.select("ticker", "date", "ret").groupBy("ticker").applyInPandas(fit, FIT)


def likelihood(rets: DataFrame, params: DataFrame, block: int = 64) -> DataFrame:
    """ticker, n, log_likelihood, last_variance of params(ticker, mean, omega, alpha, beta), without Python.

    The variance is linear in the one before, v' = beta v + u: inside a block of rows it is a sum of powers of beta; from block to block the
    (few) starts are folded in order. The first row starts from a falling average of the first squares.
    """
    by = by_date()
    x = rets.select("ticker", "date", "ret").join(params, "ticker").withColumns({"_n": F.row_number().over(by) - 1, "_e": F.pow(F.col("ret") - F.col("mean"), F.lit(2))})
    w = F.when(F.col("_n") < vol.BACKCAST_ROWS, F.pow(F.lit(vol.BACKCAST), F.col("_n")))
    x = x.withColumn("_first", F.sum(w * F.col("_e")).over(Window.partitionBy("ticker")) / F.sum(w).over(Window.partitionBy("ticker")))
    x = x.withColumn("_u", F.col("omega") + F.when(F.col("_n") == 0, (F.col("alpha") + F.col("beta")) * F.col("_first")).otherwise(F.col("alpha") * F.lag("_e").over(by)))
    x = x.withColumns({"_b": F.floor(F.col("_n") / block), "_k": F.col("_n") % block})
    inside = F.collect_list("_u").over(Window.partitionBy("ticker", "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))  # `block` values at most
    x = x.withColumn("_in", F.aggregate(inside, F.lit(0.0), lambda s, u: s * F.col("beta") + u))
    ends = x.groupBy("ticker", "_b").agg(F.max_by("_in", "_k").alias("c"), F.pow(F.first("beta"), F.count("*")).alias("a"))
    chain = F.sort_array(F.collect_list(F.struct("_b", "a", "c")).over(Window.partitionBy("ticker").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    starts = ends.select("ticker", "_b", F.aggregate(chain, F.lit(0.0), lambda v, e: e["a"] * v + e["c"]).alias("_start"))
    x = x.join(starts, ["ticker", "_b"]).withColumn("_v", F.col("_in") + F.col("_start") * F.pow("beta", F.col("_k") + 1))
    ll = -0.5 * F.sum(math.log(2 * math.pi) + F.log("_v") + F.col("_e") / F.col("_v"))
    return x.groupBy("ticker").agg(F.count("*").alias("n"), ll.alias("log_likelihood"), F.max_by("_v", "_n").alias("last_variance"))


def forecast(fitted: DataFrame, days: int) -> DataFrame:
    """ticker, day (1..days), volatility: the expected variance goes to its long-run level with alpha + beta; without parameters it stays."""
    x = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    p, v = F.col("alpha") + F.col("beta"), F.pow("next_volatility", F.lit(2))
    level = F.col("omega") / (1 - p)
    return x.select("ticker", "day", F.when(F.col("alpha").isNull(), F.col("next_volatility")).otherwise(F.sqrt(level + F.pow(p, F.col("day") - 1) * (v - level))).alias("volatility"))
