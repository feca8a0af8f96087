"""Covariance, correlation and portfolio risk in long form: one row for each pair, never a wide matrix."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete_cases(rets: DataFrame) -> DataFrame:
    """Rows of the days on which every ticker has a return."""
    n = rets.agg(F.count_distinct("ticker").alias("k"))
    days = rets.groupBy("date").agg(F.count("*").alias("c")).join(F.broadcast(n)).where("c = k").select("date")
    return rets.join(days, "date", "left_semi")


def return_matrix(rets: DataFrame, least: int = 100) -> DataFrame:
    """Complete cases over the tickers that have `least` returns or more."""
    many = rets.groupBy("ticker").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("ticker")
    return complete_cases(rets.join(many, "ticker", "left_semi"))


def aligned_tails(rets: DataFrame, align: str = "date") -> DataFrame:
    """Series of equal length: by `date`, the days that all share; by `position`, as many last rows of each as the shortest has
    (`place` from 0), whatever their dates."""
    if align == "date":
        return complete_cases(rets)
    least = rets.groupBy("ticker").agg(F.count("*").alias("c")).agg(F.min("c").alias("len"))
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rets.withColumn("_k", k).join(F.broadcast(least)).where("_k <= len").withColumn("place", F.col("len") - F.col("_k")).drop("_k", "len")


def pairs(rets: DataFrame, column: str = "ret", same: bool = True) -> DataFrame:
    """date, a, b, x, y of all pairs of tickers (a <= b, or a < b) with a return on the same day.

    A day's rows meet in one list, as long as there are tickers, and the pairs are read off it where it stands: one shuffle
    of the rows, and what is counted or summed over pairs combines map-side.
    """
    return day_pairs(rets, ["date"], column, (lambda a, b: a <= b) if same else (lambda a, b: a < b))


def day_pairs(rets: DataFrame, keys: list[str], column: str, keep) -> DataFrame:
    """keys, a, b, x, y of the pairs of rows (ticker, column) of each key for which keep(a, b) holds."""
    days = rets.groupBy(*keys).agg(F.collect_list(F.struct(F.col("ticker").alias("t"), F.col(column).alias("v"))).alias("d"))
    left = days.select(*keys, "d", F.explode("d").alias("l"))
    both = left.select(*keys, "l", F.explode(F.filter("d", lambda r: keep(F.col("l.t"), r.t))).alias("r"))
    return both.select(*keys, F.col("l.t").alias("a"), F.col("r.t").alias("b"), F.col("l.v").alias("x"), F.col("r.v").alias("y"))


def covariance(rets: DataFrame) -> DataFrame:
    """a, b, n, cov, corr over the days a pair shares. The join is on the day; pairs aggregate map-side."""
    return pairs(rets).groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), F.corr("x", "y").alias("corr"))


def rank_correlation(rets: DataFrame) -> DataFrame:
    """Spearman: the correlation of average ranks within each ticker's series of shared days."""
    days = complete_cases(rets)
    w = Window.partitionBy("ticker").orderBy("ret")
    ties = Window.partitionBy("ticker", "ret")
    ranked = days.withColumn("rank", F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)
    return pairs(ranked, "rank", same=False).groupBy("a", "b").agg(F.corr("x", "y").alias("spearman"))


def inversions(y: np.ndarray) -> int:
    """Pairs i < j with y[i] > y[j]: two numbers are told apart by the highest bit in which their ranks differ."""
    rank = np.unique(y, return_inverse=True)[1]
    found = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        one, group = rank[order] >> bit & 1, rank[order] >> (bit + 1)
        before = np.cumsum(one) - one
        found += int((before - before[np.searchsorted(group, group)])[one == 0].sum())
    return found


def kendall(rets: DataFrame) -> DataFrame:
    """a, b, n, kendall (tau a: the mean sign of two days' concordance), tau_b (ties left out; null if a series is constant).

    For all pairs of tickers with two shared days at least, each over the days it shares. Discordant days are counted
    from ranks, in n log(n)^2, not by joining days.
    """

    def count(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(d[c], return_inverse=True)[1] for c in "xy")
        order = np.lexsort((y, x))
        tied = lambda k: sum(t * (t - 1) // 2 for t in np.unique(k, return_counts=True)[1].tolist())
        n = len(d)
        every, tx, ty = n * (n - 1) // 2, tied(x), tied(y)
        s = every - tx - ty + tied(x * np.int64(n) + y) - 2 * inversions(y[order])
        free = float(every - tx) * (every - ty)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "n": [n], "kendall": [s / every if every else None], "tau_b": [s / free**0.5 if free else None]})

    p = pairs(rets.where("ret is not null"), same=False)
    return p.groupBy("a", "b").applyInPandas(count, "a string, b string, n long, kendall double, tau_b double").where("n > 1")


def symmetric(cov: DataFrame) -> DataFrame:
    """Both triangles of a pair table."""
    return cov.select("a", "b", "cov").union(cov.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """ticker, marginal (of a unit of weight), contribution (they sum to the deviation) and share (they sum to 1)."""
    wa, wb = weights.select(F.col("ticker").alias("a"), F.col("w").alias("wa")), weights.select(F.col("ticker").alias("b"), F.col("w").alias("wb"))
    row = symmetric(cov).join(wb, "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("s")).join(wa, "a")
    total = row.agg(F.sqrt(F.sum(F.col("s") * F.col("wa"))).alias("sigma"))
    out = row.join(F.broadcast(total))
    return out.select(F.col("a").alias("ticker"), F.try_divide("s", "sigma").alias("marginal"), F.try_divide(F.col("wa") * F.col("s"), F.col("sigma")).alias("contribution"), F.try_divide(F.col("wa") * F.col("s"), F.col("sigma") * F.col("sigma")).alias("share"))


def portfolio_variance(cov: DataFrame, weights: DataFrame) -> DataFrame:
    wa, wb = weights.select(F.col("ticker").alias("a"), F.col("w").alias("wa")), weights.select(F.col("ticker").alias("b"), F.col("w").alias("wb"))
    v = symmetric(cov).join(wa, "a").join(wb, "b").agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("variance"))
    return v.withColumn("sigma", F.sqrt("variance"))


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret: weighted sum over the tickers that have a return; weights stay constant, as if rebalanced daily."""
    return rets.join(weights, "ticker").groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))


def value_at_risk(port: DataFrame, level: float = 0.95, horizon: int = 1) -> DataFrame:
    """Historical and parametric value at risk and the historical shortfall of one return series."""
    z = NormalDist().inv_cdf(1 - level)
    q = port.agg(F.percentile("ret", F.lit(1 - level)).alias("q"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    tail = port.join(F.broadcast(q)).where("ret <= q").agg(F.avg("ret").alias("tail"))
    h = float(horizon)
    return q.join(F.broadcast(tail)).select((F.col("q") * h**0.5).alias("var_hist"), (F.col("m") * h + z * F.col("s") * h**0.5).alias("var_param"), (F.col("tail") * h**0.5).alias("cvar"))


def stress(weights: DataFrame, scenarios: DataFrame) -> DataFrame:
    """scenario, impact: weighted sum of the scenario's returns; a ticker it does not name has 0."""
    names = scenarios.select("scenario").distinct()
    hit = scenarios.join(weights, "ticker", "left").groupBy("scenario").agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("ret")).alias("impact"))
    return names.join(hit, "scenario", "left").select("scenario", F.coalesce("impact", F.lit(0.0)).alias("impact"))


def simulated_var(spark, mean: float, sigma: float, paths: int, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Value at risk of normal draws. A draw depends on its number and the seed only, not on how rows are dealt."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1))
    return spark.range(paths).select((F.lit(mean) + F.lit(sigma) * z).alias("ret")).agg(F.percentile("ret", F.lit(1 - level)).alias("var_sim"), F.count("*").alias("paths"))


def rolling_correlation(both: DataFrame, days: int = 60, by: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """corr of x and y over the last `days` rows of each pair; null until there are as many."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(1 - days, 0)
    return both.withColumn("corr", F.when(F.count("*").over(w) == days, F.corr("x", "y").over(w)))


def stability(both: DataFrame, days: int = 60) -> DataFrame:
    r = rolling_correlation(both, days).where("corr is not null")
    return r.groupBy("a", "b").agg(F.avg("corr").alias("mean"), F.stddev_samp("corr").alias("std"), F.min("corr").alias("low"), F.max("corr").alias("high"), (F.max("corr") - F.min("corr")).alias("spread"))


def edges(cov: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs whose correlation is at least `least` either way: the links of a correlation network."""
    return cov.where(F.col("a") != F.col("b")).where(F.abs("corr") >= least).select("a", "b", "corr")


def low_pairs(cov: DataFrame, most: float = 0.3, least_days: int = 100) -> DataFrame:
    return cov.where("a <> b").where((F.abs("corr") <= most) & (F.col("n") >= least_days)).select("a", "b", "n", "corr").orderBy(F.abs("corr"), "a", "b")


def drawdown_episodes(rets: DataFrame) -> DataFrame:
    """Closed drawdowns of each ticker: peak, trough and recovery dates, depth, days. One that is still open is left out.

    The curve begins at its first growth value. An episode is the rows between two rows at the running maximum; islands
    are numbered by a running count of such rows.
    """
    by = Window.partitionBy("ticker").orderBy("date")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    g = rets.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(upto)))
    g = g.withColumn("peak", F.max("growth").over(upto)).withColumn("dd", F.col("growth") / F.col("peak") - 1)
    g = g.withColumn("top", F.min_by("date", F.struct((-F.col("growth")).alias("g"), "date")).over(upto))
    g = g.withColumn("island", F.sum(F.when(F.col("dd") == 0, 1).otherwise(0)).over(upto))
    down = g.where("dd < 0").groupBy("ticker", "island").agg(F.min("dd").alias("depth"), F.min_by("date", F.struct("dd", "date")).alias("trough"), F.min("date").alias("start"), F.first("top").alias("peak_date"))
    back = g.where("dd = 0").select("ticker", (F.col("island") - 1).alias("island"), F.col("date").alias("recovery"))
    return down.join(back, ["ticker", "island"]).select("ticker", "peak_date", "trough", "recovery", "depth", F.datediff("recovery", "start").cast("long").alias("days"))
