"""Returns, cleaning and per-ticker statistics. All windows are by ticker, so nothing is gathered beyond one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.quantiles import quantile
from tidemark.sources.bars import by_date


def to_date() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("ticker")
LIMITS = (-0.5, 2.0)


def usable(prices: DataFrame, least_prices: int = 252, least_returns: int = 50) -> DataFrame:
    """Clipped returns of positive prices, of tickers with enough of both."""
    clean = prices.where("close > 0").withColumn("n_prices", F.count("*").over(whole())).where(F.col("n_prices") >= least_prices)
    r = clean.withColumn("ret", F.col("close") / F.lag("close").over(by_date()) - 1).where("ret is not null")
    clipped = r.withColumn("ret", F.greatest(F.lit(LIMITS[0]), F.least(F.lit(LIMITS[1]), F.col("ret"))))
    return clipped.withColumn("n", F.count("*").over(whole())).where(F.col("n") >= least_returns).select("ticker", "date", "ret")


def consistent() -> Column:
    """Whether a bar's prices agree with each other and are positive."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h >= low) & (h >= F.greatest(o, c)) & (low <= F.least(o, c)) & (o > 0) & (h > 0) & (low > 0) & (c > 0)


def clean(prices: DataFrame, jump: float = 0.5) -> DataFrame:
    """Consistent bars after a change of at most `jump`; a ticker's first bar has no change and goes."""
    filled = prices.withColumn("close", F.last("close", ignorenulls=True).over(to_date()))
    change = F.abs(F.col("close") / F.lag("close").over(by_date()) - 1)
    return filled.withColumn("change", change).where(F.col("change") <= jump).where(consistent()).drop("change")


def standardized(prices: DataFrame) -> DataFrame:
    """Adjusted close defaults to close, volume to 0 and to whole numbers."""
    adj = F.coalesce("adj_close", "close") if "adj_close" in prices.columns else F.col("close")
    return prices.withColumns({"adj_close": adj, "volume": F.coalesce("volume", F.lit(0)).cast("long")})


def clip_outliers(rets: DataFrame, sigmas: float) -> DataFrame:
    """Returns within mean +- sigmas deviations of their ticker; rows that are not finite go."""
    finite = rets.where("ret is not null and not isnan(ret) and abs(ret) < double('infinity')")
    m, s = F.avg("ret").over(whole()), F.stddev_samp("ret").over(whole())
    wide = finite.withColumns({"m": m, "s": F.coalesce(s, F.lit(0.0))})
    return wide.withColumn("clipped", F.greatest(F.col("m") - sigmas * F.col("s"), F.least(F.col("m") + sigmas * F.col("s"), F.col("ret")))).drop("m", "s")


def rescale_small(rets: DataFrame, below: float = 0.01) -> DataFrame:
    """Percent in place of shares where a ticker's deviation is small."""
    return rets.withColumn("scaled", F.when(F.stddev_samp("ret").over(whole()) < below, F.col("ret") * 100).otherwise(F.col("ret")))


def normalized(prices: DataFrame) -> DataFrame:
    """Percent from the first close."""
    return prices.withColumn("pct", (F.col("close") / F.first("close").over(to_date()) - 1) * 100)


def downsample(prices: DataFrame, most: int, keep_last: bool = True) -> DataFrame:
    """Every k-th bar of each ticker, such that at most `most` (and perhaps the last) remain."""
    n = F.count("*").over(whole())
    rn = F.row_number().over(by_date())
    marked = prices.withColumns({"n": n, "rn": rn}).withColumn("k", F.ceil(F.col("n") / most))
    pick = (F.col("rn") - 1) % F.col("k") == 0
    return marked.where(pick | (F.col("rn") == F.col("n")) if keep_last else pick).drop("n", "rn", "k")


def cumulative(rets: DataFrame) -> DataFrame:
    """Growth of 1, running maximum (at least the start) and drawdown (not positive) along each series."""
    g = rets.withColumn("growth", F.exp(F.sum(F.log1p("ret")).over(to_date())))
    g = g.withColumn("peak", F.greatest(F.lit(1.0), F.max("growth").over(to_date())))
    return g.withColumn("drawdown", F.col("growth") / F.col("peak") - 1)


def performance(rets: DataFrame) -> DataFrame:
    """Annualised return and volatility, Sharpe, Sortino, maximum drawdown and Calmar of each ticker.

    The drawdown's window and the aggregate share the partitioning by ticker: one shuffle.
    """
    out = cumulative(rets).groupBy("ticker").agg(
        F.count("*").alias("n"),
        stats.annualized_return("ret").alias("ann_return"),
        stats.volatility("ret").alias("ann_vol"),
        stats.sharpe("ret").alias("sharpe"),
        stats.sortino("ret").alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
    )
    return out.withColumn("calmar", F.try_divide(F.col("ann_return"), F.abs("max_drawdown")))


def expected_shortfall(rets: DataFrame, level: float = 0.95) -> DataFrame:
    """var and cvar (mean of returns at or below var) of each ticker."""
    cut = F.percentile("ret", F.lit(1 - level)).over(whole())
    return rets.withColumn("cut", cut).groupBy("ticker").agg(F.first("cut").alias("var"), F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret"))).alias("cvar"))


def against(rets: DataFrame, benchmark: str, rf: float = 0.02) -> DataFrame:
    """Information ratio, beta, alpha and Treynor ratio of each ticker on the days it shares with the benchmark."""
    b = rets.where(F.col("ticker") == benchmark).select("date", F.col("ret").alias("bench"))
    both = rets.where(F.col("ticker") != benchmark).join(b, "date")
    r, m = "ret", "bench"
    a = both.groupBy("ticker").agg(
        F.count("*").alias("n"),
        stats.annualized_return(F.greatest(F.col(r) - F.col(m), F.lit(-0.999999))).alias("active"),
        stats.volatility(F.greatest(F.col(r) - F.col(m), F.lit(-0.999999))).alias("te"),
        stats.beta(r, m).alias("beta"),
        stats.annualized_return(r).alias("ar"),
        stats.annualized_return(m).alias("ab"),
    )
    return a.select(
        "ticker",
        "n",
        "beta",
        F.coalesce(F.try_divide(F.col("active"), F.col("te")), F.lit(0.0)).alias("information_ratio"),
        (F.col("ar") - (rf + F.col("beta") * (F.col("ab") - rf))).alias("alpha"),
        F.try_divide(F.col("ar") - rf, F.col("beta")).alias("treynor"),
    )


def period_returns(prices: DataFrame, unit: str) -> DataFrame:
    """Last close of each week (labelled by its Sunday), month or year, and its change from the period before."""
    p = F.date_trunc(unit, "date").cast("date")
    p = F.date_add(p, 6) if unit == "week" else p
    last = prices.groupBy("ticker", p.alias("period")).agg(F.max_by("close", "date").alias("close"))
    return last.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("period")) - 1)


def block_returns(rets: DataFrame, days: int = 21) -> DataFrame:
    """Compound returns of consecutive blocks of days; the last block, full or not, goes when no more days follow it."""
    rn = F.row_number().over(by_date()) - 1
    n = F.count("*").over(whole())
    b = rets.withColumns({"rn": rn, "n": n}).withColumn("block", F.floor(F.col("rn") / days))
    return b.where(F.col("block") * days < F.col("n") - days).groupBy("ticker", "block").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"))


def winsorized(rets: DataFrame, share: float = 0.05) -> DataFrame:
    """rets with each ticker's values held between its quantiles `share` and 1 - `share`."""
    low, high = (quantile(rets, "ticker", "ret", q, name) for q, name in ((share, "_low"), (1 - share, "_high")))
    x = rets.join(low, "ticker").join(high, "ticker")
    return x.withColumn("ret", F.greatest("_low", F.least("_high", F.col("ret")))).drop("_low", "_high")


def without_extremes(rets: DataFrame, most: float = 5.0) -> DataFrame:
    """rets without the rows beyond `most` deviations (of the population) of their ticker; if these are over half of its rows, they
    are held at the bounds and stay."""
    by = Window.partitionBy("ticker")
    x = rets.withColumns({"_m": F.avg("ret").over(by), "_d": F.stddev_pop("ret").over(by) * most, "_n": F.count("*").over(by)})
    x = x.withColumn("_far", F.coalesce(F.abs(F.col("ret") - F.col("_m")) > F.col("_d"), F.lit(False)))
    x = x.withColumn("_clip", F.count_if("_far").over(by) * 2 > F.col("_n"))
    held = F.greatest(F.col("_m") - F.col("_d"), F.least(F.col("_m") + F.col("_d"), F.col("ret")))
    return x.where("not _far or _clip").withColumn("ret", F.when(F.col("_clip"), held).otherwise(F.col("ret"))).drop("_m", "_d", "_n", "_far", "_clip")
