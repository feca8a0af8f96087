"""Dividends and total return: as-of joins by windows over the union of both sides, never a row-by-row search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(events: DataFrame, prices: DataFrame, how: str = "nearest") -> DataFrame:
    """events(ticker, ex_date, ...) with px_date, px: the nearest bar (a tie takes the later), or the next one (else the last).

    Both sides are stacked and one window a direction carries the bars to the events: one shuffle by ticker.
    """
    p = prices.select("ticker", F.col("date").alias("at"), F.struct(F.col("date").alias("d"), F.col("close").alias("p")).alias("bar"), F.lit(None).cast(events.select(F.struct(*events.columns).alias("e")).schema["e"].dataType).alias("event"))
    e = events.select("ticker", F.col("ex_date").alias("at"), F.lit(None).cast("struct<d:date,p:double>").alias("bar"), F.struct(*events.columns).alias("event"))
    w = Window.partitionBy("ticker").orderBy("at")
    both = p.unionByName(e)
    # equal dates are peers in a range frame, so a bar on the day itself is seen from both sides
    # both frames grow from their order's first row, so each is one running pass
    back = F.last("bar", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    on = F.last("bar", ignorenulls=True).over(Window.partitionBy("ticker").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0))
    x = both.withColumns({"b": back, "n": on}).where("event is not null")
    if how == "nearest":
        later = F.col("b").isNull() | (F.datediff("n.d", "at") <= F.datediff("at", "b.d"))
        pick = F.when(F.col("n").isNotNull() & later, F.col("n")).otherwise(F.col("b"))
    else:
        pick = F.coalesce("n", "b")
    return x.withColumn("pick", pick).select("event.*", F.col("pick.d").alias("px_date"), F.col("pick.p").alias("px"))


def total_return(prices: DataFrame, dividends: DataFrame, reinvest: bool = False) -> DataFrame:
    """ticker, total_return, annualized, dividend_return over the whole series; dividends may be reinvested at the nearest close."""
    ends = prices.groupBy("ticker").agg(F.min("date").alias("d0"), F.max("date").alias("d1"), F.min_by("close", "date").alias("p0"), F.max_by("close", "date").alias("p1"))
    if reinvest:
        shares = asof(dividends, prices).groupBy("ticker").agg(F.exp(F.sum(F.log1p(F.col("amount") / F.col("px")))).alias("x"))
        total = F.coalesce("x", F.lit(1.0)) * F.col("p1") / F.col("p0") - 1
    else:
        shares = dividends.groupBy("ticker").agg(F.sum("amount").alias("x"))
        total = (F.col("p1") - F.col("p0") + F.coalesce("x", F.lit(0.0))) / F.col("p0")
    years = F.datediff("d1", "d0") / 365.25
    out = ends.join(shares, "ticker", "left").withColumns({"total_return": total, "years": years, "price_return": F.col("p1") / F.col("p0") - 1})
    growth = F.when((F.col("years") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), F.try_divide(F.lit(1.0), F.col("years"))) - 1)
    return out.select("ticker", "total_return", "price_return", (F.col("total_return") - F.col("price_return")).alias("income_return"), growth.alias("annualized"))


def dividend_metrics(dividends: DataFrame, prices: DataFrame, end: str) -> DataFrame:
    """Trailing-year dividends, yield on the last close, growth of yearly sums, frequency by the mean gap of days."""
    z = F.lit(end).cast("date")
    w = Window.partitionBy("ticker").orderBy("ex_date")
    d = dividends.withColumn("gap", F.datediff("ex_date", F.lag("ex_date").over(w)))
    base = d.groupBy("ticker").agg(F.count("*").alias("payments"), F.sum("amount").alias("total"), F.sum(F.when(F.col("ex_date") > F.date_sub(z, 365), F.col("amount"))).alias("ttm"), F.avg("gap").alias("gap"))
    yearly = dividends.groupBy("ticker", F.year("ex_date").alias("y")).agg(F.sum("amount").alias("s"))
    growth = yearly.groupBy("ticker").agg((F.pow(F.try_divide(F.max_by("s", "y"), F.min_by("s", "y")), F.try_divide(F.lit(1.0), F.max("y") - F.min("y"))) - 1).alias("growth"))
    last = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("px"))
    often = F.when(F.col("gap") <= 35, "Monthly").when(F.col("gap") <= 100, "Quarterly").when(F.col("gap") <= 200, "Semi-Annual").otherwise("Annual")
    return base.join(growth, "ticker").join(last, "ticker").select("ticker", "payments", "total", "ttm", F.try_divide("ttm", "px").alias("yield"), "growth", often.alias("frequency"))


def year_over_year(prices: DataFrame, dividends: DataFrame, end: str, years: int = 5) -> DataFrame:
    """ticker, year (1: the last 365 days), n, total_return of trailing windows of 365 days; windows of one bar go."""
    rows = F.array(*(F.struct(F.lit(k + 1).alias("year"), F.date_sub(F.lit(end).cast("date"), 365 * (k + 1)).alias("a"), F.date_sub(F.lit(end).cast("date"), 365 * k).alias("z")) for k in range(years)))
    windows = lambda df, c: df.withColumn("w", F.explode(F.filter(rows, lambda x: F.col(c).between(x.a, x.z))))
    p = windows(prices, "date").groupBy("ticker", "w.year").agg(F.count("*").alias("n"), F.min_by("close", "date").alias("p0"), F.max_by("close", "date").alias("p1"))
    d = windows(dividends, "ex_date").groupBy("ticker", "w.year").agg(F.sum("amount").alias("s"))
    return p.where("n >= 2").join(d, ["ticker", "year"], "left").select("ticker", "year", "n", ((F.col("p1") - F.col("p0") + F.coalesce("s", F.lit(0.0))) / F.col("p0")).alias("total_return"))


def next_payments(dividends: DataFrame, metrics: DataFrame, horizon: str) -> DataFrame:
    """ticker, next_date, amount: the last payment's date moved on by the ticker's period, if within the horizon."""
    months = F.when(F.col("frequency") == "Monthly", 1).when(F.col("frequency") == "Quarterly", 3).when(F.col("frequency") == "Semi-Annual", 6).otherwise(12)
    last = dividends.groupBy("ticker").agg(F.max("ex_date").alias("last"), F.max_by("amount", "ex_date").alias("amount"))
    out = last.join(metrics.select("ticker", "frequency"), "ticker").select("ticker", F.add_months("last", months).alias("next_date"), "amount")
    return out.where(F.col("next_date") <= F.lit(horizon).cast("date"))
