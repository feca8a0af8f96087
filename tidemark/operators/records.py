"""Stored series beside prices, small dimensions, run histories and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Funds by sector.
SECTOR_FUNDS = {
    "Technology": "XLK VGT IYW FTEC IGM",
    "Healthcare": "XLV VHT IYH FHLC IBB",
    "Financial": "XLF VFH IYF FNCL KBE",
    "Energy": "XLE VDE IYE FENY XOP",
    "Consumer Discretionary": "XLY VCR IYC FDIS XRT",
    "Consumer Staples": "XLP VDC IYK FSTA IEV",
    "Industrials": "XLI VIS IYJ FIDU ITA",
    "Materials": "XLB VAW IYM FMAT GDX",
    "Real Estate": "XLRE VNQ IYR FREL REM",
    "Utilities": "XLU VPU IDU FUTY XLU",
    "Communication": "XLC VOX IYZ FCOM XLC",
}
#: Names under which metrics are shown.
METRIC_NAMES = {
    "twrr_nominal": "Time Weighted Rate of Return (nominal)",
    "twrr_real": "Time Weighted Rate of Return (real)",
    "final_balance_nominal": "Portfolio End Balance (nominal)",
    "final_balance_real": "Portfolio End Balance (real)",
    "annual_mean_return": "Annual Mean Return (nominal)",
    "annual_volatility": "Annualized Volatility",
    "sharpe_ratio": "Sharpe Ratio",
    "sortino_ratio": "Sortino Ratio",
    "max_drawdown": "Maximum Drawdown",
    "max_drawdown_excl_cashflows": "Maximum Drawdown Excluding Cashflows",
    "safe_withdrawal_rate": "Safe Withdrawal Rate",
    "perpetual_withdrawal_rate": "Perpetual Withdrawal Rate",
}
FALLBACK_RATE = 0.02


def series_range(rows: DataFrame, source: str, start: str, end: str) -> DataFrame:
    """Rows of one source between two dates; both conditions reach the scan of a stored table."""
    return rows.where((F.col("source") == source) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def series_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("rate").alias("mean_rate"), F.min("rate").alias("low"), F.max("rate").alias("high"))


def latest_rate(observations: DataFrame, asked: DataFrame, last: int = 10, fallback: float = FALLBACK_RATE) -> DataFrame:
    """series, rate, as_of, is_fallback: the latest rate that is not missing among a series' `last` observations, else the fallback."""
    w = Window.partitionBy("series").orderBy(F.desc("date"))
    recent = observations.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") <= last) & F.col("rate").isNotNull())
    found = recent.groupBy("series").agg(F.max_by("rate", "date").alias("rate"), F.max("date").alias("as_of"))
    return asked.join(found, "series", "left").select("series", F.coalesce("rate", F.lit(fallback)).alias("rate"), "as_of", F.col("rate").isNull().alias("is_fallback"))


def history_rule(prices: DataFrame, end: str, years: int = 15, limited_under: int = 15) -> DataFrame:
    """Of each ticker: whether its history will do for `years` up to `end`, begins late, or is short: one aggregate."""
    z = F.lit(end).cast("date")
    first, last, n = F.min("date"), F.max("date"), F.count("*")
    asked = F.date_sub(z, years * 365)
    span = lambda a, b: F.datediff(b, a) / 365.25
    enough = (span(first, last) >= years) & (span(F.greatest(first, asked), last) >= years * 0.8) & (last >= F.date_sub(z, 7)) & (n >= years * 252 * 0.8)
    return prices.groupBy("ticker").agg(n.alias("records"), first.alias("first_date"), last.alias("last_date"), span(first, last).alias("years"), enough.alias("sufficient"), (first > F.date_add(asked, 365)).alias("starts_late"), (span(first, last) < limited_under).alias("limited"))


def history_span(prices: DataFrame, members: DataFrame, end: str, least: int = 15, optimal: int = 25, longest: int = 50) -> DataFrame:
    """portfolio, years, start_date, and of its tickers: how many will do for `least` years, begin over a year late, and have rows.

    A book whose tickers all do is read for `optimal` years, any other for `longest`.
    """
    rule = history_rule(prices, end, least).select("ticker", "sufficient", "first_date")
    z = F.lit(end).cast("date")
    x = members.select("portfolio", "ticker").distinct().join(rule, "ticker", "left")
    years = F.when(F.bool_and(F.coalesce("sufficient", F.lit(False))), optimal).otherwise(longest)
    g = x.groupBy("portfolio").agg(years.alias("years"), F.count("*").alias("tickers"), F.count_if("sufficient").alias("sufficient"), F.count("first_date").alias("with_rows"))
    g = g.withColumn("start_date", F.date_sub(z, F.col("years") * 365))
    late = x.join(g.select("portfolio", "start_date"), "portfolio").groupBy("portfolio").agg(F.count_if(F.col("first_date") > F.date_add("start_date", 365)).alias("late"))
    return g.join(late, "portfolio")


def history_rows(prices: DataFrame, members: DataFrame, spans: DataFrame, end: str) -> DataFrame:
    """portfolio, ticker, date, close of each book's span up to `end`."""
    x = prices.select("ticker", "date", "close").join(members.select("portfolio", "ticker").distinct(), "ticker").join(spans.select("portfolio", "start_date"), "portfolio")
    return x.where((F.col("date") >= F.col("start_date")) & (F.col("date") <= F.lit(end).cast("date"))).select("portfolio", "ticker", "date", "close")


def real_values(rows: DataFrame, value: str, inflation: float, periods: int = 252) -> DataFrame:
    """`real`: the value in money of its series' first day, at a yearly inflation."""
    t = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    return rows.withColumn("real", F.col(value) / F.pow(F.lit(1 + inflation), t / periods))


def dimension(rows: DataFrame, name: str, member: str, shown: int) -> DataFrame:
    """name, members (the first `shown`, sorted), n: a small table to broadcast."""
    own = rows.select(name, member).distinct()
    rank = F.row_number().over(Window.partitionBy(name).orderBy(member))
    top = own.withColumn("_rn", rank).groupBy(name).agg(F.sort_array(F.collect_list(F.when(F.col("_rn") <= shown, F.col(member)))).alias("members"), F.count("*").alias("n"))
    return top


def sector_funds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, ts in SECTOR_FUNDS.items() for t in ts.split()], "sector string, fund string")


def named(rows: DataFrame) -> DataFrame:
    """rows(metric, ..) with the metric's name to show; metrics without one are left out."""
    names = rows.sparkSession.createDataFrame(list(METRIC_NAMES.items()), "metric string, name string")
    return rows.join(F.broadcast(names), "metric")


def compared(one: DataFrame, two: DataFrame, higher: list[str]) -> DataFrame:
    """ticker, metric, one (median of its values), two (mean of its values), difference, better by the metric's direction."""
    a = one.groupBy("ticker", "metric").agg(F.median("v").alias("one"))
    c = two.groupBy("ticker", "metric").agg(F.avg("v").alias("two"))
    wins = F.when(F.col("metric").isin(higher), F.col("two") > F.col("one")).otherwise(F.col("two") < F.col("one"))
    return a.join(c, ["ticker", "metric"]).select("ticker", "metric", "one", "two", F.abs(F.col("two") - F.col("one")).alias("difference"), F.when(wins, "two").otherwise("one").alias("better"))


def append_run(history: DataFrame, run: DataFrame) -> DataFrame:
    """The history with the rows of new runs; a run that it holds already is not added again."""
    return history.unionByName(run.join(history.select("run"), "run", "left_anti"))


def regressions(history: DataFrame) -> DataFrame:
    """Change in percent of throughput and memory against the run before. Runs are few: one row each."""
    w = Window.orderBy("run")
    change = lambda c: F.try_divide(F.col(c) - F.lag(c).over(w), F.lag(c).over(w)) * 100
    return history.withColumns({"throughput_change": change("paths_per_second"), "memory_change": change("memory_mb")})


def scored(rows: DataFrame, least: float = 50.0, most_gb: float = 8.0) -> DataFrame:
    """Weighted score of throughput, accuracy, convergence and memory (0.3, 0.3, 0.2, 0.2), and what is required of each."""
    score = 0.3 * F.least(F.lit(1.0), F.col("paths_per_second") / least) + 0.3 * F.col("accuracy") + 0.2 * F.col("convergence") + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("memory_mb") / 2000)
    return rows.withColumns({"score": score, "fast_enough": F.col("paths_per_second") >= least, "small_enough": F.col("memory_mb") / 1024 <= most_gb, "converges": F.col("convergence") >= 0.95, "accurate": F.col("accuracy") >= 0.8})


def scaling(rows: DataFrame, by: str, size: str, cost: str) -> DataFrame:
    """by, n, slope: what a unit of size costs more, by least squares."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(cost, size).alias("slope"))
