"""Least squares for many groups at once: sums of products in one aggregate, solved by sweeping the small matrix.

The matrix of a group is the sums of products of its columns, target last. Sweeping its pivots one after the other leaves the
coefficients in the last column and the squares that remain at the last place. So one aggregate, combined map-side, fits all
nested models of a group; rows are never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import by_date

LAGS = 5
CLIP = 5.0
#: MacKinnon's response surface for the p-value of a unit-root statistic, one series, with a constant.
ADF_LOW, ADF_SPLIT, ADF_HIGH = -18.83, -1.61, 2.74
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def products(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, n, m: the symmetric matrix of sums of products of the columns."""
    k = len(columns)
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
    at = lambda i, j: F.col(f"_s{min(i, j)}_{max(i, j)}")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *sums).select(*keys, "n", F.array(*(F.array(*(at(i, j) for j in range(k))) for i in range(k))).alias("m"))


def sweep(m: Column, k: Column) -> Column:
    """m after pivot k (from 0): a Gauss-Jordan step. A pivot of 0 makes the matrix null."""
    row = F.get(m, k)
    pivot = F.get(row, k)

    def line(r: Column, i: Column) -> Column:
        return F.transform(r, lambda x, j: F.when(i == k, F.try_divide(x, pivot)).otherwise(x - F.get(r, k) * F.try_divide(F.get(row, j), pivot)))

    return F.transform(m, line)


def swept(m: Column, pivots: Column) -> Column:
    """m after all pivots of an array of numbers, in their order."""
    return F.aggregate(pivots, m, sweep)


def corner(m: Column) -> Column:
    """The squares that are left: the last place of the matrix."""
    return F.element_at(F.element_at(m, -1), -1)


def clipped(series: DataFrame, column: str = "ret", most: float = CLIP) -> DataFrame:
    """ticker, date, y: values held within `most` deviations of their ticker's mean; nulls and rows that are no numbers are left out."""
    by = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    y = F.col(column).cast("double")
    x = series.where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))).select("ticker", "date", y.alias("y"))
    x = x.withColumns({"_m": F.avg("y").over(by), "_d": F.coalesce(F.stddev_samp("y").over(by), F.lit(0.0)) * most})
    return x.select("ticker", "date", F.greatest(F.col("_m") - F.col("_d"), F.least(F.col("_m") + F.col("_d"), F.col("y"))).alias("y"))


def lagged(series: DataFrame, lags: int = LAGS) -> DataFrame:
    """series(ticker, date, y) with place (from 1 in a ticker), one (1.0), and l1.. (y of the rows before; 0 where there is none)."""
    x = series.withColumn("place", F.row_number().over(by_date()))
    return x.withColumns({"one": F.lit(1.0)} | {f"l{k}": F.coalesce(F.lag("y", k).over(by_date()), F.lit(0.0)) for k in range(1, lags + 1)})


def _ladder(df: DataFrame, pivots: int, skip: int) -> DataFrame:
    """df(.., m) with `left`: the squares left after `skip` pivots, and after each further one, up to `pivots`."""
    none = F.expr("cast(array() as array<double>)")
    step = lambda s, k: F.struct(sweep(s["m"], k).alias("m"), F.concat(s["left"], F.array(corner(s["m"]))).alias("left"))
    state = F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), F.struct(F.col("m").alias("m"), none.alias("left")), step, lambda s: F.concat(s["left"], F.array(corner(s["m"]))))
    return df.withColumn("left", F.slice(state, skip + 1, pivots - skip + 1))


def ar_orders(x: DataFrame, lags: int = LAGS) -> DataFrame:
    """ticker, lags, n, rss, aic of each order 0..lags over the rows that all orders can use (x: from `lagged`).

    aic = ln(rss / n) + 2 (lags + 1) / n; a ticker with fewer rows than twice the terms is left out.
    """
    m = _ladder(products(x.where(F.col("place") > lags), ["ticker"], ["one", *(f"l{k}" for k in range(1, lags + 1)), "y"]), lags + 1, 1)
    each = m.where(F.col("n") > 2 * (lags + 1)).select("ticker", "n", F.posexplode("left").alias("lags", "rss"))
    return each.select("ticker", "lags", "n", "rss", (F.log(F.col("rss") / F.col("n")) + 2 * (F.col("lags") + 1) / F.col("n")).alias("aic"))


def chosen(orders: DataFrame, least: int = 1) -> DataFrame:
    """ticker, lags: the order of least aic (the smallest of equal ones), and `least` at least."""
    return orders.groupBy("ticker").agg(F.greatest(F.min_by("lags", F.struct("aic", "lags")), F.lit(least)).alias("lags"))


def ar_fit(x: DataFrame, orders: DataFrame, lags: int = LAGS) -> DataFrame:
    """ticker, lags, n, const, coef (l1 first), rss, r2, aic, bic, hqic of each ticker's order, over all rows that it can use."""
    own = x.join(orders, "ticker").where(F.col("place") > F.col("lags"))
    terms = ["one", *(f"l{k}" for k in range(1, lags + 1)), "y"]
    m = products(own, ["ticker", "lags"], terms)
    solved = m.withColumn("_m", swept(F.col("m"), F.sequence(F.lit(0), F.col("lags"))))
    value = F.transform(F.col("_m"), lambda r: F.element_at(r, -1))
    total = F.col("m")[lags + 1][lags + 1] - F.pow(F.col("m")[0][lags + 1], 2) / F.col("n")
    out = solved.select("ticker", "lags", "n", F.element_at(value, 1).alias("const"), F.slice(value, F.lit(2), F.col("lags")).alias("coef"), corner(F.col("_m")).alias("rss"), total.alias("_total"))
    base, k = F.log(F.col("rss") / F.col("n")), F.col("lags") + 1
    out = out.withColumns({"r2": 1 - F.try_divide("rss", "_total"), "aic": base + 2 * k / F.col("n"), "bic": base + F.log("n") * k / F.col("n"), "hqic": base + 2 * F.log(F.log("n")) * k / F.col("n")})
    return out.drop("_total")


def ar_residuals(x: DataFrame, fit: DataFrame, lags: int = LAGS) -> DataFrame:
    """ticker, date, fitted, residual, z (over its deviation, which counts as 1 if it is 0) of all rows that the order can use."""
    y = x.join(fit.select("ticker", "lags", "const", "coef", F.sqrt(F.col("rss") / F.col("n")).alias("_d")), "ticker").where(F.col("place") > F.col("lags"))
    fitted = sum((F.coalesce(F.get("coef", F.lit(k - 1)), F.lit(0.0)) * F.col(f"l{k}") for k in range(1, lags + 1)), F.col("const"))
    y = y.withColumn("fitted", fitted).withColumn("residual", F.col("y") - F.col("fitted"))
    return y.select("ticker", "date", "fitted", "residual", (F.col("residual") / F.when(F.col("_d") > 0, F.col("_d")).otherwise(1.0)).alias("z"))


def ar_diagnostics(residuals: DataFrame) -> DataFrame:
    """ticker, n, residual_mean, residual_std and the correlation of neighbouring residuals."""
    x = residuals.withColumn("_before", F.lag("residual").over(by_date()))
    return x.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("residual").alias("residual_mean"), F.stddev_pop("residual").alias("residual_std"), F.corr("residual", "_before").alias("lag1_corr"))


def normal_cdf(x: Column) -> Column:
    """The normal distribution, from a continued fraction in the tail and a series in the middle (13 digits)."""
    a = F.abs(x)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    tail = a + 0.0
    for k in range(40, 0, -1):
        tail = a + k / tail if k < 40 else a + F.lit(40.0) / (a + 1)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("t"), a.alias("s")), lambda c, k: F.struct((c["t"] * a * a / (2 * k + 1)).alias("t"), (c["s"] + c["t"] * a * a / (2 * k + 1)).alias("s")))["s"]
    above = F.when(a > 37, 0.0).when(a > 2.5, density / tail).otherwise(0.5 - density * series)
    return F.when(x > 0, 1 - above).otherwise(above)


def adf_pvalue(t: Column) -> Column:
    """The approximate p-value of a unit-root statistic."""
    poly = lambda c: sum((F.lit(b) * F.pow(t, i) for i, b in enumerate(c)), F.lit(0.0))
    return F.when(t > ADF_HIGH, 1.0).when(t < ADF_LOW, 0.0).otherwise(normal_cdf(F.when(t <= ADF_SPLIT, poly(ADF_SMALL)).otherwise(poly(ADF_LARGE))))


def unit_root(series: DataFrame, lags: int = LAGS) -> DataFrame:
    """ticker, lags, n, statistic, p_value: the augmented Dickey-Fuller test with a constant, of series(ticker, date, y).

    The number of lagged differences (0..lags) has the least aic over the rows that all can use; the statistic then uses all
    rows that it can. The level comes last, so its pivot is what is left of its squares, which gives the coefficient's error.
    """
    x = series.select("ticker", "date", "y", F.lag("y").over(by_date()).alias("level")).where("level is not null")
    x = lagged(x.select("ticker", "date", (F.col("y") - F.col("level")).alias("y"), "level"), lags)
    terms = [f"l{k}" for k in range(1, lags + 1)]
    common = products(x.where(F.col("place") > lags), ["ticker"], ["one", "level", *terms, "y"]).where(F.col("n") > 2 * (lags + 2))
    ladder = _ladder(common, lags + 2, 2)
    each = ladder.select("ticker", "n", F.posexplode("left").alias("lags", "rss"))
    best = each.groupBy("ticker").agg(F.min_by("lags", F.struct((F.col("n") * F.log(F.col("rss") / F.col("n")) + 2 * (F.col("lags") + 2)).alias("aic"), "lags")).alias("lags"))
    own = products(x.join(best, "ticker").where(F.col("place") > F.col("lags")), ["ticker", "lags"], ["one", *terms, "level", "y"])
    q = lags + 1
    before = own.withColumn("_m", swept(F.col("m"), F.sequence(F.lit(0), F.col("lags"))))
    before = before.select("ticker", "lags", "n", F.col("_m")[q][q].alias("d"), F.col("_m")[q][q + 1].alias("c"), corner(F.col("_m")).alias("r"))
    slope = F.try_divide("c", "d")
    rss = F.col("r") - slope * F.col("c")
    out = before.select("ticker", "lags", "n", (slope / F.sqrt(rss / (F.col("n") - F.col("lags") - 2) / F.col("d"))).alias("statistic"))
    return out.withColumn("p_value", adf_pvalue(F.col("statistic")))


def differences(series: DataFrame) -> DataFrame:
    """ticker, date, y: what each row of series(ticker, date, y) adds to the one before; a ticker's first has none."""
    return series.select("ticker", "date", (F.col("y") - F.lag("y").over(by_date())).alias("y")).where("y is not null")


def stationary(series: DataFrame, tests: DataFrame, most: float = 0.05) -> DataFrame:
    """series(ticker, date, y), with differences in place of the values of tickers whose unit root is not rejected."""
    x = series.withColumn("_d", F.col("y") - F.lag("y").over(by_date())).join(tests.select("ticker", (F.col("p_value") > most).alias("_root")), "ticker", "left")
    return x.select("ticker", "date", F.when(F.coalesce("_root", F.lit(False)), F.col("_d")).otherwise(F.col("y")).alias("y")).where("y is not null")
