"""Column expressions for return statistics. All aggregate in one pass with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def annualized_return(r: str | Column, periods: int = PERIODS) -> Column:
    """Compound growth a year; 0 for no rows."""
    r = col(r)
    return F.coalesce(F.when(F.count(F.lit(1)) > 0, F.exp(F.sum(F.log1p(r)) * periods / F.count(F.lit(1))) - 1), F.lit(0.0))


def volatility(r: str | Column, periods: int = PERIODS) -> Column:
    return F.stddev_samp(col(r)) * F.sqrt(F.lit(float(periods)))


def sharpe(r: str | Column, rf: float = 0.02, periods: int = PERIODS) -> Column:
    r = col(r)
    return F.try_divide(F.avg(r - rf / periods), F.stddev_samp(r)) * F.sqrt(F.lit(float(periods)))


def sortino(r: str | Column, rf: float = 0.02, periods: int = PERIODS) -> Column:
    x = col(r) - rf / periods
    return F.try_divide(F.avg(x), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), 2)))) * F.sqrt(F.lit(float(periods)))


def value_at_risk(r: str | Column, level: float = 0.95) -> Column:
    """Linearly interpolated percentile, exact."""
    return F.percentile(col(r), F.lit(1 - level))


def skew(r: str | Column) -> Column:
    """Bias-adjusted sample skewness; null under 3 rows."""
    n = F.count(col(r))
    return F.when(n > 2, F.skewness(col(r)) * F.sqrt((n * (n - 1)).cast("double")) / F.nullif(n - 2, F.lit(0)))


def kurt(r: str | Column) -> Column:
    """Bias-adjusted excess kurtosis; null under 4 rows."""
    n = F.count(col(r))
    return F.when(n > 3, ((n + 1) * F.kurtosis(col(r)) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def beta(a: str | Column, b: str | Column) -> Column:
    """Slope of a on b; 1 where it is undefined."""
    return F.coalesce(F.try_divide(F.covar_samp(col(a), col(b)), F.var_samp(col(b))), F.lit(1.0))


def rounded(*names: str, digits: int = 6) -> dict[str, Column]:
    return {n: F.round(F.col(n), digits) for n in names}


def significant(name: str, digits: int = 9) -> Column:
    """A value rounded to so many digits, whatever its size."""
    x = F.col(name)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x / unit, digits - 1) * unit).alias(name)


def significant_sql(x: str, digits: int = 9) -> str:
    unit = f"pow(10, floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round({x} / {unit}, {digits - 1}) * {unit} END"
