"""Exchange holidays by rule, as expressions of a year; special closures must be given as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _date(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def observed(day: Column) -> Column:
    """Saturdays move to Friday, Sundays to Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    first = _date(year, month, 1)
    return F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)).cast("int") + 7 * (n - 1))


def last_monday(year: Column, month: int) -> Column:
    end = F.last_day(_date(year, month, 1))
    return F.date_sub(end, F.weekday(end))


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday, by the anonymous algorithm."""
    f = lambda x: F.floor(x).cast("int")
    a = year % 19
    b, c = f(year / 100), year % 100
    d, e = f(b / 4), b % 4
    g = f((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = f(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = f((a + 11 * h + 22 * m) / 451)
    x = h + m - 7 * n + 114
    return F.make_date(year, f(x / 31), x % 31 + 1)


def holidays(years: DataFrame) -> DataFrame:
    """date, name of the exchange holidays of a frame of years."""
    y = F.col("year")
    named = {
        "new year": F.when(F.weekday(_date(y, 1, 1)) == 5, None).otherwise(observed(_date(y, 1, 1))),
        "king": F.when(y >= 1998, nth_weekday(y, 1, 0, 3)),
        "presidents": nth_weekday(y, 2, 0, 3),
        "good friday": F.date_sub(easter(y), 2),
        "memorial": last_monday(y, 5),
        "juneteenth": F.when(y >= 2022, observed(_date(y, 6, 19))),
        "independence": observed(_date(y, 7, 4)),
        "labor": nth_weekday(y, 9, 0, 1),
        "thanksgiving": nth_weekday(y, 11, 3, 4),
        "christmas": observed(_date(y, 12, 25)),
    }
    rows = F.array(*(F.struct(d.alias("date"), F.lit(n).alias("name")) for n, d in named.items()))
    return years.select(F.explode(rows).alias("h")).select("h.date", "h.name").where("date is not null")


def likely_holiday(day: Column) -> Column:
    """A short rule: January 1, July 4, December 25 and the fourth Thursday of November."""
    md = F.month(day) * 100 + F.day(day)
    return md.isin(101, 704, 1225) | ((F.month(day) == 11) & (F.weekday(day) == 3) & F.day(day).between(22, 28))
