"""A table function for SQL: the runs of missing weekdays of each partition of dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class MissingRanges:
    """key, start_date, end_date, n between the first and last date of a partition; weekends part a run.

    Rows of (key, date) come by partition in order of dates; nulls and repeated dates are passed over. State is the date before.
    """

    def __init__(self) -> None:
        self.last: dt.date | None = None

    def eval(self, row) -> Iterator[tuple]:
        key, date = row[0], row[1]
        if date is None:
            return
        if self.last is not None:
            day, start = self.last + dt.timedelta(days=1), None
            while day <= date:
                if day < date and day.weekday() < 5:
                    start = start or day
                elif start is not None:
                    end = day - dt.timedelta(days=1)
                    yield key, start, end, (end - start).days + 1
                    start = None
                day += dt.timedelta(days=1)
        self.last = date


def register(spark: SparkSession) -> None:
    """missing_ranges(TABLE(..) PARTITION BY .. ORDER BY ..) in the session's SQL."""
    spark.udtf.register("missing_ranges", udtf(MissingRanges, returnType="key string, start_date date, end_date date, n int"))
