"""Readers of price payloads: JSON texts to the long table, by built-in JSON functions with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_json(payloads: DataFrame, body: str = "body") -> DataFrame:
    """ticker and a map of date to a map of numbered fields (`1. open` ...), all texts; what is no number becomes null."""
    days = payloads.select("ticker", F.explode(F.from_json(body, "map<string, map<string, string>>")).alias("d", "f"))
    num = lambda k, t: F.expr(f"try_cast(f['{k}'] as {t})")
    return days.select("ticker", F.to_date("d").alias("date"), *(num(f"{i}. {n}", "double").alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)), num("5. volume", "bigint").alias("volume"))


def candles(payloads: DataFrame, body: str = "body") -> DataFrame:
    """ticker and parallel arrays t (epoch seconds), o, h, l, c, v, perhaps several a day; resampled to days."""
    kind = "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"
    rows = payloads.select("ticker", F.from_json(body, kind).alias("b")).select("ticker", F.expr("inline(arrays_zip(b.t, b.o, b.h, b.l, b.c, b.v))"))
    ticks = rows.toDF("ticker", "t", "o", "h", "l", "c", "v").withColumn("date", F.to_date(F.timestamp_seconds("t")))
    return ticks.groupBy("ticker", "date").agg(F.min_by("o", "t").alias("open"), F.max("h").alias("high"), F.min("l").alias("low"), F.max_by("c", "t").alias("close"), F.sum("v").cast("long").alias("volume"))


def records(payloads: DataFrame, body: str = "body") -> DataFrame:
    """ticker and an array of records in camel case."""
    kind = "array<struct<date:string,open:double,high:double,low:double,close:double,adjClose:double,volume:bigint>>"
    rows = payloads.select("ticker", F.expr(f"inline(from_json({body}, '{kind}'))"))
    return rows.withColumnRenamed("adjClose", "adj_close").withColumn("date", F.to_date("date"))


def aggregates(payloads: DataFrame, body: str = "body") -> DataFrame:
    """ticker and an array of short records, t in epoch milliseconds; what an empty or missing array holds is no row."""
    kind = "struct<results:array<struct<t:bigint,o:double,h:double,l:double,c:double,v:double>>>"
    rows = payloads.select("ticker", F.explode(F.from_json(body, kind)["results"]).alias("r"))
    return rows.select("ticker", F.to_date(F.timestamp_millis("r.t")).alias("date"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.col("r.v").cast("long").alias("volume"))


def dividend_series(payloads: DataFrame, start: str, end: str, source: str, body: str = "body", frequency: int = 1) -> DataFrame:
    """ticker and a map of date to amount, within the dates given, with the constants that a stored dividend has."""
    rows = payloads.select("ticker", F.explode(F.from_json(body, "map<string, double>")).alias("d", "amount"))
    rows = rows.select("ticker", F.to_date("d").alias("ex_date"), "amount").where(F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.withColumns({"dividend_type": F.lit("regular"), "currency": F.lit("USD"), "frequency": F.lit(frequency), "source": F.lit(source)})


def observations(payloads: DataFrame, body: str = "body", percent: bool = False) -> DataFrame:
    """series and an array of date, value records; `.` is missing; percent turns percents to shares."""
    rows = payloads.select("series", F.expr(f"inline(from_json({body}, 'array<struct<date:string,value:string>>'))"))
    value = F.expr("try_cast(nullif(value, '.') as double)")
    return rows.select("series", F.to_date("date").alias("date"), (value / 100 if percent else value).alias("value")).where("value is not null")


def splits(events: DataFrame) -> DataFrame:
    """ticker, date, ratio to action rows; ratios under 1 are reverse splits, told the other way round."""
    r = F.col("ratio")
    back = r < 1
    return events.where("ratio > 0").select(
        "ticker", "date", F.when(back, "reverse_split").otherwise("split").alias("action"),
        F.when(back, 1 / r).otherwise(F.lit(1.0)).alias("ratio_from"), F.when(back, F.lit(1.0)).otherwise(r).alias("ratio_to"),
        F.when(back, F.format_string("1:%.0f reverse split", 1 / r)).otherwise(F.format_string("%.0f:1 split", r)).alias("description"),
    )


def corporate_actions(events: DataFrame) -> DataFrame:
    """Splits as actions with `recency`, 1 for a ticker's latest; dividends are no part of it."""
    latest = Window.partitionBy("ticker").orderBy(F.desc("date"), "ratio_from", "ratio_to")
    return splits(events).withColumn("recency", F.row_number().over(latest))
