"""Changes of stored tables as plans: upsert, insert if absent, delete by range, time-to-live; written as whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str = "ingested") -> DataFrame:
    """Rows of both, of each key the one with the latest stamp (new before old among equals)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(stamp), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def delete_range(rows: DataFrame, ticker: str, start: str, end: str) -> DataFrame:
    return rows.where(~((F.col("ticker") == ticker) & F.col("date").between(start, end)))


def alive(rows: DataFrame, stamp: str, now, ttl: str) -> DataFrame:
    """Rows younger than the time to live."""
    return rows.where(F.col(stamp) > now - F.expr(f"interval {ttl}"))


def write_partitioned(rows: DataFrame, path: str, by: str = "ticker") -> None:
    """Parquet, one folder for each value of `by`, each folder written by few tasks; only the given partitions are replaced."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def to_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def to_csv_lines(rows: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """A line of comma-separated values a row; values with commas, quotes or breaks are quoted."""
    return rows.select(F.to_csv(F.struct(*rows.columns), options or {"quote": '"', "escape": '"'}).alias("line"))


def to_records(rows: DataFrame, by: str) -> DataFrame:
    """by, record: the other columns of a row as a map from name to text (null where it is null)."""
    others = [c for c in rows.columns if c != by]
    return rows.select(by, F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(F.col(c).cast("string") for c in others))).alias("record"))
