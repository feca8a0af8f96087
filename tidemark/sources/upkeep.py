"""A stored price table with its range log and ticker statistics, kept up batch by batch.

Prices lie in a folder for each ticker. A batch reads and rewrites the folders of its own tickers only; the statistics of these are
made anew from the rows just written, the others' rows are carried over. The log gets a row for each ticker of a batch.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

STATS = "ticker string, total_records long, first_date date, last_date date, updated int"
LOG = "ticker string, start_date date, end_date date, source string, record_count long, batch int"


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: below spark.checkpoint.dir, or a private one on a single machine."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base}/tidemark-{uuid.uuid4().hex}"


class PriceStore:
    """prices(ticker, date, ..), ranges (the log) and stats below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.batch = 0

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def prices(self, tickers: list[str] | None = None) -> DataFrame:
        """All prices, or those of some tickers: their folders alone are listed and read."""
        df = self._read("prices").withColumn("ticker", F.col("ticker").cast("string"))
        return df if tickers is None else df.where(F.col("ticker").isin(tickers))

    def stats(self) -> DataFrame:
        """ticker, total_records, first_date, last_date, updated (the batch that last changed it)."""
        return self._read(f"stats/{self.batch}")

    def ranges(self) -> DataFrame:
        return self._read("ranges")

    def changed(self, batch: DataFrame) -> list[str]:
        """The tickers of a batch: as many as folders that it writes."""
        return [r.ticker for r in batch.select("ticker").distinct().collect()]

    def upsert(self, batch: DataFrame, source: str) -> None:
        """Put in the rows of batch(ticker, date, ..), which replace those of the same ticker and day; of two for a day, any."""
        names = self.changed(batch)
        new = batch.dropDuplicates(["ticker", "date"])
        rows = new
        if self.batch:
            rows = self.prices(names).select(*batch.columns).join(new, ["ticker", "date"], "left_anti").unionByName(new)
        staged = f"{self.folder}/staged/{self.batch + 1}"  # a folder can't be read and replaced at once
        rows.write.parquet(staged)
        self._finish(self.spark.read.schema(rows.schema).parquet(staged), names)
        log = new.groupBy("ticker").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.lit(source).alias("source"), F.count("*").alias("record_count"), F.lit(self.batch).alias("batch"))
        log.coalesce(1).write.mode("append").parquet(f"{self.folder}/ranges")

    def delete(self, ticker: str, start: str, end: str) -> None:
        """Take out a ticker's rows from start to end."""
        staged = f"{self.folder}/staged/{self.batch + 1}"
        rows = tables.delete_range(self.prices([ticker]), ticker, start, end)
        rows.write.parquet(staged)
        self._finish(self.spark.read.schema(rows.schema).parquet(staged), [ticker])

    def _finish(self, rows: DataFrame, names: list[str]) -> None:
        """Replace the folders of `names` by rows, and bring the statistics up to them."""
        tables.write_partitioned(rows, f"{self.folder}/prices")
        fresh = rows.groupBy("ticker").agg(F.count("*").alias("total_records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.lit(self.batch + 1).alias("updated"))
        kept = self.stats().where(~F.col("ticker").isin(names)) if self.batch else fresh.limit(0)
        kept.unionByName(fresh).coalesce(1).write.parquet(f"{self.folder}/stats/{self.batch + 1}")
        self.batch += 1


class TtlCache:
    """Frames stored by name below one folder, each good for a time from when it was put.

    A version is a folder; what the driver keeps is a name, a time and a number of rows for each. The time is the caller's.
    """

    def __init__(self, spark: SparkSession, folder: str, ttl: dt.timedelta):
        self.spark, self.folder, self.ttl = spark, folder, ttl
        self._log: dict[str, tuple[str, dt.datetime, int]] = {}

    def put(self, name: str, df: DataFrame, now: dt.datetime) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{version}")
        self.invalidate(name)
        self._log[name] = version, now, self.spark.read.parquet(f"{self.folder}/{version}").count()

    def get(self, name: str, now: dt.datetime) -> DataFrame | None:
        """What was put under the name, or None if nothing was, or its time is over."""
        found = self._log.get(name)
        return None if found is None or now - found[1] > self.ttl else self.spark.read.parquet(f"{self.folder}/{found[0]}")

    def invalidate(self, name: str) -> None:
        """Forget a name, and remove its files."""
        found = self._log.pop(name, None)
        if found:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{found[0]}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self, now: dt.datetime | None = None) -> None:
        """Forget all names, or only those whose time is over."""
        for name in [n for n, (_, at, _) in self._log.items() if now is None or now - at > self.ttl]:
            self.invalidate(name)

    def info(self, now: dt.datetime) -> DataFrame:
        """name, rows, age in seconds, valid."""
        rows = [(n, k, (now - at).total_seconds(), now - at <= self.ttl) for n, (_, at, k) in self._log.items()]
        return self.spark.createDataFrame(rows, "name string, rows long, age double, valid boolean")
