"""The trades as a Python data source: one partition a ticker, conditions on ticker and date pushed into the reads.

For tables that Python can open: `spark.read.format("tidemark_trades").option("path", folder).load()`. Conditions on the ticker leave
its partitions alone; those on the date go into the scan of the file. A reader holds a batch of rows and its ticker's part keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "ticker string, date date, px double, qty double, orderkey long, linenumber int, partkey long, price double"
BATCH, BUFFER = 1 << 16, 1 << 18  # rows of a batch, bytes read at once of a column
_PUSH = "spark.sql.python.filterPushdown.enabled"


class TickerPartition(InputPartition):
    def __init__(self, ticker: str):
        super().__init__(ticker)
        self.ticker = ticker


class TradesReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.only: set[str] | None = None
        self.low: dt.date | None = None
        self.high: dt.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what it can apply as a whole; gives back the rest."""
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("ticker",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.only = wanted if self.only is None else self.only & wanted
            elif name == ("date",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                day = dt.timedelta(days=1)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = value + day if isinstance(f, GreaterThan) else value
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = value - day if isinstance(f, LessThan) else value
                    self.high = high if self.high is None else min(self.high, high)
            else:
                yield f

    def _batches(self, name: str, columns: list[str], only: ds.Expression | None = None) -> Iterator[list[pa.Array]]:
        """The columns of a table, a batch at a time, without row groups that `only` rules out by their statistics.

        Pages are read through a small buffer and decoded as batches ask for them: a dataset's scanner decodes whole row groups, and
        several ahead, so its memory follows the size of the file.
        """
        table = ds.dataset(f"{self.folder}/{name}.parquet", format="parquet")
        for fragment in table.get_fragments():
            groups = [g.id for g in (fragment if only is None else fragment.subset(only, schema=table.schema)).row_groups]
            with table.filesystem.open_input_file(fragment.path) as f:
                file = pq.ParquetFile(f, buffer_size=BUFFER, pre_buffer=False)
                for batch in file.iter_batches(BATCH, row_groups=groups, columns=columns, use_threads=False):
                    yield [batch.column(c) for c in columns]

    def partitions(self) -> list[TickerPartition]:
        tickers: set[str | None] = set()
        for (brand,) in self._batches("part", ["p_brand"]):
            tickers.update(pc.unique(brand).to_pylist())
        return [TickerPartition(t) for t in sorted(t for t in tickers if t is not None) if self.only is None or t in self.only] or [TickerPartition("")]

    def read(self, partition: TickerPartition) -> Iterator[pa.RecordBatch]:
        own = [part.filter(pc.equal(brand, partition.ticker)).drop_null() for part, brand in self._batches("part", ["p_partkey", "p_brand"])]
        keys = np.unique(np.concatenate([x.to_numpy() for x in own if len(x)] or [np.empty(0, np.int64)]))
        if not len(keys):
            return
        day, wanted = ds.field("l_shipdate"), None
        low = None if self.low is None else dt.datetime.combine(self.low, dt.time())
        high = None if self.high is None else dt.datetime.combine(self.high + dt.timedelta(days=1), dt.time())
        if low is not None:
            wanted = day >= low
        if high is not None:
            wanted = day < high if wanted is None else wanted & (day < high)
        columns = ["l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey"]
        for found in self._batches("lineitem", columns, wanted):
            ship, _, qty, _, _, part = found
            at = pc.fill_null(part, keys[-1]).to_numpy(zero_copy_only=False)
            kept = pc.and_(pc.greater(qty, 0), pa.array(keys[np.minimum(np.searchsorted(keys, at), len(keys) - 1)] == at))
            kept = pc.and_(kept, part.is_valid())
            if low is not None:
                kept = pc.and_(kept, pc.greater_equal(ship, pa.scalar(low, ship.type)))
            if high is not None:
                kept = pc.and_(kept, pc.less(ship, pa.scalar(high, ship.type)))
            ship, price, qty, order, line, part = (c.filter(kept) for c in found)
            if len(ship):
                made = [pa.repeat(partition.ticker, len(ship)), ship.cast(pa.date32(), safe=False), pc.divide(price, qty), qty, order, line, part, price]
                yield pa.RecordBatch.from_arrays(made, [c.split()[0] for c in SCHEMA.split(", ")])


class TradesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_trades"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TradesReader:
        return TradesReader(self.options["path"])


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """The trades of a folder through the source, in the columns that `bars.resample_daily` takes.

    A frame is for one query: Spark keeps the conditions that were pushed with the loaded source, so load it anew for other ones.
    """
    spark.dataSource.register(TradesSource)
    spark.conf.set(_PUSH, "true")
    x = spark.read.format("tidemark_trades").option("path", folder).load()
    return x.withColumn("key", F.struct("orderkey", "linenumber", "partkey", "price", "qty"))
