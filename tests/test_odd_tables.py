"""Queries against their SQL on tables that the given ones do not hold."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from test_queries import table
from tidemark import catalog
from tidemark.operators import portfolio
from tidemark.session import ship
from tidemark.sources import bars, trades_source


def same_as_sql(spark, folder, name):
    """The query's rows, which are those of its SQL over the folder."""
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, found = catalog.QUERIES[name](spark, str(folder)), c.execute(catalog.ORACLES[name])
    columns, order = [d[0] for d in found.description], sorted(df.columns)
    rows = df.collect()
    assert table(rows, df.columns, order) == table(found.fetchall(), columns, order)
    return rows


def noon(y, m, d):
    return dt.datetime(y, m, d, 12)


def test_a_family_that_falls_below_nothing(spark, tmp_path):
    """Eleven members at 19% fall by 80% in one quarter, so the book is below 0 at the next rebalance, and again at the one after."""
    brands = [f"Brand#{k}" for k in (1, *range(10, 20), 3)]
    days = [(noon(1995, 7, 3), 100.0), (noon(1995, 8, 1), 60.0), (noon(1995, 10, 2), 20.0), (noon(1995, 11, 1), 30.0), (noon(1996, 1, 2), 4.0), (noon(1996, 2, 1), 8.0)]
    lines = [(order, k, 1, 1, 2.0, 2 * price, day) for order, (day, price) in enumerate(days) for k in range(len(brands))]
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    pq.write_table(pa.table(dict(zip(columns, zip(*lines)))), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": list(range(len(brands))), "p_brand": brands, "p_retailprice": [1.0] * len(brands)}), tmp_path / "part.parquet")
    rows = same_as_sql(spark, tmp_path, "b9_backtest")
    after = [r.log_value for r in rows if r.portfolio == "Brand#1" and r.date >= dt.date(1995, 10, 2)]
    assert len(after) == 4 and all(v != v for v in after)


def test_walks_without_a_unit_root(spark, tmp_path):
    """Walks that go back to their mean each day, which a test tells as stationary; one has too few days for a test."""
    rng, rows = np.random.default_rng(3), []
    for priority, n in (("a", 400), ("b", 400), ("c", 5)):
        moves = np.diff(np.concatenate([[0], rng.integers(0, 90, n)]))
        rows += [(2 * i + int(m < 0), abs(int(m)), noon(1995, 1, 1) + dt.timedelta(days=i), priority) for i, m in enumerate(moves)]
    pq.write_table(pa.table(dict(zip(["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], zip(*rows)))), tmp_path / "orders.parquet")
    assert {r.ticker: r.n for r in same_as_sql(spark, tmp_path, "m8_stationary")} == {"a": 399, "b": 399, "c": 4}


def test_an_asset_has_one_mean(spark):
    """Assets of a book that are seen on different days: what a pair shares does not change the mean, whatever order rows come in."""
    ship(spark)
    rng = np.random.default_rng(5)
    days = [dt.date(1996, 1, 1) + dt.timedelta(days=k) for k in range(200)]
    rows = [("x", t, day, float(r)) for t, mean in (("a", 0.01), ("b", 0.02), ("c", 0.015)) for day, r in zip(days, rng.normal(mean, 0.3, 200)) if rng.random() < 0.4]
    mom = portfolio.moments(spark.createDataFrame(rows, "portfolio string, ticker string, date date, ret double"))
    got = {t: {x.mean for x in mom.collect() if x.a == t} for t in "abc"}
    assert {t: len(v) for t, v in got.items()} == {"a": 1, "b": 1, "c": 1}
    assert [got[t].pop() for t in "abc"] == pytest.approx([252 * np.mean([r[3] for r in rows if r[1] == t]) for t in "abc"])
    for order in (["a", "b"], [mom.a.desc(), mom.b.desc()]):
        w = portfolio.optimized(mom.coalesce(1).sortWithinPartitions(*order), "max_sharpe")
        assert portfolio.optimality(mom, w, 0.02).first().excess < 1e-3


def test_bars_of_ticks_with_ties_and_nulls(spark, sf):
    """Two passes give the bars of one; the first, which sees all ticks, does not sort them."""
    rng = np.random.default_rng(9)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [(pick("a", "b", None), pick(dt.date(1996, 1, 1), dt.date(1996, 1, 2), None), pick(1.0, 2.5, 7.0, None), 2.0, (pick(1, 2, 3, None), pick(1, 2, None), pick(5.0, 6.0))) for _ in range(120)]
    rows.append(("null keys", None, 3.0, None, (None, None, 1.0)))
    ticks = spark.createDataFrame(rows, "ticker string, date date, px double, qty double, key struct<o: long, n: int, p: double>")
    for more in ([], ["qty"]):
        order = ["ticker", "date", *more, "open", "high", "low", "close", "volume"]
        one, two = (table(f(ticks, *more).collect(), order, order) for f in (bars.resample_daily, bars.resample_many))
        assert len(one) >= 10 and one == two
    plan = bars.fresh_bars(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert [line.lstrip(" :+-").split("(")[0] for line in plan.splitlines() if "partial_sum(qty" in line] == ["HashAggregate"]


def test_a_reader_holds_a_batch(tmp_path):
    """A row group of two million trades: a ticker's reader takes its own ones, and memory for a batch only."""
    n = 2_000_000
    k = np.arange(n)
    day = np.datetime64("1995-01-01T00:00:00", "us") + (k % 100).astype("timedelta64[D]")
    lines = {"l_orderkey": k, "l_partkey": k % 4, "l_linenumber": (k % 7).astype(np.int32), "l_quantity": (k % 3).astype(float), "l_extendedprice": k * 1.5, "l_shipdate": day}
    pq.write_table(pa.table(lines), tmp_path / "lineitem.parquet", row_group_size=n)
    pq.write_table(pa.table({"p_partkey": [0, 1, 2, None], "p_brand": ["a", "b", "a", "a"]}), tmp_path / "part.parquet")
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    try:
        reader = trades_source.TradesReader(str(tmp_path))
        reader.low = dt.date(1995, 2, 1)
        got = [(b.num_rows, pc.sum(b.column("orderkey")).as_py()) for p in reader.partitions() if p.ticker == "a" for b in reader.read(p)]
    finally:
        pa.set_memory_pool(before)
    want = k[np.isin(k % 4, (0, 2)) & (k % 3 > 0) & (k % 100 >= 31)]
    assert (sum(x for x, _ in got), sum(x for _, x in got)) == (len(want), want.sum())
    assert pool.max_memory() < 32 << 20


def test_optimisers_share_a_matrix(spark):
    """All kinds of optimiser are solved from one plan of a book's moments."""
    prices = spark.createDataFrame([("a", dt.date(1996, 1, 1), 1.0)], "ticker string, date date, close double")
    w = portfolio.optimizer_weights(prices, spark.createDataFrame([("p", "a")], "portfolio string, ticker string"), prices.select("date"), days=2)
    assert w._jdf.queryExecution().analyzed().toString().count("FlatMapGroupsInPandas") == 2
    assert sorted((r.strategy, r.w) for r in w.collect()) == [("max_sharpe", 1.0), ("min_variance", 1.0), ("risk_parity", 1.0)]
