"""Stored prices kept up by batches, the trades source, and the table function, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranges
from tidemark.session import ship
from tidemark.sources import bars, trades_source
from tidemark.sources.upkeep import PriceStore

DAY0 = dt.date(2020, 1, 1)
day = lambda i: DAY0 + dt.timedelta(days=i)


def test_statistics_follow_batches(spark, tmp_path):
    r = random.Random(5)
    store, want, log = PriceStore(spark, f"{tmp_path}/store"), {}, []
    touched = {}
    for k in range(1, 5):
        tickers = r.sample("ABCDEFGH", 3 if k > 1 else 7)
        rows = {(t, day(r.randrange(60))): float(k * 100 + i) for t in tickers for i in range(12)}
        store.upsert(spark.createDataFrame([(t, d, v) for (t, d), v in rows.items()], "ticker string, date date, close double"), f"s{k}")
        want |= rows
        for t in tickers:
            mine = [d for u, d in rows if u == t]
            log.append((t, min(mine), max(mine), f"s{k}", len(mine), k))
            touched[t] = k
        assert {(x.ticker, x.date): x.close for x in store.prices().collect()} == want
        stats = {x.ticker: (x.total_records, x.first_date, x.last_date, x.updated) for x in store.stats().collect()}
        assert stats == {t: (len(m := [d for u, d in want if u == t]), min(m), max(m), touched[t]) for t in {u for u, _ in want}}
    assert sorted(map(tuple, store.ranges().collect())) == sorted(log)
    t = log[0][0]
    store.delete(t, str(day(10)), str(day(20)))
    left = {k for k in want if not (k[0] == t and day(10) <= k[1] <= day(20))}
    assert {(x.ticker, x.date) for x in store.prices().collect()} == left
    assert {x.ticker: x.total_records for x in store.stats().collect()}[t] == sum(k[0] == t for k in left)


def test_a_batch_reads_only_its_folders(spark, tmp_path):
    store = PriceStore(spark, f"{tmp_path}/store")
    store.upsert(spark.createDataFrame([(t, day(i), 1.0) for t in "ABCDEF" for i in range(3)], "ticker string, date date, close double"), "all")
    some = store.prices(["B", "E"])
    assert {f.split("ticker=")[1][0] for f in some.inputFiles()} <= set("ABCDEF")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "B" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = spark.read.parquet(f"{tmp_path}/store/prices")
    assert some.select(F.input_file_name().alias("f")).distinct().where("f not rlike 'ticker=[BE]'").count() == 0 and read.count() == 18
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/prices").glob("ticker=[!B]/*.parquet")}
    store.upsert(spark.createDataFrame([("B", day(9), 2.0)], "ticker string, date date, close double"), "one")
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "store/prices").glob("ticker=[!B]/*.parquet")}  # other folders are not written
    assert store.prices(["B"]).count() == 4


def test_conditions_reach_the_trades_source(spark, sf):
    ship(spark)
    reader = trades_source.TradesReader(sf)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

    rest = list(reader.pushFilters([In(("ticker",), ("Brand#11", "Brand#12", "none")), IsNotNull(("px",)), GreaterThan(("date",), dt.date(1996, 1, 1)), LessThanOrEqual(("date",), dt.date(1996, 12, 31)), EqualTo(("ticker",), "Brand#12")]))
    assert [type(f) for f in rest] == [IsNotNull] and [p.ticker for p in reader.partitions()] == ["Brand#12"]
    got = [x for p in reader.partitions() for batch in reader.read(p) for x in batch.column("date").to_pylist()]
    assert got and min(got) > dt.date(1996, 1, 1) and max(got) <= dt.date(1996, 12, 31)
    one = trades_source.trades(spark, sf).where("ticker = 'Brand#12' and date > date'1996-01-01' and date <= date'1996-12-31'")
    assert one.count() == len(got) and one.rdd.getNumPartitions() == 1
    x = trades_source.trades(spark, sf)
    assert x.rdd.getNumPartitions() == 25 and x.count() == bars.trades(spark, sf).count()
    assert trades_source.trades(spark, sf).where("ticker = 'none'").count() == 0


def test_missing_ranges_by_hand(spark):
    ship(spark)
    ranges.register(spark)
    rows = [("a", dt.date(2024, 1, 1)), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 2)), ("a", dt.date(2024, 1, 10)), ("a", None), ("b", dt.date(2024, 1, 6)), (None, dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 3))]
    spark.createDataFrame(rows, "k string, d date").createOrReplaceTempView("some_dates")
    got = {tuple(x) for x in spark.sql("SELECT key, start_date, end_date, n FROM missing_ranges(TABLE(SELECT k, d FROM some_dates) PARTITION BY k ORDER BY d)").collect()}
    # the 6th and 7th are a weekend, which parts the run
    assert got == {("a", dt.date(2024, 1, 3), dt.date(2024, 1, 5), 3), ("a", dt.date(2024, 1, 8), dt.date(2024, 1, 9), 2), (None, dt.date(2024, 1, 2), dt.date(2024, 1, 2), 1)}


@pytest.mark.parametrize("seed", range(3))
def test_missing_ranges_of_random_dates(spark, seed):
    ship(spark)
    ranges.register(spark)
    r = random.Random(seed)
    dates = sorted({day(r.randrange(200)) for _ in range(60)})
    spark.createDataFrame([("k", d) for d in dates], "k string, d date").createOrReplaceTempView("random_dates")
    got = sorted((x.start_date, x.end_date, x.n) for x in spark.sql("SELECT * FROM missing_ranges(TABLE(SELECT k, d FROM random_dates) PARTITION BY k ORDER BY d)").collect())
    miss = [d for i in range((dates[-1] - dates[0]).days) if (d := dates[0] + dt.timedelta(days=i)) not in dates and d.weekday() < 5]
    want = []
    for d in miss:
        if want and d - want[-1][-1] == dt.timedelta(days=1):
            want[-1].append(d)
        else:
            want.append([d])
    assert got == [(w[0], w[-1], len(w)) for w in want]


def test_cached_frames_run_out(spark, tmp_path):
    from tidemark.sources.upkeep import TtlCache

    t = dt.datetime(2024, 5, 1)
    cache = TtlCache(spark, f"{tmp_path}/cache", dt.timedelta(minutes=10))
    assert cache.get("a", t) is None and cache.info(t).count() == 0
    cache.put("a", spark.range(5), t)
    cache.put("b", spark.range(2), t + dt.timedelta(minutes=8))
    assert cache.get("a", t + dt.timedelta(minutes=10)).count() == 5 and cache.get("a", t + dt.timedelta(minutes=11)) is None
    cache.put("a", spark.range(7), t + dt.timedelta(minutes=12))
    later = t + dt.timedelta(minutes=20)
    assert {x.name: (x.rows, x.age, x.valid) for x in cache.info(later).collect()} == {"a": (7, 480.0, True), "b": (2, 720.0, False)}
    cache.clear(later)
    assert cache.get("a", later).count() == 7 and len(list((tmp_path / "cache").iterdir())) == 1
    cache.invalidate("a")
    assert cache.get("a", later) is None and not list((tmp_path / "cache").iterdir())


def test_exports_quote_what_they_must(spark):
    from tidemark.sources import tables

    df = spark.createDataFrame([("a,b", 1, None), ('say "x"', 2, "plain")], "k string, n int, t string")
    assert sorted(x.line for x in tables.to_csv_lines(df).collect()) == sorted(['"a,b",1,', '"say ""x""",2,plain'])
    assert {x.k: x.record for x in tables.to_records(df, "k").collect()} == {"a,b": {"n": "1", "t": None}, 'say "x"': {"n": "2", "t": "plain"}}
