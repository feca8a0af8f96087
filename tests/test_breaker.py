"""The circuit breaker: days composed, a plain fold, and a stream agree."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import breaker
from tidemark.session import ship

T0 = dt.datetime(2024, 3, 1, 22, 0)


def fold(rows, most, pause):
    """outcome by event id, call after call."""
    out, state = {}, {}
    for key, t, i, bad in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        run, until = state.get(key, (0, None))
        if until is not None and t < until:
            out[i] = "rejected"
            continue
        out[i] = "failed" if bad else "ok"
        if bad and (until is not None or run + 1 >= most):
            state[key] = (0, t + dt.timedelta(seconds=pause))
        else:
            state[key] = (run + 1 if bad else 0, None)
    return out


def made(seed, n, gap, share):
    r = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += dt.timedelta(seconds=r.choice([0, 1, gap * r.random()]))
        rows.append((r.choice(["a", "a", "b", None]), t, i, r.random() < share))
    return rows


@pytest.mark.parametrize(("gap", "share", "most", "pause"), [(600, 0.6, 5, 3600.0), (600, 0.9, 2, 200_000.0), (4000, 0.5, 1, 60.0), (30, 0.7, 3, 60.0), (20_000, 0.8, 5, 100_000.0)])
def test_days_composed_equal_a_fold(spark, gap, share, most, pause):
    ship(spark)
    rows = made(int(gap * share), 900, gap, share)
    df = spark.createDataFrame(rows, "k string, t timestamp, id long, bad boolean").withColumns({"outcome_": F.lit(1), "_x": F.lit("own")})
    out = breaker.calls(df, "k", "t", F.col("bad"), ["id"], most, pause)
    assert out.columns == [*df.columns, "outcome"]
    got = {x.id: x.outcome for x in out.where("_x = 'own'").collect()}
    assert got == fold(rows, most, pause) and len(set(got.values())) == 3
    assert breaker.calls(df.limit(0), "k", "t", F.col("bad"), ["id"], most, pause).count() == 0


def test_a_stream_agrees(spark, tmp_path):
    ship(spark)
    rows = made(5, 240, 400, 0.7)
    schema = "k string, t timestamp, id long, bad boolean"
    for n in range(4):  # a file a batch, in order of time
        spark.createDataFrame(rows[60 * n : 60 * n + 60], schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    q = breaker.calls_stream(stream, "k", "t", F.col("bad"), ["id"], 3, 900.0).writeStream.format("memory").queryName("breaker_calls").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {x.id: x.outcome for x in spark.table("breaker_calls").collect()}
    assert got == fold(rows, 3, 900.0)
    batch = spark.createDataFrame(rows, schema)
    assert got == {x.id: x.outcome for x in breaker.calls(batch, "k", "t", F.col("bad"), ["id"], 3, 900.0).collect()}
