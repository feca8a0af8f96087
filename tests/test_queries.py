"""Every query of the library against its SQL, and the driver entry without the corpus subpackage."""

import decimal
import glob
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def table(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    found = con.execute(catalog.ORACLES[name])
    columns, order = [d[0] for d in found.description], sorted(df.columns)
    assert sorted(columns) == order
    assert table(df.collect(), df.columns, order) == table(found.fetchall(), columns, order)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_and_repeats(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    first = sorted(map(str, df.collect()))
    assert first and first == sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))


def test_entry_without_corpus_operators():
    root = str(Path(__file__).resolve().parents[1])
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert e.corpus is None; q = e.queries(); assert 'pipeline' not in q and len(q) > 100, len(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
