"""Queries over all pairs of tickers, against brute force."""

from collections import defaultdict
from itertools import combinations
from math import sqrt

import numpy as np
import pytest

from tidemark import catalog
from tidemark.operators import risk
from tidemark.session import ship

sign = lambda v: (v > 0) - (v < 0)


def test_inversions():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 60):
        y = r.integers(0, 12, n)
        assert risk.inversions(y) == sum(y[i] > y[j] for i, j in combinations(range(n), 2))


def test_kendall_of_all_pairs(spark):
    ship(spark)
    r = np.random.default_rng(2)
    rows = [(t, d, float(r.integers(-4, 5)) if t != "flat" else 0.0) for t in ("p", "q", "r", "s", "flat") for d in range(40) if r.random() < 0.8]
    rows += [("single", 3, 1.0), ("p", 99, None)]
    by = defaultdict(dict)
    for t, d, x in rows:
        if x is not None:
            by[t][d] = x
    want = {}
    for a, b in combinations(sorted(by), 2):
        days = sorted(by[a].keys() & by[b].keys())
        both = [(sign(by[a][i] - by[a][j]), sign(by[b][i] - by[b][j])) for i, j in combinations(days, 2)]
        if both:
            s, free = sum(x * y for x, y in both), sum(x != 0 for x, _ in both) * sum(y != 0 for _, y in both)
            want[a, b] = len(days), pytest.approx(s / len(both)), pytest.approx(s / sqrt(free)) if free else None
    got = {(x.a, x.b): (x.n, x.kendall, x.tau_b) for x in risk.kendall(spark.createDataFrame(rows, "ticker string, date int, ret double")).collect()}
    assert got == want and len(got) == 10


def test_queries_have_all_pairs(spark, sf):
    ship(spark)
    for name in ("a12_kendall_all_pairs", "w4_rolling_correlation_all_pairs"):
        assert catalog.QUERIES[name](spark, sf).select("a", "b").distinct().count() == 300, name
