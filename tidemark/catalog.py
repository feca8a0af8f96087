"""All queries of the library by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.bars import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a1_ticker_performance"


def query(name: str, oracle: str | None = None, base: bool = True):
    """Register a query; oracle is SQL over the tables (with the market tables as common table expressions if base)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            body = oracle.strip()
            if base:
                start = next((k for k in ("WITH RECURSIVE ", "WITH ") if body.startswith(k)), "")
                body = f"{start or 'WITH '}{SQL}{', ' if start else ' '}{body[len(start):]}"
            ORACLES[name] = body
        return f

    return add


from tidemark.plans import allocation, calendar, income, ingest, market, models, paths, portfolio_risk, records, upkeep  # noqa: E402, F401
