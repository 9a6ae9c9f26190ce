"""Where the queries of the engine register, each with its SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x.cast("double"), places) + F.lit(0.0)


def rd(x: str, places: int = 6) -> str:
    """The same in SQL."""
    return f"(round(CAST({x} AS DOUBLE), {places}) + 0.0)"


def drawn(key: str, what: str = "") -> str:
    """The draw of functions.columns in SQL."""
    return f"(CAST('0x' || substr(md5('{what}' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
