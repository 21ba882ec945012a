"""Where queries are registered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """The columns, doubles rounded, and counts as longs."""
    kinds = dict(df.dtypes)

    def one(c: str) -> Column:
        kind = kinds[c]
        return F.round(F.col(c), digits).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint", "bigint") else F.col(c)

    return df.select(*map(one, columns or df.columns))
