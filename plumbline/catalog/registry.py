"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FAMILY: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int | None = None, floats: str = ""):
    """Register ``fn(spark, folder)``. With ``digits``, the float columns are rounded alike in both engines."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark, folder: str) -> DataFrame:
            out = fn(spark, folder)
            return rounded(out, digits) if digits is not None else out

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        FAMILY[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            SQL[name] = rounded_sql(sql, floats.split(), digits) if digits is not None else sql
        return fn

    return register


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round double columns; adding zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ])


def rounded_sql(sql: str, floats: list[str], digits: int) -> str:
    if not floats:
        return sql
    parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in floats)
    return f"SELECT * REPLACE ({parts}) FROM (\n{sql}\n)"
