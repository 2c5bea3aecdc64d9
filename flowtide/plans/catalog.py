"""Query catalog: every operator over the given tables, with the same question in plain SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtide.functions.expressions import col

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def num(name: str | Column, digits: int = 6) -> Column:
    """Rounded double for comparison; avoids negative zero."""
    value = col(name) if isinstance(name, str) else name
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def big(name: str | Column) -> Column:
    value = col(name) if isinstance(name, str) else name
    return value.cast("bigint")


def text(name: str | Column) -> Column:
    value = col(name) if isinstance(name, str) else name
    return value.cast("string")


def pick(df: DataFrame, texts=(), bigs=(), nums=(), digits: int = 6, bools=(), **extra: Column) -> DataFrame:
    """Projection to plain comparable types."""
    return df.select(
        *[text(c).alias(c) for c in texts], *[big(c).alias(c) for c in bigs], *[num(c, digits).alias(c) for c in nums],
        *[col(c) for c in bools], *[v.alias(k) for k, v in extra.items()],
    )


def rows_sql(bigs=(), nums=(), digits: int = 6, texts=()) -> str:
    """The same projection in SQL."""
    parts = [f'cast("{c}" as varchar) as "{c}"' for c in texts]
    parts += [f'cast("{c}" as bigint) as "{c}"' for c in bigs]
    parts += [f'round(cast("{c}" as double), {digits}) + 0.0 as "{c}"' for c in nums]
    return ", ".join(parts)


from flowtide.plans import catalog_flows, catalog_scores, catalog_sensors  # noqa: E402,F401
