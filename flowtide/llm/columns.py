"""Columns of a caller beside helper columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aside(df: DataFrame, **named: str) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with numbered columns, so that no helper column clashes with one of its own, and what restores each of them.

    ``named`` gives columns of ``df`` a name to work with: ``aside(df, text=text_col)``.
    """
    new = {c: n for n, c in named.items()}
    names = {c: new.get(c, f"column_{i}") for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), {c: F.col(n).alias(c) for c, n in names.items()}
