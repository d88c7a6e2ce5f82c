"""Stacking tables and turning columns into rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.text import plain_text


def stack_same(*tables: DataFrame) -> DataFrame:
    """Stack tables that have the same columns, matched by name; duplicates stay."""
    for table in tables[1:]:
        if set(table.columns) != set(tables[0].columns):
            raise ValueError("tables to stack must have the same columns")
    return reduce(lambda a, b: a.unionByName(b), tables)


def stack_fill(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column a table lacks is missing in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable",
         value: str = "value") -> DataFrame:
    """One row per id and value column, missing values included.

    Columns of different types meet as text, as columns of one type keep it.
    """
    if len({df.schema[v].dataType for v in values}) > 1:
        df = df.withColumns({v: plain_text(df, v) for v in values})
    return df.unpivot([F.col(f"`{i}`") for i in ids], [F.col(f"`{v}`") for v in values],
                      variable, value)


def gather_distinct(df: DataFrame, columns: Sequence[str] | None = None, drop_missing: bool = True,
                    variable: str = "key", value: str = "value") -> DataFrame:
    """The distinct (column, value) pairs of a table."""
    pairs = melt(df, [], list(columns or df.columns), variable, value).distinct()
    return pairs.dropna(subset=[value]) if drop_missing else pairs
