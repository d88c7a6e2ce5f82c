"""Sorting, row numbers and running totals over a whole table.

A window without a partition would pull the table into one task. Here the table is
range-sorted, written once, and each sorted part gets the offset of the parts before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canvass.session import write_once

_PART_BITS = 33  # monotonically_increasing_id: part number above, row in part below


def nulls_last(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`").asc_nulls_last() for n in names]


def _tie_breakers() -> list[str]:
    return ["_tie_hash", "_tie_part"]


def _with_tie_breakers(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_tie_hash": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),
        "_tie_part": F.spark_partition_id(),
    })


def arrange(df: DataFrame, *by: str) -> DataFrame:
    """Ascending sort with missing values last.

    Rows that tie on all keys are ordered by content, which also lets the range
    partitioner cut through a run of ties that would not fit one task.
    """
    keyed = _with_tie_breakers(df)
    order = nulls_last(by) + [F.col(t) for t in _tie_breakers()]
    return keyed.orderBy(*order).drop(*_tie_breakers())


def _placed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sorted rows, written once, each with its part and its place in the part."""
    slotted = arrange(df, *by).withColumn("_slot", F.monotonically_increasing_id())
    return write_once(slotted, "sorted").withColumns({
        "_part": F.shiftright("_slot", _PART_BITS),
        "_place": F.col("_slot").bitwiseAND(F.lit((1 << _PART_BITS) - 1)),
    })


def _starts(parts: DataFrame, totals: Mapping[str, str]) -> DataFrame:
    """Sum of all earlier parts. One row per part of the sort, so one task is enough."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in totals.items()
    ])


def with_row_number(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Add the ``bigint`` position (from 1) of each row in the order of ``by``."""
    placed = _placed(df, by)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = _starts(parts, {"_start": "_size"})
    # Bounded broadcast: a row per sorted part, at most spark.sql.shuffle.partitions.
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(name))


def with_row_names(df: DataFrame, by: Sequence[str], name: str = "row_name") -> DataFrame:
    """Row names as text: "1", "2", ... in the order of ``by``."""
    return with_row_number(df, by, name).withColumn(name, F.col(name).cast("string"))


def with_running_totals(df: DataFrame, by: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Running sums over the whole table in the order of ``by``: {new column: summed column}."""
    placed = _placed(df, by)
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    starts = _starts(parts, {f"_start_{n}": n for n in totals})
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(
        Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(starts), "_part").withColumns({
        n: F.sum(c).over(within) + F.col(f"_start_{n}") for n, c in totals.items()
    })
    return summed.select(*df.columns, *totals)
