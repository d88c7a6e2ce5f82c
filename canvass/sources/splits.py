"""Conditions that cut a table into reads of about equal size, however its key is distributed."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000  # rank error of the quantile summary: rows / ACCURACY


def _text(value) -> str:
    """A literal that Spark and databases read alike."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, datetime.date)):
        raise TypeError(f"cannot split on {type(value).__name__} values")
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    return format(value, "f") if isinstance(value, Decimal) else repr(value)


def _bounds(df: DataFrame, column: str, reads: int) -> list:
    """The values at 1/reads, 2/reads, ... of the known values, from a mergeable summary of fixed size."""
    shares = [i / reads for i in range(1, reads)]
    if not shares:
        return []
    return df.agg(F.percentile_approx(f"`{column}`", shares, ACCURACY).alias("bounds")).first()["bounds"] or []


def _ranges(column: str, bounds: Sequence, whole: str | None = None) -> list[tuple[str, int, object]]:
    """(condition, how many reads it is worth, the heavy value or None), in order and without gaps.

    A value that is a bound twice or more holds at least one read's rows by itself and becomes a condition of its own.
    """
    found, low = [], None
    for value in sorted(set(bounds)):
        times = sum(b == value for b in bounds)
        above = [f"{column} > {_text(low)}"] if low is not None else []
        if times == 1:
            found.append((" AND ".join([*above, f"{column} <= {_text(value)}"]), 1, None))
        else:
            found.append((" AND ".join([*above, f"{column} < {_text(value)}"]), 1, None))
            found.append((f"{column} = {_text(value)}", times, value))
        low = value
    last = f"{column} > {_text(low)}" if low is not None else f"{column} IS NOT NULL"
    return [*found, (last, 1, None)]


def equal_depth(sample: DataFrame, column: str, reads: int, second: str | None = None) -> list[str]:
    """SQL conditions that every row meets exactly one of, each with about 1/reads of the rows.

    ``sample`` is the table or a uniform sample of it; it only places the cuts, never decides which rows are read. The
    column holds numbers, dates or timestamps. A value (or the missing key) with several reads' worth of rows is cut again by
    ``second``; without it, such a value is one read. NaN counts as larger than all numbers.
    """
    if reads < 1:
        raise ValueError("reads must be at least 1")
    rows, known = sample.agg(F.count(F.lit(1)), F.count(f"`{column}`")).first()
    missing = rows - known
    own = max(1, round(reads * missing / rows)) if missing else 0
    parts = [*_ranges(column, _bounds(sample, column, max(1, reads - own) if known else 1)), (f"{column} IS NULL", own, None)]
    found = []
    for condition, worth, _ in parts:
        if second is None or worth < 2:
            found.append(condition)
            continue
        inner = _ranges(second, _bounds(sample.filter(condition), second, worth))
        found += [f"{condition} AND {part}" for part, _, _ in inner]
        found.append(f"{condition} AND {second} IS NULL")
    return found
