"""Missing-value rules of a statistics language, as Spark column expressions.

Comparisons and ``&``, ``|``, ``~`` already follow the same three-valued logic in Spark.
The functions here cover what differs: conditionals, membership, pasting and sums.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def if_else(test: Column, yes, no) -> Column:
    """``yes`` or ``no``; unknown when the test is unknown (SQL ``CASE`` would give ``no``)."""
    return F.when(test.isNull(), None).when(test, as_column(yes)).otherwise(as_column(no))


def cascade(*branches: tuple[Column, object], otherwise=None) -> Column:
    """Nested ``if_else``: the first test that is not false decides, also when it is unknown."""
    result = F.when(F.lit(False), None)
    for test, value in branches:
        result = result.when(test.isNull(), None).when(test, as_column(value))
    return result.otherwise(as_column(otherwise))


def is_in(x: Column, values: Iterable) -> Column:
    """Membership that is never unknown; ``None`` among the values matches a missing ``x``."""
    values = list(values)
    known = [v for v in values if v is not None]
    hit = F.coalesce(x.isin(known), F.lit(False)) if known else F.lit(False)
    return (hit | x.isNull()) if len(known) < len(values) else hit


def not_in(x: Column, values: Iterable) -> Column:
    """Opposite of :func:`is_in`: a missing ``x`` is not in the list, so this is true."""
    return ~is_in(x, values)


def paste(*parts: Column, sep: str = "_") -> Column:
    """Join as text; a missing part becomes the text ``NA`` instead of vanishing."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("NA")) for p in parts]
    return F.concat_ws(sep, *texts)


def sum_strict(x: Column) -> Column:
    """Sum that is unknown as soon as one value is unknown; 0 over no rows."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def sum_present(x: Column) -> Column:
    """Sum of the known values; 0 when there is none."""
    return F.coalesce(F.sum(x), F.lit(0))


def n_distinct(x: Column) -> Column:
    """Number of distinct values, a missing value counting as one of them."""
    return F.countDistinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def n_distinct_approx(x: Column, rsd: float = 0.02) -> Column:
    """As :func:`n_distinct` from a fixed-size sketch, for when an estimate will do."""
    return F.approx_count_distinct(x, rsd) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))
