"""Status flags as a declared list, computed level by level.

A flag may use flags of earlier levels. Each level is one projection, so the plan grows
with the number of levels and not with the number of flags.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.na import cascade, if_else, is_in


@dataclass(frozen=True)
class Flag:
    name: str
    value: Column


def binary(name: str, test: Column) -> Flag:
    """1 or 0, unknown when the test is."""
    return Flag(name, if_else(test, 1, 0))


def share(name: str, base: Column, hit: Column) -> Flag:
    """1 in the numerator, 0 only in the denominator, missing out of scope.

    Missing too where ``hit`` itself is unknown; membership tests never are.
    """
    return Flag(name, F.when(base & hit, 1).when(base & ~hit, 0))


def category(name: str, cases: Sequence[tuple[Column, int]]) -> Flag:
    """Code of the first case that holds; an unknown test ends the search with missing."""
    return Flag(name, cascade(*cases))


def in_codes(column: str, codes) -> Column:
    return is_in(F.col(column), codes)


def with_flags(df: DataFrame, *levels: Sequence[Flag]) -> DataFrame:
    for level in levels:
        df = df.withColumns({flag.name: flag.value for flag in level})
    return df
