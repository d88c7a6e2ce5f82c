"""Grouped sums, stage counts and running daily counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canvass.functions.na import sum_present, sum_strict
from canvass.operators.reshape import melt
from canvass.sources.literals import sequence_table


def group_sums(df: DataFrame, by: Sequence[str], strict: Mapping[str, str] | None = None,
               present: Mapping[str, str] | None = None) -> DataFrame:
    """Sums per group, as {new column: summed column}, missing groups kept.

    ``strict`` sums are unknown if a value is; ``present`` sums skip unknown values.
    """
    sums = [sum_strict(F.col(c)).alias(n) for n, c in (strict or {}).items()]
    sums += [sum_present(F.col(c)).alias(n) for n, c in (present or {}).items()]
    return df.groupBy(*by).agg(*sums)


def count_known(df: DataFrame, by: Sequence[str], column: str, name: str = "COUNT") -> DataFrame:
    """Known values of a column per group, missing groups kept."""
    return df.groupBy(*by).agg(F.count(column).alias(name))


def code_totals(df: DataFrame, group: str, questions: Mapping[str, str], group_name: str = "Stand"
                ) -> DataFrame:
    """Sum of the codes of each question per group and code, all questions in one pass.

    ``questions`` maps columns to the text that names them. Rows without a group or a code
    do not count.
    """
    long = melt(df, [group], list(questions), "_question", "value")
    known = long.dropna(subset=[group, "value"])
    totals = known.groupBy(F.col(group).alias(group_name), "_question", "value").agg(
        F.sum("value").alias("x"))
    text = F.lit(None)
    for column, name in questions.items():
        text = F.when(F.col("_question") == column, F.lit(name)).otherwise(text)
    return totals.select(group_name, "value", "x", text.alias("var"))


def _stage_sums(df: DataFrame, by: str, stages: Sequence[tuple[str, int]],
                strict: Sequence[str]) -> DataFrame:
    """One row per group with a column ``stage<number>`` per stage."""
    return group_sums(
        df, [by],
        strict={f"stage{i}": flag for flag, i in stages if flag in strict},
        present={f"stage{i}": flag for flag, i in stages if flag not in strict},
    )


def _steps(sums: DataFrame, by: str, steps: Sequence[int], count: str, step: str) -> DataFrame:
    """The wide sums as one row per group and step; a step without a sum is missing."""
    rows = [
        F.struct(
            (F.col(f"stage{i}") if f"stage{i}" in sums.columns else F.lit(None).cast("bigint"))
            .alias(count),
            F.lit(i).alias(step),
        )
        for i in steps
    ]
    return sums.select(by, F.inline(F.array(*rows)))


def stage_counts(df: DataFrame, by: str, stages: Sequence[tuple[str, int]],
                 strict: Sequence[str] = (), count: str = "count", stage: str = "visioid"
                 ) -> DataFrame:
    """Sum of each stage's flag per group, one row per group and stage, from one pass.

    Stages named in ``strict`` are unknown in a group where a flag is; the others skip them.
    """
    return _steps(_stage_sums(df, by, stages, strict), by, [i for _, i in stages], count, stage)


def stage_grid(df: DataFrame, by: str, stages: Sequence[tuple[str, int]], first: int, last: int,
               strict: Sequence[str] = (), count: str = "count", step: str = "screenerstage"
               ) -> DataFrame:
    """As :func:`stage_counts`, with every step from ``first`` to ``last`` for each group."""
    return _steps(_stage_sums(df, by, stages, strict), by, range(first, last + 1), count, step)


def stage_list(spark, first: int, last: int, step: str = "screenerstage") -> DataFrame:
    """The bare list of stages, as exported next to the counts."""
    return sequence_table(spark, step, first, last)


def daily_running(df: DataFrame, by: str, moment: str, flag: str, day: str = "date",
                  observed: str = "N_aggragated_obs", done: str = "number_of_complete_screenings",
                  running: str = "cumulative") -> DataFrame:
    """Rows and flag sum per group and day, and the group's running sum.

    Days are counted first, so the window sees one row per day of a group and not its rows.
    """
    daily = df.groupBy(by, F.to_date(moment).alias(day)).agg(
        F.count(F.lit(1)).alias(observed), sum_present(F.col(flag)).alias(done))
    so_far = Window.partitionBy(by).orderBy(F.col(day).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)
    return daily.withColumn(running, F.sum(done).over(so_far))
