"""Codebook: one row of facts about each column of a table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.text import plain_text, value_text
from canvass.operators.frequency import slots_of, typed_counts
from canvass.operators.selection import ORDERED, doubles_hold, from_axis, on_axis, order_statistics, sketch
from canvass.session import write_once

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _is_ordered(field: T.StructField) -> bool:
    return isinstance(field.dataType, ORDERED)


def _shown(kind: T.DataType, value: Column) -> Column:
    return value_text(value, kind)


def _by_value(df: DataFrame) -> DataFrame:
    """One row: distinct values and mode (ties: the smallest text) of each column.

    An aggregate without groups, with columns of its own for each variable, so that the levels are neither sorted nor written.
    """
    levels, slots = typed_counts(df, df.columns), slots_of(df, df.columns)
    found = []
    for i, name in enumerate(df.columns):
        own = (F.col("variable") == i) & F.col(slots[name]).isNotNull()
        shown = F.struct((-F.col("freq")).alias("f"), plain_text(levels, slots[name]).alias("v"))
        found += [F.count(F.when(own, 1)).alias(f"distinct{i}"), F.min(F.when(own, shown)).alias(f"top{i}")]
    return levels.agg(*found)


def codebook(df: DataFrame, exact: bool = True, quantile_accuracy: int = 10_000,
             tracked: int = 10_000) -> DataFrame:
    """Type, label, counts, range, quartiles and mode of every column, values as text.

    Range and known values come from one aggregate over the table. Distinct values and modes
    are counted per value by many tasks rather than in one buffer. A quartile is the smallest
    value that at least that share of the known values does not exceed, found by narrowing its
    range in a few passes (:mod:`canvass.operators.selection`).

    With ``exact=False`` everything comes from the one aggregate, by sketches of fixed size:
    quartiles are off by at most rows / ``quantile_accuracy`` ranks, distinct values by a few
    percent, and the mode is the most frequent of ``tracked`` values (ties: any).
    """
    facts = []
    for i, field in enumerate(df.schema.fields):
        column = F.col(f"`{field.name}`")
        facts += [
            F.count(column).alias(f"known{i}"),
            F.min(column).alias(f"min{i}"),
            F.max(column).alias(f"max{i}"),
        ]
        if not exact:
            facts += [F.approx_count_distinct(column).alias(f"distinct{i}"),
                      F.expr(f"approx_top_k(`{field.name}`, 1, {tracked})").alias(f"top{i}")]
        if _is_ordered(field):
            axis = on_axis(field.name, field.dataType)
            facts += [sketch(axis, list(_QUARTILES.values())).alias(f"start{i}"),
                      F.min(axis).alias(f"least{i}"), F.max(axis).alias(f"most{i}")] if exact else [
                F.percentile_approx(column, list(_QUARTILES.values()), quantile_accuracy).alias(f"quart{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *facts)

    wide = _found_values(df, wide) if exact else _sketched_values(df, wide)
    texts = []
    for i, field in enumerate(df.schema.fields):
        kind, quartiles = field.dataType, _QUARTILES if _is_ordered(field) else {}
        named = ["min", "max", *quartiles]
        # One conversion for all values of a column keeps the plan small.
        shown = F.transform(F.array(*[F.col(f"{n}{i}") for n in named]), partial(_shown, kind))
        said = {n: F.get(shown, F.lit(k)) for k, n in enumerate(named)}
        texts.append(F.struct(
            F.lit(field.name).alias("variable"),
            F.lit(kind.simpleString()).alias("type"),
            F.lit(field.metadata.get("label")).cast("string").alias("label"),
            F.col("rows").alias("n"),
            (F.col("rows") - F.col(f"known{i}")).alias("missing"),
            *[said.get(n, F.lit(None).cast("string")).alias(n) for n in ("min", *_QUARTILES, "max")],
            F.col(f"distinct{i}").alias("distinct"),
            plain_text(wide, f"mode{i}").alias("mode"),
            F.col(f"mode_freq{i}").alias("mode_freq"),
        ))
    return wide.select(F.inline(F.array(*texts)))


def _sketched_values(df: DataFrame, wide: DataFrame) -> DataFrame:
    """Quartiles and modes out of the sketches of the one aggregate."""
    taken = {}
    for i, field in enumerate(df.schema.fields):
        if _is_ordered(field):
            taken |= {f"{n}{i}": F.get(f"quart{i}", F.lit(k)) for k, n in enumerate(_QUARTILES)}
        top = F.get(f"top{i}", F.lit(0))
        taken |= {f"mode{i}": top["item"], f"mode_freq{i}": top["count"]}
    return wide.withColumns(taken)


def _found_values(df: DataFrame, wide: DataFrame) -> DataFrame:
    """The facts with exact quartiles, distinct values and modes; all of it is one row."""
    wide = write_once(wide, "facts")
    ordered = {i: field for i, field in enumerate(df.schema.fields) if _is_ordered(field)}
    taken = {}
    if ordered:
        held = wide.select(*[f"{n}{i}" for i in ordered for n in ("known", "start", "least", "most")]).first()
        found = order_statistics(
            df, {str(i): on_axis(field.name, field.dataType) for i, field in ordered.items()}, list(_QUARTILES.values()),
            {str(i): held[f"known{i}"] for i in ordered}, {str(i): held[f"start{i}"] for i in ordered},
            {str(i): doubles_hold(field.dataType, held[f"least{i}"], held[f"most{i}"]) for i, field in ordered.items()})
        taken = {f"{n}{i}": from_axis(value, field.dataType)
                 for i, field in ordered.items() for n, value in zip(_QUARTILES, found[str(i)], strict=True)}
    values = _by_value(df)
    for i in range(len(df.columns)):
        taken |= {f"mode{i}": F.col(f"top{i}")["v"], f"mode_freq{i}": -F.col(f"top{i}")["f"]}
    held = values.select(F.struct(*values.columns).alias("held")).scalar()
    return wide.withColumn("_held", held).select("*", "_held.*").withColumns(taken)
