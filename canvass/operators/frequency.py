"""Frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.text import is_numeric, plain_text
from canvass.operators.ordering import with_running_totals
from canvass.session import write_once

NA_ROW, TOTAL_ROW = "<NA>", "Total"

# Columns that hold the order of levels: whole numbers, fractions of decimals, floating point.
_ORDER = ("order_whole", "order_part", "order_float")

# So many levels, not rows, one task may add up.
ONE_TASK_LEVELS = 1_000_000


def masked(df: DataFrame, mask: Column, columns: Sequence[str]) -> DataFrame:
    """Rows where the mask is true, and an all-missing row for each unknown mask.

    This is what indexing by a logical vector does; ``df.filter(mask)`` drops the unknown.
    """
    kept = df.filter(mask | mask.isNull())
    return kept.select(*[F.when(mask, F.col(c)).alias(c, metadata=df.schema[c].metadata)
                         for c in columns])


def _order_of(df: DataFrame, name: str) -> list[Column]:
    """The value in the order columns of its kind, so that no two numbers tie by rounding."""
    kind, column = df.schema[name].dataType, F.col(name)
    whole = part = real = F.lit(None)
    if isinstance(kind, T.DecimalType):
        whole = F.floor(column)
        part = column - whole
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        real = column
    elif is_numeric(df, name):
        whole = column
    types = ("decimal(38,0)", "decimal(38,37)", "double")
    return [c.cast(t) for c, t in zip((whole, part, real), types, strict=True)]


def slots_of(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The slot that holds the values of each column: columns of one type share one."""
    kinds: dict[str, str] = {}
    return {c: kinds.setdefault(_slot_type(df, c), f"_slot{len(kinds)}") for c in columns}


def _slot_type(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    return "string" if isinstance(kind, (T.MapType, T.NullType, T.CharType, T.VarcharType)) else kind.simpleString()


def typed_counts(df: DataFrame, columns: Sequence[str], few_levels: bool = False) -> DataFrame:
    """(variable, a slot per type, freq) of all columns from one pass over the table.

    Values stay as they are while they are counted: a row of a column has its value in the slot of the column's
    type, and nothing is made text. ``variable`` is the column's place. With ``few_levels`` the combinations of values
    are counted first, which leaves few rows to take apart into cells; columns with long lists of values would not gain by that.
    """
    rows = F.count(F.lit(1))
    if few_levels:
        df = df.groupBy(*columns).agg(rows.alias("_rows"))
        rows = F.sum("_rows")
    slots = slots_of(df, columns)
    types = {slot: _slot_type(df, c) for c, slot in slots.items()}
    cells = [F.struct(F.lit(i).alias("variable"), *[
        (F.col(f"`{c}`") if slots[c] == slot else F.lit(None)).cast(kind).alias(slot) for slot, kind in types.items()])
        for i, c in enumerate(columns)]
    long = df.select(*(["_rows"] if few_levels else []), F.inline(F.array(*cells)))
    return long.groupBy("variable", *types).agg(rows.alias("freq"))


def shown_levels(levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Typed counts with the column's name, the value as text and the order columns: text is made per level, not per row."""
    slots = [c for c in levels.columns if c not in ("variable", "freq")]
    orders = zip(*[_order_of(levels, slot) for slot in slots], strict=True)
    return levels.select(
        F.element_at(F.array(*map(F.lit, columns)), F.col("variable") + 1).alias("variable"),
        F.coalesce(*[plain_text(levels, slot) for slot in slots]).alias("value"),
        *[F.coalesce(*held).alias(name) for held, name in zip(orders, _ORDER, strict=True)],
        "freq")


def level_counts(df: DataFrame, columns: Sequence[str], few_levels: bool = False) -> DataFrame:
    """(variable, value, order columns, freq) of all columns from one pass over the table."""
    return shown_levels(typed_counts(df, columns, few_levels), columns)


def _placed(levels: DataFrame, one_task: bool) -> DataFrame:
    """Levels with ``seen`` and ``cum``, the rows and the known rows up to each level of its
    variable, and ``all_rows`` and ``known_rows``, those of the whole variable."""
    levels = levels.withColumn(
        "known", F.when(F.col("value").isNotNull(), F.col("freq")).otherwise(F.lit(0)))
    if one_task:
        whole = Window.partitionBy("variable")
        so_far = whole.orderBy(
            *[F.col(c).asc_nulls_last() for c in (*_ORDER, "value")]
        ).rowsBetween(Window.unboundedPreceding, 0)
        return levels.withColumns({
            "seen": F.sum("freq").over(so_far), "cum": F.sum("known").over(so_far),
            "all_rows": F.sum("freq").over(whole), "known_rows": F.sum("known").over(whole),
        })
    running = with_running_totals(levels, ["variable", *_ORDER, "value"],
                                  {"seen": "freq", "cum": "known"})
    totals = running.groupBy(F.col("variable").alias("_variable")).agg(
        F.sum("freq").alias("all_rows"), F.sum("known").alias("known_rows"),
        F.min(F.col("seen") - F.col("freq")).alias("_seen_before"),
        F.min(F.col("cum") - F.col("known")).alias("_cum_before"))
    # Bounded broadcast: one row per requested column.
    joined = running.join(F.broadcast(totals), F.col("variable") == F.col("_variable"))
    return joined.withColumns({"seen": F.col("seen") - F.col("_seen_before"),
                               "cum": F.col("cum") - F.col("_cum_before")})


def placed_levels(df: DataFrame, columns: Sequence[str], few_levels: bool = False) -> DataFrame:
    """Level counts in the order of their values, with the running and whole counts.

    With ``few_levels`` a single lazy plan. Otherwise the counts are written once; up to ``ONE_TASK_LEVELS``
    levels are added up by a task per column, more by many tasks in sorted parts.
    """
    if few_levels:
        return _placed(level_counts(df, columns, True), True)
    counted = write_once(typed_counts(df, columns), "levels")
    return _placed(shown_levels(counted, columns), counted.count() <= ONE_TASK_LEVELS)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") * 100 / whole)


def frequency(df: DataFrame, columns: str | Sequence[str], *, report_missing: bool = True,
              few_levels: bool = False) -> DataFrame:
    """Frequency table of one or more columns.

    Gives per column its values in order, a ``<NA>`` row and a ``Total`` row, with count,
    percent of the known values, percent of all rows, and both cumulated. Without
    ``report_missing`` there is no ``<NA>`` row and all percentages are of the known values.

    Say ``few_levels`` only for columns whose code list is fixed (flags, categories).
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    placed = placed_levels(df, columns, few_levels)
    freq, cum, everything, valid = (F.col(c) for c in ("freq", "cum", "all_rows", "known_rows"))
    whole, missing = (everything if report_missing else valid), everything - valid

    def row(value, kind, n, of_valid, cum_valid, of_whole, cum_whole) -> Column:
        def share(part: Column | None, total: Column) -> Column:
            return F.lit(None).cast("double") if part is None else _percent(part, total)

        return F.struct(
            value.alias("value"), F.lit(kind).alias("row_kind"), n.alias("freq"),
            share(of_valid, valid).alias("pct_valid"),
            share(cum_valid, valid).alias("pct_valid_cum"),
            share(of_whole, whole).alias("pct_total"),
            share(cum_whole, whole).alias("pct_total_cum"))

    # The first level of a variable brings the summary rows along.
    first = F.col("seen") == freq
    rows = [F.when(F.col("value").isNotNull(),
                   row(F.col("value"), "value", freq, freq, cum, freq, cum))]
    if report_missing:
        rows.append(F.when(first, row(F.lit(NA_ROW), "missing", missing, None, None, missing,
                                      whole)))
    rows.append(F.when(first, row(F.lit(TOTAL_ROW), "total", whole, valid, valid, whole, whole)))
    return placed.select("variable", F.inline(F.array_compact(F.array(*rows))))


def labelled_frequency(df: DataFrame, columns: Sequence[str], variable_labels: DataFrame,
                       value_labels: DataFrame, *, few_levels: bool = False) -> DataFrame:
    """Level counts with the label of the variable and of the value.

    Both label tables hold a row per labelled column or code, so Spark broadcasts them.
    """
    counts = level_counts(df, columns, few_levels).select("variable", "value", "freq")
    named = counts.join(variable_labels, "variable", "left")
    codes = value_labels.select(F.col("variable").alias("_variable"), F.col("code").alias("_code"),
                                "value_label")
    match = (named["variable"] == codes["_variable"]) & (named["value"] == codes["_code"])
    return named.join(codes, match, "left").select(
        "variable", "variable_label", "value", "value_label", "freq")
