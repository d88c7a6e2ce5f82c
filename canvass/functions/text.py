"""Values as text the way a statistics language prints them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shortest(column: Column) -> Column:
    """The shortest of 15, 16 or 17 digits that gives the same double."""
    def digits(n: int) -> Column:
        return F.format_string(f"%.{n - 1}e", column)

    def same(text: Column) -> Column:
        return text.try_cast("double") == column

    return F.when(F.isnan(column), F.lit("NaN")).otherwise(
        _let(digits(15), lambda a: F.when(same(a), a).otherwise(
            _let(digits(16), lambda b: F.when(same(b), b).otherwise(
                _let(digits(17), lambda c: F.when(same(c), c).otherwise(column.cast("string"))))))))


def _moved(shown: Column, mark: str) -> Column:
    """A number's text with its point where the exponent says."""
    form = r"^[-+]?(\d+)(?:\.(\d+))?(?:[eE]([-+]?\d+))?$"

    def place(p: Column) -> Column:
        point = F.length(p["whole"]) + F.coalesce(p["power"].try_cast("int"), F.lit(0))
        digits = F.concat(p["whole"], p["part"])
        return F.struct(
            F.concat(F.repeat(F.lit("0"), 1 - point), digits,
                     F.repeat(F.lit("0"), point - F.length(digits))).alias("digits"),
            F.greatest(point, F.lit(1)).alias("point"))

    def cut(q: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.substring(q["digits"], F.lit(1), q["point"]), "^0+(?=.)", "").alias("before"),
            F.regexp_replace(F.substring(q["digits"], q["point"] + 1, F.length(q["digits"])), "0+$", "").alias("after"))

    def glue(r: Column) -> Column:
        plain = F.when(r["after"] == "", r["before"]).otherwise(F.concat(r["before"], F.lit(mark), r["after"]))
        negative = shown.startswith("-") & ((r["before"] != "0") | (r["after"] != ""))
        return F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), plain)

    parts = F.struct(F.regexp_extract(shown, form, 1).alias("whole"), F.regexp_extract(shown, form, 2).alias("part"),
                     F.regexp_extract(shown, form, 3).alias("power"))
    moved = _let(parts, lambda p: _let(place(p), lambda q: _let(cut(q), glue)))
    return F.when(shown.rlike(form), moved).otherwise(shown)


def decimal_text(column: Column, mark: str = ".", kind: T.DataType | None = None) -> Column:
    """Number as plain digits, never in exponent form, with ``mark`` before the fraction.

    Takes the shortest text that gives the same number and moves its point, so every digit
    stays, at any size. What is not a finite number keeps its text. ``kind`` is the column's
    type; a double needs it for the shortest text, since the cast may print digits too many.
    """
    if isinstance(kind, T.DoubleType):
        # Small whole numbers, the usual case, have this text without any of the steps.
        plain = (column == F.floor(column)) & (F.abs(column) < 1e15)
        # So have amounts of up to four decimals and 15 digits.
        amount = F.when(F.abs(column) < 1e11, column.try_cast("decimal(15,4)"))
        amount_text = F.rtrim(amount.cast("string"), F.lit("0"))
        return F.when(plain, column.cast("bigint").cast("string")).when(
            amount.cast("double") == column, amount_text if mark == "." else F.replace(amount_text, F.lit("."), F.lit(mark))).otherwise(
            _let(_shortest(column), lambda shown: _moved(shown, mark)))
    return _let(column.cast("string"), lambda shown: _moved(shown, mark))


def value_text(value: Column, kind: T.DataType) -> Column:
    """A value of a type as text; floating-point numbers print as plain digits, whole ones without a
    fraction (398, not 398.0)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return decimal_text(value, kind=kind)
    return value.cast("string")


def plain_text(df: DataFrame, name: str) -> Column:
    """A column as text, by :func:`value_text`."""
    return value_text(F.col(f"`{name}`"), df.schema[name].dataType)
