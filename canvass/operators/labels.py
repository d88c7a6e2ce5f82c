"""Variable labels on columns and value labels in tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators.joins import join
from canvass.sources.literals import literal_table


def label_variables(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach a label to columns; it follows them through later projections and joins."""
    for name, text in labels.items():
        if name in df.columns:
            df = df.withMetadata(name, {**df.schema[name].metadata, "label": text})
    return df


def label_of(df: DataFrame, name: str) -> str | None:
    return df.schema[name].metadata.get("label")


def cast_labelled(df: DataFrame, name: str, dtype: str) -> DataFrame:
    """Change a column's type and keep its label, which a bare cast would lose."""
    return df.withColumn(name, F.col(name).cast(dtype)).withMetadata(
        name, df.schema[name].metadata)


def variable_labels(df: DataFrame) -> DataFrame:
    """The labels of a table as rows (variable, variable_label)."""
    rows = [(f.name, f.metadata.get("label")) for f in df.schema.fields]
    return literal_table(df.sparkSession, "variable string, variable_label string", rows)


def code_labels(spark: SparkSession, rows: Sequence[tuple[int | None, str]], code: str = "value",
                label: str = "description") -> DataFrame:
    """A label table for one code; a missing code may have a label of its own."""
    return literal_table(spark, f"{code} int, {label} string", rows)


def value_labels(spark: SparkSession, labels: Mapping[str, Mapping[int, str]]) -> DataFrame:
    """Labels of several columns as rows (variable, code, value_label), the code as text."""
    rows = [(column, str(code), text) for column, codes in labels.items()
            for code, text in codes.items()]
    return literal_table(spark, "variable string, code string, value_label string", rows)


def decode(df: DataFrame, column: str, labels: DataFrame, name: str, code: str = "value",
           label: str = "description") -> DataFrame:
    """Add the label of a code; the missing code matches a missing code in the table."""
    return join(df, labels, [(column, code)], take={label: name}, null_safe=True)


def decode_long(df: DataFrame, labels: DataFrame, name: str, variable: str = "variable",
                value: str = "value", missing: str | None = None, unlisted: str | None = None
                ) -> DataFrame:
    """Label (variable, value) rows; missing values and unlisted codes get their own text."""
    found = join(df, labels, [(variable, "variable"), (value, "code")],
                 take={"value_label": name})
    fallback = F.when(F.col(value).isNull(), F.lit(missing)).otherwise(F.lit(unlisted))
    return found.withColumn(name, F.coalesce(F.col(name), fallback))
