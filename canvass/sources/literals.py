"""Small tables written in the program."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def literal_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A table from rows in the program; Spark knows its exact size, so it plans joins well."""
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    arrow = {
        "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
    }
    data = pa.table({
        f.name: pa.array(values, arrow[f.dataType.simpleString()])
        for f, values in zip(fields, columns, strict=True)
    })
    return spark.createDataFrame(data)


def sequence_table(spark: SparkSession, name: str, first: int, last: int) -> DataFrame:
    """The whole numbers ``first`` to ``last`` as one ``int`` column."""
    return spark.range(first, last + 1).selectExpr(f"CAST(id AS INT) AS `{name}`")
