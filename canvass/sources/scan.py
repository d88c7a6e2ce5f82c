"""Scans that rename and type columns on the way in.

Everything is a plain ``select`` or ``filter`` on a reader, so Spark prunes the columns
and pushes the predicate into Parquet or the database by itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One kept source column, with its new name and (if given) type."""

    source: str
    name: str | None = None
    dtype: str | None = None

    def column(self) -> Column:
        column = F.col(f"`{self.source}`")
        if self.dtype:
            column = column.cast(self.dtype)
        return column.alias(self.name or self.source)


@dataclass(frozen=True)
class TableMap:
    """The kept columns of one source table."""

    table: str
    fields: tuple[Field, ...]

    @staticmethod
    def renamed(table: str, names: Mapping[str, str]) -> "TableMap":
        return TableMap(table, tuple(Field(s, n) for s, n in names.items()))

    @staticmethod
    def kept(table: str, *columns: str) -> "TableMap":
        return TableMap(table, tuple(Field(c) for c in columns))

    def project(self, df: DataFrame) -> DataFrame:
        return df.select(*[f.column() for f in self.fields])


@dataclass(frozen=True)
class FileStore:
    """Tables kept as files: ``<folder>/<table><suffix>``."""

    spark: SparkSession
    folder: str
    suffix: str = ".parquet"
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format(self.fmt).options(**self.options)
        return reader.load(f"{self.folder}/{name}{self.suffix}")


@dataclass(frozen=True)
class JdbcStore:
    """Tables or views of a relational database.

    ``splits`` names for a table the numeric column, its bounds and the number of
    parallel reads; ``predicates`` gives a table one condition per read instead, as
    :func:`canvass.sources.splits.equal_depth` makes them for skewed keys. Without either
    Spark reads the table through a single connection.
    """

    spark: SparkSession
    url: str
    options: Mapping[str, str] = field(default_factory=dict)
    splits: Mapping[str, tuple[str, int, int, int]] = field(default_factory=dict)
    predicates: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def reader_options(self, name: str) -> dict[str, str]:
        chosen = {"url": self.url, "dbtable": name, **self.options}
        if name in self.splits:
            column, low, high, reads = self.splits[name]
            chosen |= {
                "partitionColumn": column,
                "lowerBound": str(low),
                "upperBound": str(high),
                "numPartitions": str(reads),
            }
        return chosen

    def table(self, name: str) -> DataFrame:
        if name in self.predicates:
            return self.spark.read.jdbc(self.url, name, predicates=list(self.predicates[name]),
                                        properties=dict(self.options))
        return self.spark.read.format("jdbc").options(**self.reader_options(name)).load()

    def query_options(self, sql: str, split: tuple[str, int, int, int] | None = None) -> dict[str, str]:
        chosen = {"url": self.url, "dbtable": f"({sql}) pushed", **self.options}
        if split:
            column, low, high, reads = split
            chosen |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
                       "numPartitions": str(reads)}
        return chosen

    def query(self, sql: str, split: tuple[str, int, int, int] | None = None) -> DataFrame:
        """Rows of a query that the database itself runs (joins stay on its side), read in
        parts by a column of the result if ``split`` is given: (column, low, high, reads)."""
        return self.spark.read.format("jdbc").options(**self.query_options(sql, split)).load()


def scan(store, mapping: TableMap | str, where: Column | None = None) -> DataFrame:
    """Read a table: all columns if only its name is given, else the mapped ones.

    ``where`` uses source column names; it is applied before the projection.
    """
    name = mapping if isinstance(mapping, str) else mapping.table
    df = store.table(name)
    if where is not None:
        df = df.filter(where)
    return df if isinstance(mapping, str) else mapping.project(df)


def min_max(df: DataFrame, column: str) -> DataFrame:
    """Largest and smallest value of a column, as one row.

    Where the source can answer that itself (a database; Parquet files read through the
    version-2 reader with ``spark.sql.parquet.aggregatePushdown``, see :func:`footer_scan`)
    Spark pushes it down.
    """
    return df.agg(F.max(column).alias("max"), F.min(column).alias("min"))


def footer_scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files read so that smallest and largest values come from their footers."""
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    readers = spark.conf.get("spark.sql.sources.useV1SourceList")
    try:  # which reader is used is settled while loading
        spark.conf.set("spark.sql.sources.useV1SourceList",
                       ",".join(r for r in readers.split(",") if r.strip() != "parquet"))
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", readers)
