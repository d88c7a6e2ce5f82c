"""Delimited text files as a statistics language writes them, and the star export.

Each writer makes a folder of part files, one per task, every one with the header. With row names, ``write_table``
writes the header once, as a part of its own that comes first and has no cell for the row names, and its rows in order
over the others; :func:`join_parts` makes one file of such a folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.functions.text import decimal_text
from canvass.operators.ordering import with_row_names
from canvass.session import CODEC, discard

Finish = Callable[[DataFrame], DataFrame]
ROW_NAME = ""  # the header cell of the row names is left empty
HEADER_PART = "part--header.csv"  # sorts before the parts that Spark numbers


@contextmanager
def _named_rows(df: DataFrame, row_names: Sequence[str] | None, finish: Finish | None) -> Iterator[DataFrame]:
    """The rows with their names in front. Their sorted copy, which lasts as long as the block, is without what ``finish`` adds."""
    finish = finish or (lambda rows: rows)
    if not row_names:
        yield finish(df)
        return
    named = with_row_names(df, row_names, "_row_name")
    whole = finish(named)
    yield whole.select(F.col("_row_name").alias(ROW_NAME), *[F.col(f"`{c}`") for c in whole.columns if c != "_row_name"])
    discard(named)


def _plain_numbers(df: DataFrame, mark: str) -> DataFrame:
    numbers = {f.name: f.dataType for f in df.schema.fields
               if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    return df.withColumns({n: decimal_text(F.col(f"`{n}`"), mark, kind) for n, kind in numbers.items()})


def _write(df: DataFrame, path: str, **options) -> None:
    # A quote inside a value is doubled, which is what spreadsheet and BI readers expect.
    df.write.options(header=True, quote='"', escape='"', **options).csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "", row_names: Sequence[str] | None = None,
              finish: Finish | None = None) -> None:
    """Comma-separated. Missing is empty, or the text given. ``row_names`` lists the columns
    that order the rows for a leading column of row names. ``finish`` adds columns that follow
    from a row once rows have their places, so that they are not sorted along."""
    with _named_rows(df, row_names, finish) as named:
        _write(_plain_numbers(named, "."), path, nullValue=missing)


def write_csv2(df: DataFrame, path: str, row_names: Sequence[str] | None = None, finish: Finish | None = None) -> None:
    """Semicolon-separated with decimal commas, missing as ``NA``."""
    with _named_rows(df, row_names, finish) as named:
        _write(_plain_numbers(named, ","), path, sep=";", nullValue="NA")


def write_table(df: DataFrame, path: str, row_names: Sequence[str] | None = None, finish: Finish | None = None) -> None:
    """Space-separated, everything quoted, missing as ``NA``; the header has no cell for the row names."""
    with _named_rows(df, row_names, finish) as named:
        if not row_names:
            _write(_plain_numbers(named, "."), path, sep=" ", nullValue="NA", quoteAll=True)
            return
        # The first column is the row name; its own is empty and cannot be named in an expression.
        columns = named.columns[1:]
        numbered = _plain_numbers(named, ".").toDF("_row_name", *columns)
        ordered = numbered.orderBy(F.col("_row_name").cast("bigint"))
        ordered.write.options(header=False, quote='"', escape='"', sep=" ", nullValue="NA", quoteAll=True).csv(path)
    _write_line(df.sparkSession, f"{path}/{HEADER_PART}", " ".join('"' + c.replace('"', '""') + '"' for c in columns))


def _write_line(spark: SparkSession, path: str, line: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray((line + "\n").encode()))
    out.close()


def read_header(spark: SparkSession, folder: str) -> list[str]:
    """Column names of a folder from ``write_table`` with row names; the rows have one cell more in front."""
    line = spark.read.text(f"{folder}/{HEADER_PART}").first()[0]
    return [c.replace('""', '"') for c in re.findall(r'"((?:[^"]|"")*)"', line)]


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """One file of a folder's parts in the order of their names, copied through the file system with a small buffer.

    For folders whose parts follow each other, as ``write_table`` leaves them with row names.
    """
    jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
    source, made = (jvm.org.apache.hadoop.fs.Path(p) for p in (folder, target))
    system = source.getFileSystem(settings)
    names = sorted(f.getPath().getName() for f in system.listStatus(source) if f.getPath().getName().startswith("part-"))
    out = made.getFileSystem(settings).create(made, True)
    for name in names:
        part = system.open(jvm.org.apache.hadoop.fs.Path(source, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.close()


def write_star(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each table to a folder of its own name; returns where each went."""
    paths = {name: f"{folder}/{name}" for name in tables}
    for name, df in tables.items():
        if fmt == "csv":
            write_csv(df, paths[name])
        else:
            options = {"compression": CODEC} if fmt == "parquet" else {}
            df.write.format(fmt).options(**options).save(paths[name])
    return paths
