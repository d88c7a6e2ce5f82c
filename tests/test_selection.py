"""Order statistics by range refinement against sorting."""

import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.operators import selection
from canvass.operators.codebook import codebook

SHARES = [0.25, 0.5, 0.75]


def plain(values):
    held = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    return [held[max(math.ceil(len(held) * s), 1) - 1] if held else None for s in SHARES]


def found(df):
    kinds = {f.name: f.dataType for f in df.schema.fields}
    axes = {n: selection.on_axis(n, k) for n, k in kinds.items()}
    row = df.agg(*[e.alias(f"{t}{n}") for n, x in axes.items() for t, e in (
        ("known", F.count(x)), ("start", selection.sketch(x, SHARES)), ("least", F.min(x)), ("most", F.max(x)))]).first()
    got = selection.order_statistics(
        df, axes, SHARES, {n: row[f"known{n}"] for n in axes}, {n: row[f"start{n}"] for n in axes},
        {n: selection.doubles_hold(k, row[f"least{n}"], row[f"most{n}"]) for n, k in kinds.items()})
    shown = df.sparkSession.range(1).select(*[selection.from_axis(v, kinds[n]).alias(f"{n}{i}")
                                              for n, held in got.items() for i, v in enumerate(held)]).first()
    return {n: [shown[f"{n}{i}"] for i in range(len(SHARES))] for n in axes}


def table(spark, n, seed):
    rng = random.Random(seed)
    at = datetime(1901, 1, 1)
    kinds = {"i": "int", "l": "long", "d": "double", "s": "double", "c": "decimal(38,10)", "b": "tinyint", "day": "date",
             "t": "timestamp_ntz", "none": "long", "f": "float", "hot": "long"}
    rows = [(rng.choice([None, rng.randint(-50, 50)]), 2 ** 60 + rng.randint(0, 3000), rng.expovariate(1) ** 9 * rng.choice([-1, 1]),
             rng.choice([1e-300, 5e-300, 1e300, float("inf"), float("nan"), -0.0]), Decimal(rng.randint(0, 10 ** 6)) + Decimal("1e17"),
             rng.randint(0, 3), date(1950, 1, 1) + timedelta(rng.randint(0, 30000)), at + timedelta(microseconds=rng.randint(0, 10 ** 16)),
             None, float(rng.randint(0, 999)) / 8, 7 if rng.random() < 0.6 else rng.randint(0, 10 ** 6)) for _ in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in kinds.items())).repartition(3), rows


@pytest.mark.parametrize("n, accuracy, grid", [(3000, 50_000, 200), (3000, 40, 8), (7, 40, 8)])
def test_ranks_equal_sorting(spark, monkeypatch, n, accuracy, grid):
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "GRID", grid)
    monkeypatch.setattr(selection, "FINAL_ROWS", 50)
    df, rows = table(spark, n, n + grid)
    got = found(df)
    for k, name in enumerate(df.columns):
        assert [v == v and v for v in got[name]] == [v == v and v for v in plain([r[k] for r in rows])], name


def test_empty_table_has_no_ranks(spark):
    df = spark.createDataFrame([], "x int, y double")
    assert found(df) == {"x": [None] * 3, "y": [None] * 3}


def test_codebook_neither_sorts_nor_writes_levels(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("x"), (F.col("id") % 3).cast("string").alias("t"),
                                  F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 0, int(id))").alias("at"))
    book = codebook(df)
    plan = book._sc._jvm.PythonSQLUtils.explainString(book._jdf.queryExecution(), "simple")
    assert "rangepartitioning" not in plan and "Window" not in plan and "CartesianProduct" not in plan and "\n+- Sort [" not in plan
    got = {r.variable: r for r in book.collect()}
    assert (got["x"].q1, got["x"].median, got["x"].q3, got["x"].distinct) == tuple(
        map(str, plain([i * 7919 % 4001 for i in range(4000)]))) + (4000,)
    assert (got["t"].mode, got["t"].mode_freq, got["at"].median) == ("0", 1334, "2020-01-02 09:19:00")
    none = {r.variable: r for r in codebook(df.limit(0)).collect()}
    assert (none["x"].n, none["x"].median, none["x"].distinct, none["x"].mode, none["x"].mode_freq) == (0, None, 0, None, None)
    assert isinstance(df.schema["at"].dataType, T.TimestampType)
