"""Truth tables of the missing-value rules."""

import itertools

import pytest
from pyspark.sql import functions as F

from canvass.functions import na

TRUTH = [True, False, None]


def one(spark, schema, data, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_if_else_is_unknown_where_its_test_is(spark):
    got = one(spark, "t boolean", [(t,) for t in TRUTH], na.if_else(F.col("t"), 1, 0))
    assert got == [(1,), (0,), (None,)]


def test_cascade_stops_at_the_first_unknown_test(spark):
    data = list(itertools.product(TRUTH, TRUTH))
    got = one(spark, "a boolean, b boolean", data,
              na.cascade((F.col("a"), 1), (F.col("b"), 2), otherwise=3))

    def nested(a, b):
        if a is None:
            return None
        if a:
            return 1
        return None if b is None else (2 if b else 3)

    assert [g[0] for g in got] == [nested(a, b) for a, b in data]


def test_membership_is_never_unknown(spark):
    got = one(spark, "x int", [(1,), (2,), (None,)],
              na.is_in(F.col("x"), [1, 4]), na.not_in(F.col("x"), [1, 4]),
              na.is_in(F.col("x"), [1, None]), na.not_in(F.col("x"), [1, None]),
              na.is_in(F.col("x"), []), na.is_in(F.col("x"), [None]))
    assert got == [
        (True, False, True, False, False, False),
        (False, True, False, True, False, False),
        (False, True, True, False, False, True),
    ]


def test_text_na_does_not_match_missing(spark):
    got = one(spark, "x string", [("1",), ("NA",), (None,)],
              na.is_in(F.col("x"), ["1", "NA"]))
    assert got == [(True,), (True,), (False,)]


def test_paste_writes_na(spark):
    got = one(spark, "a int, b string", [(1, "x"), (1, None), (None, None)],
              na.paste(F.col("a"), F.col("b"), F.lit("1")))
    assert got == [("1_x_1",), ("1_NA_1",), ("NA_NA_1",)]


@pytest.mark.parametrize("values, strict, present", [
    ([1, 2], 3, 3), ([1, None], None, 1), ([None, None], None, 0), ([], 0, 0),
])
def test_sums(spark, values, strict, present):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = df.agg(na.sum_strict(F.col("x")), na.sum_present(F.col("x"))).first()
    assert tuple(got) == (strict, present)


@pytest.mark.parametrize("values, n", [([1, 1, 2], 2), ([1, None, None], 2), ([None], 1), ([], 0)])
def test_distinct_counts_missing_once(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert tuple(df.agg(na.n_distinct(F.col("x")), na.n_distinct_approx(F.col("x"))).first()) == (n, n)
