"""Frequency tables by hand, and the long path against the short one."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from canvass.operators import frequency as fr


def table(df):
    return {(r.variable, r.row_kind, r.value): tuple(r)[3:] for r in df.collect()}


DATA = [(1,), (1,), (2,), (None,), (10,)]


@pytest.mark.parametrize("few", [True, False])
def test_frequency_by_hand(spark, few):
    got = table(fr.frequency(spark.createDataFrame(DATA, "x int"), "x", few_levels=few))
    assert got == {
        ("x", "value", "1"): (2, 50.0, 50.0, 40.0, 40.0),
        ("x", "value", "2"): (1, 25.0, 75.0, 20.0, 60.0),
        ("x", "value", "10"): (1, 25.0, 100.0, 20.0, 80.0),
        ("x", "missing", "<NA>"): (1, None, None, 20.0, 100.0),
        ("x", "total", "Total"): (5, 100.0, 100.0, 100.0, 100.0),
    }


def test_without_missing_report(spark):
    got = table(fr.frequency(spark.createDataFrame(DATA, "x int"), "x", report_missing=False))
    assert got[("x", "value", "2")] == (1, 25.0, 75.0, 25.0, 75.0)
    assert got[("x", "total", "Total")] == (4, 100.0, 100.0, 100.0, 100.0)
    assert not [k for k in got if k[1] == "missing"]


def test_text_sorts_as_text_and_whole_doubles_print_plain(spark):
    df = spark.createDataFrame([("9", 398.0), ("10", 398.5), ("10", None)], "t string, d double")
    got = table(fr.frequency(df, ["t", "d"]))
    assert got[("t", "value", "10")][2] == pytest.approx(200 / 3)
    assert got[("t", "value", "9")][2] == 100.0
    assert ("d", "value", "398") in got and ("d", "value", "398.5") in got


def test_all_missing(spark):
    got = table(fr.frequency(spark.createDataFrame([(None,), (None,)], "x int"), "x"))
    assert got == {
        ("x", "missing", "<NA>"): (2, None, None, 100.0, 100.0),
        ("x", "total", "Total"): (2, None, None, 100.0, 100.0),
    }


def test_levels_added_up_in_parts_equal_one_task(spark):
    df = spark.range(5000).select((F.col("id") % 1234).alias("a"),
                                  F.when(F.col("id") % 3 > 0, F.col("id") % 77).cast("string")
                                  .alias("b"))
    assert table(fr.frequency(df, ["a", "b"])) == table(fr.frequency(df, ["a", "b"], few_levels=True))


def test_numbers_that_a_double_cannot_tell_apart_keep_their_order(spark):
    base = 10 ** 17
    whole = [base - 1, base, base + 1, -base + 1, -base, -base - 1]
    df = spark.createDataFrame([(x, Decimal(x) / 10 ** 3, float(x)) for x in whole],
                               "w long, d decimal(30,3), f double")
    for name in ("w", "d"):
        rows = fr.placed_levels(df, [name]).orderBy("cum").select("value").collect()
        assert [Decimal(r[0]) for r in rows] == sorted(Decimal(x) / (1 if name == "w" else 1000) for x in whole)


def test_masked_keeps_unknown_as_missing(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "stand int, x int")
    kept = fr.masked(df, F.col("stand") == 1, ["x"])
    assert sorted([r.x for r in kept.collect()], key=str) == [5, None]
    got = table(fr.frequency(kept, "x", few_levels=True))
    assert got[("x", "missing", "<NA>")][0] == 1


def test_percentages_add_up(spark):
    df = spark.range(997).select((F.col("id") * F.col("id") % 13).alias("x"))
    got = table(fr.frequency(df, "x"))
    shares = [v[1] for k, v in got.items() if k[1] == "value"]
    assert sum(shares) == pytest.approx(100.0)
    assert max(v[2] for k, v in got.items() if k[1] == "value") == 100.0
