"""Row numbers and running totals that never meet in one task."""

import random

from pyspark.sql import functions as F

from canvass.operators import ordering


def test_row_numbers_are_dense_and_follow_the_order(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, *range(50)]), rng.choice("abc"), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, t string, i int").repartition(7)
    got = ordering.with_row_number(df, ["k", "t", "i"], "n").orderBy("n").collect()
    expected = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    assert [(r.k, r.t, r.i) for r in got] == expected
    assert [r.n for r in got] == list(range(1, 3001))


def test_ties_and_exact_copies_still_get_distinct_numbers(spark):
    df = spark.createDataFrame([(1, "x")] * 500 + [(2, "y")] * 20, "k int, t string").repartition(5)
    got = ordering.with_row_number(df, ["k"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 521))
    assert {r.k for r in got if r.n <= 500} == {1}


def test_row_names_are_text(spark):
    got = ordering.with_row_names(spark.range(3), ["id"], "name").orderBy("id").collect()
    assert [r.name for r in got] == ["1", "2", "3"]


def test_running_totals_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k")).repartition(6)
        placed = ordering._placed(df, ["k"])
        assert placed.select("_part").distinct().count() > 1
        got = ordering.with_running_totals(df, ["k"], {"sum": "k"}).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    total = 0
    for i, row in enumerate(got):
        total += i
        assert (row.k, row["sum"]) == (i, total)


def test_arrange_puts_missing_last(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (2, 1), (1, 5)], "a int, b int")
    got = [tuple(r) for r in ordering.arrange(df, "a", "b").collect()]
    assert got == [(1, 5), (2, 1), (2, None), (None, 1)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int")
    assert ordering.with_row_number(df, ["k"], "n").collect() == []
