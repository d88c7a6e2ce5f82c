"""Joins against brute force, with hot keys on either side."""

import random

import pytest
from pyspark.sql import functions as F

from canvass.operators import joins

HOT = dict(hot_rows=8, hot_share=0.05, rows_per_split=3)


def brute(left, right, how, null_safe):
    out = []
    for l in left:
        hits = [r for r in right if (l[0] == r[0] if null_safe else
                                     l[0] is not None and l[0] == r[0])]
        if how == "left_anti":
            out += [] if hits else [l]
        elif hits:
            out += [(*l, r[1]) for r in hits]
        elif how == "left":
            out.append((*l, None))
    return out


def keyed(seed, cold, hot_left, hot_right, missing):
    rng = random.Random(seed)
    left = [(rng.randrange(40), i) for i in range(cold)] + [(7, 1000)] * hot_left
    right = [(rng.randrange(20, 60), i) for i in range(cold)] + [(7, 5000)] * hot_right
    left += [(None, i) for i in range(missing)]
    right += [(None, 9000 + i) for i in range(missing)]
    rng.shuffle(left)
    return left, right


def order(found):
    return sorted(found, key=str)


@pytest.mark.parametrize("hot_left, hot_right", [(0, 0), (60, 2), (2, 60), (40, 40), (30, 0)])
@pytest.mark.parametrize("how, null_safe", [("left", False), ("inner", False), ("left", True)])
def test_spread_join_equals_brute_force(spark, hot_left, hot_right, how, null_safe):
    left, right = keyed(hot_left + hot_right, 60, hot_left, hot_right, 12)
    a = spark.createDataFrame(left, "k int, a int").repartition(3)
    b = spark.createDataFrame(right, "k int, b int").repartition(3)
    got = joins.spread_join(a, b, ["k"], how, null_safe=null_safe, **HOT)
    assert got.columns == ["k", "a", "b"]
    assert order(map(tuple, got.collect())) == order(brute(left, right, how, null_safe))


def test_spread_join_really_salts_and_parts_copies(spark):
    a = spark.createDataFrame([(7, 0)] * 400, "k int, a int").repartition(4)
    b = spark.createDataFrame([(7, 1)], "k int, b int")
    got = joins.spread_join(a, b, ["k"], **HOT)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "_left_salt" in plan and got.count() == 400
    # All copies are in one partition, yet the written hot rows carry many salts.
    alike = spark.createDataFrame([(7, 0)] * 4000, "k int, a int").coalesce(1)
    counted = joins.spread_join(alike, b, ["k"], **(HOT | {"rows_per_split": 100}))
    assert counted.count() == 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert counted.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cold = joins.spread_join(a, b, ["k"])
    plan = cold._sc._jvm.PythonSQLUtils.explainString(cold._jdf.queryExecution(), "simple")
    assert "_left_salt" not in plan


def test_spread_anti_join(spark):
    left, _ = keyed(3, 50, 40, 0, 15)
    right = [(k, 0) for k in range(0, 40, 3)]
    a = spark.createDataFrame(left, "k int, a int")
    b = spark.createDataFrame(right, "k int, b int")
    got = joins.spread_join(a, b, ["k"], "left_anti", take=[], right_unique=True, **HOT)
    assert order(map(tuple, got.collect())) == order(brute(left, right, "left_anti", False))


def test_spread_join_on_two_keys_with_renamed_columns(spark):
    left = [(1, None, i) for i in range(20)] + [(1, 2, i) for i in range(20)]
    a = spark.createDataFrame(left, "p int, q int, v int")
    b = spark.createDataFrame([(1, 2, "x"), (1, None, "y")], "r int, s int, v string")
    got = joins.spread_join(a, b, [("p", "r"), ("q", "s")], prefix="b_", take=["v"], **HOT)
    assert order(map(tuple, got.collect())) == order(
        [(*l, "x" if l[1] == 2 else None) for l in left])


def test_join_keeps_unmatched_and_fans_out(spark, rows):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    b = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "k int, y int")
    assert rows(joins.join(a, b, ["k"])) == [(1, "a", 10), (1, "a", 11), (2, "b", None),
                                             (None, "c", None)]
    assert (None, "c", 12) in rows(joins.join(a, b, ["k"], null_safe=True))


def test_join_refuses_columns_on_both_sides(spark):
    a = spark.createDataFrame([(1, 2)], "k int, x int")
    with pytest.raises(ValueError, match="x"):
        joins.join(a, a, ["k"])
    assert joins.join(a, a, ["k"], prefix="r_").columns == ["k", "x", "r_k", "r_x"]


@pytest.mark.parametrize("right", [[1, 2], [1, None], [None], []])
def test_not_in_equals_sql(spark, right):
    a = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,)], "k int")
    b = spark.createDataFrame([(r,) for r in right], "k int")
    a.createOrReplaceTempView("not_in_left")
    b.createOrReplaceTempView("not_in_right")
    expected = spark.sql(
        "SELECT k FROM not_in_left WHERE k NOT IN (SELECT k FROM not_in_right)").collect()
    assert order(map(tuple, joins.not_in(a, b, "k").collect())) == order(map(tuple, expected))


def test_not_in_does_not_force_a_broadcast(spark):
    a, b = spark.range(1000).toDF("k"), spark.range(0, 1000, 2).toDF("k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.not_in(a, b, "k")
        plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
        assert "Broadcast" not in plan and found.count() == 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_share_of_group(spark, rows):
    data = [("d1", 1, 0), ("d1", 2, 7), ("d1", 2, 9), ("d2", 1, 3), (None, 2, 5), (None, 1, 1)]
    df = spark.createDataFrame(data, "d string, kind int, id int")
    got = joins.share_of_group(df, "d", F.when(F.col("kind") == 2, F.col("id")), "id2")
    expected = {"d1": 9, "d2": None, None: 5}
    assert {(r.d, r.id2) for r in got.collect()} == set(expected.items())
    assert got.count() == len(data)


def test_star_join_matches_a_missing_code(spark, rows):
    fact = spark.createDataFrame([(1, 1), (2, None), (3, 8)], "id int, code int")
    labels = spark.createDataFrame([(1, "one"), (None, "none")], "value int, text string")
    star = joins.star_join(fact, [(labels, [("code", "value")], {"text": "label"})])
    assert rows(star) == [(1, 1, "one"), (2, None, "none"), (3, 8, None)]


def test_pairs_below_both_limits_are_spread(spark):
    a = spark.createDataFrame([(i % 40 if i > 30 else 7, i) for i in range(1100)], "k int, a int").repartition(3)
    b = spark.createDataFrame([(7 if i < 60 else 100 + i, i) for i in range(1100)], "k bigint, b int").repartition(3)
    got = joins.spread_join(a, b, ["k"], "inner", hot_rows=1000, pairs_per_task=500)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "_left_salt" in plan
    left, right = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]
    assert order(map(tuple, got.collect())) == order(brute(left, right, "inner", False))
    splits = joins._hot_table(joins._Side(a, ["k"]), joins._Side(b, ["k"]), ["_h"], 1000, 1e-5, 10 ** 6, 500).collect()
    assert [r["_h"] for r in splits] == [7] and splits[0]["_left_splits"] * splits[0]["_right_splits"] >= 57 * 60 / 500


def test_heavy_hitters_are_found_without_counting_all_keys(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 4 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.lit("x").alias("q"))
    side = joins._Side(rows, ["k", "q"])
    heavy = joins._heavy([side, side], [2000, 10 ** 9], ["a", "b"], {"a": rows.schema["k"].dataType, "b": rows.schema["q"].dataType}, 600)
    assert "Exchange hashpartitioning" not in heavy._sc._jvm.PythonSQLUtils.explainString(heavy._jdf.queryExecution(), "simple")
    assert heavy.collect() == rows.where("k = -1").select(F.xxhash64("k", "q")).distinct().collect()


@pytest.mark.parametrize("bits", [16, 1])
@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_not_in_by_bloom_filter_equals_sql(spark, monkeypatch, bits, kind):
    monkeypatch.setattr(joins, "_broadcast_threshold", lambda spark: 1)
    monkeypatch.setattr(joins, "BLOOM_BITS", bits)
    a = spark.range(60000).select(F.when(F.col("id") % 100 > 0, F.col("id") * 7).cast(kind).alias("k"), "id")
    b = spark.range(40000).select((F.col("id") * 3).cast(kind).alias("k"))
    got = joins.not_in(a, b, "k")
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "_maybe" in plan or "getbit" in plan
    found = [r["id"] for r in got.collect()]
    assert sorted(found) == [i for i in range(60000) if i % 100 and (i * 7 % 3 or i * 7 >= 120000)]
    maybe = joins._bloom_marked(a.dropna(), "k", b.toDF("_key"), 40000).where("_maybe").count()
    real = sum(1 for i in range(60000) if i % 100 and i * 7 % 3 == 0 and i * 7 < 120000)
    assert real <= maybe <= real + (0.1 if bits == 16 else 0.8) * 60000 and (bits == 16 or maybe > real)
