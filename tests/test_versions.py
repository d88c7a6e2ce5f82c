"""Published versions, the daily state, bucketed links and equal-depth reads."""

import datetime

import pytest
from pyspark.sql import functions as F

from canvass.operators import bucketed
from canvass.operators.bucketed import bucket_pair, linked_join
from canvass.operators.joins import join
from canvass.operators.summary import daily_running, stage_counts
from canvass.plans.daily_state import DailyState
from canvass.sinks import versions
from canvass.sources import splits
from canvass.sources.scan import JdbcStore


def test_a_failed_publish_leaves_the_version_before(spark, rows, tmp_path):
    folder = str(tmp_path / "star")
    assert versions.published(spark, folder) == {} and versions.numbers(spark, folder) == []
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "a int, b string")
    assert versions.publish(spark, folder, {"a": a, "b": a.limit(0)}) == 1
    broken = a.withColumn("a", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, folder, {"a": a.filter("a = 1"), "b": broken})
    assert versions.numbers(spark, folder) == [1] and versions.differing(spark, folder) == []
    tables = versions.published(spark, folder)
    assert tables["a"].rows == 3 and tables["b"].rows == 0
    assert rows(tables["a"].read(spark)) == [(1, "x"), (1, "x"), (None, None)]


def test_versions_are_compared_kept_and_retired(spark, rows, tmp_path):
    folder = str(tmp_path / "star")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    versions.publish(spark, folder, {"same": a, "rows": a, "content": a, "schema": a, "gone": a})
    kept = {"same": versions.published(spark, folder)["same"]}
    versions.publish(spark, folder, {"rows": a.unionAll(a), "content": a.withColumn("b", F.lit("z")),
                                     "schema": a.withColumn("a", F.col("a").cast("long")), "new": a}, keep=kept)
    assert versions.changed(spark, folder, 1, 2) == {"rows": "rows", "content": "content", "schema": "schema",
                                                     "gone": "gone", "new": "added"}
    assert rows(versions.published(spark, folder, 1)["rows"].read(spark)) == [(1, "x"), (2, "y")]
    assert versions.retire(spark, folder, 1) == 1 and versions.numbers(spark, folder) == [2]
    assert versions.differing(spark, folder) == []  # what the old version shared with the new one is still there


def test_a_taken_number_is_not_replaced(spark, tmp_path):
    folder = str(tmp_path / "star")
    versions.add_manifest(spark, folder, 1, {"tables": {}, "note": {"by": "one"}})
    with pytest.raises(versions.VersionTaken):
        versions.add_manifest(spark, folder, 1, {"tables": {}, "note": {"by": "two"}})
    assert versions.read_manifest(spark, folder)["note"] == {"by": "one"}


def test_a_damaged_table_is_found(spark, tmp_path):
    folder = str(tmp_path / "star")
    a = spark.range(10)
    versions.publish(spark, folder, {"a": a, "b": a})
    a.limit(1).write.mode("append").parquet(versions.published(spark, folder)["b"].path)
    assert versions.differing(spark, folder) == ["b"]


CASES = [("s", "2020-01-01", 1), ("s", "2020-01-01", None), ("s", "2020-01-02", 1), ("t", "2020-01-02", 0),
         (None, "2020-01-03", 1), ("s", None, 1)]


def _cases(spark, picked):
    return spark.createDataFrame(picked, "g string, d string, flag int").withColumn("d", F.to_timestamp("d"))


def test_daily_state_equals_the_whole_computation(spark, rows, tmp_path):
    state = DailyState(spark, str(tmp_path / "state"), "g", "d", ["flag"])
    assert state.add("one", _cases(spark, CASES[:2])) and state.add("two", _cases(spark, CASES[2:]))
    assert not state.add("two", _cases(spark, CASES[2:]))
    whole = _cases(spark, CASES)
    assert rows(state.curve("flag")) == rows(daily_running(whole, "g", "d", "flag"))
    for strict in ([], ["flag"]):
        assert rows(state.stage_counts([("flag", 4)], strict)) == rows(stage_counts(whole, "g", [("flag", 4)], strict))
    state.compact()
    assert rows(state.curve("flag")) == rows(daily_running(whole, "g", "d", "flag"))
    assert not state.add("one", whole) and state.labels() == ["one", "two"]


def test_daily_state_replaces_and_withdraws_days(spark, rows, tmp_path):
    state = DailyState(spark, str(tmp_path / "state"), "g", "d", ["flag"])
    state.add("all", _cases(spark, CASES))
    late = _cases(spark, [("u", "2020-01-02", 1), ("s", None, 0)])
    state.replace("late", late)  # the missing day is a day
    kept = [c for c in CASES if c[1] in ("2020-01-01", "2020-01-03")]
    whole = _cases(spark, [*kept, ("u", "2020-01-02", 1), ("s", None, 0)])
    assert rows(state.curve("flag")) == rows(daily_running(whole, "g", "d", "flag"))
    days = spark.createDataFrame([("2020-01-03",)], "d string")
    state.replace("emptied", _cases(spark, []), days)
    state.withdraw("back", late)
    assert rows(state.curve("flag")) == rows(daily_running(_cases(spark, CASES[:2]), "g", "d", "flag"))


def test_bucketed_link_moves_no_rows(spark, rows, tmp_path):
    left = spark.range(200).selectExpr("cast(id % 20 as string) AS k", "id AS a")
    right = spark.range(20).selectExpr("cast(id AS string) AS k", "id * 10 AS b")
    with_threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = bucket_pair(left, right, "k", 4)
        linked = linked_join(a, b)
        assert "Exchange" not in linked._jdf.queryExecution().executedPlan().toString()
        assert a.apart is None and rows(linked) == rows(join(left, right, ["k"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_threshold)


def test_missing_and_hot_keys_stay_out_of_the_buckets(spark, rows):
    left = spark.range(400).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, 'hot', cast(id AS string))) AS k", "id AS a")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("2", 4)], "k string, b int")
    limits = {"hot_rows": 50, "hot_share": 0.1, "rows_per_split": 20}
    a, b = bucket_pair(left, right, "k", 4, **limits)
    assert rows(a.even.selectExpr("max(k = 'hot') AS h", "max(k IS NULL) AS n")) == [(False, False)]
    assert a.apart.count() == 200 and rows(a.rows()) == rows(left)
    for how in ("left", "inner"):
        assert rows(linked_join(a, b, how, **limits)) == rows(join(left, right, ["k"], how))
    with pytest.raises(ValueError):
        bucket_pair(left, right.withColumn("k", F.lit(1)), "k", 4)


@pytest.mark.parametrize("key", ["cast(pow(id, 3) / 1e6 AS double)", "cast(if(id % 3 = 0, 7, id) AS int)",
                                 "date_add(date'1960-01-01', cast(sqrt(id) * 9 AS int))",
                                 "if(id % 2 = 0, null, cast(id % 5 AS bigint))", "timestamp_seconds(id * id)"])
def test_reads_are_of_equal_depth(spark, key):
    df = spark.range(6000).selectExpr(f"{key} AS k", "id AS other")
    parts = splits.equal_depth(df, "k", 6, "other")
    counts = [df.filter(p).count() for p in parts]
    met = sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in parts), F.lit(0))
    assert df.filter(met != 1).isEmpty() and sum(counts) == 6000
    assert max(counts) < 2 * 6000 / 6
    assert splits.equal_depth(df.limit(0), "k", 6) == ["k IS NOT NULL", "k IS NULL"]


def test_split_literals_and_stores():
    assert splits._text(datetime.date(1969, 12, 31)) == "DATE '1969-12-31'"
    with pytest.raises(TypeError):
        splits._text("text")
    assert JdbcStore(None, "jdbc:x", predicates={"t": ["a = 1"]}).predicates["t"] == ["a = 1"]


def test_content_hash_is_the_exact_sum_without_a_decimal_per_row(spark):
    df = spark.range(-500, 500).select(F.col("id").alias("a"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("b"))
    exact = [sum(r[0] for r in df.select(h).collect()) for h in (F.xxhash64("a", "b"), F.xxhash64(F.lit(1), "a", "b"))]
    found = df.agg(versions.content_hash(df.columns).alias("c"))
    assert found.first()["c"] == "/".join(map(str, exact))
    assert "sum(cast(xxhash64" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert df.limit(0).agg(versions.content_hash(df.columns)).first()[0] == "0/0"
    edges = spark.createDataFrame([(2 ** 63 - 1,), (2 ** 63 - 1,), (-2 ** 63,), (-1,)], "n long")
    assert int(edges.agg(versions._wide_sum(F.col("n"))).first()[0]) == 2 * (2 ** 63 - 1) - 2 ** 63 - 1


def test_bucket_pair_counts_and_deals_from_one_written_copy(spark, rows, monkeypatch):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, l string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k int, r string")
    seen = []
    monkeypatch.setattr(bucketed, "hot_keys", lambda a, b, key, **hot: seen.extend([a.inputFiles(), b.inputFiles()]))
    a, b = bucket_pair(left, right, "k", 2)
    assert len(seen) == 2 and all(any("-whole" in f for f in files) for files in seen)
    assert rows(linked_join(a, b), "l", "r") == [("a", "x"), ("b", None), ("c", None)]


def test_columns_that_follow_from_a_row_are_added_in_the_buckets(spark, rows, monkeypatch):
    left = spark.range(400).selectExpr("if(id % 4 = 0, null, if(id % 4 = 1, 'hot', cast(id AS string))) AS part", "id AS a")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("2", 4)], "part string, b int")

    def keyed(df):
        return df.select(F.concat(F.lit("k"), "part").alias("k"), "*", F.repeat(F.lit("wide"), 9).alias(f"wide_{df.columns[1]}"))

    copies, write = {}, bucketed.write_once
    monkeypatch.setattr(bucketed, "write_once", lambda df, name: copies.setdefault(name, df.columns) and write(df, name))
    limits = {"hot_rows": 50, "hot_share": 0.1, "rows_per_split": 20}
    a, b = bucket_pair(left, right.withColumnRenamed("part", "part_r"), "k", 4, finish_left=keyed,
                       finish_right=lambda df: keyed(df.withColumnRenamed("part_r", "part")).withColumnRenamed("part", "part_r"), **limits)
    assert copies["left-whole"] == ["part", "a"] and copies["right-whole"] == ["part_r", "b"]
    assert rows(a.rows()) == rows(keyed(left)) and a.apart.count() == 200
    assert rows(a.even.selectExpr("max(part = 'hot') AS h", "max(k IS NULL) AS n")) == [(False, False)]
    for how in ("left", "inner"):
        assert rows(linked_join(a, b, how, take=["b", "wide_b"], **limits)) == rows(
            join(keyed(left), keyed(right), ["k"], how, take=["b", "wide_b"]))
