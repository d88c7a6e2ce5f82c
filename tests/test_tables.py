"""Reshaping, labels, dimensions, health answers, codebook, funnels, sources."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass import vocabulary as v
from canvass.functions.text import decimal_text
from canvass.operators import labels, reshape, summary
from canvass.operators.codebook import codebook
from canvass.operators.frequency import labelled_frequency
from canvass.plans import dashboard, dimensions
from canvass import session as sessions
from canvass.session import fresh_path, shared_dir
from canvass.sinks import writers
from canvass.sources.scan import FileStore, JdbcStore, TableMap, footer_scan, min_max, scan


def test_stack_same_matches_by_name_and_keeps_copies(spark, rows):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert rows(reshape.stack_same(a, a.select("b", "a"))) == [(1, "x"), (1, "x")]
    with pytest.raises(ValueError):
        reshape.stack_same(a, a.select("a"))
    assert rows(reshape.stack_fill(a, a.select("a"))) == [(1, "x"), (1, None)]


def test_melt_keeps_missing(spark, rows):
    df = spark.createDataFrame([(1, 2, None)], "id int, a int, b int")
    assert rows(reshape.melt(df, ["id"], ["a", "b"])) == [(1, "a", 2), (1, "b", None)]
    mixed = spark.createDataFrame([(1, 2.0, "t")], "id int, a double, b string")
    assert rows(reshape.melt(mixed, ["id"], ["a", "b"])) == [(1, "a", "2"), (1, "b", "t")]


def test_gather_distinct(spark, rows):
    df = spark.createDataFrame([(1, None), (1, 2)], "a int, b int")
    assert rows(reshape.gather_distinct(df)) == [("a", 1), ("b", 2)]
    assert len(rows(reshape.gather_distinct(df, drop_missing=False))) == 3


def test_variable_labels_survive(spark, tmp_path):
    df = labels.label_variables(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "Label A"})
    df = labels.cast_labelled(df.filter("b > 0").select("a", "b"), "a", "bigint")
    assert labels.label_of(df, "a") == "Label A" and dict(df.dtypes)["a"] == "bigint"
    df.write.parquet(str(tmp_path / "t"))
    assert labels.label_of(spark.read.parquet(str(tmp_path / "t")), "a") == "Label A"


def test_labelled_frequency(spark, rows):
    df = labels.label_variables(spark.createDataFrame([(1,), (1,), (6,), (None,)], "SCQ600 int"),
                                v.DWELLING_VARIABLE_LABELS)
    got = labelled_frequency(df, ["SCQ600"], labels.variable_labels(df),
                             labels.value_labels(spark, v.DWELLING_VALUE_LABELS))
    text = v.DWELLING_VARIABLE_LABELS["SCQ600"]
    assert rows(got) == [("SCQ600", text, "1", "Excellent", 2), ("SCQ600", text, "6", None, 1),
                         ("SCQ600", text, None, None, 1)]


def test_pending_labels_cover_a_missing_category(spark, rows):
    df = spark.createDataFrame([(1,), (None,)], "screener_pending3cat int")
    got = labels.decode(df, "screener_pending3cat", labels.code_labels(spark, v.PENDING_LABELS),
                        "text")
    assert rows(got) == [(1, "Screener Not Worked"),
                         (None, "contact dashboard manager about missing data")]


def test_stand_dimension(spark):
    cases = spark.createDataFrame([(s,) for s in (420, 421, 799, 800, 421, None)], "standid int")
    got = {(r.standid, r.active_stand) for r in dimensions.stand_dimension(cases).collect()}
    assert got == {(420, 2), (421, 1), (799, 1), (800, 2), (None, None), (500, 1)}


def test_slicer(spark):
    people = spark.createDataFrame(
        [(1, 2, 1, 4, 2, 9), (2, 5, None, 1, 7, 1)],
        "dwellingid int, participant_selected_as_SP int, participant_gender int, "
        "participant_race int, participant_ethnicity int, participant_active_mil int")
    got = {(r.slicer_ID, r.variable): r.valuelabel
           for r in dimensions.demographics_slicer(
        dimensions.numbered_participants(people, ["dwellingid"])).collect()}
    assert len(got) == 10
    assert got[("1", "participant_selected_as_SP")] == "Not selected as SP"
    assert got[("2", "participant_selected_as_SP")] == v.RECODE_ERROR_LABEL
    assert got[("2", "participant_gender")] == v.MISSING_LABEL
    assert got[("1", "participant_race")] == "Asian"
    assert got[("1", "participant_active_mil")] == "Don't know"


def test_health_answers_sum_codes_and_drop_missing_keys(spark, rows):
    df = spark.createDataFrame(
        [(398, 2, 1), (398, 2, None), (None, 2, 1), (399, 7, 1)], "SDASTAND int, SCQ600 int, q int")
    df = df.select("SDASTAND", "SCQ600", *[F.col("q").alias(c) for c in
                                           ("SCQ610", "SCQ620", "SCQ630", "SCQ640")])
    got = [r for r in rows(dashboard.health_answers(df)) if r[3].startswith("Self- rep")]
    assert [r[:3] for r in got] == [(398, 2, 4), (399, 7, 7)]


def test_stage_grid_has_every_step(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, None)],
                               "standid int, a int, b int")
    got = {(r.standid, r.screenerstage): r["count"]
           for r in summary.stage_grid(df, "standid", [("a", 2), ("b", 3)], 1, 4, ["b"]).collect()}
    assert got == {(1, 1): None, (1, 2): 2, (1, 3): None, (1, 4): None,
                   (None, 1): None, (None, 2): 1, (None, 3): None, (None, 4): None}


def test_daily_running(spark, rows):
    at = [datetime(2021, 1, d, 5) for d in (1, 1, 2)]
    df = spark.createDataFrame([(1, at[0], 1), (1, at[1], None), (1, at[2], 1), (1, None, 1)],
                               "s int, t timestamp_ntz, f int")
    got = [r[2:] for r in rows(summary.daily_running(df, "s", "t", "f"))]
    assert got == [(2, 1, 1), (1, 1, 2), (1, 1, 3)]


@pytest.mark.parametrize("exact", [True, False])
def test_codebook(spark, exact):
    df = spark.createDataFrame(
        [(1, "b", 1.5), (2, "a", None), (3, "b", 4.0), (4, None, 4.0)], "i int, t string, d double")
    got = {r.variable: r for r in codebook(labels.label_variables(df, {"t": "Text"}), exact).collect()}
    assert (got["i"].min, got["i"].q1, got["i"].median, got["i"].q3, got["i"].max) == (
        "1", "1", "2", "3", "4")
    assert (got["t"].label, got["t"].missing, got["t"].distinct, got["t"].mode,
            got["t"].mode_freq, got["t"].q1) == ("Text", 1, 2, "b", 2, None)
    assert (got["d"].min, got["d"].max, got["d"].mode, got["d"].n) == ("1.5", "4", "4", 4)
    assert got["i"].mode_freq == 1 and (got["i"].mode == "1" or not exact)
    assert (got["d"].q1, got["d"].median) == ("1.5", "4")


def test_quartiles_from_long_lists(spark):
    df = spark.range(997).select((F.col("id") * 31 % 997).alias("x"),
                                 F.date_add(F.lit("2021-01-01"), F.col("id").cast("int")).alias("d"))
    got = {r.variable: r for r in codebook(df).collect()}
    assert [got["x"][q] for q in ("q1", "median", "q3")] == ["249", "498", "747"]
    assert got["d"].median == "2022-05-14" and got["x"].distinct == 997


def test_sketched_codebook_needs_no_row_per_cell(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"))
    book = codebook(df, exact=False)
    plan = book._jdf.queryExecution().toString()
    assert "Generate" not in plan.split("== Physical Plan ==")[1].split("HashAggregate")[-1]
    got, exact = ({r.variable: r for r in b.collect()} for b in (book, codebook(df)))
    for name in ("x", "t"):
        assert got[name].asDict() == exact[name].asDict()


def test_scans_push_columns_and_filters(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("A"), (F.col("id") * 2).alias("B"),
                           F.lit("x").alias("C")).write.parquet(str(tmp_path / "t.parquet"))
    store = FileStore(spark, str(tmp_path))
    got = scan(store, TableMap.renamed("t", {"A": "a"}), F.col("B") == 6)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert got.collect() == [(3,)] and "EqualTo(B,6)" in plan
    assert "ReadSchema: struct<A:bigint,B:bigint>" in plan
    assert min_max(scan(store, "t"), "B").collect() == [(18, 0)]


def test_jdbc_options_split_the_read(spark):
    store = JdbcStore(spark, "jdbc:x", {"driver": "d"}, {"case": ("SDASTAND", 1, 900, 64)})
    assert store.reader_options("case") == {
        "url": "jdbc:x", "dbtable": "case", "driver": "d", "partitionColumn": "SDASTAND",
        "lowerBound": "1", "upperBound": "900", "numPartitions": "64"}
    assert store.query_options("SELECT a FROM t", ("a", 1, 9, 4)) == {
        "url": "jdbc:x", "dbtable": "(SELECT a FROM t) pushed", "driver": "d", "partitionColumn": "a",
        "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    assert store.reader_options("other") == {"url": "jdbc:x", "dbtable": "other", "driver": "d"}


def test_numbers_print_in_full(spark):
    values = [1.0, -0.0, 0.5, 1234567890.25, 1e-5, 100.0, None, float("inf"), 1e-21, -1e18, 2e23,
              1.2345678901234567e-8, 9.529635e19, 2.5e-300, 1.7976931348623157e308, float("nan")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(decimal_text(F.col("x"), ",", T.DoubleType())).collect()]
    assert got == [None if x is None else "Infinity" if x == float("inf") else "NaN" if x != x else
                   (format(Decimal(repr(x)), "f").rstrip("0").rstrip(".") if x else "0").replace(".", ",")
                   if x != int(x) or not x else str(int(Decimal(repr(x)))) for x in values]


def text_of(path):
    import glob
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "a;b"', 1.5), (2, None, None)],
                               "k int, t string, d double").coalesce(1)
    writers.write_csv(df, str(tmp_path / "a"))
    assert text_of(tmp_path / "a") == 'k,t,d\n1,"say ""a;b""",1.5\n2,,\n'
    writers.write_csv2(df, str(tmp_path / "b"), row_names=["k"])
    assert '"";k;t;d\n' in text_of(tmp_path / "b")
    assert '1;1;"say ""a;b""";1,5\n' in text_of(tmp_path / "b")
    assert "2;2;NA;NA\n" in text_of(tmp_path / "b")
    writers.write_table(df, str(tmp_path / "c"))
    assert text_of(tmp_path / "c") == '"k" "t" "d"\n"1" "say ""a;b""" "1.5"\n"2" "NA" "NA"\n'


def test_shared_dir_is_the_clusters_own(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert shared_dir(spark) == folder.rstrip("/")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_written_tables_can_be_discarded(spark):
    kept, sessions._written[:] = list(sessions._written), []
    try:
        df = sessions.write_once(spark.range(5), "test")
        assert df.count() == 5
        assert sessions.discard_written(spark) == 1 and sessions._written == []
    finally:
        sessions._written[:] = kept


def test_shuffle_partitions():
    assert sessions.shuffle_partitions(100 << 40, 8000) == 208_000
    assert sessions.shuffle_partitions(1, 8) == 8


def test_smallest_and_largest_come_from_parquet_footers(spark, tmp_path):
    spark.range(10, 500).write.parquet(str(tmp_path / "t"))
    result = min_max(footer_scan(spark, str(tmp_path / "t")), "id")
    assert "PushedAggregation: [MAX(id), MIN(id)]" in result._jdf.queryExecution().toString()
    assert tuple(result.first()) == (499, 10)
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_table_with_row_names_has_one_shifted_header(spark, tmp_path):
    df = spark.createDataFrame([(3, 'say "x"', 2.5), (1, None, 1.0), (2, "é", None), *[(i, "t", 0.5) for i in range(4, 200)]],
                               "k int, `a 'b` string, d double").repartition(5)
    writers.write_table(df, str(tmp_path / "t"), row_names=["k"])
    assert writers.read_header(spark, str(tmp_path / "t")) == df.columns
    writers.join_parts(spark, str(tmp_path / "t"), str(tmp_path / "one.txt"))
    lines = (tmp_path / "one.txt").read_text().splitlines()
    assert lines[0] == '"k" "a \'b" "d"' and len(lines) == 200
    assert lines[1:4] == ['"1" "1" "NA" "1"', '"2" "2" "é" "NA"', '"3" "3" "say ""x""" "2.5"']
    assert [line.split()[0] for line in lines[1:]] == [f'"{i}"' for i in range(1, 200)]


def test_row_names_leave_no_sorted_copy_and_finished_columns_come_last(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, t string")
    before = list(sessions._written)

    def keyed(rows):
        return rows.withColumn("u", F.concat_ws("_", "k", "t"))

    writers.write_csv(df, str(tmp_path / "a"), row_names=["k"], finish=keyed)
    writers.write_table(df, str(tmp_path / "b"), row_names=["k"], finish=keyed)
    assert sessions._written == before
    assert text_of(tmp_path / "a") == '"",k,t,u\n1,1,,1\n2,2,b,2_b\n'
    assert writers.read_header(spark, str(tmp_path / "b")) == ["k", "t", "u"]
    writers.write_csv(df, str(tmp_path / "c"), finish=keyed)
    assert text_of(tmp_path / "c").startswith("k,t,u\n")


def test_one_written_table_can_be_discarded(spark):
    kept, sessions._written[:] = list(sessions._written), []
    try:
        a, b = sessions.write_once(spark.range(5), "test"), sessions.write_once(spark.range(6), "test")
        sessions.discard(a)
        assert len(sessions._written) == 1 and b.count() == 6
        with pytest.raises(Exception):
            a.collect()
    finally:
        sessions.discard_written(spark)
        sessions._written[:] = kept
