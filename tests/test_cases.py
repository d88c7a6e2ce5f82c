"""Keys, current status and participant ids of the case fact."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.operators.keys import key_of, with_keys
from canvass.plans import cases as plan
from canvass.plans.dashboard import bucket_star, dashboard_fact, fact_rows, finished_fact, screener_stages

CASE = ("caseid bigint, standid int, segmentid int, dwellingid int, case_type int, familyid int, "
        "personid int, participantid int, mec_session_id int, interpreter_used int, "
        "proxy_used int, spanish_interview int, case_date timestamp_ntz, case_where_completed int")
CURRENT = ("caseid bigint, case_date timestamp_ntz, case_disposition string, employee_id int, "
           "case_ip_address string")


def case(caseid, dwelling, kind, participant, segment=1, stand=398, family=None, person=None):
    return (caseid, stand, segment, dwelling, kind, family, person, participant, None, 1, 1, 1,
            datetime(2021, 3, 1), 1)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([
        case(1, 1, 1, 0), case(2, 1, 2, 7),                       # propagated
        case(3, 2, 1, 0), case(4, 2, 2, None),                    # stops at missing
        case(5, 3, 1, 5),                                         # no relationship part
        case(6, 4, 1, 0), case(7, 4, 2, 8), case(8, 4, 2, 9),     # two of them
        case(9, 5, 1, None, segment=None), case(10, 5, 2, 3, segment=None),
        case(11, 1, 4, 0, family=1, person=2),
        case(12, 6, None, 4),                                     # of no type
    ], CASE)


def test_keys_write_missing_levels_as_na(cases):
    got = {r.caseid: r for r in plan.with_case_keys(cases).collect()}
    assert got[9].segment_key == "398_NA" and got[9].participant_key == "398_NA_5_NA"
    assert got[11].person_key == "398_1_1_1_2" and got[1].family_key == "398_1_1_NA"


def test_participant_ids(cases):
    keyed = plan.with_case_keys(cases)
    got = sorted([(r.caseid, r.participantid_x, r.participantid_y, r.participantid2)
                  for r in plan.propagate_participant(keyed).collect()], key=str)
    assert got == sorted([
        (1, 0, 7, 7), (2, 7, 7, 7), (3, 0, None, None), (4, None, None, None),
        (5, 5, None, 5), (6, 0, 8, 8), (6, 0, 9, 9), (7, 8, 8, 8), (8, 9, 9, 9),
        (9, None, 3, 3), (10, 3, 3, 3), (11, 0, 0, 0),
    ], key=str)
    single = plan.propagate_participant(keyed, one_per_dwelling=True)
    assert single.filter("caseid = 6").select("participantid2").collect() == [(8,)]


def test_reconciliation_on_all_pairs(spark):
    values = [None, -1, 0, 1, 7]
    data, dwelling = [], 0
    for x, y in itertools.product(values, values):
        dwelling += 1
        data += [case(dwelling, dwelling, 1, x), case(1000 + dwelling, dwelling, 2, y)]
    keyed = plan.with_case_keys(spark.createDataFrame(data, CASE))
    got = {r.caseid: r.participantid2 for r in plan.propagate_participant(keyed).collect()}

    def rule(x, y):
        if x is None and y is None:
            return None
        if y is None:
            return x if x > 0 else None
        if x is None:
            return y if y > 0 else None
        if x == y or x > 0:
            return x
        return y if x == 0 and y > 0 else v.ID_NOT_COVERED

    for i, (x, y) in enumerate(itertools.product(values, values), 1):
        assert got[i] == rule(x, y), (x, y)


def test_hot_dwelling_gives_the_same_rows(spark):
    data = [case(i, 1, 1, i % 3) for i in range(40)] + [case(100 + i, 1, 2, i) for i in range(25)]
    data += [case(500 + i, 2 + i, 1 + i % 2, i % 4) for i in range(40)]
    keyed = plan.with_case_keys(spark.createDataFrame(data, CASE).repartition(3))
    plain = plan.propagate_participant(keyed)
    spread = plan.propagate_participant(keyed, hot_rows=5, hot_share=0.01, rows_per_split=4)
    assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()),
                                                                   key=str)


@pytest.mark.parametrize("moment", [
    "timestamp_ntz'2021-07-01 03:30:00'", "bigint(1625110200)",
    "timestamp'2021-07-01 03:30:00+00:00'",
])
def test_current_dates_show_the_report_zone(spark, cases, moment):
    current = spark.createDataFrame([(1, "2", 5, "ip")], "caseid bigint, case_disposition string, "
                                    "employee_id int, case_ip_address string")
    current = current.withColumn("case_date", F.expr(moment))
    got = plan.with_current_status(cases, current).filter("caseid = 1").first()
    assert got.curr_case_date == datetime(2021, 6, 30, 23, 30)
    assert got.case_disposition == "2"


def test_stages_count_the_flags_and_strict_ones_are_poisoned(spark, cases):
    more = cases.unionByName(spark.createDataFrame([case(20, 9, 1, 1, stand=420)], CASE))
    current = spark.createDataFrame([
        (1, None, "11", 5, None), (3, None, "2", 0, None), (5, None, "30", 4, None),
        (6, None, "50", 4, None), (20, None, "70", None, None),
    ], CURRENT)
    fact = dashboard_fact(more, current)
    got = {(r.standid, r.visioid): r["count"] for r in screener_stages(fact).collect()}
    # Case 6 appears twice: its dwelling has two relationship parts.
    assert got == {
        (398, 3): 5, (398, 4): 4, (398, 5): 1, (398, 6): 1, (398, 7): 1, (398, 8): 2,
        (420, 3): 1, (420, 4): None, (420, 5): 1, (420, 6): 0, (420, 7): 0, (420, 8): 0,
    }


def test_fact_shuffles_no_pasted_key_but_the_dwelling(spark, cases):
    current = spark.createDataFrame([(1, datetime(2020, 1, 1), "51", 5, "ip")],
                                    "caseid long, case_date timestamp, case_disposition string, employee_id long, case_ip_address string")
    fact = dashboard_fact(cases, current)
    pasted = ["segment_key", "dwelling_key", "family_key", "person_key", "participant_key"]
    keyed = plan.with_current_status(plan.propagate_participant(plan.with_case_keys(cases)), current)
    assert fact.columns[:len(keyed.columns)] == keyed.columns
    same = fact.select("caseid", "participantid_y", *pasted)
    expected = keyed.select("caseid", "participantid_y", *pasted)
    assert sorted(map(str, same.collect())) == sorted(map(str, expected.collect()))
    moved = [line for line in fact._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert moved
    below = fact._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    assert not any(f"AS {k}#" in below for k in pasted if k != "dwelling_key")


def test_keys_that_begin_alike_have_the_same_text(spark):
    df = spark.createDataFrame([(1, None, 3), (None, 2.0, None)], "a int, b double, c long")
    keys = {"k1": ["a", "b"], "k2": ["a", "b", "c"], "k3": ["b", "a"], "k4": ["a", "b", "c", "c"]}
    found = with_keys(df, keys)
    assert found.columns == [*df.columns, *keys]
    assert [r[3:] for r in found.collect()] == [r[:] for r in df.select(*[key_of(df, p) for p in keys.values()]).collect()]
    over = df.withColumn("k1", F.lit("own"))
    assert [r["k2"] for r in with_keys(over, {"k1": ["a"], "k2": ["k1", "c"]}).collect()] == ["own_3", "own_NA"]


def test_keys_and_flags_are_not_moved_to_the_buckets(spark, rows, cases):
    current = spark.createDataFrame([(1, datetime(2021, 3, 1), "10", 5, "10.0.0.1")], CURRENT)
    people = cases.select("standid", "segmentid", "dwellingid", "participantid").distinct()
    narrow, fact = fact_rows(cases, current), dashboard_fact(cases, current)
    assert not {c for c in narrow.columns if c.endswith("_key")} and "released_dwelling" not in narrow.columns
    assert finished_fact(narrow).columns == fact.columns
    moved, _ = bucket_star(narrow, people, 2, finish=finished_fact)
    whole, _ = bucket_star(fact, people, 2)
    assert moved.rows().columns == whole.rows().columns == fact.columns
    assert rows(moved.rows()) == rows(whole.rows()) == rows(fact)
